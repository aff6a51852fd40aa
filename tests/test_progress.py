from pyspark.sql import functions as F

from foliospark.operators import store
from foliospark.streaming import progress


def test_progress_stream(spark, tmp_path):
    spark.createDataFrame([("r1",), ("r2",)], "run_id string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id string").parquet(str(tmp_path / "in"))
    progress.write_progress(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    events = spark.read.parquet(str(tmp_path / "out"))
    assert events.count() == 2 * len(progress.STAGES)
    state = {r["run_id"]: (r["status"], len(r["trace"])) for r in store.fold_states(events).collect()}
    assert state == {"r1": ("completed", 9), "r2": ("completed", 9)}


def test_retries_run_the_broken_only(spark):
    seen = []

    def run(df):
        seen.append(sorted(r["doc_id"] for r in df.collect()))
        return df.withColumn("ok", F.lit(len(seen) > 1) | (F.col("doc_id") == 1))

    good, bad = progress.retried(spark.createDataFrame([(1,), (2,)], "doc_id int"), run, lambda r: r.where("not ok"), 1)
    assert seen == [[1, 2], [2]] and good.count() == 2 and bad.count() == 0


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "run_id string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "run_id string, v int")
    assert {tuple(r) for r in store.upsert(old, new).collect()} == {("a", 1), ("b", 2), ("c", 2)}
