"""Progress of runs as streams: stages as events, the fold of their states, windows over events, retries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

#: The stages of a run in order.
STAGES = ("queued", "validate_input", "ingest_document", "extract_structure", "validate_output", "explain_concepts", "summarise_paper", "compare_papers", "complete")


def stage_events(requests: DataFrame, key: str = "run_id") -> DataFrame:
    """An event for each stage of each request: key, seq, node, status, trace."""
    stages = F.array(*map(F.lit, STAGES))
    return requests.select(key, F.posexplode(stages).alias("seq", "node")).select(
        key, "seq", "node", F.when(F.col("node") == "complete", "completed").when(F.col("node") == "queued", "queued").otherwise("running").alias("status"),
        F.array(F.concat(F.lit("passed "), "node")).alias("trace"),
    )


def write_progress(requests: DataFrame, path: str, checkpoint: str, key: str = "run_id") -> StreamingQuery:
    """Append the stage events of a stream of requests to a table; what has come is written, then it ends."""
    return (
        stage_events(requests, key).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def tumbling(events: DataFrame, at: str = "ts", late: str = "10 minutes", size: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts by window and type of a stream or a table of events; later ones than ``late`` are dropped from streams."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark(at, late)
    return timed.groupBy(F.window(at, size), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("window.start").alias("start"), by, "n", "total"
    )


def first_deliveries(events: DataFrame, key: str, at: str, late: str = "10 minutes") -> DataFrame:
    """Each key once: its first delivery within the watermark of a stream, any one of a table."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else timed.dropDuplicates([key])


def retried(inputs: DataFrame, run: Callable[[DataFrame], DataFrame], broken: Callable[[DataFrame], DataFrame], retries: int = 1, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Results of ``run`` that aren't ``broken``, and the keys still broken after ``retries`` more tries,
    each of the broken ones only. The loop is over tries, never over rows."""
    results = run(inputs)
    bad = broken(results).select(key).distinct()
    good = results.join(bad, key, "left_anti")
    for _ in range(max(0, min(retries, 3))):
        again = run(inputs.join(bad, key, "left_semi"))
        still = broken(again).select(key).distinct()
        good = good.unionByName(again.join(still, key, "left_anti"))
        bad = still
    return good, bad
