"""Queries of the training-data operators; SQL only where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_repaired(spark: SparkSession, folder: str) -> DataFrame:
    from .scans import repair_reads

    return repair_reads(_table(spark, folder, "reads")).distinct()


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    from .scans import spoiled_lines

    return spoiled_lines(_table(spark, folder, "reads"), _table(spark, folder, "paragraphs"))


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    from .split import split_chunks

    return split_chunks(_table(spark, folder, "chunks"), _table(spark, folder, "reads"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_pieces(spark, folder).select("read_id", "id").distinct()


def p3_feeds(spark: SparkSession, folder: str) -> DataFrame:
    from .truncation import cut_by_feed, judge_ends

    return cut_by_feed(judge_ends(_table(spark, folder, "evidence"), _table(spark, folder, "reads")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    from .truncation import judge_ends

    judged = judge_ends(_table(spark, folder, "evidence"), _table(spark, folder, "reads"))
    return judged.where("cut").select("origin", "doc_id", "item_id").distinct()


def p4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    from .boilerplate import main_text

    return main_text(_table(spark, folder, "reads"), _table(spark, folder, "papers")).distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    from .boilerplate import furniture_lines

    return furniture_lines(_table(spark, folder, "reads"), _table(spark, folder, "papers")).distinct()


def p6_clean_reads(spark: SparkSession, folder: str) -> DataFrame:
    from .residue import flag_residue

    reads = _table(spark, folder, "reads")
    flags = flag_residue(reads).groupBy("read_id").agg(F.max("residue").alias("residue"))
    return reads.join(flags.where("residue"), "read_id", "left_anti")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    from .residue import flag_residue

    return flag_residue(_table(spark, folder, "reads")).where("residue").select("read_id").distinct()


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    from .encode import encode_corpus

    return encode_corpus(_table(spark, folder, "documents"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_containers(spark, folder).where("piece > 0").select("doc_id").distinct()


def p9_levels(spark: SparkSession, folder: str) -> DataFrame:
    from .reading import reading_levels

    return reading_levels(_table(spark, folder, "documents"), _table(spark, folder, "reading_refs"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    from .reading import MIN_WORDS

    return p9_levels(spark, folder).where(F.col("english") & (F.col("n_words") >= MIN_WORDS) & (F.col("whole_level") == 5)).select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_repaired": p1_repaired,
        "p2_found": p2_found,
        "p2_pieces": p2_pieces,
        "p3_found": p3_found,
        "p3_feeds": p3_feeds,
        "p4_found": p4_found,
        "p4_main_text": p4_main_text,
        "p6_found": p6_found,
        "p6_clean_reads": p6_clean_reads,
        "p7_ids": p7_ids,
        "p8_found": p8_found,
        "p8_containers": p8_containers,
        "p9_found": p9_found,
        "p9_levels": p9_levels,
    }


def oracle_sql() -> dict[str, str]:
    return {"p2_found": "SELECT DISTINCT read_id, id FROM chunks WHERE length(text) > 4000"}
