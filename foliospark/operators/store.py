"""The store of runs: upsert, lookup, recent ones, projection to JSON, and reading of model output."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .analysis import quality
from .shred import latest


def current_runs(runs: DataFrame, key: str = "run_id", at: str = "created_at", text: str = "response_json") -> DataFrame:
    """The latest row of each key; see ``latest``."""
    return latest(runs, key, at, text)


def upsert(stored: DataFrame, new: DataFrame, key: str = "run_id") -> DataFrame:
    """The stored rows with those of ``new`` in place of theirs of the same key."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def save(new: DataFrame, path: str) -> str | None:
    """Append runs to a table; a warning instead of an error if that fails."""
    try:
        new.write.mode("append").parquet(path)
    except Exception as error:  # noqa: BLE001
        return f"The run could not be saved: {type(error).__name__}"
    return None


def get_run(runs: DataFrame, run_id: str) -> DataFrame:
    return current_runs(runs.where(F.col("run_id") == run_id))


def recent(runs: DataFrame, most: int = 20) -> DataFrame:
    """The newest runs, at least 1 and at most 100; ties go by key."""
    return current_runs(runs).orderBy(F.desc("created_at"), "run_id").limit(max(1, min(most, 100)))


def responses(states: DataFrame, concepts: DataFrame, evidence: DataFrame, key: str = "run_id") -> DataFrame:
    """The response of each run from its last state: key, status, document_format, ocr_used, warnings, trace, usage and quality.

    ``states`` has key, status, document_format, ocr_used, warnings, errors, trace, text, n_chunks, retry_count and
    has_analysis. A run without an analysis has failed, as has any that isn't completed; warnings are followed by
    errors; without an analysis there is no quality. Null lists count as empty, null counts as 0."""
    none = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(c, none)
    shares = quality(concepts, evidence, key)
    there = F.coalesce("has_analysis", F.lit(False))
    usage = F.struct(
        F.coalesce(F.length("text"), F.lit(0)).alias("input_characters"), F.coalesce("n_chunks", F.lit(0)).alias("chunk_count"), F.coalesce("retry_count", F.lit(0)).alias("retries")
    )
    measured = F.struct(
        F.lit(1.0).alias("schema_valid"), F.coalesce("citation_coverage", F.lit(0.0)).alias("citation_coverage"),
        F.coalesce("location_coverage", F.lit(0.0)).alias("evidence_location_coverage"), F.coalesce("retry_count", F.lit(0)).cast("double").alias("retry_count"),
    )
    return states.join(shares, key, "left").select(
        key, F.when(there & (F.col("status") == "completed"), "completed").otherwise("failed").alias("status"), "document_format",
        F.coalesce("ocr_used", F.lit(False)).alias("ocr_used"), F.concat(listed("warnings"), listed("errors")).alias("warnings"), listed("trace").alias("trace"),
        usage.alias("usage"), F.when(there, measured).alias("quality"),
    )


def response(analyses: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc and the analysis as one JSON text."""
    return analyses.select(doc, F.to_json(F.struct(*(c for c in analyses.columns if c != doc))).alias("response_json"))


def existing_papers(forms: DataFrame, key: str = "request_id", json: str = "existing_papers") -> DataFrame:
    """key, n, id, title, abstract and concepts of the papers in a form's JSON list; ``error`` instead for a text that
    is no list of objects with an id and a title. An empty list and a null have no rows."""
    papers = F.from_json(json, "array<struct<id:string,title:string,abstract:string,concepts:array<string>>>")
    rows = forms.where(F.col(json).isNotNull()).select(key, papers.alias("p"), F.coalesce(F.trim(json).startswith("["), F.lit(False)).alias("listed"))
    bad = ~F.col("listed") | F.col("p").isNull() | F.exists("p", lambda x: x.isNull() | x["id"].isNull() | x["title"].isNull())
    good = rows.where(~bad).select(key, F.posexplode("p").alias("n", "x")).select(key, "n", "x.*", F.lit(None).cast("string").alias("error"))
    wrong = rows.where(bad).select(
        key, F.lit(0).alias("n"), *(F.lit(None).cast("string").alias(c) for c in ("id", "title", "abstract")), F.lit(None).cast("array<string>").alias("concepts"),
        F.lit("The existing papers are no list of papers").alias("error"),
    )
    return good.unionByName(wrong)


def event_lines(events: DataFrame) -> DataFrame:
    """Each row as a server-sent event."""
    return events.select(F.concat(F.lit("data: "), F.to_json(F.struct(*events.columns)), F.lit("\n\n")).alias("line"))


def provider_text(raw: Column) -> Column:
    """The text of a model's answer in any of the shapes of its providers; null if it has none."""
    parts = "array<struct<text:string>>"
    joined = lambda path: F.nullif(F.array_join(F.transform(F.from_json(F.get_json_object(raw, path), parts), lambda p: p["text"]), ""), F.lit(""))
    plain = lambda *paths: [F.nullif(F.get_json_object(raw, p), F.lit("")) for p in paths]
    return F.coalesce(
        joined("$.content"), joined("$.output.message.content"),
        *plain("$.completion", "$.generation", "$.outputText", "$.results[0].outputText", "$.results[0].text"),
    )


def json_object(output: Column) -> Column:
    """The JSON object in a model's text: a fenced block, else the whole, else the first brace from which
    an object can be read; null if there is none."""
    fenced = F.nullif(F.regexp_extract(output, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    whole = F.trim(F.coalesce(fenced, output))
    ready = F.when(whole.startswith("{") & F.try_parse_json(whole).isNotNull(), whole)
    return F.coalesce(ready, F.when(F.contains(output, F.lit("{")), _first_object(output)))


@F.pandas_udf(StringType())
def _first_object(texts: pd.Series) -> pd.Series:
    decoder = json.JSONDecoder()

    def find(text: str | None) -> str | None:
        at = text.find("{") if text else -1
        while at >= 0:
            try:
                value, end = decoder.raw_decode(text, at)
                if isinstance(value, dict):
                    return text[at:end]
            except ValueError:
                pass
            at = text.find("{", at + 1)
        return None

    return texts.map(find)


def typed(output: DataFrame, schema: str, key: str = "doc_id", text: str = "raw") -> DataFrame:
    """key, the object read by ``schema`` and whether it could be read."""
    value = F.from_json(json_object(F.coalesce(provider_text(F.col(text)), F.col(text))), schema)
    return output.select(key, value.alias("value")).withColumn("schema_valid", F.col("value").isNotNull())


def fold_states(events: DataFrame, key: str = "run_id", seq: str = "seq") -> DataFrame:
    """The last state of each run from its events (key, seq, node, status, trace): traces are joined in
    order, the other fields are the last's."""
    last = F.max_by(F.struct("node", "status"), seq)
    trace = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(seq, "trace"))), lambda e: F.coalesce(e["trace"], F.array().cast("array<string>"))))
    return events.groupBy(key).agg(last.alias("s"), trace.alias("trace")).select(key, "s.node", "s.status", "trace")


def ranked(rows: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group in the given order, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= most)
