"""Nested JSON records as related flat tables.

Each record is read once into triples of path, ordinals and value: the path names the keys on the way
(``concepts[].evidence_ids[]``), the ordinals are the positions in the lists passed. Triples are
grouped by their repeated ancestor, that is the path up to its last ``[]``, and each group is pivoted
into one table with a row for every combination of ordinals.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import Unreadable, read

SLICE_ROWS = 256
#: Digests of rows that a task remembers to have read.
MOST_SEEN = 1_000_000
UNREADABLE = "unreadable"
TRIPLES = "path string, ordinals array<int>, kind string, value string"

#: Lists of a run and the lists nested in them: their place in the record. Fixed names of the stored format.
LISTS = (
    "concepts",
    "concepts[].evidence_ids",
    "concepts[].source_urls",
    "evidence",
    "concept_explanations",
    "concept_explanations[].supporting_evidence",
    "concept_explanations[].reliability.limitations",
    "relationships",
    "relationships[].paper_ids",
    "warnings",
    "trace",
)
#: Keys under which an envelope holds the record proper.
WRAPPERS = ("response",)


def _shred(lists: tuple[str, ...], wrappers: tuple[str, ...], only: frozenset[str] | None, keys: list[str]):
    known = frozenset(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple] = set()  # rows that are equal in key and digest are read once a task
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                rows, columns = [], ([], [], [], [])
                marks = zip(part.column("__key").to_pylist(), part.column("__digest").to_pylist()) if "__digest" in keys else None
                for i, text in enumerate(part.column("__json").to_pylist()):
                    if marks is not None:
                        mark = next(marks)
                        if mark in done:
                            continue
                        if len(done) >= MOST_SEEN:
                            done.clear()
                        done.add(mark)
                    try:
                        found = read(text, known, wrappers, only)
                    except Unreadable as error:
                        found = [("", [], UNREADABLE, str(error))] if only is None or "" in only else []
                    rows += [i] * len(found)
                    for triple in found:
                        for column, x in zip(columns, triple):
                            column.append(x)
                at = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c).take(at) for c in keys),
                        pa.array(columns[0], pa.string()),
                        pa.array(columns[1], pa.list_(pa.int32())),
                        pa.array(columns[2], pa.string()),
                        pa.array([None if v is None else v.encode("utf-8", "replace").decode() for v in columns[3]], pa.string()),
                    ],
                    [*keys, "path", "ordinals", "kind", "value"],
                )

    return run


def shred(
    records: DataFrame,
    key: str,
    text: str,
    lists: tuple[str, ...] = LISTS,
    wrappers: tuple[str, ...] = WRAPPERS,
    only: frozenset[str] | None = None,
) -> DataFrame:
    """Triples of the JSON texts: ``key``, path, ordinals, kind, value; of the paths in ``only``, if given.

    Null texts give no rows. A text that isn't JSON or holds no object gives one row, of path "" and kind
    ``unreadable``, whose value is the reason (not if ``only`` leaves out the path ""). The texts are read
    row by row without a shuffle; a repeated row gives its triples again.
    """
    kind = records.schema[key].dataType.simpleString()
    return (
        records.select(F.col(key).alias("__key"), F.col(text).alias("__json"))
        .where(F.col("__json").isNotNull())
        .mapInArrow(_shred(lists, wrappers, only, ["__key"]), f"__key {kind}, {TRIPLES}")
        .withColumnRenamed("__key", key)
    )


def shred_latest(
    records: DataFrame,
    key: str,
    at: str,
    text: str,
    lists: tuple[str, ...] = LISTS,
    wrappers: tuple[str, ...] = WRAPPERS,
    only: frozenset[str] | None = None,
) -> DataFrame:
    """The triples of each key's latest row by ``at``: nulls of ``at`` come first; of different texts at
    one time the one with the greatest digest counts. Rows with a null key are dropped.

    The texts themselves are never shuffled: the latest row of a key is found from key, time and digest
    alone, and the triples, read where the rows lie, meet it by key and digest. Versions of a hot key
    spread by digest; equal rows are read once a task. The output is partitioned by key and digest.
    """
    kind = records.schema[key].dataType.simpleString()
    rows = records.where(F.col(key).isNotNull()).select(
        F.col(key).alias("__key"), F.col(at).alias("__at"), F.xxhash64(F.col(at), F.col(text)).alias("__digest"), F.col(text).alias("__json")
    )
    last = rows.groupBy("__key").agg(F.max(F.struct("__at", "__digest")).alias("__last")).select("__key", F.col("__last.__digest").alias("__digest"))
    found = rows.where("__json is not null").select("__key", "__digest", "__json").mapInArrow(
        _shred(lists, wrappers, only, ["__key", "__digest"]), f"__key {kind}, __digest bigint, {TRIPLES}"
    )
    # the same triple from another task's copy of the row changes no pivot: each takes the greatest value
    return found.join(last, ["__key", "__digest"]).withColumnRenamed("__key", key)


def latest(rows: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """The row of each key with the greatest ``at``; nulls of ``at`` come first, ties go to the greatest
    of ``columns`` in order. A hash aggregate with partial steps, so a hot key is reduced before the
    shuffle. Rows with a null key are dropped."""
    return (
        rows.where(F.col(key).isNotNull())
        .groupBy(F.col(key))
        .agg(F.max(F.struct(F.col(at).alias("__at"), *(F.col(c) for c in columns))).alias("__row"))
        .select(key, F.col("__row.__at").alias(at), *(F.col(f"__row.{c}").alias(c) for c in columns))
    )


def group_of() -> Column:
    """The path of a triple's repeated ancestor: its path up to the last ``[]``, "" if there is none."""
    return F.regexp_extract("path", r"^(.*\[\])?", 0)


def grouped(triples_: DataFrame, key: str) -> DataFrame:
    """All tables as one: a row for each key, group (path of the repeated ancestor) and ordinals, with
    ``fields``, a map of the paths below the group ("" for the element itself) to their values."""
    below = F.regexp_replace(F.expr("substring(path, length(group) + 1)"), r"^\.", "")
    values = triples_.where(f"kind <> '{UNREADABLE}'").withColumn("group", group_of()).withColumn("field", below)
    once = values.groupBy(key, "group", "ordinals", "field").agg(F.max("value").alias("value"))
    entry = F.when(F.col("value").isNotNull(), F.struct("field", "value"))
    return once.groupBy(key, "group", "ordinals").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("fields"))


def pivot_group(triples_: DataFrame, key: str, group: str, fields: dict[str, str], depth: int) -> DataFrame:
    """One table of the rows that repeat at ``group``, a path that ends in ``[]`` (or "" for the record).

    A row for each key and ordinals with a node at or below the group; ``fields`` maps column names to
    paths below the group ("" for the element itself). Columns: key, ``ordinals`` cut to ``depth``,
    the fields as STRING, and ``rest``, a map of all other fields below the group, so that unknown
    ones are kept (null if there are none). Fields that repeat themselves belong to an own group.
    """
    prefix = group + "." if group else ""
    wanted = {name: (prefix + path if path else group) for name, path in fields.items()}
    inside = triples_.where((F.col("kind") != UNREADABLE) & (F.size("ordinals") == depth) & (group_of() == group))
    other = F.when(~F.col("path").isin(*wanted.values()) & F.col("value").isNotNull(), F.struct(F.substring("path", len(prefix) + 1, 1 << 30).alias("field"), F.col("value")))
    rows = inside.groupBy(key, "ordinals").agg(
        *(F.max(F.when(F.col("path") == path, F.col("value"))).alias(name) for name, path in wanted.items()), F.array_sort(F.collect_set(other)).alias("__rest")
    )
    return rows.withColumn("rest", F.when(F.size("__rest") > 0, F.map_from_entries("__rest"))).drop("__rest")


def parent(depth: int) -> Column:
    """Ordinals of the ancestor at ``depth``."""
    return F.slice("ordinals", 1, depth)


def run_tables(runs: DataFrame, key: str = "run_id", at: str = "created_at", text: str = "response_json") -> dict[str, DataFrame]:
    """Flat tables of stored runs, of each key's latest row: runs, concepts, evidence, explanations,
    relationships and their lists. ``ordinals`` with the run's key is each table's own key; its first
    members are the parent's. See ``shred`` for nulls and unreadable texts."""
    from ..session import durable

    flat = durable(shred_latest(runs, key, at, text).drop("__digest"))
    table = lambda group, depth, **fields: pivot_group(flat, key, group, fields, depth)
    return {
        "runs": table("", 0, status="status", title="paper.title", year="paper.year", source_url="paper.source_url",
                      document_format="document_format", ocr_used="ocr_used", thesis="thesis", summary="summary",
                      relevance="relevance", latency_ms="quality.latency_ms", coverage="quality.coverage"),
        "authors": table("paper.authors[]", 1, author=""),
        "concepts": table("concepts[]", 1, id="id", label="label", kind="kind", description="description",
                          confidence="confidence", concept_type="concept_type", wikidata_id="wikidata_id",
                          recognition_status="recognition_status"),
        "concept_evidence": table("concepts[].evidence_ids[]", 2, evidence_id=""),
        "concept_urls": table("concepts[].source_urls[]", 2, url=""),
        "evidence": table("evidence[]", 1, id="id", claim="claim", kind="kind", excerpt="excerpt",
                          source_location="source_location", confidence="confidence"),
        "explanations": table("concept_explanations[]", 1, concept_id="concept_id", term="term", kind="kind",
                              definition="definition", support_status="support_status", score="reliability.score",
                              label="reliability.label", rationale="reliability.rationale"),
        "explanation_evidence": table("concept_explanations[].supporting_evidence[]", 2, evidence_id="evidence_id",
                                      claim="claim", excerpt="excerpt", confidence="confidence"),
        "explanation_limitations": table("concept_explanations[].reliability.limitations[]", 2, limitation=""),
        "relationships": table("relationships[]", 1, source_id="source_id", target_id="target_id",
                               relationship_type="relationship_type", explanation="explanation", confidence="confidence"),
        "relationship_papers": table("relationships[].paper_ids[]", 2, paper_id=""),
        "warnings": table("warnings[]", 1, warning=""),
        "trace": table("trace[]", 1, step=""),
        "unreadable": flat.where(F.col("kind") == UNREADABLE).select(key, "ordinals", F.col("value").alias("reason")).distinct(),
    }


#: Entity: list path, path of the element's id below it (None: its position), parent's id path (None: run, "": position).
ELEMENTS = (
    ("concepts", "concepts[]", "id", None),
    ("evidence", "evidence[]", "id", None),
    ("explanations", "concept_explanations[]", "concept_id", None),
    ("relationships", "relationships[]", None, None),
    ("warnings", "warnings[]", None, None),
    ("trace", "trace[]", None, None),
    ("concept_evidence", "concepts[].evidence_ids[]", "", "concepts[].id"),
    ("concept_urls", "concepts[].source_urls[]", None, "concepts[].id"),
    ("explanation_evidence", "concept_explanations[].supporting_evidence[]", "evidence_id", "concept_explanations[].concept_id"),
    ("explanation_limitations", "concept_explanations[].reliability.limitations[]", None, "concept_explanations[].concept_id"),
    ("relationship_papers", "relationships[].paper_ids[]", "", ""),
)


def run_elements(runs: DataFrame, key: str = "run_id", at: str = "created_at", text: str = "response_json") -> DataFrame:
    """One row for each element nested in each key's latest row: key, entity, parent_id, item_id.

    Ids are those the element and its parent carry, else null; positions count from 0. Distinct rows.
    The pivot of all groups is one aggregation by key, group and ordinals; parents are found by a
    window over the element's first ordinal. Both reuse the partitioning by which the triples met the
    latest rows, so the triples are shuffled once.
    """
    wanted = frozenset(p for _, group, item, _ in ELEMENTS for p in (group, f"{group}.{item}"))
    flat = shred_latest(runs, key, at, text, only=wanted)
    path, ordinals, value = F.col("path"), F.col("ordinals"), F.col("value")
    marks = []
    for name, group, item, _ in ELEMENTS:
        own = group if item in (None, "") else f"{group}.{item}"
        # an element that is a bare string is its own id
        marks.append(F.when(path.isin(group, own), F.struct(F.lit(name).alias("entity"), value.alias("item"))))
    of_parent = {name: p for name, _, _, p in ELEMENTS if p}
    rows = flat.withColumn("__m", F.coalesce(*marks)).where(F.col("__m").isNotNull())
    pivoted = rows.groupBy(key, "__digest", "ordinals", F.col("__m.entity").alias("entity")).agg(F.max("__m.item").alias("item"))
    by_position = [name for name, _, item, _ in ELEMENTS if item is None]
    family = F.expr("case when entity like 'concept%' then 'c' when entity like 'explanation%' then 'x' else entity end")
    holder = F.max(F.when(F.col("entity").isin("concepts", "explanations"), F.col("item"))).over(
        _window(key, "__digest", family, ordinals[0])
    )
    parent_id = (
        F.when(F.col("entity").isin(*[n for n, p in of_parent.items() if p != ""]), holder)
        .when(F.col("entity") == "relationship_papers", ordinals[0].cast("string"))
        .otherwise(F.col(key).cast("string"))
    )
    item_id = F.when(F.col("entity").isin(*by_position), F.element_at(ordinals, -1).cast("string")).otherwise(F.col("item"))
    # distinct within the digest, of which each key has one, so that the partitioning serves once more
    found = pivoted.select(key, "__digest", "entity", parent_id.alias("parent_id"), item_id.alias("item_id"))
    return found.distinct().drop("__digest")


def _window(*by):
    from pyspark.sql import Window

    return Window.partitionBy(*by)
