"""Encoding of a corpus with a public tokenizer, by overlapping chunks.

Texts of up to ``chunk_chars`` are one chunk and are encoded where they are read, without a shuffle.
A longer text is cut into overlapping chunks that are pre-tokenised in parallel. Two neighbouring
scans are stitched at the first pre-token boundary that both have within their overlap: from a shared
boundary on, the scanner has no memory, so both go on alike. The pieces between the stitches are then
encoded in parallel and joined. Where a seam has no shared boundary, the whole text is encoded as one
piece, which is exact too. Decoding is the concatenation of the tokens' bytes.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512
#: Characters at the end of a chunk within which a match may still depend on what follows the chunk.
MARGIN = 4
SLICE_ROWS = 1024


def rank_file(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Place of a rank file; ``folder`` overrides the installed package of public vocabularies."""
    if folder is None:
        folder = os.environ.get("FOLIO_TOKENIZERS")
    if folder is None:
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(folder, name)


@lru_cache(maxsize=4)
def encoding(path: str):
    """The encoder of a rank file; read once per Python worker. It knows no special tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding(
        os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


@lru_cache(maxsize=1)
def pre_token_pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def stable_ends(chunk: str, last: bool) -> list[int]:
    """Ends of the pre-tokens of a chunk at which a text may be cut: they follow a character that is no
    white space, and the match before them can't change with what follows the chunk."""
    limit = len(chunk) if last else len(chunk) - MARGIN
    ends = []
    for match in pre_token_pattern().finditer(chunk):
        end = match.end()
        if end > limit:
            break
        if not chunk[end - 1].isspace():
            ends.append(end)
    return ends


def id_arrays(texts: list[str], path: str) -> pa.Array:
    """Token ids of each text as a list array."""
    import numpy as np

    encode = encoding(path).encode_ordinary
    parts = [encode(text) if text else [] for text in texts]
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(part) for part in parts], out=offsets[1:])
    flat = np.fromiter((i for part in parts for i in part), np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def _encode_rows(path: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                ids = id_arrays(part.column("__text").to_pylist(), path)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), ids], [*keep, "__ids"])

    return run


def _chunks(size: int, overlap: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(key).to_pylist(), batch.column("__text").to_pylist()):
                count = -(-len(text) // size)
                starts = [max(0, k * size - overlap) for k in range(count)]
                ends = [min(len(text), (k + 1) * size + overlap) for k in range(count)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "__key": [row] * count,
                        "__k": list(range(count)),
                        "__start": starts,
                        "__last": [e == len(text) for e in ends],
                        "__chunk": [text[a:b] for a, b in zip(starts, ends)],
                    },
                    schema=pa.schema(
                        [("__key", pa.string()), ("__k", pa.int32()), ("__start", pa.int64()), ("__last", pa.bool_()), ("__chunk", pa.string())]
                    ),
                )

    return run


def _seams(size: int, overlap: int):
    """Adds the boundaries that lie in the overlaps with the chunk before and the chunk after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for k, start, last, chunk in zip(*(batch.column(c).to_pylist() for c in ("__k", "__start", "__last", "__chunk"))):
                ends = [start + e for e in stable_ends(chunk, last)]
                seam, following = k * size, (k + 1) * size
                heads.append([e for e in ends if seam - overlap < e < seam + overlap] if k else [])
                tails.append([] if last else [e for e in ends if following - overlap < e < following + overlap])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
                [*batch.schema.names, "__head", "__tail"],
            )

    return run


def encode_corpus(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    out: str = "ids",
    path: str | None = None,
    chunk_chars: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """``key`` and the token ids of ``text`` of every row, as ``out`` ARRAY<INT>.

    Ids are those of the plain encoder without special tokens; strings that look like special tokens
    are ordinary text. A null text and an empty one give the empty list. Repeated rows give repeated
    results; rows with a null key are encoded too. Other columns are ignored, whatever their names.
    """
    if not 0 < 2 * overlap < chunk_chars:
        raise ValueError("overlap must be positive and less than half of chunk_chars")
    path = path or rank_file()
    kind = docs.schema[key].dataType.simpleString()
    base = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    whole = base.where(F.length("__text") <= chunk_chars).mapInArrow(
        _encode_rows(path, ["__key"]), f"__key {kind}, __ids array<int>"
    )

    # Copies of a long text are encoded once; its digest leads back to all rows that hold it.
    held = base.where(F.length("__text") > chunk_chars).withColumn("__row", F.md5("__text"))
    long = held.select("__row", "__text").dropDuplicates(["__row"])
    chunks = long.mapInArrow(
        _chunks(chunk_chars, overlap, "__row"), "__key string, __k int, __start bigint, __last boolean, __chunk string"
    )
    scanned = chunks.repartition("__key", "__k").mapInArrow(
        _seams(chunk_chars, overlap),
        "__key string, __k int, __start bigint, __last boolean, __chunk string, __head array<bigint>, __tail array<bigint>",
    )
    by_row = "partition by __key order by __k"
    cut = scanned.selectExpr(
        "*",
        f"if(__k = 0, 0, array_min(array_intersect(__head, lag(__tail) over ({by_row})))) as __from",
    ).selectExpr(
        "*",
        f"if(__last, __start + length(__chunk), lead(__from) over ({by_row})) as __to",
        "count_if(__from is null) over (partition by __key) as __open",
    )
    pieces = (
        cut.where("__open = 0")
        .selectExpr("__key as __row", "__k", "substring(__chunk, int(__from - __start + 1), int(__to - __from)) as __text")
        .repartition("__row", "__k")
        .mapInArrow(_encode_rows(path, ["__row", "__k"]), "__row string, __k int, __ids array<int>")
        .groupBy("__row")
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__ids"))), lambda p: p["__ids"])).alias("__ids"))
    )
    unstitched = long.join(
        cut.where("__open > 0").select(F.col("__key").alias("__row")).distinct(), "__row", "left_semi"
    ).mapInArrow(_encode_rows(path, ["__row"]), "__row string, __ids array<int>")
    stitched = held.select("__key", "__row").join(pieces.unionByName(unstitched), "__row").select("__key", "__ids")
    return whole.unionByName(stitched).select(F.col("__key").alias(key), F.col("__ids").alias(out))


def decode_corpus(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``key`` and ``text`` of rows of ids: the tokens' bytes joined. Null ids give a null text."""
    path = path or rank_file()
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if i is None else encoding(path).decode(i) for i in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(texts, pa.string())], ["__key", "text"])

    return (
        encoded.select(F.col(key).alias("__key"), F.col(ids).alias("__ids"))
        .mapInArrow(run, f"__key {kind}, text string")
        .withColumnRenamed("__key", key)
    )
