import random

import pytest

from foliospark.llm import split


def test_pieces_cover_overlap_and_end_well():
    rng = random.Random(1)
    words = "rain seed bank gauge valley river stone".split()
    text = "\n\n".join(" ".join(" ".join(rng.choice(words) for _ in range(9)).capitalize() + "." for _ in range(8)) for _ in range(20))
    pieces = split.pieces(text, 1000, 90)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert b - a <= 1000 and b - c == 90 and text[b - 1] == "." and d > b
    assert all(b - a <= 1000 for a, b in pieces)


@pytest.mark.parametrize("text", ["x" * 5000, "水" * 5000, "12;34\n" * 900, "", "short", "a " * 3000, "。" * 4500])
def test_any_text(text):
    pieces = split.pieces(text, 1000, 350)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= 1000 for a, b in pieces)
    assert all(b - c == 350 for (_, b), (c, _) in zip(pieces, pieces[1:]))


def test_cut_at_the_topic_boundary():
    a = "The rain gauge in the valley measures rain and wind and rain again. " * 6
    b = "The stock market sells a bond and a share and a bond once more. " * 6
    first = split.pieces(a + b, 650, 50, block=20)[0]
    assert abs(first[1] - len(a)) <= 2


def test_tables(spark):
    long = "One sentence here. " * 400
    chunks = spark.createDataFrame(
        [(1, "c0", long, 5, "x"), (1, "c0", long, 5, "x"), (1, "c1", "short", 0, "x"), (2, "c0", None, None, "x"), (3, "c0", long, None, "x")],
        "read_id long, id string, text string, start_char int, piece string",
    )
    reads = spark.createDataFrame([(1, "Head. " + long, "p"), (1, "Head. " + long, "p"), (2, None, "p")], "read_id long, text string, id string")
    rows = split.split_chunks(chunks, reads).collect()
    assert {(r["read_id"], r["id"]) for r in rows} == {(1, "c0"), (3, "c0")}
    for r in rows:
        source = "Head. " + long if r["located"] else long
        assert source[r["start_char"] : r["end_char"]] == r["text"] and r["located"] == (r["read_id"] == 1)
    assert split.split_chunks(chunks.limit(0), reads).count() == 0


def test_likely_rows_lose_no_key(spark):
    keys = spark.createDataFrame([(k * 7919,) for k in range(500)], "k long")
    rows = spark.createDataFrame([(k, "t") for k in range(0, 7919 * 500, 131)] + [(k * 7919, "t") for k in range(500)], "read_id long, text string")
    found = {r["read_id"] for r in split.likely_in(rows, "read_id", keys).collect()}
    assert {k * 7919 for k in range(500)} <= found and len(found) < 500 + 20
    assert split.likely_in(rows, "read_id", keys.limit(0)).count() == 0
