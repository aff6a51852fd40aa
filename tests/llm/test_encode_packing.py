import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import encode, packing


def reference(text):
    return encode.encoding(encode.rank_file()).encode_ordinary(text or "")


def texts():
    rng = random.Random(5)
    words = ["rain", " falls", "\n\n", "  ", "it's", "émigré", "水位变化", "<|endoftext|>", "123456", "!!!", "\t", "🙂", " x1"]
    return ["".join(rng.choice(words) for _ in range(n)) for n in (3, 200, 900)] + ["a" * 2000, " " * 2000, "", None, "水" * 900, "word " * 500, "word " * 500]


def test_chunks_give_the_plain_ids(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows] + [(None, "null key", "x", "y")], "doc_id long, text string, ids string, piece string")
    got = {r["doc_id"]: list(r["ids"]) for r in encode.encode_corpus(docs, chunk_chars=400, overlap=60).collect()}
    assert got == {**{i: reference(t) for i, t in rows}, None: reference("null key")}
    assert encode.encode_corpus(docs.limit(0)).count() == 0
    back = {r["doc_id"]: r["text"] for r in encode.decode_corpus(encode.encode_corpus(docs)).collect()}
    assert back == {**{i: t or "" for i, t in rows}, None: "null key"}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab '!\n\t1é水sl", max_size=120), st.integers(5, 60))
def test_pieces_cut_at_stable_ends_encode_alike(text, at):
    for cut in [e for e in encode.stable_ends(text, True) if e <= at]:
        assert reference(text[:cut]) + reference(text[cut:]) == reference(text)


def test_every_document_has_its_place(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["rain", "seed", "bank", "gauge"]) for _ in range(rng.choice([0, 5, 40, 90, 300])))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, rows[1][1]), (902, rows[1][1]), (None, "no key")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, piece int")
    placed = packing.pack(docs, capacity=100, shard_items=80).collect()
    containers = {}
    for r in placed:
        containers.setdefault(r["container"], []).append(r)
    for items in containers.values():
        items.sort(key=lambda r: r["place"])
        assert [r["place"] for r in items] == list(range(len(items)))
        assert sum(r["n_tokens"] for r in items) <= 100
        assert [r["offset"] for r in items] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in items])[:-1]]).tolist()
    by = {}
    for r in placed:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        n = len(reference(t)) * (2 if i == 902 else 1)
        assert sum(r["n_tokens"] for r in by[i]) == n
        if n <= 100:
            assert all(r["piece"] == 0 for r in by[i])
    used = sum(r["n_tokens"] for r in placed)
    assert used / (100 * len(containers)) > 0.9
    assert packing.pack(docs.limit(0)).count() == 0


def test_neighbours_share_a_container():
    # two topics of equal sizes: containers hold one topic each
    terms = np.concatenate([np.repeat([1, 2, 3], 4) if i % 2 else np.repeat([7, 8, 9], 4) for i in range(16)])
    container, _ = packing.fill(np.full(16, 12), terms, np.arange(0, 193, 12), 48)
    for c in range(4):
        assert len({i % 2 for i in np.flatnonzero(container == c)}) == 1


def test_scores_are_those_of_plain_bm25():
    rng = np.random.default_rng(4)
    items = [rng.integers(0, 60, rng.integers(1, 40)) for _ in range(300)]
    sizes = np.array([len(x) for x in items])
    index = packing.Index(sizes, np.concatenate(items), np.concatenate([[0], np.cumsum(sizes)]))
    index.prepare(np.arange(0, 300, 7))
    df = {t: sum(t in x for x in map(set, map(np.ndarray.tolist, items))) for t in range(60)}
    for seed in (0, 7, 11, 299):
        got = dict(zip(*map(np.ndarray.tolist, index.neighbours(seed))))
        for i, x in enumerate(items):
            want = 0.0
            for t in set(items[seed].tolist()):
                tf = int((x == t).sum())
                want += np.log1p((300 - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / sizes.mean()))
            assert abs(got.get(i, 0.0) - want) < 1e-3


def test_neighbours_share_a_shard(spark):
    rng = random.Random(6)
    topics = [[f"{a}{k}word" for k in range(40)] for a in "abcdefgh"]
    rows = [(i, " ".join(rng.choice(topics[i % 8]) for _ in range(30))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = packing.pack(docs, capacity=1200, shard_items=200).collect()
    shards = {r["doc_id"]: r["container"].split("-")[1] for r in placed}
    assert len(set(shards.values())) >= 4
    # the neighbours of a document are those of its topic
    together = sum(shards[i] == shards[j] for i in range(0, 800, 50) for j in range(800) if i != j and i % 8 == j % 8)
    assert together >= 0.9 * sum(1 for i in range(0, 800, 50) for j in range(800) if i != j and i % 8 == j % 8)
