import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import boilerplate, boost, grams, reading, residue, scans, truncation

NOUNS = "rain seed bank gauge valley river stone meadow transect network protocol sample".split()


def prose(n, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        a, b, c = rng.choice(NOUNS, 3)
        out.append(f"We recorded the {a} {b} every {rng.integers(2, 900)} minutes because the {c} was held fixed in the valley.")
    return " ".join(out)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab\né水", max_size=12), min_size=1, max_size=6))
def test_line_starts(texts):
    data, offsets = grams.span(pa.array(texts))
    starts, ends, rows = grams.line_starts(data, offsets)
    got = [(int(r), bytes(data[a:b]).decode()) for a, b, r in zip(starts, ends, rows)]
    assert got == [(i, x) for i, t in enumerate(texts) for x in t.split("\n")]


def test_span_of_slices_and_nulls():
    a = pa.array(["x", None, "yé", ""]).slice(1, 3)
    data, offsets = grams.span(a)
    assert bytes(data).decode() == "yé" and offsets.tolist() == [0, 0, 3, 3]


def test_residue(spark):
    rows = [
        (1, "404 Not Found\nThe page you are looking for could not be found.", True), (2, "Title: XXXX\nAbstract: {{ paper.abstract }}", True),
        (3, "Lorem ipsum dolor sit amet, consectetur adipiscing elit. Sed do eiusmod tempor.", True), (4, "zork zork zork zork zork zork zork", True),
        (5, prose(12) + "\nPlease enable JavaScript to use the search box.", False), (6, prose(3) + " The phrase lorem ipsum occurred in many drafts.", False),
        (7, None, False), (8, "", False), (9, "  \n ", False), (10, prose(600), False), (1, "404 Not Found\nThe page you are looking for could not be found.", True),
        (11, "Skip to content\nHome Search About\nYou need to enable JavaScript to run this app.\nTerms of use", True),
    ]
    reads = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(100 + k, prose(30, k), "x") for k in range(20)], "read_id long, text string, residue string")
    flags = {r["read_id"]: r["residue"] for r in residue.flag_residue(reads).collect()}
    assert {i: flags[i] for i, _, _ in rows} == {i: want for i, _, want in rows}
    assert residue.flag_residue(reads.limit(0)).count() == 0


def test_natural_text_is_learned_from_every_distinct_text(spark):
    copy = prose(200, 7)
    natural = [copy] * 1500 + ["\n".join(prose(2, 10 * k + j) for j in range(12)) for k in range(30)]
    script = "\n".join("".join(chr(0x4E00 + int(c)) for c in np.random.default_rng(j).integers(0, 40, 60)) for j in range(30))
    rows = [(i, t) for i, t in enumerate([*natural, script])]
    reads = spark.createDataFrame(rows, "read_id long, text string")
    model = residue.fit(reads)
    data, _ = grams.span(pa.array([script, natural[-1]]))
    assert (model.weights(model.table[grams.hashes(grams.fold(data), residue.ORDER, residue.BITS)]).argmax(axis=1) == 0).mean() > 0.9
    notice = "\nThe page you are looking for could not be found."
    assert not model.residue(pa.array([natural[-1] + notice, script + notice])).any()


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = boost.Trees(rounds=40).fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0) == (y[3000:] > 0)).mean() > 0.93


def test_boilerplate(spark):
    menu = "Home | Archive | Search | Sign in\nWe use cookies to make this site work better. Accept all"
    tail = "Related articles\nOn the seasonal river: evidence from the coast\nMeasuring the stone with a field campaign\nTerms of use | Privacy notice\n© 2020 Harbour Press. All rights reserved."
    reads, papers = [], []
    for k in range(60):
        title = f"On the {NOUNS[k % 12]} {NOUNS[(k + 5) % 12]}: evidence number {k}"
        papers.append((f"d{k}", title))
        body = [title, "Ostander, Velquist", "Abstract", prose(3, k), "1 Introduction", prose(2, k + 100), "Figure 2. Overview of the sites.", prose(2, k + 200)]
        if k % 2:
            reads.append((k, f"d{k}", "html", "\n".join([menu, *body, tail])))
        else:
            reads.append((k, f"d{k}", "pdf", "\n\n".join(body)))
    reads += [(900, "none", "html", None), (901, "none", "html", ""), (902, "none", "html", "404 Not Found\nThe page you are looking for could not be found.")]
    r = spark.createDataFrame([(*x, "z") for x in reads], "read_id long, doc_id string, format string, text string, line_no string")
    p = spark.createDataFrame(papers + papers[:3], "doc_id string, title string")
    found = {}
    for x in boilerplate.furniture_lines(r, p).collect():
        found.setdefault(x["read_id"], set()).add(x["line_no"])
    right = wrong = 0
    for k in range(1, 60, 2):
        lines = reads[k][3].split("\n")
        truth = {1, 2, *range(len(lines) - 4, len(lines) + 1)}
        right += len(truth & found.get(k, set()))
        wrong += len(truth ^ found.get(k, set()))
    assert wrong < 0.1 * right and not {900, 901, 902} & found.keys()
    text = {x["read_id"]: x["text"] for x in boilerplate.main_text(r, p).collect()}
    assert text[1].startswith(papers[1][1]) and "cookies" not in text[1]
    assert boilerplate.furniture_lines(r.limit(0), p).count() == 0


def test_truncation(spark):
    rows = [(f"d{k}", f"e{k}", "f", prose(2, k)) for k in range(400)] + [(f"t{k}", "t", "f", f"Keywords: {NOUNS[k % 12]}, {NOUNS[k % 7]}, {NOUNS[k % 5]}") for k in range(100)]
    cut = [(f"c{k}", "c", "f", prose(2, k + 500)[: 60 + 3 * k]) for k in range(20)]
    marked = [("m", "m", "f", prose(1)[:70] + "...")]
    odd = [("n", "n", "f", None), ("b", "b", "f", ""), ("w", "w", "f", "  "), ("q", "q", None, prose(1) + '"')]
    evidence = spark.createDataFrame([(*x, 1) for x in rows + cut + marked + odd + cut[:1]], "doc_id string, id string, feed_id string, excerpt string, cut int")
    reads = spark.createDataFrame([("r", 1, "f", prose(40)), ("r", 2, "f", prose(40)[:1000] + " We recor"), ("r", 3, "f", None)], "doc_id string, read_id long, feed_id string, text string")
    judged = truncation.judge_ends(evidence, reads)
    flags = {(r["origin"], r["doc_id"], r["item_id"]): r["cut"] for r in judged.collect()}
    hits = [flags["evidence", d, i] for d, i, _, t in cut if not t.rstrip().endswith((".", "minutes"))]
    assert sum(hits) >= 0.9 * len(hits)
    assert sum(flags["evidence", d, i] for d, i, _, _ in rows) <= 0.02 * len(rows)
    assert flags["evidence", "m", "m"] and not any(flags["evidence", d, i] for d, i, _, _ in odd)
    assert flags["reads", "r", "2"] and not flags["reads", "r", "1"] and not flags["reads", "r", "3"]
    feeds = {(r["feed_id"], r["origin"]): r for r in truncation.cut_by_feed(judged).collect()}
    assert feeds["f", "evidence"]["n"] == len(rows) + len(cut) + 1 + 3
    assert truncation.judge_ends(evidence.limit(0), reads.limit(0)).count() == 0


def test_every_value_is_cut_on_purpose(spark, monkeypatch):
    monkeypatch.setattr(truncation, "SAMPLE_CUTS", 5, raising=False)  # a bound on the number of cuts must have no effect
    seen = []
    limits = truncation._limits
    monkeypatch.setattr(truncation, "_limits", lambda judged: seen.append({(r["origin"], r["synthetic"]): r["count"] for r in judged.where("eligible").groupBy("origin", "synthetic").count().collect()}) or limits(judged))
    evidence = spark.createDataFrame([(f"d{k}", f"e{k}", "f", prose(2, k)) for k in range(60)] + [("s", "s", "f", "Too short to cut")], "doc_id string, id string, feed_id string, excerpt string")
    reads = spark.createDataFrame([(f"r{k}", k, "f", prose(20, k)) for k in range(30)], "doc_id string, read_id long, feed_id string, text string")
    judged = truncation.judge_ends(evidence, reads)
    assert seen == [{("evidence", False): 61, ("evidence", True): 60, ("reads", False): 30, ("reads", True): 30}]
    assert judged.count() == 91 and judged.where("doc_id is null or item_id is null").count() == 0


def test_scans(spark):
    clean = prose(60).split(" ")
    lines = [" ".join(clean[k : k + 9]) for k in range(0, len(clean), 9)]
    noisy = list(lines)
    noisy[3] = noisy[3].replace("e", "c", 1) if "e" in noisy[3] else noisy[3]
    noisy[5] = noisy[5].replace("recorded", "rec^orded").replace("valley", "val^ley").replace("minutes", "min^utes")
    noisy[10:10] = ["", "- 14 -", "", "15   On the seed bank and", ""]
    noisy.append("the pro-")
    noisy.append("tocol was held fixed.")
    text = "On the seed bank and the gauge\n\n" + "\n".join(noisy)
    base = [(100 + k, "d", "text", prose(60, k)) for k in range(12)]
    reads = spark.createDataFrame([*base, (1, "s", "pdf", text), (1, "s", "pdf", text), (2, "s", "pdf", None), (3, "s", "pdf", "")], "read_id long, doc_id string, format string, text string")
    block = "\n".join(noisy[14:])
    start = text.index(block)
    paragraphs = spark.createDataFrame(
        [("s", "p1", 1, block, start, len(text)), ("s", "p1", 1, block, start, len(text)), ("z", "p9", 77, "the pro-\ntocol of rain", 0, 22), ("s", "p0", 2, None, None, None)],
        "doc_id string, id string, read_id long, text string, start_char int, end_char int",
    )
    rows = {(r["origin"], r["item_id"], r["line_no"]) for r in scans.spoiled_lines(reads, paragraphs).collect()}
    lines_ = text.split("\n")
    found = {n for o, i, n in rows if o == "reads"}
    wanted = {k + 1 for k, x in enumerate(lines_) if x in ("- 14 -", "15   On the seed bank and", "the pro-") or "^" in x} | {6}
    assert found == wanted
    first = text[:start].count("\n")
    assert {n + first for o, i, n in rows if (o, i) == ("paragraphs", "p1")} == {n for n in wanted if n > first}
    assert ("paragraphs", "p9", 1) in rows
    repaired = {r["read_id"]: r["text"] for r in scans.repair_reads(reads).collect()}
    assert "protocol was held fixed." in repaired[1] and "^" not in repaired[1] and "- 14 -" not in repaired[1]
    assert scans.spoiled_lines(reads.limit(0), paragraphs.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("line", "is_number"),
    [("- 12 -", True), ("Page 3 of 9", True), ("xiv", True), ("|7|", True), ("p. 44", True), ("3 / 8", True), ("12.", False), ("0.5 0.7", False), ("2 Methods", False), ("", False), ("The end", False)],
)
def test_page_numbers(line, is_number):
    assert scans.is_page_number(line) is is_number


WORDS = {w: n for w, n in zip("the of valley network protocol measurements measure was held fixed in we recorded rain seed bank and modern".split(),
                              [9000, 8000, 900, 800, 700, 600, 500, 4000, 600, 500, 7000, 3000, 2500, 800, 700, 600, 8000, 300])}


@pytest.mark.parametrize(
    ("text", "want"),
    [("the networkprotocol was held", "the network protocol was held"), ("in the val ley we recorded", "in the valley we recorded"), ("measure ments of rain", "measurements of rain"),
     ("rnea surements of rain", "measurements of rain"), ("held in thevalley, and the net work, was", "held in the valley, and the network, was"),
     ("Ostander and Velquist recorded", "Ostander and Velquist recorded"), ("seed bank of the valley", "seed bank of the valley"), ("", ""), ("  ", "  ")],
)
def test_the_stream_is_segmented_anew(text, want):
    assert scans.Words(WORDS).stream(text) == want


def test_decoding_has_no_bound_on_length():
    long = "pneumono" + "ultra" * 20 + "rnicro"
    words = scans.Words({**WORDS, long.replace("rn", "m"): 50})
    assert words.decode(long) == (long.replace("rn", "m"), "letter") and words.decode("x" * 5000) is None
    assert words.decode("valley/rnodern") == ("valley/modern", "letter") and words.decode("https://rnodern.org") is None
    rest = np.zeros(1 << scans.REST_BITS, np.float32)
    rest[scans.rest_bucket("rnodern")] = 40
    assert scans.Words(WORDS).decode("rnodern") == ("modern", "letter") and scans.Words(WORDS, rest).decode("rnodern") is None  # a word of its own among the rare ones


def test_words_beyond_the_most_frequent_count_exactly(spark, monkeypatch):
    text = "the " * 300 + "of " * 200 + "in " * 150 + "measurements " * 60 + "valley " * 40 + "Modern " * 30 + "MODERN " * 10 + "network " * 25 + "burn " * 3 + "Burn " * 3 + "rnodern valIey"
    reads = spark.createDataFrame([(text,), ("measurernents of the vallcy in the net work",), (None,)], "text string")
    whole = scans.count_words(reads)
    monkeypatch.setattr(scans, "MAX_WORDS", 3)
    few = scans.count_words(reads)
    assert set(few.exact) == {"the", "of", "in"} and few.total == whole.total
    for word in [*whole.folded, "modern", "burn", "bum", "absent", "rnodern"]:
        assert (few.count(word), few.seen(word), few.known(word)) == (whole.count(word), whole.seen(word), whole.known(word))
        assert all(few.begins(word[:k]) == whole.begins(word[:k]) for k in range(len(word) + 1))
    for token in ("measurernents", "rnodern", "vallcy", "valIey", "Modern", "MODERN", "Burn", "absent", "the"):
        assert few.spelled(token) == whole.spelled(token) and few.decode(token) == whole.decode(token)
    assert few.decode("measurernents") == ("measurements", "letter") and few.spelled("MODERN") == 10
    assert few.stream("in the net work of thevalley") == whole.stream("in the net work of thevalley") == "in the network of the valley"
    marked = few.__class__(few.exact, np.ones_like(few.rest), few.others)  # full buckets only cost time
    assert marked.count("absent") == 0 and marked.count("valley") == 40
    with_tasks = spark.sparkContext.broadcast(few)
    assert spark.sparkContext.parallelize(["rnodern"], 1).map(lambda x: with_tasks.value.decode(x)).collect() == [("modern", "letter")]


def test_paragraph_breaks_against_plain_dynamic_programming():
    lines = [f"We recorded the rain every few minutes because the valley was held at {i}" for i in range(200)]
    assert [len(p) for p in scans.paragraphs(list(enumerate(lines)), lines)] == [200]
    rng = np.random.default_rng(1)
    for _ in range(20):
        lines = [str(rng.choice(["a line that ends here.", "a line that runs on and", "", "Short", "A line that begins a sentence and goes on for a while", "12 13 14"])) for _ in range(rng.integers(1, 90))]
        parts = [(i, x) for i, x in enumerate(lines) if x]
        groups = scans.paragraphs(parts, lines)
        assert [x for g in groups for x in g] == [x for _, x in parts]


def test_residue_without_any_seed(spark):
    notice = ["The vault is shut for the night", "Nothing stands under this number"]
    rows = [(k, f"d{k}", prose(30, k) + "\nArchive\nHelp") for k in range(30)] + [(100 + k, f"n{k}", notice[k % 2] + f" {k}\nArchive\nHelp") for k in range(12)]
    rows += [(200 + k, "same", "One short line of a paper that came often") for k in range(9)] + [(300, "q", prose(30, 99) + "\n" + notice[0])]
    reads = spark.createDataFrame(rows, "read_id long, doc_id string, text string")
    flags = {r["read_id"] for r in residue.flag_residue(reads, model=residue.fit(reads, seeds="x")).where("residue").collect()}
    assert flags == set(range(100, 112))


def test_counts_of_contexts_are_exact(spark):
    texts = [prose(3, k) for k in range(40)] + ["", "水位变化。观测", "x"]
    values = spark.createDataFrame([(t,) for t in texts], "__text string")
    every, ends = {}, {}
    for t in texts:
        contexts = truncation.Contexts(pa.array([t]))
        data = bytes(contexts.data)
        for order in truncation.ORDERS:
            for i in range(1, len(data) + 1):
                key = (order, data[max(0, i - order) : i])
                every[key] = every.get(key, 0) + 1
                ends[key] = ends.get(key, 0) + (i == len(data) or bool(contexts.end[i]))
    tails = truncation.Tails(texts)
    codes = np.unique(np.concatenate([tails.contexts.tails(o) for o in truncation.ORDERS])).view(np.int64)
    words = truncation.wanted_set(spark.createDataFrame([(int(c),) for c in codes], "code long"))
    counted = {r["code"]: (r["every"], r["ends"]) for r in truncation.count_ends(values, words).collect()}
    for order in truncation.ORDERS:
        for t, code in zip(texts, tails.contexts.tails(order).view(np.int64).tolist()):
            data = bytes(truncation.Contexts(pa.array([t])).data)
            if data:
                key = (order, data[-order:])
                assert counted[code] == (every[key], ends[key])


def test_languages():
    from foliospark.llm.language import language

    assert language("Die Messung der Pegel ist nicht mit dem Netz verbunden") == "de" and language("we measured the depth of the river and the flow") == "en"
    assert language("水位变化") == "cjk" and language("уровень воды") == "cyrillic" and language("12 34") == "none"


def test_reading(spark):
    easy = "The cat sat on the mat. It was a big cat. I like the cat. We ran to the car. "
    hard = "Notwithstanding considerable epistemological reservations, the institutionalisation of methodological individualism presupposes a comprehensive reconceptualisation of jurisdictional subsidiarity. "
    foreign = "Le robinet fuit depuis ce matin et la notice est trop vague pour nous. "
    rows = [(k, easy * 4, "en") for k in range(60)] + [(100 + k, hard * 4, "en") for k in range(6)] + [(200 + k, foreign * 5, "fr") for k in range(10)]
    odd = [(300, None, "en"), (301, "", None), (302, "```\n" + hard + "\n```", "en"), (303, hard * 3 + easy, "de"), (304, easy * 4 + "\nsee https://a.b/c\n    x = f(y)\n2024-01-01 00:00:00 INFO [a] b=1", "en")]
    docs = spark.createDataFrame([(*x, 1.0) for x in rows + odd + rows[:1]], "doc_id long, text string, lang string, level double")
    refs = spark.createDataFrame([(k, 1, easy * 3) for k in range(6)] + [(10 + k, 5, hard * 3) for k in range(6)], "ref_id int, level int, text string")
    got = {r["doc_id"]: r for r in reading.reading_levels(docs, refs).collect()}
    assert got[0]["whole_level"] == 1 and got[100]["whole_level"] == 5 and got[303]["whole_level"] == 5 and got[303]["english"]
    assert not got[200]["english"] and got[300]["level"] is None and got[301]["n_words"] == got[302]["n_words"] == 0
    assert got[304]["n_words"] == got[0]["n_words"]
    assert reading.reading_levels(docs.limit(0), refs).count() == 0
