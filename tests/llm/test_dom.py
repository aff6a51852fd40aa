import numpy as np

from foliospark.llm import dom

NOUNS = "rain seed bank gauge valley river stone meadow transect network protocol sample".split()


def page(k):
    """A page of one of several layouts, with its own body's sentences."""
    rng = np.random.default_rng(k)
    sentence = lambda: f"We recorded the {rng.choice(NOUNS)} {rng.choice(NOUNS)} every {rng.integers(2, 900)} minutes because the {rng.choice(NOUNS)} was held fixed."
    body = [" ".join(sentence() for _ in range(rng.integers(2, 5))) for _ in range(rng.integers(3, 8))]
    links = "".join(f'<li><a href="/{n}">{rng.choice(NOUNS).title()} {n}</a></li>' for n in range(rng.integers(4, 9)))
    wrap = ["<div class='x{0}'>{1}</div>", "<article>{1}</article>", "<section id='c{0}'><div>{1}</div></section>"][k % 3]
    text = "".join(f"<p>{b}</p>" if k % 2 else f"<div>{b} <em>{rng.choice(NOUNS)}</em></div>" for b in body)
    menu = [f"<nav><ul>{links}</ul></nav>", f"<div class='top-menu'><ul>{links}</ul></div>", f"<div class='q'><ul>{links}</ul></div>"][(k // 3) % 3]
    side = f"<div class='{'sidebar' if k % 4 else 'r2'}'><h3>Related articles</h3><ul>{links}</ul></div>"
    foot = ["<footer>Terms of use | Privacy notice</footer>", "<div class='footer'>Terms of use | Privacy notice</div>"][k % 2]
    return f"<html><head><title>t</title><script>var a=1;</script></head><body>{menu}{wrap.format(k, f'<h1>On the {rng.choice(NOUNS)}</h1>' + text)}{side}{foot}</body></html>", body


def test_main_text_of_held_out_pages(spark):
    pages = [(k, page(k)[0], "x") for k in range(240)]
    rows = spark.createDataFrame([*pages, (900, None, "x"), (901, "", "x"), (902, "<![foo[bar", "x"), (903, "plain words", "x")], "page_id long, html string, text string")
    model = dom.Model([dom.Page(h) for _, h, _ in pages[:120]])
    got = {r["page_id"]: r["text"] for r in dom.main_text(rows, model=model).collect()}
    assert got[900] is None and got[901] == "" and got[902] is None and got[903] == "plain words"
    kept = wrong = all_ = 0
    for k in range(120, 240):
        body = page(k)[1]
        all_ += len(body)
        kept += sum(b in got[k] for b in body)
        wrong += "Privacy notice" in got[k] or "Related articles" in got[k]
    assert kept >= 0.97 * all_ and wrong <= 6
    assert dom.main_text(rows.limit(0)).count() == 0


def test_no_kept_node_stands_in_a_dropped_one():
    for k in range(40):
        p = dom.Page(page(k)[0])
        kept = p.decode(np.random.default_rng(k).normal(size=len(p.tag)))
        assert all(kept[p.parent[i]] for i in np.flatnonzero(kept) if i)


def test_decode_is_cheapest():
    p = dom.Page("<div>aa<p>bbbb</p><ul><li>c</li><li>dddd</li></ul></div><span>e</span>")
    n = len(p.tag)
    weight = np.sqrt([sum(map(len, t)) for t in p.texts]) + 0.1
    for seed in range(30):
        score = np.random.default_rng(seed).normal(size=n)
        cost = lambda kept: float(np.sum(np.where(kept, score, -score) * weight))
        choices = [np.array([True, *map(bool, map(int, f"{m:0{n - 1}b}"))]) for m in range(1 << (n - 1))]
        fair = [c for c in choices if all(c[p.parent[i]] for i in np.flatnonzero(c) if i)]
        assert abs(cost(p.decode(score)) - min(map(cost, fair))) < 1e-9
