"""Operators 11 to 13 against brute force and hand-written pages."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cyclekit.llm import hard_negatives, lexical_search, queries, site_style_tree

from .conftest import sentence


# ---------------------------------------------------------------- main text
def blocks_of(page):
    return [b[0] for b in site_style_tree.page_nodes(page)[1] if not b[4]]


def test_blocks_of_awkward_markup():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";x(1);</script></head>
    <body class="with-sidebar"><header><h1>Site</h1></header><nav>menu<article><header><h1>T &amp; t</h1></header><p>one<p>two <b>bold</b><br>x
 y&nbsp;z<a href="a>b">link</a> <p title='q'>3 < 4<div class="cookie-notice">N</div><ul><li>a<li>b</ul><aside>s</aside><!-- c --></article>
    <section id="reader-comments"><div><p>c1</div></section><form><input><p>f</form><footer>ft"""
    assert blocks_of(page) == ["T & t", "one", "two bold x y zlink", "3 < 4", "a", "b"]
    assert blocks_of("") == [] and blocks_of("plain text") == ["plain text"] and blocks_of("<p>a<p>") == ["a"]
    assert blocks_of("<form><h2>Whole page</h2><p>is a form") == ["Whole page", "is a form"]
    assert blocks_of("<p>cut <a href='x") == ["cut"] and blocks_of("a</div></p>b") == ["ab"]
    assert blocks_of("<div>" * 5000 + "deep" + "</span>" * 5000) == ["deep"]
    assert blocks_of("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]


def test_boxes_that_say_what_they_are():
    page = """<body><div id="header">Site</div><ul class="main-nav"><li>x</ul><div class="content with-sidebar"><h1 class="page-header">Title</h1><p>Text.</p>
    <div class="ad-slot">buy</div><section><h3>12 Comments</h3><div><p>first!</p></div></section><div><p>Werbung</p><p>kauf</p></div>
    <p>Comments on the law are rare.</p></div><div class="widget-area">w</div><div role="contentinfo">c</div><p hidden>h<p style="display: none">d"""
    assert blocks_of(page) == ["Title", "Text.", "Comments on the law are rare."]


def site(i, body, menu="Home|About us|Contact"):
    links = "".join(f"<span>{m}</span> " for m in menu.split("|"))
    return f"<html><body><div>{links}</div><div><h2>Title {i} {sentence(i, 3)}</h2>{body}</div><div>Subscribe now! {i} readers</div></body></html>"


def test_unnamed_furniture_goes_by_entropy(spark):
    """Menus and notices without any telling tag: the site's pages repeat them. Articles that
    share a passage, copies, and pages without a host stay whole."""
    shared = sentence(7, 60)
    rows = [(i, f"http://a.example/{i}", site(i, f"<p>{sentence(100 + i, 30)}</p><p>{shared if i % 3 == 0 else sentence(200 + i, 30)}</p>")) for i in range(12)]
    copy = site(0, f"<p>{sentence(55, 40)}</p>")
    rows += [(20 + i, "https://copies.example/x", copy) for i in range(5)]
    rows += [(30, "http://single.example/", copy), (31, None, copy), (32, "nothing", None), (33, "http://a.example/9", ""), (None, "http://A.example:80", "<p>x")]
    pages = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, host int, text string")
    out = site_style_tree.extract(pages)
    got = {r.page_id: r for r in out.collect()}
    assert out.columns == ["page_id", "url", "text", "n_chars"] and len(got) == len(rows)
    for i in range(12):
        lines = got[i].text.split("\n")
        assert lines == [f"Title {i} {sentence(i, 3)}", sentence(100 + i, 30), shared if i % 3 == 0 else sentence(200 + i, 30)]
        assert got[i].n_chars == len(got[i].text)
    whole = f"Home About us Contact\nTitle 0 {sentence(0, 3)}\n{sentence(55, 40)}\nSubscribe now! 0 readers"
    assert {got[i].text for i in (20, 24, 30, 31)} == {whole}
    assert got[32].text == "" and got[33].n_chars == 0 and got[None].text == "x"
    assert site_style_tree.extract(pages.limit(0)).collect() == []


def test_importance_equals_hand_computed(spark):
    """Four pages: a constant menu, and paragraphs of which one is on two pages."""
    texts = ["p q", "p q", "r", "s"]
    rows = [(i, "http://h/", f"<div>menu</div><div><p>{t}</p></div>") for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    from pyspark.sql import functions as F
    parsed = pages.select("page_id", "url", F.lit(5).cast("long").alias("host"), "html").mapInArrow(site_style_tree._parsed, site_style_tree.PARSED)
    nodes = {n: v for n, v in ((r.node, r) for r in site_style_tree.importance(parsed).collect())}
    one = site_style_tree.page_nodes(rows[0][2])
    menu, words = one[1][0][2], one[1][1][2]
    assert nodes[menu].importance == pytest.approx(0.0)
    assert nodes[words].importance == pytest.approx(1 - (math.log(2) / math.log(4) + 0 + 0) / 3)
    box = next(n for n in one[0] if n[0] == words)[1]
    # one child sequence: presentation entropy 0 weighs 1 - gamma
    assert nodes[box].importance == pytest.approx(0.9 * nodes[words].importance) and nodes[box].highest == nodes[words].highest


def test_given_pages(spark):
    """The given pages have one template: heading and paragraphs of the article, nothing else."""
    import html
    got = queries.op11_html_text(spark, "/root/testdata/sf0.001").collect()
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        parts = re.split(r"</?(?:p|h1)>", article)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts]
        assert r.text.split("\n") == [w for w in want if w]


# ---------------------------------------------------------------- lexical search
def ranked(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, c) for i, c in bags if c]
    n_docs, length = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in bags:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return Counter(out)


def test_search_equals_brute_force(spark, documents, no_documents, monkeypatch):
    r = random.Random(5)
    rows = [(100 + i, " ".join(r.choice(["alpha", "Beta", "gamma", "x1", "é", "中文"]) + str(r.randrange(1 + i % 9)) for _ in range(r.randint(0, 40)))) for i in range(500)]
    rows += [(2000 + i, rows[7][1]) for i in range(40)] + [(None, "rare alpha0"), (3000, "rare, rare; RARE_rare"), (3000, "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(documents.select("doc_id", "text"))
    items = [(1, "alpha0 beta1 beta1 x10 É0"), (2, "rare"), (3, None), (4, " .,"), (5, "never seen"), (None, "gamma0 中文0"), (1, "alpha0 beta1 beta1 x10 É0"),
             (6, sentence(1, 40)), (7, " ".join(t for _, t in rows[:60]))]
    bench = spark.createDataFrame([(*i, 0, "d") for i in items], "item_id long, text string, rank int, doc_id string")
    plain = [tuple(d) for d in docs.collect()]
    want = ranked(plain, dict.fromkeys(items))
    got = lexical_search.search(docs, bench)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and Counter(tuple(g) for g in got.collect()) == want
    # many small trees, and items in blocks
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 37)
    monkeypatch.setattr(lexical_search, "LEAF", 2)
    assert Counter(tuple(g) for g in lexical_search.search(docs, bench, block_items=3).collect()) == want
    assert lexical_search.search(no_documents, bench).collect() == [] and lexical_search.search(docs, bench.limit(0)).collect() == []
    assert lexical_search.search(documents, spark.createDataFrame([(1, None)], "item_id long, text string")).collect() == []


def test_trees_bound_and_prune(monkeypatch):
    """Every block size and leaf size gives the same best rows, and bounds hold."""
    r = np.random.default_rng(3)
    n, width = 300, 40
    each = [np.sort(r.choice(width, r.integers(0, 12), replace=False)) for _ in range(n)]
    each[5:60] = [each[5]] * 55
    count = [r.integers(1, 4, len(t)) for t in each]
    m = r.integers(25, 200, n)
    off = np.concatenate([[0], np.cumsum([len(t) for t in each])])
    places, weight = np.array([0, 3, 7, 20]), np.array([5, 900, 4000, 70])
    full = sorted((-sum(int(w) * ((10**9 * int(c[t == p][0])) // (1000 * int(c[t == p][0]) + 8 * int(mm))) for p, w in zip(places, weight) if p in t), i)
                  for i, (t, c, mm) in enumerate(zip(each, count, m)))
    want = [x for x in full if x[0] < 0][:10]
    for leaf in (1, 3, 32, 1000):
        monkeypatch.setattr(lexical_search, "LEAF", leaf)
        tree = lexical_search.Tree(np.arange(n), m, off, np.concatenate(each), np.concatenate(count).astype(np.int32), width)
        assert tree.search(places, weight, [], 10) == want
        covered = sorted(i for s, c in zip(tree.span, tree.children) if not c for i in range(*s))
        assert covered == list(range(n)) and sorted(tree.ids.tolist()) == list(range(n))


# ---------------------------------------------------------------- hard negatives
def mined(rows):
    """(anchor, positive, rank, negative, scores) by brute force over (id, label, vector)."""
    good = {(i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(math.floor(256 * x) for x in v)) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    width = max((len(g[2]) for g in good), default=0)
    good = {(i, lab, v + (0,) * (width - len(v))) for i, lab, v in good}
    out = []
    for a, label, v in good:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, lab) for i, lab, w in good if i != a)
        for p, pid, _ in [s for s in scored if s[2] == label][:5]:
            window = [(s, i) for s, i, lab in scored if lab != label and 80 * -p <= 100 * -s <= 100 * -p][:5]
            out += [(a, pid, r + 1, i, -p, -s) for r, (s, i) in enumerate(window)]
    return Counter(out)


KIND = "vec_id long, embedding array<float>, label int, id int, score string, cell int"


@pytest.mark.parametrize("dense", [True, False])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(hard_negatives, "FIRST_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "ROWS_PER_CELL", 8)
    r = np.random.default_rng(1)
    centre = r.normal(size=(12, 8))
    vecs = [(centre[i % 12] + r.normal(size=8) * (0.9 if dense else 0.1)).astype(np.float32).tolist() for i in range(500)]
    rows = [(i, v, i % 12 % 10) for i, v in enumerate(vecs)]
    rows += [(1000 + i, vecs[0], i % 3) for i in range(60)]                            # one vector many times
    rows += [(None, vecs[1], 1), (2000, None, 1), (2001, vecs[1], None), (2002, [*vecs[1][:3], None], 1), (2003, [float("nan")] * 8, 1),
             (2004, [float("inf")] * 8, 1), (2005, [], 1), (2006, [1.0, 2.0], 2), (100, vecs[100], 100 % 12 % 10), (3, vecs[3], 3)]
    frame = spark.createDataFrame([(*x, 1, "s", 2) for x in rows], KIND)
    got = hard_negatives.mined_embeddings(frame)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows])
    assert Counter(tuple(g) for g in got.collect()) == want and want


def test_hard_negatives_of_small_tables(spark):
    assert hard_negatives.mined_embeddings(spark.createDataFrame([], KIND)).collect() == []
    few = [(100, [1.0, 0.0], 1), (101, [0.9, 0.0], 1), (102, [0.8, 0.0], 2), (103, [-1.0, 0.0], 2)]
    got = hard_negatives.mined_embeddings(spark.createDataFrame([(*f, 1, "s", 2) for f in few], KIND)).collect()
    assert Counter(tuple(g) for g in got) == mined(few) and len(got) == 1
    with pytest.raises(ValueError):
        hard_negatives.mined_embeddings(spark.createDataFrame([(100, [1e30, 1.0], 1, 1, "s", 2)], KIND))


def test_cells_come_by_falling_bound_and_bounds_hold():
    r = np.random.default_rng(2)
    x = r.integers(-300, 300, (400, 6))
    books = tuple(hard_negatives._codebook(h.astype(float), 5) for h in (x[:, :3], x[:, 3:]))
    (a, da), (b, db) = (hard_negatives._nearest(h.astype(float), c) for h, c in zip((x[:, :3], x[:, 3:]), books))
    cell = a * len(books[1]) + b
    cells = hard_negatives.Cells(books, [(c, (cell == c).sum(), da[cell == c].max(), db[cell == c].max()) for c in np.unique(cell)])
    for q in x[:20]:
        assert sorted(cells.visit(q, 0, hard_negatives.NONE)) == np.unique(cell).tolist()
        scores = x @ q
        for floor in np.quantile(scores, [0.5, 0.9, 0.99]).astype(int):
            seen = set(cells.visit(q, 0, int(floor)))
            assert set(cell[scores >= floor].tolist()) <= seen
            first = len(list(cells.visit(q, 0, None)))
            assert set(cells.visit(q, first, int(floor))) == set(list(cells.visit(q, 0, int(floor)))[first:])


def test_blocks_of_vectors_are_not_broadcast(spark):
    """The blocks hold every vector: no join may send them through the driver."""
    from pyspark.sql import functions as F

    from cyclekit.llm import hard_negatives as H

    rows = spark.range(400).selectExpr("id", "cast(id % 10 as int) as label", "transform(sequence(1, 8), i -> cast(pmod(hash(id, i), 512) - 256 as bigint)) as vec")
    index = H.MultiIndex(rows)
    empty = F.array().cast("array<long>")
    asked = index.opened(rows.where("id % 100 = 0"))
    found = index.found(asked.select("aid", "own", "label", "vec", F.lit(0).alias("skip"), F.lit(None).cast("long").alias("floor"),
                                     empty.alias("high"), empty.alias("low")), 5)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() > 0
