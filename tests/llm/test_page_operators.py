"""Operators on pages and conversations, the graph helper, and the pipeline."""
import collections
import hashlib
import io
import re

import pytest

from cyclekit.llm import language_id, tool_calls, url_rules, warc
from cyclekit.llm.graph import components

from .conftest import sentence


# ---------------------------------------------------------------- URL filter
def host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def test_url_parts_and_host_rules(spark):
    urls = ["http://A.Example.NET/en/1?x", "https://example.net", "http://x.net/", "ftp://b.org/fr/z#a/b", "http://org/fr/", "http://xorg/fr/",
            "no scheme", None, "", "http://", "http://m.example.com/de/?q://z", "a://b://c/d", "http://example.com/de", "http://h.example.net/en/\n?"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "x")], "page_id long, url string, host string")
    got = url_rules.judge_urls(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(urls) + 1
    want = {r.page_id: r for r in got}
    for i, u in enumerate(urls):
        host, path = host_and_path(u)
        rule = max((r for r in url_rules.HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)),
                   key=lambda r: len(r.text), default=None)
        assert (want[i].host, want[i].path, want[i].rule, want[i].verdict) == (
            host, path, rule and rule.text, rule.verdict if rule else "allow"), u


def test_mined_rules_equal_brute_force(spark):
    """Block rules are the frequent, sure token sets without a more general one as sure."""
    from itertools import combinations
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, f"http://{'spam' if bad and i % 8 else 'h'}{i % 5}.test/{'ads' if bad else 'en'}/{i}?{'aff' if bad and i % 3 else 'q'}=1", int(not bad)))
    rows += [(1000, None, 0), (1001, "http://spam1.test/ads/7?aff=2", None)]
    pages = spark.createDataFrame([(a, b) for a, b, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(a, c, 0) for a, _, c in rows] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    urls = {r.url: set(r.tokens) for r in url_rules.parsed(pages).collect()}
    label = {u: False for u in urls}
    for _, u, q in rows:
        if u is not None and q == 0:
            label[u] = True
    total, bad = len(urls), sum(label.values())
    found = {}
    tokens = sorted({t for s in urls.values() for t in s})
    common = [t for t in tokens if sum(t in s for s in urls.values()) >= 0.05 * total]
    for n in range(1, 8):
        for c in combinations(common, n):
            has = [u for u, s in urls.items() if s >= set(c)]
            hit = sum(label[u] for u in has)
            if hit and hit >= 0.05 * (bad / total) * total and hit / len(has) >= 0.6:
                found[c] = hit / len(has)
    want = {c for c, p in found.items() if not any(found.get(s, 0) >= p for k in range(1, len(c)) for s in combinations(c, k))}
    marked = spark.createDataFrame([(sorted(s), label[u]) for u, s in urls.items()], "tokens array<string>, bad boolean")
    rules = url_rules.mine_rules(marked, 0.05, 0.6)
    assert {r[0] for r in rules} == want and want
    got = {r.page_id: r for r in url_rules.judge_urls(pages, labels, min_support=0.05).collect()}
    for i, u, _ in rows:
        fires = u is not None and any(urls[u] >= set(c) for c in want)
        assert got[i].verdict == ("block" if fires else "allow")


def test_rules_of_long_urls_equal_brute_force(spark):
    """16 frequent tokens a URL; tokens that say little alone are sure together."""
    import random
    from itertools import combinations
    r = random.Random(4)
    rows = []
    for i in range(1200):
        x, y = i % 2, i // 2 % 2
        bad = x == y == 1 and i % 12 != 3 or i % 7 == 0
        # informative alone, never sure; then a chain that always stands together
        loud = [f"loud{k}" for k in range(12) if r.random() < (0.7 if bad else 0.5)]
        rows.append((["always1", "always2", "always3", *loud, f"quiet{x}a", f"quiet{y}b"], bad))
    total, bad = len(rows), sum(b for _, b in rows)
    sets = [(frozenset(t), b) for t, b in rows]
    found, support = {}, 0.15
    common = sorted({t for s, _ in sets for t in s})
    for n in range(1, 5):
        for c in combinations(common, n):
            hit = [b for s, b in sets if s.issuperset(c)]
            if sum(hit) >= support * bad and sum(hit) / len(hit) >= 0.6:
                found[c] = sum(hit) / len(hit)
    want = {c for c, p in found.items() if not any(found.get(s, 0) >= p for k in range(1, len(c)) for s in combinations(c, k))}
    marked = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    rules = url_rules.mine_rules(marked, support, 0.6)
    assert ("quiet1a", "quiet1b") in want
    assert {r[0] for r in rules if len(r[0]) < 5} == want
    assert all(r[1] == found[r[0]] for r in rules if len(r[0]) < 5)
    # the size of a rule is not bounded: all rules are sure and none has a part that is as sure
    for tokens, confidence, _ in rules:
        hits = [[b for s, b in sets if s.issuperset(c)] for c in (tokens, *combinations(tokens, len(tokens) - 1)) if c]
        assert confidence == sum(hits[0]) / len(hits[0]) and all(sum(h) / len(h) < confidence for h in hits[1:])


def test_urls_of_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge_urls(pages, spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")).collect() == []


# ---------------------------------------------------------------- WARC
def test_warc_round_trip(spark):
    page = "<p>" + "é" * 200
    rows = [(5, "http://a", page), (3, "http://b\r\nX: y", page), (9, None, page), (1, "http://c", None), (2, "http://d", ""),
            (7, "http://e", "short"), (8, "http://f", "short"), (None, "http://g", page), (11, "http://h", "z" * 3_000_000), (3, "http://b", page)]
    pages = spark.createDataFrame([(*r, "digest") for r in rows], "page_id long, url string, html string, digest string")
    folder = warc.shared_path(spark, "warc")
    manifest = warc.write_archives(pages, folder, archive_bytes=2000)
    got = warc.read_archives(manifest, folder).collect()
    want = collections.Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        again = html == page and i not in (3, None)
        want[(i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 3 if again else None)] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(bytes(r.payload) == ("".encode() if r.record_type == "revisit" else next((h or "").encode() for i, _, h in rows if i == r.page_id)) for r in got)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows)
    assert warc.archived_pages(pages.limit(0)).collect() == []


def test_every_archive_has_a_reading_task(spark):
    from pyspark.sql import functions as F
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("http://a").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 40).alias("html"))
    folder = warc.shared_path(spark, "warc")
    manifest = warc.write_archives(pages, folder, archive_bytes=5_000)
    n = manifest.count()
    per_task = warc.read_archives(manifest, folder).groupBy(F.spark_partition_id()).count().collect()
    assert n > 8 and len(per_task) > n // 2


def test_very_long_urls_round_trip(spark):
    rows = [(1, "http://a/" + "x" * (2 << 20)), (2, "http://b/\x00 \t\x7f"), (3, "")]
    folder = warc.shared_path(spark, "warc")
    pages = spark.createDataFrame([(i, u, "<p>") for i, u in rows], "page_id long, url string, html string")
    got = {r.page_id: r.uri for r in warc.read_archives(warc.write_archives(pages, folder), folder).collect()}
    assert got == {1: rows[0][1], 2: "http://b/%00%20%09%7F", 3: None}


def test_unknown_archive_stores_are_an_error_before_any_work(spark):
    pages = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")
    with pytest.raises(warc.WarcError):
        warc.write_archives(pages, "nostore://bucket/folder")


def test_damaged_archives_are_errors():
    one = warc.record_bytes("response", "1", "http://a", b"x" * 1000, warc._sha256(b"x" * 1000))
    assert [r.payload for r in warc.read_records(io.BytesIO(one + one), block=7)] == [b"x" * 1000] * 2
    import zlib
    plain = zlib.decompress(one, 31)

    def packed(data):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(data) + z.flush()
    for bad in (one[:-3], one + b"tail", packed(plain.replace(b"x" * 1000, b"y" * 1000)), packed(plain.replace(b"Length: 1000", b"Length: 999")),
                packed(plain.replace(b"Content-Length", b"Content-Size")), packed(b"hello"), packed(plain + b"more")):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(bad)))


# ---------------------------------------------------------------- tool calls
def test_integers_of_any_length_are_validated(spark):
    calls = spark.createDataFrame([(1, "a", None, 1, "search", '{"limit": %s, "query": "q"}' % ("9" * 400)), (1, "b", None, 2, "search", '{"limit": 1e999, "query": "q"}'),
                                   (1, "c", None, 3, "search", "[" * 100_000), (1, "d", None, 4, "search", '{"limit": 5, "query": "%s"}' % ("q" * 300_000))],
                                  "conv_id long, call_id string, parent_id string, turn long, name string, arguments string")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    got = {r.call_id: r for r in tool_calls.link_calls(calls, results, tool_calls.SCHEMAS).collect()}
    assert got["a"].errors == ["$.limit: out of range"] and got["a"].arguments.startswith('{"limit":999')
    assert got["b"].errors == ["$: not JSON"] and got["c"].errors == ["$: not JSON"] and got["d"].errors == ["$.query: wrong length"]


def test_tool_calls(spark):
    call = "conv_id long, call_id string, parent_id string, turn long, name string, arguments string, depth int"
    ok = '{"limit": 5.0, "query": "é"}'
    calls = spark.createDataFrame([
        (1, "c", "b", 1, "search", ok, 0), (1, "b", "a", 2, "search", '{"query": "", "limit": 99, "z": 1}', 0), (1, "a", None, 3, "search", "{bad", 0),
        (1, "x", "y", 4, "search", ok, 0), (1, "y", "x", 5, "search", ok, 0), (1, "d", "gone", 6, "nope", "[1, NaN]", 0),
        (1, "a", None, 9, "search", ok, 0), (2, "c", None, 1, None, None, 0), (None, "q", None, 1, "search", ok, 0), (2, None, None, 1, "search", ok, 0),
        (2, "e", "c", 2, "translate", '{"text":"t","target":"xx"}', 0)], call)
    results = spark.createDataFrame([(1, "a", 4, "first"), (1, "a", 8, "late"), (1, "b", 1, "early"), (3, "c", 1, "lost"), (1, "x", 9, "r")],
                                    "conv_id long, call_id string, turn long, content string")
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link_calls(calls, results, tool_calls.SCHEMAS).collect()}
    assert {k: (r.position, r.depth, r.status) for k, r in got.items()} == {
        (1, "a"): (0, 0, "linked"), (1, "d"): (1, 0, "no_result"), (1, "b"): (2, 1, "early_result"), (1, "c"): (3, 2, "no_result"),
        (1, "x"): (4, None, "cycle"), (1, "y"): (5, None, "cycle"), (2, "c"): (0, 0, "no_result"), (2, "e"): (1, 1, "no_result")}
    assert got[1, "c"].arguments == '{"limit":5,"query":"é"}' and got[1, "c"].errors == []
    assert got[1, "b"].errors == ["$.limit: out of range", "$.query: wrong length", "$.z: unknown"]
    assert got[1, "a"].errors == ["$: not JSON"] and got[1, "a"].content == "first" and got[1, "d"].errors == ["$: not JSON"]
    assert got[2, "e"].errors == ["$.target: not in the enumeration"]
    empty = tool_calls.link_calls(calls.limit(0), results.limit(0), tool_calls.SCHEMAS)
    assert empty.collect() == []


def test_long_chain_of_calls(spark):
    n = 300
    rows = [(1, f"c{i}", f"c{i - 1}" if i else None, i, "search", "{}") for i in range(n)]
    got = tool_calls.link_calls(spark.createDataFrame(rows, "conv_id long, call_id string, parent_id string, turn long, name string, arguments string"),
                                spark.createDataFrame([], "conv_id long, call_id string, turn long, content string"), tool_calls.SCHEMAS).collect()
    assert sorted((r.position, r.call_id) for r in got) == [(i, f"c{i}") for i in range(n)]


# ---------------------------------------------------------------- language ID
def test_languages(spark):
    text = {"de": "der die das und nicht ist ein schön wir haben heute", "en": "the and of that with have this from they were there",
            "fr": "le la les des est une dans pour qui ça nous avons été"}
    docs = [(i, " ".join([t] * (1 + i % 3)), lang, "s") for i, (lang, t) in enumerate(list(text.items()) * 20)]
    docs += [(900, None, "de", "s"), (901, "", None, None), (902, "ab", "xx", "s")]
    documents = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    html = '<html lang="{}"><script>var the = "the and of that"</script><p>{}</p></html>'
    pages = [(i, f"http://h{i % 2}.test/{lang}/x", html.format(lang, t)) for i, (lang, t) in enumerate(list(text.items()) * 6)]
    pages += [(100, "http://h0.test/fr/x", html.format("fr", "")), (101, None, None), (102, "http://only.de/", "<p>" + text["fr"]), (102, "http://only.de/", "<p>" + text["fr"])]
    got = language_id.languages(spark.createDataFrame(pages, "page_id long, url string, html string"), documents).collect()
    assert len(got) == len(docs) + len(pages)
    by_doc = {r.doc_id: r for r in got if r.doc_id is not None}
    assert sum(by_doc[d].text_lang == lang for d, t, lang, _ in docs[:60]) == 60
    by_page = {r.page_id: r for r in got if r.page_id is not None}
    assert all(by_page[i].language == lang for i, lang in enumerate(list(text) * 6))
    assert by_page[100].language == "fr" and by_page[102].language == "fr" and by_page[101].language is not None
    assert all(0 < r.confidence <= 1 for r in got)
    none = language_id.languages(spark.createDataFrame(pages[:2], "page_id long, url string, html string"), documents.limit(0)).collect()
    assert [r.language for r in none] == [None, None]


def test_rare_languages_are_kept(spark):
    """One labelled text in 2,000 is Swahili, and one in 4,000 has a label of its own."""
    text = {"de": "der die das und nicht ist ein schön wir haben heute", "en": "the and of that with have this from they were there"}
    rare = "watu wote wamezaliwa huru hadhi na haki zao ni sawa"
    docs = [(i, list(text.values())[i % 2] + f" {i}", list(text)[i % 2], "s") for i in range(3997)]
    docs += [(5000, rare, "sw", "s"), (5001, rare + " wote", "sw", "s"), (5002, "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ ᏣᎳᎩ", "chr", "s"), (5003, "", None, "s")]
    html = '<html lang="{}"><p>{}</p></html>'
    pages = [(1, "http://a.test/sw/1", html.format("sw", rare)), (2, "http://b.test/2", "<p>" + rare), (3, "http://a.test/de/3", html.format("de", text["de"]))]
    got = language_id.languages(spark.createDataFrame(pages, "page_id long, url string, html string"),
                                spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()
    by_doc, by_page = {r.doc_id: r for r in got}, {r.page_id: r for r in got}
    assert [by_doc[i].language for i in (5000, 5001, 5002)] == ["sw", "sw", "chr"]
    assert [by_page[i].language for i in (1, 2, 3)] == ["sw", "sw", "de"]
    assert by_doc[5003].language == "de"       # no evidence: the commonest language
    assert all(by_doc[i].language == lang for i, _, lang, _ in docs[:3997])


def test_host_that_is_also_a_source(spark):
    """The prior of example.org counts its pages and its documents: English in sum only."""
    text = {"de": "der die das und nicht ist ein schön wir haben heute", "en": "the and of that with have this from they were there",
            "fr": "le la les des est une dans pour qui ça nous avons été"}
    langs = ["de"] * 30 + ["fr"] * 30 + ["en"] * 20
    docs = [(text[v], v, "other") for v in langs] + [(text[v], v, "example.org") for v in ["de"] * 5 + ["en"] * 4]
    pages = [(i, "http://example.org/x", "<p>" + text[v]) for i, v in enumerate(["fr"] * 5 + ["en"] * 4)] + [(100, "http://example.org/x", "<p>")]
    got = language_id.languages(spark.createDataFrame(pages, "page_id long, url string, html string"),
                                spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(docs) + len(pages)
    assert {r.page_id: r.language for r in got}[100] == "en"


# ---------------------------------------------------------------- components, pipeline
def test_components(spark):
    import random
    r = random.Random(5)
    path = list(range(200))
    r.shuffle(path)
    edges = list(zip(path, path[1:])) + [(1000 + r.randrange(80), 1000 + r.randrange(80)) for _ in range(60)] + [(5000, 5000 + i) for i in range(50)]
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(tuple(g) for g in got) == sorted((x, find(x)) for x in parent)


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    good = [sentence(i, 60) for i in range(12)]
    item = sentence(999, 30)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)]
    rows += [(100, good[3], "en", "s", 1), (101, good[4].replace(good[4].split()[-1], "end"), "en", "s", 1), (102, good[5] + " " + item + " " + good[6][:200], "en", "s", 1),
             (103, "too short", "en", "s", 1), (104, None, "en", "s", 1), (105, "", None, None, None), (106, sentence(50, 40) + " token=abcdefgh12 end", "en", None, 1),
             (107, sentence(51, 30_000), "en", "s", 1), (3, good[3], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for name, step in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name.replace(' ', '-')}"
        step(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        kept.append(sorted(r.doc_id for r in docs.collect()))
    every = set(range(12)) | {106, 107}
    assert kept[0] == sorted([*range(12), 3, 100, 101, 102, 106, 107])
    assert kept[1] == sorted(every | {102}) and kept[2] == sorted(every) and kept[3] == sorted(every)
    assert {r.doc_id: r.text for r in docs.collect()}[106].endswith("[SECRET] end")
    import public_tokenizers as tokenizers
    import tiktoken

    from cyclekit.llm import byte_bpe
    coder = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(
        tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == every
    for r in docs.collect():
        ids = coder.encode_ordinary(r.text)
        assert out[r.doc_id].n_tokens == len(ids)
        assert out[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_pipeline_decides_row_by_row(spark, tmp_path):
    """Rows without an id, and rows that repeat an id with another text."""
    import corpus_pipeline

    good, item = [sentence(i, 60) for i in range(8)], sentence(999, 30)
    planted = good[5] + " " + item
    rows = [(1, good[0]), (1, "too short"), (None, "too short"), (None, good[1]),
            (2, good[2]), (3, good[2]), (3, good[3]), (None, good[2]), (None, good[4]), (None, good[4] + " "),
            (4, planted), (4, good[6]), (None, planted + " " + good[7])]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES[:3]:
        step(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        kept.append(collections.Counter((r.doc_id, r.text.strip()) for r in docs.collect()))
    want = collections.Counter((i, t.strip()) for i, t in rows if t != "too short")
    assert kept[0] == want
    for gone in ((3, good[2]), (None, good[2]), (None, good[4])):
        want[gone] -= 1
    assert kept[1] == +want
    want -= collections.Counter([(4, planted), (None, planted + " " + good[7])])
    assert kept[2] == want


def test_pipeline_with_clashing_names_and_without_rows(spark, tmp_path):
    import corpus_pipeline

    text = [sentence(i, 60) for i in range(3)]
    rows = [(1, text[0], "en", "s", 1, 7, ["x"], "a", 5), (2, text[0], "en", "s", 1, 8, None, None, None), (3, text[1] + " token=abcdefgh", "en", "s", 1, 9, ["y"], "b", 6)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, _row int, _spans array<string>, host string, n_words int"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text[2])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, step) in enumerate(corpus_pipeline.STAGES[:4]):
        step(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns == table.columns
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == {1, 3} and got[1][5:] == rows[0][5:] and got[3][5:] == rows[2][5:] and got[3].text.endswith("[SECRET]")
    table.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([(1, text[2])], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
