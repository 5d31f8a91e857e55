"""Operators on documents against brute force."""
import collections
import hashlib
import re
import tracemalloc
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from cyclekit.llm import byte_bpe, decontaminate, kd_shards, ngram_join, quality_rules, secret_scan
from cyclekit.llm import text as X

from .conftest import sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return WORD.findall(text)


def shingles(text):
    w = words(text, lower=True)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_words_and_hashes_match_plain_python():
    texts = ["a bb  ccc\n", "", None, "x" * 3_000_000, "é ü\x0bz", " lead", "trail "]
    w = X.words(pa.array(texts))
    got = [[w.buf[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.first, w.first[1:])]
    assert got == [words(t) for t in texts]
    assert len(set(X.word_hashes(w).tolist())) == len({x for g in got for x in g})


def test_components_equal_brute_force(documents):
    rows = [(r.doc_id, shingles(r.text)) for r in documents.collect()]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    want = collections.Counter((i, len(s), None if i is None else find(i)) for i, s in rows)
    got = collections.Counter(tuple(r) for r in ngram_join.jaccard_components(documents).collect())
    assert got == want


def test_components_of_an_empty_table(no_documents):
    assert ngram_join.jaccard_components(no_documents).collect() == []


def test_chain_of_near_copies_is_one_component(spark):
    """Neighbours link, the ends do not; one text is copied many times."""
    w = sentence(7, 150).split()
    rows = []
    for i in range(40):
        rows.append((100 + i, " ".join(w)))
        w[(i * 37) % 150] = f"new{i}"
    rows += [(500 + i, rows[0][1]) for i in range(60)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {100}


def test_lane_sketches_share_a_posting():
    """Whatever the sizes, linked sets share a posting, and the bit sketch never exceeds the difference."""
    r = np.random.default_rng(5)
    from fractions import Fraction
    lanes = ngram_join.Lanes(Fraction(4, 5), np.zeros(0, np.uint64))
    for n in [1, 2, 3, 5, 9, 10, 17, 40, 41, 90, 250, 700]:
        for _ in range(20):
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            drop = r.integers(0, n // 9 + 1)
            b = np.unique(np.concatenate([a[drop:], r.integers(0, 1 << 63, max(0, n // 9 - drop)).astype(np.uint64)]))
            if not len(b) or 5 * len(np.intersect1d(a, b)) < 4 * len(np.union1d(a, b)):
                continue
            assert set(lanes.post(a)[0].tolist()) & set(lanes.post(b)[0].tolist()), (n, len(a), len(b))
            assert ngram_join.sketch_distance(ngram_join.bit_sketch(a), ngram_join.bit_sketch(b)) <= len(np.setxor1d(a, b))


def test_quality_measures_equal_brute_force(documents):
    def measure(text):
        w, t = words(text), text or ""
        wins = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        c = collections.Counter(wins)
        cover = {i + k for i, g in enumerate(wins) if c[g] > 1 for k in range(5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)

    got = quality_rules.judged(documents).collect()
    want = collections.Counter((r.doc_id, *measure(r.text)) for r in documents.collect())
    assert collections.Counter((r.doc_id, *(r[m] for m in quality_rules.MEASURES)) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and not r.host_rejected)


def test_hosts_are_rejected_by_shrunk_rates(spark):
    good, bad = sentence(4, 60), "too short"
    rows = [(i, bad if h == "bad.example" or i % 20 == 0 else good, h) for h, n in
            (("bad.example", 40), ("big.example", 400), ("other.example", 60)) for i in range(n)]
    rows += [(9000, bad, "tiny.example"), (9001, good, "bad.example"), (9002, good, None)]
    got = {(r.doc_id, r.kept) for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert (9001, False) in got and (9002, True) in got and (1, True) in got
    hosts = quality_rules.host_verdicts(quality_rules.text_measures(
        spark.createDataFrame(rows, "doc_id long, text string, source string"), ("source",)), "source")
    assert {r.source for r in hosts.where("host_rejected").collect()} == {"bad.example"}   # not the tiny host


def test_quality_of_an_empty_table(no_documents):
    assert quality_rules.judged(no_documents).collect() == []


def test_decontamination_finds_planted_items(spark):
    items = [(i, sentence(1000 + i, n)) for i, n in enumerate([6, 15, 20, 33, 45, 59, 90, 300])]
    items += [(90, None), (91, ""), (92, items[2][1]), (93, "one two")]
    docs = []
    for i, text in items[:8]:
        docs.append((i, sentence(i, 40) + " " + text.upper() + " " + sentence(50 + i, 40)))
    longer = items[5][1].split()
    longer.insert(30, "inserted")
    docs += [(100, " ".join(longer)), (101, items[3][1].rsplit(" ", 2)[0]), (102, sentence(77, 3000)), (103, None), (104, ""),
             (105, items[5][1].rsplit(" ", 30)[0]), (106, "one two"), (None, items[4][1])]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                     spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert found == {(i, i) for i in range(8)} | {(2, 92), (100, 5), (101, 3), (106, 93), (None, 4)}
    exact = {r.doc_id: r for r in got if r.doc_id in range(8) and r.item_id == r.doc_id}
    assert all(r.similarity == 1.0 and r.start_word == 40 for r in exact.values())


def test_decontamination_equals_all_stretches(spark):
    """Edited copies of items of 8 to 700 words: every pair whose best stretch reaches the threshold, by
    comparing all stretches of all texts, is found at that stretch; repeated documents alike."""
    import random
    r = random.Random(9)
    items = [(i, sentence(3000 + i, r.choice([8, 12, 30, 60, 120, 300, 400, 700]))) for i in range(24)]
    docs = []
    for i, text in items:
        for _ in range(3):
            w = text.split()
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                at = r.randrange(len(w))
                w[at:at + r.choice([0, 1, 1, 2])] = [f"new{r.randrange(999)}"] * r.choice([0, 1, 1, 2])
            docs.append((len(docs), " ".join([sentence(len(docs), r.choice([0, 25])), *w, sentence(500 + len(docs), r.choice([0, 25]))])))
    docs.append(docs[0])
    index = decontaminate.Index([i for i, _ in items], [t for _, t in items])
    want = {}
    for d, text in docs:
        h = X.word_hashes(X.words(pa.array([text]), lower=True))
        for i, words_ in enumerate(index.words):
            bag, many = (x.tolist() for x in index.bags[i])
            have, n = dict(zip(bag, many)), len(words_)
            for p in range(-n // 4, len(h)):
                s, e = max(p, 0), min(p + n, len(h))
                if e - s < 0.75 * n or i != d // 3:
                    continue
                c = collections.Counter(next(X.text_shingles(h[s:e], np.array([0, e - s]))).tolist())
                weight = dict(zip(index.known.tolist(), index.weight.tolist()))
                both = sum(weight.get(g, 1.0) * min(c[g], have.get(g, 0)) for g in c)
                whole = sum(weight.get(g, 1.0) * max(c.get(g, 0), have.get(g, 0)) for g in {*c, *have})
                if both / whole >= 0.8 - 1e-9 and (d, i) not in want or (d, i) in want and both / whole > want[d, i][0] + 1e-12:
                    want[d, i] = (both / whole, s, e - s)
    got = decontaminate.contaminated(spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, item_id int, start_word string"),
                                     spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(want) + 1 > 40                                     # one document stands twice
    for g in got:
        score, s, n = want[g.doc_id, g.item_id]
        assert abs(g.similarity - score) < 1e-9 and (g.start_word, g.n_words) == (s, n)


def test_wide_counters_equal_plain_counts():
    h = X.mix(np.arange(1, 2000, dtype=np.uint64))
    c = decontaminate.Counters(h)
    for size in (3, 220, 256, 257, 1000):
        for at in (0, 7, len(h) - size):
            votes = [(int(v) >> b) & 1 for v in h[at:at + size] for b in range(64)]
            bits = np.array(votes).reshape(size, 64).sum(axis=0) > size // 2
            assert int(c.fingerprints(size)[at]) == sum(1 << b for b in range(64) if bits[b])
    assert decontaminate.window_size(276) == 220 and decontaminate.window_size(10_000) > 6_000


def test_multi_index_finds_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(2)
    index = decontaminate.Index([0], [sentence(5, 50)], radius=7)
    (size, (prints, _, tables)), = index.sizes.items()
    for _ in range(500):
        bits = rng.choice(64, rng.integers(0, 8), replace=False)
        near = int(prints[0]) ^ sum(1 << int(b) for b in bits)
        assert any(has[(near >> (16 * b)) & 0xFFFF] for b, (has, _, _) in enumerate(tables))


def test_decontamination_in_blocks_of_items(spark, no_documents):
    items = spark.createDataFrame([(i, sentence(i, 20)) for i in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(i, sentence(i, 20)) for i in range(9)], "doc_id long, text string")
    got = decontaminate.contaminated(docs, items, block_items=2).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(9)]
    assert decontaminate.contaminated(docs, items.limit(0)).collect() == []
    assert decontaminate.contaminated(no_documents, items).collect() == []


def test_items_without_an_id_are_searched(spark):
    items = spark.createDataFrame([(None, sentence(1, 30)), (7, sentence(2, 30)), (None, None), (None, sentence(3, 30))], "item_id long, text string")
    docs = spark.createDataFrame([(i, sentence(20 + i, 40) + " " + sentence(i, 30)) for i in (1, 2, 3, 4)], "doc_id long, text string")
    for block_items in (20_000, 1):
        got = decontaminate.contaminated(docs, items, block_items=block_items).collect()
        assert sorted((r.doc_id, r.item_id or 0, r.start_word, r.similarity) for r in got) == [(1, 0, 40, 1.0), (2, 7, 40, 1.0), (3, 0, 40, 1.0)]


def test_shards(documents, no_documents):
    got = kd_shards.document_shards(documents, shards=5).collect()
    texts = collections.Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in documents.collect())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == texts
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    assert kd_shards.document_shards(no_documents).collect() == []


def test_shards_of_equal_rows_are_near_equal(spark):
    """A third of the rows repeat one row, ties everywhere."""
    rows = [(1, 100, 5.0)] * 2000 + [(i, 100 + i % 7, float(i % 3)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, w long, x double")
    got = kd_shards.kd_shards(df, ["x", "doc_id"], "w", target_bytes=20_000).groupBy("shard").sum("w").collect()
    total = sum(r[1] for r in rows)
    sizes = [r[1] for r in got]
    assert len(sizes) == -(-total // 20_000) and max(sizes) < 1.1 * total / len(sizes) and min(sizes) > 0.9 * total / len(sizes)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_secrets_equal_regular_expressions(spark, documents):
    import random
    r = random.Random(3)
    parts = ["password", "Secret", "TOKEN", "api_key", "'", '"', " ", "=", ":", "abc", "deadbeef" * 3, "AKIA", "ABCDEFGH01234567",
             "é", "\n", "x", "==", "_", "token=", "secret:token: abcdefgh", " : ", "0123456789abcdef01234567", "ghp_" + "a1" * 18]
    rows = [(1000 + i, "".join(r.choice(parts) for _ in range(r.randint(1, 25)))) for i in range(400)]
    rows += [(2001, None), (2002, ""), (2003, "password=" + "a" * 150_000), (2004, "token=x " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(documents.select("doc_id", "text"))
    want = collections.Counter((i, hashlib.sha256(base_spans(t or "").encode()).hexdigest()) for i, t in docs.collect())
    got = secret_scan.secret_digests(docs).collect()
    assert collections.Counter((g.doc_id, g.base_sha256) for g in got) == want
    by_id = {g.doc_id: g for g in got}
    assert by_id[2003].n_assign == 1 and by_id[2004].n_assign == 0 and by_id[2001].spans == ""


def test_long_value_behind_a_consumed_keyword_is_linear():
    import time
    scanner = secret_scan.Scanner(secret_scan.BASE_RULES)
    for text in ("secret: token: " + "Zz9" * 350_000, "secret:token:" * 80_000, "token=abcdefgh" * 70_000):
        data = np.frombuffer(text.encode(), np.uint8)
        t = time.perf_counter()
        got = scanner.spans(data, np.array([0, len(data)])).get(0, [])
        assert time.perf_counter() - t < 5
        assert ",".join(f"{secret_scan.BASE_RULES[r].kind}:{s}:{e}" for s, r, e in got) == base_spans(text)


def test_rule_expressions_equal_the_re_module():
    import random
    r = random.Random(8)
    rules = [r"a(b|cd)?e+", r"[^a-c\x20]{2,3}x", r"(?:ab|a|b){2}c", r"\[a\]\.b*", r".a[]b-]+"]
    for regex in rules:
        scanner = secret_scan.Scanner((secret_scan.Rule("k", regex),))
        for _ in range(300):
            text = "".join(r.choice("aabbcdex []-.") for _ in range(r.randint(1, 9)))
            rows, accept, _ = scanner.steps[0]
            s = 0
            for b in text.encode():
                s = rows[s][b]
            assert bool(accept[s]) == bool(re.fullmatch(regex, text)), (regex, text)
    for bad in (r"a*?", r"(?=a)", r"\d", r"^a", "(a", "a)", "é\u0142"):
        with pytest.raises(ValueError):
            secret_scan.parse_rule(bad)


def test_redaction_keeps_the_rest(spark, documents, no_documents):
    docs = spark.createDataFrame([(1, "é key: token=abcdefgh end", 5), (2, None, 6), (3, "AKIA" + "B" * 16 + "!", 7)], "doc_id long, text string, c0 int")
    got = {r.doc_id: r for r in secret_scan.scan(docs, redact="[X]").collect()}
    assert got[1].text == "é key: [X] end" and got[2].text is None and got[3].text == "[X]!" and got[3].c0 == 7
    assert [tuple(s) for s in got[1].spans] == [("assign", 7, 21)]
    clash = secret_scan.scan(documents)                     # has a column named spans already
    assert clash.columns == documents.columns[:-2] + ["shard", "spans"] and clash.count() == documents.count()
    assert secret_scan.scan(no_documents).collect() == []


def test_bpe_equals_tiktoken(spark, documents, no_documents):
    import public_tokenizers as tokenizers
    import tiktoken
    from pyspark.sql import functions as F

    ranks = byte_bpe.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coder = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    extra = spark.createDataFrame([(900, "a" * 3000 + " " * 500), (901, "don't I'LL 12½Ⅷ 😀 <|endoftext|> \x00\x1c\x85")], "doc_id long, text string")
    docs = documents.select("doc_id", "text").where("length(text) < 50000 or text is null").unionAll(extra)
    want = collections.Counter()
    for i, t in docs.collect():
        ids = coder.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert collections.Counter(tuple(r) for r in byte_bpe.round_trip_digests(docs, ranks, tokenizers.PATTERN).collect()) == want
    assert byte_bpe.round_trip_digests(no_documents, ranks, tokenizers.PATTERN).collect() == []
    words_ = spark.createDataFrame([(w,) for w in ["", "a", " the", "retitioning", "élelle", "中文字", "zzzzzzzzqqqq"]], "word string")
    for r in byte_bpe.fold_words(words_, ranks).collect():
        assert r.ids == (coder._core_bpe.encode_single_piece(r.word.encode()) if r.word else [])
    assert byte_bpe.fold(b"ab" * 40, ranks) == coder._core_bpe.encode_single_piece(b"ab" * 40)
    back = spark.range(1).select(byte_bpe.decode(F.lit(None).cast("array<int>"), ranks).alias("b")).first()
    assert back.b is None


def test_bpe_folds_the_new_pieces_of_a_slice_side_by_side(monkeypatch):
    """One by one only pieces of more than 48 bytes; with a cache that forgets, and a text cut in groups."""
    import public_tokenizers as tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coder = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r, one_by_one, fold = np.random.default_rng(5), [], byte_bpe.fold
    letters = [list("etaoinshrdlu"), list("éàbç中文字Ⅷ😀\x00\x85"), list("ab")]

    def text(n):
        return " ".join("".join(r.choice(letters[k % 3], size=r.integers(1, 30))) for k in range(n))

    texts = [None, "", "a" * 48 + "b" * 9 + " " + "é" * 24, "x", *(text(400) for _ in range(6)), text(20_000) + " word" * 210_000]
    texts += texts[2:6]
    assert max(len(t or "") for t in texts) > 1 << 20
    monkeypatch.setattr(byte_bpe, "_WORKER", {})
    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", 3000)
    monkeypatch.setattr(byte_bpe, "fold", lambda word, ranks: one_by_one.append(word) or fold(word, ranks))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["k0", "text"])
    got = [x for b in byte_bpe._encoder(ranks, tokenizers.PATTERN)(iter([batch])) for x in b.column("ids").to_pylist()]
    assert got == [coder.encode_ordinary(t or "") for t in texts]
    assert all(len(word) > 48 for word in one_by_one)


@pytest.mark.parametrize("tokens", [0, 40, 600])
def test_bpe_side_by_side_equals_one_by_one(tokens):
    """Any rank file: ranks here are dealt at random, so a merge may make a pair of a lower rank."""
    r = np.random.default_rng(tokens)

    def word(least, most):
        return bytes(r.choice(list(b"abcd"), size=r.integers(least, most)).astype(np.uint8))

    made = {word(2, 9) for _ in range(tokens)}
    order = r.permutation(256 + len(made)).tolist()
    ranks = dict(zip([*(bytes([i]) for i in range(256)), *sorted(made)], [3 * i for i in order]))
    words_ = sorted({w for w in (word(2, 49) for _ in range(3000)) if w not in ranks} | {b"ab" * 24, b"\x00\xff"}, key=len)
    got = byte_bpe._fold_side_by_side(words_, byte_bpe._Pairs(ranks))
    assert [np.frombuffer(b, np.int32).tolist() for b in got] == [byte_bpe.fold(w, ranks) for w in words_]
    for odd in ({t: i for t, i in ranks.items() if t != b"z"}, ranks | {b"z": ranks[b"a"]}):
        cache = byte_bpe._Cache(odd)
        cache.learn({"abcd", "abab"})
        assert [np.frombuffer(cache[w], np.int32).tolist() for w in ("abcd", "abab")] == [byte_bpe.fold(w, odd) for w in (b"abcd", b"abab")]


@pytest.mark.parametrize("step", ["measures", "survey", "postings", "shingles"])
def test_a_worker_holds_little_beside_its_batch(step):
    """A reused worker keeps what a task took, and shares the executor's memory with the JVM."""
    r = np.random.default_rng(3)
    texts = [" ".join(map(str, r.integers(1 << 40, size=1200))) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    run = {"measures": lambda b: quality_rules._measure(next(b), "text"), "survey": ngram_join._survey(5, 0.002)[0],
           "postings": ngram_join._postings(5, Fraction(4, 5), np.zeros(0, np.uint64))[0], "shingles": ngram_join._shingle_rows(5)[0]}[step]
    X._POW.clear()
    tracemalloc.start()
    try:
        for out in run(iter([batch])):
            del out
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 56 << 20


def test_survey_counts_the_shingles_that_several_texts_share():
    shared = [f"s{i}" for i in range(9)]
    texts = [" ".join([*shared, *(f"t{t}w{i}" for i in range(20 + t))]) for t in range(6)] + ["a b c d e f"] * 9 + ["", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    found = [b.to_pylist() for b in ngram_join._survey(5, 0.002)[0](iter([batch]))]
    common = [r for b in found for r in b if r["shingle"] is not None]
    w = X.words(pa.array([" ".join(shared)]))
    assert {r["shingle"]: r["texts"] for r in common} == dict.fromkeys(
        X.window_hashes(X.word_hashes(w)).view(np.int64).tolist(), 6)
    # chunks that are full are counted by themselves; texts above the chunk too
    again = [r for b in ngram_join._survey(5, 0.002, chunk=3)[0](iter([batch])) for r in b.to_pylist()]
    assert not [r for r in again if r["shingle"] is not None] and sum(r["sid"] is not None for r in again) == len(texts)
