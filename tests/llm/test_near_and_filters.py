import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from attesta.llm import decontaminate, simhash, url_filter
from attesta.llm.common import cut, cut_spans


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def brute_roots(prints, radius):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_every_close_pair_shares_a_table():
    masks = simhash.covering_masks(4)
    assert len(masks) == 31
    draw = random.Random(5)
    for _ in range(2000):
        a = draw.getrandbits(64)
        b = a
        for k in draw.sample(range(64), draw.randrange(5)):
            b ^= 1 << k
        assert any((a ^ b) & (m & (2**64 - 1)) == 0 for m in masks)


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicates_against_all_pairs(spark, block):
    draw = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        base = draw.choices(words, k=draw.choice([1, 2, 5, 60, 200, 400]))
        for _ in range(draw.choice([1, 1, 2, 9])):
            copy = base.copy()
            for _ in range(draw.randrange(4)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            texts.append(draw.choice([" ", "\n", " \t"]).join(copy).upper() if draw.random() < 0.3 else " ".join(copy))
    texts += [None, "", "  \n", "A", "a", "\xa0", "one two three", "one two three four"]
    rows = [*enumerate(texts)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("root", F.lit(1))
    found = {r.doc_id: r for r in simhash.near_duplicates(df, block=block).collect()}
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    roots = brute_roots(prints, 4)
    assert {i: r.fingerprint for i, r in found.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in found.items()} == roots


def test_near_duplicates_of_long_texts_and_hot_copies(spark):
    """A third of the rows is one text, and two long texts differ in one word."""
    draw = random.Random(3)
    long = [f"w{draw.randrange(500)}" for _ in range(60_000)]
    rows = [(i, "one and the same text") for i in range(400)] + [(400, " ".join(long)), (401, " ".join([*long[:-1], "end"])), (402, "x" * 300_000)]
    rows += [(i, f"text {draw.getrandbits(60)} of its own {draw.getrandbits(60)}") for i in range(403, 1200)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {i: brute_print(t) for i, t in rows if i > 399} | {0: brute_print(rows[0][1])}
    assert all(got[i].fingerprint == f"{p:016x}" for i, p in prints.items())
    roots = brute_roots(prints, 4)
    assert {i: got[i].component_id for i in prints} == roots and roots[401] == 400
    assert {got[i].component_id for i in range(400)} == {0}


def test_near_duplicates_of_fingerprint_crowds(spark):
    draw = random.Random(2)
    values = set()
    for _ in range(3):
        center = draw.getrandbits(64)
        for _ in range(60):
            v = center
            for k in draw.sample(range(64), draw.randrange(6)):
                v ^= 1 << k
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 4, 16)
    roots = {r.vertex: r.root for r in simhash.components(edges).collect()}
    masked = {v: v & (2**64 - 1) for v in signed}
    expected = brute_roots(masked, 4)
    assert {v: roots.get(v, v) for v in signed} == expected


def test_components_stop_at_stars_in_few_parts(spark, monkeypatch):
    """A forest of stars takes no round, others none beyond the last that changes edges, and
    the tables of rounds have no more parts than their edges need."""
    made = []
    monkeypatch.setattr(simhash, "cut", lambda df: made.append(cut(df)) or made[-1])
    stars = spark.createDataFrame([(1, 5), (7, 1), (1, 9), (20, 21)], "a long, b long")
    assert {(r.vertex, r.root) for r in simhash.components(stars).collect()} == {(1, 1), (5, 1), (7, 1), (9, 1), (20, 20), (21, 20)}
    assert len(made) == 1
    made.clear()
    draw = random.Random(4)
    pairs = [(k, k + 1) for k in range(40)] + [(draw.randrange(100, 200), draw.randrange(100, 200)) for _ in range(80)]
    root = {v: v for pair in pairs for v in pair}
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    found = {r.vertex: r.root for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {v: found.get(v, v) for v in root} == root
    tables = [sorted(map(tuple, df.collect())) for df in made]
    assert len(tables) > 2 and tables[-1] != tables[-2]
    assert [df.rdd.getNumPartitions() for df in made[1:]] == [1] * (len(made) - 1)
    empty = spark.createDataFrame([], "a long, b long")
    assert simhash.components(empty).count() == 0


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, "other words")], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in simhash.near_duplicates(twice).collect()) == ["1", "1", "1", "None"]


def brute_hits(text, items, window):
    split = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words, hit, found = split.findall(low(text)), set(), set()
    for item, body in items:
        w = split.findall(low(body))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            part = w[k : k + window]
            for p in range(len(words) - len(part) + 1):
                if words[p : p + len(part)] == part:
                    hit |= {*range(p, p + len(part))}
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("chars", [16_000_000, 20])
def test_decontaminate_against_scan(spark, monkeypatch, chars):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
    draw = random.Random(4)
    words = ["a", "B", "É", "x1", "the", "é"]
    items = [(i, " ".join(draw.choices(words, k=draw.randrange(9)))) for i in range(12)] + [(3, None), (None, "a a a"), (20, "--")]
    docs = [(i, draw.choice([" ", "--", "\n"]).join(draw.choices([*words, "zz"], k=draw.randrange(60)))) for i in range(60)] + [(60, None), (61, ""), (61, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)).withColumn("words", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("x", F.lit(1))
    got = decontaminate.decontaminate(df, bench, window=4).collect()
    want = [(i, *brute_hits(t, [x for x in items if x[0] is not None], 4)) for i, t in docs]
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == sorted(want)
    text = dict(docs)
    for r in got:
        for s in r.spans:
            assert brute_hits(text[r.doc_id][s.start : s.end], items[:12], 4)[1] > 0


def test_decontaminate_long_texts(spark, monkeypatch):
    """Shards and located occurrences are bounded, also under a one-word item."""
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 2000)
    monkeypatch.setattr(decontaminate, "LOCATED", 50)
    draw = random.Random(6)
    words = ["the", "a", "of", "zz", "yy"]
    docs = [(i, " ".join(draw.choices(words, k=n))) for i, n in enumerate([3000, 3, 900, 0, 40, 1])]
    items = [(1, "the"), (2, "a of a"), (3, "of of the a"), (4, "yy zz yy zz yy")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(df, bench, window=4).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == [(i, *brute_hits(t, items, 4)) for i, t in docs]


def test_decontaminate_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.decontaminate(docs, none).collect()] == [0]
    assert decontaminate.decontaminate(docs.limit(0), none).count() == 0


def test_cut_spans(spark):
    df = spark.sql("SELECT 'aébcdef' AS text, array(struct(1 AS start, 2 AS end), struct(4 AS start, 7 AS end)) AS spans")
    assert df.select(cut_spans(F.col("text"), F.col("spans"), "_")).first()[0] == "a_bc_"


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("a.example.com", "allow"), ("example.com/de/x", "allow"), ("org/fr/", "block")]


def brute_verdict(url, rules=RULES):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    fold = lambda x: "".join(c.lower() if c.isascii() else c for c in x)
    host, path = (fold(m[1]), m[2]) if m else ("", "")
    fits = []
    for rule, verdict in rules:
        h, s, p = rule.partition("/")
        h = fold(h)
        if (host == h or host.endswith("." + h) or not h) and path.startswith(s + p):
            fits.append((-len(h), -len(s + p), verdict != "allow", rule, verdict))
    best = min(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


URLS = [
    "http://x.example.net/en/1", "http://example.net", "http://example.net/", "http://EXAMPLE.net/en", "https://a.example.com/de/x1?q=/#z", "https://b.example.com/de/xy",
    "https://b.example.com/de/y#/de", "ftp://q.org/fr/", "q.org/fr/", "http://notexample.net.com/en/", "http://myexample.com/de/", "", None, "://", "http://?net/", "http://u://v.net/x", "http://net/", "http://a..net/",
    "http://É.org/fr/é", "http://x.net/" + "a/" * 50_000, "http://" + "a." * 20_000 + "net/",
]


@pytest.mark.parametrize("size", [100, 3])
def test_url_filter_against_scan(spark, size):
    pages = spark.createDataFrame([*enumerate(URLS[:-1]), (2, URLS[2])], "page_id long, url string").withColumn("rule", F.lit("own"))
    rules = spark.createDataFrame([*RULES, RULES[0], (None, "block")], "rule string, verdict string")
    got = url_filter.judge(pages, rules, trie_entries=size).collect()
    want = [(i, *brute_verdict(u)) for i, u in [*enumerate(URLS[:-1]), (2, URLS[2])]]
    assert sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got))) == sorted(map(str, want))
    assert url_filter.judge(pages.limit(0), rules, trie_entries=size).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0), trie_entries=size).collect()} == {"allow"}


def test_url_filter_of_many_host_labels(spark):
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    got = url_filter.judge(spark.createDataFrame([(1, URLS[-1])], "page_id long, url string"), rules).first()
    assert (got.rule, got.verdict) == ("net/", "block")


def test_trie_and_join_agree(spark):
    """Entries that differ in case, verdict or spelling only, on both sides of the switch."""
    draw = random.Random(12)
    for turn in range(3):
        hosts = ["a.com", "A.com", "b.a.com", "B.A.COM", "com", "", "x.B.a.com"]
        paths = ["", "/", "/p", "/p/", "/p/q", "/P"]
        entries = [(draw.choice(hosts) + draw.choice(paths), draw.choice(["allow", "block"])) for _ in range(draw.randrange(4, 25))]
        urls = [f"http://{draw.choice(hosts)}{draw.choice(['', '/p', '/p/q/r', '/', '/Pp'])}" for _ in range(60)]
        pages = spark.createDataFrame([*enumerate(urls)], "page_id long, url string")
        rules = spark.createDataFrame(entries, "rule string, verdict string")
        want = [(i, *brute_verdict(u, entries)) for i, u in enumerate(urls)]
        for limits in ({}, {"trie_entries": 1}, {"trie_bytes": 1}):
            got = url_filter.judge(pages, rules, **limits).collect()
            assert sorted(map(tuple, got)) == sorted(want), (turn, limits)
