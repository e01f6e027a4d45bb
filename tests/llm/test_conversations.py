import hashlib
import heapq
import itertools
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from attesta.llm import prefix_trie, repair

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def rebuilt(rows):
    """conv_id -> turns (role, text), by the contract's words."""
    own = {}
    for conv, turn, role, text in rows:
        own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items() if c is not None}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def brute_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def total(node):
        leaves = not children.get(node)
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        for child in children.get(node, []):
            more = total(child)
            leaves, saved = leaves + more[0], saved + more[1]
        return int(leaves), saved

    out = set()
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        out.add((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children.get(node, [])), *total(node), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    got = prefix_trie.trie(*prefix_trie.graft(prefix_trie.placed(df)))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_trie_against_plain_dictionaries(spark):
    draw = random.Random(5)
    rows = []
    for c in [*range(0, 40), *range(100, 130), 250, 251, -7]:
        for turn in range(draw.randrange(1, 9)):
            rows.append((c, turn if turn else None, draw.choice(["user", "assistant", None]), draw.choice(["a", "bb", "", None, "é😀"])))
    rows += [(60, t, "user", "deep") for t in range(150)] + [(61, t, "user", "deep") for t in range(90)]
    rows += [(None, 0, "user", "no conversation"), (c := 62, 3, "user", "same"), (c, 3, "user", "same"), (63, 0, "user", "x" * 200_000)]
    draw.shuffle(rows)
    assert trie(spark, rows, place=1, size="s", a=2) == brute_trie(rebuilt(rows))


def test_turnless_conversations_and_empty_tables(spark):
    # 301 takes its beginning from a conversation that isn't there, and has no more turns.
    short = next(c for c in range(301, 399) if zlib.crc32(str(c).encode()) % 6 >= 2)
    assert trie(spark, [(short, 0, "user", "hello")]) == {(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())}
    assert trie(spark, []) == set()


def test_trie_of_a_staircase_takes_few_rounds(spark, monkeypatch):
    """Conversation i leaves a common spine after i turns: by least ids every path would
    wait for the next one, by hashes few do."""
    n = 120
    convs = spark.range(n).withColumnRenamed("id", "conv_id")
    rows = convs.select("conv_id", F.explode(F.sequence(F.lit(1), F.col("conv_id").cast("int") + 1)).alias("place"))
    last = F.col("place") > F.col("conv_id")
    rows = rows.select("conv_id", "place", F.when(last, F.col("conv_id") + 1000).otherwise(F.col("place")).cast("long").alias("one"), F.lit(0).cast("long").alias("two"), F.lit(3).cast("long").alias("size"))
    every = prefix_trie.nodes(prefix_trie.prefixes(rows, convs))
    cuts = []
    monkeypatch.setattr(prefix_trie, "cut", lambda df, f=prefix_trie.cut: (cuts.append(1), f(df))[1])
    prefix_trie.peeled(every)
    assert len(cuts) < 30
    got = {r.depth: r for r in prefix_trie.trie(rows, convs).filter("n_convs > 1").collect()}
    assert [got[d].n_convs for d in range(n - 1)] == [n - d for d in range(n - 1)]
    assert got[0].n_leaves == n
    assert got[0].saved_tokens == sum(3 * (n - d - 1) for d in range(1, n))


def dijkstra(symbols):
    """Least (cost, labels) over the whole composition, by complete labels."""
    heap, seen = [(0, "", 0, repair.START)], set()
    while heap:
        cost, labels, i, q = heapq.heappop(heap)
        if i == len(symbols) and q in repair.ACCEPTING:
            return cost, labels
        if (i, q) in seen:
            continue
        seen.add((i, q))
        steps = [("I", 5, q2, i) for (p, c), q2 in repair._NEXT.items() if p == q and c in "ua"]
        if i < len(symbols):
            s = symbols[i]
            steps.append(("D", 2, q, i + 1))
            if s != "x":
                more = 5 if s.isupper() else 0
                steps += [("K", more, q2, i + 1) for (p, c), q2 in repair._NEXT.items() if p == q and c == s.lower()]
                steps += [("R", 1 + more, q2, i + 1) for (p, c), q2 in repair._NEXT.items() if p == q and c in "ua"]
        for label, c, q2, j in steps:
            heapq.heappush(heap, (cost + c, labels + label, j, q2))


@pytest.mark.parametrize("size", range(6))
def test_cheapest_edits_against_dijkstra(size):
    alphabet = "xsuaoUA" if size < 5 else "xsuA"
    for symbols in itertools.product(alphabet, repeat=size):
        assert repair.cheapest("".join(symbols)) == dijkstra(symbols), symbols


def test_cheapest_edits_of_long_strings():
    draw = random.Random(3)
    for _ in range(40):
        symbols = "".join(draw.choices("xsuaoSUAO", k=60))
        assert repair.cheapest(symbols) == dijkstra(symbols)


def brute_repair(rows):
    out, convs = {}, {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else text.translate({ord(c): None for c in ".!?"}) if fault == 2 else text
        convs[conv] += [(turn is not None, turn or 0, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    space = " \t\n\x0b\x0c\r"
    for conv, turns in convs.items():
        turns.sort()
        counts, symbols, seen = dict.fromkeys("bdt", 0), "", set()
        for _, _, role, text in turns:
            ink = text.strip(space)
            symbol = role[:1] if role[:1] in ("s", "u", "a") else "o"
            kind = "b" if not ink else "d" if (role, text) in seen else "t" if ink[-1] not in ".!?" else ""
            symbol = "x" if kind in ("b", "d") else symbol.upper() if kind else symbol
            seen.add((role, text))
            symbols += symbol
            if kind:
                counts[kind] += 1
        numbers = [t for known, t, _, _ in turns if known]
        illegal = sum(x[2][:1] + y[2][:1] not in ("su", "ua", "au") for x, y in zip(turns, turns[1:]))
        cost, audit = dijkstra(symbols)
        kept, state, at = [], repair.START, 0
        for label in audit:
            role, text = ("", "") if label == "I" else turns[at][2:]
            at += label != "I"
            if label in "IR":
                role, state = repair._NEW[state]
            elif label == "K":
                state = repair._NEXT[state, role[0]]
            if label != "D":
                kept.append(f"{role}:{text}")
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_repair_against_plain_lists(spark):
    draw = random.Random(11)
    rows = []
    for c in [*range(60), None]:
        for turn in range(draw.randrange(1, 10)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = draw.choice(["Fine.", "Why? ", "cut off", "", " \t", None, "Ja!\n", "é😀.", " ", "a.b"])
            rows.append((c, draw.choice([turn, turn, turn + 3]) if turn else None, role, text))
    # Ties of different rows are ordered by hashes; leave rows that are the same or alone.
    first = {}
    rows = [r for r in rows if first.setdefault(r[:2], r) == r]
    rows += [(90, 0, "user", "Same."), (90, 0, "user", "Same."), (91, -(1 << 62), "user", "Far."), (91, 1 << 62, "assistant", "Away."), (92, 5, "user", "long " * 50_000 + ".")]
    rows += [(93, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(700)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("gone", F.lit(1)).withColumn("report", F.lit("r"))
    got = {r[0]: tuple(r[1:]) for r in repair.digests(repair.damage(df)).collect()}
    assert got == brute_repair(rows)
    turns = repair.repair(repair.damage(df)).collect()
    for conv, expected in got.items():
        own = sorted((r.place, r.edit, r.role, r.text) for r in turns if r.conv_id == conv)
        assert [x[0] for x in own] == [*range(1, len(own) + 1)]
        assert "".join(x[1] for x in own) == expected[6].replace("D", "")
        assert hashlib.sha256("\n".join(f"{x[2]}:{x[3]}" for x in own).encode()).hexdigest() == expected[7]


def test_repair_of_nothing(spark):
    assert repair.digests(repair.damage(spark.createDataFrame([], SCHEMA))).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.digests(repair.damage(spark.createDataFrame([(dropped, 0, "user", "Hi.")], SCHEMA))).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", EMPTY)]
