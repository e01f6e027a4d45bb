import random

import pytest

import corpus_pipeline
from attesta.llm import near_copies, simhash
from tests.llm.test_near_and_filters import brute_roots


def grams(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


class Linked(frozenset):
    """Of two sets, ``^`` counts as no bit where they are similar and as 64 elsewhere."""

    def __xor__(self, other):
        return 0 if len(self & other) >= 0.8 * len(self | other) - 1e-9 else 2**64 - 1


def edited(draw, base, edits):
    out = base.copy()
    for at in draw.sample(range(len(out)), edits):
        out[at] = f"edit{draw.getrandbits(40)}"
    return out


@pytest.mark.parametrize("block", [1024, 3])
def test_groups_against_all_pairs(spark, block):
    draw = random.Random(3)
    texts = [None, "", " \n", "A b", "a  B", "one two three four five", "one two three four five six"]
    for _ in range(30):
        base = [f"w{draw.randrange(3000)}" for _ in range(draw.choice([6, 60, 250, 500]))]
        for _ in range(draw.choice([1, 2, 3, 9])):
            texts.append(" ".join(edited(draw, base, draw.randrange(1 + len(base) // 40))))
    rows = [*enumerate(texts)]
    want = brute_roots({i: Linked(grams(t)) for i, t in rows if grams(t)}, 4) | {0: 0, 1: 0, 2: 0}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.groups_of(docs, block=block).collect()}
    assert got == want
    assert len(set(want.values())) < len(want) - 10


def test_stage_drops_edited_copies(spark):
    draw = random.Random(9)
    rows, similar = [], []
    for k in range(60):
        base = [f"w{draw.randrange(20_000)}" for _ in range(400)]
        copy = edited(draw, base, draw.choice([2, 4, 6, 7]))
        a, b = grams(" ".join(base)), grams(" ".join(copy))
        similar.append(len(a & b) / len(a | b))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    assert min(similar) >= 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()}
    assert left == {2 * k for k in range(60)}


def test_stage_drops_documents_of_near_fingerprints(spark):
    """op1's links count too: a line that is repeated outweighs what follows it, so texts have
    near fingerprints while their shingle sets differ. Groups are those of both links."""
    draw = random.Random(5)
    word = lambda: f"w{draw.randrange(10**6)}"
    rows = []
    for k in range(0, 60, 3):
        line = " ".join(word() for _ in range(7)) + " "
        first, second = (line * 60 + " ".join(word() for _ in range(12)) for _ in range(2))
        # The third is a near copy of the second's only by its shingles.
        third = " ".join(dict.fromkeys(second.split())) if k % 2 else second + " " + word()
        rows += [(k, first), (k + 1, second), (k + 2, third)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {i: simhash.simhash(t) for i, t in rows}
    linked = [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 4]
    sets = {i: Linked(grams(t)) for i, t in rows}
    similar = [(i, j) for i in sets for j in sets if i < j and not sets[i] ^ sets[j]]
    assert len({*linked} - {*similar}) >= 15
    root = {i: i for i in prints}
    for _ in rows:
        for i, j in linked + similar:
            root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: r.component_id for r in near_copies.groups_of(docs, radius=simhash.RADIUS).collect()}
    assert got == root
    left = {r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()}
    assert left == {i for i in root if root[i] == i} and len(left) < 50
