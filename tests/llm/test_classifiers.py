import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attesta.llm import language, quality
from attesta.llm.common import table, utf8_of

SF = "/root/testdata/sf0.001"


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_line_features_by_hand():
    texts = ["Ab a a\n|| 1\nAb a a", "", "é É\n\n", "x", "x"]
    x, size, doc = quality.line_features(*utf8_of(pa.array(texts)))
    lines = [line for t in texts for line in t.split("\n")]
    assert size.tolist() == [len(line.encode()) for line in lines]
    assert doc.tolist() == [k for k, t in enumerate(texts) for _ in t.split("\n")]
    names = [*quality._CLASSES, "again1", "again2", "again3", "seen", "length", "word", "blank_line"]
    got = {n: x[:, k] for k, n in enumerate(names)}
    assert got["again1"][0] == pytest.approx(1 / 3) and got["again1"][1:].sum() == pytest.approx(1 / 3)
    assert got["seen"].tolist() == [0, 0, 1, 0, 0, 0, 0, 0, 0]
    assert got["pipe"][1] == pytest.approx(2 / 4) and got["digit"][1] == pytest.approx(1 / 4)
    assert got["blank_line"].tolist() == [0, 0, 0, 1, 0, 1, 1, 0, 0]


def test_long_texts_are_counted_in_pieces(monkeypatch):
    draw = np.random.default_rng(5)
    for _ in range(60):
        text = "".join(draw.choice([*"aB1 |", "\n", "word ", "é"], 400))
        whole = quality.line_features(*utf8_of(pa.array([text])))
        longest = max(len(x.encode()) for x in text.split("\n"))
        monkeypatch.setattr(quality, "AT_ONCE", longest + 1 + int(draw.integers(20)))
        parts = quality.features_of(pa.array([text]))
        assert all(np.allclose(a, b) for a, b in zip(whole, parts, strict=True))
        monkeypatch.setattr(quality, "AT_ONCE", 5)
        assert quality.features_of(pa.array([text]))[1].sum() == len(text.encode()) - text.count("\n")


def test_quality_against_loops(spark):
    """The query's scores by forward and backward sums over one line at a time."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    field = quality.train(docs, labels)
    move = np.exp(field.pairs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.score(docs, field).collect():
        x, size, doc = quality.line_features(*utf8_of(pa.array([texts[r.doc_id]], pa.string())))
        z = (x - field.center) / field.scale
        nothing = np.zeros(quality.FEATURES)
        score = [np.concatenate([z[i], z[i - 1] if i else nothing, z[i + 1] if i + 1 < len(z) else nothing, [1]]) @ field.weights for i in range(len(z))]
        emit = [np.array([1 - (p := 1 / (1 + np.exp(-min(30, max(-30, s))))), p]) for s in score]
        ahead, back = [emit[0] / emit[0].sum()], [np.ones(2)]
        for e in emit[1:]:
            a = (ahead[-1] @ move) * e
            ahead.append(a / a.sum())
        for e in emit[:0:-1]:
            b = move @ (e * back[0])
            back.insert(0, b / b.sum())
        good = [(a * b)[1] / (a * b).sum() for a, b in zip(ahead, back, strict=True)]
        assert r.score == pytest.approx(np.average(good, weights=size + 1.0), abs=1e-4)


def test_marginals_against_enumeration():
    draw = np.random.default_rng(1)
    doc = np.repeat([0, 1, 2], [3, 1, 5])
    score, pairs = draw.normal(size=9), draw.normal(size=(2, 2))
    p, expected = quality.marginals(score, doc, pairs)
    want, joint = [], np.zeros((2, 2))
    for d in range(3):
        s = score[doc == d]
        ways = []
        for w in np.ndindex(*[2] * len(s)):
            ways.append((np.exp(sum(s[i] for i in range(len(s)) if w[i]) + sum(pairs[a, b] for a, b in zip(w, w[1:], strict=False))), w))
        z = sum(v for v, _ in ways)
        want += [sum(v for v, w in ways if w[i]) / z for i in range(len(s))]
        for v, w in ways:
            for a, b in zip(w, w[1:], strict=False):
                joint[a, b] += v / z
    assert np.allclose(p, want) and np.allclose(expected, joint)


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = quality.classify(docs, labels)
    assert got.count() == docs.count()
    both = got.join(labels.filter("quality IS NOT NULL"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in both]) > 0.9
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.collect())


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x\n\n"), (5, "long " * 40_000)], "doc_id long, text string").withColumn("score", F.lit("own"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify(docs, none).collect()
    assert len(got) == 5 and all(r.score == 0.5 for r in got)
    assert sorted(r.lines for r in got) == [1, 1, 1, 1, 3]
    one = spark.createDataFrame([(2, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, one).collect())
    assert quality.classify(docs.limit(0), one).count() == 0


def test_kernel_against_sets():
    texts = ["Hello hello", "Größe 12", "a", "", "hola - ñ"]

    def grams(t):
        code = [int(language._CODE[b]) for b in t.lower().encode()]
        code = [c for k, c in enumerate(code) if k == 0 or c != 32 or code[k - 1] != 32]
        return {(p, *code[i : i + p]) for p in (1, 2, 3) for i in range(len(code) - p + 1)}

    samples = [("x" if k % 2 else "y", np.unique(language.cells_of(np.frombuffer(t.lower().encode(), np.uint8)))) for k, t in enumerate(texts)]
    model = language.fit(samples, landmarks=5)
    model.weights = np.eye(5)
    order = [0, 1, 2, 3, 4]
    got = model.scores([np.frombuffer(t.lower().encode(), np.uint8) for t in texts])
    sets = [grams(t) for t in texts]
    turn = sorted(order, key=lambda k: (k // 2, "x" if k % 2 else "y"))
    for i in range(5):
        for j, k in enumerate(turn):
            want = len(sets[i] & sets[k]) / np.sqrt(max(1, len(sets[i])) * max(1, len(sets[k])))
            assert got[i, j] == pytest.approx(want, abs=1e-6)


def grams_of(text):
    code = [b if 97 <= b <= 122 or b >= 0x80 else 32 for b in text.lower().encode()]
    code = [c for k, c in enumerate(code) if k == 0 or c != 32 or code[k - 1] != 32]
    return {(p, *code[i : i + p]) for p in (1, 2, 3) for i in range(len(code) - p + 1)}


def test_language_against_sets(spark):
    """The query's predictions by set intersections with each landmark."""
    docs = table(spark, SF, "documents")
    model = language.train(docs)
    named = {}
    for cell, column in zip(model.cells.tolist(), model.landmarks, strict=True):
        p = 1 if cell < 1 << 8 else 2 if cell < (1 << 8) + (1 << 16) else 3
        cell -= sum(1 << (8 * q) for q in range(1, p))
        gram = (p, *[(cell >> (8 * (p - 1 - i))) & 255 for i in range(p)])
        for k in np.flatnonzero(column):
            named.setdefault(int(k), set()).add(gram)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in language.predict(docs, model).collect():
        mine = grams_of(texts[r.doc_id])
        kernel = [len(mine & named[k]) / np.sqrt(max(1, len(mine)) * len(named[k])) for k in range(len(named))]
        values = np.array(kernel) @ model.weights
        if not any(c.isalpha() for c in texts[r.doc_id]):
            assert r.lang_pred == "und"
            continue
        assert values[model.languages.index(r.lang_pred)] == pytest.approx(values.max(), abs=1e-4)
        assert r.score == pytest.approx(min(1, max(0, (values.max() + 1) / 2)), abs=1e-4)


def test_cells_of_long_texts(monkeypatch):
    draw = np.random.default_rng(9)
    for _ in range(100):
        data = np.frombuffer("".join(draw.choice([*"aé  .B"], 60)).lower().encode(), np.uint8)
        monkeypatch.setattr(language, "PIECE", 1 << 20)
        whole = language.cells_of(data)
        monkeypatch.setattr(language, "PIECE", int(draw.integers(1, 9)))
        assert whole.tolist() == language.cells_of(data).tolist()


def test_language_on_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got if r.held_out]) > 0.95
    assert all(0 <= r.score <= 1 and r.held_out == held(r.doc_id) for r in got)


def test_language_of_odd_rows(spark):
    a, b, c = [i for i in range(10, 60) if not held(i)][:3]
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 ..!", None), (a, "the", "en"), (a, "the", "en"), (None, "le", "fr"), (b, "le la " * 30_000, "fr"), (c, "der", None), (61, "x" * 3_000_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("own"))
    got = language.identify(docs).collect()
    assert len(got) == 9
    assert all((r.lang_pred == "und") == (r.doc_id in (1, 2, 3)) for r in got)
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0
