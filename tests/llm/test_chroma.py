import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attesta.llm import chroma, queries


def tune(draw, notes):
    return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (n / 12) * np.arange(256) / chroma.RATE) for n in draw.integers(0, 12, notes)]).astype(np.float32)


def test_integral_image_against_sums():
    draw = np.random.default_rng(1)
    image = draw.random((40, 12))
    got = chroma.integers(image)
    assert len(got) == 40 - 16 + 1
    for t in (0, 7, 24):
        want = 0
        for kind, y, h, w in chroma.FILTERS:
            box = image[t : t + w, y : y + h]
            part = {0: box[:, : h // 2], 1: box[: w // 2], 3: box[:, h // 4 : h - h // 4], 4: box[w // 4 : w - w // 4]}
            a = box[: w // 2, : h // 2].sum() + box[w // 2 :, h // 2 :].sum() if kind == 2 else part[kind].sum()
            r = np.log((1 + a) / (1 + box.sum() - a))
            want = want << 2 | [0, 1, 3, 2][int(r >= -chroma.CUT) + int(r >= 0) + int(r >= chroma.CUT)]
        assert int(got[t]) == want


def brute(prints):
    """Best alignment of every pair by the share of differing bits."""
    out = {}
    for q in prints:
        for r in prints:
            if q % 50 or q == r or not len(prints[q]) or not len(prints[r]):
                continue
            best = (1.0, 0, 0)
            for off in range(-len(prints[q]) + chroma.OVERLAP, len(prints[r]) - chroma.OVERLAP + 1):
                a = prints[q][max(0, -off) :]
                b = prints[r][max(0, off) :]
                n = min(len(a), len(b))
                if n >= chroma.OVERLAP:
                    best = min(best, (float(np.bitwise_count(a[:n] ^ b[:n]).sum()) / (32 * n), off, n))
            if best[0] <= chroma.ERRORS:
                out[q, r] = best
    return out


def test_align_against_all_offsets(spark):
    draw = np.random.default_rng(4)
    tunes = {}
    for k in range(0, 300, 50):
        base = tune(draw, 60)
        tunes[k] = base
        tunes[k + 1] = base[128 * 20 :] + draw.normal(0, 0.02, len(base) - 128 * 20).astype(np.float32)
        tunes[k + 2] = np.concatenate([tune(draw, 10), base[:9000]])
        tunes[k + 3] = tune(draw, 60)
        tunes[k + 4] = base
    rows = [(i, (x / 2 * 32000).astype("<i2").tobytes()) for i, x in tunes.items()]
    rows += [(900, None), (901, b""), (902, b"\0" * 9000), (904, b"\0" * 30_000), (904, b"\0" * 30_000), (None, rows[0][1]), (905, b"\1")]
    df = spark.createDataFrame(rows, "rec_id long, audio binary").withColumn("id", F.lit("own")).withColumn("fp", F.lit(1))
    got = chroma.align(df, "rec_id", "audio").collect()
    prints = {i: chroma.fingerprint(chroma.pcm16(a)) for i, a in rows if i is not None}
    members = [r for r in got if r.kind == "member"]
    assert len(members) == len(rows)
    assert all(r.match_id == 0 for r in members if r.rec_id is None or r.rec_id in (0, 4))
    distinct = {i: p for i, p in prints.items() if not any(j < i and np.array_equal(p, prints[j]) for j in prints)}
    want = brute(distinct)
    found = {(r.rec_id, r.match_id): (r.offset, r.bit_error) for r in got if r.kind == "match"}
    assert len(want) >= 12
    tuned = {k for k in want if k[0] < 900 and k[1] < 900}
    assert len(tuned & set(found)) / len(tuned) >= 0.9
    for pair in tuned & set(found):
        assert found[pair] == (want[pair][1], want[pair][0])
    assert set(found) <= set(want)
    assert chroma.align(df.limit(0), "rec_id", "audio").count() == 0


@pytest.mark.parametrize("crowd", [4096, 8, None])
def test_recall_by_noise(spark, crowd):
    """Cuts of recordings under noise of all strengths, against all offsets; few landmarks
    may meet with a small ``crowd``, and the longer ones must make up for it."""
    draw = np.random.default_rng(8)
    prints = {}
    for k in range(0, 3000, 50):
        base = chroma.tones(draw.normal(size=64).tolist())
        cut = base[128 * int(draw.integers(20)) :][: 128 * int(draw.integers(60, 110))]
        prints[k] = chroma.fingerprint(base)
        prints[k + 1] = chroma.fingerprint(cut + draw.choice([0.02, 0.1, 0.2, 0.3]) * draw.normal(size=len(cut)).astype(np.float32))
    df = spark.createDataFrame([(i, p.view(np.int32).tolist()) for i, p in prints.items()], "id long, fp array<int>")
    want = {(k, k + 1): x for k in range(0, 3000, 50) if (x := brute({k: prints[k], k + 1: prints[k + 1]}).get((k, k + 1)))}
    got = {(r.query, r.id): (r.bit_error, r.offset, r.overlap) for r in chroma.match(df, df.filter("id % 50 = 0"), crowd=crowd).collect()}
    assert len(want) > 35 and set(got) <= set(want)
    assert len(got) / len(want) >= 0.9
    assert sum(got[p] == want[p] for p in got) / len(got) > 0.95


@pytest.mark.parametrize("crowd", [1 << 16, 200, None])
def test_every_match_against_all_offsets(spark, crowd):
    """Matches without one equal integer, with integers that all recordings share, with
    equal integers in a row, and with repeats that crowd another offset: none is lost."""
    draw = np.random.default_rng(12)
    common = draw.integers(0, 1 << 32, 30, dtype=np.uint32)

    def noised(print_, most):
        out = print_.copy()
        for k in range(len(out)):
            for bit in draw.choice(32, draw.integers(0, most + 1) if most > 2 else most, replace=False):
                out[k] ^= np.uint32(1 << bit)
        return out

    prints = {}
    for k in range(0, 1000, 50):
        base = draw.integers(0, 1 << 32, draw.integers(40, 90), dtype=np.uint32)
        base[5:9] = base[5]
        prints[k] = base
        prints[k + 1] = noised(base[draw.integers(12) :], 2)
        prints[k + 2] = noised(np.concatenate([base[8:], base[:30]]), 5)
        prints[k + 3] = np.concatenate([noised(common[:8], 1), base[10:34], common[8:]])
        prints[k + 4] = noised(base[-24:], 4)
    for k in range(1001, 1200):
        prints[k] = np.concatenate([common[:12], draw.integers(0, 1 << 32, 30, dtype=np.uint32)])
    prints[1250], prints[1201] = np.full(300, 7, np.uint32), np.concatenate([np.full(90, 5, np.uint32), common])
    rows = [(i, p.view(np.int32).tolist()) for i, p in prints.items()]
    df = spark.createDataFrame(rows, "id long, fp array<int>").repartition(4)
    want = brute(prints)
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesced, "false")
    found = chroma.match(df, df.filter("id % 50 = 0"), crowd=crowd).collect()
    spark.conf.unset(coalesced)
    assert len(want) > 50 and {(r.query, r.id): (r.bit_error, r.offset, r.overlap) for r in found} == want
    assert len(found) == len(want)
    assert sum(not np.any(prints[q][max(0, -o) :][:n] == prints[i][max(0, o) :][:n]) for (q, i), (_, o, n) in want.items()) >= 15


def test_landmarks_are_compared_in_parts(spark, monkeypatch):
    draw = np.random.default_rng(2)
    prints = [draw.integers(0, 4, 60).astype(np.int32) for _ in range(6)]
    blocks = [chroma._Block(pa.chunked_array([pa.array(prints[a:b], pa.list_(pa.int32()))])) for a, b in ((0, 3), (3, 6))]
    whole = {x for part in chroma._votes(*blocks) for x in zip(*(v.tolist() for v in part), strict=True)}
    monkeypatch.setattr(chroma, "AT_ONCE", 7)
    parts = [x for part in chroma._votes(*blocks) for x in zip(*(v.tolist() for v in part), strict=True)]
    assert len(whole) > 100 and len(parts) == len(whole) and set(parts) == whole


def test_ids_that_are_text(spark):
    base = chroma.tones(np.random.default_rng(1).normal(size=64).tolist())
    rows = [(f"r{i}", chroma.fingerprint(base[128 * i :]).view(np.int32).tolist()) for i in range(4)]
    df = spark.createDataFrame([(i, (base[128 * k :] * 9000).astype("<i2").tobytes()) for k, (i, _) in enumerate(rows)], "rec string, audio binary")
    got = chroma.align(df, "rec", "audio", step=1).filter("kind = 'match'").collect()
    assert {(r.rec, r.match_id) for r in got} == {(a, b) for a, _ in rows for b, _ in rows if a != b}


def test_vectors_of_odd_values():
    assert len(chroma.tones(None)) == len(chroma.tones([])) == 0
    assert len(chroma.fingerprint(chroma.tones([1.0, None, float("nan")] * 20))) > 0


def test_query_against_all_offsets(spark):
    """The registered recordings, a fifth of which are noised cuts of their neighbours."""
    folder = "/root/testdata/sf0.01"
    media = {r.vec_id: r.media.asDict() for r in queries.recordings(spark, folder).collect()}
    prints = {i: chroma.fingerprint(chroma.cut_or_own(m)) for i, m in media.items()}
    assert len(prints) == spark.read.parquet(f"{folder}/embeddings.parquet").count()
    want = brute(prints)
    rows = queries.op7_chroma(spark, folder).collect()
    got = {(r.vec_id, r.match_id): (r.bit_error, r.offset, r.overlap) for r in rows if r.kind == "match"}
    assert sum(r.kind == "member" for r in rows) == len(prints)
    assert len(want) >= 5 and all(b == a + 1 for a, b in want)
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert sum(got[p] == want[p] for p in got) >= 0.95 * len(got)


def test_cuts_of_odd_media():
    assert len(chroma.cut_or_own({"seed": 1, "embedding": None, "before": None})) == 0
    assert len(chroma.cut_or_own({"seed": None, "embedding": [1.0], "before": []})) == 0
    assert len(chroma.cut_or_own({"seed": -3, "embedding": None, "before": [1.0, float("nan")] * 40})) > 0
