"""Near copies by the Jaccard similarity of their word shingles.

Equal shingle sets are one vertex. Minima of ``BANDS * ROWS`` hash functions over a set
are joined to ``BANDS`` keys; two sets of similarity ``s`` share a key with probability
``1 - (1 - s ** ROWS) ** BANDS``, which is 0.999993 at 0.8. A SimHash can't do this job:
at 0.8 about ten of 64 bits differ, and tables that cover as many bits are thousands.

Sets that meet under a key are compared exactly. Keys with the same members count once;
larger groups are split into blocks by a salt, and each pair of blocks emits a spanning
forest of its links, as in ``simhash``.

With a ``radius``, texts whose SimHash fingerprints differ in at most so many bits are
linked too, by ``simhash.links``, and groups are those of both kinds of links. Fingerprints
weigh shingles by their number, so they link texts whose sets are not similar.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import cut, slices, trimmed
from attesta.llm.simhash import _FOLD, components, label_rows, name_components, simhash
from attesta.llm.simhash import links as fingerprint_links

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 5
#: Sets of a group that are compared in one task.
BLOCK = 1024

_DRAW = random.Random(23)
_TURN = np.array([_DRAW.getrandbits(64) for _ in range(BANDS * ROWS)], np.uint64)[:, None]
_FACTOR = np.array([_DRAW.getrandbits(64) | 1 for _ in range(BANDS * ROWS)], np.uint64)[:, None]
#: Shingles whose hashes are held at once.
_PART = 4096
#: Bytes of text whose sets are held at once; a text counts whole.
AT_ONCE = 2 << 20


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; a text of fewer words
    is one shingle, and one without words has none."""
    words = (text or "").encode("utf-8", "replace").translate(_FOLD).split(None)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    last = ends[size - 1 :].tolist() or [len(joined)]
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), last, strict=False)], np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The ``BANDS`` keys of a set of shingles; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.min([((hashes[i : i + _PART] ^ _TURN) * _FACTOR).min(1) for i in range(0, len(hashes), _PART)], axis=0)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), 42) for band in least.reshape(BANDS, ROWS)], np.uint64)


def _vertex(hashes: np.ndarray) -> int:
    """The number of a set of shingles, as a signed one."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 42)).view(np.int64))


def _sketches(df: DataFrame, id_col: str, text_col: str, printed: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, AT_ONCE) if batch.num_rows else ():
                sets = [shingles(t.as_py()) for t in part.column(1)]
                keys = pa.array([band_keys(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
                prints = np.array([simhash(t.as_py()) if printed else 0 for t in part.column(1)], np.uint64).view(np.int64)
                yield pa.record_batch([part.column(0), part.column(2), pa.array(map(_vertex, sets), pa.int64()), keys, pa.array(prints)], names=[id_col, "text_hash", "vertex", "keys", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(id_col, text_col, F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(trimmed(run), f"`{id_col}` {kind}, text_hash long, vertex long, keys array<long>, fp long")


def _sets(df: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(vertex, hashes) of the sets in ``wanted`` and of a few others: a bit map of bounded
    size tells most others apart before anything is exchanged."""
    bits = 1 << min(27, max(15, (16 * wanted.count()).bit_length()))
    at = F.col("vertex").bitwiseAND(F.lit(bits - 1))
    maps = wanted.groupBy(F.shiftright(at, 15).alias("bucket")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    filled = np.zeros(bits >> 3, np.uint8)
    for r in maps:
        filled[r.bucket << 12 : (r.bucket + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(filled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shared.value, set()
        for batch in batches:
            for part in slices(batch, 0, AT_ONCE) if batch.num_rows else ():
                found = {}
                for text in part.column(0):
                    hashes = shingles(text.as_py())
                    v = _vertex(hashes)
                    place = v & (bits - 1)
                    if known[place >> 3] >> (place & 7) & 1 and v not in seen:
                        seen.add(v)
                        found[v] = hashes.view(np.int64)
                yield pa.record_batch([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.list_(pa.int64()))], names=["vertex", "hashes"])

    return df.select(text_col).mapInArrow(trimmed(run), "vertex long, hashes array<long>").groupBy("vertex").agg(F.first("hashes").alias("hashes"))


def _forest(sets: list[np.ndarray], left: int, similarity: float) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of ``sets`` with at least ``similarity``; with ``left``
    of them in the first of two blocks, only pairs between the blocks count."""
    sizes = np.array([*map(len, sets)])
    starts = np.cumsum(sizes) - sizes
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    label = np.arange(len(sets))
    mark = np.zeros(len(values), bool)
    out = []
    for i in range(left or len(sets) - 1):
        begin = left or i + 1
        fits = (np.minimum(sizes[begin:], sizes[i]) >= similarity * np.maximum(sizes[begin:], sizes[i]) - 1e-9) & (label[begin:] != label[i])
        others = np.flatnonzero(fits) + begin
        if not len(others):
            continue
        own = flat[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        if len(others) < 64:
            common = np.array([int(mark[flat[starts[j] : starts[j] + sizes[j]]].sum()) for j in others])
        else:
            common = np.add.reduceat(mark[flat], starts, dtype=np.int64)[others]
        mark[own] = False
        near = others[common >= similarity * (sizes[i] + sizes[others] - common) - 1e-9]
        for j in near.tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def links(df: DataFrame, vertices: DataFrame, text_col: str = "text", similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(a, b) edges between ``vertices`` (vertex, keys) of the texts of ``df`` that have at
    least ``similarity`` and share a key: enough of them that their components are those
    of all such pairs."""
    keyed = vertices.select("vertex", F.posexplode("keys").alias("t", "key"))
    met = keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.bit_xor("vertex").alias("x")).filter("n > 1")
    groups = cut(met.groupBy("n", "x").agg(F.min(F.struct("t", "key")).alias("g")).select("n", "g.t", "g.key"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    members = keyed.join(groups, ["t", "key"]).withColumn("salt", F.pmod(F.xxhash64("vertex"), blocks).cast("int"))
    # Block pair (low, high): each set goes to the pairs its block is in.
    dealt = members.select("t", "key", "vertex", "salt", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = cut(dealt.select("t", "key", F.least("salt", "other").alias("low"), F.greatest("salt", "other").alias("high"), (F.col("salt") > F.col("other")).cast("int").alias("side"), "vertex"))
    sets = _sets(df, text_col, cut(dealt.select("vertex").distinct()))
    order = ["t", "key", "low", "high"]
    ready = dealt.join(sets, "vertex").select(*order, "side", "vertex", "hashes").repartition(*order).sortWithinPartitions(*order, "side", "vertex")

    def edges(table: pa.Table) -> pa.RecordBatch:
        low, high, side, vertex = (table.column(k).to_numpy() for k in (2, 3, 4, 5))
        left = int((side == 0).sum()) if low[0] != high[0] else 0
        found = []
        if low[0] == high[0] or 0 < left < len(vertex):
            found = _forest([s.values.to_numpy() for s in table.column(6)], left, similarity)
        pairs = [sorted((int(vertex[i]), int(vertex[j]))) for i, j in found]
        return pa.record_batch([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)], 1)
            bounds = [0, *(np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1).tolist(), len(keys)]
            for start, end in zip(bounds, bounds[1:], strict=False):
                if held and tuple(keys[start]) != at:
                    yield edges(pa.Table.from_batches(held))
                    held = []
                at = tuple(keys[start])
                held.append(batch.slice(start, end - start))
        if held:
            yield edges(pa.Table.from_batches(held))

    return ready.mapInArrow(trimmed(run), "a long, b long").distinct()


def _by_fingerprint(sketches: DataFrame, radius: int, block: int) -> DataFrame:
    """(a, b) edges between vertices of ``sketches`` (vertex, fp): each fingerprint stands at
    its least vertex, is linked with its others, and with those of fingerprints near it."""
    met = cut(sketches.select("vertex", "fp").distinct())
    least = cut(met.groupBy("fp").agg(F.min("vertex").alias("at"), F.count("*").alias("n")))
    same = met.join(least.filter("n > 1"), "fp").filter("vertex <> at").select(F.col("vertex").alias("a"), F.col("at").alias("b"))
    near = fingerprint_links(least.select("fp"), radius, block)
    ends = near.join(least.select(F.col("fp").alias("a"), F.col("at").alias("u")), "a").join(least.select(F.col("fp").alias("b"), F.col("at").alias("v")), "b")
    return same.unionByName(ends.select(F.col("u").alias("a"), F.col("v").alias("b")))


def groups_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, block: int = BLOCK, radius: int | None = None) -> DataFrame:
    """(id, text_hash, component_id) of every row: texts whose sets of five-word shingles have a
    Jaccard similarity of at least ``similarity`` are linked, and with a ``radius`` those whose
    fingerprints differ in at most so many bits; component_id is the smallest
    id reachable and text_hash is Spark's xxhash64 of the text. Null and empty texts are copies of each other; repeated rows stay
    repeated; null ids never name a component unless it has no other id."""
    sketches = cut(_sketches(df, id_col, text_col, radius is not None))
    vertices = cut(sketches.groupBy("vertex").agg(F.min(id_col).alias("least"), F.count("*").alias("n"), F.first("keys").alias("keys")))
    edges = links(df, vertices, text_col, similarity, block)
    if radius is not None:
        edges = edges.unionByName(_by_fingerprint(sketches, radius, block))
    named = name_components(vertices.drop("keys"), components(edges), "vertex")
    return label_rows(sketches.select(id_col, "text_hash", "vertex"), named, "vertex").select(id_col, "text_hash", "component_id")
