"""SimHash near-duplicates by covering locality-sensitive hashing.

Equal fingerprints are one vertex. A random code gives each of the 64 bits a vector of
``radius + 1`` bits; table ``v`` keeps the bits whose vector has an odd product with
``v``. At most ``radius`` differing bits span less than the whole space, so a non-zero
``v`` is orthogonal to all of them: every pair within the radius shares the key of one
of the ``2 ** (radius + 1) - 1`` tables, for any code.

Keys with one fingerprint end there, keys with two are compared in the JVM. Larger
buckets are split into blocks of ``BLOCK`` fingerprints by a salt; each pair of blocks
is one group of bounded size that emits a spanning forest of its links, so a crowd of
near copies never leaves as all its pairs, and no bucket meets in one task. Components
come from alternating large-star and small-star rounds.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import cut, map_batches, trimmed

#: Fingerprints of a bucket that are compared in one group.
BLOCK = 1024
#: A class with over this share of the rows is hot; there are at most as many as 1 / HOT.
HOT = 1 / 256
#: Edges of a part of a round's table.
EDGES = 1 << 16
RADIUS = 4
SHINGLE = 4

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def bit_majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of ``hashes``."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    edges = np.arange(0, n, 255)
    for k, column in enumerate(hashes.view(np.uint8).reshape(n, 8).T):
        lanes = np.add.reduceat(_SPREAD[column], edges)  # eight byte lanes, at most 255 each
        counts[8 * k : 8 * k + 8] = lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of a whole text; zero without words."""
    words = (text or "").encode("utf-8", "replace").translate(_FOLD).split(None)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=False)]
    return bit_majority(np.array(found, np.uint64))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp bigint) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([simhash(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
        return pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), run, f"`{id_col}` {kind}, fp long")


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """The bit masks of the tables, as signed 64-bit numbers."""
    draw = random.Random(seed)
    width = radius + 1
    # Non-zero vectors in shuffled turns keep the masks near 32 bits each.
    codes: list[int] = []
    while len(codes) < 64:
        turn = [*range(1, 1 << width)]
        draw.shuffle(turn)
        codes += turn
    masks = []
    for v in range(1, 1 << width):
        mask = sum(1 << i for i, code in enumerate(codes[:64]) if (code & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _close(a: Column, b: Column, radius: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def _forest(values: np.ndarray, left: int, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among ``values``; with ``left`` of them in the first
    of two blocks, only links between the blocks count, and 0 means one block."""
    label = np.arange(len(values))
    out = []
    for i in range(left or len(values) - 1):
        begin = left or i + 1
        near = np.flatnonzero(np.bitwise_count(values[begin:] ^ values[i]) <= radius) + begin
        near = near[label[near] != label[i]]
        while len(near):
            j = int(near[0])
            label[label == label[j]] = label[i]
            out.append((i, j))
            near = near[label[near] != label[i]]
    return out


def links(vertices: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b) edges between distinct fingerprints ``fp`` within the radius: enough of
    them that their components are those of all links."""
    masks = F.array(*[F.lit(m).cast("long") for m in covering_masks(radius)])
    keyed = vertices.select("fp", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("t", "key"))
    buckets = keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    buckets = cut(buckets)
    pairs = buckets.filter("n = 2").select("a", "b").filter(_close(F.col("a"), F.col("b"), radius))

    blocks = F.ceil(F.col("n") / block).cast("int")
    crowded = keyed.join(buckets.filter("n > 2").select("t", "key", "n"), ["t", "key"])
    crowded = crowded.withColumn("salt", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
    others = F.sequence(F.lit(0), blocks - 1)
    # Block pair (low, high): each fingerprint goes to the pairs its block is in.
    dealt = crowded.select("t", "key", "fp", "salt", F.explode(others).alias("other"))
    dealt = dealt.select("t", "key", F.least("salt", "other").alias("low"), F.greatest("salt", "other").alias("high"), (F.col("salt") > F.col("other")).cast("int").alias("side"), "fp")
    sorted_groups = dealt.repartition("t", "key", "low", "high").sortWithinPartitions("t", "key", "low", "high", "side", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)], 1)
            if held is not None:
                rows = np.concatenate([held, rows])
            edge = np.flatnonzero(np.any(rows[1:, :4] != rows[:-1, :4], axis=1)) + 1
            bounds = [0, *edge.tolist()]
            held = rows[bounds[-1] :]
            yield _edges(rows, bounds, radius)
        if held is not None:
            yield _edges(held, [0, len(held)], radius)

    crowd = sorted_groups.mapInArrow(trimmed(run), "a long, b long")
    return pairs.unionByName(crowd).distinct()


def _edges(rows: np.ndarray, bounds: list[int], radius: int) -> pa.RecordBatch:
    a, b = [], []
    for start, end in zip(bounds, bounds[1:], strict=False):
        group = rows[start:end]
        between = group[0, 2] != group[0, 3]
        left = int((group[:, 4] == 0).sum()) if between else 0
        if between and (left == 0 or left == len(group)):
            continue
        values = np.ascontiguousarray(group[:, 5]).view(np.uint64)
        for i, j in _forest(values, left, radius):
            x, y = sorted((int(group[i, 5]), int(group[j, 5])))
            a.append(x)
            b.append(y)
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _stars(edges: DataFrame) -> tuple[bool, int]:
    """Whether no vertex of ``edges`` (u, v), u > v, has two vertices below it, or one below
    and one above; and the number of edges."""
    end = lambda name, below, above: F.struct(F.col(name).alias("vertex"), F.lit(below).alias("below"), F.lit(above).alias("above"))
    ends = edges.select(F.inline(F.array(end("u", 1, 0), end("v", 0, 1))))
    each = ends.groupBy("vertex").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    found = each.agg(F.count_if(F.col("below") + F.col("above") > 1).alias("open"), F.coalesce(F.sum("below"), F.lit(0)).alias("n")).first()
    return found.open == 0, found.n


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(vertex, root): the smallest vertex reachable, for every vertex of ``edges`` (a, b).
    Alternates large-star and small-star rounds until every component is a star, which a
    further round would leave as it is; each round is checkpointed, in as few parts as its
    edges need. Raises RuntimeError if ``rounds`` don't suffice."""
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        settled, n = _stars(edges)
        if settled:
            roots = edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
            return roots.unionByName(edges.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
        # Large star: neighbours above a vertex go to its smallest neighbour or itself.
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a vertex and its neighbours below go to the smallest of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        # A round never adds edges.
        edges = cut(small.distinct().coalesce(-(-n // EDGES)))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def name_components(vertices: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """(key, n, component_id) of every vertex (key, least, n): the smallest ``least`` of the
    vertices with its root in ``roots`` (key, root), its own without one."""
    linked = cut(vertices.join(roots, key).select(key, "least", "root"))
    # A table of its own, so that the join on root has plain exchanges that AQE can split.
    smallest = cut(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    labels = linked.join(smallest, "root").select(key, "component_id")
    return cut(vertices.join(labels, key, "left").select(key, "n", F.coalesce("component_id", "least").alias("component_id")))


def label_rows(rows: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """``rows`` with the component_id of their class in ``named`` (key, n, component_id).
    Rows of hot classes, which are few by the bound of ``HOT``, take it from a broadcast
    where they are; only the others are dealt out by their class."""
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") > total * HOT
    common = named.filter(hot).select(key, F.struct("component_id").alias("_hot"))
    met = rows.join(F.broadcast(common), key, "left")
    easy = met.filter("_hot IS NOT NULL").withColumn("component_id", F.col("_hot.component_id")).drop("_hot")
    return easy.unionByName(met.filter("_hot IS NULL").drop("_hot").join(named.filter(~hot).select(key, "component_id"), key))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(id, fp, fingerprint, component_id) of every row: documents whose fingerprints
    differ in at most ``radius`` bits are linked; component_id is the smallest id
    reachable. Null and empty texts have fingerprint zero and link like any other;
    repeated rows stay repeated; null ids keep their rows but never name a component
    unless it has no other id. Other columns are not read."""
    prints = cut(fingerprints(df, id_col, text_col, shingle))
    vertices = cut(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")))
    roots = components(links(vertices, radius, block))
    named = name_components(vertices, roots.withColumnRenamed("vertex", "fp"), "fp")
    return label_rows(prints, named, "fp").select(id_col, "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
