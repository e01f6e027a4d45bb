"""Approximate nearest neighbours by a permutation index.

``PIVOTS`` vectors are drawn from the table; every vector is represented by its ``PREFIX``
nearest pivots in order. The rows are dealt into shards, and a shard posts its rows in one
inverted file per pivot: (row, place of the pivot in the row's order). A query walks the
files of its own nearest pivots and adds up, per row, ``PREFIX - max(own place, place)``.
With absent pivots at place ``PREFIX`` the footrule distance of two orders is twice
``PREFIX * (PREFIX + 1) / 2`` less that sum, so the largest sums are the smallest footrule
distances. The best ``SHARE`` of each shard, at least ``LEAST`` rows, are ranked again by
their exact distance, and the best ``k`` of every shard meet per query.

The pivots are the only thing that is fitted, on a sample of ``SAMPLE`` different vectors
by a hash of the vector. Queries are broadcast in blocks of ``BLOCK_BYTES``, each of which
meets the whole index once. The number of shards grows with the square root of the rows,
so that neither a shard nor the candidates per query grow with the table in proportion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import cut

PIVOTS = 256
#: Different vectors that pivots are drawn from, and their bytes at most.
SAMPLE = 4096
SAMPLE_BYTES = 32 << 20
#: Nearest pivots that represent a vector.
PREFIX = 128
#: Part of a shard that is ranked by exact distance, and the least number of rows.
SHARE = 0.06
LEAST = 64
#: Bytes of query vectors that are broadcast at once.
BLOCK_BYTES = 16 << 20
#: Shards per square root of the rows.
SPREAD = 0.125

_INDEX = "shard int, row long, id long, vec array<double>, nearest binary"
_FOUND = "row long, query_id long, vec_id long, score double"


def usable(vec: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(row, id, vec) of the rows that take part: a usable vector of the table's commonest
    length (the longer one of equally common lengths) and an id that isn't null. ``row``
    tells repeated rows apart."""
    fine = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(usable(F.col("vec")) & F.col("id").isNotNull())
    fine = cut(fine.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "vec"))
    common = fine.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return fine.filter(F.size("vec") == (common["size"] if common else 0))


def draw_pivots(rows: DataFrame, dim: int, pivots: int = PIVOTS) -> np.ndarray:
    """At most ``pivots`` different vectors out of a sample of ``SAMPLE``, those with the
    least hashes, or fewer long ones. Each next pivot is drawn with chances as its squared
    distance to the pivots so far, so that a crowd of near copies gets few of them."""
    hashed = rows.select("vec", F.xxhash64("vec").alias("hash"))
    size = max(pivots, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    least = [r["hash"] for r in hashed.select("hash").distinct().orderBy("hash").limit(size).collect()]
    sample = np.array([r["vec"] for r in hashed.filter(F.col("hash").isin(least)).dropDuplicates(["hash"]).orderBy("hash").collect()], np.float64)
    draw, chosen, far = np.random.default_rng(0), [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < pivots and far.any():
        chosen.append(int(draw.choice(len(sample), p=far / far.sum())))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def index(rows: DataFrame, pivots: np.ndarray, prefix: int, shards: int) -> DataFrame:
    """The rows dealt into shards by a hash, with their nearest pivots in order (16 bits
    each), as a table in the checkpoint folder."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        norms = (centres**2).sum(1)
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                vec = _matrix(part.column(3))
                order = np.argsort(norms - 2 * vec @ centres.T, axis=1, kind="stable")[:, :prefix].astype(np.uint16)
                yield pa.record_batch([*part.columns, pa.array([r.tobytes() for r in order], pa.binary())], names=[*part.schema.names, "nearest"])

    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")
    posted = rows.select(shard, "row", "id", "vec").mapInArrow(run, _INDEX)
    return cut(posted.repartition(shards, "shard").sortWithinPartitions("shard", "id", "row"))


class Shard:
    """The rows of a shard in order of their ids, and one inverted file per pivot."""

    def __init__(self, batches: list[pa.RecordBatch], n_pivots: int) -> None:
        table = pa.Table.from_batches(batches)
        self.row, self.id = table["row"].to_numpy(), table["id"].to_numpy()
        self.vec = np.concatenate([_matrix(c) for c in table["vec"].chunks])
        near = np.array([np.frombuffer(x, np.uint16) for x in table["nearest"].to_pylist()])
        self.prefix = near.shape[1]
        order = np.argsort(near.ravel(), kind="stable")
        self.bounds = np.searchsorted(near.ravel()[order], np.arange(n_pivots + 1))
        self.rows, self.places = order // self.prefix, (order % self.prefix).astype(np.int32)

    def closest(self, nearest: np.ndarray, keep: int) -> np.ndarray:
        """The ``keep`` rows with the smallest footrule distance to the order ``nearest``;
        of equal ones those with the smaller ids, as rows stand in order of their ids."""
        n = len(self.id)
        if keep >= n:
            return np.arange(n)
        common = np.zeros(n, np.int32)
        for place, pivot in enumerate(nearest):
            posted = slice(self.bounds[pivot], self.bounds[pivot + 1])
            common[self.rows[posted]] += self.prefix - np.maximum(self.places[posted], place)
        worth = common.astype(np.int64) * n - np.arange(n)
        return np.argpartition(-worth, keep - 1)[:keep]


def _search(shard: Shard, queries: tuple, k: int, share: float, least: int) -> pa.RecordBatch:
    rows, ids, vecs, nearest = queries
    keep = max(least, int(np.ceil(share * len(shard.id))))
    out: list[list] = [[], [], [], []]
    for row, qid, vec, near in zip(rows, ids, vecs, nearest, strict=True):
        near_rows = shard.closest(near, keep)
        near_rows = near_rows[shard.row[near_rows] != row]
        score = np.sqrt(((shard.vec[near_rows] - vec) ** 2).sum(1))
        best = np.lexsort((shard.id[near_rows], score))[:k]
        for column, values in zip(out, (np.full(len(best), row), np.full(len(best), qid), shard.id[near_rows][best], score[best]), strict=True):
            column.append(values)
    return pa.record_batch([pa.array(np.concatenate(x) if x else []).cast(t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["row", "query_id", "vec_id", "score"])


def _against(indexed: DataFrame, block: DataFrame, n_pivots: int, k: int, share: float, least: int) -> DataFrame:
    """The best ``k`` rows of every shard for each query of one bounded block."""
    held = block.select("row", "id", "vec", "nearest").toArrow()
    near = np.array([np.frombuffer(x, np.uint16) for x in held["nearest"].to_pylist()])
    vecs = np.concatenate([_matrix(c) for c in held["vec"].chunks if len(c)] or [np.zeros((0, 0))])
    sent = indexed.sparkSession.sparkContext.broadcast((held["row"].to_numpy(), held["id"].to_numpy(), vecs, near))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for start, end in zip(edges, edges[1:], strict=False):
                if open_ and open_[-1].column(0)[0] != batch.column(0)[start]:
                    yield _search(Shard(open_, n_pivots), sent.value, k, share, least)
                    open_ = []
                open_.append(batch.slice(start, end - start))
        if open_:
            yield _search(Shard(open_, n_pivots), sent.value, k, share, least)

    return indexed.mapInArrow(run, _FOUND)


def search(
    df: DataFrame,
    query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    pivots: int = PIVOTS,
    prefix: int = PREFIX,
    share: float = SHARE,
    least: int = LEAST,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose ``query`` (of column ``id``)
    holds, its ``k`` nearest other rows that were found, by Euclidean distance in double
    precision, ties to the smaller id.

    Null ids and unusable vectors (null, empty, zero, null or non-finite components, or of
    another length than most) take no part. A repeated row is a row of its own: it is a
    neighbour of its twin, and asks for itself. Fewer than ``k`` other rows give all of
    them; an empty table gives no rows. Other columns are not read."""
    spark = df.sparkSession
    rows = vectors(df, id_col, vec_col)
    total, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centres = draw_pivots(rows, dim, pivots)
    indexed = index(rows, centres, min(prefix, len(centres)), max(1, round(SPREAD * total**0.5)))
    asked = indexed.filter(query)
    blocks = max(1, -(-asked.count() * dim * 8 // block_bytes))
    found = None
    for i in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("row", F.lit("block")), F.lit(blocks)) == i)
        part = _against(indexed, block, len(centres), k, share, least)
        found = part if found is None else found.unionByName(part)
    by_query = found.groupBy("row", "query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
    ranked = by_query.select("query_id", F.posexplode("best").alias("place", "hit"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
