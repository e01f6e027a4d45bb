"""Prefix trie of conversations, its subtree totals gathered by leaf-peeling messages.

A node is a distinct sequence of first turns. It is named by a 128-bit key: the exclusive
or, over its turns, of two hashes of (place, role, text), so that keys of all prefixes are
running values and a parent's key is its child's without the last turn. Texts are hashed
and measured where they are read and never travel.

Totals of subtrees go up by messages. Every node belongs to the path of one of its members,
the one with the least hash of its id: a path runs from where its conversation leaves
another path down to the conversation's end, and is one vertex of the message passing. It
holds a counter of the paths that branch off it and haven't reported; when that is zero it
sends its total to the path it branches off, until only the root's path is left. As members
are chosen by a hash, a walk from any node to the root changes paths about log(members)
times, so a trie as deep as its longest conversation still takes few rounds. Running sums
along the paths then spread the totals to their nodes.

Long conversations and hot nodes: running values are scanned in two levels over a range
partitioning (``running``), counts combine on the map side, and the digest of a node's ids
reads blocks that were joined beforehand in parallel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.llm.common import cut

#: Ids joined into one block of a digest.
BLOCK = 4096
_NODE = ["depth", "a", "b"]


def running(df: DataFrame, key: str, order: list[Column], values: dict[str, Column], fold: str = "sum") -> DataFrame:
    """``df`` with running totals of ``values`` along ``order`` within ``key``, the row
    itself included. Rows are dealt by ranges of (key, order), so a key of any size is
    spread out; totals per key and range are scanned in turn. ``fold`` is sum or bit_xor.
    Rows that are equal in key and order must be equal in their values."""
    add = F.sum if fold == "sum" else F.bit_xor
    plus = (lambda a, b: a + b) if fold == "sum" else (lambda a, b: a.bitwiseXOR(b))
    dealt = cut(df.repartitionByRange(F.col(key), *order).withColumn("_range", F.spark_partition_id()))
    inside = W.partitionBy(key, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy(key, "_range").agg(*[add(v).alias(f"_{n}") for n, v in values.items()])
    totals = totals.select(key, "_range", *[F.coalesce(add(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in values])
    local = dealt.withColumns({n: add(v).over(inside) for n, v in values.items()})
    met = local.join(totals, [key, "_range"])
    return met.withColumns({n: plus(F.col(n), F.col(f"_{n}")) for n in values}).drop("_range", *[f"_{n}" for n in values])


def placed(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, one, two, size): the turns of each conversation, numbered from 1 by
    turn, null first, ties by the hashes ``one`` and ``two`` of role and text. ``size`` is
    the text's length in code points. Null roles and texts are empty; turns without a
    conversation's id are left out."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    hashes = [F.xxhash64(F.lit(i), role, text).alias(n) for i, n in enumerate(("one", "two"))]
    rows = df.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), *hashes, F.length(text).cast("long").alias("size"))
    order = [F.asc_nulls_first("turn"), F.asc("one"), F.asc("two")]
    return running(rows, "conv_id", order, {"place": F.lit(1)}).drop("turn")


def graft(rows: DataFrame, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on shared beginnings, (rows, conversations): conversation c
    starts with the first h turns of c - c % ``family``, h = crc32(c) % ``most``, and goes
    on with its own turns after its first h. Remainders of negative ids are negative, as in
    SQL."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = rows.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h.alias("h"))
    heads = rows.filter(F.col("place") < most).withColumnRenamed("conv_id", "base")
    starts = cut(convs.join(heads, "base").filter("place <= h").select("conv_id", "place", "one", "two", "size"))
    given = convs.join(starts.groupBy("conv_id").agg(F.max("place").alias("given")), "conv_id", "left").select("conv_id", "h", F.coalesce("given", F.lit(0)).alias("given"))
    own = rows.join(given, "conv_id").filter("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("given")).alias("place"), "one", "two", "size")
    return starts.unionByName(own), convs.select("conv_id")


def prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, last_a, last_b, size) of every prefix of every conversation,
    the empty one included: its node's key and the hashes and size of its last turn."""
    last = {f"last_{n}": F.xxhash64(F.lit(n), "place", "one", "two") for n in "ab"}
    keyed = running(rows.withColumns(last), "conv_id", [F.asc("place")], {n: F.col(f"last_{n}") for n in "ab"}, "bit_xor")
    columns = ["conv_id", F.col("place").cast("long").alias("depth"), "a", "b", "last_a", "last_b", "size"]
    zero = [F.lit(0).cast("long").alias(n) for n in ("depth", "a", "b", "last_a", "last_b", "size")]
    return cut(keyed.select(*columns).unionByName(convs.select("conv_id", *zero)))


def nodes(found: DataFrame) -> DataFrame:
    """(depth, a, b, conv_id, path, n_convs, size, n_children, parent_conv_id, parent_path)
    of every node; ``path`` is the member with the least hash of its id."""
    least = F.min(F.struct(F.xxhash64("conv_id"), "conv_id")).getField("conv_id")
    every = found.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), least.alias("path"), F.count("*").alias("n_convs"), F.max("size").alias("size"), *[F.max(f"last_{n}").alias(f"last_{n}") for n in "ab"])
    every = cut(every)
    upward = every.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), *[F.col(n).bitwiseXOR(F.col(f"last_{n}")).alias(n) for n in "ab"], *[F.col(n).alias(f"child_{n}") for n in "ab"])
    counts = upward.groupBy(*_NODE).agg(F.count("*").alias("n_children"))
    above = upward.join(every.select(*_NODE, F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("parent_path")), _NODE)
    above = above.select((F.col("depth") + 1).alias("depth"), F.col("child_a").alias("a"), F.col("child_b").alias("b"), "parent_conv_id", "parent_path")
    met = every.drop("last_a", "last_b").join(counts, _NODE, "left").join(above, _NODE, "left")
    return cut(met.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))


def peeled(every: DataFrame) -> DataFrame:
    """(path, depth, leaves, saved): the totals that finished paths sent, by the node they
    branch off. Each round is checkpointed."""
    own = [F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"), F.sum(_saved()).alias("saved")]
    top = F.min_by(F.struct(F.col("parent_path").alias("up"), (F.col("depth") - 1).alias("at")), "depth")
    paths = cut(every.groupBy("path").agg(top.alias("top"), *own).select("path", "top.up", "top.at", "leaves", "saved"))
    waiting = paths.filter("up IS NOT NULL").groupBy(F.col("up").alias("path")).agg(F.count("*").alias("left"))
    state = cut(paths.join(waiting, "path", "left").withColumn("left", F.coalesce("left", F.lit(0).cast("long"))))
    sent = []
    while True:
        done = state.filter("left = 0 AND up IS NOT NULL")
        sent.append(done.select(F.col("up").alias("path"), F.col("at").alias("depth"), "leaves", "saved"))
        if state.filter("left > 0").isEmpty():
            break
        news = done.groupBy(F.col("up").alias("path")).agg(F.count("*").alias("n"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
        met = state.filter("left > 0").join(news, "path", "left")
        state = cut(met.select("path", "up", "at", (F.col("left") - F.coalesce("n", F.lit(0))).alias("left"), add("leaves", "more_leaves").alias("leaves"), add("saved", "more_saved").alias("saved")))
    out = sent[0]
    for part in sent[1:]:
        out = out.unionByName(part)
    return out.groupBy("path", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _saved() -> Column:
    return (F.col("n_convs") - 1) * F.col("size")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
    """((depth, a, b), rows so far of one node and batch): runs of equal nodes."""
    for batch in batches:
        rows = batch.to_pydict()
        keys = list(zip(*[rows[n] for n in _NODE], strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                yield keys[start], rows["value"][start:i]
                start = i


def digests_of_ends(found: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the nodes where conversations end: SHA-256 of their
    ids, ascending, comma-joined. Ranges of sorted ids are joined into blocks first, and a
    node's blocks are hashed one by one, so nothing of a hot node is held."""
    ends = found.groupBy("conv_id").agg(F.max(F.struct(*_NODE)).alias("end")).select("end.*", "conv_id")
    dealt = ends.repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id").select(*_NODE, F.col("conv_id").alias("value"))

    def batch(rows: list[tuple], last: tuple[str, pa.DataType]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        types = [pa.int64()] * 4 if last[0] == "value" else [pa.int64()] * 3
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [*types, last[1]], strict=False)], names=[*_NODE, *(["first"] if last[0] == "value" else []), last[0]])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key_rows in _grouped(batches):
            key, ids = key_rows
            yield batch([(*key, ids[i], ",".join(map(str, ids[i : i + BLOCK]))) for i in range(0, len(ids), BLOCK)], ("value", pa.string()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, out = None, None, []
        for key, texts in _grouped(batches):
            if key != at:
                if at is not None:
                    out.append((*at, digest.hexdigest()))
                at, digest = key, hashlib.sha256()
                digest.update(texts[0].encode())
                texts = texts[1:]
            for text in texts:
                digest.update(b"," + text.encode())
            if len(out) >= BLOCK:
                yield batch(out, ("ends_sha256", pa.string()))
                out = []
        if at is not None:
            yield batch([*out, (*at, digest.hexdigest())], ("ends_sha256", pa.string()))

    blocks = dealt.mapInArrow(joined, "depth long, a long, b long, first long, value string")
    sorted_blocks = blocks.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").select(*_NODE, "value")
    return sorted_blocks.mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256) of every node of the trie of the conversations ``convs`` (conv_id) with
    the numbered turns ``rows`` (of ``placed`` or ``graft``). Conversations without turns
    are members of the root alone. No conversations give no nodes."""
    found = prefixes(rows, convs)
    every = nodes(found)
    sent = peeled(every)
    met = every.join(sent, ["path", "depth"], "left")
    met = met.withColumns({"_leaves": (F.col("n_children") == 0).cast("long") + F.coalesce("leaves", F.lit(0)), "_saved": _saved() + F.coalesce("saved", F.lit(0))}).drop("leaves", "saved")
    totals = running(met, "path", [F.desc("depth")], {"n_leaves": F.col("_leaves"), "saved_tokens": F.col("_saved")})
    empty = hashlib.sha256(b"").hexdigest()
    whole = totals.join(digests_of_ends(found), _NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty)))
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
