"""Equal and near-equal images, relationships between panels, and their groups."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names, or the one already set. Where
    neither is set, a local master gets a folder beside its warehouse; on a cluster it is an
    error, as executors must see one folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(path or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder (``checkpoint_dir``)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def exact_groups(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(digest, n, ids): contents that occur more than once."""
    digest = F.sha2(F.col(content_col), 256)
    groups = files.groupBy(digest.alias("digest")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"))
    return groups.filter("n > 1")


def signature(values: Column, bits: int = 63) -> Column:
    """Bit i is set where value i exceeds value i + 1 (a difference hash)."""
    steps = F.sequence(F.lit(0), F.lit(bits - 1))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, i: acc + F.when(F.get(values, i) > F.get(values, i + 1), F.expr("1L")).otherwise(F.lit(0).cast("long")) * F.pow(F.lit(2.0), i).cast("long"))


def classes(rows: DataFrame, id_col: str = "id", hash_col: str = "h") -> DataFrame:
    """(id, h, class_id): the smallest id with a row's hash. Null hashes are left out."""
    known = rows.filter(F.col(hash_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(hash_col).alias("h"))
    return known.join(known.groupBy("h").agg(F.min("id").alias("class_id")), "h").select("id", "h", "class_id")


def intact_masks(limit: int, intact: int, width: int = 64) -> list[int]:
    """Masks of ``intact`` of ``limit + intact`` bands of bits, of sizes that differ by one
    at most: hashes that differ in at most ``limit`` bits are equal under one of them."""
    many = limit + intact
    if many > width:
        raise ValueError(f"{many} bands of {width} bits")
    edges = [k * width // many for k in range(many + 1)]
    bands = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(chosen)) for chosen in combinations(bands, intact)]


def hamming_links(hashes: DataFrame, limit: int, intact: int = 2, width: int = 64) -> DataFrame:
    """(x, y, distance) of distinct hashes ``h``, x < y, that differ in at most ``limit``
    bits: candidates are equal under one of the masks, an equi-join. More ``intact`` bands
    make more masks and keys of more bits: ``width * intact / (limit + intact)``."""
    masks = F.array(*[F.lit(m).cast("long") for m in intact_masks(limit, intact, width)])
    values = hashes.select(F.col("h").cast("long").alias("h")).distinct()
    keyed = values.select("h", F.posexplode(F.transform(masks, lambda m: F.col("h").bitwiseAND(m))).alias("t", "key"))
    other = keyed.withColumnRenamed("h", "y")
    distance = F.bit_count(F.col("h").bitwiseXOR(F.col("y")))
    near = keyed.join(other, ["t", "key"]).filter((F.col("h") < F.col("y")) & (distance <= limit))
    return near.select(F.col("h").alias("x"), "y", distance.alias("distance")).distinct()


def hamming_pairs(rows: DataFrame, limit: int, id_col: str = "id", hash_col: str = "h", width: int = 64, intact: int = 2) -> DataFrame:
    """(a, b, distance): classes of ids with one hash, named by their smallest id, that
    differ in at most ``limit`` bits, a < b. ``classes`` has the members; copies are not
    expanded into pairs."""
    named = classes(rows, id_col, hash_col).select("h", "class_id").distinct()
    near = hamming_links(named, limit, intact, width)
    side = lambda h, name: named.select(F.col("h").alias(h), F.col("class_id").alias(name))
    met = near.join(side("x", "p"), "x").join(side("y", "q"), "y")
    return met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "distance")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b). Labels move to the
    smallest neighbour and then jump to their label's label, until nothing changes."""
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")))
    for _ in range(rounds):
        seen = both.join(labels.select(F.col("a").alias("b"), F.col("l").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        step = labels.join(seen, "a").select("a", "l", F.least("l", "m").alias("n"))
        jumped = step.join(step.select(F.col("a").alias("n"), F.col("n").alias("far")), "n", "left")
        moved = checkpointed(jumped.select("a", "l", F.least("n", F.coalesce("far", "n")).alias("n")))
        changed = moved.filter("n <> l").limit(1).count()
        labels = moved.select("a", F.col("n").alias("l"))
        if not changed:
            return labels.select(F.col("a").alias("id"), F.col("l").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def build_relationships(parts: list[DataFrame]) -> DataFrame:
    """One relationship per unordered pair of panels from lists (source, target, score,
    seq) in order of priority: the first list that has a pair wins, then the lower seq."""
    tagged = [p.withColumn("pass", F.lit(k)) for k, p in enumerate(parts)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    pair = [F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")]
    first = F.min(F.struct("pass", "seq", "source", "target", "score")).alias("m")
    return union.groupBy(*pair).agg(first).select("a", "b", "m.source", "m.target", "m.score", F.col("m.pass").alias("priority"))


def tiles(panels: DataFrame, size: int = 128, stride: int = 64, least: int = 64, crop: int = 32) -> DataFrame:
    """(panel_id, x, y, w, h): overlapping tiles of panels (panel_id, width, height);
    panels under ``least`` pixels and crops under ``crop`` are left out."""
    big = panels.filter((F.col("width") >= least) & (F.col("height") >= least))
    xs = big.select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(stride))).alias("x"))
    ys = xs.select("*", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(stride))).alias("y"))
    cut = ys.select("panel_id", "x", "y", F.least(F.lit(size), F.col("width") - F.col("x")).alias("w"), F.least(F.lit(size), F.col("height") - F.col("y")).alias("h"))
    return cut.filter((F.col("w") >= crop) & (F.col("h") >= crop))


def outliers(values: DataFrame, group: str, id_col: str, value: str) -> DataFrame:
    """Rows further than twice the quartile distance from their group's median, in groups
    of three or more. Quartiles are order statistics: places n // 4 and 3n // 4."""
    w = Window.partitionBy(group)
    ranked = values.filter(F.col(value).isNotNull()).select(group, F.col(value).alias("x"), F.row_number().over(w.orderBy(value)).alias("k"), F.count("*").over(w).alias("n")).filter("n >= 3")
    at = lambda place: F.max(F.when(F.col("k") == F.floor(place).cast("int") + 1, F.col("x")))
    n = F.col("n")
    limits = ranked.groupBy(group, "n").agg(at(n / 2).alias("upper"), at((n - 1) / 2).alias("lower"), at(n / 4).alias("q1"), at(3 * n / 4).alias("q3"))
    iqr = F.when(n >= 4, F.col("q3") - F.col("q1")).otherwise(0.0)
    limits = limits.select(group, ((F.col("lower") + F.col("upper")) / 2).alias("median"), iqr.alias("iqr"))
    return values.join(limits, group).filter(F.abs(F.col(value) - F.col("median")) > 2 * F.col("iqr")).select(group, id_col, value, "median", "iqr")
