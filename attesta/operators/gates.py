"""Gates that mark harmless relations: running numbers, summary statistics, designs,
instruments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.scalars import COUNT_TERMS, MEAN_TERMS, SUM_TERMS, TIME_TERMS, has_term
from attesta.operators.similarity import checkpointed

SHEET = ["workbook", "sheet"]
PAIR = [*SHEET, "left", "right"]

#: Words of labels that go together, by group; a label belongs to a group if
#: it contains one of its words.
GROUPS = (
    ("mean", "avg", "average", "sd", "std", "stderr", "sem"),
    ("median", "iqr", "q1", "q3", "25%", "75%"),
    ("n", "count", "total", "proportion", "percentage", "%"),
    ("pre", "post", "baseline", "followup", "t0", "t1"),
    ("control", "treatment", "case", "case_control"),
)


def semantic_pair(left: Column, right: Column) -> Column:
    """Both labels contain a word of one group."""
    both = [has_term(left, words) & has_term(right, words) for words in GROUPS]
    found = both[0]
    for one in both[1:]:
        found = found | one
    return found


def mean_and_sum(left: Column, right: Column) -> Column:
    """1 where the left label is a mean and the right one a sum, 2 the other way round,
    else null."""
    return F.when(has_term(left, MEAN_TERMS) & has_term(right, SUM_TERMS), 1).when(has_term(right, MEAN_TERMS) & has_term(left, SUM_TERMS), 2)


def timed(left: Column, right: Column) -> Column:
    """One of the labels has a term of time or events."""
    return has_term(left, TIME_TERMS) | has_term(right, TIME_TERMS)


def formula_columns(found: DataFrame, columns: list[str], formulas: DataFrame | None) -> DataFrame:
    """Adds ``formula``: whether one of the fields ``columns`` names a column of
    ``formulas`` (workbook, sheet, col)."""
    if formulas is None:
        return found.withColumn("formula", F.lit(False))
    known = formulas.groupBy(*SHEET).agg(F.collect_set("col").alias("_formulas"))
    inside = reduce(lambda a, b: a | b, [F.array_contains("_formulas", F.col(c).cast("int")) for c in columns])
    return found.join(known, SHEET, "left").withColumn("formula", F.coalesce(inside, F.lit(False))).drop("_formulas")


def labelled(found: DataFrame, columns: list[str], labels: DataFrame) -> DataFrame:
    """Adds the label of each field of ``columns`` as label_<field>, empty without one."""
    for c in columns:
        named = labels.select(*SHEET, F.col("col").alias(c), F.col("label").alias(f"label_{c}"))
        found = found.join(named, [*SHEET, c], "left").na.fill("", [f"label_{c}"])
    return found


def explained(found: DataFrame, key: list[str], rows: DataFrame, cells: DataFrame, labels: DataFrame | None = None, formulas: DataFrame | None = None) -> DataFrame:
    """Adds to found column pairs what may explain them: ``formula`` (a side is a formula
    column), ``semantic`` (labels of one group) and ``summary`` (a mean and its sum on the
    supporting ``rows`` (key, row)). Only pairs with such labels are looked at again."""
    found = formula_columns(found, ["left", "right"], formulas)
    if labels is None:
        return found.withColumns({"semantic": F.lit(False), "summary": F.lit(False)})
    left, right = F.col("label_left"), F.col("label_right")
    found = labelled(found, ["left", "right"], labels).withColumns({"semantic": semantic_pair(left, right), "mean": mean_and_sum(left, right)})
    found = checkpointed(found)
    asked = found.filter("mean IS NOT NULL").select(*key, "mean")
    if asked.isEmpty():
        return found.withColumn("summary", F.lit(False))
    asked = rows.join(asked, key).distinct()
    side = lambda s, v: cells.select(*SHEET, "row", F.col("col").alias(s), F.col("v").alias(v))
    values = asked.join(side("left", "a"), [*SHEET, "row", "left"]).join(side("right", "b"), [*SHEET, "row", "right"])
    counts = count_columns(labels)
    named = counts.select(*SHEET, F.explode("columns").alias("col")).distinct()
    others = cells.join(named, [*SHEET, "col"]).groupBy(*SHEET, "row").agg(F.collect_list(F.struct("col", "v")).alias("others"))
    values = values.join(others, [*SHEET, "row"], "left").withColumn("others", F.coalesce("others", F.array()))
    met = found.join(summaries(values, key, counts), key, "left")
    return met.withColumn("summary", F.coalesce("summary", F.lit(False)))


def likelihood(*harmless: str) -> Column:
    """high where one of the boolean fields holds, else unknown."""
    return F.when(reduce(lambda a, b: a | b, map(F.col, harmless)), "high").otherwise("unknown").alias("artifact_likelihood")


def running_numbers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, index_like): whether both ``a`` and ``b`` of a key's rows, in row order, are
    running numbers: eight rows or more, 95 % whole numbers, 70 % steps of one."""
    w = Window.partitionBy(*keys).orderBy("row")
    stepped = rows.select(*keys, "a", "b", *[(F.col(c) - F.lag(c).over(w)).alias(f"step_{c}") for c in "ab"])
    one = lambda c: F.sum(c.cast("int"))
    s = stepped.groupBy(*keys).agg(F.count("*").alias("n"), *[one(F.col(c) % 1_000_000 == 0).alias(f"whole_{c}") for c in "ab"], *[one(F.col(f"step_{c}") == 1_000_000).alias(f"ones_{c}") for c in "ab"])
    side = lambda c: (F.col(f"whole_{c}") * 100 >= F.col("n") * 95) & (F.coalesce(f"ones_{c}", F.lit(0)) * 10 >= (F.col("n") - 1) * 7)
    return s.select(*keys, ((F.col("n") >= 8) & side("a") & side("b")).alias("index_like"))


def designs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, design): whether one side or both of a key's rows hold few distinct values:
    three, or a fifth of the rows."""
    s = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("a").alias("da"), F.count_distinct("b").alias("db"))
    few = lambda c: (F.col(c) <= 3) | (F.col(c) * 5 <= F.col("n"))
    return s.select(*keys, (few("da") | few("db")).alias("design"))


def count_columns(labels: DataFrame) -> DataFrame:
    """(workbook, sheet, columns): the columns that are labelled as counts."""
    return labels.filter(has_term(F.col("label"), COUNT_TERMS)).groupBy(*SHEET).agg(F.collect_set("col").alias("columns"))


def summaries(rows: DataFrame, keys: list[str], counts: DataFrame) -> DataFrame:
    """(keys, summary) of keys whose ``mean`` is 1 where ``a`` is a mean and ``b`` a sum, or
    2: three rows or more with a non-zero mean, 80 % of whose ratios sum / mean are whole
    numbers over one. Where the sheet has columns labelled as counts (``count_columns``), the
    ratio must be such a count, to a thousandth, on 80 % of the rows that have it; where it
    has none, the whole ratios are at most two numbers. ``others`` are a row's cells of
    these columns."""
    mean, total = F.when(F.col("mean") == 1, F.col("a")).otherwise(F.col("b")), F.when(F.col("mean") == 1, F.col("b")).otherwise(F.col("a"))
    used = rows.select(*keys, "others", mean.alias("m"), total.alias("s")).filter("m <> 0").withColumn("ratio", F.col("s").cast("double") / F.col("m"))
    whole = (F.col("ratio") > 1) & (F.abs(F.col("ratio") - F.rint("ratio")) <= 1e-6)
    s = used.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(whole).alias("whole"), F.count_distinct(F.when(whole, F.rint("ratio"))).alias("ratios"))
    s = s.filter("n >= 3 AND whole * 10 >= n * 8")
    near = F.abs(F.col("ratio") - F.col("v") / 1e6) <= 0.001 + 1e-12
    met = used.select(*keys, "ratio", F.inline("others")).filter((F.col("col") != F.col("left")) & (F.col("col") != F.col("right")))
    fits = met.groupBy(*keys, "col").agg((F.count_if(near) * 10 >= F.count("*") * 8).alias("fits")).groupBy(*keys).agg(F.max("fits").alias("fits"))
    able = s.join(counts, SHEET, "left").withColumn("counted", F.coalesce(F.size(F.array_except("columns", F.array("left", "right"))) > 0, F.lit(False)))
    return able.join(fits, keys, "left").select(*keys, F.when(F.col("counted"), F.coalesce("fits", F.lit(False))).otherwise(F.col("ratios") <= 2).alias("summary"))


def instrument(pairs: DataFrame) -> DataFrame:
    """(pair, instrument): the pooled quartile distance is under 1 % of a positive median
    (exclusive quartiles, at places (n + 1) q of the sorted values), or the columns are
    correlated over 0.99 while their difference hardly varies. Places are counted over
    sorted rows, so no pair's values are held at once."""
    s = pairs.groupBy(*PAIR).agg(F.count("*").alias("rows"), F.try_divide(F.covar_samp("a", "b"), F.stddev_samp("a") * F.stddev_samp("b")).alias("corr"), F.stddev_samp((F.col("b") - F.col("a")) / 1e6).alias("sd"))
    n = F.col("n")
    at = lambda q: F.greatest(F.lit(1.0), F.least(n.cast("double") - 1, (n + 1) * q))
    places = {k: at(q) for k, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))}
    # Counted by a window, so that a pair's values aren't exchanged to meet their number.
    w = Window.partitionBy(*PAIR)
    pooled = pairs.select(*PAIR, F.explode(F.array("a", "b")).alias("v")).withColumns({"k": F.row_number().over(w.orderBy("v")), "n": F.count("*").over(w)})
    met = pooled.withColumns(places)
    part = lambda p: F.sum(F.when(F.col("k") == F.floor(p), F.col("v") * (1 - (F.col(p) - F.floor(p)))).when(F.col("k") == F.floor(p) + 1, F.col("v") * (F.col(p) - F.floor(p)))).alias(p)
    quartiles = met.groupBy(*PAIR).agg(*[part(p) for p in places])
    narrow = (F.col("q2") > 0) & (F.col("q3") - F.col("q1") < 0.01 * F.col("q2"))
    stable = (F.col("corr") > 0.99) & (F.col("sd") < 0.001)
    found = s.join(quartiles, PAIR)
    return found.select(*PAIR, (F.coalesce(narrow, F.lit(False)) | F.coalesce(stable, F.lit(False))).alias("instrument"))


def violations(rows: DataFrame) -> DataFrame:
    """Image relationships with what is wrong with them: a score outside 0..1, a negative
    box, a missing panel, a panel related to itself without a self-matching method."""
    wrong = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("score").between(0, 1), F.lit(False)), "score"),
            F.when(F.exists("bbox", lambda x: x < 0), "bbox"),
            F.when(F.col("source").isNull() | F.col("target").isNull(), "panel"),
            F.when((F.col("source") == F.col("target")) & (F.col("method") != "copy_move_single"), "self_pair"),
        )
    )
    return rows.withColumn("violations", wrong)
