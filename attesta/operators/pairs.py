"""Column-pair detectors.

Two cells of one row make a pair. Rows are gathered once (a row is as wide as its sheet,
which bounds it), pairs are unfolded inside the row, and every statistic of a pair comes
from partial aggregates: no self-join of the cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators import gates
from attesta.operators.columns import informative, rate, strength
from attesta.operators.shelf import shelf
from attesta.operators.similarity import checkpointed
from attesta.sources.cells import MICRO

PAIR = ["workbook", "sheet", "left", "right"]


def gathered(cells: DataFrame) -> DataFrame:
    """(workbook, sheet, row, cells): the cells of a row as an array, by column."""
    return cells.groupBy("workbook", "sheet", "row").agg(F.array_sort(F.collect_list(F.struct("col", "v"))).alias("cells"))


def row_pairs(cells: DataFrame) -> DataFrame:
    """(workbook, sheet, row, left, right, a, b) for every two cells of a row, left < right."""
    return pairs_of(gathered(cells))


def pairs_of(rows: DataFrame) -> DataFrame:
    """The pairs of gathered rows."""
    each = rows.select("workbook", "sheet", "row", "cells", F.posexplode("cells").alias("_i", "_x"))
    rest = F.inline(F.slice("cells", F.col("_i") + 2, F.size("cells"))).alias("right", "b")
    return each.select("workbook", "sheet", "row", F.col("_x.col").alias("left"), F.col("_x.v").alias("a"), rest).select("workbook", "sheet", "row", "left", "right", "a", "b")


def pair_stats(pairs: DataFrame) -> DataFrame:
    """One pass over the pairs: everything that the threshold detectors ask for."""
    d = F.col("b") - F.col("a")
    one = lambda c: F.sum(c.cast("int"))
    return pairs.groupBy(*PAIR).agg(
        F.count("*").alias("overlap"),
        one(F.col("a") == F.col("b")).alias("equal"),
        one((F.col("a") == 0) & (F.col("b") == 0)).alias("both_zero"),
        one((F.col("a") != 0) | (F.col("b") != 0)).alias("non_zero"),
        one((F.col("a") == F.col("b")) & (F.col("a") != 0)).alias("equal_non_zero"),
        F.max(F.abs(d)).alias("max_diff"),
        F.min(F.abs(d)).alias("min_diff"),
        F.sum(F.abs("a") + F.abs("b")).alias("magnitude"),
        F.least(F.min(F.abs("a")), F.min(F.abs("b"))).alias("low_abs"),
        F.greatest(F.max(F.abs("a")), F.max(F.abs("b"))).alias("high_abs"),
    )


def zero_inflated() -> Column:
    """Twenty rows or more, 70 % of them zero on both sides, and few or unequal others."""
    few = (F.col("non_zero") < 5) | (F.col("equal_non_zero") * 100 < F.col("non_zero") * 98)
    return (F.col("overlap") >= 20) & (F.col("both_zero") * 10 >= F.col("overlap") * 7) & few


def ratio_key(part: Column, whole: Column, places: int = 4) -> Column:
    """A ratio in units of ``places`` decimals, half to even; null for a zero denominator
    and for ratios that a BIGINT can't hold."""
    return F.rint(F.try_divide(part.cast("double") * float(10**places), whole.cast("double"))).try_cast("bigint")


#: Relation: what is constant on the rows that support it, values that don't count, and
#: the common rows it needs.
RELATIONS = {
    "duplicate_numeric_columns": (lambda a, b: F.when(a == b, F.lit(0).cast("long")), (), 12),
    "fixed_difference": (lambda a, b: a - b, (0,), 8),
    "fixed_ratio": (lambda a, b: ratio_key(a, b, 6), (0, MICRO), 8),
}

#: Hash buckets by which a pair's values are counted before they are told apart.
BUCKETS = 4
#: Why a relation may be harmless.
REASONS = {
    "index_like": "running numbers on both sides", "zero": "zero-inflated columns", "summary": "summary statistics",
    "design": "time or event design", "formula": "formula column involved",
}


def relations(cells: DataFrame, kinds: tuple[str, ...] = tuple(RELATIONS), support: int = 98, labels: DataFrame | None = None, formulas: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Column pairs that are one relation on ``support`` percent of their common rows:
    equal values, one difference or one ratio (both in millionths). The value is the most
    frequent one, the one seen first in a tie; the share is out of all common rows.

    A first pass only sums: rows of a pair are counted by ``BUCKETS`` hash buckets of each
    kind's value, and a value that reaches the support fills its bucket at least as far.
    Pairs that hold one value on all rows are done with that. Only others that pass are
    counted by value, so the many pairs without a relation never leave as one row per value.

    Relations are harmless (low risk, artifact_likelihood high) if the supporting rows are
    running numbers on both sides, zero-inflated (copies), a mean and its sum, or a time or
    event design; ``labels`` (workbook, sheet, col, label) names the columns for the last
    two. Differences and ratios that involve a column of ``formulas`` (workbook, sheet, col)
    are low, too (artifact_likelihood medium)."""
    with shelf(cells.sparkSession) as keep:
        rows = keep(gathered(cells)) if rows is None else rows
        return checkpointed(_relations(rows, kinds, support, labels, formulas))


def _relations(rows: DataFrame, kinds: tuple[str, ...], support: int, labels: DataFrame | None, formulas: DataFrame | None) -> DataFrame:
    pairs = pairs_of(rows)
    a, b = F.col("a"), F.col("b")
    values = {k: RELATIONS[k][0](a, b) for k in kinds}
    one = lambda c: F.sum(c.cast("int"))
    hashed = pairs.withColumns({f"v_{k}": v for k, v in values.items()}).withColumns({f"_{k}": F.when(F.col(f"v_{k}").isNotNull(), F.pmod(F.hash(f"v_{k}"), F.lit(BUCKETS))) for k in kinds})
    whole = lambda c: one(F.col(c) % MICRO == 0).alias(f"whole_{c}")
    sums = [one(F.col(f"_{k}") == n).alias(f"{k}_{n}") for k in kinds for n in range(BUCKETS)]
    stats = hashed.groupBy(*PAIR).agg(
        F.count("*").alias("overlap"),
        one((a == 0) & (b == 0)).alias("both_zero"),
        one((a != 0) | (b != 0)).alias("non_zero"),
        one((a == b) & (a != 0)).alias("equal_non_zero"),
        whole("a"),
        whole("b"),
        *[f(f"v_{k}").alias(f"{k}_{name}") for k in kinds for name, f in (("low", F.min), ("high", F.max))],
        *sums,
    )
    fullest = F.array(*[F.struct(F.lit(k).alias("category"), F.greatest(*[F.coalesce(f"{k}_{n}", F.lit(0)) for n in range(BUCKETS)]).alias("most"), F.lit(RELATIONS[k][2]).alias("least"), F.col(f"{k}_low").alias("low"), F.col(f"{k}_high").alias("high")) for k in kinds])
    stats = stats.select(*PAIR, "overlap", "both_zero", "non_zero", "equal_non_zero", "whole_a", "whole_b", F.inline(fullest))
    stats = stats.filter((F.col("most") * 100 >= F.col("overlap") * support) & (F.col("overlap") >= F.col("least"))).withColumn("one", (F.col("low") == F.col("high")) & (F.col("most") == F.col("overlap"))).drop("most", "least", "high")
    key = [*PAIR, "category"]
    value = F.lit(None).cast("long")
    for k, v in values.items():
        value = F.when(F.col("category") == k, v).otherwise(value)
    # A sheet's pairs that passed meet its gathered rows; only these pairs are unfolded.
    stats = checkpointed(stats)
    keyed = chosen_pairs(rows, stats.filter("NOT one").select(*key), ["category"]).withColumn("value", value).filter("value IS NOT NULL")
    counts = keyed.groupBy(*key, "value").agg(F.count("*").alias("n"), F.min("row").alias("first"), whole("a"), whole("b"))
    best = counts.groupBy(*key).agg(F.max(F.struct("n", (-F.col("first")).alias("early"), "value", "whole_a", "whole_b")).alias("m"))
    best = best.select(*key, F.col("m.value").alias("value"), F.col("m.n").alias("support"), "m.whole_a", "m.whole_b")
    best = best.unionByName(stats.filter("one").select(*key, F.col("low").alias("value"), F.col("overlap").alias("support"), "whole_a", "whole_b"))
    stats = stats.drop("low", "one", "whole_a", "whole_b")
    refused = F.lit(False)
    for k in kinds:
        refused = refused | ((F.col("category") == k) & F.col("value").isin(*RELATIONS[k][1]))
    found = best.join(stats, key).filter(~refused & (F.col("support") * 100 >= F.col("overlap") * support))
    found = _with_labels(found, labels)
    # Found relations are few beside cells: a table of their own keeps what follows from
    # computing them again.
    found = checkpointed(gates.formula_columns(found, ["left", "right"], formulas))

    # Only rows of relations that a gate may let off are looked at again.
    able = (F.col("support") >= 8) & (F.col("whole_a") * 100 >= F.col("support") * 95) & (F.col("whole_b") * 100 >= F.col("support") * 95)
    same = F.col("category") == "duplicate_numeric_columns"
    asked = found.select(*key, "value", able.alias("numbers"), "timed", F.when(~same, F.col("mean")).alias("mean")).filter("numbers OR timed OR mean IS NOT NULL")
    look = lambda gate, *tags, **more: chosen_pairs(rows, asked.filter(gate), ["category", "value", *tags], **more).withColumn("_v", value).filter("_v = value")
    if labels is not None:
        counts = gates.count_columns(labels)
        found = found.join(gates.designs(look("timed"), key), key, "left").join(gates.summaries(look("mean IS NOT NULL", "mean", sheets=counts), key, counts), key, "left")
    else:
        found = found.withColumns({"design": F.lit(False), "summary": F.lit(False)})
    found = found.join(gates.running_numbers(look("numbers"), key), key, "left").na.fill(False, ["index_like", "design", "summary"])
    found = found.withColumns({"zero": same & zero_inflated(), "formula": ~same & F.col("formula")})

    share = rate(F.col("support"), F.col("overlap"))
    harmless = F.col("index_like") | F.col("zero") | F.col("summary") | F.col("design")
    differ = F.col("label_left").isNull() | F.col("label_right").isNull() | (F.col("label_left") != F.col("label_right"))
    risk = F.when(harmless | F.col("formula"), "low").when((F.col("support") >= 100) & (~same | differ), "high").otherwise("medium")
    confidence = F.when(~same | (F.col("support") == F.col("overlap")), "high").otherwise("medium")
    likely = F.when(harmless, "high").when(F.col("formula"), "medium").otherwise("unknown")
    reason = F.coalesce(*[F.when(F.col(c), text) for c, text in REASONS.items()])
    return found.select(*PAIR, "category", "value", "support", "overlap", share.alias("support_rate"), risk.alias("risk_level"), confidence.alias("confidence"), strength(share).alias("pattern_strength"), likely.alias("artifact_likelihood"), reason.alias("artifact_reason"))


def chosen_pairs(rows: DataFrame, wanted: DataFrame, tags: list[str], sheets: DataFrame | None = None) -> DataFrame:
    """(workbook, sheet, row, left, right, tags, a, b): the pairs of gathered rows that
    ``wanted`` (workbook, sheet, left, right, tags) names for their sheet. With ``sheets``
    (workbook, sheet, columns) also ``others``: the cells of these columns of the row."""
    named = wanted.groupBy("workbook", "sheet").agg(F.collect_list(F.struct("left", "right", *tags)).alias("wanted"))
    more = []
    if sheets is not None:
        named = named.join(sheets, ["workbook", "sheet"], "left")
        more = [F.when(F.size("columns") > 0, F.filter("cells", lambda c: F.array_contains("columns", c["col"]))).otherwise(F.slice("cells", 1, 0)).alias("others")]
    # A sheet's list is small beside its rows, which stay where they are.
    met = rows.join(named.hint("shuffle_hash"), ["workbook", "sheet"])
    met = met.select("workbook", "sheet", "row", F.col("cells.col").alias("cols"), F.col("cells.v").alias("values"), *more, F.explode("wanted").alias("w"))
    at = lambda side: F.get("values", F.array_position("cols", F.col(f"w.{side}")).cast("int") - 1)
    return met.select("workbook", "sheet", "row", "w.*", at("left").alias("a"), at("right").alias("b"), *(["others"] if more else [])).filter("a IS NOT NULL AND b IS NOT NULL")


def _with_labels(found: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Adds the labels of both sides and what they make of a pair."""
    if labels is None:
        return found.withColumns({"label_left": F.lit(None).cast("string"), "label_right": F.lit(None).cast("string"), "timed": F.lit(False), "mean": F.lit(None).cast("int")})
    side = lambda s: labels.select("workbook", "sheet", F.col("col").alias(s), F.col("label").alias(f"label_{s}"))
    met = found.join(side("left"), ["workbook", "sheet", "left"], "left").join(side("right"), ["workbook", "sheet", "right"], "left")
    left, right = F.col("label_left"), F.col("label_right")
    return met.withColumns({"timed": gates.timed(left, right), "mean": gates.mean_and_sum(left, right)})


def duplicate_columns(cells: DataFrame, support: int = 98, **known: DataFrame) -> DataFrame:
    """Column pairs that hold the same values."""
    return relations(cells, ("duplicate_numeric_columns",), support, **known)


def fixed_difference(cells: DataFrame, support: int = 98, **known: DataFrame) -> DataFrame:
    """Pairs whose left minus right is one non-zero value."""
    return relations(cells, ("fixed_difference",), support, **known)


def fixed_ratio(cells: DataFrame, support: int = 98, **known: DataFrame) -> DataFrame:
    """Pairs whose left over right is one value besides zero and one."""
    return relations(cells, ("fixed_ratio",), support, **known)


def pair_spread(cells: DataFrame, least: int = 8, rows: DataFrame | None = None) -> DataFrame:
    """Paired differences that are too narrow, of columns that aren't low in information:
    the largest is under 5 % of the mean magnitude, or both the spread of the absolute
    differences and the largest are under 1 % of the range of the absolute values. What
    looks like an instrument's precision is low. ``rows`` are the gathered informative cells
    where they are at hand."""
    with shelf(cells.sparkSession) as keep:
        rows = keep(gathered(informative(cells, least, 1))) if rows is None else rows
        s = pair_stats(pairs_of(rows)).filter(F.col("overlap") >= least)
        span = F.col("high_abs") - F.col("low_abs")
        by_magnitude = (F.col("magnitude") > 0) & (F.col("max_diff") * 40 * F.col("overlap") < F.col("magnitude"))
        by_range = (span > 0) & ((F.col("max_diff") - F.col("min_diff")) * 100 < span) & (F.col("max_diff") * 100 < span)
        found = checkpointed(s.filter(by_magnitude | by_range).select(*PAIR, "max_diff", "overlap"))
        precise = gates.instrument(chosen_pairs(rows, found.select(*PAIR), []))
        risk = F.when(F.col("instrument"), "low").when(F.col("overlap") >= 10, "high").otherwise("medium")
        likely = F.when(F.col("instrument"), "high")
        return checkpointed(found.join(precise, PAIR).select(*PAIR, F.lit("paired_difference_too_narrow").alias("category"), "max_diff", "overlap", risk.alias("risk_level"), likely.alias("artifact_likelihood")))


def small_n_fixed(cells: DataFrame, least: int = 3, rows: DataFrame | None = None) -> DataFrame:
    """Pairs with few common rows that all have one difference, or one ratio."""
    p = (row_pairs(cells) if rows is None else pairs_of(rows)).withColumns({"d": F.col("b") - F.col("a"), "r": F.when(F.col("a") != 0, F.rint(F.col("b") * 1e6 / F.col("a")).cast("long"))})
    s = p.groupBy(*PAIR).agg(F.count("*").alias("n"), F.min("d").alias("d0"), F.max("d").alias("d1"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.count("r").alias("nr")).filter(F.col("n") >= least)
    difference = s.filter("d0 = d1 AND d0 <> 0").select(*PAIR, F.lit("small_n_fixed_difference").alias("category"), F.col("d0").alias("value"), "n", F.lit("medium").alias("risk_level"))
    ratio = s.filter("nr = n AND r0 = r1 AND r0 NOT IN (0, 1000000)").select(*PAIR, F.lit("small_n_fixed_ratio").alias("category"), F.col("r0").alias("value"), "n", F.lit("medium").alias("risk_level"))
    return difference.unionByName(ratio)


def strict_linear(cells: DataFrame, least: int = 3, rows: DataFrame | None = None, **known: DataFrame | None) -> DataFrame:
    """Pairs on a line: two distinct x, R² of 0.999999 or more, and no residual beyond a
    millionth of the largest |y|; pure differences and pure ratios are left to others.
    The line comes from centred sums; a second pass takes the largest residual. Low if a side
    is a formula column; likely an artifact for summary statistics and labels of one group."""
    with shelf(cells.sparkSession) as keep:
        rows = keep(gathered(cells)) if rows is None else rows
        p = pairs_of(rows).withColumns({"x": F.col("a") / 1e6, "y": F.col("b") / 1e6})
        fit = p.groupBy(*PAIR).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.max(F.abs("y")).alias("top"))
        fit = fit.filter((F.col("n") >= least) & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")) & (F.col("r2") >= 0.999999))
        limit = F.greatest(F.lit(1.0), F.col("top")) * 1e-6
        fit = fit.filter((F.abs("intercept") > limit) & (F.abs(F.col("slope") - 1) > 1e-6))
        fit = checkpointed(fit)
        residual = F.max(F.abs(F.col("y") - F.col("slope") * F.col("x") - F.col("intercept"))).alias("residual")
        again = chosen_pairs(rows, fit.select(*PAIR, "slope", "intercept"), ["slope", "intercept"]).withColumns({"x": F.col("a") / 1e6, "y": F.col("b") / 1e6})
        worst = again.groupBy(*PAIR).agg(residual)
        found = fit.join(worst, PAIR).filter(F.col("residual") <= limit)
        found = gates.explained(found, PAIR, again.select(*PAIR, "row"), cells, **known)
        return checkpointed(found.select(*PAIR, F.lit("strict_linear_relation").alias("category"), F.rint(F.col("slope") * 1e4).cast("long").alias("slope"), F.rint(F.col("intercept") * 1e3).cast("long").alias("intercept"), "n", F.when(F.col("formula"), "low").when((F.col("n") >= 10) & (F.col("r2") >= 0.9999999), "high").otherwise("medium").alias("risk_level"), gates.likelihood("semantic", "summary")))


def cross_sheet_duplicates(cells: DataFrame, min_overlap: int = 10, support: int = 80) -> DataFrame:
    """Columns of different sheets that hold equal values in the same rows. Candidates
    share (row, value) pairs, an equi-join that AQE splits where one value is hot; common
    rows are then counted for candidates only."""
    left = cells.select(F.struct("workbook", "sheet", "col").alias("l"), "row", "v")
    right = cells.select(F.struct("workbook", "sheet", "col").alias("r"), "row", "v")
    other = (F.col("l") < F.col("r")) & ~((F.col("l.workbook") == F.col("r.workbook")) & (F.col("l.sheet") == F.col("r.sheet")))
    equal = left.join(right, ["row", "v"]).filter(other).groupBy("l", "r").agg(F.count("*").alias("equal")).filter(F.col("equal") * 100 >= min_overlap * support)
    rows = equal.join(left.select("l", "row"), "l").join(right.select("r", "row"), ["r", "row"]).groupBy("l", "r", "equal").agg(F.count("*").alias("overlap"))
    found = rows.filter((F.col("overlap") >= min_overlap) & (F.col("equal") * 100 >= F.col("overlap") * support))
    name = lambda side: [F.col(f"{side}.{c}").alias(f"{c}_{side}") for c in ("workbook", "sheet", "col")]
    return found.select(*name("l"), *name("r"), "equal", "overlap", rate(F.col("equal"), F.col("overlap")).alias("support_rate"))
