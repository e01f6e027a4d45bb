"""Scalar functions of the spreadsheet, text and image lanes, as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_to_index(name: Column) -> Column:
    """A1 column letters to a number counted from one."""
    letters = F.filter(F.split(F.upper(name), ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64)


def index_to_col(index: Column) -> Column:
    """A number from 1 to 18278 to A1 column letters."""
    letter = lambda n: F.when(n > 0, F.char(n + 64)).otherwise("")
    n = index.cast("int")
    last = F.pmod(n - 1, F.lit(26)) + 1
    rest = ((n - last) / 26).cast("int")
    middle = F.when(rest > 0, F.pmod(rest - 1, F.lit(26)) + 1).otherwise(0)
    first = ((rest - middle) / 26).cast("int")
    return F.concat(letter(first), letter(middle), letter(last))


def row_range(text: Column) -> Column:
    """'2-15' to struct<start,end>; null for anything else."""
    a, b = F.regexp_extract(text, r"^\s*(\d+)\s*-\s*(\d+)\s*$", 1), F.regexp_extract(text, r"^\s*(\d+)\s*-\s*(\d+)\s*$", 2)
    return F.when(a != "", F.struct(a.try_cast("int").alias("start"), b.try_cast("int").alias("end")))


def column_range(text: Column) -> Column:
    """'B-E' or '2-5' to struct<start,end> of column numbers; null for anything else."""
    part = lambda kind, k: F.regexp_extract(text, rf"^\s*({kind}+)\s*-\s*({kind}+)\s*$", k)
    letters = F.struct(*[col_to_index(part("[A-Za-z]", k)).alias(name) for k, name in ((1, "start"), (2, "end"))])
    return F.when(part("[A-Za-z]", 1) != "", letters).otherwise(row_range(text))


def cell_ranges(text: Column) -> Column:
    """All 'A1:C9' of a text in order, as structs of their first and last row and column."""
    shape = r"([A-Z]+)(\d+):([A-Z]+)(\d+)"
    part = lambda x, k: F.regexp_extract(x, shape, k)
    row, col = lambda x, k: part(x, k).try_cast("int"), lambda x, k: col_to_index(part(x, k))
    one = lambda x: F.struct(row(x, 2).alias("first_row"), col(x, 1).alias("first_col"), row(x, 4).alias("last_row"), col(x, 3).alias("last_col"))
    return F.transform(F.regexp_extract_all(text, F.lit(shape), F.lit(0)), one)


def value_bucket(value: Column, width: float = 1e-6) -> Column:
    """The number of the bucket of ``width`` that is nearest, ties to even; 0 for NaN and
    infinities, null where the number is beyond a BIGINT."""
    odd = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(odd, F.lit(0)).otherwise(F.rint(value / width).try_cast("long"))


def report_id(prefix: str, at: Column, key: Column) -> Column:
    """PREFIX-YYYYMM-XXXXXX: month of ``at``, and six hex digits of the key's SHA-256, so
    that a report gets the same id when it is made again."""
    return F.concat(F.lit(f"{prefix}-"), F.date_format(at, "yyyyMM"), F.lit("-"), F.upper(F.substring(F.sha2(key.cast("string"), 256), 1, 6)))


def is_report_id(text: Column, prefix: str) -> Column:
    return F.coalesce(text.rlike(rf"^{prefix}-\d{{6}}-[0-9A-Fa-f]{{6}}\z"), F.lit(False))


def parse_number(raw: Column) -> Column:
    """Number text without commas and per cent signs; null if it is none (NaN and
    infinities included)."""
    clean = F.trim(F.translate(raw, ",%", ""))
    return F.when(clean.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), clean).try_cast("double")


def decimal_places(raw: Column) -> Column:
    """Digits behind the point of a literal: 1.50 has two."""
    return F.length(F.regexp_extract(raw, r"\.(\d+)", 1))


def approx_equal(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return F.abs(a - b) <= eps * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def integer_delta(a: Column, b: Column) -> Column:
    """The whole difference b - a (millionths) of values with equal decimals, else null."""
    f = F.abs(a) % 1_000_000
    return F.when((f != 0) & (f == F.abs(b) % 1_000_000) & ((b - a) % 1_000_000 == 0), ((b - a) / 1_000_000).cast("long"))


def formula_pattern(formula: Column) -> Column:
    """A formula with its row numbers taken out."""
    return F.regexp_replace(formula, r"\$?([A-Z]+)\$?(\d+)", "$1<row>")


def referenced_columns(formula: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(formula, F.lit(r"\$?([A-Z]+)\$?\d+"), F.lit(1))))


#: Words that mark a label as a mean, a sum, a count, or a time or event.
MEAN_TERMS = ("mean", "average")
SUM_TERMS = ("sum", "total")
COUNT_TERMS = ("n total", "n=", "n ", "count", "number")
TIME_TERMS = ("day", "days", "time", "week", "weeks", "control", "tumor free", "tumour free", "survival", "event")


def has_term(label: Column, terms: tuple[str, ...]) -> Column:
    """Whether a label contains one of the terms; a null label has none."""
    return F.coalesce(F.lower(label).rlike("|".join(terms)), F.lit(False))


def sentences(text: Column) -> Column:
    """Sentences of a text, trimmed; blank ones are left out."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?。！？])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def clean_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def label_key(label: Column) -> Column:
    """Figure and table labels without case, blanks and marks."""
    return F.regexp_replace(F.lower(label), "[^a-z0-9\\u4e00-\\u9fa5]+", "")


def figure_key(name: Column) -> Column:
    """struct<kind,number,panel> of a sheet name such as 'ED Fig. 3d'."""
    pattern = r"(?i)^(ed|extended data|supp\w*)?\s*_?fig(?:ure|\.)?\s*_?(\d+)\s*_?([a-z]?)"
    number = F.regexp_extract(name, pattern, 2)
    kind = F.when(F.regexp_extract(name, pattern, 1) == "", "main").otherwise("extended")
    return F.when(number != "", F.struct(kind.alias("kind"), number.try_cast("int").alias("number"), F.lower(F.regexp_extract(name, pattern, 3)).alias("panel")))


def panel_range(text: Column) -> Column:
    """'l-n' to [l, m, n]; a single letter to itself; ranges of ten or more to nothing."""
    a, b = F.ascii(F.substring(text, 1, 1)), F.ascii(F.substring(text, 3, 1))
    wide = F.length(text) == 3
    letters = F.transform(F.sequence(a, F.when(wide & (b > a) & (b - a < 10), b).otherwise(a)), lambda c: F.char(c))
    return F.when(wide & ((b <= a) | (b - a >= 10)), F.array().cast("array<string>")).otherwise(letters)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def min_rotation_distance(a: Column, b: Column) -> Column:
    """Least distance between two arrays of rotated hashes."""
    return F.array_min(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.bit_count(x.bitwiseXOR(y))))))


#: Weight of a panel type in the risk of an image score, and the cuts.
MODALITY_WEIGHT = {"Blots": 1.0, "Microscopy": 0.9, "Body": 0.6, "Flow": 0.2, "Graphs": 0.2}
OTHER_WEIGHT = 0.5
CUTS = ((0.7, "high"), (0.4, "medium"), (0.25, "low"))


def image_risk(score: Column, modality: Column) -> Column:
    """Risk level of a score weighted by its panel type; a null type has full weight."""
    weight = F.when(modality.isNull(), 1.0)
    for name, w in MODALITY_WEIGHT.items():
        weight = weight.when(modality == name, w)
    weighted = score * weight.otherwise(OTHER_WEIGHT)
    level = F.when(weighted >= CUTS[0][0], CUTS[0][1])
    for cut, name in CUTS[1:]:
        level = level.when(weighted >= cut, name)
    return level.otherwise("info")


def integrity_risk(score: Column) -> Column:
    return F.when(score >= 0.9, "high").when(score >= 0.7, "medium").otherwise("low")


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def polygon_area(points: Column) -> Column:
    """Shoelace area of array<struct<x,y>>; fewer than three points have none."""
    n = F.size(points)
    index = F.sequence(F.lit(0), n - 1)
    term = lambda i: F.get(points, i)["x"] * F.get(points, F.pmod(i + 1, n))["y"] - F.get(points, F.pmod(i + 1, n))["x"] * F.get(points, i)["y"]
    return F.when(n >= 3, F.abs(F.aggregate(F.transform(index, term), F.lit(0.0), lambda acc, x: acc + x)) / 2).otherwise(0.0)


def box_overlap(a: Column, b: Column) -> Column:
    """Common area of boxes array(x, y, w, h)."""
    side = lambda k: F.greatest(F.lit(0), F.least(a[k] + a[k + 2], b[k] + b[k + 2]) - F.greatest(a[k], b[k]))
    return side(0) * side(1)


def affine_parts(a: Column, b: Column, c: Column, d: Column) -> Column:
    """struct<angle,scale,flipped> of the matrix [[a, b], [c, d]]; degrees."""
    det = a * d - b * c
    return F.struct((F.atan2(c, a) * 180 / math.pi).alias("angle"), F.sqrt(F.abs(det)).alias("scale"), (det < 0).alias("flipped"))


def shorten(text: Column, limit: int) -> Column:
    """Head of a text, with a mark where it was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def found_phrases(text: Column, phrases: list[str]) -> Column:
    """Phrases of a fixed list that occur in a text, in list order."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))
