"""Secret scanning with multipart credential linking, in DataFrame functions only.

Strong patterns (assignments, access keys, hexadecimal runs) are reported wherever they
match. Weak candidates - named identifiers, bare tokens, endpoints - are reported only if
complementary parts co-occur: each access identifier opens a scope of ``SCOPE`` code
points to both sides; an interval join meets it with the secrets and endpoints that lie
inside. An identifier with a secret is a credential, and an endpoint in reach of a
credential completes it. Parts are different stretches of text: a bare token that touches
an identifier or an endpoint is no secret of its own. The join is dealt by row and bin of
positions, and a bin can only hold as many candidates as fit into its width.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import cut, cut_spans

#: Strong kinds, in the order in which they are listed: (kind, pattern, filter on the match).
STRONG = ("assign", "access", "hex")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
#: Runs are maximal, so a least length gives what dropping short runs gives.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Least length of an assigned value.
ASSIGNED = 6
#: Weak kinds: a named identifier, a bare token with letters and digits, an endpoint.
WEAK = ("ident", "part", "endpoint")
IDENT = r"""(?i:(?<![A-Za-z0-9_])(access_?key_?id|client_?id|account_?id|key_?id|username|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,})"""
PART = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"""(?i:[a-z][a-z0-9+.-]{0,30}://[^\s"'<>|]+|(?<![A-Za-z0-9_])(endpoint|host|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/-]{4,})"""
#: Elements of a piece over which running values are gathered.
PIECE = 128
#: Code points to either side of an identifier that its scope reaches.
SCOPE = 300

_ORDER = {k: i for i, k in enumerate((*STRONG, *WEAK))}
_SPANS = "array<struct<start:int,end:int,body:string>>"


def scanned(values: Column, fold: Callable[[Column, Column], Column], start: int) -> Column:
    """For each of the integers ``values``, ``fold`` over those before it, from ``start``.
    An accumulator is copied at every step, so that arrays are only gathered over pieces of
    ``PIECE`` elements and over the pieces. Values are held by arrays of one element, as a
    lambda computes again what it names."""

    def folds(items: Column, first: Column, step: Callable[[Column, Column], Column]) -> Column:
        every = F.aggregate(items, F.array(first), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))
        return F.slice(every, 1, F.size(items))

    def of_pieces(pieces: Column) -> Column:
        firsts = folds(pieces, F.lit(start), lambda at, piece: F.aggregate(piece, at, fold))
        return F.flatten(F.zip_with(pieces, firsts, lambda piece, at: folds(piece, at, fold)))

    def cut_up(held: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / PIECE).cast("int"))
        pieces = F.transform(places, lambda k: F.slice(held, k * PIECE + 1, PIECE))
        return F.flatten(F.transform(F.array(pieces), of_pieces))

    return F.when(F.size(values) > 0, F.flatten(F.transform(F.array(values), cut_up))).otherwise(F.array().cast("array<int>"))


def spans_of(text: Column, pattern: str, found: Column) -> Column:
    """Code-point spans of the matches ``found`` (all of them, in order): the text between
    matches and the matches themselves give the positions as running sums of lengths."""
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    parts = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("body")))

    def placed(held: Column) -> Column:
        before = scanned(F.transform(held, lambda x: x["gap"] + x["size"]), lambda at, n: at + n, 0)
        span = lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["body"].alias("body"))
        return F.zip_with(held, before, span)

    return F.when(F.size(found) > 0, F.flatten(F.transform(F.array(parts), placed))).otherwise(F.array().cast(_SPANS))


def _with_spans(df: DataFrame, patterns: dict[str, str], only: Column | None = None) -> DataFrame:
    """Adds a span column per kind; where ``only`` doesn't hold, nothing is searched."""
    text = F.col("text")
    searched = {f"_{k}": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in patterns.items()}
    if only is not None:
        searched = {k: F.when(only, v).otherwise(F.array().cast("array<string>")) for k, v in searched.items()}
    df = df.withColumns(searched)
    return df.withColumns({k: spans_of(text, p, F.col(f"_{k}")) for k, p in patterns.items()}).drop(*searched)


def _strong(df: DataFrame) -> DataFrame:
    """Adds a span column per strong kind."""
    df = _with_spans(df, {"assign": ASSIGN, "access": ACCESS, "hex": HEX})
    return df.withColumn("assign", F.filter("assign", lambda s: F.length(F.regexp_extract(s["body"], ASSIGN, 2)) >= ASSIGNED))


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, _row, one span array per kind) of every row. Weak secrets and endpoints are
    searched where an identifier is present, as only there they can be linked."""
    rows = df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("_row"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = _with_spans(_strong(rows), {"ident": IDENT})
    rows = _with_spans(rows, {"part": PART, "endpoint": ENDPOINT}, (F.size("access") > 0) | (F.size("ident") > 0))
    rows = rows.withColumn("part", F.filter("part", lambda s: s["body"].rlike("[0-9]") & s["body"].rlike("[A-Za-z]")))
    place = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    return rows.select("id", "_row", *[F.transform(k, place).alias(k) for k in (*STRONG, *WEAK)])


def apart(spans: DataFrame, own: Column, others: Column) -> DataFrame:
    """``spans`` (_row, start, end, ...) without those of ``own`` that share a code point
    with one of ``others``: by start, the greatest end of the others so far and the next
    start of another one tell it, so that a row's spans are sorted once."""
    before = Window.partitionBy("_row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # The same frame from the end; frames that end at the last row are computed again for each.
    after = Window.partitionBy("_row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    far, near = F.max(F.when(others, F.col("end"))).over(before), F.min(F.when(others, F.col("start"))).over(after)
    touched = own & ((F.coalesce(far, F.lit(-1)) > F.col("start")) | (F.coalesce(near, F.col("end")) < F.col("end")))
    return spans.withColumn("_touched", touched).filter("NOT _touched").drop("_touched")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(_row, kind, start, end) of the weak candidates that complementary parts confirm and
    that touch no strong match."""
    spans = found.filter((F.size("access") > 0) | (F.size("ident") > 0)).select("_row", F.inline(F.concat(*[_tagged(k, kind=k) for k in (*STRONG, *WEAK)])))
    spans = apart(spans, F.col("kind") == "part", F.col("kind").isin("access", "ident", "endpoint"))
    spans = cut(spans.select("_row", "kind", "start", "end"))

    named = F.col("kind").isin("access", "ident")
    idents = spans.filter(named).select("_row", F.col("kind").alias("i_kind"), F.col("start").alias("i_start"), F.col("end").alias("i_end"))
    idents = idents.withColumns({"low": F.greatest(F.lit(0), F.col("i_start") - scope), "high": F.col("i_end") + scope})
    idents = idents.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / scope), F.floor(F.col("high") / scope))))
    others = spans.filter(~named).withColumn("bin", F.floor(F.col("start") / scope))
    met = idents.join(others, ["_row", "bin"]).filter((F.col("start") >= F.col("low")) & (F.col("end") <= F.col("high")))
    # An identifier is no secret and no endpoint of its own.
    met = met.filter((F.col("end") <= F.col("i_start")) | (F.col("start") >= F.col("i_end")))
    key = ["_row", "i_kind", "i_start", "i_end"]
    whole = met.groupBy(*key).agg(F.max(F.col("kind") != "endpoint").alias("whole"), F.collect_set(F.struct("kind", "start", "end")).alias("parts")).filter("whole")
    both = F.concat(F.array(F.struct(F.col("i_kind").alias("kind"), F.col("i_start").alias("start"), F.col("i_end").alias("end"))), "parts")
    weak = whole.select("_row", F.inline(both)).filter(F.col("kind").isin(*WEAK)).distinct()
    strong = F.col("kind").isin(*STRONG)
    return apart(weak.unionByName(spans.filter(strong)), ~strong, strong).filter(~strong)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, base, spans) of every row, arrays of struct<kind,start,end> in code points,
    end exclusive, by start and then kind as listed. ``base`` holds the strong matches,
    ``spans`` these and the linked weak ones that touch no strong match. Null texts are
    empty; rows without matches have empty arrays; repeated rows stay repeated; other
    columns are not read. The work on a text grows in proportion to its matches."""
    found = cut(candidates(df, id_col, text_col))
    extra = linked(found, scope).groupBy("_row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("extra"))
    joined = found.join(extra, "_row", "left")

    def ordered(spans: Column) -> Column:
        rank = lambda s: F.struct(s["start"].alias("start"), _rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
        back = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
        return F.transform(F.array_sort(F.transform(spans, rank)), back)

    base = F.concat(*[_tagged(k, kind=k) for k in STRONG])
    rows = joined.select("id", base.alias("base"), F.coalesce("extra", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("extra"))
    return rows.select(F.col("id").alias(id_col), ordered(F.col("base")).alias("base"), ordered(F.concat("base", "extra")).alias("spans"))


def _tagged(spans: str, **tags: str) -> Column:
    """The spans of a column with constant fields before them."""
    fields = [F.lit(v).alias(k) for k, v in tags.items()]
    return F.transform(spans, lambda s: F.struct(*fields, s["start"].alias("start"), s["end"].alias("end")))


def _rank(kind: Column) -> Column:
    out = F.lit(len(_ORDER))
    for k, i in _ORDER.items():
        out = F.when(kind == k, i).otherwise(out)
    return out


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, *[count(k) for k in STRONG], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def merged(spans: str) -> Column:
    """Disjoint struct<start,end> spans that cover the sorted ``spans``: a new one begins
    where a span starts behind all ends so far, and ends at the greatest of these."""

    def islands(held: Column) -> Column:
        far = scanned(F.transform(held, lambda s: s["end"]), lambda at, end: F.greatest(at, end), -1)
        heads = F.filter(F.zip_with(held, far, lambda s, f: F.struct(s["start"].alias("start"), f.alias("far"))), lambda x: x["start"] > x["far"])
        return F.struct(heads.alias("heads"), F.array_max(F.transform(held, lambda s: s["end"])).alias("last"))

    def closed(x: Column) -> Column:
        ends = F.concat(F.transform(F.slice(x["heads"], 2, F.size(x["heads"])), lambda h: h["far"]), F.array(x["last"]))
        return F.zip_with(x["heads"], ends, lambda h, end: F.struct(h["start"].alias("start"), end.alias("end")))

    found = F.flatten(F.transform(F.transform(F.array(F.col(spans)), islands), closed))
    return F.when(F.size(spans) > 0, found).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fill: str = "[secret]") -> DataFrame:
    """The documents, with all their columns, with every found span replaced by ``fill``;
    null texts stay null. Texts without an identifier have nothing to link and are masked
    as they are read; only the others meet their spans in a join, by id and a hash of the
    text, so that repeated ids keep their own."""
    text = F.col(text_col)
    named = F.coalesce(text.rlike(ACCESS) | text.rlike(IDENT), F.lit(False))
    plain = _strong(docs.filter(~named).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"), text.alias("text")))
    base = F.array_sort(F.concat(*[_tagged(k) for k in STRONG]))
    plain = plain.select("row", "text", base.alias("base")).select("row", "text", merged("base").alias("spans"))
    plain = plain.select(*[cut_spans(F.col("text"), F.col("spans"), fill).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])

    rows = docs.filter(named)
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    found = scan(rows.select(key.alias("key"), text.alias("text")), "key", "text").filter(F.size("spans") > 0)
    found = found.select("key", merged("spans").alias("spans")).dropDuplicates(["key"])
    met = rows.alias("d").join(found.alias("f"), key.eqNullSafe(F.col("f.key")), "left")
    cleared = cut_spans(F.col(f"d.{text_col}"), F.col("f.spans"), fill)
    return plain.unionByName(met.select(*[cleared.alias(c) if c == text_col else F.col(f"d.{c}") for c in docs.columns]))
