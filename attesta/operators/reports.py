"""From findings to reports: layers, queues, tiers, certainty texts, evidence indexes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.findings import latest, risk_level, risk_rank
from attesta.operators.ranks import placed
from attesta.operators.similarity import checkpointed

#: Categories that are informational whatever their risk, and words of
#: categories and sources whose high risks still need judgement.
INFORMATIONAL = ("duplicate_row_vector", "paperfraud.methodology_review")
JUDGED = ("paperfraud", "numeric_forensics", "benford", "digit")
#: Risk of a rule's severity.
SEVERITY_RISK = {"red": "high", "orange": "medium", "yellow": "low", "green": "info"}
#: Claims and sheets that are compared text by text at most; both are written by hand.
MAX_CLAIMS = 10_000


def layer_of(risk: Column, category: Column, source: Column) -> Column:
    """1, 2 or 3: informational categories are third; critical and high are first, or second
    for judged categories and sources; medium and unknown risks are second, the rest third."""
    level = F.lower(F.coalesce(risk, F.lit("medium")))
    kind, origin = F.lower(F.coalesce(category, F.lit(""))), F.lower(F.coalesce(source, F.lit("")))
    judged = kind.rlike("|".join(JUDGED)) | origin.rlike("|".join(JUDGED))
    return F.when(kind.isin(*INFORMATIONAL), 3).when(level.isin("critical", "high"), F.when(judged, 2).otherwise(1)).when(level == "medium", 2).otherwise(3)


def judge_input(findings: DataFrame) -> DataFrame:
    """Findings of the first two layers, with their layer."""
    source = F.col("source_artifact") if "source_artifact" in findings.columns else F.lit(None).cast("string")
    return findings.withColumn("layer", layer_of(F.col("risk_level"), F.col("category"), source)).filter("layer < 3")


def first_by_id(rows: DataFrame, id_col: str, seq: str) -> DataFrame:
    """The first row of each id in the order of ``seq``."""
    others = [c for c in rows.columns if c not in (id_col, seq)]
    first = rows.groupBy(id_col).agg(F.min_by(F.struct(*others), F.col(seq)).alias("m"), F.min(seq).alias(seq))
    return first.select(id_col, seq, *[F.col(f"m.{c}").alias(c) for c in others])


def top_findings(findings: DataFrame, n: int) -> DataFrame:
    """The ``n`` findings of highest risk, by id among equals."""
    return findings.withColumn("_rank", risk_rank(F.col("risk_level"))).orderBy(F.desc("_rank"), "finding_id").limit(n).drop("_rank")


def tiers(patterns: DataFrame, top: int = 20) -> DataFrame:
    """Patterns (pattern_id, seq, risk_level, consistency) with their tier: the first ``top``
    of critical or high risk with a consistency finding are primary."""
    able = patterns.filter(F.col("risk_level").isin("critical", "high") & F.col("consistency"))
    primary = able.orderBy("seq", "pattern_id").limit(top).select("pattern_id", F.lit("primary").alias("tier"))
    return patterns.join(F.broadcast(primary), "pattern_id", "left").withColumn("tier", F.coalesce("tier", F.lit("secondary")))


def context_top(sources: list[DataFrame], n: int = 5) -> DataFrame:
    """The first ``n`` rows (source, seq, category, ...) of several lists, one list after
    the other."""
    tagged = [s.withColumn("_list", F.lit(k)).orderBy("seq").limit(n) for k, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, tagged).orderBy("_list", "seq").limit(n).drop("_list")


def performance(runs: DataFrame) -> DataFrame:
    """Steps with a runtime, each with its place among them, longest first."""
    timed = runs.filter("runtime_seconds IS NOT NULL")
    return placed(timed, [F.desc("runtime_seconds"), "agent_step"]).withColumn("place", F.col("place").cast("int"))


def visual_queue(clusters: DataFrame, top: int = 20) -> DataFrame:
    """Review tasks VRT-001 and on of the first ``top`` clusters in order of ``seq``; those
    of whole figures have medium priority at most."""
    first = clusters.orderBy("seq").limit(top)
    place = F.row_number().over(Window.orderBy("seq"))
    rank = risk_rank(F.coalesce("risk_level", F.lit("medium")))
    capped = F.when(F.col("quality") == "whole_figure_fallback", F.least(rank, F.lit(2))).otherwise(rank)
    return first.select(F.format_string("VRT-%03d", place).alias("task_id"), "cluster_id", "category", risk_level(capped).alias("priority"), "finding_count", F.coalesce("quality", F.lit("unknown")).alias("quality"))


def ledger_figures(figures: DataFrame) -> DataFrame:
    """One entry per image path (id, path, page, seq): the first that has a page, else the
    first; entries without a path all stay."""
    known = figures.filter("path IS NOT NULL AND path <> ''")
    best = known.groupBy("path").agg(F.min(F.struct(F.col("page").isNull().alias("bare"), "seq", "id", "page")).alias("m"))
    return best.select("m.id", "path", "m.page", "m.seq").unionByName(figures.filter("path IS NULL OR path = ''").select("id", "path", "page", "seq"))


def rule_findings(matches: DataFrame, prefix: str = "paperfraud") -> tuple[DataFrame, DataFrame]:
    """Triggered rules (rule_id, rule_type, severity, title, excerpts) as findings where
    they have excerpts, and as a checklist where they have none."""
    kind = F.coalesce(F.nullif(F.col("rule_type"), F.lit("")), F.lit("methodology_review"))
    risk = F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITY_RISK.items() for x in kv])[F.coalesce("severity", F.lit("yellow"))], F.lit("low"))
    quoted = F.coalesce(F.size("excerpts") > 0, F.lit(False))
    title = F.coalesce("title", "rule_id")
    found = matches.filter(quoted).select(F.concat(F.lit("PF-"), F.regexp_replace("rule_id", "[^A-Za-z0-9_-]+", "-")).alias("finding_id"), F.concat(F.lit(f"{prefix}."), kind).alias("category"), risk.alias("risk_level"), title.alias("summary"), F.size("excerpts").alias("n_excerpts"))
    return found, matches.filter(~quoted).select("rule_id", kind.alias("rule_type"), "severity", title.alias("title"))


def certainty(findings: DataFrame) -> DataFrame:
    """Findings (finding_id, category, risk_level, summary, evidence_refs, explanations)
    with three texts: what was seen, with up to three references; what may explain it, with
    up to two explanations and a reservation; and what to do, risk before category."""
    refs = F.concat_ws(", ", F.slice(F.coalesce("evidence_refs", F.array().cast("array<string>")), 1, 3))
    fact = F.concat(F.coalesce("summary", F.lit("An unusual pattern was found")), F.when(refs != "", F.concat(F.lit(". Evidence: "), refs)).otherwise(""), F.lit("."))
    reasons = F.concat_ws("; ", F.slice(F.coalesce("explanations", F.array().cast("array<string>")), 1, 2))
    inference = F.concat(F.when(reasons != "", F.concat(F.lit("Possible reasons: "), reasons)).otherwise("No harmless explanation is known"), F.lit(". This is an inference, not a verdict."))
    kind = F.lower("category")
    topic = F.when(kind.contains("duplicate"), "repeated rows or columns").when(kind.rlike("offset|fixed"), "the fixed difference or offset").when(kind.rlike("mismatch|inconsisten"), "the data against the statement")
    high = F.col("risk_level").isin("critical", "high")
    suggestion = (
        F.when(high & topic.isNotNull(), F.concat(F.lit("High risk: check "), topic, F.lit(" first and record it.")))
        .when(high, "High risk: have it reviewed first and record it.")
        .when(topic.isNotNull(), F.concat(F.lit("Check "), topic, F.lit(" or explain it.")))
        .when(kind.rlike("missing|completeness"), "Supply the missing data or say why it is missing.")
        .when(F.col("risk_level") == "medium", "Have it reviewed for consistency.")
        .otherwise("Have it reviewed.")
    )
    return findings.select("finding_id", "category", "risk_level", fact.alias("fact"), inference.alias("inference"), suggestion.alias("suggestion"))


def client_report(findings: DataFrame, texts: DataFrame, reviews: DataFrame, details: DataFrame) -> DataFrame:
    """Findings with their certainty texts, the latest review decision and the details that
    exist for their id; a finding without a decision is open."""
    last = latest(reviews.select("finding_id", "seq", "status"), ["finding_id"], ["seq"]).select("finding_id", "status")
    met = findings.join(texts.select("finding_id", "fact"), "finding_id", "left").join(last, "finding_id", "left").join(details.select("finding_id", "detail"), "finding_id", "left")
    return met.withColumn("status", F.coalesce("status", F.lit("open")))


def claims_of_sheets(claims: DataFrame, sheets: DataFrame) -> DataFrame:
    """(workbook, sheet, claim_id): claims (claim_id, refs) one of whose references contains
    the name of a workbook or sheet, in either case. Claims are written by hand: more than
    ``MAX_CLAIMS`` are refused, and the sheets are not moved."""
    if claims.limit(MAX_CLAIMS + 1).count() > MAX_CLAIMS:
        raise ValueError(f"more than {MAX_CLAIMS} claims")
    refs = claims.select("claim_id", F.transform("refs", lambda r: F.lower(r)).alias("refs"))
    named = sheets.select("workbook", "sheet").distinct()
    hit = F.expr("exists(refs, r -> contains(r, lower(workbook)) OR contains(r, lower(sheet)))")
    return named.join(F.broadcast(refs), hit).select("workbook", "sheet", "claim_id")


def measured_columns(findings: DataFrame, types: DataFrame | None) -> DataFrame:
    """Cross-sheet findings (name_l, name_r) of which one column or both are measurements by
    ``types`` (name, type); without types all stay."""
    if types is None:
        return findings
    side = lambda s: types.select(F.col("name").alias(f"name_{s}"), F.lower("type").alias(f"_type_{s}"))
    met = findings.join(side("l"), "name_l", "left").join(side("r"), "name_r", "left")
    return met.filter("_type_l = 'measurement' OR _type_r = 'measurement'").select(findings.columns)


def scan_summary(scans: DataFrame) -> DataFrame:
    """(severity, kind, n, level) of nested lists of findings (array<struct<severity,kind>>
    in ``lists``): counts by severity and kind with their roll-ups; level 3 is the total."""
    rows = scans.select(F.inline(F.flatten("lists")))
    kind, severity = F.coalesce("kind", F.lit("unknown")), F.coalesce("severity", F.lit("low"))
    return rows.select(severity.alias("severity"), kind.alias("kind")).rollup("severity", "kind").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def derived_pages(records: DataFrame, known: DataFrame) -> DataFrame:
    """Pages (page) that records name and that aren't known yet, with ids that go on after
    the known ones."""
    fresh = records.filter("page IS NOT NULL").select("page").distinct().join(known.select("page"), "page", "left_anti")
    before = known.agg(F.count("*").alias("_n"))
    return placed(fresh, ["page"]).crossJoin(F.broadcast(before)).select(F.format_string("page-%04d", F.col("_n") + F.col("place")).alias("id"), "page")


def ledger_index(items: DataFrame) -> DataFrame:
    """(index, key, n, ids) of ledger items (id, type, page, path, line_start, line_end):
    which items have a type, a page, an image path or a markdown line."""
    lines = F.sequence(F.col("line_start"), F.greatest("line_start", F.coalesce("line_end", "line_start")))
    entry = lambda name, key: F.struct(F.lit(name).alias("index"), key.cast("string").alias("key"))
    single = F.array(entry("by_type", F.coalesce("type", F.lit("unknown"))), entry("by_page", F.col("page")), entry("by_image_path", F.col("path")))
    several = F.when(F.col("line_start").isNotNull(), F.transform(lines, lambda k: entry("by_markdown_line", k))).otherwise(F.array().cast("array<struct<index:string,key:string>>"))
    rows = items.select("id", F.inline(F.concat(single, several))).filter("key IS NOT NULL")
    return rows.groupBy("index", "key").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), ",").alias("ids"))


def sheet_briefing(findings: DataFrame, ids: int = 50) -> DataFrame:
    """(workbook, sheet, category, place, n, max_risk, finding_ids): what was found in each
    sheet by category, the most frequent first, with the first ``ids`` finding ids."""
    w = Window.partitionBy("workbook", "sheet", "category").orderBy("finding_id")
    ranked = findings.withColumns({"_rank": risk_rank(F.col("risk_level")), "_k": F.row_number().over(w)})
    some = F.array_join(F.array_sort(F.collect_list(F.when(F.col("_k") <= ids, F.col("finding_id")))), ",")
    by = ranked.groupBy("workbook", "sheet", "category").agg(F.count("*").alias("n"), risk_level(F.max("_rank")).alias("max_risk"), some.alias("finding_ids"))
    place = F.row_number().over(Window.partitionBy("workbook", "sheet").orderBy(F.desc("n"), "category"))
    return by.withColumn("place", place)


def sample_rows(samples: DataFrame, top: int = 50) -> DataFrame:
    """(workbook, sheet, row, sample, total): the rows that findings show (workbook, sheet,
    row, seq, sample), each once as the first finding shows it; the ``top`` first rows of a
    sheet, and how many it has in all."""
    first = samples.filter("row IS NOT NULL").groupBy("workbook", "sheet", "row").agg(F.min_by("sample", "seq").alias("sample"))
    w = Window.partitionBy("workbook", "sheet")
    numbered = first.withColumns({"_k": F.row_number().over(w.orderBy("row")), "total": F.count("*").over(w)})
    return numbered.filter(F.col("_k") <= top).drop("_k")


#: Edges that one task may take to settle the rest of a forest.
SMALL = 100_000


def _settled(live: DataFrame) -> DataFrame:
    """The forest of few edges (a, b, weight, x, y), taken lightest first: an edge stays if
    its vertices x and y aren't connected yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def top(v):
            while (up := above.get(v, v)) != v:
                above[v] = v = above.get(up, up)
            return v

        for batch in batches:
            kept = []
            for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                p, q = top(x), top(y)
                if p != q:
                    above[p] = q
                    kept.append(i)
            yield batch.select(["a", "b", "weight"]).take(pa.array(kept, pa.int64()))

    ordered = live.coalesce(1).sortWithinPartitions("weight", "a", "b")
    return ordered.mapInArrow(run, live.select("a", "b", "weight").schema)


def _roots(chosen: DataFrame, rounds: int) -> DataFrame:
    """(x, root) of vertices x that each point to a neighbour y along their lightest edge.
    Such paths end in two vertices that point to each other, of which the smaller is the
    root; pointers move to their pointer's pointer until nothing changes."""
    back = chosen.select(F.col("x").alias("y"), F.col("y").alias("_back"))
    at = chosen.select("x", "y").join(back, "y").select("x", F.when((F.col("_back") == F.col("x")) & (F.col("x") < F.col("y")), F.col("x")).otherwise(F.col("y")).alias("root"))
    jump = lambda p: p.join(p.select(F.col("x").alias("root"), F.col("root").alias("_far")), "root").select("x", F.col("_far").alias("root"))
    at = checkpointed(at)
    for _ in range(rounds):
        moved = checkpointed(jump(jump(at)).join(at.withColumnRenamed("root", "_old"), "x"))
        at = moved.select("x", "root")
        if moved.filter("root <> _old").isEmpty():
            return at
    raise RuntimeError(f"pointers did not settle in {rounds} rounds")


def spanning_tree(edges: DataFrame, rounds: int = 40, small: int = SMALL) -> DataFrame:
    """(a, b, weight) of a minimum spanning forest of edges (a, b, weight): in each round
    every component takes its lightest edge (the smallest pair in a tie), and components
    that meet become one, of whose edges the lightest between two components stays. The
    last ``small`` edges are settled in one task, lightest first."""
    plain = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").groupBy("a", "b").agg(F.min("weight").alias("weight"))
    live = checkpointed(plain.select("a", "b", "weight", F.col("a").alias("x"), F.col("b").alias("y")))
    tree = []
    for _ in range(rounds):
        if live.count() <= small:
            return reduce(DataFrame.unionByName, [*tree, _settled(live)])
        both = live.unionByName(live.select("a", "b", "weight", F.col("y").alias("x"), F.col("x").alias("y")))
        lightest = both.groupBy("x").agg(F.min(F.struct("weight", "a", "b", "y")).alias("m"))
        chosen = checkpointed(lightest.select("x", "m.y", "m.a", "m.b", "m.weight"))
        tree.append(chosen.select("a", "b", "weight").distinct())
        names = _roots(chosen, rounds)
        name = lambda side: names.select(F.col("x").alias(side), F.col("root").alias(f"_{side}"))
        moved = live.join(name("x"), "x").join(name("y"), "y").filter("_x <> _y")
        lightest = moved.groupBy(F.least("_x", "_y").alias("x"), F.greatest("_x", "_y").alias("y")).agg(F.min(F.struct("weight", "a", "b")).alias("m"))
        live = checkpointed(lightest.select("m.a", "m.b", "m.weight", "x", "y"))
    raise RuntimeError(f"no spanning forest in {rounds} rounds")


def _gray_counts(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """What ``gray_anomalies`` asks of each image; a null among the pixels is a value that
    is near to none."""
    for width, height, pixels in batches:
        rows = []
        for w, h, image in zip(width, height, pixels, strict=True):
            values = np.array([] if image is None else image, float)
            k = np.arange(len(values))
            x, y, bw, bh = k % w, k // w, max(1, w // 10), max(1, h // 10)
            border = (x < bw) | (x >= w - bw) | (y < bh) | (y >= h - bh)
            known, at, counts = np.unique(values, return_inverse=True, return_counts=True)
            edge = np.bincount(at, border, len(known))
            mode = known[edge.argmax()] if len(known) else 0.0
            near = edge[np.abs(known - mode) <= 2].sum()
            rows.append((len(values), np.nansum(values), counts.max(initial=0), edge.sum(), near))
        yield pd.DataFrame(rows, columns=["total", "mass", "most", "edge", "inside"]).astype({"total": "int64", "mass": float, "most": "int64", "edge": "int64", "inside": "int64"})


def gray_anomalies(images: DataFrame) -> DataFrame:
    """(image_id, anomaly_type, severity) of gray images (image_id, width, height, pixels in
    rows): a border of a tenth whose values lie within two of their mode on over 95 %, one
    value on over 80 % of all pixels, a mean over 250 or under 5. An image is counted in its
    row, and its pixels are never rows of their own; of equally frequent values the
    smallest is the mode."""
    counted = F.pandas_udf(_gray_counts, "total long, mass double, most long, edge long, inside long")
    sized = images.filter("width > 0 AND height > 0 AND size(pixels) > 0")
    seen = sized.select("image_id", counted("width", "height", "pixels").alias("c")).select("image_id", "c.*")
    mean = F.col("mass") / F.col("total")
    kinds = F.array(
        F.when(F.col("inside") / F.col("edge") > 0.95, F.struct(F.lit("uniform_border").alias("anomaly_type"), F.lit("high").alias("severity"))),
        F.when(F.col("most") / F.col("total") > 0.8, F.struct(F.lit("globally_uniform").alias("anomaly_type"), F.lit("medium").alias("severity"))),
        F.when((mean > 250) | (mean < 5), F.struct(F.lit("near_solid_color").alias("anomaly_type"), F.lit("high").alias("severity"))),
    )
    return seen.select("image_id", F.inline(F.array_compact(kinds)))


def tile_candidates(tiles: DataFrame, limit: int = 24, top: int = 500) -> tuple[DataFrame, DataFrame]:
    """Tiles (case_id, tile_id, panel_id, rotations) of different panels of one case whose
    rotated hashes come within ``limit`` bits - the ``top`` nearest of each case - and the
    panel pairs they make: least distance, number of tiles, best turn. A case is one paper,
    so the join meets as many tiles as a paper has."""
    side = lambda name: tiles.select("case_id", F.struct("tile_id", "panel_id", "rotations").alias(name))
    met = side("x").join(side("y"), "case_id").filter((F.col("x.tile_id") < F.col("y.tile_id")) & (F.col("x.panel_id") != F.col("y.panel_id")))
    turns = F.flatten(F.transform("x.rotations", lambda a, i: F.transform(F.col("y.rotations"), lambda b, j: F.struct(F.bit_count(a.bitwiseXOR(b)).alias("distance"), (F.pmod(j - i, F.lit(4)) * 90).alias("angle")))))
    scored = met.select("case_id", F.col("x.tile_id").alias("a"), F.col("y.tile_id").alias("b"), F.least("x.panel_id", "y.panel_id").alias("source"), F.greatest("x.panel_id", "y.panel_id").alias("target"), F.array_min(turns).alias("best"))
    near = scored.filter(F.col("best.distance") <= limit).select("case_id", "a", "b", "source", "target", "best.distance", "best.angle")
    ranked = near.withColumn("_k", F.row_number().over(Window.partitionBy("case_id").orderBy("distance", "a", "b"))).filter(F.col("_k") <= top).drop("_k")
    pairs = ranked.groupBy("case_id", "source", "target").agg(F.count("*").alias("n_tiles"), F.min("distance").alias("best_distance"), F.min(F.struct("distance", "a", "b", "angle"))["angle"].alias("best_angle"))
    return ranked, pairs


#: Figure headings and the words that a figure label may have.
FIGURE_HEADING = r"(?i)^#+\s*((?:Extended\s+Data\s+)?Fig(?:ure)?\.?\s*\d+[a-z]?)\s*\|?\s*(.*)"


def legends(lines: DataFrame, id_col: str) -> DataFrame:
    """(id, label, legend): the text below each figure heading of a markdown text (id, line,
    body), its title first, up to the next heading. The last heading of a label counts."""
    w = Window.partitionBy(id_col).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    label = F.regexp_extract("body", FIGURE_HEADING, 1)
    marked = lines.withColumns({"label": label, "is_heading": F.col("body").startswith("#")})
    marked = marked.withColumn("part", F.sum(F.col("is_heading").cast("int")).over(w))
    text = F.when(F.col("is_heading"), F.trim(F.regexp_extract("body", FIGURE_HEADING, 2))).otherwise(F.col("body"))
    parts = marked.withColumn("text", text).groupBy(id_col, "part").agg(F.max("label").alias("label"), F.array_sort(F.collect_list(F.struct("line", "is_heading", "text"))).alias("rows"))
    kept = F.filter("rows", lambda r: ~(r["is_heading"] & (r["text"] == "")))
    body = F.trim(F.array_join(F.transform(kept, lambda r: r["text"]), "\n"))
    found = parts.filter("label <> ''").select(id_col, "part", F.regexp_replace(F.trim("label"), r"\s+", " ").alias("label"), body.alias("legend"))
    return found.groupBy(id_col, "label").agg(F.max_by("legend", "part").alias("legend"))
