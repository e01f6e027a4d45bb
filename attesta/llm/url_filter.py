"""URL allow and block lists: a trie over reversed host labels, then path segments.

An entry such as ``example.net/en/`` fits its host and all subdomains where the URL's
path starts with the entry's path. Among the entries that fit, the one with the most
host labels wins, then the one with the longest path. Entries for one place - host in
lower case and path - are one entry: allow wins over block, then the spelling that comes
first. Lists within ``TRIE_ENTRIES`` and ``TRIE_BYTES`` are broadcast as a trie; longer
ones are joined on the host suffixes of each URL, with the same results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import map_batches

#: Entries and bytes of a list that is broadcast; beyond it the list is a table and joined.
TRIE_ENTRIES = 100_000
TRIE_BYTES = 8 << 20
#: The verdict where no entry fits.
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class _Node:
    labels: dict[str, _Node] = field(default_factory=dict)
    segments: _Segment | None = None


@dataclass
class _Segment:
    next: dict[str, _Segment] = field(default_factory=dict)
    #: Entries that end inside a segment: prefix of it -> (rule, verdict).
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)
    #: The lengths of these prefixes, longest first.
    sizes: list[int] = field(default_factory=list)


class UrlTrie:
    """Reversed host labels lead to a second trie over path segments. Entries are (host,
    path, rule, verdict), one per place."""

    def __init__(self, entries: list[tuple[str, str, str, str]]):
        self.root = _Node()
        for host, path, rule, verdict in entries:
            node = self.root
            for label in reversed(host.split(".") if host else []):
                node = node.labels.setdefault(label, _Node())
            if node.segments is None:
                node.segments = _Segment()
            *whole, rest = path.split("/")
            at = node.segments
            for segment in whole:
                at = at.next.setdefault(segment, _Segment())
            at.ends[rest] = (rule, verdict)
            at.sizes = sorted({*at.sizes, len(rest)}, reverse=True)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest entry that fits."""
        best, node = None, self.root
        segments = path.split("/")
        for label in [None, *reversed(host.split(".") if host else [])]:
            if label is not None:
                node = node.labels.get(label)
                if node is None:
                    break
            best = self._path(node.segments, segments) or best
        return best

    @staticmethod
    def _path(at: _Segment | None, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            if at is None:
                break
            for size in at.sizes:
                found = at.ends.get(segment[:size])
                if found and len(segment) >= size:
                    best = found
                    break
            at = at.next.get(segment)
        return best


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def places_of(rules: DataFrame) -> DataFrame:
    """(_host, _path, rule, verdict), one row per place: host, A-Z in lower case, and path,
    from the first slash on, of each entry. Rules or verdicts that are null are left out."""
    host = F.translate(F.substring_index("rule", "/", 1), _UPPER, _LOWER)
    path = F.when(F.instr("rule", "/") > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise("")
    first = F.min(F.struct((F.col("verdict") != "allow").alias("blocks"), "rule", "verdict")).alias("m")
    named = rules.select("rule", "verdict").dropna().withColumns({"_host": host, "_path": path})
    return named.groupBy("_host", "_path").agg(first).select("_host", "_path", "m.rule", "m.verdict")


def _by_trie(pages: DataFrame, entries: list[tuple[str, str, str, str]], id_col: str) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(UrlTrie(entries))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        trie = shared.value
        found = [trie.match(h, p) or (None, DEFAULT) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        return pa.record_batch([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], names=[id_col, "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    return map_batches(pages, run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def _by_join(pages: DataFrame, entries: DataFrame, id_col: str) -> DataFrame:
    """URL places (host, path) are judged once each: every host suffix meets the list."""
    urls = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = urls.withColumn("_suffix", F.explode(F.array_distinct(F.concat(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")), F.array(F.lit(""))))))
    fits = suffixes.join(entries, (F.col("_suffix") == F.col("_host")) & F.col("path").startswith(F.col("_path")))
    strength = F.struct(F.length("_host"), F.length("_path"), "rule", "verdict")
    best = fits.groupBy("host", "path").agg(F.max(strength).alias("_best")).select("host", "path", "_best.rule", "_best.verdict")
    judged = pages.join(best, ["host", "path"], "left")
    return judged.select(id_col, "host", "path", "rule", F.coalesce("verdict", F.lit(DEFAULT)).alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", trie_entries: int = TRIE_ENTRIES, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(id, host, path, rule, verdict) of every row. Null URLs and ones without ``://`` have
    an empty host and path, which only an entry without a host can fit; where none fits, rule
    is null and the verdict the default. ``rules`` has rule and verdict ('allow' or 'block');
    its size in entries and bytes decides between the broadcast trie and the join. Repeated
    rows stay repeated; other columns are not read."""
    url = F.col(url_col)
    parts = pages.select(id_col, host_of(url).alias("host"), path_of(url).alias("path"))
    entries = places_of(rules)
    size = entries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("rule")), F.lit(0)).alias("bytes")).first()
    if size["n"] > trie_entries or size["bytes"] > trie_bytes:
        return _by_join(parts, entries, id_col)
    return _by_trie(parts, [tuple(r) for r in entries.collect()], id_col)
