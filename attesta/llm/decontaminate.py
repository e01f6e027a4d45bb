"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents of about ``SHARD_BYTES``. Its words are coded by the
benchmark's vocabulary; a stretch of known words that is shorter than the shortest window cannot
hold one and is left out, which loses nothing. The rest, with separators, is indexed: a suffix
array by prefix doubling, the Burrows-Wheeler transform in a wavelet matrix, and every
16th suffix position. All windows search backwards at once, one wavelet rank per word;
occurrences walk to the next sampled position, and the words they cover merge into spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import cut_spans, map_batches, slices, trimmed

#: Consecutive words of a window; shorter items are one window.
WINDOW = 10
#: Every this many text positions a suffix position is kept.
SAMPLE = 16
#: Bytes of text in a shard; a document counts whole.
SHARD_BYTES = 8 << 20
#: Occurrences that are located at once.
LOCATED = 1 << 20
#: Benchmark characters that are broadcast at once; a larger benchmark goes block by block.
BLOCK_CHARS = 16_000_000

_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")  # a word before folding


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as UTF-8; null has none."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


class _Bits:
    """Bit vector with ranks: packed 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position ``i``."""
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask)


class FMIndex:
    """Index of an array of codes; code 0 separates and is never searched."""

    def __init__(self, text: np.ndarray):
        text = np.append(text + 1, 0).astype(np.int64)  # an end of its own, below the separators
        n = self.n = len(text)
        order = suffix_array(text)
        codes = text[order - 1]
        top = int(text.max()) + 1
        self.start = np.zeros(top + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=top), out=self.start[1:])
        self.levels: list[tuple[int, _Bits, int]] = []
        for shift in range(max(1, (top - 1).bit_length()) - 1, -1, -1):
            bits = ((codes >> shift) & 1).astype(bool)
            self.levels.append((shift, _Bits(bits), int(n - bits.sum())))
            codes = np.concatenate([codes[~bits], codes[bits]])
        sampled = order % SAMPLE == 0
        self.sampled, self.samples = _Bits(sampled), order[sampled]

    def rank(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``code`` among the first ``i`` of the transform."""
        low = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = (code >> shift) & 1
            a, b = bits.rank(low), bits.rank(i)
            low = np.where(one, zeros + a, low - a)
            i = np.where(one, zeros + b, i - b)
        return i - low

    def back(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix that is one position longer."""
        code, low, at = np.zeros_like(i), np.zeros_like(i), i
        for shift, bits, zeros in self.levels:
            one = bits.get(at).astype(np.int64)
            code |= one << shift
            a, b = bits.rank(low), bits.rank(at)
            low = np.where(one, zeros + a, low - a)
            at = np.where(one, zeros + b, at - b)
        return self.start[code] + at - low

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of right-aligned patterns; negative codes occur nowhere."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1]):
            live = np.flatnonzero((lengths > k) & (low < high))
            code = patterns[live, -1 - k]
            known = (code > 0) & (code < len(self.start) - 2)
            high[live[~known]] = 0
            live, code = live[known], code[known] + 1
            base = self.start[code]
            low[live], high[live] = base + self.rank(code, low[live]), base + self.rank(code, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps to sampled ones."""
        out, at, todo = np.zeros_like(rows), rows.copy(), np.arange(len(rows))
        for step in range(SAMPLE):
            found = self.sampled.get(at).astype(bool)
            out[todo[found]] = self.samples[self.sampled.rank(at[found])] + step
            todo, at = todo[~found], at[~found]
            if not len(todo):
                break
            at = self.back(at)
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling, each round a vectorised sort. Past the end comes first."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - width)] = rank[width:]
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        step = np.ones(n, np.int64)
        step[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if width >= n or rank[order[-1]] == n:
            return order
        width *= 2


class _Benchmark:
    """Vocabulary and windows of a block of items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.codes: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            codes = [self.codes.setdefault(w, len(self.codes) + 1) for w in words_of(text)]
            for i in range(max(1, len(codes) - window + 1) if codes else 0):
                found.setdefault(tuple(codes[i : i + window]), set()).add(item)
        self.items = [*found.values()]
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.least = int(self.lengths.min()) if found else 0
        self.patterns = np.full((len(found), window), -1, np.int64)
        for row, w in zip(self.patterns, found, strict=True):
            row[window - len(w) :] = w

    def hits(self, docs: list[np.ndarray]) -> tuple[list[np.ndarray], list[set[str]]]:
        """For the coded words of each document: which are hit, and the items that occur."""
        hit = [np.zeros(len(d), bool) for d in docs]
        items: list[set[str]] = [set() for _ in docs]
        parts, places = [], []
        for k, d in enumerate(docs):
            if not self.least or len(d) < self.least:
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], (d > 0).view(np.int8), [0]])))
            for a, b in zip(edge[::2], edge[1::2], strict=True):
                if b - a >= self.least:
                    parts.append(d[a:b])
                    places.append((k, a))
        if not parts:
            return hit, items
        sizes = np.array([len(p) for p in parts])
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        text = np.zeros(int(sizes.sum()) + len(parts), np.int64)
        for s, p in zip(starts, parts, strict=True):
            text[s : s + len(p)] = p
        index = FMIndex(text)
        low, high = index.search(self.patterns, self.lengths)
        cover = np.zeros(len(text) + 1, np.int64)
        # Rows of all windows end to end, located a bounded number at a time.
        ends = np.cumsum(high - low)
        for first in range(0, int(ends[-1]), LOCATED):
            place = np.arange(first, min(first + LOCATED, int(ends[-1])))
            which = np.searchsorted(ends, place, side="right")
            at = index.locate(high[which] - (ends[which] - place))
            np.add.at(cover, at, 1)
            np.add.at(cover, at + self.lengths[which], -1)
            part = np.searchsorted(starts, at, side="right") - 1
            for p, w in zip(*np.divmod(np.unique(part * len(self.items) + which), len(self.items)), strict=True):
                items[places[p][0]] |= self.items[w]
        covered = np.cumsum(cover)[:-1] > 0
        for s, n, (k, a) in zip(starts, sizes, places, strict=True):
            hit[k][a : a + n] |= covered[s : s + n]
        return hit, items


def _spans(hit: np.ndarray) -> np.ndarray:
    """Flat [start, end, ...] of the stretches of hit words."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).astype(np.int32)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """(id, n_words, n_hit, items array<string>, spans array<struct<start,end>>) of every
    row: words, words inside an occurrence of a window, the ids of the items whose windows
    occur (as sorted strings), and the merged removal spans in code points, end exclusive.

    ``benchmark`` has item_id and text; items without id or words are ignored. It is
    broadcast in blocks of ``BLOCK_CHARS`` characters, and with more than one block the
    documents pass through one search per block. Null and empty texts have no words.
    With ``keep_text`` the text follows as a column of its own; the id may be a struct.
    Repeated rows stay repeated. Nothing is shuffled."""
    spark = docs.sparkSession
    items = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_CHARS))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, text string, words int, hits array<int>, items array<string>"
    out = docs.select(id_col, F.col(text_col).alias("text"), F.lit(0).alias("words"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"))
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(_Benchmark([(r[0], r[1]) for r in rows], window))

        def search(batch: pa.RecordBatch, bench: _Benchmark) -> pa.RecordBatch:
            get, coded = bench.codes.get, []
            for text in batch.column(1):
                coded.append(np.array([*map(get, words_of(text.as_py()), repeat(0))], np.int32))
            hit, found = bench.hits(coded)
            spans, names = [], []
            for h, new, old_spans, old in zip(hit, found, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                for a, b in zip(old_spans[::2], old_spans[1::2], strict=True):
                    h[a:b] = True
                spans.append(_spans(h))
                names.append(sorted(new.union(old)))
            words = pa.array([len(d) for d in coded], pa.int32())
            return pa.record_batch([batch.column(0), batch.column(1), words, pa.array(spans, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))], names=[id_col, "text", "words", "hits", "items"])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, search=search) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 1, SHARD_BYTES) if batch.num_rows else ():
                    yield search(part, shared.value)

        out = out.mapInArrow(trimmed(run), schema)

    def places(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_hit, spans = [], []
        for text, flat in zip(batch.column(1), batch.column(3).to_pylist(), strict=True):
            pairs = [*zip(flat[::2], flat[1::2], strict=True)]
            n_hit.append(sum(b - a for a, b in pairs))
            at = [m.span() for m in _WORD.finditer(text.as_py())] if pairs else []
            spans.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in pairs])
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        columns = [batch.column(0), batch.column(2).cast(pa.int64()), pa.array(n_hit, pa.int64()), batch.column(4), pa.array(spans, kinds)]
        names = [id_col, "n_words", "n_hit", "items", "spans"]
        return pa.record_batch([*columns, batch.column(1)], names=[*names, "text"]) if keep_text else pa.record_batch(columns, names=names)

    return map_batches(out, places, f"`{id_col}` {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>" + ", text string" * keep_text)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and the SHA-256 of the occurring items."""
    return found.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_passages(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, without the spans that hold benchmark
    windows; one of which no word is left goes. Clean rows pass unchanged, and the text
    isn't shuffled."""
    others = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*others).alias("row"), F.col(text_col).alias("text"))
    found = decontaminate(packed, benchmark, "row", "text", window, keep_text=True)
    found = found.filter((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words")))
    text = cut_spans(F.col("text"), F.col("spans"))
    return found.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
