"""Chroma audio fingerprints and their alignment.

Samples become overlapping frames, frames become the energies of the twelve pitch
classes, and an integral image over (frame, pitch class) gives the sum of any rectangle
in four reads. Sixteen filters compare two parts of a rectangle that slides over time;
each answer is quantised to two Gray-coded bits, so every step yields one 32-bit integer.

Every integer of a recording is a landmark. Two landmarks meet where at most ``NEAR`` of
their bits differ, and vote for the difference of their places. A match has at most the
share ``ERRORS`` of differing bits, so that places with over ``NEAR`` of them can't be all:
at least the share ``VOTES`` of its overlap votes for its offset. Every offset with so many
votes is tried, and the least share of differing bits over the overlap decides; none is
lost. Near landmarks share one of ten keys of 18 to 21 bits: of five parts of their bits,
three are equal. Recordings are dealt out into blocks, and each block of queries meets each
block of recordings in a group of its own, so that no key meets in one task, however
common. Recordings with equal fingerprints are one class and are matched once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from attesta.llm.common import cut, map_batches

RATE = 2000
FRAME, HOP = 512, 128
#: Lowest and highest pitch that counts, in hertz.
LOW, HIGH = 100.0, 950.0
#: (filter kind, first pitch class, pitch classes, frames), one per pair of bits.
FILTERS = [(k % 5, (5 * k) % (13 - h), h, w) for k, (h, w) in enumerate((h, w) for w in (16, 12, 8, 4) for h in (12, 6, 4, 8))]
#: A filter's answer is cut at minus this, zero and this.
CUT = 0.25
_GRAY = np.array([0, 1, 3, 2], np.uint32)

#: Steps of overlap, and share of differing bits of a match.
OVERLAP, ERRORS = 24, 0.08
#: Differing bits of landmarks that meet: some place of a match has no more of them.
NEAR = int(32 * ERRORS)
#: Share of a match's places that have at most so many, as each of the others has more.
VOTES = 1 - 32 * ERRORS / (NEAR + 1)
#: Bits of the keys: all but ``NEAR`` of ``NEAR`` + 3 parts.
_MASKS = np.array([sum(1 << b for b in range(32) if b % (NEAR + 3) in kept) for kept in combinations(range(NEAR + 3), 3)], np.uint32)
#: Integers of recordings in a block, and pairs of landmarks compared at once; a recording
#: and a landmark count whole.
CROWD, AT_ONCE = 1 << 16, 1 << 20
#: Every row whose id is a multiple of this is a query.
QUERY_STEP = 50


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Energies of the pitch classes per frame, each frame of length one or all zero."""
    count = (len(samples) - FRAME) // HOP + 1
    if count < 1:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP]
    energy = np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=1)) ** 2
    pitch = np.fft.rfftfreq(FRAME, 1 / rate)
    used = np.flatnonzero((pitch >= LOW) & (pitch <= HIGH))
    bins = np.zeros((len(pitch), 12))
    bins[used, np.round(12 * np.log2(pitch[used] / 440.0)).astype(int) % 12] = 1
    out = energy @ bins
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return np.where(norm > 1e-6, out / np.maximum(norm, 1e-6), 0)


def integers(image: np.ndarray) -> np.ndarray:
    """The packed fingerprint of a chroma image; empty if it is shorter than a filter."""
    widest = max(f[3] for f in FILTERS)
    n = len(image) - widest + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return total[at + t1, y1] - total[at + t0, y1] - total[at + t1, y0] + total[at + t0, y0]

    packed = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        whole = area(0, w, y, y + h)
        if kind == 0:  # lower against upper pitch classes
            a = area(0, w, y, y + h // 2)
        elif kind == 1:  # earlier against later frames
            a = area(0, w // 2, y, y + h)
        elif kind == 2:  # the two diagonals
            a = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
        elif kind == 3:  # the middle pitch classes against the outer ones
            a = area(0, w, y + h // 4, y + h - h // 4)
        else:  # the middle frames against the outer ones
            a = area(w // 4, w - w // 4, y, y + h)
        answer = np.log((1 + a) / (1 + whole - a))
        packed = (packed << np.uint32(2)) | _GRAY[np.searchsorted([-CUT, 0.0, CUT], answer, side="right")]
    return packed


def fingerprint(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    return integers(chroma(samples, rate))


def pcm16(data: bytes | None) -> np.ndarray:
    """Samples of little-endian 16-bit mono audio; null has none."""
    return np.frombuffer(data or b"", "<i2", len(data or b"") // 2).astype(np.float32) / 32768


def tones(vector: list[float] | None, length: int = 256, rate: int = RATE) -> np.ndarray:
    """A recording made from a vector: a note per component, at the pitch class of the
    largest among twelve scattered components, with that of the smallest below it."""
    v = np.array([x if x is not None and np.isfinite(x) else 0.0 for x in vector or []])
    if not len(v):
        return np.zeros(0, np.float32)
    view = v[(17 * np.arange(len(v))[:, None] + np.arange(12) * (3 * np.arange(12) + 5)) % len(v)]
    t = np.arange(length) / rate
    wave = lambda pc: np.sin(2 * np.pi * 220.0 * 2 ** (pc[:, None] / 12) * t)
    return (wave(view.argmax(1)) + 0.5 * wave(view.argmin(1))).ravel().astype(np.float32)


#: Strengths of the noise over cuts.
NOISE = (0.02, 0.1, 0.2, 0.3)


def cut_or_own(media: dict) -> np.ndarray:
    """The tones of ``embedding``, or where there is one before it a cut of the tones of
    ``before`` under noise; place, length and noise are drawn by ``seed``."""
    if media["before"] is None:
        return tones(media["embedding"])
    draw, whole = np.random.default_rng(abs(media["seed"] or 0)), tones(media["before"])
    part = whole[HOP * int(draw.integers(20)) :][: HOP * int(draw.integers(60, 110))]
    return part + draw.choice(NOISE) * draw.normal(size=len(part)).astype(np.float32)


def fingerprints(df: DataFrame, id_col: str, media_col: str, decode: Callable[..., np.ndarray] = pcm16) -> DataFrame:
    """(id, fp array<int>) of every row; ``decode`` turns a value of the media column into
    samples. Null, empty and too short recordings have an empty fingerprint."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(decode(x.as_py())).view(np.int32) for x in batch.column(1)]
        return pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=[id_col, "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, media_col), run, f"`{id_col}` {kind}, fp array<int>")


class _Block:
    """The landmarks of a block's recordings: of equal integers in a row one, with its first
    and last place."""

    def __init__(self, prints: pa.ChunkedArray) -> None:
        found = [p.values.to_numpy().view(np.uint32) for p in prints]
        self.sizes = np.array([*map(len, found)], np.int64)
        flat = np.concatenate(found)
        own = np.repeat(np.arange(len(found)), self.sizes)
        fresh = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (own[1:] != own[:-1])]))
        self.value, self.own = flat[fresh], own[fresh]
        self.first = fresh - (np.cumsum(self.sizes) - self.sizes)[self.own]
        self.last = self.first + np.diff(np.append(fresh, len(flat))) - 1


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts`` its index so many times, and the turns."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - (np.cumsum(counts) - counts)[which]


def _parts(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of ``counts`` that sum to about ``AT_ONCE``, at least one each."""
    turn = np.cumsum(counts) // AT_ONCE
    bounds = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(counts)]
    return zip(bounds, bounds[1:], strict=False)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def _votes(asked: _Block, marks: _Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, recording, offset) by their places in the blocks, of all offsets with enough
    votes for a match."""
    tables = []
    for mask in _MASKS:
        order = np.argsort(marks.value & mask, kind="stable")
        held, wanted = (marks.value & mask)[order], asked.value & mask
        low = np.searchsorted(held, wanted)
        tables.append((order, low, np.searchsorted(held, wanted, "right") - low))
    met = np.bincount(asked.own, sum(n for _, _, n in tables), len(asked.sizes)).astype(np.int64)
    left, span = int(asked.sizes.max()), int(asked.sizes.max() + marks.sizes.max())
    for start, end in _parts(met):
        some = slice(*np.searchsorted(asked.own, [start, end]))
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (order, low, n) in enumerate(tables):
            for a, b in _parts(n[some]):
                a, b = a + some.start, b + some.start
                i, turn = _spread(n[a:b])
                i, j = i + a, order[low[a:b][i] + turn]
                apart = asked.value[i] ^ marks.value[j]
                near = np.flatnonzero(np.bitwise_count(apart) <= NEAR)
                # Of the keys that two landmarks share, the first counts.
                near = near[np.all(apart[near, None] & _MASKS[:k], axis=1)]
                i, j = i[near], j[near]
                lowest = marks.first[j] - asked.last[i]
                width = marks.last[j] - asked.first[i] - lowest + 1
                for c, d in _parts(width):
                    which, turn = _spread(width[c:d])
                    p, q, offset = i[c:d][which], j[c:d][which], lowest[c:d][which] + turn
                    places = np.minimum(asked.last[p], marks.last[q] - offset) - np.maximum(asked.first[p], marks.first[q] - offset) + 1
                    one = _summed([(asked.own[p] * len(marks.sizes) + marks.own[q]) * span + offset + left], [places])
                    keys.append(one[0])
                    counts.append(one[1])
        key, count = _summed(keys, counts)
        pair, offset = key // span, key % span - left
        query, other = pair // len(marks.sizes), pair % len(marks.sizes)
        overlap = np.minimum(asked.sizes[query], marks.sizes[other] - offset) - np.maximum(0, -offset)
        enough = (overlap >= OVERLAP) & (count >= VOTES * overlap - 1e-6)
        yield query[enough], other[enough], offset[enough]


def _blocks(prints: DataFrame, crowd: int | None) -> int:
    whole = prints.agg(F.sum(F.size("fp")), F.count("*")).first()
    return max(1, min(-(-(whole[0] or 0) // crowd), whole[1])) if crowd else 1


def match(prints: DataFrame, queries: DataFrame, crowd: int | None = CROWD) -> DataFrame:
    """(query, id, offset, overlap, bit_error): recordings of ``prints`` (id, fp) that align
    with one of ``queries`` (id, fp), all of them. Place p of the query is place p + offset of
    the other. Blocks hold about ``crowd`` integers, or all; they change no result."""
    prints, queries = (x.filter(F.size("fp") > 0).select("id", "fp") for x in (prints, queries))
    many, asking = _blocks(prints, crowd), _blocks(queries, crowd)
    kind = prints.schema["id"].dataType.simpleString()

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = [left.schema.field("id").type, right.schema.field("id").type, pa.int32()]
        parts = []
        if left.num_rows and right.num_rows:
            for query, other, offset in _votes(_Block(left["fp"]), _Block(right["fp"])):
                parts.append([left["id"].take(pa.array(query)), right["id"].take(pa.array(other)), pa.array(offset, pa.int32())])
        names = ["query", "id", "offset"]
        empty = pa.table([pa.array([], k) for k in kinds], names=names)
        return pa.concat_tables([empty, *(pa.table(p, names=names) for p in parts)])

    asked = dealt(queries, "_from", asking, "_to", many).groupBy("_from", "_to")
    marks = dealt(prints, "_to", many, "_from", asking).groupBy("_from", "_to")
    pairs = asked.cogroup(marks).applyInArrow(meet, f"query {kind}, id {kind}, offset int")
    pairs = pairs.filter("query <> id").groupBy("query", "id").agg(F.collect_set("offset").alias("offsets"))
    both = pairs.join(queries.select(F.col("id").alias("query"), F.col("fp").alias("a")), "query").join(prints.select("id", F.col("fp").alias("b")), "id")

    def tried(offset: Column) -> Column:
        start = F.greatest(F.lit(0), -offset)
        overlap = F.least(F.size("a"), F.size("b") - offset) - start
        wrong = F.zip_with(F.slice("a", start + 1, overlap), F.slice("b", start + offset + 1, overlap), lambda x, y: F.bit_count(x.bitwiseXOR(y).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))
        errors = F.aggregate(wrong, F.lit(0), lambda acc, x: acc + x) / (overlap * 32)
        return F.when(overlap >= OVERLAP, F.struct(errors.alias("bit_error"), offset.alias("offset"), overlap.alias("overlap")))

    best = F.array_min(F.array_compact(F.transform("offsets", tried)))
    scored = both.select("query", "id", best.alias("best"))
    return scored.filter(F.col("best.bit_error") <= ERRORS).select("query", "id", "best.offset", "best.overlap", "best.bit_error")


def align(df: DataFrame, id_col: str, media_col: str, decode: Callable[..., np.ndarray] = pcm16, step: int = QUERY_STEP, crowd: int | None = CROWD) -> DataFrame:
    """Membership and matches of recordings, as (id, match_id, kind, offset, overlap,
    bit_error). A 'member' row for every input row names its class: the smallest id with
    the same fingerprint. A 'match' row aligns the class of a query - an id that is a
    multiple of ``step``, or for ids that are no numbers a hash that is - with another class. Rows without a fingerprint are their own
    members and match nothing; repeated rows stay repeated; null ids only appear as
    members. Other columns are not read."""
    prints = cut(fingerprints(df, id_col, media_col, decode).withColumnRenamed(id_col, "id").withColumn("sha", F.sha2(F.array_join("fp", ","), 256)))
    numeric = isinstance(df.schema[id_col].dataType, NumericType)
    asked = F.max((F.col("id") if numeric else F.xxhash64("id")) % step == 0)
    classes = cut(prints.filter("size(fp) > 0").groupBy("sha").agg(F.min("id").alias("id"), F.first("fp").alias("fp"), asked.alias("asked")).filter("id IS NOT NULL"))
    found = match(classes.select("id", "fp"), classes.filter("asked").select("id", "fp"), crowd)
    matched = found.select(F.col("query").alias(id_col), F.col("id").alias("match_id"), F.lit("match").alias("kind"), "offset", "overlap", "bit_error")
    named = prints.select("id", "sha", F.size("fp").alias("n")).join(classes.select("sha", F.col("id").alias("class")), "sha", "left")
    members = named.select(F.col("id").alias(id_col), F.coalesce("class", "id").alias("match_id"), F.lit("member").alias("kind"), F.lit(0).alias("offset"), F.col("n").alias("overlap"), F.lit(0.0).alias("bit_error"))
    return members.unionByName(matched)
