"""Document quality from a linear-chain conditional random field over lines.

Each line has counts over its bytes and words, seen together with those of the lines
before and after it. The field scores "good" against "bad" linearly in these features
and has a weight for each pair of neighbouring labels; it is trained by the gradient of
the conditional likelihood on lines that carry their document's label. A document's
score is the mean of its lines' forward-backward marginals, weighted by line length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import held_out, map_batches, slices, trimmed, utf8_of

#: Labelled documents that the field is fitted on at most, in the order of a hash of the id.
TRAIN_DOCS = 4000
#: Bytes of text whose features are computed at once. A line that is longer counts as
#: several lines of this length.
AT_ONCE = 1 << 20
#: Longer documents are left out of the fitting sample (never out of scoring).
TRAIN_LINES = 256
ROUNDS = 120
RATE = 0.1
DECAY = 1e-3

_CLASSES = ("upper", "lower", "digit", "blank", "pipe", "mark", "stop", "other", "wide")
_CLASS = np.full(256, 7, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 8 if _b >= 0x80 else 0 if "A" <= _c <= "Z" else 1 if "a" <= _c <= "z" else 2 if "0" <= _c <= "9" else 3 if _c in " \t\r\n" else 4 if _c == "|" else 5 if _c in "!?" else 6 if _c in ".,;:'\"-()" else 7
FEATURES = len(_CLASSES) + 7


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: features of each line, its length in bytes and its
    document. A text has one line more than it has line feeds."""
    return _features(*_line_counts(data, offsets))


def features_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``line_features`` of a column of texts; a long text is counted in pieces that end
    with a line wherever they can."""
    data, offsets = utf8_of(column)
    if len(column) > 1 or len(data) <= AT_ONCE:
        return line_features(data, offsets)
    parts = [_line_counts(piece, np.array([0, len(piece)])) for piece in _pieces(data)]
    return _features(*[np.concatenate([p[k] for p in parts], axis=-1) for k in range(6)])


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    while len(data) - at > AT_ONCE:
        feeds = np.flatnonzero(data[at : at + AT_ONCE] == 10)
        end = at + int(feeds[-1]) if len(feeds) else at + AT_ONCE
        yield data[at:end]
        at = end + bool(len(feeds))
    yield data[at:]


def _line_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each line: bytes by class, words, words that stand again one to three words on,
    length, a hash, and the document."""
    n = len(data)
    feeds = np.flatnonzero(data == 10)
    docs = len(offsets) - 1
    starts = np.concatenate([offsets[:-1], feeds + 1])
    doc = np.concatenate([np.arange(docs), np.searchsorted(offsets, feeds, side="right") - 1])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    ends = np.empty_like(starts)
    ends[:-1] = np.where(doc[1:] == doc[:-1], starts[1:] - 1, 0)
    last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True))
    ends[last] = offsets[1:][doc[last]]
    size = ends - starts
    kind = _CLASS[data]

    def per_line(values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total

    counts = np.empty((len(_CLASSES), len(starts)))
    for k in range(len(_CLASSES)):
        total = per_line(kind == k)
        counts[k] = total[ends] - total[starts]
    # Words: stretches without blanks; a text's start also starts a word.
    solid = kind != 3
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begin[inner] |= solid[inner]
    at = np.flatnonzero(begin)
    total = per_line(begin)
    words = total[ends] - total[starts]
    again = np.zeros((3, len(starts)))
    if len(at):
        # A hash of each word: bytes weighted by a power of their place in it.
        index = np.cumsum(begin) - 1
        place = np.arange(n) - at[np.maximum(index, 0)]
        power = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
        value = (data.astype(np.uint64) + np.uint64(1)) * power[place & 63] * solid
        hashes = np.add.reduceat(value, at)
        first, end = total[starts], total[ends]
        for lag in (1, 2, 3):
            same = np.zeros(len(at), bool)
            same[lag:] = hashes[lag:] == hashes[:-lag]
            repeats = per_line(same)
            low = np.minimum(first + lag, end)
            again[lag - 1] = repeats[end] - repeats[low]
        whole = np.zeros(len(at) + 1, np.uint64)
        np.cumsum(hashes, out=whole[1:])
        line = whole[end] - whole[first]
    else:
        line = np.zeros(len(starts), np.uint64)
    return counts, words, again, size, line, doc


def _features(counts: np.ndarray, words: np.ndarray, again: np.ndarray, size: np.ndarray, line: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    # Lines that stood earlier in the same document.
    order = np.lexsort((np.arange(len(doc)), line, doc))
    seen = np.zeros(len(doc), bool)
    seen[order[1:]] = (line[order[1:]] == line[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]]) & (words[order[1:]] > 0)
    length = np.maximum(size, 1)
    share = counts / length
    share[1] = counts[0] / np.maximum(counts[0] + counts[1], 1)  # capitals among letters
    many = np.maximum(words, 1)
    out = np.vstack([share, again / many, seen[None, :], np.log1p(size)[None, :] / 5, (size / many)[None, :].clip(0, 30) / 10, (words == 0)[None, :]])
    return out.T.astype(np.float32), size, doc


def with_neighbours(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Features of each line, of the one before and of the one after; zeros at the ends."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    same = (doc[1:] == doc[:-1])[:, None]
    before[1:] = x[:-1] * same
    after[:-1] = x[1:] * same
    return np.hstack([x, before, after, np.ones((len(x), 1), x.dtype)])


@dataclass
class Field:
    """``center`` and ``scale`` of the features, their ``weights``, and the scores of
    neighbouring labels, ``pairs[a, b]``."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    pairs: np.ndarray

    def score(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return with_neighbours((x - self.center) / self.scale, doc) @ self.weights


def marginals(score: np.ndarray, doc: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each line is good, and expected counts of neighbouring labels."""
    n = len(score)
    emit = np.empty((n, 2))
    emit[:, 1] = 1 / (1 + np.exp(-score.clip(-30, 30)))
    emit[:, 0] = 1 - emit[:, 1]
    move = np.exp(pairs)
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    count = np.diff(np.append(first, n))
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    live = np.searchsorted(-count, -np.arange(count[0] + 1), side="left")  # documents with over t lines
    alpha, beta = np.empty((n, 2)), np.empty((n, 2))
    for t in range(count[0]):
        at = first[: live[t]] + t
        a = emit[at] if t == 0 else (alpha[at - 1] @ move) * emit[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(count[0] - 1, -1, -1):
        at = first[: live[t]] + t
        b = np.ones((len(at), 2))
        go = live[t + 1]
        if go:
            nxt = at[:go] + 1
            carried = emit[nxt] * beta[nxt]
            b[:go] = carried @ move.T
            joint = alpha[at[:go], :, None] * move * carried[:, None, :]
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        beta[at] = b / b.sum(1, keepdims=True)
    both = alpha * beta
    return both[:, 1] / both.sum(1), expected


def fit(x: np.ndarray, doc: np.ndarray, label: np.ndarray, rounds: int = ROUNDS) -> Field:
    """Gradient ascent (Adam) on the mean log-likelihood; ``label`` is each line's 0 or 1.
    Without lines every score is a half; with one class, the prior decides."""
    width = FEATURES
    if not len(x):
        return Field(np.zeros(width), np.ones(width), np.zeros(3 * width + 1), np.zeros((2, 2)))
    center, scale = x.mean(0), x.std(0) + 1e-2
    z = with_neighbours(((x - center) / scale).astype(np.float64), doc)
    weights, pairs = np.zeros(z.shape[1]), np.zeros((2, 2))
    same = doc[1:] == doc[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[:-1][same], label[1:][same]), 1)
    m = [np.zeros_like(weights), np.zeros_like(pairs)]
    v = [np.zeros_like(weights), np.zeros_like(pairs)]
    for k in range(1, rounds + 1):
        p, expected = marginals(z @ weights, doc, pairs)
        gradients = [z.T @ (label - p) / len(z) - DECAY * weights, (seen - expected) / len(z) - DECAY * pairs]
        for i, (g, value) in enumerate(zip(gradients, (weights, pairs), strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            value += RATE * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
    return Field(center, scale, weights, pairs)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = TRAIN_DOCS) -> Field:
    """Fit the field on up to ``limit`` labelled documents that aren't held out. Labels are
    picked by a hash of the id; ids with more than one label take the smallest. The picked
    ids are broadcast (at most ``limit``), and only line features come to the driver."""
    rows = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    picked = rows.groupBy(id_col).agg(F.min(label_col).cast("int").alias("_label")).orderBy(F.xxhash64(id_col), id_col).limit(limit)
    sample = docs.select(id_col, text_col).join(F.broadcast(picked), id_col).select(text_col, "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, AT_ONCE) if batch.num_rows else ():
                x, size, doc = features_of(part.column(0))
                lines = np.bincount(doc, minlength=part.num_rows)
                short = (lines <= TRAIN_LINES).tolist()
                bounds = np.concatenate([[0], np.cumsum(lines)])
                flat = [x[a:b].ravel().tobytes() if keep else None for a, b, keep in zip(bounds, bounds[1:], short, strict=False)]
                yield pa.record_batch([pa.array(flat, pa.binary()), part.column(1)], names=["x", "label"])

    # Ids that stand in several rows may bring more than ``limit`` texts; each counts once.
    found = sample.mapInArrow(trimmed(run), "x binary, label int").filter("x IS NOT NULL").distinct().orderBy(F.xxhash64("x", "label"), "x").limit(2 * limit).collect()
    found = sorted((bytes(r.x), r.label) for r in found)
    parts = [np.frombuffer(r[0], np.float32).reshape(-1, FEATURES) for r in found]
    if not parts:
        return fit(np.zeros((0, FEATURES), np.float32), np.zeros(0, int), np.zeros(0, int))
    sizes = [len(p) for p in parts]
    return fit(np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes), np.repeat([r[1] for r in found], sizes))


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, lines, good_lines) of every row: the length-weighted mean of the lines'
    probabilities to be good, the number of lines and of those likelier good than bad.
    Null and empty texts are one empty line; repeated rows stay repeated; other columns
    are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores, lines, good = [], [], []
        for part in slices(batch, 1, AT_ONCE):
            x, size, doc = features_of(part.column(1))
            p, _ = marginals(shared.value.score(x, doc), doc, shared.value.pairs)
            weight = size + 1.0
            n = part.num_rows
            scores.append(np.bincount(doc, weight * p, n) / np.bincount(doc, weight, n))
            lines.append(np.bincount(doc, minlength=n))
            good.append(np.bincount(doc, p >= 0.5, n).astype(np.int64))
        return pa.record_batch([batch.column(0), *[pa.array(np.concatenate(c)) for c in (scores, lines, good)]], names=[id_col, "score", "lines", "good_lines"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, score double, lines long, good_lines long")


def keep_good(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The rows whose document scores a half or more, with all their columns. The text
    isn't shuffled: rows pass through the scoring task."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, place, AT_ONCE) if batch.num_rows else ():
                x, size, doc = features_of(part.column(place))
                p, _ = marginals(shared.value.score(x, doc), doc, shared.value.pairs)
                n = part.num_rows
                good = np.bincount(doc, (size + 1.0) * p, n) >= 0.5 * np.bincount(doc, size + 1.0, n)
                yield part.filter(pa.array(good))

    return docs.mapInArrow(trimmed(run), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted, lines, good_lines): fits on the labelled rows that
    aren't held out and scores every row; predicted is 1 from a half on."""
    scored = score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "lines", "good_lines")
