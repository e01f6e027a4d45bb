"""Language identification with string kernels.

The kernel of two texts counts the character n-grams of one to three bytes that are
present in both (a blended spectrum of presences) and is normalised by the kernels of
each text with itself. Texts are lower-cased and runs of ASCII characters that are no
letters become one blank; every n-gram of what is left has a cell of its own. Nyström
landmarks turn the kernel into a finite feature map,
one ridge regression per language is solved in it, and documents are scored in batches:
presence rows times landmark columns times weights.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import held_out, map_batches, slices, utf8_of

ORDERS = 3
#: About so many documents of each language are sampled for fitting, by a hash of the id,
#: and so many of all languages together at most.
PER_LANGUAGE = 400
SAMPLE = 8000
#: Landmarks of all languages together; each has two at least.
LANDMARKS = 128
#: Bytes of one text whose n-grams are held at once.
PIECE = 1 << 20
RIDGE = 1e-2
#: Rows of a scoring batch, and presence values that it holds at most.
ROWS = 128
VALUES = 1 << 23
UNKNOWN = "und"

_CODE = np.array([b if 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256)], np.uint8)
_LETTER = re.compile(r"[^\W\d_]").search


def cells_of(data: np.ndarray) -> np.ndarray:
    """The distinct cells of all n-grams of one text's bytes, sorted."""
    code = _CODE[data]
    if len(code) > 1:
        code = code[np.append(True, (code[1:] != 32) | (code[:-1] != 32))]
    # Pieces overlap by what an n-gram reaches across their edge.
    parts = [_grams(code[max(0, at - ORDERS + 1) : at + PIECE].astype(np.int32)) for at in range(0, max(1, len(code)), PIECE)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def _grams(code: np.ndarray) -> np.ndarray:
    out, base, gram = [], 0, code
    for p in range(1, ORDERS + 1):
        if p > 1:
            gram = (gram[:-1] << 8) | code[p - 1 :]
        out.append(gram + base)
        base += 1 << (8 * p)
        if len(code) <= p:
            break
    return np.unique(np.concatenate(out))


@dataclass
class Kernel:
    """``cells`` are those of any landmark, in order, with a row of ``landmarks`` each;
    ``weights`` maps kernel values with the landmarks to one score per language."""

    languages: list[str]
    cells: np.ndarray
    landmarks: np.ndarray
    norms: np.ndarray
    weights: np.ndarray

    def presence(self, cells: np.ndarray) -> np.ndarray:
        """The rows of ``landmarks`` that belong to those of ``cells`` that any has."""
        at = np.searchsorted(self.cells, cells)
        at[at == len(self.cells)] = 0
        return at[self.cells[at] == cells] if len(self.cells) else at[:0]

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        rows = np.zeros((len(texts), len(self.landmarks)), np.float32)
        sizes = np.ones(len(texts))
        for i, data in enumerate(texts):
            cells = cells_of(data)
            if len(cells):
                sizes[i] = len(cells)
                rows[i, self.presence(cells)] = 1
        kernel = (rows @ self.landmarks) / np.sqrt(sizes[:, None] * self.norms[None, :])
        return kernel @ self.weights


def fit(samples: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Kernel:
    """``samples`` are (language, distinct cells). Landmarks are taken in turn from each
    language, two at least. Without samples there are no languages."""
    languages = sorted({s[0] for s in samples})
    landmarks = max(landmarks, 2 * len(languages))
    turns: dict[str, int] = {}
    ranked = []
    for lang, cells in samples:
        ranked.append((turns.setdefault(lang, 0), lang, cells))
        turns[lang] += 1
    chosen = [c for _, _, c in sorted(ranked, key=lambda r: r[:2])[:landmarks]]
    known = np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int32)
    norms = np.array([max(1, len(c)) for c in chosen], float)
    found = Kernel(languages, known, np.zeros((len(known), len(chosen)), np.float32), norms, np.zeros((0, 0)))
    marks = found.landmarks
    for k, c in enumerate(chosen):
        marks[found.presence(c), k] = 1
    kernel = np.zeros((len(samples), len(chosen)))
    for i, (_, c) in enumerate(samples):
        kernel[i] = marks[found.presence(c)].sum(0) / np.sqrt(max(1, len(c)) * norms)
    among = (marks.T @ marks) / np.sqrt(norms[:, None] * norms[None, :]) if chosen else np.zeros((0, 0))
    values, vectors = np.linalg.eigh(among.astype(float)) if chosen else (np.zeros(0), among)
    keep = values > 1e-6 * max(values, default=0)
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = kernel @ root
    target = np.array([[1.0 if s[0] == lang else -1.0 for lang in languages] for s in samples]).reshape(len(samples), len(languages))
    if len(samples):
        found.weights = root @ np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ target)
    return found


def _texts(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    data, offsets = utf8_of(pc.utf8_lower(batch.column(column)))
    return [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Kernel:
    """Fit on a sample of about ``per_language`` documents of each language that aren't
    held out, of fewer where that makes more than ``SAMPLE``. Only their distinct n-gram
    cells come to the driver."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    counts = [(r[0], r[1]) for r in rows.groupBy(lang_col).count().collect()]
    if not counts:
        return fit([])
    per_language = max(2, min(per_language, SAMPLE // len(counts)))
    share = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, min(1.0, per_language / n))])
    order = F.xxhash64(id_col)
    drawn = F.pmod(order, F.lit(1_000_003)) < share[F.col(lang_col)] * 1_000_003

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells = [cells_of(t).astype(np.int32).tobytes() for t in _texts(batch, 0)]
        return pa.record_batch([pa.array(cells, pa.binary()), batch.column(1), batch.column(2)], names=["cells", "lang", "turn"])

    sample = map_batches(rows.filter(drawn).select(text_col, lang_col, order.alias("turn")), run, "cells binary, lang string, turn long")
    found = sample.orderBy("turn", "lang", "cells").limit(2 * per_language * len(counts)).collect()
    return fit([(r.lang, np.frombuffer(bytes(r.cells), np.int32)) for r in found])


def predict(docs: DataFrame, kernel: Kernel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; score is the winner's regression value from
    -1..1 brought to 0..1. Null texts and ones without a letter are ``und`` with score 0,
    as is everything if no language was learned. Repeated rows stay repeated; other
    columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(kernel)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        langs, scores = [], []
        for part in slices(batch, 1):
            texts = _texts(part, 1)
            letters = [bool(_LETTER(t.as_py() or "")) for t in part.column(1)]
            step = max(1, min(ROWS, VALUES // max(1, len(model.landmarks))))
            for at in range(0, len(texts), step):
                some = letters[at : at + step]
                if not model.languages:
                    langs += [UNKNOWN] * len(some)
                    scores += [0.0] * len(some)
                    continue
                values = model.scores(texts[at : at + step])
                best = values.argmax(1)
                top = np.clip((values[np.arange(len(best)), best] + 1) / 2, 0, 1)
                langs += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), some, strict=True)]
                scores += np.where(some, top, 0.0).tolist()
        return pa.record_batch([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score): learns from the rows with a language that aren't
    held out and predicts every row."""
    found = predict(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)
    return found.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
