"""Personal data: strict patterns, and a character BiLSTM with CRF transitions.

The patterns (email, ip, card, phone, each with its check) are always reported. The model
finds what they miss: addresses spelled out (``name at host dot org``), phones without a
plus, cards in unusual groups, addresses with guarded points. It is a small bidirectional
LSTM over characters with a linear-chain CRF, trained in numpy on labelled spans: windows
of sampled texts, where the patterns give the labels, and the same texts with such forms
written into them (``written_forms``), among numbers that are no personal data.

Every text is covered by overlapping windows. Each is decoded on its own (Viterbi), a
character takes its label from the window in which it is most central, and the spans are
read off the whole text. A model span is added where no pattern span overlaps it, its
marginals are sure, and what is left of it without its guards passes its kind's check. No
span passes without a seed: a digit, an ``@``, or an ``at`` that a name and a dot follow.
So the windows over seeds and pattern spans come first, and then those over whatever a
labelled stretch reaches, until every such stretch is whole; the windows left over can't
change a result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import map_batches, slices

KINDS = ("email", "ip", "card", "phone")
WIDTH, STRIDE = 64, 32
#: Windows that the model is fitted on at most, and documents that they come from.
TRAIN_WINDOWS = 6000
TRAIN_DOCS = 1500
EMBED, HIDDEN = 12, 20
STEPS, BATCH, RATE = 500, 64, 0.04
#: Mean marginal that a model span needs.
SURE = 0.9
#: How sure the model is of a pattern span that it confirms.
CONFIRMED = 0.5
#: Windows computed at once.
CHUNK = 2048
#: Characters of text that are searched at once, at least a text.
AT_ONCE = 2 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]|(?i:(?<![a-z])dot(?![a-z]))")
#: What every span that passes its check holds. Guards may stand loosely: more is found.
_SEED = re.compile(r"[0-9@]|(?i:(?<=[\s(\[{])at(?=\s*+(?:[)\]}]\s*+)?[a-z0-9-]++\s*+(?:[(\[{]\s*+)?(?:dot|\.)))")
_CHARS = " @.-+()_%:/,;'\"=\n#[]{}|"
#: Symbols: padding, digits, 26 letters in either case, wide characters, marks, others.
_OTHER = 29 + len(_CHARS)
SYMBOLS = _OTHER + 1


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[-1::-2]]
    even = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def _valid(kind: str, body: str) -> bool:
    """The check of a kind on the text of a match."""
    digits = [c for c in body if c in "0123456789"]
    if kind == "email":
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", body))
    if kind == "ip":
        parts = body.split(".")
        return len(parts) == 4 and all(p and p.strip("0123456789") == "" and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn("".join(digits))
    return 9 <= len(digits) <= 15


_GUARDED_DOT = re.compile(r"(?i)\s*[(\[{]\s*(?:dot|\.)\s*[)\]}]\s*|\s+dot\s+|\s+\.\s+")
_GUARDED_AT = re.compile(r"(?i)\s*[(\[{]\s*(?:at|@)\s*[)\]}]\s*|\s+at\s+|\s+@\s+")


def unguarded(kind: str, body: str) -> bool:
    """The check of a model span: it passes its kind's own once guards and separators that
    the patterns don't know are taken out."""
    if kind == "email":
        return _valid(kind, _GUARDED_DOT.sub(".", _GUARDED_AT.sub("@", body)))
    if kind == "ip":
        return _valid(kind, _GUARDED_DOT.sub(".", body))
    if kind == "card":
        return not re.search(r"[^0-9\x20./_|-]", body) and _valid(kind, body)
    return not re.search(r"[^0-9\x20().+/-]", body) and _valid(kind, body)


def strict_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern matches that pass their check, by kind and start."""
    out, least = [], 0
    at = text.find("@")
    while at >= 0:
        # The leftmost match for this @ begins where its run of local characters does.
        m = _DOMAIN.match(text, at)
        if m:
            start = at
            while start > least and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((0, start, m.end()))
                least = m.end()
        at = text.find("@", max(at + 1, least))
    for k, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        out += [(k, m.start(), m.end()) for m in pattern.finditer(text) if _valid(KINDS[k], m[0])]
    return out


def symbols(text: str) -> np.ndarray:
    """Symbol of each character; 0 is padding."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _SYMBOL[np.minimum(code, 128)]


_SYMBOL = np.full(129, _OTHER, np.int64)
for _i in range(128):
    _c = chr(_i)
    _SYMBOL[_i] = 1 if "0" <= _c <= "9" else 2 + ord(_c.lower()) - 97 if _c.isalpha() else 29 + _CHARS.index(_c) if _c in _CHARS else _OTHER
_SYMBOL[128] = 28


def windows(text: str) -> np.ndarray:
    """Starts of the windows that hold an anchor: a digit, an ``@`` or a lone ``dot``. The
    model is fitted on such windows; what it is asked about, ``_Cover`` tells."""
    last = max(0, -(-(len(text) - WIDTH) // STRIDE))
    found: set[int] = set()
    for m in _ANCHOR.finditer(text):
        high = m.start() // STRIDE
        low = max(0, high - (WIDTH // STRIDE - 1))
        found.update(range(min(low, last), min(high, last) + 1))
    return np.array(sorted(found), np.int64) * STRIDE


def _cut(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.concatenate([values, np.zeros(WIDTH, values.dtype)])
    return padded[starts[:, None] + np.arange(WIDTH)]


@dataclass
class Tagger:
    """Parameters: character embedding, two LSTMs, output layer, CRF transitions."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 3, kind: type = np.float32) -> Tagger:
        draw = np.random.default_rng(seed)
        labels = len(KINDS) + 1
        p = {"embed": draw.normal(0, 0.5, (SYMBOLS, EMBED)), "out": draw.normal(0, 0.3, (2 * HIDDEN, labels)), "bias": np.zeros(labels), "move": np.zeros((labels, labels))}
        # Both directions at once: the first axis tells them apart.
        p |= {"x": draw.normal(0, 0.3, (2, EMBED, 4 * HIDDEN)), "h": draw.normal(0, 0.3, (2, HIDDEN, 4 * HIDDEN)), "c": np.zeros((2, 1, 4 * HIDDEN))}
        return cls({k: v.astype(kind) for k, v in p.items()})

    def _lstm(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states (steps, direction, window, unit) of inputs (steps, direction, ...)."""
        pre = x @ self.p["x"] + self.p["c"]
        h = np.zeros((*x.shape[1:3], HIDDEN), x.dtype)
        c = h
        out, tape = np.empty((*x.shape[:3], HIDDEN), x.dtype), []
        for t in range(len(x)):
            g = pre[t]
            g += h @ self.p["h"]
            gate = 1 / (1 + np.exp(-g[..., : 3 * HIDDEN]))
            i, f, o = gate[..., :HIDDEN], gate[..., HIDDEN : 2 * HIDDEN], gate[..., 2 * HIDDEN :]
            u = np.tanh(g[..., 3 * HIDDEN :])
            before, kept = h, c
            c = f * c + i * u
            s = np.tanh(c)
            h = o * s
            out[t] = h
            tape.append((i, f, o, u, s, kept, before))
        return out, tape

    def emissions(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        x = self.p["embed"][codes.T]
        x = np.stack([x, x[::-1]], 1)
        out, tape = self._lstm(x)
        both = np.concatenate([out[:, 0], out[::-1, 1]], 2)
        return (both @ self.p["out"] + self.p["bias"]).swapaxes(0, 1), (x, both, tape)

    def _lstm_back(self, d: np.ndarray, x: np.ndarray, tape: list, grad: dict) -> np.ndarray:
        dh = np.zeros(d.shape[1:], x.dtype)
        dc = np.zeros_like(dh)
        dpre = np.empty((*x.shape[:3], 4 * HIDDEN), x.dtype)
        back = self.p["h"].swapaxes(1, 2)
        for t in range(len(x) - 1, -1, -1):
            i, f, o, u, s, kept, before = tape[t]
            dh = dh + d[t]
            dc = dc + dh * o * (1 - s * s)
            g = dpre[t]
            g[..., :HIDDEN] = dc * u * i * (1 - i)
            g[..., HIDDEN : 2 * HIDDEN] = dc * kept * f * (1 - f)
            g[..., 2 * HIDDEN : 3 * HIDDEN] = dh * s * o * (1 - o)
            g[..., 3 * HIDDEN :] = dc * i * (1 - u * u)
            grad["h"] += before.swapaxes(1, 2) @ g
            dh = g @ back
            dc = dc * f
        for side in (0, 1):
            flat = dpre[:, side].reshape(-1, 4 * HIDDEN)
            grad["x"][side] += x[:, side].reshape(-1, EMBED).T @ flat
            grad["c"][side] += flat.sum(0)
        return dpre @ self.p["x"].swapaxes(1, 2)

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label marginals by forward-backward, and expected transitions."""
        n, steps, k = e.shape
        move = np.exp(self.p["move"])
        unary = np.exp(e - e.max(2, keepdims=True))
        a, b = np.empty_like(e), np.ones_like(e)
        for t in range(steps):
            v = unary[:, t] if t == 0 else (a[:, t - 1] @ move) * unary[:, t]
            a[:, t] = v / v.sum(1, keepdims=True)
        pairs = np.zeros((k, k), e.dtype)
        for t in range(steps - 2, -1, -1):
            carried = unary[:, t + 1] * b[:, t + 1]
            v = carried @ move.T
            joint = a[:, t, :, None] * move * carried[:, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            b[:, t] = v / v.sum(1, keepdims=True)
        both = a * b
        return both / both.sum(2, keepdims=True), pairs

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        n, steps, k = e.shape
        best, came = e[:, 0], np.empty((n, steps, k), np.int8)
        for t in range(1, steps):
            ways = best[:, :, None] + self.p["move"]
            came[:, t] = ways.argmax(1)
            best = ways.max(1) + e[:, t]
        out = np.empty((n, steps), np.int8)
        out[:, -1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = came[np.arange(n), t, out[:, t]]
        return out

    def fit(self, codes: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 5) -> Tagger:
        """Adam on the CRF likelihood of labelled windows."""
        draw = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        order = np.concatenate([draw.permutation(len(codes)) for _ in range(-(-steps * BATCH // len(codes)))])
        for step in range(1, steps + 1):
            some = order[(step - 1) * BATCH : step * BATCH]
            rate = RATE * (1 - step / (steps + 1))
            c, y = codes[some], labels[some]
            e, (x, both, tape) = self.emissions(c)
            p, pairs = self.marginals(e)
            grad = {k: np.zeros_like(v) for k, v in self.p.items()}
            d = (p - np.eye(p.shape[2], dtype=p.dtype)[y]) / len(some)
            np.add.at(pairs, (y[:, :-1], y[:, 1:]), -1)
            grad["move"] = pairs / len(some)
            d = d.swapaxes(0, 1)
            grad["out"] = both.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, d.shape[2])
            grad["bias"] = d.sum((0, 1))
            dboth = d @ self.p["out"].T
            dx = self._lstm_back(np.stack([dboth[..., :HIDDEN], dboth[::-1, :, HIDDEN:]], 1), x, tape, grad)
            seen = np.eye(SYMBOLS, dtype=dx.dtype)[c.T.ravel()]
            grad["embed"] = seen.T @ (dx[:, 0] + dx[::-1, 1]).reshape(-1, EMBED)
            for k, g in grad.items():
                g = np.clip(g, -5, 5)
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.999 * v2[k] + 0.001 * g * g
                self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def tag(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi labels of windows, and the marginal of each label taken."""
        labels, sure = [], []
        for at in range(0, len(codes), CHUNK):
            e, _ = self.emissions(codes[at : at + CHUNK])
            y = self.viterbi(e)
            p, _ = self.marginals(e)
            labels.append(y)
            sure.append(np.take_along_axis(p, y[:, :, None].astype(int), 2)[:, :, 0])
        return np.concatenate(labels), np.concatenate(sure)


def _bare(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label, marginal and distance to the window's edge of each character, before any."""
    return np.zeros(length, np.int8), np.zeros(length), np.full(length, -1)


def _lay(laid: tuple[np.ndarray, np.ndarray, np.ndarray], starts: np.ndarray, labels: np.ndarray, sure: np.ndarray) -> None:
    """Adds windows: each character follows the one in whose middle it lies nearest."""
    whole, score, centred = laid
    near = np.minimum(np.arange(WIDTH), np.arange(WIDTH)[::-1])
    for s, y, p in zip(starts.tolist(), labels, sure, strict=True):
        n = min(WIDTH, len(whole) - s)
        better = near[:n] > centred[s : s + n]
        at = np.flatnonzero(better) + s
        whole[at], score[at], centred[at] = y[:n][better], p[:n][better], near[:n][better]


def _stretches(whole: np.ndarray, score: np.ndarray) -> list[tuple[int, int, int, float]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], whole, [0]])))
    return [(int(whole[a]) - 1, a, b, float(score[a:b].mean())) for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False) if whole[a]]


def reconcile(length: int, starts: np.ndarray, labels: np.ndarray, sure: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, mean marginal) over a whole text: each character follows the
    window in whose middle it lies nearest."""
    laid = _bare(length)
    _lay(laid, starts, labels, sure)
    return _stretches(*laid[:2])


def _word(draw: random.Random, low: int, high: int, letters: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    return "".join(draw.choices(letters, k=draw.randint(low, high)))


def _with_check_digit(digits: str) -> str:
    return next(digits + d for d in "0123456789" if luhn(digits + d))


def written_forms(draw: random.Random) -> tuple[int, str]:
    """(kind, text) of an invented item in a form that the patterns miss; kind -1 is a
    number or phrase that is no personal data."""
    kind = draw.choice((0, 0, 1, 2, 3, 3, -1, -1, -1))
    number = lambda n: _word(draw, n, n, "0123456789")
    if kind == 0:
        local = _word(draw, 2, 9) + draw.choice(["", "", ".", "_", "-"]).join(["", _word(draw, 1, 6)]) + draw.choice(["", number(2)])
        at, dot = draw.choice([(" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" AT ", " DOT "), ("(at)", "."), (" [at] ", "."), (" @ ", " . "), ("{at}", "{dot}")])
        return kind, local + at + _word(draw, 2, 9) + draw.choice(["", number(1)]) + dot + draw.choice(["com", "org", "net", "de", "fr", "info", _word(draw, 2, 4)])
    if kind == 1:
        guard = draw.choice(["[.]", " . ", "(.)", "[dot]", " dot ", "{.}", " [.] ", "(dot)"])
        return kind, guard.join(str(draw.randint(0, 255)) for _ in range(4))
    if kind == 2:
        digits = _with_check_digit(draw.choice("3456") + number(draw.choice((14, 14, 14, 13))))
        mark = draw.choice([".", "/", "_", "  ", " - ", "|"])
        return kind, mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == 3:
        a, b, c = str(draw.randint(2, 9)) + number(2), number(3), number(4)
        return kind, draw.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a} {b} {c}", f"({a}){b}-{c}", f"00{a[:2]} {b} {c}{a[0]}", f"{a} {b} {c}", f"{a}/{b}-{c}", f"0{a}/{b}{c}"])
    return kind, draw.choice(
        [f"{draw.randint(1900, 2030)}-{number(2)}-{number(2)}", f"{number(2)}:{number(2)}:{number(2)}", f"{draw.randint(1, 20)}.{number(1)}.{number(1)}", f"{number(1)},{number(3)}.{number(2)}", f"{number(3)}-{number(3)}", number(draw.randint(1, 8)),
         number(16), f"{number(2)}.{number(2)} {number(2)}.{number(2)} {number(1)}.{number(3)}", f"{number(2)} {number(2)} {number(2)}", f"look at the {_word(draw, 3, 7)} dot {_word(draw, 3, 7)}", f"v{number(1)}.{number(2)}.{number(1)}", f"{number(40)}", _word(draw, 32, 40, "0123456789abcdef"),
         f"{number(1)}/{number(2)}/{draw.randint(1900, 2030)}", f"dot {number(1)} at {number(2)}", f"{number(3)} x {number(3)} mm", f"the dot at {_word(draw, 2, 8)}"]
    )


def with_written_forms(text: str, seed: int, many: int = 4, stretch: int = 600) -> tuple[str, list[tuple[int, int, int]]]:
    """A stretch of a text with invented items between its words, and the spans (kind,
    start, end) of those that are personal data."""
    draw = random.Random(seed)
    begin = draw.randrange(max(1, len(text) - stretch))
    words = text[begin : begin + stretch].split(" ")
    places = sorted(draw.randrange(len(words) + 1) for _ in range(many))
    out, spans, size = [], [], 0
    for i in range(len(words) + 1):
        for _ in range(places.count(i)):
            kind, item = written_forms(draw)
            mark = draw.choice(["", "", "", ",", ".", ";", ")"]) if kind >= 0 else ""
            out.append(item + mark)
            if kind >= 0:
                spans.append((kind, size, size + len(item)))
            size += len(item + mark) + 1
        if i < len(words):
            out.append(words[i])
            size += len(words[i]) + 1
    return " ".join(out), spans


def _labelled(text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a text and their labels; pattern spans first, ``spans`` over them."""
    labels = np.zeros(len(text), np.int64)
    for kind, a, b in [*reversed(strict_spans(text)), *spans]:
        labels[a:b] = kind + 1
    starts = windows(text)
    return _cut(symbols(text), starts), _cut(labels, starts)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_DOCS, most: int = TRAIN_WINDOWS) -> Tagger:
    """Fit on windows of up to ``limit`` documents that hold a digit or an ``@``, picked by
    a hash of the id, and of a stretch of each with written forms. At most ``most`` windows,
    likewise by a hash, come to the driver."""
    rows = docs.filter(F.col(text_col).rlike("[0-9@]"))
    total = rows.count()
    share = min(1.0, limit / max(1, total))
    turn = F.xxhash64(id_col)
    picked = rows.filter(F.pmod(turn, F.lit(1_000_003)) < share * 1_000_003).select(turn.alias("turn"), F.col(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        turns, codes, labels = [], [], []
        for turn, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for c, y in (_labelled(text.as_py(), []), _labelled(*with_written_forms(text.as_py(), turn))):
                turns += [turn] * len(c)
                codes += [r.astype(np.uint8).tobytes() for r in c]
                labels += [r.astype(np.uint8).tobytes() for r in y]
        return pa.record_batch([pa.array(turns, pa.int64()), pa.array(codes, pa.binary()), pa.array(labels, pa.binary())], names=["turn", "codes", "labels"])

    found = map_batches(picked, run, "turn long, codes binary, labels binary").distinct().orderBy(F.xxhash64("codes", "labels"), "turn").limit(most).collect()
    tagger = Tagger.new()
    if not found:
        tagger.p["bias"][0] = 50.0  # nothing was seen: all is outside
        return tagger
    unpack = lambda name: np.stack([np.frombuffer(bytes(r[name]), np.uint8) for r in found]).astype(np.int64)
    return tagger.fit(unpack("codes"), unpack("labels"))


_NONE = np.zeros((0, WIDTH), np.int8)


class _Cover:
    """The windows of a text that are computed, and what they gave. A block is a stretch of
    ``STRIDE`` characters; it is settled when both windows over it are computed."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]) -> None:
        self.codes = symbols(text).astype(np.uint8)
        self.last = max(0, -(-(len(text) - WIDTH) // STRIDE))
        self.blocks = -(-len(text) // STRIDE)
        self.settled, self.done = np.zeros(self.blocks, bool), np.zeros(self.last + 1, bool)
        self.laid = _bare(len(text))
        found = {m.start() // STRIDE for m in _SEED.finditer(text)}
        for _, start, end in base:
            found.update(range(start // STRIDE, (end - 1) // STRIDE + 1))
        self.wanted = self._over(np.array(sorted(found), np.int64))

    def _over(self, blocks: np.ndarray) -> np.ndarray:
        """Numbers of the windows over ``blocks`` that are not computed yet."""
        self.settled[blocks] = True
        both = np.unique(np.clip(np.concatenate([blocks - 1, blocks]), 0, self.last))
        return both[~self.done[both]]

    def take(self, labels: np.ndarray, sure: np.ndarray) -> None:
        """Takes what the wanted windows gave, and wants the windows over the blocks that
        labelled stretches of settled ones reach."""
        self.done[self.wanted] = True
        _lay(self.laid, self.wanted * STRIDE, labels, sure)
        edge = np.diff(np.concatenate([[False], self.settled, [False]]).astype(np.int8))
        whole = self.laid[0]
        firsts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        before = firsts[(firsts > 0) & (whole[firsts * STRIDE] > 0)] - 1
        after = ends[ends < self.blocks]
        after = after[whole[after * STRIDE - 1] > 0]
        self.wanted = self._over(np.unique(np.concatenate([before, after])))
        if not len(self.wanted) and (len(before) or len(after)):
            self.take(_NONE, _NONE)


def _find(texts: list[str], tagger: Tagger) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], list[float]]]:
    """Pattern spans of each text, model spans added to them, and how sure the model is of
    each pattern span."""
    base = [strict_spans(t) if _ANCHOR.search(t) else [] for t in texts]
    covers = {k: c for k, t in enumerate(texts) if t and len((c := _Cover(t, base[k])).wanted)}
    open_ = [*covers]
    while open_:
        busy = [k for k in open_ if len(covers[k].wanted) <= CHUNK]
        for k in open_:
            if len(covers[k].wanted) > CHUNK:  # a text with many windows goes alone
                covers[k].take(*_tagged(covers[k], tagger))
        if busy:
            labels, sure = tagger.tag(np.concatenate([_cut(covers[k].codes, covers[k].wanted * STRIDE) for k in busy]).astype(np.int64))
            at = 0
            for k in busy:
                n = len(covers[k].wanted)
                covers[k].take(labels[at : at + n], sure[at : at + n])
                at += n
        open_ = [k for k in open_ if len(covers[k].wanted)]
    nothing = lambda b: ([], [0.0] * len(b))
    return [(b, *(_judged(t, c.laid, b) if (c := covers.get(k)) else nothing(b))) for k, (t, b) in enumerate(zip(texts, base, strict=True))]


def _tagged(cover: _Cover, tagger: Tagger) -> tuple[np.ndarray, np.ndarray]:
    """Labels and marginals of one text's wanted windows, cut out and computed by chunks."""
    starts = cover.wanted * STRIDE
    found = [tagger.tag(_cut(cover.codes, starts[at : at + CHUNK]).astype(np.int64)) for at in range(0, len(starts), CHUNK)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _judged(text: str, laid: tuple[np.ndarray, np.ndarray, np.ndarray], base: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int]], list[float]]:
    """The model's spans of one text that are sure, pass their check and touch no pattern
    span; and per pattern span the marginals of its characters that the model gives the
    same kind, over all its characters."""
    taken, kind, weight = np.zeros(len(text), bool), np.zeros(len(text), np.int8), np.zeros(len(text))
    for _, a, b in base:
        taken[a:b] = True
    found = _stretches(*laid[:2])
    for k, a, b, mean in found:
        kind[a:b], weight[a:b] = k + 1, mean
    added = [(k, a, b) for k, a, b, mean in found if mean >= SURE and not taken[a:b].any() and unguarded(KINDS[k], text[a:b])]
    return added, [float(weight[a:b][kind[a:b] == k + 1].sum() / (b - a)) for k, a, b in base]


def find(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, sure, spans) of every row: ``base`` and ``spans`` are arrays of
    struct<kind,start,end> in code points, end exclusive, by kind and start; ``base`` from
    the patterns, ``spans`` with the model's. ``sure`` says of each span of ``base`` how far
    the model takes it for the same kind, from 0 to 1; one it doubts stays a span.
    Null and empty texts have none; repeated rows stay repeated; other columns are not
    read."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda found: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(found)]
        for batch in batches:
            for part in slices(batch, 1, AT_ONCE) if batch.num_rows else ():
                found = _find([t or "" for t in part.column(1).to_pylist()], shared.value)
                base, spans = [pack(b) for b, _, _ in found], [pack(b + extra) for b, extra, _ in found]
                sure = [[x for _, x in sorted(zip(b, scores, strict=True))] for b, _, scores in found]
                yield pa.record_batch([part.column(0), pa.array(base, kinds), pa.array(sure, pa.list_(pa.float64())), pa.array(spans, kinds)], names=[id_col, "base", "sure", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    struct = "array<struct<kind:string,start:int,end:int>>"
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, base {struct}, sure array<double>, spans {struct}")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of the pattern spans, all spans, and ``n_confirmed``: how many
    pattern spans the model is sure of by ``CONFIRMED`` or more. It reads forms and context
    and can't check a Luhn digit, so it seldom confirms cards written in one piece; therefore
    ``personal`` takes any span, confirmed or not."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    confirmed = F.size(F.filter("sure", lambda x: x >= CONFIRMED)).cast("long")
    return found.select(id_col, *[count(k) for k in KINDS], F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"), confirmed.alias("n_confirmed"), (F.size("spans") > 0).alias("personal"))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
