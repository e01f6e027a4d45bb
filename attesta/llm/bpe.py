"""BPE encoding and decoding with a tokenization automaton.

The merge list is compiled, on the driver and once, into a deterministic automaton over
tokens. It begins with one state that every base symbol loops on. Merge ``u v -> w`` adds
a gadget: all arcs that read ``u`` are redirected to a copy of their target without its
``v`` arc, and an arc that reads ``w`` is added beside every ``u`` arc, to where ``v`` led.
All arcs with one label share a target, so a state is known by the token read last. A
gadget's cut holds for every token whose right edge was ``u`` and every label whose left
edge was ``v`` when the merge came: an arc that was built before a cut survives it, one
that was to be built later does not, so edges are kept with the rank up to which they
stand. States that lack the same arcs are one row of the transition table, labels that
are lacked by the same states one column, and an arc is one bit.

The automaton accepts exactly one path per word, the one that applying the merges in
order gives. New words of a batch run through the table together, a step for all of them
at a time: from each position, arcs whose label the text spells (a trie in sorted arrays
finds them) are followed if their bit is set; each position is reached by one arc only.
Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import give_back, map_batches, slices, trimmed

#: Words of the per-worker memo; it is emptied when full.
WORD_MEMO = 80_000
#: Characters of memo words at most, by which long words are bounded.
MEMO_CHARS = 2_000_000
#: Bytes of text that are encoded at once; a text counts whole.
AT_ONCE = 4 << 20
#: Words of up to this many bytes run through the table together.
TOGETHER = 64
#: Texts beyond this many characters are split word by word, not into a list.
LONG = 1 << 20
#: Up to U+024F the letters are known ranges, and a table-driven class is faster there.
LATIN = re.compile("[^\\x00-\\x1b\\x20-\\x84\\x86-\\u024f]").search
LATIN_CLASSES = {r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ɏ", r"\p{N}": "0-9²³¹¼½¾"}

#: Letters and numbers of Unicode 17, which the tokenizers library (Unicode
#: 16) doesn't know as such, as hexadecimal ranges.
NEWER = {
    r"\p{L}": "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 "
    "1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F "
    "2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F",
    r"\p{N}": "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6",
}
#: Capitals newer than Python's tables: (first, last, distance to lower case).
CAPITALS = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1),
    (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
]
_LOWER = {c: c + d for a, b, d in CAPITALS for c in range(a, b + 1)} | {0x3A3: 0x3C3}  # sigma: letter by letter, without a word-final form


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class MergeAutomaton:
    """Deterministic tokenization automaton of a merge list, in arrays.

    ``vocab`` maps token strings to ids, ``merges`` lists pairs in order, ``suffix``
    marks the last symbol of a word. Every token must have one derivation; a list that
    builds a token twice raises ``ValueError``.

    ``row`` and ``column`` give a token's row as a state and its column as a label in the
    bit table ``arcs``. ``steps`` and ``nodes`` are the trie of the labels: sorted keys
    node * size + symbol, and the node each leads to; ``token`` is the label that ends at
    a node, or -1.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int32)
        self.last = np.array([vocab[c + suffix] for c in symbols], np.int32)
        size = self.size = max(vocab.values()) + 1
        end = len(merges)
        spelled: dict[int, tuple[int, ...]] = {int(i): (int(i),) for i in {*self.inner, *self.last}}
        #: Right and left edges: (token, rank before which it still stands alone there).
        right: dict[int, tuple[tuple[int, int], ...]] = {i: ((i, end),) for i in spelled}
        left = dict(right)
        cut: dict[int, int] = {}

        def open_arc(a: int, b: int) -> bool:
            for u, limit in right[a]:
                for v, other in left[b]:
                    rank = cut.get(u * size + v)
                    if rank is not None and rank < limit and rank < other:
                        return False
            return True

        for rank, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if u not in spelled or v not in spelled or not open_arc(u, v):
                continue  # no path reads u and then v: the merge never applies
            if w in spelled:
                raise ValueError(f"token {a + b!r} has two derivations")
            spelled[w] = spelled[u] + spelled[v]
            right[w] = ((w, end), *((t, min(r, rank)) for t, r in right[v]))
            left[w] = ((w, end), *((t, min(r, rank + 1)) for t, r in left[u]))  # for "u u", the copy loses its arc first
            cut[u * size + v] = rank
        self._tabulate(right, left, cut)
        self._spell(spelled)

    def _tabulate(self, right: dict, left: dict, cut: dict[int, int]) -> None:
        """Edges and cuts as a bit table of state rows and label columns."""
        size = self.size
        gadgets: dict[int, list[tuple[int, int]]] = {}
        for key, rank in cut.items():  # in order of rank
            gadgets.setdefault(key // size, []).append((rank, key % size))
        seconds = {key % size for key in cut}
        # In the order of their edges from the outside in, rows and columns that lack much
        # of the same lie together, and the table travels in few bytes.
        self.row, rows = self._classes({w: tuple(e for e in edge if e[0] in gadgets) for w, edge in right.items()})
        self.column, columns = self._classes({w: tuple(e for e in edge if e[0] in seconds) for w, edge in left.items()})
        begins: dict[int, list[tuple[int, int]]] = {}
        for edge, column in columns.items():
            for v, limit in edge:
                begins.setdefault(v, []).append((limit, column))
        lost: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for u, found in gadgets.items():
            # The columns each gadget of u cuts, end to end in the order of the gadgets.
            parts = [[c for limit, c in begins[v] if limit > rank] for rank, v in found]
            ends = np.cumsum([0, *map(len, parts)])
            lost[u] = np.array([rank for rank, _ in found]), ends, np.array([c for p in parts for c in p], np.int64)
        self.arcs = np.empty((len(rows), -(-len(columns) // 8)), np.uint8)
        for edge, row in rows.items():
            bits = np.ones(len(columns), bool)
            for u, limit in edge:
                ranks, ends, cols = lost[u]
                bits[cols[: ends[np.searchsorted(ranks, limit)]]] = False
            self.arcs[row] = np.packbits(bits, bitorder="little")

    def _classes(self, edges: dict[int, tuple]) -> tuple[np.ndarray, dict[tuple, int]]:
        """The class of each token by its edge, and the classes."""
        known = {edge: k for k, edge in enumerate(sorted({*edges.values()}, key=lambda edge: edge[::-1]))}
        out = np.zeros(self.size, np.int32)
        for w, edge in edges.items():
            out[w] = known[edge]
        return out, known

    def _spell(self, spelled: dict[int, tuple[int, ...]]) -> None:
        """The trie of the labels in sorted arrays."""
        step: dict[int, int] = {}
        token = [-1]
        for w, path in spelled.items():
            node = 0
            for s in path:
                key = node * self.size + s
                if key not in step:
                    step[key] = len(token)
                    token.append(-1)
                node = step[key]
            token[node] = w
        keys = np.array([*step], np.int64)
        order = np.argsort(keys)
        self.steps, self.nodes = keys[order], np.array([*step.values()], np.int32)[order]
        self.token = np.array(token, np.int32)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of pre-split words, end to end, and how many each has."""
        sizes = np.array([*map(len, words)], np.int64)
        parts: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        counts = np.zeros(len(words), np.int64)
        order = np.argsort(sizes, kind="stable")
        short = order[(sizes[order] > 0) & (sizes[order] <= TOGETHER)]
        for at in range(0, len(short), 8192):
            some = short[at : at + 8192]
            flat, n = self._together([words[i] for i in some.tolist()], sizes[some])
            counts[some] = n
            for i, part in zip(some.tolist(), np.split(flat, np.cumsum(n)[:-1]), strict=True):
                parts[i] = part
        for i in order[sizes[order] > TOGETHER].tolist():
            parts[i] = np.array(self._alone(words[i]), np.int32)
            counts[i] = len(parts[i])
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), counts

    def _together(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(words), int(sizes[-1])
        data = np.zeros((n, width), np.uint8)
        data[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[data].astype(np.int64)
        ends = np.arange(n), sizes - 1
        symbols[ends] = self.last[data[ends]]
        read, came = np.full((n, width + 1), -1, np.int32), np.zeros((n, width + 1), np.int32)
        top = len(self.steps) - 1
        for i in range(width):
            live = np.flatnonzero(sizes > i)
            node, j = np.zeros(len(live), np.int64), i
            state = self.row[read[live, i]] if i else None
            while len(live):
                key = node * self.size + symbols[live, j]
                place = np.minimum(np.searchsorted(self.steps, key), top)
                hit = np.flatnonzero(self.steps[place] == key)
                live, node = live[hit], self.nodes[place[hit]].astype(np.int64)
                state = state[hit] if i else None
                j += 1
                arc = self.token[node]
                fits = (arc >= 0) & (read[live, j] < 0)
                if i:
                    column = self.column[arc]
                    fits &= (self.arcs[state, column >> 3] >> (column & 7) & 1).astype(bool)
                to = live[fits]
                read[to, j], came[to, j] = arc[fits], i
                more = np.flatnonzero(sizes[live] > j)
                live, node = live[more], node[more]
                state = state[more] if i else None
        back, at = [], sizes.copy()
        every = np.arange(n)
        while at.any():
            back.append(np.where(at > 0, read[every, at], -1))
            at = np.where(at > 0, came[every, at], 0)
        path = np.stack(back[::-1], 1)
        real = path >= 0
        return path[real], real.sum(1)

    @property
    def _scalars(self) -> tuple[dict[int, int], list[int], list[int], list[int]]:
        if not hasattr(self, "_kept"):
            self._kept = dict(zip(self.steps.tolist(), self.nodes.tolist(), strict=True)), self.token.tolist(), self.row.tolist(), self.column.tolist()
        return self._kept

    def __getstate__(self) -> dict:
        state = {k: v for k, v in self.__dict__.items() if k != "_kept"}
        return state | {"arcs": (self.arcs.shape, zlib.compress(self.arcs, 6))}

    def __setstate__(self, state: dict) -> None:
        shape, packed = state["arcs"]
        self.__dict__ = state | {"arcs": np.frombuffer(zlib.decompress(packed), np.uint8).reshape(shape)}

    def _alone(self, word: bytes) -> list[int]:
        """The same run for one long word, a position at a time."""
        step, token, row, column = self._scalars
        n, size, arcs = len(word), self.size, self.arcs
        symbols = self.inner[np.frombuffer(word, np.uint8)].tolist()
        symbols[-1] = int(self.last[word[-1]])
        read, came = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            state = row[read[i]]
            node, j = 0, i
            while j < n:
                node = step.get(node * size + symbols[j], -1)
                if node < 0:
                    break
                j += 1
                arc = token[node]
                if arc < 0 or read[j] >= 0:
                    continue
                if not i or arcs[state, column[arc] >> 3] >> (column[arc] & 7) & 1:
                    read[j], came[j] = arc, i
        out = []
        while n:
            out.append(read[n])
            n = came[n]
        return out[::-1]


class Tokenizer:
    """A byte-level BPE file with word ends: normaliser, pre-split and automaton.

    Reads files of the kind ``word_bpe``: NFC, white space runs become one blank, lower
    case, words by pattern, a word-end suffix, added tokens that are matched as they stand,
    and tokens joined by one blank when no decoder is named. Files with anything else that
    bears on ids raise ``ValueError``."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, split, level = spec["model"], *self._pretokenizers(spec)
        steps = [{k: v for k, v in x.items()} for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        if steps != [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}] or spec.get("decoder"):
            raise ValueError("only files with NFC, blank and lower-case steps and no decoder are read")
        if (split.get("behavior"), split.get("invert"), level.get("add_prefix_space"), level.get("use_regex")) != ("Removed", True, False, False):
            raise ValueError("only files that keep what their pattern matches, as bytes, are read")
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain BPE models are read")
        added = spec.get("added_tokens", [])
        if any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only added tokens that are matched as they stand are read")
        self.key = hashlib.sha256(content.encode()).hexdigest()
        self.pattern = split["pattern"]["Regex"]
        vocab = model["vocab"]
        self.automaton = MergeAutomaton(vocab, [tuple(m) for m in model["merges"]], model.get("end_of_word_suffix") or "")
        self.added = {x["content"]: x["id"] for x in added}
        labels = {v: k for k, v in (vocab | self.added).items()}
        #: Labels by id; null for ids that no token has.
        self.labels = pa.array([labels.get(i) for i in range(max(labels) + 1)], pa.string())
        self.top = len(self.labels) - 1

    @staticmethod
    def _pretokenizers(spec: dict) -> list[dict]:
        found = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if [x["type"] for x in found] != ["Split", "ByteLevel"] or "Regex" not in found[0]["pattern"]:
            raise ValueError("only files that split by one pattern into byte-level words are read")
        return found

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The labels of the arcs of each row, joined by one blank; ids that no token has
        emit none. ``flat`` holds the rows' ids end to end, ``counts`` how many each has."""
        known = (flat >= 0) & (flat <= self.top)
        rows = np.repeat(np.arange(len(counts)), counts)[known]
        emitted = self.labels.take(pa.array(flat[known]))
        real = pc.is_valid(emitted).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(rows[real], minlength=len(counts)))])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), emitted.drop_null()), " ")


class Encoder:
    """What a worker keeps of a tokenizer: compiled patterns and the words it has met."""

    def __init__(self, t: Tokenizer):
        self.t = t
        exact, latin = t.pattern, t.pattern
        for name, ranges in NEWER.items():
            newer = "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in ranges.split())
            exact, latin = exact.replace(name, f"[{name}--[{newer}]]"), latin.replace(name, LATIN_CLASSES[name])
        self.pattern = regex.compile(exact, regex.V1)
        self.latin = re.compile(latin) if "\\p" not in latin else None
        self.specials = re.compile("|".join(map(re.escape, sorted(t.added, key=len, reverse=True)))) if t.added else None
        self._empty()

    def _empty(self) -> None:
        """An empty memo; the added tokens take the first places."""
        self.place: dict = {}
        self.fresh: list[str] = []
        self.chars = 0
        ids = [*self.t.added.values()]
        self.special = {k: i for i, k in enumerate(self.t.added)}
        self.flat, self.ends = np.array(ids, np.int32), np.arange(1, len(ids) + 1)

    def _place(self, word: str) -> int:
        """The memo place of a word."""
        found = self.place.get(word)
        if found is None:
            found = self.place[word] = len(self.special) + len(self.place)
            self.fresh.append(word)
            self.chars += len(word)
        return found

    def _words(self, text: str) -> list[int]:
        low = text.lower()
        if self.latin and not LATIN(low):
            pattern = self.latin
        else:
            pattern, low = self.pattern, unicodedata.normalize("NFC", text).translate(_LOWER).lower()
        if len(low) > LONG:
            return [self._place(m[0]) for m in pattern.finditer(low)]
        words = pattern.findall(low)
        found = [*map(self.place.get, words)]
        if None in found:
            return [*map(self._place, words)]
        return found

    def _places(self, text: str) -> list[int]:
        if self.specials is None or not self.specials.search(text):
            return self._words(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += self._words(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._words(text[at:])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of whole texts, end to end, and how many each has; null has none."""
        if len(self.place) > WORD_MEMO or self.chars > MEMO_CHARS:
            self._empty()
        places = [np.array(self._places(t) if t else [], np.int64) for t in texts]
        if self.fresh:
            flat, counts = self.t.automaton.words([w.encode("utf-8", "surrogatepass") for w in self.fresh])
            self.ends = np.concatenate([self.ends, (self.ends[-1] if len(self.ends) else 0) + np.cumsum(counts)])
            self.flat = np.concatenate([self.flat, flat])
            self.fresh = []
        words = np.concatenate(places) if places else np.zeros(0, np.int64)
        ends = self.ends[words]
        sizes = ends - np.where(words > 0, self.ends[words - 1], 0)
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(ends - total[1:], sizes)]
        edges = np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int64)
        return ids, np.diff(total[edges])


class Packed:
    """A compiled tokenizer as the driver keeps and broadcasts it: its tables unfold to
    twenty times as much. Workers get a ``Tokenizer`` when they read it."""

    def __init__(self, t: Tokenizer):
        self.key, self.body = t.key, pickle.dumps(t, pickle.HIGHEST_PROTOCOL)

    def __reduce__(self) -> tuple:
        return pickle.loads, (self.body,)


def tokenizer(content: str) -> Tokenizer:
    """The compiled automaton of a vocabulary."""
    return Tokenizer(content)


@lru_cache(maxsize=2)
def packed(content: str) -> Packed:
    """The compiled automaton of a vocabulary, on the driver, which keeps nothing else of it."""
    found = Packed(tokenizer(content))
    give_back()
    return found


_ENCODERS: dict[str, Encoder] = {}


def encoder(shared: tuple[str, Broadcast]) -> Encoder:
    """The worker's encoder of a shared tokenizer; workers keep one, and load a tokenizer
    only if it is another one."""
    key, broadcast = shared
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(broadcast.value)
    return _ENCODERS[key]


def share(spark: SparkSession, vocabulary: str) -> tuple[str, Broadcast]:
    """The key of a compiled tokenizer, and itself for all workers; its size is that of the
    vocabulary."""
    t = packed(vocabulary)
    return t.key, spark.sparkContext.broadcast(t)


def read_vocabulary(path: str) -> str:
    """The tokenizer file, read on the driver; its size is that of a vocabulary."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every row: the encoding of the whole text,
    and the decoding of these ids. Null and empty texts have no ids and decode to an empty
    string; repeated rows stay repeated; other columns are not read. ``vocabulary`` is the
    content of the tokenizer file, which is compiled once and broadcast."""
    shared = share(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, AT_ONCE) if batch.num_rows else ():
                e = encoder(shared)
                flat, counts = e.encode(part.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.record_batch([part.column(0), ids, e.t.decode(flat, counts)], names=[id_col, "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(trimmed(run), f"`{id_col}` {kind}, ids array<int>, decoded string")


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the arc labels of each row's ids. Null and empty lists give an empty text."""
    shared = share(df.sparkSession, vocabulary)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
        return pa.record_batch([batch.column(0), encoder(shared).t.decode(flat, counts)], names=[id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, ids_col), run, f"`{id_col}` {kind}, text string")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token count and SHA-256 of the ids and of the decoded text, in the JVM."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
