import gc
import hashlib
import json
import pickle
import random
from itertools import chain

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attesta.llm import bpe
from attesta.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(bpe.tokenizer(bpe.read_vocabulary(PATH)))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_automaton_against_merging():
    """Random merge lists: the automaton gives what merging step by step gives."""
    symbols = bpe.byte_symbols()
    for seed in range(60):
        draw = random.Random(seed)
        tokens = [symbols[ord(c)] for c in "abc"]
        vocab = {c: i for i, c in enumerate([*symbols, *(s + "_" for s in symbols)])}
        tokens += [t + "_" for t in tokens]
        merges = []
        for _ in range(draw.randrange(1, 25)):
            a, b = draw.choice(tokens), draw.choice(tokens)
            if a.endswith("_") or a + b in vocab:
                continue
            merges.append((a, b))
            vocab[a + b] = len(vocab)
            tokens.append(a + b)
        automaton = bpe.MergeAutomaton(vocab, merges, "_")
        labels = {i: s for s, i in vocab.items()}
        words = ["".join(draw.choices("abc", k=draw.randrange(1, 14))) for _ in range(150)]
        flat, counts = automaton.words([w.encode() for w in words])
        for word, ids in zip(words, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
            parts = [*word[:-1], word[-1] + "_"]
            for a, b in merges:
                i = 0
                while i < len(parts) - 1:
                    if (parts[i], parts[i + 1]) == (a, b):
                        parts[i : i + 2] = [a + b]
                    i += 1
            assert [labels[i] for i in ids.tolist()] == parts, (merges, word)
            assert [labels[i] for i in automaton._alone(word.encode())] == parts, (merges, word)


def test_random_texts_against_the_library(own, library):
    draw = random.Random(1)
    pool = ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "Σ", "ΑΣ ", "İ", "ﬁ", "é", "\x1c", "\x85", "​", "aaaa", "...", "!!", "²", "٣", "Ⅷ", "\xa0", "\n", "日本", "😀", "ß", "ŉ", "thth", "<|", "_", "'"]
    for _ in range(4000):
        text = "".join(draw.choice(pool) if draw.random() < 0.5 else chr(draw.randrange(32, 0x2FF)) for _ in range(draw.randrange(14)))
        ids = library.encode(text, add_special_tokens=False).ids
        flat, counts = own.encode([text])
        assert flat.tolist() == ids, repr(text)
        assert own.t.decode(flat, counts).to_pylist() == [library.decode(ids, skip_special_tokens=False)]


def test_every_code_point_against_the_library(own, library):
    texts = [f"a{chr(c)}b {chr(c)}" for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(texts), 1 << 16):
        some = texts[at : at + (1 << 16)]
        flat, counts = own.encode(some)
        want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
        assert flat.tolist() == [*chain.from_iterable(want)] and counts.tolist() == [*map(len, want)]


def test_memo_is_emptied_and_long_texts_are_split(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "WORD_MEMO", 50)
    monkeypatch.setattr(bpe, "LONG", 100)
    draw = random.Random(4)
    for _ in range(40):
        texts = [" ".join("".join(draw.choices("aeinthr", k=draw.randrange(1, 90))) for _ in range(draw.randrange(30))) for _ in range(5)]
        flat, counts = own.encode([*texts, None, ""])
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert flat.tolist() == [*chain.from_iterable(want)] and counts.tolist() == [*map(len, want), 0, 0]


def test_files_of_another_shape_are_refused():
    spec = json.loads(bpe.read_vocabulary(PATH))
    for path, value in ((("added_tokens", 0, "lstrip"), True), (("normalizer", "normalizers", 1, "content"), "_"), (("pre_tokenizer", "pretokenizers", 0, "invert"), False), (("model", "dropout"), 0.1)):
        other = json.loads(json.dumps(spec))
        at = other
        for key in path[:-1]:
            at = at[key]
        at[path[-1]] = value
        with pytest.raises(ValueError):
            bpe.Tokenizer(json.dumps(other))


def test_documents_against_the_library(spark, library):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    odd = spark.createDataFrame([(10_001, None), (10_002, ""), (10_003, "a" * 5000), (10_003, "a" * 5000), (None, "x")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd).withColumn("ids", F.lit(1))
    texts = {r.doc_id: r.text or "" for r in both.collect()}
    got = bpe.digests(bpe.encode(both, bpe.read_vocabulary(PATH))).collect()
    assert len(got) == both.count()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))
    encoded = bpe.encode(both.filter("doc_id < 20"), bpe.read_vocabulary(PATH))
    assert encoded.join(bpe.decode(encoded, bpe.read_vocabulary(PATH)), "doc_id").filter("decoded <> text").count() == 0
    assert bpe.encode(both.limit(0), bpe.read_vocabulary(PATH)).count() == 0


def test_driver_keeps_the_tokenizer_packed(spark):
    """The unfolded tables are a tenth of a small driver's memory."""
    alive = lambda: sum(isinstance(x, bpe.MergeAutomaton) for x in gc.get_objects())
    gc.collect()
    before = alive()
    content = bpe.read_vocabulary(PATH) + "\n"  # compiled by no other test
    key, shared = bpe.share(spark, content)
    gc.collect()
    assert alive() == before
    assert len(pickle.dumps(bpe.packed(content))) < 8 << 20
    read = spark.sparkContext.parallelize([0], 1).map(lambda _: type(shared.value).__name__ + shared.value.key).first()
    assert read == "Tokenizer" + key
