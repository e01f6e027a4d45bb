import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attesta.llm import bpe, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
END = 49407


def brute(tokens, separator):
    out, start = [], 0
    for i, t in enumerate(tokens):
        if t == separator:
            out.append((start, i - start))
            start = i + 1
    return out


@pytest.mark.parametrize(("block", "dtype"), [(5, "<u2"), (1, "<u4"), (1000, "<u2")])
def test_counts_against_a_loop(spark, tmp_path, block, dtype):
    draw = random.Random(block)
    want = {}
    for k in range(6):
        tokens = draw.choices([0, 1, 2, 9], weights=[5, 5, 5, draw.choice([0, 1, 9])], k=draw.choice([0, 1, 37, 200]))
        np.array(tokens, dtype).tofile(tmp_path / f"f{k}.tokens")
        want |= {(f"f{k}.tokens", p): x for p, x in enumerate(brute(tokens, 9))}
    scanned = token_files.scan_blocks(token_files.list_blocks(spark, str(tmp_path), dtype, block), str(tmp_path), 9, dtype)
    got = token_files.stitch(scanned, group=3).collect()
    assert {(r.file, r.place): (r.start, r.n_tokens) for r in got} == want
    assert len(got) == len(want)


def test_no_files(spark, tmp_path):
    assert token_files.count_tokens(spark, str(tmp_path / "none"), 9).count() == 0


def test_documents_against_the_library(spark):
    library = Tokenizer.from_file(PATH)
    texts = ["Hello there", None, "", "x " * 30_000, "été ~ 12", "Hello there"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "null id")], "doc_id long, text string").withColumn("file", F.lit(1))
    got = {r.doc_id: r.n_tokens for r in token_files.count_documents(docs, bpe.read_vocabulary(PATH), END, block=100).collect()}
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in [*enumerate(texts), (None, "null id")]}
    assert got == want
    assert token_files.count_documents(docs.limit(0), bpe.read_vocabulary(PATH), END).count() == 0


def test_separator_inside_a_text(spark):
    library = Tokenizer.from_file(PATH)
    texts = ["before", "one <|endoftext|> two three", "<|endoftext|>", "after that", None, "<|endoftext|><|endoftext|> x", "last of all words"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)
    for block in (3, 1000):
        got = {r.doc_id: r.n_tokens for r in token_files.count_documents(docs, bpe.read_vocabulary(PATH), END, block=block).collect()}
        assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
