import re

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from attesta.llm import quality, secrets
from attesta.llm.common import table
from tests.llm.test_near_and_filters import brute_hits, brute_roots
from tests.llm.test_near_copies import Linked, grams

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_loops(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels)).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if scores[r.doc_id] >= 0.5}
    roots = brute_roots({i: Linked(grams(t)) for i, t in texts.items()}, 4)
    texts = {i: t for i, t in texts.items() if roots[i] == i}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]

    step = docs
    for name, stage in corpus_pipeline.STAGES[:2]:
        step = stage(spark, step, SF)
    assert {r.doc_id for r in step.select("doc_id").collect()} == set(texts)
    assert step.columns == docs.columns
    clean = corpus_pipeline.remove_benchmark(spark, step, SF)
    assert clean.columns == docs.columns
    found = {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}
    for i, t in texts.items():
        n, hit, _ = brute_hits(t, items, 10)
        if hit == n and n:
            assert i not in found
        elif not hit:
            assert found[i][0] == t
        else:
            assert len(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", found[i][0])) == n - hit
        if i in found:
            assert found[i][1] == len(found[i][0])

    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(found)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    spans = {r.doc_id: r.spans for r in secrets.scan(clean).collect()}
    for r in rows:
        text = found[r.doc_id][0]
        at, parts = 0, []
        for s in sorted(spans[r.doc_id], key=lambda s: (s.start, s.end)):
            if s.start >= at:
                parts += [text[at : s.start], "[secret]"]
            at = max(at, s.end)
        masked = "".join([*parts, text[at:]])
        assert r.ids == library.encode(masked, add_special_tokens=False).ids
        assert r.n_tokens == len(r.ids)


def test_stages_of_odd_rows(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "token=abcdef", "en", "s", 3), (4, "", "en", "s", 0), (5, "token=abcdef x", "en", None, 1), (5, "other words token=abcdef", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("spans", F.lit(1))
    for start in (docs, docs.limit(0)):
        step = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            step = stage(spark, step, SF)
            assert step.columns == docs.columns
            if start is docs and stage is corpus_pipeline.keep_one_of_near_copies:
                # One id with two texts is two documents; copies under other ids go.
                assert sorted(r.text for r in step.filter("doc_id = 5").collect()) == ["other words token=abcdef", "token=abcdef x"]
                assert step.filter("doc_id IS NULL").count() == 1 and step.filter("doc_id = 4").count() == 0
        assert not any("token=abcdef" in (r.text or "") for r in step.collect())
        assert corpus_pipeline.encode(spark, step, SF).count() == step.count()
