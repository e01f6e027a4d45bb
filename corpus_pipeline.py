"""A training corpus from raw documents: quality, near-duplicates, benchmark passages,
secrets, tokens. Each stage takes what the one before it kept; all but the last return
the columns of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import bpe, decontaminate, near_copies, quality, secrets, simhash
from attesta.llm.common import delete_folder, ensure_checkpoint_dir, table
from attesta.llm.queries import vocabulary


def _measured(docs: DataFrame) -> DataFrame:
    """Documents whose texts changed, with n_chars brought up to date."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the line field holds for bad: documents whose lines' weighted mean
    probability to be good is under a half. Null and empty texts are one empty line, and are
    judged like any other; repeated rows are judged alike; without labels all rows stay."""
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, field)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays. Links are those
    of op1 (SimHash fingerprints that differ in at most four bits) and those of five-word
    shingles with a similarity of 0.8 or more. Texts without words are copies of each other. Rows
    with one id and one text are one document, rows with one id and different texts are
    not; rows without an id stay."""
    groups = near_copies.groups_of(docs, radius=simhash.RADIUS)
    dropped = groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id", F.col("text_hash").alias("_hash")).distinct()
    same = (docs["doc_id"] == dropped["doc_id"]) & (F.xxhash64(docs["text"]) == dropped["_hash"])
    return docs.join(dropped, same, "left_anti")


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of the benchmark; documents of which no word is left go. Null and empty
    texts, repeated rows and documents without a passage pass as they are."""
    return _measured(decontaminate.remove_passages(docs, table(spark, sf_dir, "benchmark")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets and linked credential parts by a mark. Null texts stay null, repeated
    rows stay repeated, and no document goes."""
    return _measured(secrets.mask(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document; null and empty texts have no ids, and
    repeated rows stay repeated."""
    encoded = bpe.encode(docs, vocabulary())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_copies),
    ("benchmark", remove_benchmark),
    ("secrets", mask_secrets),
    ("tokens", encode),
]

#: Trained fields, fingerprints and merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each kept is written to the shared checkpoint folder
    and deleted when the next stage is written. The last of them stays, as the result that
    is returned reads it."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    *stages, (_, last) = STAGES
    read = None
    for name, stage in stages:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if read:
            delete_folder(spark, read)
        read = f"{folder}/{name}"
    return last(spark, docs, sf_dir)
