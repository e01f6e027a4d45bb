"""Token counts of flat token files by a separator scan.

A token file is a bare run of little-endian token ids; each document ends with an
end-of-document id, and nothing says where. Files are read in blocks of a fixed number
of tokens. One vectorised comparison per block finds its separators; a block reports
the lengths of the documents that lie inside it, the tokens before its first separator
and those after its last. A prefix scan over the blocks' summaries carries open
documents from block to block and numbers the documents.

The scan of summaries runs in two levels, so that no task sees all blocks of a file:
groups of ``GROUP`` blocks are scanned alone, then the groups' totals, then both join.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm.bpe import AT_ONCE, encoder, share
from attesta.llm.common import cut, delete_folder, ensure_checkpoint_dir, map_batches, slices

#: Tokens of a block.
BLOCK = 1 << 18
#: Blocks that are scanned in one group.
GROUP = 1024
DTYPE = "<u2"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or plain path."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_files(docs: DataFrame, folder: str, vocabulary: str, separator: int, id_col: str = "doc_id", text_col: str = "text", dtype: str = DTYPE) -> DataFrame:
    """Encode every document and append it, with a separator, to its task's token file in
    ``folder``, a shared one. Returns (file, place, id): the documents in file order, for
    naming only. A file is named by its content's digest, so a task that runs twice leaves
    the same file, and it appears by a rename once it is whole. Null and empty texts are
    lone separators. Where a text itself encodes to the separator's id (a literal special
    token), the largest number of ``dtype`` is written for it, so that a separator always
    ends a document; a vocabulary that uses that number is refused."""
    stand_in = int(np.iinfo(dtype).max)
    shared = share(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        temporary = f"{root}/.{part}-{uuid.uuid4().hex}"
        ids, digest = [], hashlib.sha256(str(part).encode())
        with system.open_output_stream(temporary) as out:
            for batch in batches:
                for some in slices(batch, 1, AT_ONCE) if batch.num_rows else ():
                    e = encoder(shared)
                    if e.t.top >= stand_in:
                        raise ValueError(f"{dtype} has no number beyond the vocabulary's")
                    flat, counts = e.encode(some.column(1).to_pylist())
                    content = np.where(flat == separator, stand_in, flat)
                    data = np.insert(content, np.cumsum(counts), separator).astype(dtype).tobytes()
                    digest.update(data)
                    out.write(data)
                    ids.append(some.column(0))
        if not ids:
            system.delete_file(temporary)
            return
        name = f"{part:06d}-{digest.hexdigest()[:16]}.tokens"
        system.move(temporary, f"{root}/{name}")
        place = 0
        for some in ids:
            n = len(some)
            yield pa.record_batch([pa.array([name] * n), pa.array(np.arange(place, place + n)), some], names=["file", "place", id_col])
            place += n

    kind = docs.schema[id_col].dataType.simpleString()
    return cut(docs.select(id_col, text_col).mapInArrow(run, f"file string, place long, `{id_col}` {kind}"))


def list_blocks(spark: SparkSession, folder: str, dtype: str = DTYPE, block: int = BLOCK, files: DataFrame | None = None) -> DataFrame:
    """(file, block, first, tokens): byte ranges of the token files in ``folder``, or of
    those named in ``files``. Sizes are asked for by the executors."""
    width = np.dtype(dtype).itemsize
    if files is None:
        system, root = _open(folder)
        infos = [i for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.is_file and i.extension == "tokens"]
        files = spark.createDataFrame([(i.base_name,) for i in infos], "file string")

    def sizes(batch: pa.RecordBatch) -> pa.RecordBatch:
        system, root = _open(folder)
        infos = system.get_file_info([f"{root}/{name}" for name in batch.column(0).to_pylist()])
        return pa.record_batch([batch.column(0), pa.array([i.size // width for i in infos], pa.int64())], names=["file", "size"])

    sized = map_batches(files.select("file").distinct(), sizes, "file string, size long").filter("size > 0")
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block).cast("long")))
    return sized.select("file", "size", number.alias("block")).selectExpr("file", "block", f"block * {block} AS first", f"least({block}, size - block * {block}) AS tokens")


def scan_blocks(blocks: DataFrame, folder: str, separator: int, dtype: str = DTYPE) -> DataFrame:
    """(file, block, first, tokens, ends): the positions, from the block's start, of the
    separators in each block. A block is read on its own, by its byte range."""
    width = np.dtype(dtype).itemsize

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        system, root = _open(folder)
        found = []
        for file, first, tokens in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
            with system.open_input_file(f"{root}/{file}") as f:
                data = np.frombuffer(f.read_at(tokens * width, first * width), dtype)
            found.append(np.flatnonzero(data == separator).astype(np.int32))
        return pa.record_batch([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=["file", "block", "first", "tokens", "ends"])

    # One range a row is little for Spark and much to read: deal the rows out.
    dealt = blocks.repartition(F.col("file"), F.col("block"))
    return map_batches(dealt, run, "file string, block long, first long, tokens long, ends array<int>")


def stitch(scanned: DataFrame, group: int = GROUP) -> DataFrame:
    """(file, place, start, n_tokens) of every document: two-level prefix scans over the
    blocks give each block the documents that ended before it and the position at which
    the document that is open at its start began. Tokens after the last separator of a
    file are a document that was cut off, and are not reported."""
    size = F.size("ends")
    brief = scanned.select("file", "block", size.cast("long").alias("n"), F.when(size > 0, F.col("first") + F.element_at("ends", -1) + 1).alias("open_at"), F.floor(F.col("block") / group).alias("g"))
    inside = Window.partitionBy("file", "g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = brief.select("file", "block", "g", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("n_in"), F.max("open_at").over(inside).alias("open_in"))
    groups = brief.groupBy("file", "g").agg(F.sum("n").alias("n"), F.max("open_at").alias("open_at"))
    earlier = Window.partitionBy("file").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    carried = groups.select("file", "g", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.max("open_at").over(earlier).alias("open_before"))
    start = F.coalesce("open_in", "open_before", F.lit(0))
    state = local.join(carried, ["file", "g"]).select("file", "block", (F.col("n_in") + F.col("n_before")).alias("done"), start.alias("open"))
    joined = scanned.filter(size > 0).join(state, ["file", "block"])
    ends = joined.select("file", "done", "open", "first", "ends", F.posexplode("ends").alias("k", "end"))
    begin = F.when(F.col("k") == 0, F.col("open")).otherwise(F.col("first") + F.get("ends", F.col("k") - 1) + 1)
    return ends.select("file", (F.col("done") + F.col("k")).alias("place"), begin.alias("start"), (F.col("first") + F.col("end") - begin).alias("n_tokens"))


def count_tokens(spark: SparkSession, folder: str, separator: int, dtype: str = DTYPE, block: int = BLOCK, files: DataFrame | None = None) -> DataFrame:
    """(file, place, start, n_tokens) of every document in the token files of ``folder``.
    Empty files and folders have none; repeated separators are empty documents."""
    scanned = cut(scan_blocks(list_blocks(spark, folder, dtype, block, files), folder, separator, dtype))
    return stitch(scanned)


def count_documents(docs: DataFrame, vocabulary: str, separator: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, file, place, start, n_tokens) of every row: writes the token files into the
    shared checkpoint folder, counts them from the flat files alone, and names the counted
    documents by their place. The files are deleted when they are counted. Raises
    RuntimeError if a file has more or fewer separators than documents."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    named = write_files(docs, folder, vocabulary, separator, id_col, text_col)
    # The scan's result is a table of its own, so the files can go as soon as it is there.
    scanned = cut(scan_blocks(list_blocks(spark, folder, block=block, files=named.select("file")), folder, separator))
    delete_folder(spark, folder)
    written = named.groupBy("file").agg(F.count("*").alias("n"))
    ends = scanned.groupBy("file").agg(F.sum(F.size("ends")).alias("ends"))
    wrong = written.join(ends, "file", "full").filter(~F.col("n").eqNullSafe(F.col("ends"))).first()
    if wrong:
        raise RuntimeError(f"{wrong['file']} has {wrong['ends']} separators for {wrong['n']} documents")
    return named.join(stitch(scanned), ["file", "place"]).select(id_col, "file", "place", "start", "n_tokens")
