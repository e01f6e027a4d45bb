"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineages: ``spark.checkpoint.dir``, or the one already
    set on the context. Where neither is set, a local master gets a folder beside its
    warehouse; on a cluster it is an error, as executors must see one folder."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(path or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return sc.getCheckpointDir()


def delete_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder that this job made in the shared store."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Returns this process's free memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which the worker gives its free memory back: a
    worker is used again for later tasks, and stands idle beside others in between."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch; empty batches never reach ``fn``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(trimmed(run), schema)


def slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` whose text column holds about ``limit`` bytes, at least a row
    each, so that per-byte work arrays stay bounded whatever the batch holds."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes end to end, nulls as empty texts, and the offsets."""
    filled = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    body = filled.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; never for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def cut_spans(text: Column, spans: Column, fill: str = "") -> Column:
    """``text`` with its sorted disjoint code-point spans (start, end) replaced by
    ``fill``; null spans change nothing. Stretches are taken out of a form with four bytes
    per code point, as finding a place in a text takes a walk to it."""
    n = F.size(spans)
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])
    end = lambda size, i: F.when(i == n, size).otherwise(F.get(spans, i)["start"])
    # A letter before each stretch: decoding drops a byte-order mark at the start.
    mark = F.encode(F.lit("x"), "UTF-32")
    stretch = lambda wide, size, i: F.substring(F.decode(F.concat(mark, F.substring(wide, 4 * begin(i) + 1, 4 * (end(size, i) - begin(i)))), "UTF-32"), F.lit(2), size)
    held = F.array(F.struct(F.encode(text, "UTF-32").alias("wide"), F.length(text).alias("size")))
    kept = F.flatten(F.transform(held, lambda h: F.transform(F.sequence(F.lit(0), n), lambda i: stretch(h["wide"], h["size"], i))))
    return F.when(n > 0, F.array_join(kept, fill)).otherwise(text)
