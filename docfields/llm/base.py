"""Helpers that every training-data operator shares."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_U = np.uint64
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_ODD = 0x9E3779B97F4A7C15
#: Bytes of a run from which it is hashed alone.
LONG = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where that is unset, the folder that the context has already; a temporary one only where all runs on this machine.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    known = context._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="docfields-checkpoint-"))
    return named or known.get() if known.isDefined() else named


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` as one column ``row``, so that no name of its columns meets a name of a step's own."""
    return docs.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("row"))


def frugal(go: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``go``, after whose last batch a worker gives back what it has freed; else it holds its peak while it waits for other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from go(batches)
        give_back()

    return run


def give_back() -> None:
    """Return freed memory of Arrow and of the C library, where it is one that can, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def through_arrow(docs: DataFrame, go: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``docs`` through ``go``, whose batches have the columns c0, c1 and so on of ``docs``, whatever those are named."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(frugal(go), plain.schema).toDF(*docs.columns)


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` from ``row``; those in ``changed`` with new values, of the same types."""
    cast = lambda c: changed[c].cast(docs.schema[c].dataType) if c in changed else F.col("row").getField(c)
    return rows.select(*(cast(c).alias(c) for c in docs.columns))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now; it does so when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], name: str, most: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut so that column ``name`` holds about ``most`` bytes in each; a longer value stands alone."""
    for batch in batches:
        lengths = [x or 0 for x in pa.compute.binary_length(batch.column(name)).to_pylist()]
        start = size = 0
        for i, n in enumerate(lengths):
            if i > start and size + n > most:
                part = batch.slice(start, i - start)
                yield part, as_bytes(part.column(name))
                start, size = i, 0
            size += n
        if start < len(lengths):
            part = batch.slice(start)
            yield part, as_bytes(part.column(name))


def groups(texts: Iterable[bytes], most: int) -> Iterator[list[bytes]]:
    """Texts of ``most`` bytes together, or one longer than that alone."""
    own, size = [], 0
    for t in texts:
        if own and size + len(t) > most:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t)
    if own:
        yield own


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _powers(x: int, n: int) -> np.ndarray:
    """Powers of a number modulo 2 to the 64."""
    p = np.full(n, x, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def run_hashes(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of bytes, wherever they stand: differences of one running sum over all bytes."""
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_powers(_ODD, len(flat)) * _BYTES[flat], out=total[1:])
    out = mixed((total[starts + sizes] - total[starts]) * _powers(pow(_ODD, -1, 1 << 64), len(flat))[starts] + sizes.astype(np.uint64))
    for k in np.flatnonzero(sizes > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(flat[starts[k] : starts[k] + sizes[k]].tobytes())
    return out
