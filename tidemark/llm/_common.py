"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path

#: Bytes of text that one Python step holds at a time (a single longer text is one step).
STEP_BYTES = 4 << 20


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; for file scans the size of the files. Where it knows none (rows from the driver's
    memory have a size of exabytes) a task's worth for each shuffle partition."""
    unknown = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * (16 << 20)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 58 else unknown


def tasks_for(df: DataFrame, task_bytes: int = 16 << 20, least: int = 12, most: int = 1 << 17) -> int:
    """Partitions for a shuffle of df's texts: they grow with the input."""
    n = math.ceil(plan_bytes(df) / task_bytes)
    return min(most, max(least, n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def steps(batches: Iterable[pa.RecordBatch], text: int | str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each slice has at most `limit` bytes of the text column, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


CACHE_WORDS = 100_000


class WordHash(dict):
    """64-bit hashes of words, for at most CACHE_WORDS words at a time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def release() -> None:
    """Gives memory that a task has freed back to the system: workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def crc_mod(id_column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
