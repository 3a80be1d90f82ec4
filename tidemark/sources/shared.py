"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None

#: Bytes of a text column that a Python task turns into objects at a time (a single longer text is one step).
STEP_BYTES = 4 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Without that setting a temporary folder does, but on a local master only."""
    global _own_dir
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _own_dir is None:
            _own_dir = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        root = _own_dir
    return f"{root.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: cuts lineage and outlives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def steps(batches: Iterable, column: int | str, limit: int | None = None) -> Iterator:
    """Arrow batches (or arrays, where a function has one column) in slices with at most `limit` bytes of a text column: a batch has
    as many rows as Spark gives it, however long they are."""
    import pyarrow.compute as pc

    limit = limit or STEP_BYTES
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column) if hasattr(batch, "column") else batch), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)
