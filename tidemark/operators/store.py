"""Mutations of the append-only store as DataFrame -> DataFrame: the result replaces the old snapshot.

``Snapshots`` writes a result to a new folder and then swaps a pointer file, so readers see all of it or none.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def append_new(old: DataFrame, new: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """The rows of new to append: the first of each key that old does not have (conflict: do nothing)."""
    once = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*(order or key)))).where("_n = 1").drop("_n")
    return once.join(old.select(*key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, restamped: list[str], cleared: list[str]) -> DataFrame:
    """Inserts new ids; on conflict keeps the old row but takes the restamped columns from the new and nulls the cleared."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    hit, fresh = F.col(f"n.{key}").isNotNull(), F.col(f"o.{key}").isNull()

    def column(c: str) -> Column:
        if c in cleared:
            return F.when(hit & ~fresh, F.lit(None)).otherwise(F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")))
        if c in restamped:
            return F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        return F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return both.select(*[column(c).alias(c) for c in old.columns])


def lookup(rows: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """Rows with the cached value or null: hits and misses in one pass."""
    return rows.join(cache, key, "left")


def assign_where(df: DataFrame, values: DataFrame, key: str, column: str, where: Column) -> DataFrame:
    """Sets a column from values (key, new_value) on rows that match the condition."""
    joined = df.join(values.select(key, F.col("new_value").alias("_v"), F.lit(True).alias("_hit")), key, "left")
    return joined.withColumn(column, F.when(where & F.col("_hit"), F.col("_v")).otherwise(F.col(column))).drop("_v", "_hit").select(*df.columns)


def invalidate(df: DataFrame, ids: DataFrame, at: Column, scope: Column, superseded_by: Column | None = None, key: str = "id") -> DataFrame:
    """Tombstones live rows in scope whose id is listed; the first tombstone stays. Adds flipped."""
    joined = df.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    flips = F.coalesce(F.col("_hit") & scope & F.col("invalid_at").isNull(), F.lit(False))
    out = joined.withColumn("flipped", flips).withColumn("invalid_at", F.when(F.col("flipped"), at).otherwise(F.col("invalid_at")))
    if superseded_by is not None:
        out = out.withColumn("superseded_by", F.when(F.col("flipped"), superseded_by).otherwise(F.col("superseded_by")))
    return out.drop("_hit")


def delete_ids(df: DataFrame, ids: DataFrame, scope: Column, key: str = "id") -> DataFrame:
    """Without the listed ids inside the scope."""
    joined = df.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return joined.where(~F.coalesce(F.col("_hit") & scope, F.lit(False))).drop("_hit")


def delete_stale(df: DataFrame, version: Column, column: str = "chunker_version") -> DataFrame:
    """Rows of the current version; null counts as stale."""
    return df.where(F.col(column).eqNullSafe(version))


def delete_owner(df: DataFrame, owner: str, prefix: bool = False) -> DataFrame:
    match = F.col("owner").startswith(owner) if prefix else F.col("owner") == owner
    return df.where(~F.coalesce(match, F.lit(False)))


def last_writer(old: DataFrame, new: DataFrame, key: list[str], stamp: str) -> DataFrame:
    """Ledger upsert: the row with the newest stamp of each key; new wins ties."""
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(stamp), F.desc("_src")))
    return both.withColumn("_n", place).where("_n = 1").drop("_n", "_src")


def checked(batch: DataFrame, width: int, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """A batch for ``upsert``: the first row of each key; a vector of another width fails the whole batch."""
    once = batch.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*(order or [key])))).where("_n = 1").drop("_n")
    wrong = F.col("embedding").isNotNull() & (F.size("embedding") != width)
    return once.withColumn("embedding", F.when(wrong, F.raise_error(F.concat(F.lit(f"expected width {width}, got "), F.size("embedding").cast("string")))).otherwise(F.col("embedding")))


def sweep(df: DataFrame, reports: DataFrame, version: Column, scope: Column) -> DataFrame:
    """After a reindex: without the rows in scope of other chunker versions, but only if no file (reports: error) failed."""
    failed = reports.agg(F.count("error").alias("_errors"))
    return df.join(F.broadcast(failed)).where((F.col("_errors") > 0) | ~F.coalesce(scope, F.lit(False)) | F.col("chunker_version").eqNullSafe(version)).drop("_errors")


def _parsed(events: DataFrame, source: str, schema: str) -> DataFrame:
    """Payloads of a source as p. Every object is readable, whatever fields it has; torn ones, other values and fields of
    another type are not. The parser keeps what it could not read in a field of its own."""
    kind = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_torn", T.StringType())])
    rows = events.where(F.col("source") == source)
    parsed = F.from_json("payload", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"})
    one = F.try_parse_json(F.concat(F.lit("["), "payload", F.lit("]")))  # in brackets, so that nothing may follow the object
    whole = F.coalesce(F.schema_of_variant(F.try_variant_get(one, "$[0]", "variant")).startswith("OBJECT"), F.lit(False)) & F.try_variant_get(one, "$[1]", "variant").isNull()
    return rows.withColumn("p", parsed).withColumn("_good", whole & F.col("p._torn").isNull() & F.col("p").isNotNull())


def replay(events: DataFrame, source: str, schema: str) -> DataFrame:
    """Stored raw payloads of a source, parsed; unreadable ones are left out (see ``unreadable``)."""
    names = T._parse_datatype_string(schema).names
    return _parsed(events, source, schema).where("_good").select("trajectory_id", *[F.col("p")[c].alias(c) for c in names])


def unreadable(events: DataFrame, source: str, schema: str) -> DataFrame:
    """The events of a source whose payload ``replay`` leaves out."""
    return _parsed(events, source, schema).where("NOT _good").select(*events.columns)


def existing(chunks: DataFrame, ids: DataFrame, tier: str, key: str = "id") -> DataFrame:
    """Those of the ids that the store has in a tier, tombstoned rows too."""
    return ids.select(key).distinct().join(chunks.where(F.col("tier") == tier).select(key), key, "left_semi")


def backfill_artifacts(chunks: DataFrame, events: DataFrame, source: str, schema: str, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The store with the artifacts of raw chunks derived anew from stored payloads: they are read again (unreadable ones leave
    their chunks as they are), `derive` makes (trajectory_id, artifacts) of them, and rows whose artifacts differ are marked
    `changed`. Other tiers and trajectories without a payload keep what they have."""
    found = derive(replay(events, source, schema)).select(F.col("trajectory_id").alias("_t"), F.col("artifacts").alias("_artifacts"))
    joined = chunks.join(found, F.col("trajectory_id") == F.col("_t"), "left")
    hit = (F.col("tier") == "raw") & F.col("_t").isNotNull() & ~F.col("artifacts").eqNullSafe(F.col("_artifacts"))
    changed = F.coalesce(hit, F.lit(False))
    return joined.withColumn("changed", changed).withColumn("artifacts", F.when(F.col("changed"), F.col("_artifacts")).otherwise(F.col("artifacts"))).drop("_t", "_artifacts")


def needs_embedding(df: DataFrame, model: str) -> DataFrame:
    """Rows that a migration to the model has to embed: no vector, or another model's."""
    return df.where(F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model)))


def stale(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Keys that a rebuild no longer produces."""
    return old.select(key).distinct().join(new.select(key), key, "left_anti")


class Snapshots:
    """Versions of a table in one folder; `current` names the version that readers use. The pointer is written through
    Spark, so any store that Spark writes will do; the newest complete pointer counts."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> str:
        version = f"v{time.time_ns()}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.root}/{version}")
        self.spark.createDataFrame([(json.dumps({"version": version, "schema": df.schema.jsonValue()}),)], "value string").coalesce(1).write.mode("append").text(f"{self.root}/pointers")
        return version

    def current(self) -> str:
        latest = self.spark.read.text(f"{self.root}/pointers").select(F.max(F.get_json_object("value", "$.version"))).first()[0]
        return f"{self.root}/{latest}"

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.current())
