"""Incremental synthesis: units, fingerprints, ledgers, plans and outcomes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .rows import reachable

CHARS_PER_TOKEN = 4
TRANSCRIPT_CAP = 24_000
SHRINK_FLOOR, SHRINK_SHARE = 500, 0.4


def aggregate_units(chunks: DataFrame, since: Column | None = None) -> DataFrame:
    """session_id, repo, chunk_ids (sorted), fingerprint, total_chars, last_ts of each synthesis unit."""
    units = chunks.groupBy("session_id", F.coalesce("repo", F.lit("")).alias("repo")).agg(F.array_sort(F.collect_list("id")).alias("chunk_ids"), F.sum(F.length("content")).alias("total_chars"), F.max("ts").alias("last_ts"))
    if since is not None:
        units = units.where(F.col("last_ts") >= since)
    return units.withColumn("fingerprint", tx.fingerprint(F.col("chunk_ids")))


def status(units: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """new, changed or skipped, by the ledger's fingerprint."""
    known = ledger.select(*keys, F.col("fingerprint").alias("_fp"), F.lit(True).alias("_known"))
    s = F.when(F.col("_known").isNull(), "new").when(F.col("fingerprint").eqNullSafe(F.col("_fp")), "skipped").otherwise("changed")
    return units.join(known, keys, "left").withColumn("status", s).drop("_fp", "_known")


def pending(units: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    return status(units, ledger, keys).where("status <> 'skipped'")


def plan(units: DataFrame, cap: int = TRANSCRIPT_CAP) -> DataFrame:
    """Dry run: chunks and estimated tokens of each unit."""
    return units.withColumn("chunks", F.size("chunk_ids").cast("long")).withColumn("est_tokens", F.ceil(F.least(F.col("total_chars"), F.lit(cap)) / CHARS_PER_TOKEN).cast("long"))


def transcript(chunks: DataFrame, keys: list[str], order: list[str], cap: int = TRANSCRIPT_CAP) -> DataFrame:
    """Each unit's contents in order, joined by rules, with the middle left out beyond the cap; null contents are left
    out, a unit of nothing else has an empty text. Only chunks near a unit's ends are gathered, however long it is."""
    rule, mark = "\n---\n", "\n…\n"
    head = (cap - len(mark)) * 3 // 4
    cost = F.length("content") + len(rule)
    total = chunks.groupBy(*keys).agg((F.coalesce(F.sum(cost), F.lit(len(rule))) - len(rule)).alias("n"))
    ends = chunks.where("content IS NOT NULL").select(*dict.fromkeys([*keys, *order, "content"]))
    ends = reachable(ends, keys, order, cost, cap, both_ends=True)
    # Over what is left of a unit, the same from both of its ends.
    up, down = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    before = lambda w: F.coalesce(F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) <= cap
    ends = ends.withColumn("_up", before(up)).withColumn("_down", before(down)).where("_up OR _down")
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("content").alias("content")))), lambda x: x["content"])
    whole = ends.groupBy(*keys).agg(F.array_join(parts, rule).alias("t"))
    cut = F.concat(F.substring("t", 1, head), F.lit(mark), F.substring(F.col("t"), -(cap - len(mark) - head), cap))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = total.alias("a").join(whole.alias("b"), same, "left")
    return joined.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.when(F.col("n") <= cap, F.coalesce("t", F.lit(""))).otherwise(cut).alias("transcript"))


def shrinks(old: Column, new: Column) -> Column:
    """A rewrite that loses too much of a long page."""
    return (F.length(old) > SHRINK_FLOOR) & (F.length(new) < SHRINK_SHARE * F.length(old))


def guarded_body(old: Column, new: Column, retried: Column, day: Column) -> Column:
    """New body, or the retry's, or the old one with a dated addendum."""
    addendum = F.concat(F.regexp_replace(old, r"\s+$", ""), F.lit("\n\n## Addendum ("), day, F.lit(")\n\n"), F.regexp_replace(new, r"^\s+|\s+$", ""))
    return F.when(~F.coalesce(shrinks(old, new), F.lit(False)), new).when(retried.isNotNull() & ~shrinks(old, retried), retried).otherwise(addendum)


def extract(transcripts: DataFrame, extractor: Callable[[str], list[dict]], keys: list[str]) -> DataFrame:
    """Runs an injected extractor on each transcript, in the tasks; a unit that fails reports its error and writes nothing."""
    import pandas as pd
    from pyspark.sql import types as T

    fields = [transcripts.schema[k] for k in keys]

    def run(batches):
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                try:
                    items = extractor(r["transcript"])
                    out += [{k: r[k] for k in keys} | {"kind": x.get("kind") if x.get("kind") in ("decision", "gotcha", "howto", "note") else "note", "text": str(x["text"]), "error": None} for x in items if str(x.get("text", "")).strip()]
                except Exception as e:  # noqa: BLE001  a unit's failure is data
                    out.append({k: r[k] for k in keys} | {"kind": None, "text": None, "error": str(e)})
            yield pd.DataFrame(out, columns=[*keys, "kind", "text", "error"])

    return transcripts.mapInPandas(run, T.StructType([*fields, *(T.StructField(c, T.StringType()) for c in ("kind", "text", "error"))]))


def synthesize(chunks: DataFrame, ledger: DataFrame, extractor: Callable[[str], list[dict]], as_of: Column, limit: int | None = None) -> dict[str, DataFrame]:
    """Units that changed -> items, and the ledger rows to upsert last. Failed units get no ledger row; units beyond the
    limit (newest first) are deferred."""
    keys = ["session_id", "repo"]
    todo = pending(aggregate_units(chunks), ledger, keys)
    taken = todo.orderBy(F.desc("last_ts"), *keys).limit(limit) if limit is not None else todo
    rows = chunks.withColumn("repo", F.coalesce("repo", F.lit(""))).join(taken.select(*keys), keys, "left_semi")
    items = extract(transcript(rows, keys, ["ts", "id"]), extractor, keys)
    failed = items.where("error IS NOT NULL").select(*keys).distinct()
    done = taken.join(failed, keys, "left_anti").select(*keys, "fingerprint", F.col("chunk_ids").alias("source_chunk_ids"), as_of.alias("synthesized_at"))
    return {"items": items.where("error IS NULL"), "failed": failed, "ledger": done, "deferred": todo.join(taken.select(*keys), keys, "left_anti")}


def artifacts_of_unit(rows: DataFrame, unit: list[str], order: list[str]) -> DataFrame:
    """Distinct artifacts of a unit in order of first mention (columns kind, tool, ref)."""
    first = rows.groupBy(*unit, "kind", "tool", "ref").agg(F.min(F.struct(*order)).alias("first"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first", "kind", "tool", "ref"))), lambda x: F.struct(x["kind"].alias("kind"), x["tool"].alias("tool"), x["ref"].alias("ref")))
    return first.groupBy(*unit).agg(listed.alias("artifacts"))


def fifo(units: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """The oldest units, and how many are deferred."""
    return units.orderBy("last_ts", "session_id", "repo").limit(limit), max(0, units.count() - limit)


def uncompiled(units: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Units (keys, fingerprint) that the page ledger does not know as they are, with the status new or changed."""
    known = ledger.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("fingerprint").alias("_fp"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    rows = units.join(known, on, "left").where(~F.col("fingerprint").eqNullSafe(F.col("_fp")))
    return rows.withColumn("status", F.when(F.col("_fp").isNull(), "new").otherwise("changed")).drop("_fp", *[f"_{k}" for k in keys])
