"""Compiling units into pages: oldest unit first, each on the pages as the units before have left them, yet many at a time.

A run goes in waves. All units that are left are prepared at once: candidate pages, and one call of the model in the tasks
(only where what the model reads has changed since its last call). Then the units that a serial run would have treated the
same are committed together, which are those before the first one that touches an earlier one of the wave:

- it reads or writes a page that the earlier one writes,
- its items or bodies hold a name, old or new, of a page that the earlier one writes, so that candidates or links could differ,
- or the bodies of the earlier one hold a name of a page that it writes itself.

The first unit of a wave touches nothing, so every wave commits at least one; units that share no pages take one wave. The
driver holds the number of the first touching unit. Commitment is one pass: links for the bodies, the shrink guard with one
retry per unit, the merge into pages. The ledger comes last, and a unit whose model fails writes nothing and has no row in it.

Given hits are taken as they are for the whole run. Of several operations of a unit on one page the last counts."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import materialise
from . import compiled, phrases, units as synthesis

PAGE = ["slug", "title", "kind", "summary", "aliases", "sources", "trajectories", "created", "updated", "body"]
CANDIDATES = 8
_OP = "struct<slug:string,title:string,kind:string,summary:string,aliases:array<string>,sources:array<string>,body:string>"
Model = Callable[[dict], list[dict]]


def _asked(rows: DataFrame, model: Model) -> DataFrame:
    """Rows with a payload (JSON) and the model's operations or its error."""

    def call(batches):
        for frame in batches:
            ops, errors = [], []
            for payload in frame["payload"]:
                try:
                    made = model(json.loads(payload))
                    ops.append(json.dumps([{k: op.get(k) for k in ("slug", "title", "kind", "summary", "aliases", "sources", "body")} for op in made]))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a unit's failure is data
                    ops.append("[]")
                    errors.append(f"{type(e).__name__}: {e}")
            yield frame.assign(ops=ops, error=errors)

    kinds = T.StructType([*rows.schema.fields, T.StructField("ops", T.StringType()), T.StructField("error", T.StringType())])
    return rows.mapInPandas(call, kinds)


def payloads(todo: DataFrame, items: DataFrame, pages: DataFrame, hits: DataFrame, cap: int = CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """Of units (n, unit) the payload for the model, JSON of unit, items and candidate pages; and the candidates (unit, slug)."""
    own = items.join(todo.select("unit"), "unit", "left_semi")
    near = phrases.candidate_pages(own.select(F.col("unit").alias("item_id"), "text"), pages, hits.join(todo.select(F.col("unit").alias("item_id")), "item_id", "left_semi"), cap)
    near = materialise(near.select(F.col("item_id").alias("unit"), "slug", "place"), "candidates")
    shown = near.join(pages.select("slug", "title", "kind", "summary", "aliases", "body"), "slug")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "slug", "title", "kind", "summary", "aliases", "body"))), lambda x: x.dropFields("place"))
    pages_of = shown.groupBy("unit").agg(listed.alias("candidates"))
    items_of = own.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("id", "kind", "text"))).alias("items"))
    whole = todo.join(items_of, "unit", "left").join(pages_of, "unit", "left")
    return whole.select("n", "unit", "day", F.to_json(F.struct("unit", F.coalesce("items", F.array()).alias("items"), F.coalesce("candidates", F.array()).alias("candidates"))).alias("payload")), near


def _operations(asked: DataFrame) -> DataFrame:
    """A row per operation: n, unit, day, slug, title, kind, summary, aliases, sources, body; the last one of a unit on a page."""
    rows = asked.select("n", "unit", "day", F.posexplode(F.from_json("ops", f"array<{_OP}>")).alias("at", "op")).select("n", "unit", "day", "at", "op.*").where("slug IS NOT NULL")
    last = Window.partitionBy("unit", "slug").orderBy(F.desc("at"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "at").withColumns({"body": F.coalesce("body", F.lit("")), "aliases": F.coalesce("aliases", F.array().cast("array<string>"))})


def first_touching(ops: DataFrame, near: DataFrame, items: DataFrame, pages: DataFrame, todo: DataFrame) -> int | None:
    """The first unit (n) of a wave that touches an earlier one; None where none does."""
    numbered = todo.select("n", "unit")
    writes = ops.select("n", "slug").distinct()
    reads = near.join(numbered, "unit").select("n", "slug").union(writes).distinct()
    shared = writes.withColumnRenamed("n", "u").join(reads, "slug").where("u < n").agg(F.min("n").alias("n"))
    old = pages.join(writes.select("slug").distinct(), "slug", "left_semi").select("slug", "title", "aliases")
    names = phrases.names_of(ops.select("slug", "title", "aliases").union(old)).join(writes, "slug").select("phrase", F.col("n").alias("u")).distinct()
    texts = items.join(numbered, "unit").select("n", F.lit(0).alias("body"), "text").union(ops.select("n", F.lit(1), F.col("body")))
    held = phrases.contained(texts.select(F.struct("n", "body").alias("id"), "text"), names.select("phrase")).select("id.n", "id.body", "phrase").distinct()
    both = held.join(names, "phrase").where((F.col("u") < F.col("n")) | ((F.col("u") > F.col("n")) & (F.col("body") == 1)))
    named = both.agg(F.min(F.greatest("u", "n")).alias("n"))
    return shared.union(named).agg(F.min("n")).first()[0]


def _linked(ops: DataFrame, targets: DataFrame) -> DataFrame:
    return phrases.autolink_pages(ops, targets).drop("added")


def _retried(ops: DataFrame, pages: DataFrame, targets: DataFrame, retry: Model | None) -> DataFrame:
    """Operations with the body of the retry (null where there is none): one more call for each unit that would shrink pages."""
    if retry is None:
        return ops.withColumn("retry", F.lit(None).cast("string"))
    both = ops.join(pages.select("slug", F.col("body").alias("old")), "slug").where(synthesis.shrinks(F.col("old"), F.col("body")))
    ask = both.groupBy("n", "unit", "day").agg(F.array_sort(F.collect_list(F.struct("slug", "old", F.col("body").alias("new")))).alias("pages"))
    ask = ask.select("n", "unit", "day", F.to_json(F.struct("unit", "pages")).alias("payload"))
    again = _operations(materialise(_asked(ask, retry), "retries"))
    again = again.join(both.select("n", "slug"), ["n", "slug"], "left_semi")
    return ops.join(_linked(again, targets).select("n", "slug", F.col("body").alias("retry")), ["n", "slug"], "left")


def compile_units(
    units: DataFrame, items: DataFrame, pages: DataFrame, model: Model, retry: Model | None = None, hits: DataFrame | None = None, cap: int = CANDIDATES, limit: int | None = None
) -> dict:
    """Pages after compiling units (unit, last_ts, day) with items (unit, id, kind, text), oldest first. Returns `pages` (PAGE and
    fingerprint), `ledger` (unit, slugs, fingerprint of its items), `failed` (unit, error) and the number of `waves`. With a
    limit the oldest units count and the others wait for the next run."""
    spark = units.sparkSession
    order = Window.orderBy("last_ts", "unit")  # a row for each pending unit of a run
    todo = units.select("unit", "day", F.row_number().over(order).cast("long").alias("n"), "last_ts")
    todo = materialise((todo if limit is None else todo.where(F.col("n") <= max(0, limit))).select("n", "unit", "day"), "units")
    hits = hits if hits is not None else spark.createDataFrame([], "item_id string, slug string, rank int")
    own = items.groupBy("unit").agg(F.collect_set("id").alias("unit_ids"))
    pages, known, waves, ledger, failed = materialise(pages.select(*PAGE), "pages"), None, 0, [], []
    while not todo.isEmpty():
        waves += 1
        prepared, near = payloads(todo, items, pages, hits, cap)
        prepared = prepared.withColumn("read", F.sha2("payload", 256))
        if known is not None:
            prepared = prepared.join(known.select("unit", "read", "ops", "error"), ["unit", "read"], "left")
            fresh = _asked(prepared.where("ops IS NULL").select("n", "unit", "day", "payload", "read"), model)
            asked = fresh.unionByName(prepared.where("ops IS NOT NULL").select(*fresh.columns))
        else:
            asked = _asked(prepared.select("n", "unit", "day", "payload", "read"), model)
        known = materialise(asked, "asked")
        ops = materialise(_operations(known), "operations")
        cut = first_touching(ops, near, items, pages, todo)
        now = known if cut is None else known.where(F.col("n") < cut)
        ops = ops if cut is None else ops.where(F.col("n") < cut)
        merged = pages.select("slug", F.col("title").alias("_t"), F.col("aliases").alias("_a")).join(ops.select("slug", "title", "aliases"), "slug", "full_outer")
        targets = merged.select("slug", F.coalesce("title", "_t").alias("title"), compiled.merge_unique(F.col("_a"), F.col("aliases")).alias("aliases"), F.lit(0).alias("ordinal"))
        targets = materialise(targets, "targets")
        bodies = materialise(_retried(materialise(_linked(ops, targets), "linked"), pages, targets, retry).join(own, "unit", "left"), "bodies")
        rows = bodies.withColumns({"place": F.col("n"), "at": F.col("day"), "trajectory_id": F.concat(F.lit("dream:"), "unit")})
        pages = materialise(compiled.merge_ops(pages, rows).select(*PAGE, "fingerprint"), "pages")
        done = now.where("error IS NULL").select("unit").join(ops.groupBy("unit").agg(F.array_sort(F.collect_set("slug")).alias("slugs")), "unit", "left")
        ledger.append(materialise(done.select("unit", F.coalesce("slugs", F.array().cast("array<string>")).alias("slugs")), "ledger"))
        failed.append(now.where("error IS NOT NULL").select("unit", "error"))
        todo = materialise(todo.where(F.col("n") >= cut) if cut is not None else todo.where("false"), "units")
    from functools import reduce

    from ..functions import text as tx

    none = spark.createDataFrame([], "unit string, slugs array<string>"), spark.createDataFrame([], "unit string, error string")
    written = reduce(DataFrame.union, ledger, none[0]).join(own, "unit", "left")
    written = written.select("unit", "slugs", tx.fingerprint(F.coalesce("unit_ids", F.array().cast("array<string>"))).alias("fingerprint"))
    return {"pages": pages, "ledger": written, "failed": reduce(DataFrame.union, failed, none[1]), "waves": waves}
