"""Compiled pages: merging and splitting them, and keeping their chunks in step with the store.

Pages have slug, title, kind, summary, aliases, sources, trajectories, created, updated, body.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import segments as seg
from ..functions import text as tx
from . import store
from .units import SHRINK_FLOOR, SHRINK_SHARE

ARTIFACTS = 30
MERGED = "slug string, title string, kind string, summary string, aliases array<string>, sources array<string>, trajectories array<string>, created string, updated string, body string, outcome string"


def merge_unique(old: Column, new: Column) -> Column:
    """Ordered union: old values first, each once; null counts as empty."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(old, empty), F.coalesce(new, empty)))


def valid_sources(sources: Column, unit_ids: Column) -> Column:
    """The sources that are items of the unit, in their order."""
    return F.filter(sources, lambda s: F.array_contains(unit_ids, s))


def derived_artifacts(pages: DataFrame, chunks: DataFrame, cap: int = ARTIFACTS) -> DataFrame:
    """slug, artifacts of pages (slug, sources) from their source chunks (id, ts, artifacts of kind, tool, ref): newest
    chunk first, then the order of sources and inside the chunk; distinct, at most cap. Pages without any are left out."""
    at = pages.select("slug", F.posexplode("sources").alias("source_at", "id")).join(chunks.select("id", "ts", "artifacts"), "id")
    rows = at.select("slug", "source_at", "ts", F.posexplode("artifacts").alias("artifact_at", "a"))
    newest = F.struct((-F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0))).alias("age"), "source_at", "artifact_at")
    first = rows.groupBy("slug", F.col("a.kind").alias("kind"), F.col("a.tool").alias("tool"), F.col("a.ref").alias("ref")).agg(F.min(newest).alias("at"))
    top = first.withColumn("n", F.row_number().over(Window.partitionBy("slug").orderBy("at"))).where(F.col("n") <= cap)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "kind", "tool", "ref"))), lambda x: F.struct(x["kind"].alias("kind"), x["tool"].alias("tool"), x["ref"].alias("ref")))
    return top.groupBy("slug").agg(listed.alias("artifacts"))


def _violates(old: str, new: str) -> bool:
    return len(old) > SHRINK_FLOOR and len(new) < SHRINK_SHARE * len(old)


def _apply(page: dict | None, op: dict) -> dict:
    body, outcome = op["body"] or "", "updated" if page else "created"
    if page and _violates(page["body"] or "", body):
        if op["retry"] is not None and not _violates(page["body"], op["retry"]):
            body, outcome = op["retry"], "retried"
        else:
            body, outcome = f"{page['body'].rstrip()}\n\n## Addendum ({(op['at'] or 'unknown')[:10]})\n\n{body.strip()}", "addendum"
    grow = lambda k, new: list(dict.fromkeys([*((page or {}).get(k) or ()), *new]))
    known = set(op["unit_ids"] or ())
    return {
        "slug": op["slug"], "title": op["title"], "kind": op["kind"], "summary": op["summary"], "aliases": grow("aliases", op["aliases"] or ()),
        "sources": grow("sources", [s for s in op["sources"] or () if s in known]), "trajectories": grow("trajectories", [op["trajectory_id"]] if op["trajectory_id"] else ()),
        "created": (page or {}).get("created") or op["at"], "updated": op["at"], "body": body, "outcome": outcome,
    }


def merge_ops(pages: DataFrame, ops: DataFrame) -> DataFrame:
    """Pages after page operations (slug, place, title, kind, summary, aliases, sources, unit_ids, trajectory_id, body,
    retry, at) with the outcome of each page's last one: kept, created, updated, retried or addendum.

    Operations of a page apply in the order of place (oldest unit first), each to the result of the one before; pages are
    independent. A body that trips the shrink guard gives way to the retry's, or becomes an addendum dated by `at`.
    Sources that are no items of the unit are dropped; aliases, sources and trajectories only grow; null arrays and bodies
    count as empty. Rows stream in sorted order, so a task holds one page, however many operations it gets; adds fingerprint."""
    fields = ["title", "kind", "summary", "aliases", "sources", "trajectories", "created", "updated", "body"]
    rows = pages.select("slug", F.lit(None).cast("long").alias("place"), F.struct(*fields).alias("page"), F.lit(None).alias("op"))
    ops = ops.select("slug", F.coalesce(F.col("place").cast("long"), F.lit(-(1 << 62))).alias("place"), F.lit(None).alias("page"), F.struct("title", "kind", "summary", "aliases", "sources", "unit_ids", "trajectory_id", "body", "retry", "at").alias("op"))
    both = rows.unionByName(ops).where("slug IS NOT NULL").repartition("slug").sortWithinPartitions("slug", F.asc_nulls_first("place"), "op.trajectory_id", "op.body")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page: dict | None = None
        schema = None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if page is not None and page["slug"] != r["slug"]:
                    done.append(page)
                    page = None
                page = {"slug": r["slug"], "outcome": "kept", **r["page"]} if r["op"] is None else _apply(page, {"slug": r["slug"], **r["op"]})
            schema = schema or _arrow_schema()
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if page is not None:
            yield pa.RecordBatch.from_pylist([page], schema)

    return both.mapInArrow(fold, MERGED).withColumn("fingerprint", tx.fingerprint(F.coalesce("sources", F.array().cast("array<string>"))))


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[t]) for n, t in (x.split(" ") for x in MERGED.split(", "))])


def split_pages(hubs: DataFrame, ops: DataFrame, existing: DataFrame, at: Column) -> DataFrame:
    """Splits hub pages by operations (hub, place, action, slug, title, kind, summary, aliases, sources, body): a row for
    each page to write (role hub or child), or one of role failed with the reason for a hub that nothing is written for.

    A hub needs exactly one operation on itself, an update. Children are the creates of slugs that no page (existing: slug)
    has; of equal slugs the first of a hub counts, and of two hubs the one with the smaller slug. A child inherits the
    sources that the hub has too, or all of the hub's where there are none; the hub keeps its sources. The hub's shrinking is
    meant, so no guard applies."""
    h = hubs.select(F.col("slug").alias("hub"), *[F.col(c).alias(f"hub_{c}") for c in ("title", "summary", "aliases", "sources", "trajectories", "created")])
    own = ops.where(F.col("slug") == F.col("hub")).groupBy("hub").agg(F.count(F.lit(1)).alias("own"), F.count_if(F.col("action") == "update").alias("updates"), F.min_by(F.struct("title", "kind", "summary", "aliases", "sources", "body"), "place").alias("op"))
    base = h.join(own, "hub", "left").withColumn("sound", F.coalesce((F.col("own") == 1) & (F.col("updates") == 1), F.lit(False)))
    made = ops.where((F.col("slug") != F.col("hub")) & (F.col("action") == "create")).join(existing.select("slug"), "slug", "left_anti").join(base.where("sound").select("hub"), "hub", "left_semi")
    first = made.groupBy("slug").agg(F.min_by(F.struct("hub", "title", "kind", "summary", "aliases", "sources", "body"), F.struct("hub", "place")).alias("op")).select("slug", "op.hub", "op")
    n = first.groupBy("hub").agg(F.count(F.lit(1)).alias("children"))
    base = base.join(n, "hub", "left").withColumn("children", F.coalesce("children", F.lit(0)))
    good = base.where("sound AND children > 0")
    shared = F.filter(F.coalesce("op.sources", F.array().cast("array<string>")), lambda s: F.array_contains("hub_sources", s))
    either = lambda a, b: F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(b)
    children = first.join(good.drop("op", "children"), "hub").select(
        "hub", "slug", F.lit("child").alias("role"), F.lit(None).cast("string").alias("reason"), "op.title", "op.kind", "op.summary", "op.aliases",
        F.when(F.size(shared) > 0, shared).otherwise(F.col("hub_sources")).alias("sources"), F.col("hub_trajectories").alias("trajectories"), at.alias("created"), at.alias("updated"), "op.body",
    )
    rewritten = good.select(
        "hub", F.col("hub").alias("slug"), F.lit("hub").alias("role"), F.lit(None).cast("string").alias("reason"), either(F.col("op.title"), F.col("hub_title")).alias("title"), "op.kind",
        either(F.col("op.summary"), F.col("hub_summary")).alias("summary"), merge_unique(F.col("hub_aliases"), F.col("op.aliases")).alias("aliases"), F.col("hub_sources").alias("sources"),
        F.col("hub_trajectories").alias("trajectories"), either(F.col("hub_created"), at).alias("created"), at.alias("updated"), "op.body",
    )
    out = children.unionByName(rewritten)
    failed = base.where("NOT (sound AND children > 0)").select("hub", F.col("hub").alias("slug"), F.lit("failed").alias("role"), F.when(F.col("sound"), "no valid child").otherwise("not exactly one update of the hub").alias("reason"))
    return out.unionByName(failed, allowMissingColumns=True).withColumn("fingerprint", tx.fingerprint("sources"))


def page_rows(pages: DataFrame, owner: str) -> DataFrame:
    """Chunk rows of pages, with ids of their content; a page without text has none."""
    t = F.concat(F.lit("wiki:"), F.col("slug"))
    parts = pages.withColumn("parts", seg.page_chunks_of("title", "body")).select("*", F.size("parts").alias("chunk_count"), F.posexplode("parts").alias("chunk_index", "content"))
    return parts.select(tx.chunk_id(t, F.col("chunk_index"), F.col("content")).alias("id"), "content", t.alias("trajectory_id"), "chunk_index", "chunk_count", F.lit(owner).alias("owner"), F.lit("wiki").alias("tier"), F.col("kind").alias("dream_type"), F.col("updated").alias("ts"), F.col("sources").alias("source_chunk_ids"))


def sync(old: DataFrame, pages: DataFrame, owner: str, at: Column, orphans: bool = False) -> DataFrame:
    """The store after syncing pages to it: new chunks are inserted, known ones live again, and the live ones that a page
    no longer has get a tombstone that names the page. With orphans (a full reindex), so do chunks of pages that are gone,
    with no successor. Other owners and tiers stay as they are."""
    rows = page_rows(pages, owner)
    new = rows.select(*[F.col(c).cast(old.schema[c].dataType).alias(c) if c in rows.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns]).dropDuplicates(["id"])
    merged = store.upsert(old, new, "id", [c for c in ("chunker_version",) if c in old.columns], ["invalid_at", "superseded_by"])
    named = pages.select(F.concat(F.lit("wiki:"), F.col("slug")).alias("trajectory_id"), F.lit(True).alias("_page")).distinct()
    marked = merged.join(new.select("id", F.lit(True).alias("_new")), "id", "left").join(named, "trajectory_id", "left")
    gone = (F.col("tier") == "wiki") & (F.col("owner") == owner) & F.col("invalid_at").isNull() & F.col("_new").isNull()
    hit = F.coalesce(gone if orphans else gone & F.col("_page"), F.lit(False))
    out = marked.withColumn("_hit", hit).withColumns({"invalid_at": F.when(F.col("_hit"), at).otherwise(F.col("invalid_at")), "superseded_by": F.when(F.col("_hit"), F.when(F.col("_page"), F.col("trajectory_id"))).otherwise(F.col("superseded_by"))})
    return out.select(*old.columns)


def chunk_ids(chunks: DataFrame, owner: str) -> DataFrame:
    """id, trajectory_id of the owner's page chunks."""
    return chunks.where((F.col("tier") == "wiki") & (F.col("owner") == owner)).select("id", "trajectory_id")


def inventory_line(slug: Column, kind: Column, summary: Column, aliases: Column) -> Column:
    named = F.when(F.size(aliases) > 0, F.concat(F.lit(" (aliases: "), F.array_join(aliases, ", "), F.lit(")"))).otherwise("")
    return F.concat(F.lit("- "), slug, F.lit(" — "), kind, F.lit(" — "), F.coalesce(summary, F.lit("")), named)


def index_is_fresh(pages: DataFrame, index: DataFrame) -> DataFrame:
    """fresh: the index is as new as the newest page (both have modified); no pages are fresh, no index is not."""
    newest = pages.agg(F.max("modified").alias("p"))
    return newest.join(F.broadcast(index.agg(F.max("modified").alias("i")))).select((F.col("p").isNull() | F.coalesce(F.col("i") >= F.col("p"), F.lit(False))).alias("fresh"))
