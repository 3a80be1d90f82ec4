"""Session-start context: pages by provenance, recent decisions, keyword mentions; a budget; a deterministic text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .rows import fold_budget

MEMORY_KINDS = ("decision", "gotcha")
MEMORY_DAYS, PAGES, MEMORIES = 30, 8, 12
PAGES_TITLE, MEMORIES_TITLE = "**Pages**", f"**Recent decisions & gotchas ({MEMORY_DAYS}d)**"


def pages_for_repo(wiki: DataFrame, chunks: DataFrame, repo: str) -> DataFrame:
    """slug, evidence, latest, excerpt of pages whose sources include chunks of the repo."""
    links = wiki.select("slug", "chunk_index", "content", F.explode("source_chunk_ids").alias("id"))
    own = chunks.where(F.col("repo") == repo).select("id", "ts")
    return links.join(own, "id").groupBy("slug").agg(F.count_distinct("id").alias("evidence"), F.max("ts").alias("latest"), F.min_by("content", F.struct("chunk_index", "content")).alias("excerpt"))


def page_evidence(wiki: DataFrame, chunks: DataFrame) -> DataFrame:
    """slug, sessions, first_seen, last_seen: the distinct sessions behind a page's source chunks and their earliest and
    latest times, tombstoned chunks included. A page without known sources has 0 sessions."""
    links = wiki.select("slug", F.explode_outer("source_chunk_ids").alias("id")).distinct()
    own = links.join(chunks.select("id", "session_id", "ts"), "id", "left")
    sessions = own.groupBy("slug", "session_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))  # before the distinct count, so a hot page is folded in its tasks
    return sessions.groupBy("slug").agg(F.count("session_id").alias("sessions"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"))


def recent_memories(chunks: DataFrame, repo: str, as_of: Column, kinds: tuple[str, ...] = MEMORY_KINDS, days: int = MEMORY_DAYS, limit: int = MEMORIES) -> DataFrame:
    since = as_of - F.make_dt_interval(F.lit(days))
    return chunks.where((F.col("repo") == repo) & F.col("dream_type").isin(*kinds) & (F.col("ts") >= since) & F.col("invalid_at").isNull()).orderBy(F.desc("ts"), "id").limit(limit)


def hydrate(pages: DataFrame, files: DataFrame) -> DataFrame:
    """The file's title and summary where it can be read, else the slug and the first sentence of the index's excerpt."""
    read = files.select("slug", F.lit(True).alias("_read"), F.col("title").alias("_title"), "summary", *[c for c in ("updated",) if c in files.columns])
    both = pages.join(read, "slug", "left").withColumn("summary", F.when(F.col("_read"), tx.collapse(F.col("summary"))).otherwise(tx.first_sentence(F.col("excerpt"))))
    return both.withColumn("title", F.coalesce(F.nullif(tx.collapse(F.col("_title")), F.lit("")), "slug")).drop("_read", "_title")


def page_line(slug: Column, title: Column, summary: Column, updated: Column) -> Column:
    shown = F.coalesce(F.nullif(summary, F.lit("")), title)
    return F.concat(F.lit("- "), slug, F.lit(" — "), shown, F.coalesce(F.concat(F.lit(" (updated "), F.left(F.nullif(updated, F.lit("")), F.lit(10)), F.lit(")")), F.lit("")))


def candidates(pages: DataFrame, memories: DataFrame, mentions: DataFrame, as_of: Column) -> DataFrame:
    """group, kind, place, cost, line: pages (slug, title, summary, evidence, latest) by evidence, pages that only mention
    the repo (slug, title, summary, rank) after them, and memories (content, dream_type, ts, id), newest first. A repo with
    neither pages nor memories is not known, and mentions of it do not count."""
    updated = lambda df: F.col("updated") if "updated" in df.columns else F.lit(None).cast("string")
    known = pages.select(F.lit(1).alias("_known")).limit(1).union(memories.select(F.lit(1)).limit(1)).limit(1)  # a row at most
    named = mentions.join(pages.select("slug"), "slug", "left_anti").join(F.broadcast(known))
    own = pages.select("slug", "title", "summary", updated(pages).alias("updated"), F.lit(0).alias("a"), (-F.col("evidence")).cast("double").alias("b"), F.coalesce(-F.unix_micros(F.col("latest").cast("timestamp")), F.lit(1 << 62)).cast("double").alias("c"))
    other = named.select("slug", "title", "summary", updated(named).alias("updated"), F.lit(1).alias("a"), F.col("rank").cast("double").alias("b"), F.lit(0.0).alias("c"))
    page = own.union(other).select(F.lit("page").alias("kind"), page_line(*map(F.col, ("slug", "title", "summary", "updated"))).alias("line"), F.struct("a", "b", "c", F.col("slug").alias("d")).alias("o"))
    when = F.concat(F.lit(" ("), tx.day_label(F.col("ts"), as_of), F.lit("): "))
    line = F.concat(F.lit("- "), F.coalesce("dream_type", F.lit("note")), when, tx.collapse(F.col("content")))
    memory = memories.select(F.lit("memory").alias("kind"), line.alias("line"), F.struct(F.lit(2).alias("a"), (-F.unix_micros(F.col("ts").cast("timestamp"))).cast("double").alias("b"), F.lit(0.0).alias("c"), F.col("id").alias("d")).alias("o"))
    rows = page.union(memory).withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("o")))  # some 30 rows
    return rows.select(F.lit("context").alias("group"), "kind", "place", tx.estimate_tokens(F.col("line")).alias("cost"), "line")


def heading(repo: str, branch: str | None = None) -> str:
    return f"## Prior context — {repo}" + (f"@{branch}" if branch else "")


def keyword_query(repo: str, branch: str | None = None) -> str:
    """The distinct terms of repo and branch, any of which may match."""
    import re

    terms = dict.fromkeys(t for s in (repo, branch or "") for t in re.split("[^a-z0-9]+", s.lower()) if len(t) >= 2)
    return " OR ".join(terms)


def footer(pages: Column, memories: Column, repo: str, branch: str | None = None) -> Column:
    p, m = (F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}")) for n, one, many in ((pages, "page", "pages"), (memories, "memory", "memories")))
    return F.concat(F.lit("_"), p, F.lit(", "), m, F.lit(f' · search "{keyword_query(repo, branch) or repo}" in {repo} to dig deeper_'))


def scaffold(repo: str, branch: str | None = None):
    """The tokens of what frames so many pages and memories: heading, footer and the titles of sections that have any."""

    def tokens(pages: Column, memories: Column) -> Column:
        some = lambda n, title: F.when(n > 0, tx.estimate_tokens(F.lit(title))).otherwise(0)
        return tx.estimate_tokens(F.lit(heading(repo, branch))) + tx.estimate_tokens(footer(pages, memories, repo, branch)) + some(pages, PAGES_TITLE) + some(memories, MEMORIES_TITLE)

    return tokens


def render(filled: DataFrame, repo: str, branch: str | None = None) -> DataFrame:
    """text and tokens: heading, pages, memories in order, footer. No row where there is neither a page nor a memory."""
    part = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("place", "line")))), lambda x: x["line"])
    both = filled.groupBy("group").agg(part("page").alias("p"), part("memory").alias("m"))
    section = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{title}\n"), F.array_join(c, "\n")))
    text = F.concat(F.concat_ws("\n\n", F.lit(heading(repo, branch)), section(PAGES_TITLE, "p"), section(MEMORIES_TITLE, "m"), footer(F.size("p"), F.size("m"), repo, branch)), F.lit("\n"))
    return both.select(text.alias("text")).withColumn("tokens", tx.estimate_tokens(F.col("text")))


def build(pages: DataFrame, memories: DataFrame, mentions: DataFrame, as_of: Column, repo: str, branch: str | None, budget: int) -> DataFrame:
    """The context's text within a budget of tokens, what frames it included (but not the breaks between lines, some four
    tokens). Where not even one item fits, the first one is given all the same."""
    items = candidates(pages, memories, mentions, as_of)
    return render(fold_budget(items, budget, scaffold(repo, branch)), repo, branch)
