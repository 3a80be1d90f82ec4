"""What a search or an answer shows and logs: reranked pages, sources, candidate texts and demand rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE_CHARS = 2000


def parse_ranking(answer: Column, n: Column) -> Column:
    """Indices of a JSON answer {"ranking": [...]}: whole numbers from 0 below n, each once, in order; null where the
    answer is no such JSON or none is left."""
    items = F.try_variant_get(F.try_parse_json(answer), "$.ranking", "array<variant>")
    number = lambda v: F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(v, "$", "double"))
    whole = F.filter(F.transform(items, number), lambda x: x.isNotNull() & (x == F.floor(x)) & (x >= 0) & (x < n))
    out = F.array_distinct(F.transform(whole, lambda x: x.cast("int")))
    return F.when(F.size(out) > 0, out)


def reranked_pages(pool: DataFrame, answers: DataFrame, top_k: int, limit: int) -> DataFrame:
    """Result pages (query_id, rank from 0) reordered by a reranker's answers (query_id, answer): its ranking of the first
    top_k rows, then those it left out, then the rest; the pool's order where the answer is missing or unusable. Adds
    position from 0 and keeps limit rows a query."""
    heads = pool.where(F.col("rank") < top_k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    ranks = answers.join(heads, "query_id").select("query_id", F.posexplode(parse_ranking(F.col("answer"), F.col("n"))).alias("place", "rank"))
    w = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("place"), "rank")
    return pool.join(ranks, ["query_id", "rank"], "left").withColumn("position", F.row_number().over(w) - 1).where(F.col("position") < limit).drop("place")


def reference(tier: Column, repo: Column, branch: Column, trajectory_id: Column) -> Column:
    """Where a source is found: the page's slug, or repository@branch."""
    place = F.concat(F.coalesce(repo, F.lit("")), F.lit("@"), F.when(F.coalesce(branch, F.lit("")) != "", branch).otherwise("(no-branch)"))
    return F.when(tier == "wiki", F.coalesce(F.regexp_replace(trajectory_id, "^wiki:", ""), F.lit("?"))).otherwise(place)


def iso_day(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("unknown"))


def iso_text(c: Column) -> Column:
    """A `yyyy-MM-dd HH:mm:ss` text in UTC as ISO; others as they are."""
    return F.when(c.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"), F.concat(F.translate(c, " ", "T"), F.lit("Z"))).otherwise(c)


def source_line(n: Column, tier: Column, dream_type: Column, ref: Column, ts: Column, trajectory_id: Column, chunk_id: Column, artifacts: Column) -> Column:
    """One line of the list of sources; artifacts is their number."""
    kind = F.coalesce(dream_type, F.lit("?"))
    badge = F.when(tier == "wiki", F.concat(F.lit("wiki:"), kind)).when(tier == "dream", F.concat(F.lit("dream:"), kind)).otherwise("raw")
    short = F.when(F.length(chunk_id) > 8, F.concat(F.substring(chunk_id, 1, 8), F.lit("…"))).otherwise(chunk_id)
    tail = F.when((tier == "dream") & (F.coalesce(trajectory_id, F.lit("")) != ""), trajectory_id).otherwise(F.concat(F.lit("chunk "), short))
    more = F.when(artifacts == 1, F.lit(" · 1 artifact")).when(artifacts > 1, F.concat(F.lit(" · "), artifacts.cast("string"), F.lit(" artifacts"))).otherwise("")
    return F.concat(F.lit("["), n.cast("string"), F.lit("] ["), badge, F.lit("] "), ref, F.lit(" · "), iso_day(ts), F.lit(" · "), tail, more)


def candidate_header(n: Column, tier: Column, dream_type: Column, ref: Column, ts: Column) -> Column:
    kind = F.when(tier.isin("wiki", "dream"), F.concat(tier, F.lit("/"), F.coalesce(dream_type, F.lit("?")))).otherwise("raw")
    return F.concat(F.lit("["), n.cast("string"), F.lit("] "), kind, F.lit(" · "), ref, F.lit(" · "), iso_day(ts))


def candidate_body(content: Column, cap: int = CANDIDATE_CHARS) -> Column:
    return F.when(F.length(content) > cap, F.concat(F.substring(content, 1, cap), F.lit("\n[truncated]"))).otherwise(content)


def cited_texts(citations: DataFrame, sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations (answer_id, n) with the cited chunk's text: n names a source (answer_id, n, chunk_id), and its chunk is
    found by id; null where the chunk is gone."""
    return citations.join(sources, ["answer_id", "n"]).join(chunks.select(F.col("id").alias("chunk_id"), "content"), "chunk_id", "left")


def search_rows(requests: DataFrame, results: DataFrame) -> DataFrame:
    """A demand row for each search (query_id, surface, query, tier, repo, failed): number of results (query_id, position,
    similarity, tier, session_id) and the best one's facts; a failed search has none and the outcome error."""
    top = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("similarity", "tier", "session_id"), "position").alias("top"))
    fine = ~F.coalesce("failed", F.lit(False))
    best = lambda c, name: F.when(fine, F.col(f"top.{c}")).alias(name)
    return requests.join(top, "query_id", "left").select(
        "query_id", "surface", F.lit("search").alias("kind"), "query", "tier", "repo", F.when(fine, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("result_count"),
        best("similarity", "top_similarity"), best("tier", "top_tier"), best("session_id", "top_session_id"), F.when(~fine, "error").alias("outcome"),
    )


def ask_rows(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """A demand row for each answered question (query_id, surface, query, tier, repo, answer): number of sources (query_id,
    n, tier, cited), the first one's tier, cited ones and the outcome."""
    s = sources.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sources"), F.count_if("cited").alias("n_cited"), F.min_by("tier", "n").alias("top_tier"))
    cited = F.coalesce("n_cited", F.lit(0))
    outcome = F.when(F.col("answer").isNull(), "no_candidates").when(cited == 0, "not_covered").otherwise("answered")
    return requests.join(s, "query_id", "left").select("query_id", "surface", F.lit("ask").alias("kind"), "query", "tier", "repo", F.coalesce("n_sources", F.lit(0)).alias("result_count"), "top_tier", outcome.alias("outcome"), cited.alias("cited_count"))


def arm_chunk_id(arm: Column, trajectory_id: Column, index: Column, content: Column) -> Column:
    """Chunk ids that differ between the arms of an experiment."""
    from ..functions import text as tx

    return tx.chunk_id(F.concat(arm, F.lit(":"), trajectory_id), index, content)


def prefixed(prefix: Column, content: Column) -> Column:
    """Prefix, blank line, chunk; the bare chunk without a prefix."""
    return F.coalesce(F.concat(prefix, F.lit("\n\n"), content), content)


def recall_any(ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), by: str = "query_id") -> DataFrame:
    """Whether any relevant row (position, relevant) is among the first k."""
    first = F.min(F.when(F.col("relevant"), F.col("position")))
    return ranked.groupBy(by).agg(*[F.coalesce(first <= k, F.lit(False)).cast("int").alias(f"recall{k}") for k in ks])


def user_corpus(turns: DataFrame, cap: int = 24_000, key: str = "conv_id") -> DataFrame:
    """A text for each conversation: the user's turns in order, one per line, cut at cap characters. Only turns that begin
    below the cap are gathered, so a long conversation takes no more memory than a short one."""
    user = turns.where((F.col("role") == "user") & F.col("text").isNotNull())
    before = F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy(key).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = user.select(key, "turn", "text", before.alias("before")).where(F.col("before") < cap)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "before", F.substring("text", 1, cap).alias("text")))), lambda x: x["text"])
    return head.groupBy(key).agg(F.substring(F.array_join(parts, "\n"), 1, cap).alias("content"))


def demand_queries(demand: DataFrame, recents: DataFrame, most: int = 20) -> DataFrame:
    """The newest distinct queries (query, ts) of three characters or more, of the recents where there is no demand,
    without those that repeat or begin a newer one; at most `most`, in order n."""

    def newest(df: DataFrame, n: int) -> DataFrame:
        return df.where(F.length("query") >= 3).groupBy("query").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "query").limit(n)

    d = newest(demand, most)
    none = d.agg(F.count(F.lit(1)).alias("n_demand"))
    pool = d.unionByName(newest(recents, 30).join(F.broadcast(none)).where("n_demand = 0").drop("n_demand"))
    rows = pool.withColumn("n", F.row_number().over(Window.orderBy(F.desc("ts"), "query"))).withColumn("query", F.trim("query")).where("query <> ''")
    a, b = rows.alias("a"), F.broadcast(rows).alias("b")
    kept = a.join(b, (F.col("b.n") < F.col("a.n")) & F.startswith(F.lower("b.query"), F.lower("a.query")), "left_anti")
    return kept.select("n", "query").orderBy("n").limit(most)
