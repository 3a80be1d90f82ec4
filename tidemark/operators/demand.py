"""Analytics over the query log and over formation: demand, trends, day counts, heatmaps.

Demand rows: id, ts, kind (ask|search), query, tier, repo, result_count, top_similarity, top_tier, top_session_id, outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans

WEAK_SIMILARITY = 0.35


def unmet(count_errors: bool = True) -> Column:
    """Asks without a covered answer, and searches with no or only weak hits. Failed searches logged with no result count too, unless told otherwise."""
    search = (F.col("result_count") == 0) | (F.col("top_similarity") < WEAK_SIMILARITY)
    if not count_errors:
        search = search & ~F.col("outcome").eqNullSafe("error")
    return ((F.col("kind") == "ask") & F.col("outcome").isin("not_covered", "no_candidates")) | ((F.col("kind") == "search") & search)


def window(log: DataFrame, as_of: Column, days: int) -> DataFrame:
    return log.where(F.col("ts") >= as_of - F.make_dt_interval(F.lit(days)))


def unmet_demand(log: DataFrame) -> DataFrame:
    """Unmet queries by case-folded text: times asked, last time, and the session and tier of the best hit (first row on ties)."""
    best = F.struct(F.coalesce("top_similarity", F.lit(float("-inf"))).alias("s"), (-F.col("id")).alias("i"))
    grouped = log.where(unmet()).groupBy(F.lower("query").alias("query"))
    return grouped.agg(F.count(F.lit(1)).alias("times"), F.max("ts").alias("latest"), F.max_by("top_session_id", best).alias("top_session_id"), F.max_by("top_tier", best).alias("top_tier"))


def summary(log: DataFrame) -> DataFrame:
    bad = unmet()
    return log.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("kind") == "ask").alias("asks"), F.count_if(F.col("kind") == "search").alias("searches"),
        F.count_if(bad).alias("unmet"), F.count_distinct(F.when(bad, F.lower("query"))).alias("distinct_unmet"),
    )


def answered_questions(log: DataFrame) -> DataFrame:
    """Distinct answered asks, latest first."""
    return log.where((F.col("kind") == "ask") & (F.col("outcome") == "answered")).groupBy("query").agg(F.max("ts").alias("latest"))


def targeted_sessions(unmet_rows: DataFrame, cap: int = 5) -> DataFrame:
    """Sessions whose raw chunks answered unmet demand best: distinct, in demand order."""
    ranked = unmet_rows.where((F.col("top_tier") == "raw") & F.col("top_session_id").isNotNull())
    first = ranked.groupBy("top_session_id").agg(F.max("times").alias("times"), F.max("latest").alias("latest"))
    return first.orderBy(F.desc("times"), F.desc("latest"), "top_session_id").limit(cap)


def context_stats(log: DataFrame, as_of: Column) -> DataFrame:
    recent = F.col("ts") >= as_of - F.make_dt_interval(F.lit(7))
    return log.agg(F.count(F.lit(1)).alias("total"), F.max("ts").alias("latest"), F.count_if(recent).alias("last_week"))


def retained(log: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    return window(log, as_of, days)


def daily_counts(chunks: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Rows and characters by day and tier in [since, until); tombstones count."""
    rows = chunks
    if since is not None:
        rows = rows.where(F.col("ts") >= since)
    if until is not None:
        rows = rows.where(F.col("ts") < until)
    return rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.coalesce("tier", F.lit("raw")).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


def day_totals(daily: DataFrame, tiers: tuple[str, ...] = ("raw", "dream", "wiki")) -> DataFrame:
    """Heatmap days: total and its split by tier."""
    return daily.groupBy("day").agg(F.sum("n").alias("total"), *[F.coalesce(F.sum(F.when(F.col("tier") == t, F.col("n"))), F.lit(0)).alias(f"n_{t}") for t in tiers])


def quartile_cuts(daily_total: DataFrame, column: str = "total") -> DataFrame:
    """Values at places floor(p * n) of the sorted nonzero days (nearest place, not interpolated). A year has 366 days at most."""
    days = daily_total.where(F.col(column) > 0).agg(F.array_sort(F.collect_list(column)).alias("v"))
    at = lambda p: F.try_element_at("v", F.least(F.floor(F.size("v") * p).cast("int"), F.size("v") - 1) + 1)
    return days.select(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))


def heat_levels(daily_total: DataFrame, column: str = "total") -> DataFrame:
    cuts = F.broadcast(quartile_cuts(daily_total, column))  # one row
    v = F.col(column)
    level = F.when(v <= 0, 0).when(v <= F.col("q1"), 1).when(v <= F.col("q2"), 2).when(v <= F.col("q3"), 3).otherwise(4)
    return daily_total.join(cuts).withColumn("level", level).drop("q1", "q2", "q3")


def spark_line(series: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Values scaled to [0, 1] within each group, and the change from the row before."""
    if scans.small(series):
        all_rows = Window.partitionBy(group)
        rows = series.withColumn("_low", F.min(value).over(all_rows)).withColumn("_high", F.max(value).over(all_rows)).withColumn("_before", F.lag(value).over(all_rows.orderBy(order)))
    else:
        ends = series.groupBy(F.col(group).alias("_g")).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
        rows = scans.look(scans.parted(series, [group], [order]), [group], [order], value, "_before", back=True).join(ends, F.col(group).eqNullSafe(F.col("_g")))
    scaled = F.coalesce(F.try_divide(F.col(value) - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.5))
    return rows.select(*series.columns, scaled.alias("scaled"), (F.col(value) - F.col("_before")).alias("delta"))


def years(first: DataFrame, as_of_year: int, column: str = "first_day") -> DataFrame:
    """Selectable years, newest first, down to that of the first chunk."""
    begin = F.coalesce(F.year(column), F.lit(as_of_year))
    return first.select(F.explode(F.sequence(F.lit(as_of_year), begin)).alias("year"))


def size_stats(chunks: DataFrame, group: str, size: Column) -> DataFrame:
    rows = chunks.withColumn("_size", size)
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("trajectory_id").alias("trajectories"), F.round(F.avg("_size"), 6).alias("mean"),
        F.percentile("_size", 0.5).alias("p50"), F.percentile("_size", 0.9).alias("p90"), F.max("_size").alias("largest"),
        F.round(F.try_divide(F.count(F.lit(1)), F.count_distinct("trajectory_id")), 6).alias("per_trajectory"),
    )
