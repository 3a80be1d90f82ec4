"""Window-like operators: sessions, ranks, caps, collapses and running budgets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans

SALTS = 64


def sessionize(messages: DataFrame, session: str = "conv_id", order: str = "turn", role: str = "role") -> DataFrame:
    """A user message opens a trajectory and later messages attach to it; what comes before the first is dropped."""
    known = messages.where(F.col(role).isin("user", "assistant"))
    opens = F.when(F.col(role) == "user", 1).otherwise(0)
    if not scans.small(messages):
        rows = scans.parted(known, [session], [order])
        return scans.running(rows, [session], [order], opens, "trajectory").where("trajectory > 0").drop("_part")
    return known.withColumn("trajectory", F.sum(opens).over(Window.partitionBy(session).orderBy(order))).where("trajectory > 0")


def trajectories(messages: DataFrame, session: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per trajectory: opening message, the other messages in order, and their number."""
    rows = sessionize(messages, session, order, role)
    later = F.array_sort(F.collect_list(F.when(F.col(role) == "assistant", F.struct(F.col(order).alias("o"), F.col(text).alias("t")))))
    return rows.groupBy(session, "trajectory").agg(
        F.min_by(text, order).alias("user_message"), F.transform(later, lambda x: x["t"]).alias("assistant"), F.count(F.lit(1)).alias("n_messages"), F.min(order).alias("first")
    )


def join_tool_results(uses: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Tool calls with their results; calls without one stay, results without a call go."""
    return uses.join(results, keys, "left")


def index_within(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """chunk_index from 0 and chunk_count."""
    if not scans.small(df):
        parts = scans.parted(df, group, order)
        rows = scans.running(parts, group, order, F.lit(1), "_n")
        counts = parts.groupBy(*group).agg(F.count(F.lit(1)).alias("chunk_count")).select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(group)], "chunk_count")
        on = [F.col(c).eqNullSafe(F.col(f"_c{k}")) for k, c in enumerate(group)]
        return rows.withColumn("chunk_index", F.col("_n") - 1).drop("_n", "_part").join(counts, on).drop(*[f"_c{k}" for k in range(len(group))])
    w = Window.partitionBy(*group)
    return df.withColumn("chunk_index", F.row_number().over(w.orderBy(*order)) - 1).withColumn("chunk_count", F.count(F.lit(1)).over(w))


def newest(df: DataFrame, n: int, group: list[str] | None = None, ts: str = "ts", key: str = "id") -> DataFrame:
    """The newest n rows, of each group or of all. Without a group it is a top-k, never a sort in one task."""
    if not group:
        return df.orderBy(F.desc(ts), F.desc(key)).limit(n)
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(ts), F.desc(key)))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def collapse_typing(df: DataFrame, group: list[str], key: str, ts: str = "ts", row_id: str = "id", prefixes: Column | None = None) -> DataFrame:
    """Drops a row whose successor has the same key or, where `prefixes` holds, a key that extends it."""
    if scans.small(df):
        rows = df.withColumn("_next", F.lead(key).over(Window.partitionBy(*group).orderBy(ts, row_id)))
    else:
        rows = scans.look(scans.parted(df, group, [ts, row_id]), group, [ts, row_id], key, "_next").drop("_part")
    following = F.col("_next")
    typed = F.coalesce(following.startswith(F.col(key)) & (prefixes if prefixes is not None else F.lit(True)), F.lit(False))
    same = F.coalesce(following == F.col(key), F.lit(False))
    return rows.where(~(typed | same)).select(*df.columns)


def recently_used(df: DataFrame, kind: str, key: str, n: int = 8, ts: str = "ts", row_id: str = "id") -> DataFrame:
    """The newest row of each (kind, key), and of those the newest n of each kind."""
    once = newest(df, 1, [kind, key], ts, row_id)
    return newest(once, n, [kind], ts, row_id)


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def reachable(df: DataFrame, group: list[str], order: list[str], cost: Column, budget: int, salts: int = SALTS, both_ends: bool = False) -> DataFrame:
    """Rows that a running sum of costs (none negative) up to the budget can reach from the first row of a group, or from
    the last one too. A group is dealt by the order's hash and each part drops what follows a sum beyond the budget: the
    rows that it keeps are beyond it already, so sums over the kept rows decide as sums over all. A hot group is thus
    never sorted in one task; what is left of it is at most `salts` budgets, and rows without cost."""
    salt = F.pmod(F.xxhash64(*order), F.lit(salts))
    part = Window.partitionBy(*group, salt)
    before = lambda keys: F.coalesce(F.sum(cost).over(part.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) <= budget
    near = before([F.asc(c) for c in order])
    return df.withColumn("_near", (near | before([F.desc(c) for c in order])) if both_ends else near).where("_near").drop("_near")


def running_fill(df: DataFrame, group: list[str], order: list[str], cost: str, budget: int, at_least_one: bool = True) -> DataFrame:
    """Rows in order until the running cost first exceeds the budget; the first row always where asked. Costs are not
    negative; a null one adds nothing."""
    w = Window.partitionBy(*group).orderBy(*order)
    near = reachable(df, group, order, F.col(cost), budget)
    used = near.withColumn("used", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(w))
    fits = F.col("used") <= budget
    return used.where((fits | (F.col("place") == 1)) if at_least_one else fits)


def pack_batches(df: DataFrame, group: str, order: str, cost: str, most_rows: int = 64, most_cost: int = 150_000) -> DataFrame:
    """Batch number of each row, in order: a batch ends at its row count or cost; a null cost counts as 0. The reset makes it a
    fold, which ``scans.batches`` takes by parts of a group, so a hot group is dealt over many tasks."""
    rows = df.select(F.col(group).cast("string").alias("g"), F.col(order).cast("long").alias("o"), F.coalesce(F.col(cost).cast("long"), F.lit(0)).alias("c"))
    found = scans.batches(scans.parted(rows, ["g"], ["o"]), most_rows, most_cost)
    return found.withColumnsRenamed({"g": group, "o": order})


def fold_budget(
    items: DataFrame, budget: int, reserve: Callable[[Column, Column], Column] | None = None, page_share: float = 0.4, most_pages: int = 6, most_memories: int = 10
) -> DataFrame:
    """Three passes over a context's few candidates (group, kind page|memory, place, cost) and what the budget leaves after
    `reserve`, a function of how many pages and memories are candidates. Pages within their share, the first that fits at
    all within everything (those before it are passed over); memories into the rest; the other pages, in order, into what
    is left. A pass ends with the first item that does not fit, so each is a running sum; costs are not negative. Where
    nothing fits, the first page, else the first memory."""
    page, every = F.col("kind") == "page", Window.partitionBy("group")
    line = Window.partitionBy("group", "kind").orderBy("_n")
    some = lambda test: F.when(test, F.col("cost")).otherwise(F.lit(0))
    total = lambda test: F.sum(some(test)).over(every)
    up_to = lambda test: F.sum(some(test)).over(line)
    rows = items.withColumn("_n", F.row_number().over(Window.partitionBy("group", "kind").orderBy("place")))
    rows = rows.where((page & (F.col("_n") <= most_pages)) | ((F.col("kind") == "memory") & (F.col("_n") <= most_memories)))
    frame = reserve(F.count_if(page).over(every), F.count_if(~page).over(every)) if reserve else F.lit(0)
    rows = rows.withColumn("_left", F.greatest(F.lit(0), F.lit(budget) - frame))
    left = F.col("_left")
    rows = rows.withColumn("_first", F.min(F.when(page & (F.col("cost") <= left), F.col("_n"))).over(every))
    first, after = page & F.col("_n").eqNullSafe(F.col("_first")), page & F.coalesce(F.col("_n") > F.col("_first"), F.lit(False))
    rows = rows.withColumn("_a", first | (after & (total(first) + up_to(after) <= F.floor(left * page_share))))
    rows = rows.withColumn("_b", ~page & (total(F.col("_a")) + up_to(~page) <= left))
    rows = rows.withColumn("_c", page & ~F.col("_a") & (total(F.col("_a") | F.col("_b")) + up_to(page & ~F.col("_a")) <= left))
    rows = rows.withColumn("_in", F.col("_a") | F.col("_b") | F.col("_c"))
    rows = rows.withColumn("_none", ~F.bool_or("_in").over(every)).withColumn("_pages", F.bool_or(page).over(every))
    alone = F.col("_none") & (F.col("_n") == 1) & (page | ~F.col("_pages"))
    return rows.where(F.col("_in") | alone).select(*items.columns)


def pivot_budget_totals(filled: DataFrame) -> DataFrame:
    return filled.groupBy("group").agg(F.sum("cost").alias("used"), F.count_if(F.col("kind") == "page").alias("pages"), F.count_if(F.col("kind") == "memory").alias("memories"))
