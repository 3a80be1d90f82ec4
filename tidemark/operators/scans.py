"""Scans over ordered groups, however hot a group is: what a window over (group, order) gives, without one task per group.

Rows are dealt to range partitions of (group, order) and written once, with the number of their part; so a group with a third
of all rows lies in a third of the parts, in order. A scan then runs within (group, part), and what passes from part to part is
a table of one row for each group and part: first rows for look-ahead, totals for running sums, and for folds with resets the
part's state map (``batches``). Those tables have as many rows as there are parts, and one more for each group.

Tables of up to WINDOW_BYTES keep the plain window: no group of theirs is too much for a task. Orders must tell rows apart (add
a row's id); rows that are equal in group and order stay together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise

WINDOW_BYTES = 64 << 20
PART_BYTES = 32 << 20


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate, but no more than what the plan reads, as Catalyst multiplies the sizes of a join's sides; rows
    from the driver's memory, of which it knows no size, count as 0."""
    plan = df._jdf.queryExecution().optimizedPlan()
    sizes = lambda p: int(str(p.stats().sizeInBytes()))
    leaves = plan.collectLeaves()
    read = sum(n for n in (sizes(leaves.apply(k)) for k in range(leaves.size())) if n < 1 << 58)
    return min(sizes(plan), read)


def tasks(df: DataFrame, least: int) -> int:
    """How many tasks shall take df: those that are given, and more where it reads more than PART_BYTES for each."""
    return max(least, -(-plan_bytes(df) // PART_BYTES))


def small(df: DataFrame) -> bool:
    return plan_bytes(df) <= WINDOW_BYTES


def parted(df: DataFrame, group: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df in range partitions of (group, order), written, with the part's number _part; parts ascend with the order."""
    n = parts or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-plan_bytes(df) // PART_BYTES))
    return materialise(df.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()), "parts")


def _own(group: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*group, "_part").orderBy(*order)


def _joined(rows: DataFrame, table: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    """Values of a table (group, _part, ...) beside the rows; null groups meet."""
    right = table.select(*[F.col(c).alias(f"_r{k}") for k, c in enumerate(group)], F.col("_part").alias("_rp"), *names)
    on = F.col("_part") == F.col("_rp")
    for k, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"_r{k}"))
    return rows.join(right, on, "left").drop("_rp", *[f"_r{k}" for k in range(len(group))])


def look(rows: DataFrame, group: list[str], order: list[str], value: str, name: str, back: bool = False) -> DataFrame:
    """The value of the row after (or before) each row of its group; null at the end. rows: from ``parted``."""
    at = F.struct(*order)
    edge = (F.max_by if back else F.min_by)(F.struct(F.col(value).alias("v")), at).alias("_edge")
    parts = rows.groupBy(*group, "_part").agg(edge)
    beside = (F.lag if back else F.lead)("_edge").over(Window.partitionBy(*group).orderBy("_part"))  # a row for each part
    parts = parts.withColumn("_beside", beside).drop("_edge")
    w = _own(group, order)
    step = (F.lag if back else F.lead)(F.struct(F.col(value).alias("v"))).over(w)
    out = rows.withColumn("_inside", step)
    out = _joined(out, parts, group, ["_beside"])
    return out.withColumn(name, F.coalesce("_inside", "_beside")["v"]).drop("_inside", "_beside")


def running(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The sum of value over the rows of the group up to each row. rows: from ``parted``."""
    own = rows.withColumn("_value", value)
    parts = own.groupBy(*group, "_part").agg(F.sum("_value").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_sum")
    local = F.sum("_value").over(_own(group, order).rowsBetween(Window.unboundedPreceding, 0))
    out = _joined(own.withColumn("_local", local), parts, group, ["_before"])
    return out.withColumn(name, F.coalesce("_local", F.lit(0)) + F.col("_before")).drop("_local", "_before", "_value")


def batches(rows: DataFrame, most_rows: int, most_cost: int) -> DataFrame:
    """g, o, batch of thin rows (g, o, c; from ``parted`` by g and o): a batch ends at its row count or cost, and the next
    begins, so a row's batch depends on all before it. Where the batch that runs into a part may end is one of the part's first
    most_rows rows. So a part is a map from that place to how many batches begin in it and to the place in the next part; maps
    compose along the group, and each part then numbers its rows by itself."""
    import numpy as np
    import pyarrow as pa

    def nexts(cost: np.ndarray) -> np.ndarray:
        """For each row the row at which the batch that begins there has ended."""
        sums = np.concatenate([[0], np.cumsum(cost)])
        first = np.arange(len(cost))
        end = np.searchsorted(sums, sums[:-1] + most_cost, side="right") - 1
        return np.minimum(np.maximum(end, first + 1), first + most_rows)

    key = ["g", "_part"]
    w = _own(["g"], ["o"])
    heads = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most_rows)
    heads = heads.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "c"))), lambda x: x["c"]).alias("head"))
    # What a batch that begins in a part can reach: the first most_rows rows of the parts after it.
    after = F.slice(F.flatten(F.collect_list("head").over(Window.partitionBy("g").orderBy("_part").rowsBetween(1, most_rows))), 1, most_rows)
    heads = materialise(heads.withColumn("after", F.coalesce(after, F.array().cast("array<bigint>"))).drop("head"), "heads")
    thin = _joined(rows.select("g", "o", "c", "_part"), heads, ["g"], ["after"])

    def mapped(table: pa.Table) -> pa.Table:
        """For each place at which a batch may begin: how many begin in the part, and where the next one does after it."""
        order = np.argsort(table.column("o").to_numpy(), kind="stable")
        own = table.column("c").to_numpy()[order]
        ahead = np.array(table.column("after")[0].as_py(), np.int64)
        n, jump = len(own), nexts(np.concatenate([own, ahead]))
        count, leave = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for i in range(n - 1, -1, -1):
            j = int(jump[i])
            count[i], leave[i] = (1 + count[j], leave[j]) if j < n else (1, j - n)
        some = min(n, most_rows)
        return pa.table({"g": table.column("g").slice(0, 1), "_part": table.column("_part").slice(0, 1), "rows": pa.array([n]), "count": pa.array([count[:some].tolist()], pa.list_(pa.int64())), "leave": pa.array([leave[:some].tolist()], pa.list_(pa.int64()))})

    maps = thin.groupBy(*key).applyInArrow(mapped, "g string, _part int, rows long, count array<long>, leave array<long>")

    def composed(table: pa.Table) -> pa.Table:
        """Of one group: where the first batch that begins in each part does so, and how many began before."""
        order = np.argsort(table.column("_part").to_numpy(), kind="stable").tolist()
        at, before, out = 0, 0, []
        parts, sizes, counts, leaves = (table.column(c).to_pylist() for c in ("_part", "rows", "count", "leave"))
        for k in order:
            out.append((parts[k], at, before))
            if at < sizes[k]:
                at, before = leaves[k][at], before + counts[k][at]
            else:
                at -= sizes[k]
        p, a, b = zip(*out)
        return pa.table({"g": table.column("g").take(pa.array([0] * len(out))), "_part": pa.array(p, pa.int32()), "at": pa.array(a, pa.int64()), "before": pa.array(b, pa.int64())})

    starts = maps.groupBy("g").applyInArrow(composed, "g string, _part int, at long, before long")  # a row for each part
    told = _joined(thin, materialise(starts, "starts"), ["g"], ["at", "before"])

    def numbered(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("o").to_numpy(), kind="stable")
        own, at, before = table.column("c").to_numpy()[order], table.column("at")[0].as_py(), table.column("before")[0].as_py()
        begins, jump = np.zeros(len(own) + 1, np.int64), nexts(np.concatenate([own, np.array(table.column("after")[0].as_py(), np.int64)]))
        while at < len(own):
            begins[at] = 1
            at = int(jump[at])
        batch = np.empty(len(own), np.int64)
        batch[order] = before + np.cumsum(begins[:-1]) - 1
        return pa.table({"g": table.column("g"), "o": table.column("o"), "batch": pa.array(batch.astype(np.int32))})

    return told.groupBy(*key).applyInArrow(numbered, "g string, o long, batch int")
