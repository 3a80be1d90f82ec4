"""Structured Streaming forms of ingest: file arrival, quiescent sessions, typing collapse, exactly-once merge.

Watermarks bound the state where a stream has one; the batch operators have none and read late rows too.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

QUIET = "15 minutes"
DEBOUNCE = "8 seconds"


def tail_lines(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """Lines of arriving *.jsonl files, with their path."""
    return spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", per_trigger).text(root).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"))


def table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def debounced(changes: DataFrame, delay: str = DEBOUNCE) -> DataFrame:
    """Paths that have been still for the delay (columns path, modified)."""
    return changes.withWatermark("modified", "0 seconds").groupBy("path", F.session_window("modified", delay).alias("w")).agg(F.count(F.lit(1)).alias("changes")).select("path", F.col("w.end").alias("settled"), "changes")


def quiet_sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = QUIET, late: str = "0 seconds") -> DataFrame:
    """Sessions of a key that end with the gap; a session is out once the watermark has passed it."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    w = F.session_window(ts, gap).alias("w")
    return rows.groupBy(key, w).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def day_counts(events: DataFrame, key: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Rows by day and key; a late row within the bound still counts."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.window(ts, "1 day").alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), key, "n")


def _expiring(rows: DataFrame, ts: str | None, late: str | None):
    """The stream with its watermark, and the kind of timeout."""
    if late is None:
        return rows, GroupStateTimeout.NoTimeout
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late), GroupStateTimeout.EventTimeTimeout


def _expire_after(state: GroupState, newest: pd.Timestamp, idle: str) -> None:
    now = max(int(newest.timestamp() * 1000), state.getCurrentWatermarkMs())
    state.setTimeoutTimestamp(now + int(pd.Timedelta(idle).total_seconds() * 1000))


def typing_collapse(events: DataFrame, group: str, key: str, ts: str = "ts", row_id: str = "id", late: str | None = None, idle: str = "1 day") -> DataFrame:
    """Search-as-you-type: a row leaves when the next of its group neither repeats nor extends its key. The group's
    newest row is state; it leaves with the first row that does not continue it or, with a watermark (late), once the
    group has been idle, and its state with it. Without a watermark there is one row of state per group for ever."""
    fields = f"{group} string, {row_id} long, {key} string"
    rows, timeout = _expiring(events, ts, late)

    def step(k: tuple, batches, state: GroupState):
        held = state.get if state.exists else None
        out = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(k[0], *held)], columns=[group, row_id, key])
            return
        new = pd.concat(list(batches)).sort_values([ts, row_id])
        for i, q in zip(new[row_id], new[key]):
            if held is not None and not q.startswith(held[1]):
                out.append((k[0], held[0], held[1]))
            held = (int(i), q)
        if held is not None:
            state.update(held)
            if late is not None:
                _expire_after(state, new[ts].max(), idle)
        yield pd.DataFrame(out, columns=[group, row_id, key])

    return rows.groupBy(group).applyInPandasWithState(step, fields, "id long, key string", "append", timeout)


def cursor_suffix(trajectories: DataFrame, session: str = "session_id", number: str = "n", digest: str = "digest", ts: str = "ts", late: str | None = None, idle: str = "30 days") -> DataFrame:
    """Resumable cursor per session: the last trajectory seen is looked at again each time; one that has grown in place
    is put out with the digest that it supersedes. With a watermark (late) over ts, an idle session is forgotten; its
    later rows count as new, which a merge by key takes."""
    fields = f"{session} string, {number} long, {digest} string, superseded string"
    rows, timeout = _expiring(trajectories, ts, late)

    def step(k: tuple, batches, state: GroupState):
        out = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame(out, columns=[session, number, digest, "superseded"])
            return
        last, old = state.get if state.exists else (-1, None)
        new = pd.concat(list(batches)).sort_values(number)
        for n, d in new[[number, digest]].itertuples(index=False):
            if n > last or (n == last and d != old):
                out.append((k[0], int(n), d, old if n == last else None))
                last, old = int(n), d
        state.update((last, old))
        if late is not None:
            _expire_after(state, new[ts].max(), idle)
        yield pd.DataFrame(out, columns=[session, number, digest, "superseded"])

    return rows.groupBy(session).applyInPandasWithState(step, fields, "last long, digest string", "append", timeout)


def exactly_once(stream: DataFrame, key: str, sink: Callable[[DataFrame, int], None], checkpoint: str, ts: str | None = None, late: str = "7 days"):
    """Runs all available input once; rows already seen are dropped by state, and the sink's merge is by key, so a
    replayed micro-batch changes nothing. With ts the state holds the keys of the time `late` only, and the merge takes
    what comes again after it; without, it holds every key."""
    once = stream.dropDuplicates([key]) if ts is None else stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    query = once.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_to_table(stream: DataFrame, path: str, keys: list[str] | None = None) -> DataFrame:
    """Drives a stream over all available input into Parquet, a folder per micro-batch that a replay overwrites. With
    keys the stream runs in update mode, and the last row of a key counts."""
    spark, kind = stream.sparkSession, T.StructType([*stream.schema, T.StructField("batch", T.LongType())])
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/batch=-1")

    def write(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={n}")

    query = stream.writeStream.foreachBatch(write).outputMode("update" if keys else "append").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(kind).parquet(path)
    if keys:
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("row")).select("row.*")
    return rows.select(*stream.columns)
