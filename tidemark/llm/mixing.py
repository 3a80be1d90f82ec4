"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 12).

1. Targets: sources, by code point, weigh 3, 1, 2 and so on and share a multiple of all words; none has more than a stated
   multiple of its own words, and what is beyond is shared anew by weight. Filled in the order of limit to weight this is a
   running sum over the sources.
2. Blocks: texts are cut into segments of at most SEGMENT_WORDS words, which a hash deals to the blocks of their source, of
   about BLOCK_WORDS words. A source is taken in passes over its blocks, each in a permutation of its own; the last pass
   ends inside the block and the segment where the target is met, to the word. Its place comes from running sums over
   chunks of blocks, then over the blocks of one chunk.
3. Tree: every source has thus an exact quota of blocks. The root holds all output shards; a node draws how many blocks of
   each source go to the left half of its shards from the multivariate hypergeometric distribution, by a generator seeded
   with the node. So each shard has the composition of a uniform shuffle of all blocks, and the quotas are met exactly. A
   task follows only the nodes that its own blocks pass. A block's place in its source's permutation tells which way it
   goes, so blocks are drawn once, disjointly, with no exchange but the one by shard.
4. Local shuffle: a shard, of about SHARD_BLOCKS blocks, is ordered by a hash.

Rows are thin (no texts) from the first step on. The driver holds the quotas of COLOURS groups of sources at most; a group
is one source unless there are more, and then its sources follow each other in it. One row for each source meets in one
task for the targets. A source table of more than BROADCAST_SOURCES rows is joined by a shuffle instead of a broadcast.
Nothing depends on partitions or files: reruns agree.

Defined cases: a null text has no words; texts without words are never drawn (taken is 0) and a source without words has
the target 0; a null source is a source, the last one; very long texts are many segments; rows that are equal in id, source
and text are told apart by nothing, so the mix may take either; repeated and null ids are kept; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, quoted

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
SEGMENT_WORDS, BLOCK_WORDS, SHARD_BLOCKS = 1024, 1 << 16, 64
MOST_BLOCKS = 1 << 27  # of a mix; beyond it blocks grow
CHUNK = 1024  # blocks
COLOURS, BROADCAST_SOURCES = 1024, 10_000
SEED = 12
#: Primes above any number of blocks, so that multiplication modulo that number permutes; one for each pass in turn.
STEPS = (2147483647, 2147483629, 2147483587)
WORD = r"[^\x20\x09-\x0D]+"


def sizes(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Thin rows: id, source, size in words, and a key of the row's id, source and text."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    i, s = quoted(id_col).cast("long").alias("i"), quoted(source_col).cast("string").alias("s")
    return df.select(i, s, F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.lit(SEED), i, s, text).alias("key"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sources (s, source_size), a row each, with number (by code point, null last), weight and target. The level (words
    for a weight of 1) rises while sources are at their limit and falls after them, so its greatest value is the answer."""
    by_name = Window.orderBy(F.asc_nulls_last("s"))
    rows = sources.withColumn("number", F.row_number().over(by_name) - 1)
    rows = rows.withColumn("weight", F.array(*map(F.lit, weights))[F.col("number") % len(weights)].cast("double")).withColumn("limit", (most * F.col("source_size")).cast("double"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "number")
    before = F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy()
    rows = rows.withColumn("level", (share * F.sum("source_size").over(every) - before) / left)
    rows = rows.withColumn("target", F.least("limit", F.max("level").over(every) * F.col("weight")))
    return rows.select("s", "source_size", "number", "weight", "target")


def _segments(rows: DataFrame) -> DataFrame:
    """A row per segment: seg, length, and its block b. Rows carry n_blocks of their source."""
    many = F.ceil(F.col("size") / SEGMENT_WORDS)
    cut = rows.where("size > 0").withColumn("seg", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))
    length = F.least(F.lit(SEGMENT_WORDS).cast("long"), F.col("size") - F.col("seg") * SEGMENT_WORDS)
    return cut.withColumn("length", length).withColumn("b", F.pmod(F.xxhash64(F.lit(SEED), "key", "seg"), F.col("n_blocks")))


def _at(turn: int | str):
    """Place of block b in the permutation of a pass."""
    step = F.element_at(F.array(*[F.lit(p).cast("long") for p in STEPS]), (F.expr(str(turn)) % len(STEPS) + 1).cast("int"))
    return F.pmod(F.col("b") * step + F.pmod(F.xxhash64(F.lit(SEED), "s", F.expr(str(turn)).cast("int")), F.col("n_blocks")), F.col("n_blocks"))


def _with_sources(rows: DataFrame, sources: DataFrame, names: list[str], few: bool) -> DataFrame:
    own = sources.select(F.col("s").alias("_s"), *names)
    return rows.join(F.broadcast(own) if few else own, F.col("s").eqNullSafe(F.col("_s"))).drop("_s")


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, bool]:
    """A row per source: its target, n_blocks, whole passes, and, of the pass after them, how many whole blocks and how many
    words of the next; the colour that it has in the tree and where its blocks begin in it. And whether sources are few."""
    counts = materialise(sized.groupBy("s").agg(F.sum("size").alias("source_size")), "sources")
    n, words = counts.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    few = n <= BROADCAST_SOURCES
    each = max(block_words, -(-(words or 0) * most // MOST_BLOCKS))
    rows = targets(counts, weights, share, most).withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / each)).cast("long"))
    rows = rows.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    rows = rows.withColumn("rest", F.least(F.col("source_size"), F.greatest(F.lit(0), F.round("target").cast("long") - F.col("passes") * F.col("source_size"))))
    rows = materialise(rows, "targets")
    parts = _segments(_with_sources(sized, rows.where("rest > 0"), ["n_blocks", "passes"], few))
    blocks = materialise(parts.withColumn("at", _at("passes")).groupBy("s", "at").agg(F.sum("length").alias("words")), "blocks")

    def reached(table: DataFrame, order: str) -> DataFrame:
        """Of each source the row (in order) in which the running sum passes what is left."""
        w = Window.partitionBy("s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return table.withColumn("end", F.sum("words").over(w)).where("end - words <= left AND left < end").withColumn("left", F.col("left") - F.col("end") + F.col("words"))

    chunks = blocks.groupBy("s", F.floor(F.col("at") / CHUNK).alias("chunk")).agg(F.sum("words").alias("words"))
    chunk = reached(_with_sources(chunks, rows.select("s", F.col("rest").alias("left")), ["left"], few), "chunk").select(F.col("s").alias("_s"), F.col("chunk").alias("_chunk"), "left")
    inside = blocks.join(F.broadcast(chunk) if few else chunk, F.col("s").eqNullSafe(F.col("_s")) & (F.floor(F.col("at") / CHUNK) == F.col("_chunk"))).drop("_s", "_chunk")
    block = reached(inside, "at").select(F.col("s").alias("_s"), "at", "left")
    whole = F.when(F.col("rest") > 0, F.coalesce("at", "n_blocks")).otherwise(0)
    rows = rows.join(block, F.col("s").eqNullSafe(F.col("_s")), "left").withColumn("whole", whole.cast("long")).withColumn("cut", F.coalesce("left", F.lit(0)).cast("long"))
    rows = rows.withColumn("quota", F.when(F.col("source_size") > 0, F.col("passes") * F.col("n_blocks") + F.col("whole") + (F.col("cut") > 0).cast("long")).otherwise(0))
    rows = rows.withColumn("colour", (F.col("number") % COLOURS).cast("int"))
    first = F.sum("quota").over(Window.partitionBy("colour").orderBy("number")) - F.col("quota")
    return materialise(rows.withColumn("first", first).select("s", "source_size", "target", "n_blocks", "passes", "whole", "cut", "quota", "colour", "first"), "quotas"), few


class Tree:
    """Deals the blocks of each colour, numbered from 0 to its quota, to shards of like numbers of blocks."""

    def __init__(self, quotas: list[int], shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> None:
        self.quotas, self.seed = np.array(quotas, np.int64), seed
        self.total = int(self.quotas.sum())
        self.shards = max(1, -(-self.total // shard_blocks))

    def _room(self, first: int, end: int) -> int:
        return self.total * end // self.shards - self.total * first // self.shards

    def split(self, quotas: np.ndarray, first: int, end: int) -> np.ndarray:
        """How many blocks of each colour go to the left half of the shards first .. end - 1."""
        draw = np.random.default_rng([self.seed, first, end])
        return draw.multivariate_hypergeometric(quotas, self._room(first, (first + end) // 2), method="marginals")

    def shard(self, colour: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The shard of each block. Only nodes that one of them passes are drawn."""
        out = np.zeros(len(block), np.int64)
        work = [(np.arange(len(block)), np.zeros_like(self.quotas), self.quotas, 0, self.shards)]
        while work:
            mine, begin, quotas, first, end = work.pop()
            if end - first == 1:
                out[mine] = first
                continue
            left, middle = self.split(quotas, first, end), (first + end) // 2
            goes = block[mine] < (begin + left)[colour[mine]]
            if goes.any():
                work.append((mine[goes], begin, left, first, middle))
            if not goes.all():
                work.append((mine[~goes], begin + left, quotas - left, middle, end))
        return out


def draws(sized: DataFrame, sources: DataFrame, few: bool, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The mix: shard, place in it, and what stands there: the row's columns, pass, first word and length."""
    totals = dict(sources.groupBy("colour").agg(F.sum("quota")).collect())  # COLOURS rows at most
    tree = Tree([totals.get(c, 0) for c in range(max(totals, default=-1) + 1)], shard_blocks)
    parts = _segments(_with_sources(sized, sources.where("quota > 0"), ["n_blocks", "passes", "whole", "cut", "colour", "first"], few))
    turns = parts.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes")))).withColumn("at", _at("turn"))
    whole = turns.where("turn < passes OR at < whole")
    last = turns.where("turn = passes AND at = whole AND cut > 0")  # a block of each source
    order = Window.partitionBy("s").orderBy(F.xxhash64(F.lit(SEED + 1), "key", "seg"), "key", "seg", "i").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("length", F.least("length", F.col("cut") - F.sum("length").over(order) + F.col("length"))).where("length > 0")
    names = [*sized.columns, "turn", "seg", "length"]
    rows = whole.union(last).select(*names, "colour", (F.col("first") + F.col("turn") * F.col("n_blocks") + F.col("at")).alias("block"))

    def dealt(batches):
        for batch in batches:
            shard = tree.shard(batch.column("colour").to_numpy(), batch.column("block").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(shard)], [*names, "shard"])

    found = rows.mapInArrow(dealt, rows.select(*names, F.lit(0).cast("long").alias("shard")).schema)
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(SEED + 2), "key", "seg", "turn"), "key", "seg", "turn")
    return found.withColumn("place", F.row_number().over(local) - 1)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Rows (shard, place, id, source, key, pass, start, length): the words that stand in the mix, in order."""
    sized = materialise(sizes(df, id_col, text_col, source_col), "sizes")
    sources, few = plan(sized, **options)
    rows = draws(sized, sources, few)
    return rows.select("shard", "place", F.col("i").alias(id_col), F.col("s").alias(source_col), "key", F.col("turn").alias("pass"), (F.col("seg") * SEGMENT_WORDS).alias("start"), "length")


def texts(df: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """shard, place and text of a mix of df. Rows that are equal have equal texts, so any of them will do."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    own = df.select(F.xxhash64(F.lit(SEED), quoted(id_col).cast("long"), quoted(source_col).cast("string"), text).alias("key"), text.alias("text")).dropDuplicates(["key"])
    part = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    return mixed.select("shard", "place", "key", "start", "length").join(own, "key").select("shard", "place", F.array_join(part, " ").alias("text"))


def taken(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """A row per row of df: id, size, source_size, target, taken (words in the mix), and how many pieces in how many shards."""
    numbered = sizes(df, id_col, text_col, source_col).withColumn("row", F.monotonically_increasing_id())
    sized = materialise(numbered, "sizes")  # written once, so numbers hold
    sources, few = plan(sized, **options)
    mixed = materialise(draws(sized, sources, few), "mix")
    per = mixed.groupBy("row").agg(F.sum("length").alias("taken"), F.count(F.lit(1)).alias("pieces"), F.count_distinct("shard").alias("shards"))
    rows = _with_sources(sized.join(per, "row", "left"), sources, ["source_size", "target"], few)
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "pieces", "shards")]
    return rows.select(F.col("i").alias(id_col), "size", "source_size", "target", *zero)


#: The columns of a mix that SQL can express: sizes and targets.
TARGETS_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][number % {len(WEIGHTS)} + 1]::DOUBLE AS weight, ({MOST} * source_size)::DOUBLE AS most FROM s),
l AS (SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW o AS (ORDER BY most / weight, number))
SELECT doc_id, size, source_size, least(most, (SELECT max(level) FROM l) * weight) AS target
FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source
"""
