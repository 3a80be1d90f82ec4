"""A full-text index that follows the store and is read by blocks.

Segments: every batch of new or changed rows becomes a segment that is never changed. A row that is changed or removed is
named by a tombstone with the number of the batch; postings of the row in segments before that number do not count. Segments
of like size are merged into one, which drops what no longer counts. A snapshot names the segments and the tombstones, so
readers see all of a batch or none of it.

Blocks: ids are dealt to ranges by their hash, so that a range has some RANGE_ROWS rows. The postings of one term in one range
are a row: the ids, the positions, and the greatest number of positions that any of them has. The score of a query grows with
the number of covers. A position of the rarest of the query's G groups lies in G covers at most: of two covers around it that
start with the same group, the longer one would not need its start. So the maxima of a range bound the scores in it. A search reads the maxima of its terms first, then the blocks of the ranges with the highest
bounds, and then those of the ranges whose bound reaches the score of the last row wanted: no other block can hold a better
row, so the result is that of reading all. Folders go by the term's hash, and rows within by term and range, which is how few
row groups of few folders are opened.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fulltext, scans
from .store import Snapshots

BUCKETS, RANGE_ROWS = 64, 1024
FIRST_RANGES, MERGED = 4, 4  # ranges that are read first for each 50 rows wanted; segments of like size that are merged
POSTINGS = 2  # bytes of postings, as they are shuffled, by a byte of text
_GONE = "id string, before long"


def blocks(rows: DataFrame, ranges: int, buckets: int = BUCKETS, id_col: str = "id", text_col: str = "content", parts: int | None = None) -> DataFrame:
    """bucket, term, range, most, ids, positions: a row for each term and range; of several rows with one id the greatest text
    counts. The positions of a very common term are dealt over all ranges, so no row grows with the table. Texts are dealt to
    `parts` tasks by range, and a task inverts one range at a time: no posting is shuffled before it lies in its block."""
    own = rows.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("content"))
    own = own.withColumn("range", range_of(F.col("id"), ranges))
    parts = min(ranges, max(parts or 1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = own.repartitionById(parts, F.pmod("range", F.lit(parts)).cast("int")).sortWithinPartitions("range", "id", "content")
    found = fulltext.folded(dealt)
    return found.select(fulltext._bucket(F.col("term"), buckets).alias("bucket"), "term", "range", "most", "ids", "positions")


def range_of(row_id: Column, ranges: int | Column) -> Column:
    return F.pmod(F.xxhash64(row_id), ranges if isinstance(ranges, Column) else F.lit(ranges)).cast("int")


class TextIndex:
    """The index below a folder. One writer at a time; readers need no lock."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, range_rows: int = RANGE_ROWS) -> None:
        self.spark, self.root, self.buckets, self.range_rows = spark, root.rstrip("/"), buckets, range_rows
        self.manifest = Snapshots(spark, f"{self.root}/manifest")

    def _state(self) -> tuple[list, str | None, int]:
        """Segments, the table of tombstones, and the number of the last batch."""
        try:
            rows = self.manifest.read().collect()  # a row per segment: some tens, as segments are merged
        except Exception as e:  # nothing was written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return [], None, 0
        segments = [r for r in rows if r["path"] is not None]
        head = next(r for r in rows if r["path"] is None)
        return segments, head["gone"], head["seq"]

    def _commit(self, segments: list, gone: str | None, seq: int) -> None:
        rows = [(r[0], r[1], r[2], r[3], None) for r in segments] + [(seq, None, 0, 0, gone)]
        self.manifest.write(self.spark.createDataFrame(rows, "seq long, path string, rows long, ranges int, gone string").coalesce(1))

    def gone(self, path: str | None = None) -> DataFrame:
        """id, before: postings of the id in segments with a smaller number do not count."""
        path = path or self._state()[1]
        return self.spark.read.schema(_GONE).parquet(path) if path else self.spark.createDataFrame([], _GONE)

    def _marked(self, gone: str | None, ids: DataFrame, seq: int) -> str:
        new = ids.select(F.col("id").cast("string").alias("id"), F.lit(seq).cast("long").alias("before"))
        every = self.gone(gone).union(new) if gone else new
        path = f"{self.root}/tombstones/{seq}"
        every.groupBy("id").agg(F.max("before").alias("before")).write.mode("overwrite").parquet(path)
        return path

    def _written(self, found: DataFrame, seq: int, rows: int, ranges: int, kind: str, parts: int) -> tuple:
        """parts: tasks that shall write. The ranges of a folder are dealt to as many as that needs, each to one folder."""
        path = f"{self.root}/blocks/{kind}-{seq}"
        splits = -(-parts // self.buckets)
        to = F.col("bucket") * F.lit(splits) + F.pmod("range", F.lit(splits))
        dealt = found.repartitionById(self.buckets * splits, to.cast("int")).sortWithinPartitions("bucket", "term", "range")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)
        return seq, path, rows, ranges

    def upsert(self, rows: DataFrame, id_col: str = "id", text_col: str = "content") -> None:
        """New rows and new texts of known ones (of several rows with one id the greatest text counts); then merges what has
        grown alike."""
        segments, gone, seq = self._state()
        seq += 1
        sizes = rows.groupBy(F.col(id_col).cast("string").alias("id")).agg(F.max(F.octet_length(text_col)).alias("size"))
        n, size = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        if not n:
            return
        ranges, parts = max(1, -(-n // self.range_rows)), -(-size // scans.PART_BYTES)
        made = self._written(blocks(rows, ranges, self.buckets, id_col, text_col, parts), seq, n, ranges, "batch", parts * POSTINGS)
        if segments:
            gone = self._marked(gone, rows.select(F.col(id_col).alias("id")), seq)
        self._commit([*segments, made], gone, seq)
        self.merge()

    def remove(self, ids: DataFrame, id_col: str = "id") -> None:
        """Rows that no search shall find."""
        segments, gone, seq = self._state()
        if segments:
            seq += 1
            self._commit(segments, self._marked(gone, ids.select(F.col(id_col).alias("id")).where("id IS NOT NULL"), seq), seq)

    def merge(self, at_once: int = MERGED, everything: bool = False) -> None:
        """Merges segments of like size (within a factor of at_once) where there are as many; or all of them."""
        while True:
            segments, gone, seq = self._state()
            by: dict[int, list] = {}
            for s in segments:
                size = 0
                while at_once ** (size + 1) <= max(1, s["rows"]):
                    size += 1
                by.setdefault(0 if everything else size, []).append(s)
            some = next((x for _, x in sorted(by.items()) if len(x) >= (2 if everything else at_once)), None)
            if some is None:
                return
            live = self._live(self._entries(some), gone).select("term", "id", "positions")
            n = sum(s["rows"] for s in some)
            ranges = max(1, -(-n // self.range_rows))
            entry = F.array_sort(F.collect_list(F.struct("id", "positions")))
            folded = live.withColumn("range", range_of(F.col("id"), ranges)).groupBy("term", "range").agg(F.max(F.size("positions")).alias("most"), entry.alias("e"))
            found = folded.select(fulltext._bucket(F.col("term"), self.buckets).alias("bucket"), "term", "range", "most", F.col("e.id").alias("ids"), F.col("e.positions").alias("positions"))
            made = self._written(found, seq + 1, n, ranges, "merged", scans.tasks(found, self.buckets))
            # What a tombstone still has to hide lies in segments that were not merged.
            paths = {s["path"] for s in some}
            self._commit([*(s for s in segments if s["path"] not in paths), made], gone if len(some) < len(segments) else None, seq + 1)
            everything = False

    def _entries(self, segments: list, terms: list[str] | None = None) -> DataFrame:
        """term, id, positions, range, ranges, seq of segments' postings."""
        rows = self._blocks(segments, terms)
        return rows.select("term", "range", "segment", "seq", F.explode(F.arrays_zip("ids", "positions")).alias("e")).select("term", "range", "segment", "seq", F.col("e.ids").alias("id"), F.col("e.positions").alias("positions"))

    def _blocks(self, segments: list, terms: list[str] | None) -> DataFrame:
        schema = "term string, range int, most int, ids array<string>, positions array<array<int>>, bucket int"
        out, near = None, None
        if terms is not None:
            near = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(fulltext._bucket(F.col("term"), self.buckets)).distinct().collect()]
        for k, s in enumerate(segments):
            rows = self.spark.read.schema(schema).parquet(s["path"])
            if terms is not None:
                rows = rows.where(F.col("bucket").isin(near) & F.col("term").isin(terms))
            rows = rows.withColumn("segment", F.lit(k)).withColumn("seq", F.lit(s["seq"]).cast("long"))
            out = rows if out is None else out.union(rows)
        return out

    def _live(self, entries: DataFrame, gone: str | None) -> DataFrame:
        if not gone:
            return entries
        dead = self.gone(gone).select(F.col("id").alias("_id"), "before")
        return entries.join(dead, (F.col("id") == F.col("_id")) & (F.col("seq") < F.col("before")), "left_anti")

    def bounds(self, query: str) -> DataFrame:
        """segment, range, bound of the ranges in which a row may match, from the blocks' maxima alone."""
        clauses = [c for c in fulltext.parse_query(query) if not c.negated]
        groups = [sorted({t for p in c.phrases for t in p}) for c in clauses]
        segments, _, _ = self._state()
        heads = self._blocks(segments, sorted({t for g in groups for t in g})).select("segment", "range", "term", "most")
        each = [F.sum(F.when(F.col("term").isin(g), F.col("most"))).alias(f"g{k}") for k, g in enumerate(groups)]
        rows = heads.groupBy("segment", "range").agg(*each).where(" AND ".join(f"g{k} IS NOT NULL" for k in range(len(groups))))
        least = F.least(*[F.col(f"g{k}") for k in range(len(groups))]) if len(groups) > 1 else F.col("g0")
        covers = least * F.lit(float(len(groups)))
        return rows.select("segment", "range", (covers / (covers + 1.0)).alias("bound"))

    def search(self, query: str, limit: int, read: list | None = None) -> DataFrame:
        """id and keyword_score of the `limit` best rows, by score (12 places), then id. `read` collects how many ranges were
        read in each of the two steps, and of how many."""
        none = self.spark.createDataFrame([], "id string, keyword_score double")
        clauses = fulltext.parse_query(query)
        segments, gone, _ = self._state()
        if not segments or not any(not c.negated for c in clauses):
            return none
        terms = sorted({t for c in clauses for p in c.phrases for t in p})
        heads = self.bounds(query).persist()
        try:
            total = heads.count()
            first = heads.orderBy(F.desc("bound"), "segment", "range").limit(FIRST_RANGES * max(1, -(-limit // 50))).collect()

            def scored(ranges: list) -> DataFrame:
                if not ranges:
                    return none
                own = self.spark.createDataFrame([(r["segment"], r["range"]) for r in ranges], "segment int, range int")
                own = own.withColumnsRenamed({"segment": "_segment", "range": "_range"})
                numbers = sorted({r["range"] for r in ranges})
                rows = self._entries(segments, terms)
                rows = rows.where(F.col("range").isin(numbers)) if len(numbers) <= 1000 else rows
                rows = rows.join(F.broadcast(own), (F.col("segment") == F.col("_segment")) & (F.col("range") == F.col("_range")), "left_semi")
                return fulltext.search(self._live(rows, gone).select("term", "id", "positions"), query, limit)

            best = scored(first).collect()  # `limit` rows at most
            least = best[limit - 1]["keyword_score"] if len(best) >= limit else 0.0
            more = heads.where(F.col("bound") >= F.lit(least - 1e-12)).collect() if len(first) < total else []
            known = {(r["segment"], r["range"]) for r in first}
            more = [r for r in more if (r["segment"], r["range"]) not in known]
            if read is not None:
                read.append((len(first), len(more), total))
            found = self.spark.createDataFrame([(r["id"], r["keyword_score"]) for r in best], "id string, keyword_score double")
            return fulltext.best_first(found.union(scored(more)), limit)
        finally:
            heads.unpersist()

    def scores(self, query: str, ids: DataFrame, id_col: str = "id") -> DataFrame:
        """id and keyword_score of those of a few rows that match: only the ranges that hold them are read."""
        clauses = fulltext.parse_query(query)
        segments, gone, _ = self._state()
        none = self.spark.createDataFrame([], "id string, keyword_score double")
        wanted = [r[0] for r in ids.select(F.col(id_col).cast("string")).distinct().collect()]
        if not segments or not wanted or not any(not c.negated for c in clauses):
            return none
        terms = sorted({t for c in clauses for p in c.phrases for t in p})
        sizes = sorted({s["ranges"] for s in segments})
        asked = self.spark.createDataFrame([(w,) for w in wanted], "id string")
        at = asked.select(*[range_of(F.col("id"), n).alias(f"r{n}") for n in sizes]).collect()
        near = {n: sorted({r[f"r{n}"] for r in at}) for n in sizes}
        rows = self._entries(segments, terms)
        test = F.lit(False)
        for k, s in enumerate(segments):
            test = test | ((F.col("segment") == k) & F.col("range").isin(near[s["ranges"]]))
        rows = rows.where(test).join(F.broadcast(asked.withColumnRenamed("id", "_id")), F.col("id") == F.col("_id"), "left_semi")
        return fulltext.search(self._live(rows, gone).select("term", "id", "positions"), query, None)


def filtered(index: TextIndex, query: str, limit: int, admit: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The best rows that `admit` (found rows -> those that pass, with all columns wanted) lets through: it is asked for ever
    more of the best rows until enough pass or there are no more."""
    wanted = 4 * limit
    while True:
        best = index.search(query, wanted).collect()
        found = index.spark.createDataFrame([(r["id"], r["keyword_score"]) for r in best], "id string, keyword_score double")
        passed = fulltext.best_first(admit(found), limit)
        if len(best) < wanted or passed.count() >= limit:
            return passed
        wanted *= 8


def ordered_by_id(rows: DataFrame, path: str, files: int, id_col: str = "id") -> None:
    """A table to fetch single rows from: in ranges of the id, sorted, so few row groups hold any few ids; more
    files than given where the table is large."""
    rows.repartitionByRange(scans.tasks(rows, files), id_col).sortWithinPartitions(id_col).write.mode("overwrite").parquet(path)


def fetch(table: DataFrame, ids: DataFrame, id_col: str = "id", most: int = 10_000) -> DataFrame:
    """The rows of a table sorted by id whose id is among a few: the ids become a pushed filter. Beyond `most`, a join."""
    wanted = [r[0] for r in ids.select(id_col).distinct().limit(most + 1).collect()]
    if len(wanted) > most:
        return table.join(ids.select(id_col).distinct(), id_col, "left_semi")
    return table.where(F.col(id_col).isin(wanted))
