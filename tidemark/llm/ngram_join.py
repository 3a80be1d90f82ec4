"""Exact Jaccard self-join of word n-gram sets with set-relation skipping (operator 5).

1. Equal sets are one class, named by a hash of the set; all later work is on classes.
2. A task packs its classes in flushes of bounded size. Their shingles meet by hash in buckets, where each gets the
   number of classes that hold it; what is shared goes back to its flush. Bytes for a shingle do not depend on the
   number of buckets: it travels with its place in the flush, and the flush keeps names, sizes and ids. A shingle
   that no other class holds can be in no intersection, so a class with more of those than a link may lose drops
   out; of the others only the shared shingles are kept, rarest first. Shingles that a bounded sample shows to be
   frequent are ordered last without being gathered.
3. Index lists hold the classes of each prefix shingle. Each list's most central set (the one with the smallest
   share of shingles of its own) leads it and is compared with all others first. Answer-level skipping: two sets'
   intersections with their leader bound their own intersection from both sides, so pairs are ruled out, or linked,
   from the leader's answers alone; sets that links have joined already are not compared again.
4. Index-level skipping: lists that still meet several components are sorted by size and cut into blocks; by the
   positions in the ordered sets a pair's intersection is bounded, and blocks whose bounds rule out a link are
   skipped whole. What remains is compared. Long lists are split into pairs of blocks that go to different tasks.

Two documents link when 100 * |intersection| >= 100 * t * |union|; every link between classes is found or implied
by links that are found, so components are exact as far as 64-bit hashes tell shingles (and sets) apart: at 30 GB
about one pair of unlike shingles is expected to share a hash, which could move one intersection by one.

Defined cases: null and blank texts have no shingle and link with nothing; with fewer words than n the whole
sequence is one shingle; very long texts are one set, held whole in the task that reads them; sizes exactly at the
threshold link; of sets that are equally central the one with the smallest name leads, which changes no result;
repeated rows are in one class; a null id takes its component's smallest id, or null; an empty table gives an empty
result; extra columns are ignored by ``join`` and kept by ``keep_first``, which decides by id: rows with the same id
go or stay together, and go when any of their texts is linked to a smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WordHash, materialise, plan_bytes, quoted, raw_texts, release, steps
from .blobs import pack, slices, unpack
from .components import components, joined

WORDS, PERCENT = 5, 75
SAMPLE_ROWS, SEEN = 2_000, 10  # sampled texts at least; how often a frequent shingle is seen in them
LEAST_PLACES, LISTED, WORD_BYTES = 20_000, 2_000_000, 6  # places of a shingle that one bucket may gather; shingles listed; bytes of text a place
FLUSH, FLUSH_DOCS = 500_000, 60_000
BUCKET_BYTES = 6 << 20  # of the table, for two buckets of shingles
BLOCK, SPLIT = 64, 512
ROWS = 64  # blobs that leave a task at a time
LEAST_BUCKETS = 256
NO_SET = 0xFFFFFFFF
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingles(text: bytes, hashes: dict, n: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(31))) * _ODD[(k + 1) % 5] + h[k : k + len(out)] * _ODD[k % 5]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _need(n, percent: int):
    """Least intersection that a set of n can have with a set it links to."""
    return -(-percent * n // 100)


def _frequent(rows: DataFrame, words: int) -> np.ndarray:
    """Shingles of many texts, told from a sample that grows with the input: a shingle of `most` places or more is seen
    some 2 * SEEN times, and one of half as many SEEN times, which lists it. So no bucket gathers many more than `most`
    places of one shingle. The list only orders shingles and sends them past the buckets; it has at most 2 * LISTED
    shingles, as all places together are LISTED times `most`."""
    total = max(1, rows.count())
    most = max(LEAST_PLACES, plan_bytes(rows) // WORD_BYTES // LISTED)
    fraction = min(1.0, max(SAMPLE_ROWS / total, 2 * SEEN / most))

    def cut(batches):
        hashes = WordHash()
        for batch in batches:
            for step in steps([batch], "text"):
                sets = {s.tobytes(): s for s in (shingles(t, hashes, words) for t in raw_texts(step.column("text")))}
                if sets:
                    token, count = np.unique(np.concatenate(list(sets.values())), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count)], ["s", "n"])

    few = rows.select("text").sample(fraction=fraction, seed=3).repartition(max(4, round(fraction * total / SAMPLE_ROWS)))
    found = few.mapInArrow(cut, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN)
    return np.sort(found.select("s").toArrow().column("s").to_numpy().view(np.uint64))


def _member(tokens: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(tokens), bool)
    return listed[np.minimum(np.searchsorted(listed, tokens), len(listed) - 1)] == tokens


def _classes(rows: DataFrame, buckets: int, parts: int, words: int, percent: int) -> DataFrame:
    """Document rows (i, n, fp) and, for each class that may link, its shared shingles, rarest first. A class that
    lies in several flushes gives a row for each."""
    frequent = _frequent(rows, words)

    def scan(batches):
        hashes = WordHash()
        place = TaskContext.get().partitionId()
        held: dict[int, int] = {}  # place of a class in the flush
        sets: list[np.ndarray] = []
        names: list[int] = []
        ids, owns = [], []
        flushes = size = 0

        def flush():
            nonlocal flushes, size
            f = -1 - (place << 32 | flushes)
            flushes += 1
            size = 0
            ns = np.array([len(x) for x in sets], np.uint32)
            valid = np.array([x is not None for x in ids], np.uint8)
            meta = pack(np.array(names, np.uint64), ns, np.array([x or 0 for x in ids], np.int64), valid, np.array(owns, np.uint32))
            out = [(f, f, meta, None)]
            if sets:
                token, doc = np.concatenate(sets), np.repeat(np.arange(len(ns)), ns)
                listed = _member(token, frequent)
                if listed.any():  # known to be shared: straight to its flush, ordered after all that are counted
                    part, of = token[listed], doc[listed]
                    out.append((f, f, None, _thin(part, of, -1, buckets, np.full(len(of), NO_SET, np.uint32))))
                    token, doc = token[~listed], doc[~listed]
                for key, own in slices(_bucket(token, buckets)):
                    out.append((key, f, None, _thin(token[own], doc[own], key, buckets)))
            for x in (held, sets, names, ids, owns):
                x.clear()
            for at in range(0, len(out), ROWS):
                k, flush_of, b, d = zip(*out[at : at + ROWS])
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(flush_of, pa.int64()), pa.array(b, pa.binary()), pa.array(d, pa.binary())], ["k", "f", "b", "d"])

        for batch in batches:
            for step in steps([batch], "text"):
                for i, text in zip(step.column("i").to_pylist(), raw_texts(step.column("text"))):
                    s = shingles(text, hashes, words)
                    own = NO_SET
                    if len(s):
                        name = xxhash.xxh64_intdigest(s.tobytes())
                        own = held.get(name)
                        if own is None:
                            own = held[name] = len(sets)
                            sets.append(s)
                            names.append(name)
                            size += len(s)
                    ids.append(i)
                    owns.append(own)
                    if size >= FLUSH or len(ids) >= FLUSH_DOCS:
                        yield from flush()
        if ids:
            yield from flush()
        release()

    def count(table: pa.Table) -> pa.Table:
        """Of one bucket, the shingles that several classes (or flushes) hold, back to their flushes; others as they are."""
        if table.column("k")[0].as_py() < 0:
            return table
        key, blobs, flushes = table.column("k")[0].as_py(), table.column("d").to_pylist(), table.column("f").to_pylist()
        parts = [_thick(blob, buckets)[:2] for blob in blobs]
        token, doc = (np.concatenate(x) for x in zip(*parts))
        of = np.repeat(np.arange(len(parts), dtype=np.uint32), [len(t) for t, _ in parts])
        order = np.argsort(token, kind="stable")
        starts = np.nonzero(np.append(True, token[order][1:] != token[order][:-1]))[0]
        many = np.diff(np.append(starts, len(token))).astype(np.uint32)
        df = np.empty(len(token), np.uint32)
        df[order] = np.repeat(many, many)
        shared = df > 1
        token, doc, of, df = token[shared], doc[shared], of[shared], df[shared]
        out = [(flushes[k], _thin(token[own], doc[own], key, buckets, df[own])) for k, own in slices(of)] if len(of) else []
        f = pa.array([x[0] for x in out], pa.int64())
        return pa.table({"k": f, "f": f, "b": pa.nulls(len(out), pa.binary()), "d": pa.array([x[1] for x in out], pa.binary())})

    def select(table: pa.Table) -> pa.Table:
        """Of one flush, its documents and the classes that may link."""
        metas = [b for b in table.column("b").to_pylist() if b is not None]
        name, size, ids, valid, owns = unpack(metas[0], "<u8", "<u4", "<i8", "u1", "<u4")
        size, known = size.astype(np.int64), owns != NO_SET
        at = np.where(known, owns, 0)
        n, fp = (np.where(known, x[at], 0) if len(x) else np.zeros(len(owns), x.dtype) for x in (size, name.view(np.int64)))
        docs = pa.table({"i": pa.array(ids, mask=valid == 0), "n": pa.array(n), "fp": pa.array(fp), "own": pa.nulls(len(ids), pa.int64()), "shared": pa.nulls(len(ids), pa.list_(pa.int64()))})
        parts = [_thick(b, buckets) for b in table.column("d").to_pylist() if b is not None]
        if not parts:
            return docs
        token, owner, df = (np.concatenate(x) for x in zip(*parts))
        held = np.bincount(owner, minlength=len(name))
        may = held >= _need(size, percent)
        stays = may[owner]
        token, owner, df = token[stays], owner[stays], df[stays]
        order = np.lexsort((token, df, owner))
        token = token[order].view(np.int64)
        good = np.nonzero(may)[0]
        offsets = np.concatenate([[0], np.cumsum(held[good])]).astype(np.int32)
        found = pa.table({"i": pa.nulls(len(good), pa.int64()), "n": pa.array(size[good]), "fp": pa.array(name[good].view(np.int64)), "own": pa.array(size[good] - held[good]), "shared": pa.ListArray.from_arrays(pa.array(offsets), pa.array(token))})
        return pa.concat_tables([docs, found])

    kind = "k long, f long, b binary, d binary"
    met = rows.mapInArrow(scan, kind).repartition(parts, "k").groupBy("k").applyInArrow(count, kind)
    return met.repartition(parts, "k").groupBy("k").applyInArrow(select, "i long, n long, fp long, own long, shared array<long>")


def _bucket(token: np.ndarray, buckets: int) -> np.ndarray:
    """Of `buckets`, that of a shingle, by the upper half of its hash; all 64 bits of it travel. Above 2^32 buckets some stay empty."""
    return ((token >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _first_of(bucket: int, buckets: int) -> np.uint64:
    """Upper half of the least hash in a bucket."""
    return np.uint64(-(-(bucket << 32) // buckets))


def _thin(token: np.ndarray, doc: np.ndarray, bucket: int, buckets: int, df: np.ndarray | None = None) -> bytes:
    """Shingles of one bucket (-1: of any), the places of their classes in ascending order and, where they are known,
    their counts. Bytes are laid out in planes, of which those that hold little compress away; what is above the
    first shingle of one of LEAST_BUCKETS buckets fits seven bytes."""
    rest = token if bucket < 0 else token - (_first_of(bucket, buckets) << np.uint64(32))
    step = np.diff(doc.astype(np.int64), prepend=0)
    count = np.zeros(0, np.uint32) if df is None else df
    plane = lambda x, at: (x.astype(np.uint64) >> np.uint64(8 * at) & np.uint64(255)).astype("u1")
    planes = [(rest & np.uint64(0xFFFFFFFF)).astype("<u4"), (rest >> np.uint64(32) & np.uint64(0xFFFF)).astype("<u2"), plane(rest, 6), plane(rest, 7) if bucket < 0 else np.zeros(0, "u1")]
    return pack(np.array([bucket], "<i8"), *planes, *(plane(step, k) for k in range(4)), *(plane(count, k) for k in range(4)))


def _thick(blob: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, places and counts again."""
    bucket, low, middle, high, top, *planes = unpack(blob, "<i8", "<u4", "<u2", *["u1"] * 10)
    wide = lambda some, kind: sum((p.astype(kind) << kind(8 * k) for k, p in enumerate(some)), np.zeros(len(some[0]), kind))
    token = low.astype(np.uint64) | middle.astype(np.uint64) << np.uint64(32) | high.astype(np.uint64) << np.uint64(48)
    if len(top):
        token |= top.astype(np.uint64) << np.uint64(56)
    if bucket[0] >= 0:
        token += _first_of(int(bucket[0]), buckets) << np.uint64(32)
    return token, np.cumsum(wide(planes[:4], np.int64)).astype(np.uint32), wide(planes[4:], np.uint32)


def _once(sets: DataFrame, parts: int) -> DataFrame:
    """A row per class."""

    def first(batches):
        seen: set[int] = set()
        for batch in batches:
            own = []
            for at, fp in enumerate(batch.column("fp").to_pylist()):
                if fp not in seen:
                    seen.add(fp)
                    own.append(at)
            yield batch.take(pa.array(own, pa.int64()))

    return sets.repartition(parts, "fp").mapInArrow(first, sets.schema)


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, inside (the size of the intersection), linked of the pairs (a, b)."""
    side = lambda x: sets.select(F.col("fp").alias(x), F.col("n").alias(f"n_{x}"), F.col("shared").alias(f"s_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").withColumn("inside", F.size(F.array_intersect("s_a", "s_b")).cast("long"))
    return both.select("a", "b", "inside", ((100 + percent) * F.col("inside") >= percent * (F.col("n_a") + F.col("n_b"))).alias("linked"))


def block_pairs(n: np.ndarray, rest: np.ndarray, component: np.ndarray, side: np.ndarray, percent: int, answer: np.ndarray | None = None, leader: int = 0):
    """(i, j, sure) of the pairs of one list (or pair of its parts) that may link: of different components, with
    sizes and remaining lengths that allow it. Rows are taken in blocks by size; blocks that cannot hold a pair are
    skipped. `answer` has the rows' intersections with the list's leader, a set of `leader` shingles, or -1 where it
    was not computed: they bound the intersection of two rows from both sides, so a pair is ruled out, or sure."""
    answer = np.full(len(n), -1) if answer is None else answer
    order = np.argsort(n, kind="stable")
    edges = list(range(0, len(order), BLOCK))
    blocks = [order[e : e + BLOCK] for e in edges]
    facts = [(int(n[b].min()), int(n[b].max()), int(rest[b].max()), set(component[b].tolist()) if len(b) else set()) for b in blocks]
    for x in range(len(blocks)):
        for y in range(x, len(blocks)):
            (low, high, most, own), (low2, _, most2, own2) = facts[x], facts[y]
            if 100 * high < percent * low2:
                break  # later blocks are larger still
            if (100 + percent) * min(most, most2) < percent * (low + low2) or (len(own) == 1 and own == own2):
                continue
            a, b = blocks[x][:, None], blocks[y][None, :]
            need = percent * (n[a] + n[b])
            good = ((100 + percent) * np.minimum(rest[a], rest[b]) >= need) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (component[a] != component[b]) & ((side[a] != side[b]) | (side[a] < 0))
            if x == y:
                good &= np.arange(len(blocks[x]))[:, None] < np.arange(len(blocks[y]))[None, :]
            both = (answer[a] >= 0) & (answer[b] >= 0)
            above = np.minimum(answer[a], answer[b]) + np.minimum(n[a] - answer[a], n[b] - answer[b])
            good &= ~both | ((100 + percent) * above >= need)
            sure = both & ((100 + percent) * (answer[a] + answer[b] - leader) >= need)
            i, j = np.nonzero(good)
            yield from zip(blocks[x][i].tolist(), blocks[y][j].tolist(), sure[i, j].tolist())


def _remaining(lists: DataFrame, leaders: DataFrame, answers: DataFrame, found: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Pairs (a, b, sure) across components within a list that neither positions nor the leader's answers rule out."""
    known = lists.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    several = known.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("m")).where("c0 <> c1")
    open_rows = known.join(several.select("token", "m"), "token").join(leaders.select("token", "leader", "n_leader"), "token")
    open_rows = open_rows.withColumn("a", F.least("fp", "leader")).withColumn("b", F.greatest("fp", "leader")).join(answers.select("a", "b", "inside"), ["a", "b"], "left")
    open_rows = open_rows.withColumn("answer", F.when(F.col("fp") == F.col("leader"), F.col("n_leader")).otherwise(F.coalesce("inside", F.lit(-1))))
    ways = F.ceil(F.col("m") / SPLIT).cast("int")
    own = F.pmod(F.xxhash64("fp"), ways).cast("int")
    # A long list is cut into parts; each pair of parts is a list of its own.
    dealt = open_rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), ways - 1)))
    dealt = dealt.select("token", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "fp", "n", "rest", "component", "answer", "n_leader")

    def pair(batches):
        out: dict[tuple[int, int], bool] = {}

        def compare(t: pa.Table):
            token, p, q, own, fp, n, rest, component, answer, leader = (t.column(c).to_numpy() for c in ("token", "p", "q", "own", "fp", "n", "rest", "component", "answer", "n_leader"))
            change = (token[1:] != token[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
            for group in np.split(np.arange(len(token)), np.nonzero(change)[0] + 1):
                if len(group) < 2:
                    continue
                side = own[group] if p[group[0]] != q[group[0]] else np.full(len(group), -1)
                for i, j, sure in block_pairs(n[group], rest[group], component[group], side, percent, answer[group], int(leader[group[0]])):
                    a, b = int(fp[group[i]]), int(fp[group[j]])
                    key = (a, b) if a < b else (b, a)
                    out[key] = sure or out.get(key, False)
                    if len(out) > 50_000:
                        yield drained()

        def drained():
            batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array(list(out.values()), pa.bool_())], ["a", "b", "sure"])
            out.clear()
            return batch

        # Sorted rows come in; the last list of a batch may go on in the next one.
        tail: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in ("token", "p", "q")]
            last = np.ones(batch.num_rows, bool)
            for k in keys:
                last &= k == k[-1]
            cut = int(np.argmax(last))
            if tail and (cut or any(tail[0].column(c)[0].as_py() != k[0] for c, k in zip(("token", "p", "q"), keys))):
                yield from compare(pa.Table.from_batches([*tail, batch.slice(0, cut)]))
                tail = [batch.slice(cut)]
            else:
                if cut:
                    yield from compare(pa.Table.from_batches([batch.slice(0, cut)]))
                tail.append(batch.slice(cut))
        if tail:
            yield from compare(pa.Table.from_batches(tail))
        yield drained()

    sorted_rows = dealt.repartition(tasks, "token", "p", "q").sortWithinPartitions("token", "p", "q")
    return sorted_rows.mapInArrow(pair, "a long, b long, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure"))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id of every row."""
    spark = df.sparkSession
    rows = df.select(quoted(id_col).cast("long").alias("i"), quoted(text_col).cast("string").alias("text"))
    buckets = max(LEAST_BUCKETS, -(-2 * plan_bytes(df) // BUCKET_BYTES))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-plan_bytes(df) // BUCKET_BYTES))
    all_rows = materialise(_classes(rows, buckets, tasks, words, percent), "shingle-classes")
    docs = all_rows.where("own IS NULL").select("i", "n", "fp")
    sets = materialise(_once(all_rows.where("own IS NOT NULL").select("n", "fp", "own", "shared"), tasks), "shingle-sets")
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100).cast("long") + 1 - F.col("own")
    lists = sets.select("fp", "n", "own", F.posexplode(F.slice("shared", F.lit(1), prefix.cast("int"))).alias("at", "token"))
    lists = lists.select("token", "fp", "n", (F.col("n") - F.col("own") - F.col("at")).alias("rest"), (F.col("own") / F.col("n")).alias("share"))
    leaders = lists.groupBy("token").agg(F.min(F.struct("share", "fp", "n")).alias("l"), F.count(F.lit(1)).alias("m")).where("m > 1").select("token", F.col("l.fp").alias("leader"), F.col("l.n").alias("n_leader"))
    leaders = materialise(leaders, "list-leaders")
    close = 100 * F.least("n", "n_leader") >= percent * F.greatest("n", "n_leader")
    first = lists.join(leaders, "token").where((F.col("fp") != F.col("leader")) & close).select(F.least("fp", "leader").alias("a"), F.greatest("fp", "leader").alias("b")).distinct()
    answers = materialise(_compared(first, sets, percent), "leader-answers")
    found = materialise(components(answers.where("linked")), "leader-components")
    rest = _remaining(lists, leaders, answers, found, percent, tasks).join(answers.select("a", "b"), ["a", "b"], "left_anti")
    rest = materialise(rest, "open-pairs")
    further = materialise(rest.where("sure").select("a", "b").union(_compared(rest.where("NOT sure"), sets, percent).where("linked").select("a", "b")), "further-links")
    found = joined(found, further)
    named = docs.where("n > 0").join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("i").alias("component_id"))
    linked = named.join(least, "component").select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    alone = docs.where("n = 0").select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), F.col("i").alias("component_id"))
    return linked.union(alone)


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of df whose id is the smallest of their component (and those without id), with all their columns."""
    found = join(df, id_col, text_col, words, percent)
    name = "__dropped"
    while name in df.columns:
        name += "_"
    drop = found.where(quoted(id_col) != F.col("component_id")).select(quoted(id_col).alias(name)).distinct()
    return df.join(drop, quoted(id_col).cast("long") == F.col(name), "left_anti")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, ws, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' '))) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)
), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (
  SELECT doc_id AS d, doc_id AS c FROM w UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.d AND r.c < u.b
)
SELECT d AS doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = d GROUP BY d
"""
