"""A navigable-graph index for nearest neighbours, with filters.

Rows are dealt by id to shards of a bounded number of vectors. A task that holds a shard links its vectors in layers: every
vector lies in the lowest one, each higher layer has a part of those below, and a vector's links go to near vectors in
different directions. A search descends greedily and then keeps a beam of the best vectors seen in the lowest layer. The
index is a table with a row per shard: ids, vectors, links (as array columns) and the columns that filters may name, so any
store that Spark reads will do, and a search reads it once for each block of queries, without a shuffle: a task keeps k rows
per query over all its shards, and only those meet.

A filter is a condition on the kept columns, evaluated for a whole shard at once. The distances of the rows that pass are then
taken in one product with the block of queries, which is exact at any beam: for a shard of SHARD_ROWS that is cheaper than
beams which widen until k admitted rows are in them. With a beam as wide as the shard a search would see every vector, as
all can be reached from the entry; its distances are taken in one product as well.

Vectors that are null, or zero, have no direction: they are in the index, in no graph, and are never found. Similarity is the
cosine; equal ones (to 12 places) go by id."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import materialise
from .retrieval import SCORES, Nearest, in_blocks, spread

LINKS, BUILD_BEAM, BEAM = 16, 64, 48
SHARD_ROWS, BUILD_STEP = 8_000, 256
QUERY_BLOCK, QUERY_STEP = 16_000, 1_000
MOVED = 500  # queries from which on searching a shard takes longer than moving it


class Layers:
    """The graph of one shard. `compared` counts the similarities that were computed."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[list[np.ndarray]] | None = None, most: int = LINKS) -> None:
        """vectors: of length 1. links: for each vector its neighbours in each of its layers."""
        self.v, self.levels, self.most, self.compared = vectors, levels, most, 0
        self.entry = int(np.argmax(levels)) if len(levels) else -1  # the first of the highest
        self.links = links if links is not None else [[np.zeros(0, np.int32) for _ in range(n + 1)] for n in levels.tolist()]

    def like(self, query: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        self.compared += len(nodes)
        return self.v[nodes] @ query

    def beam(self, query: np.ndarray, start: list[tuple[float, int]], level: int, width: int) -> list[tuple[float, int]]:
        """(similarity, node) of the best nodes that a beam of this width finds in a layer, in no order."""
        seen = {n for _, n in start}
        todo = [(-s, n) for s, n in start]
        best = list(start)  # the least is in front
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            s, node = heapq.heappop(todo)
            if len(best) >= width and -s < best[0][0]:
                break
            new = [n for n in self.links[node][level].tolist() if n not in seen]
            if not new:
                continue
            seen.update(new)
            for s, n in zip(self.like(query, np.array(new)).tolist(), new):
                if len(best) < width:
                    heapq.heappush(best, (s, n))
                    heapq.heappush(todo, (-s, n))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, n))
                    heapq.heappush(todo, (-s, n))
        return best

    def descend(self, query: np.ndarray, to: int) -> list[tuple[float, int]]:
        at = [(float(self.like(query, np.array([self.entry]))[0]), self.entry)]
        for level in range(int(self.levels[self.entry]), to, -1):
            at = [max(self.beam(query, at, level, 1))]
        return at

    def _padded(self, level: int) -> np.ndarray:
        """Links of a layer as a matrix, -1 after a node's last one."""
        own = [x[level] if len(x) > level else x[0][:0] for x in self.links]
        sizes = np.array([len(x) for x in own])
        out = np.full((len(own), max(1, int(sizes.max(initial=0)))), -1, np.int32)
        out[np.arange(out.shape[1]) < sizes[:, None]] = np.concatenate(own)
        return out

    def beams(self, queries: np.ndarray, nodes: np.ndarray, like: np.ndarray, level: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``beam`` finds from one node for each of many queries, a step of all of them at once: nodes (-1 where there are
        fewer), similarities, and for each query how many were computed. A step takes the best node of each beam whose links
        were not followed yet."""
        links, q = self._padded(level), np.arange(len(queries))
        best, s = np.full((len(q), width), -1), np.full((len(q), width), -np.inf)
        best[:, 0], s[:, 0] = nodes, like
        followed, seen, compared = best < 0, np.zeros((len(q), len(self.v)), bool), np.zeros(len(q), np.int64)
        seen[q, nodes] = True
        while len(q):
            todo = np.where(followed[q], -np.inf, s[q])
            at = todo.argmax(1)
            more = todo[np.arange(len(q)), at] > -np.inf
            q, at = q[more], at[more]
            followed[q, at] = True
            near = links[best[q, at]]
            row, column = np.nonzero((near >= 0) & ~seen[q[:, None], near])
            new = near[row, column]
            seen[q[row], new] = True
            compared += np.bincount(q[row], minlength=len(compared))
            own = np.full(near.shape, -np.inf)
            own[row, column] = np.einsum("ij,ij->i", self.v[new], queries[q[row]])
            both = np.concatenate([s[q], own], axis=1)
            kept = np.argpartition(-both, width - 1, axis=1)[:, :width]
            s[q] = np.take_along_axis(both, kept, 1)
            best[q] = np.take_along_axis(np.concatenate([best[q], near], axis=1), kept, 1)
            followed[q] = np.take_along_axis(np.concatenate([followed[q], np.zeros(near.shape, bool)], axis=1), kept, 1) | ~np.isfinite(s[q])
        return np.where(np.isfinite(s), best, -1), s, compared

    def nearest_of(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes, similarities and numbers of computed ones of what a search finds for each query, with no filter."""
        nodes = np.full(len(queries), self.entry)
        s, compared = queries @ self.v[self.entry], np.ones(len(queries), np.int64)
        for level in range(int(self.levels[self.entry]), 0, -1):
            found, like, more = self.beams(queries, nodes, s, level, 1)
            nodes, s, compared = found[:, 0], like[:, 0], compared + more
        found, like, more = self.beams(queries, nodes, s, 0, width)
        return found, like, compared + more

    def _apart(self, query: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
        """Of these nodes the nearest ones that are nearer to the query than to one taken before, then others to fill up."""
        own = self.v[nodes] @ query
        order = np.argsort(-own, kind="stable")
        nodes, own = nodes[order], own[order]
        between = self.v[nodes] @ self.v[nodes].T
        taken, k, nearest = np.zeros(len(nodes), bool), 0, np.full(len(nodes), -np.inf)
        for _ in range(most):  # the next one that is nearer to the query than to all taken ones
            more = np.flatnonzero(nearest[k:] < own[k:])
            if not len(more):
                break
            k += int(more[0])
            taken[k] = True
            nearest = np.maximum(nearest, between[k])
            k += 1
        return nodes[np.argsort(~taken, kind="stable")[:most]].astype(np.int32)

    def _near(self, nodes: np.ndarray, width: int) -> np.ndarray:
        """For each of a layer's nodes its links: of the `width` nearest ones those that ``_apart`` takes, for BUILD_STEP nodes at
        a time. A shard has a bounded number of rows, so all its distances are a few matrix products."""
        v, n = self.v[nodes], len(nodes)
        width, most = min(width, n - 1), min(self.most, n - 1)
        out = np.zeros((n, most), np.int32)
        for at in range(0, n, BUILD_STEP):
            s = v[at : at + BUILD_STEP] @ v.T
            row = np.arange(len(s))
            s[row, at + row] = -np.inf
            near = np.argpartition(-s, width - 1, axis=1)[:, :width]
            near = np.take_along_axis(near, np.lexsort((near, -np.take_along_axis(s, near, 1)), axis=1), 1)
            own = np.take_along_axis(s, near, 1)
            between = v[near] @ v[near].transpose(0, 2, 1)
            taken, nearest = np.zeros(near.shape, bool), np.full(near.shape, -np.inf)
            for k in range(width):
                taken[:, k] = (nearest[:, k] < own[:, k]) & (taken.sum(1) < most)
                nearest = np.where(taken[:, k, None], np.maximum(nearest, between[:, k]), nearest)
            out[at : at + BUILD_STEP] = nodes[np.take_along_axis(near, np.argsort(~taken, axis=1, kind="stable")[:, :most], 1)]
        self.compared += n * n
        return out

    def build(self, width: int = BUILD_BEAM) -> Layers:
        """Links the nodes of every layer to near ones and these back to them, then what no path reaches."""
        for level in range(int(self.levels.max(initial=-1)) + 1):
            nodes = np.flatnonzero(self.levels >= level)
            if len(nodes) < 2:
                continue
            near = self._near(nodes, width)
            source, target = np.repeat(nodes, near.shape[1]).astype(np.int32), near.ravel()
            order = np.argsort(target, kind="stable")
            ends = np.searchsorted(target[order], nodes, side="right").tolist()
            room, back, at = self.most * (2 if level == 0 else 1), source[order], 0
            for node, own, end in zip(nodes.tolist(), near, ends):
                more = back[at:end]  # ascending, each once
                both = np.concatenate([own, more[~(more[:, None] == own).any(1)]])
                self.links[node][level] = both if len(both) <= room else self._apart(self.v[node], both, room)
                at = end
        self._reach()
        return self

    def _reach(self) -> None:
        """Every node is linked, in the lowest layer, from one that the entry reaches."""
        reached = np.zeros(len(self.v), bool)
        todo = [self.entry] if len(self.v) else []
        reached[todo] = True
        while True:
            while todo:
                new = self.links[todo.pop()][0]
                new = new[~reached[new]]
                reached[new] = True
                todo += new.tolist()
            if reached.all():
                return
            lost, known = int(np.argmin(reached)), np.flatnonzero(reached)
            near = int(known[np.argmax(self.v[known] @ self.v[lost])])
            self.links[near][0] = np.append(self.links[near][0], np.int32(lost))
            reached[lost] = True
            todo = [lost]

    def nearest(self, query: np.ndarray, k: int, width: int, admitted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities of what a search finds: k or more, or all that are admitted."""
        n = len(self.v)
        some = n if admitted is None else int(admitted.sum())
        width = max(width, k)
        if not some:
            return np.zeros(0, int), np.zeros(0)
        if some < n and some <= width * self.most:  # no dearer than a beam
            nodes = np.flatnonzero(admitted)
            return nodes, self.like(query, nodes)
        while True:
            found = self.beam(query, self.descend(query, 0), 0, width)
            hits = found if admitted is None else [x for x in found if admitted[x[1]]]
            if len(hits) >= min(k, some) or width >= n:
                return np.array([x[1] for x in hits], int), np.array([x[0] for x in hits])
            width *= 2


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(1e-300, np.linalg.norm(v, axis=1, keepdims=True))


_GRAPH = "shard int, ids array<long>, vectors array<float>, levels array<int>, ends array<int>, neighbours array<int>"


def build(vectors: DataFrame, shards: int | None = None, keep: list[str] | None = None, id_col: str = "vec_id", vector_col: str = "embedding", most: int = LINKS, width: int = BUILD_BEAM) -> DataFrame:
    """The index of all rows: write it as a table. The number of shards follows from the number of rows, `shards` at least, so
    none grows with the table; `keep` are columns that filters may name."""
    shards = max(shards or 1, -(-vectors.count() // SHARD_ROWS))
    rest = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(None).cast("int").alias("_none"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"), rest.alias("kept"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    # A layer has a LINKS-th of the one below; which rows rise follows from the id alone.
    chance = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 40)) / float(1 << 40)
    rows = rows.withColumn("level", F.floor(-F.log(F.greatest(chance, F.lit(1e-9))) / F.log(F.lit(float(most)))).cast("int"))
    kept_type = rows.schema["kept"].dataType

    def graph(table):
        import pyarrow as pa

        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        raw = [np.array(x if x is not None else [], float) for x in table.column("v").to_pylist()]
        good = np.array([len(x) > 0 and np.isfinite(x).all() and np.linalg.norm(x) > 0 for x in raw], bool)
        order = np.argsort(~good, kind="stable")  # rows without a direction come last, in no graph
        table, some = table.take(pa.array(order)), int(good.sum())
        given = np.array([raw[i] for i in order[:some]], float) if some else np.zeros((0, 0))
        v = _unit(given)
        levels = np.minimum(table.column("level").to_numpy()[:some], 12)
        made = Layers(v, levels, most=most).build(width)
        flat = [n for node in made.links for n in node]
        ends = np.cumsum([len(x) for x in flat])
        row = {
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "ids": [table.column("id").to_pylist()], "vectors": pa.array([given.astype(np.float32).ravel()], pa.list_(pa.float32())),
            "levels": pa.array([levels], pa.list_(pa.int32())), "ends": pa.array([ends], pa.list_(pa.int32())), "neighbours": pa.array([np.concatenate(flat) if flat else []], pa.list_(pa.int32())),
            "kept": pa.array([table.column("kept").to_pylist()], pa.list_(table.schema.field("kept").type)),
        }
        return pa.table(row)

    kinds = T.StructType([*T._parse_datatype_string(_GRAPH).fields, T.StructField("kept", T.ArrayType(kept_type))])
    return rows.repartition(shards, "shard").groupBy("shard").applyInArrow(graph, kinds)


def _layers(ids: np.ndarray, vectors: np.ndarray, levels: np.ndarray, ends: np.ndarray, neighbours: np.ndarray) -> Layers:
    n = len(levels)
    parts = np.split(neighbours, ends[:-1]) if len(ends) else []
    cuts = np.cumsum(levels + 1)
    links = [parts[e - level - 1 : e] for e, level in zip(cuts.tolist(), levels.tolist())]
    return Layers(_unit(vectors.reshape(n, -1).astype(float)) if n else np.zeros((0, 0)), levels, links)


def search(
    index: DataFrame, queries: DataFrame, k: int, beam: int = BEAM, admits: Callable[[Column], Column] | None = None, id_col: str = "vec_id", query_id: str = "query_id", counted: bool = False
) -> DataFrame:
    """query_id, id, similarity, rank of the k nearest rows of each query (query_id, q) that a beam of this width finds in
    each shard. `admits` makes a condition from the kept columns of a row. The driver holds QUERY_BLOCK queries at a time;
    each block is one pass over the index and, where there are several, is written before the next. With `counted` there
    are also rows without an id, with the number of similarities that a task computed for a query in column compared."""
    spark = index.sparkSession
    admitted = F.transform("kept", lambda r: F.coalesce(admits(r), F.lit(False))) if admits else F.lit(None).cast("array<boolean>")
    rows = index.select("ids", "vectors", "levels", "ends", "neighbours", admitted.alias("admitted"))
    dealt = None
    fields = f"`{query_id}` long, `{id_col}` long, similarity double, compared long"

    def block(held: list) -> DataFrame:
        nonlocal dealt
        asked, q = [r[0] for r in held], _unit(np.array([r[1] for r in held], float))
        if len(asked) >= MOVED and dealt is None:  # a task for each shard: files have some, others none
            most = index.agg(F.max("shard")).head()[0]
            dealt = rows if most is None else index.select("shard", *rows.columns[:5], admitted.alias("admitted")).repartitionById(most + 1, F.col("shard")).drop("shard")

        def nearest(batches):
            import pyarrow as pa

            steps = [slice(at, at + QUERY_STEP) for at in range(0, len(asked), QUERY_STEP)]
            best, compared = [Nearest(len(asked[s]), k) for s in steps], np.zeros(len(asked), np.int64)
            for batch in batches:
                for r in range(batch.num_rows):
                    ids, vectors, levels, ends, neighbours = (batch.column(c)[r].values.to_numpy() for c in range(5))
                    mask, n = batch.column(5)[r], len(levels)
                    mask = mask.values.to_numpy(zero_copy_only=False)[:n] if mask.is_valid else None
                    if n and (mask is not None or max(beam, k) >= n):
                        v, ids = _unit(vectors.reshape(n, -1).astype(float)), ids[:n]
                        v, ids = (v, ids) if mask is None else (v[mask], ids[mask])
                        compared += len(v)
                        rows = max(1, SCORES // min(len(asked), QUERY_STEP))  # the score matrix of a step has SCORES entries at most
                        for s, found in zip(steps, best):
                            for at in range(0, len(v), rows):
                                found.near(q[s], v[at : at + rows], ids[at : at + rows])
                    elif n:
                        layers = _layers(ids, vectors, levels, ends, neighbours)
                        for s, found in zip(steps, best):
                            nodes, like, more = layers.nearest_of(q[s], max(beam, k))
                            compared[s] += more
                            row, column = np.nonzero(nodes >= 0)
                            found.merge(row, ids[nodes[row, column]], like[row, column])
            own = [np.array(asked[s], np.int64)[b.query] for s, b in zip(steps, best)]
            columns = [pa.array(np.concatenate(x)) for x in (own, [b.ids for b in best], [b.scores for b in best])]
            columns.append(pa.nulls(len(columns[0]), pa.int64()))
            if counted:
                columns = [pa.concat_arrays([c, more]) for c, more in zip(columns, [pa.array(asked, pa.int64()), pa.nulls(len(asked), pa.int64()), pa.nulls(len(asked), pa.float64()), pa.array(compared)])]
            yield pa.RecordBatch.from_arrays(columns, [query_id, id_col, "similarity", "compared"])

        out = (dealt if len(asked) >= MOVED and dealt is not None else rows).mapInArrow(nearest, fields)
        counts = F.col("compared").isNotNull()
        rank = F.row_number().over(Window.partitionBy(query_id, counts).orderBy(F.desc(F.round("similarity", 12)), id_col))
        best = out.withColumn("rank", rank).where(counts | (F.col("rank") <= k))
        return best if counted else best.drop("compared")

    none = spark.createDataFrame([], f"{fields}, rank int")
    none = none if counted else none.drop("compared")
    return in_blocks(queries.select(query_id, "q").where("q IS NOT NULL"), lambda held: block(held) if held else none, QUERY_BLOCK)


def measure(
    index: DataFrame, exact: DataFrame, queries: DataFrame, k: int, rows: int, beam: int = BEAM, id_col: str = "vec_id", query_id: str = "query_id", unique: DataFrame | None = None
) -> DataFrame:
    """One row: queries, recall against the exact neighbours (query_id, id), and the share of all distances computed. Queries may
    have a column `alike`, as how many each counts; `unique` is the table of ``once`` that the index holds, where it is one."""
    every = materialise(search(index, queries, k, beam, id_col=id_col, query_id=query_id, counted=True), "measured")
    found = every.where("compared IS NULL")
    found = (spread(found, unique, k, id_col, query_id) if unique is not None else found).select(query_id, id_col, F.lit(1).alias("_hit"))
    hits = exact.select(query_id, id_col).join(found, [query_id, id_col], "left").groupBy(query_id).agg(F.count(F.lit(1)).alias("n"), F.count("_hit").alias("hits"))
    cost = every.where("compared IS NOT NULL").groupBy(query_id).agg(F.sum("compared").alias("compared"))
    size = F.col("alike") if "alike" in queries.columns else F.lit(1)
    each = queries.where("q IS NOT NULL").select(query_id, size.alias("_size")).join(cost, query_id).join(hits, query_id, "left")
    total = lambda c: F.sum(F.col(c) * F.col("_size"))
    return each.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("queries"), (total("hits") / total("n")).alias("recall"), (total("compared") / F.lit(float(rows)) / F.sum("_size")).alias("share"))
