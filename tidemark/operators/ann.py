"""An inverted-file index for approximate nearest neighbours: rows lie in folders by their nearest centroid, and a query
opens the folders of its nearest centroids only.

Centroids are fitted on a bounded sample of rows (SAMPLE, by the hash of the id); every row is indexed, those without a
vector or with a zero one in list -1, which no query probes. Recall depends on the data: `probes_for` measures, against
the exact search, how many lists a recall takes. With as many probes as lists the search is exact."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import retrieval

SAMPLE, ROUNDS = 20_000, 12
QUERY_BLOCK = 2_000


def _units(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(1e-300, np.linalg.norm(v, axis=1, keepdims=True))


def fit(vectors: DataFrame, lists: int, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids by spherical k-means; fewer than `lists` where the sample has fewer rows."""
    rows = vectors.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample).select(vector_col).collect()
    if not rows:
        return np.zeros((0, 0))
    v = _units(np.array([r[0] for r in rows], dtype=float))
    centres = v[: min(lists, len(v))].copy()  # rows by hash are in random order
    for _ in range(ROUNDS):
        own = (v @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        used = np.linalg.norm(sums, axis=1) > 1e-12
        centres[used] = _units(sums[used])
    return centres


def assign(vectors: DataFrame, centres: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, embedding, list."""

    def nearest(batches):
        import pyarrow as pa

        for batch in batches:
            own = np.full(batch.num_rows, -1, np.int32)
            has = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            if has.any() and len(centres):
                v = batch.column(1).drop_null().flatten().to_numpy().astype(float).reshape(int(has.sum()), -1)
                own[has] = np.where(np.linalg.norm(v, axis=1) > 0, (v @ centres.T).argmax(1), -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own)], [id_col, vector_col, "list"])

    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<float>")).mapInArrow(nearest, f"`{id_col}` long, `{vector_col}` array<float>, list int")


def write(vectors: DataFrame, path: str, centres: np.ndarray, splits: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
    """The index below path; the rows of a list are dealt to `splits` tasks, so let it grow with the table."""
    rows = assign(vectors, centres, id_col, vector_col)
    dealt = rows.repartition(max(1, len(centres)) * splits, "list", F.pmod(F.xxhash64(id_col), F.lit(splits)))
    dealt.write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    spark = vectors.sparkSession
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def read_centres(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("list").collect()], dtype=float)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """query_id, id, similarity, rank of the k nearest rows in each query's `probes` lists; ties by id. Queries go to the
    tasks in blocks of a fixed size, a task keeps k rows per query, and lists that no query of a block probes are not
    opened. Without queries or rows the result is empty."""
    centres = read_centres(spark, path)
    stored = spark.read.schema(f"`{id_col}` long, `{vector_col}` array<float>, list int").parquet(f"{path}/rows")
    fields = f"`{query_id}` long, `{id_col}` long, similarity double"

    def block(rows: list) -> DataFrame:
        ids, q = [r[0] for r in rows], _units(np.array([r[1] for r in rows], dtype=float))
        near = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes]
        asked = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}

        def nearest(batches):
            import pyarrow as pa

            best = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
            step = max(1, retrieval.SCORES // len(ids))
            for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
                v = _units(batch.column(1).flatten().to_numpy().astype(float).reshape(batch.num_rows, -1))
                own, lists = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                for c in np.unique(lists):
                    here = lists == c
                    scores = q[asked[int(c)]] @ v[here].T
                    for row, s in zip(asked[int(c)], scores):
                        s, i = np.concatenate([best[row][0], s]), np.concatenate([best[row][1], own[here]])
                        keep = np.lexsort((i, -np.round(s, 12)))[:k]
                        best[row] = s[keep], i[keep]
            for row, (s, i) in enumerate(best):
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array([ids[row]] * len(i), pa.int64()), pa.array(i), pa.array(s)], [query_id, id_col, "similarity"])

        return stored.where(F.col("list").isin(*map(int, asked))).select(id_col, vector_col, "list").mapInArrow(nearest, fields)

    asked = queries.select(query_id, "q").where("q IS NOT NULL")
    none = spark.createDataFrame([], fields)
    out = retrieval.in_blocks(asked, lambda rows: block(rows) if rows and len(centres) else none, QUERY_BLOCK)
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc(F.round("similarity", 12)), id_col))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def probes_for(vectors: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, recall: float = 0.9, most: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id") -> int:
    """The fewest probes at which a bounded set of measured queries (`most` by hash) finds that share of its exact k
    nearest rows. One exact search; a true neighbour is found when its list is among the probed ones."""
    asked = queries.orderBy(F.xxhash64(query_id), query_id).limit(most).select(query_id, "q")
    exact = retrieval.batch_topk(vectors, asked, k, id_col, vector_col, query_id).select(query_id, id_col)
    own = assign(vectors.join(F.broadcast(exact.select(id_col).distinct()), id_col, "left_semi"), centres, id_col, vector_col).select(id_col, "list")
    at = {r[0]: r[1] for r in asked.collect()}
    order = {i: np.argsort(np.argsort(-(centres @ np.array(q, dtype=float)), kind="stable"), kind="stable") for i, q in at.items()}
    places = sorted(int(order[r[0]][r[1]]) if r[1] >= 0 else len(centres) for r in exact.join(own, id_col).select(query_id, "list").collect())
    return 1 if not places else min(len(centres), places[int(np.ceil(recall * len(places))) - 1] + 1)
