"""Centroid clustering of integer vectors by exponion search (operator 13).

Lloyd's rounds over whole numbers, so that every distance and mean is exact. A vector travels with its centroid a, an
upper bound u of its distance to a and a lower bound l of its distance to any other. The next round loosens both by how
far the centroids moved. A vector needs no search while u is below l, or below half of the distance s from a to the
centroid nearest to a. For the others u is made exact; where that does not settle it, only centroids inside the ball of
radius 2u + s around a are scanned: the nearest and the second nearest lie within. For each centroid the others are listed
by distance, so a ball is the head of a list, cut by binary search; vectors of a batch with the same centroid and like
heads are compared at once. The radius includes its border and every bound leaves room for rounding, so that centroids at
equal distance are all compared, as whole numbers, and the smaller number wins.

Each round writes vectors and bounds to the shared folder and sums the components by cluster in the JVM (partial sums in
each task, one row per cluster after the shuffle). The driver holds the centroids alone: k times the width.

Defined cases: vectors of another width, null vectors and vectors with a null or non-finite component are left out;
components beyond +-LIMIT after scaling count as +-LIMIT, so that a squared distance fits a long; a null id counts as
the empty text where ids are hashed and stays null; repeated rows are vectors of their own, and of seeds with equal ids the
smaller vector comes first; with fewer vectors than k there are as many centroids as vectors; of equal centroids the first
takes all, the others keep their place; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise, quoted

CLUSTERS, ROUNDS, WIDTH, SCALE, SEED = 16, 3, 64, 64, 1
LIMIT = 1 << 27
ROOM = 1e-9  # relative room for the rounding of roots
BLOCK = 4096  # vectors that are compared at once


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of a to rows of b (n x m)."""
    if a.size and b.size and max(np.abs(a).max(), np.abs(b).max()) < 1 << 20:  # sums below 2^53 are exact as doubles
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)).astype(np.int64)
    return np.stack([((a - c) ** 2).sum(1) for c in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances row by row."""
    return ((a - b) ** 2).sum(1)


class Centroids:
    """Centroids with their lists of others by distance, and how far each has moved since the bounds were set."""

    def __init__(self, places: np.ndarray, before: np.ndarray | None = None) -> None:
        self.places, self.k = places, len(places)
        gaps = np.sqrt(squared(places, places).astype(np.float64))
        np.fill_diagonal(gaps, -1.0)  # a centroid heads its own list
        self.others = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.others, axis=1)
        self.nearest = self.gaps[:, 1] if self.k > 1 else np.full(self.k, np.inf)
        self.moved = np.zeros(self.k) if before is None else np.sqrt(paired(places, before).astype(np.float64))
        # the largest move of the others: that of the one that moved most, or of the second for itself
        order = np.argsort(-self.moved, kind="stable")
        self.others_moved = np.full(self.k, self.moved[order[0]])
        self.others_moved[order[0]] = self.moved[order[1]] if self.k > 1 else 0.0

    def _two(self, vectors: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the centroids `among`: the nearest (the smaller number of a tie), its distance and the second distance, squared."""
        among = np.sort(among)
        d = squared(vectors, self.places[among])
        first = np.argmin(d, axis=1)
        rows = np.arange(len(d))
        nearest = d[rows, first]
        if len(among) == 1:
            return among[first], nearest, np.full(len(d), -1, np.int64)
        d[rows, first] = np.iinfo(np.int64).max
        return among[first], nearest, d.min(axis=1)

    def start(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, upper and lower bound, and squared distance of vectors that have no bounds yet."""
        cluster, near, second = self._two(vectors, np.arange(self.k))
        return cluster, np.sqrt(near) * (1 + ROOM), np.where(second < 0, np.inf, np.sqrt(np.maximum(second, 0))) * (1 - ROOM), near

    def search(self, vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, seen: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, upper and lower bound after the centroids moved. `seen` collects how many centroids a search compared."""
        cluster, upper = cluster.copy(), (upper + self.moved[cluster]) * (1 + ROOM)
        lower = (lower - self.others_moved[cluster]) * np.where(lower > self.others_moved[cluster], 1 - ROOM, 1 + ROOM)
        safe = np.maximum(lower, self.nearest[cluster] / 2 * (1 - ROOM))
        open_ = np.nonzero(upper >= safe)[0]
        upper[open_] = np.sqrt(paired(vectors[open_], self.places[cluster[open_]])) * (1 + ROOM)
        open_ = open_[upper[open_] >= safe[open_]]
        radius = (2 * upper[open_] + self.nearest[cluster[open_]]) * (1 + ROOM)
        heads = np.zeros(len(open_), np.int64)
        for a in np.unique(cluster[open_]).tolist():
            own = cluster[open_] == a
            heads[own] = np.searchsorted(self.gaps[a], radius[own], side="right")
        heads = np.minimum(1 << np.ceil(np.log2(np.maximum(heads, 1))).astype(np.int64), self.k)  # heads of like size go together
        key = cluster[open_] * (2 * self.k) + heads
        for group in np.unique(key).tolist():
            mine = open_[key == group]
            among = self.others[group // (2 * self.k), : group % (2 * self.k)]
            if seen is not None:
                seen.append((len(mine), len(among)))
            cluster[mine], near, second = self._two(vectors[mine], among)
            upper[mine] = np.sqrt(near) * (1 + ROOM)
            lower[mine] = np.where(second < 0, np.inf, np.sqrt(np.maximum(second, 0))) * (1 - ROOM)
        return cluster, upper, lower


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, width: int, scale: int) -> DataFrame:
    """id and v (array of long) of the vectors that count."""
    x = quoted(vector_col).cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kept = df.where(F.coalesce((F.size(x) == width) & fine, F.lit(False)))
    whole = lambda e: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), e * F.lit(float(scale)))))
    return kept.select(quoted(id_col).cast("long").alias("id"), F.transform(x, whole).alias("v"))


def _seeds(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    rank: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(rank.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64)


def _pass(rows: DataFrame, centroids: Centroids, last: bool) -> DataFrame:
    """The rows with the cluster and bounds under these centroids; in the last pass also the squared distance."""
    fresh = "cluster" not in rows.columns
    names = ["id", "cluster", "distance"] if last else ["id", "v", "cluster", "u", "l"]

    def moved(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                held = part.column("v")
                v = held.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(np.int64)
                if fresh:
                    cluster, upper, lower, _ = centroids.start(v)
                else:
                    cluster, upper, lower = centroids.search(v, *(part.column(c).to_numpy() for c in ("cluster", "u", "l")))
                if last:
                    out = [part.column("id"), pa.array(cluster, pa.int32()), pa.array(paired(v, centroids.places[cluster]))]
                else:
                    out = [part.column("id"), held, pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower)]
                yield pa.RecordBatch.from_arrays(out, names)

    return rows.mapInArrow(moved, "id long, cluster int, distance long" if last else "id long, v array<int>, cluster int, u double, l double")


def _means(rows: DataFrame, centroids: Centroids, width: int) -> np.ndarray:
    """Componentwise floor of the means; a cluster without vectors keeps its centroid."""
    sums = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(width)]
    found = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect()  # a row per cluster
    places = centroids.places.copy()
    for r in found:
        places[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return places


def cluster(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED
) -> tuple[DataFrame, np.ndarray]:
    """A row per vector that counts (id, cluster, distance squared) after so many rounds and a last assignment, and the
    centroids."""
    vectors = whole_vectors(df, id_col, vector_col, width, scale).withColumn("v", F.col("v").cast("array<int>"))
    seeds = _seeds(vectors, k, seed)
    if not len(seeds):
        return vectors.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where(F.lit(False)), seeds
    centroids, rows = Centroids(seeds), vectors
    for _ in range(rounds):
        rows = materialise(_pass(rows, centroids, False), "vectors")
        centroids = Centroids(_means(rows, centroids, width), centroids.places)
    found = materialise(_pass(rows, centroids, True), "clusters")
    return found.withColumnRenamed("id", id_col), centroids.places


def summary(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """A row per vector: id, cluster, distance, cluster_inertia, inertia, and the digest of the final centroid."""
    found, places = cluster(df, id_col, vector_col, **options)
    digests = [(c, hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for c, p in enumerate(places.tolist())]
    named = df.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    totals = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # k rows
    whole = totals.agg(F.sum("cluster_inertia").alias("inertia"))
    per = totals.join(F.broadcast(whole)).join(F.broadcast(named), "cluster")
    return found.join(F.broadcast(per), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(rounds: int = ROUNDS) -> str:
    """Lloyd's rounds with all distances, one table of (vector, component) and one of (centroid, component) a round."""
    assigned = lambda r: f"""
a{r} AS MATERIALIZED (SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT x.row, m.c, sum((x.x - m.x) * (x.x - m.x)) AS d FROM x JOIN m{r} m ON m.i = x.i GROUP BY ALL) GROUP BY row)"""  # noqa: E731
    moved = lambda r: f"""
m{r + 1} AS MATERIALIZED (SELECT m.c, m.i, coalesce(s.x, m.x) AS x FROM m{r} m LEFT JOIN (
  SELECT a.c, x.i, sum(x.x) AS total, count(*) AS n,
         CASE WHEN total >= 0 THEN total // n ELSE -((-total + n - 1) // n) END AS x
  FROM a{r} a JOIN x ON a.row = x.row GROUP BY a.c, x.i) s ON s.c = m.c AND s.i = m.i)"""  # noqa: E731
    parts = [p for r in range(rounds) for p in (assigned(r), moved(r))] + [assigned(rounds)]
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, [floor({SCALE} * v::DOUBLE)::BIGINT FOR v IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len([v FOR v IN embedding IF v IS NULL OR NOT isfinite(v)]) = 0),
x AS MATERIALIZED (SELECT row, unnest(range({WIDTH})) AS i, unnest(v) AS x FROM k),
s AS (SELECT row, (row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), v) - 1)::INTEGER AS c FROM k
      QUALIFY c < {CLUSTERS}),
m0 AS MATERIALIZED (SELECT s.c, x.i, x.x FROM s JOIN x USING (row)),
{",".join(parts)},
h AS (SELECT c, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM m{rounds} GROUP BY c)
SELECT k.vec_id, a.c AS cluster, a.d::BIGINT AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
       sum(a.d) OVER ()::BIGINT AS inertia, h.centroid_sha256
FROM a{rounds} a JOIN k USING (row) JOIN h ON h.c = a.c
"""


ORACLE_SQL = _sql()
