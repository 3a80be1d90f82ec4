"""Hybrid search from stored indexes: a query reads a few blocks of postings, the graph, and the candidates' rows.

Needed are a ``postings.TextIndex`` over the chunks, a ``smallworld`` index that keeps the columns which filters name, and the
chunks in a table sorted by id (``postings.ordered_by_id``) with their vectors but without their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vec
from . import postings, retrieval, smallworld

KEPT = ["invalid_at", "repo", "branch", "owner", "tier", "ts"]


def admits(f: retrieval.Filters):
    """The condition of ``retrieval.live`` on a row's kept columns."""

    def test(r: Column) -> Column:
        tests = [] if f.include_superseded else [r["invalid_at"].isNull()]
        tests += [r[c] == F.lit(v) for c, v in (("repo", f.repo), ("branch", f.branch), ("owner", f.owner)) if v is not None]
        if f.since is not None:
            tests.append(r["ts"] >= F.lit(f.since).cast("timestamp_ntz"))
        if retrieval.tiers(f.tier):
            tests.append(r["tier"].isin(*retrieval.tiers(f.tier)))
        out = F.lit(True)
        for t in tests:
            out = out & t
        return out

    return test


def hybrid_search(
    rows: DataFrame, texts: postings.TextIndex, graph: DataFrame, query_vector: DataFrame, query: str, f: retrieval.Filters, s: retrieval.Scoring, as_of: Column, beam: int = smallworld.BEAM, key: str = "doc_id", id_col: str = "id"
) -> DataFrame:
    """What ``retrieval.hybrid_search`` gives, as far as the beam finds the nearest rows. rows: sorted by id_col, with key (the
    graph's id), embedding and the filters' columns; chunks without a vector are left out."""
    limit = retrieval.clamp_limit(f.limit)
    spark = rows.sparkSession
    asked = query_vector.limit(1).select(F.lit(0).cast("long").alias("query_id"), "q")
    # The graph knows rows by key; ids are what the table is sorted by.
    near = smallworld.search(graph, asked, max(retrieval.VECTOR_POOL, limit), beam, admits(f), key).select(F.col(key).cast("string").alias(id_col))
    passes = lambda found: found.join(retrieval.live(postings.fetch(rows, found, id_col), f).where("embedding IS NOT NULL").select(id_col), id_col)
    named = postings.filtered(texts, query, max(retrieval.KEYWORD_POOL, limit), passes).select(id_col)
    ids = spark.createDataFrame([(r[0],) for r in near.union(named).distinct().collect()], f"`{id_col}` string")  # both pools
    found = postings.fetch(rows, ids, id_col).join(F.broadcast(query_vector.limit(1)))
    scored = found.select(id_col, "tier", "ts", "repo", "session_id", vec.cosine(F.col("embedding"), F.col("q")).alias("similarity"))
    both = scored.join(F.broadcast(texts.scores(query, ids, id_col)), id_col, "left").withColumn("keyword_score", F.coalesce("keyword_score", F.lit(0.0)))
    return retrieval.rescore(both, s, as_of).orderBy(F.desc_nulls_last("combined"), id_col).limit(limit)
