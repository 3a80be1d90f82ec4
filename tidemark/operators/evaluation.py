"""Retrieval and answer metrics. Ranked rows: query_id, position from 1, relevant boolean."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def rank_metrics(ranked: DataFrame, by: str = "query_id") -> DataFrame:
    """hit@1/3/5, reciprocal rank within 10, recall-any@10, NDCG@10 with the ideal of the retrieved top ten."""
    first = F.min(F.when(F.col("relevant"), F.col("position")))
    gain = F.when(F.col("relevant") & (F.col("position") <= 10), 1 / F.log2(F.col("position") + 1)).otherwise(0.0)
    hits = F.count_if(F.col("relevant") & (F.col("position") <= 10))
    rows = ranked.groupBy(by).agg(first.alias("first"), F.sum(gain).alias("dcg"), hits.alias("hits"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("hits"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    at = lambda k: F.coalesce(F.col("first") <= k, F.lit(False)).cast("int")
    return rows.select(
        by, at(1).alias("hit1"), at(3).alias("hit3"), at(5).alias("hit5"), at(10).alias("recall10"),
        F.when(F.col("first") <= 10, 1 / F.col("first")).otherwise(0.0).alias("mrr10"),
        F.when(F.col("hits") == 0, 0.0).otherwise(F.col("dcg") / ideal).alias("ndcg_retrieved"),
    )


def standard_ndcg(ranked: DataFrame, totals: DataFrame, k: int = 10) -> DataFrame:
    """NDCG@k whose ideal holds all relevant rows (totals: query_id, n_relevant)."""
    gain = F.when(F.col("relevant") & (F.col("position") <= k), 1 / F.log2(F.col("position") + 1)).otherwise(0.0)
    rows = ranked.groupBy("query_id").agg(F.sum(gain).alias("dcg")).join(totals, "query_id")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("n_relevant", F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return rows.select("query_id", (F.col("dcg") / ideal).alias("ndcg"))


def metrics_by(per_query: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """Means by group with an overall row (group null)."""
    return per_query.rollup(group).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])


def faithfulness(claims: DataFrame, price_in: float = 0.0, price_out: float = 0.0) -> DataFrame:
    """Counts of claims by verdict and their shares, with a guard for none. Columns verdict, tokens_in, tokens_out."""
    v = tx.verdict(F.col("verdict"))
    total = F.count(F.lit(1))
    share = lambda c: F.round(F.coalesce(F.try_divide(F.count_if(c), total), F.lit(0.0)), 6)
    cost = F.sum(F.col("tokens_in")) * price_in / 1e6 + F.sum(F.col("tokens_out")) * price_out / 1e6
    return claims.agg(total.alias("claims"), *[F.count_if(v == x).alias(x) for x in ("supported", "partial", "unsupported")], share(v == "supported").alias("faithful"), share(v == "unsupported").alias("unsupported_share"), F.round(F.coalesce(cost, F.lit(0.0)), 6).alias("cost"))


def judged(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Claims (answer_id, claims array) with verdicts (answer_id, n from 1, verdict, reason); missing ones are unsupported."""
    rows = claims.select("answer_id", F.posexplode("claims").alias("at", "claim")).withColumn("n", F.col("at") + 1)
    joined = rows.join(verdicts, ["answer_id", "n"], "left")
    return joined.select("answer_id", "n", "claim", tx.verdict(F.coalesce("verdict", F.lit(""))).alias("verdict"), F.coalesce(F.when(F.trim("reason") != "", F.col("reason")), F.lit("no reason given")).alias("reason"))


def with_rank(results: DataFrame, truth: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Rank of the first row of the true trajectory for each query, or null."""
    hit = results.join(truth, query_id, "right")
    return hit.groupBy(query_id).agg(F.min(F.when(F.col("trajectory_id") == F.col("true_id"), F.col("position"))).alias("true_rank"))


def covered(arms: list[DataFrame], key: str) -> DataFrame:
    """Keys that every arm has."""
    out = arms[0].select(key)
    for arm in arms[1:]:
        out = out.intersect(arm.select(key))
    return out


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of n rows: the smallest hashes of seed and key."""
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)).limit(n)


def run_answers(questions: DataFrame, answer: Callable[[str], str], judge: Callable[[str], str]) -> DataFrame:
    """Answers questions (id, question), splits them into claims and judges each, with injected models; a judge that
    fails leaves its claims unjudged."""
    import pandas as pd

    from ..functions.segments import split_claims

    def run(batches):
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                text = answer(r["question"])
                for claim, _ in split_claims(text or "", 1000):
                    try:
                        verdict = judge(claim)
                    except Exception:  # noqa: BLE001  a failed judgement is data
                        verdict = None
                    out.append({"id": r["id"], "claim": claim, "verdict": verdict})
            yield pd.DataFrame(out, columns=["id", "claim", "verdict"])

    return questions.select(F.col("id").cast("string").alias("id"), "question").mapInPandas(run, "id string, claim string, verdict string")


def ask(question: str, candidates: DataFrame, model: Callable[[str, list[str]], str]) -> dict:
    """One call over at most 50 candidates (position, content, tier, ...): the answer, its outcome and cited flags; no call without candidates."""
    rows = [r.asDict() for r in candidates.orderBy("position").limit(50).collect()]
    if not rows:
        return {"answer": None, "outcome": "no_candidates", "sources": []}
    text = model(question, [r["content"][:2000] for r in rows])
    import re

    cited = {int(n) for n in re.findall(r"\[([0-9]{1,9})\]", text) if 1 <= int(n) <= len(rows)}
    return {"answer": text, "outcome": "answered" if cited else "not_covered", "sources": [r | {"n": i, "cited": i in cited} for i, r in enumerate(rows, 1)]}
