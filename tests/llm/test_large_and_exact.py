"""Texts beyond a step for each operator, the toxicity model from plain counts, and overlapping added spans."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import frame, words_of
from tidemark.llm import _common, decontaminate, edit_counts, exact_dedup, lm_score, mixing, ngram_join, packing, pii, quality, toxicity, warc
from tidemark.llm.tokens import encoder

STEPS = 5 << 20  # bytes: above STEP_BYTES


@pytest.fixture(scope="module")
def long_docs(spark):
    """A text of more than a step, twice (once in capitals), and short ones."""
    long = " ".join(f"w{i % 90_000} said {'me@x.org' if i % 500 == 0 else 'so'}" for i in range(STEPS // 12))
    assert len(long) > _common.STEP_BYTES
    texts = [long, long.upper(), "one two three four five six", "", None, "a needle of ten words that no other text has here"]
    return texts, frame(spark, texts)


def test_long_texts_exact_dedup(long_docs):
    texts, df = long_docs
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.groups(df).collect()}
    sha = hashlib.sha256(texts[0].lower().encode()).hexdigest()
    assert got[0] == (1, 2, False, sha) and got[1] == (1, 2, True, sha) and sorted(r.doc_id for r in exact_dedup.survivors(df).collect()) == [1, 2, 4, 5]


def test_long_texts_ngram_join(long_docs):
    texts, df = long_docs
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()}
    w = words_of(texts[0])
    assert got[0] == got[1] == (len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}), 0) and got[2] == (2, 2)


def test_long_texts_decontaminate(spark, long_docs):
    texts, df = long_docs
    w = texts[0].split()
    items = spark.createDataFrame([(1, " ".join(w[200_000:200_030])), (2, " ".join([*w[300_000:300_010], "gap", *w[300_010:300_030]]))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.hits(df, items).collect()}
    assert got[0, 1] == got[1, 1] == 0 and got[0, 2] == 1


def test_long_texts_packing_and_counts(spark, long_docs):
    texts, df = long_docs
    ids = encoder(None).encode(texts[0]) + b"\0\0\0\0"
    own = sorted((r for r in packing.pack(df).collect() if r.doc_id == 0), key=lambda r: r.piece)
    assert sum(r.length for r in own) == len(ids) // 4 and all(r.length == 2048 for r in own[1:])
    assert all(r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in own)
    some = texts[0][: _common.STEP_BYTES + 1000]
    counts = edit_counts.edit_aware_counts(frame(spark, [some]), lambda t: []).first()
    assert counts.n_tokens == counts.n_tokens_edited == len(encoder(None).encode(some)) // 4


def test_long_texts_scores(spark, long_docs):
    texts, df = long_docs
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    toxic, good = toxicity.train(docs, labels), quality.train(docs, labels)
    by = lambda rows: {r.doc_id: r for r in rows.collect()}
    scores = by(toxicity.score(df, toxic))
    assert scores[0].score == pytest.approx(toxic.score(toxicity.tokens(texts[0].encode()))[0]) and scores[0].score == scores[1].score
    assert 0 <= by(quality.score(df, good))[0].score <= 1
    lm = by(lm_score.score(df))
    n = len(words_of(texts[0])) + 1
    assert lm[0].n_tokens == lm[1].n_tokens == n and lm[0].base_score < 0 and lm[0].n_known == n
    taken = by(mixing.taken(df))
    assert taken[0].size == n - 1 and sum(r.taken for r in taken.values()) == round(taken[0].target)


def test_long_texts_pii_and_warc(spark, long_docs):
    texts, df = long_docs
    weights = {k: [0.0] * 6 for k in pii.KINDS}
    found = {r.doc_id: r.base for r in pii.detect(df, weights).where("doc_id < 2").collect()}
    want = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", texts[0])]
    assert [(x.start, x.end) for x in found[0] if x.kind == "email"] == want == [(x.start, x.end) for x in found[1] if x.kind == "email"]
    pages = df.where("doc_id IN (0, 2)").select(F.col("doc_id").alias("page_id"), F.lit("http://h").alias("url"), F.col("text").alias("html"))
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.round_trip(pages).collect()}
    assert got[0] == (len(texts[0].encode()), hashlib.sha256(texts[0].encode()).hexdigest())


def test_added_spans_may_overlap(spark):
    """Of added spans of a kind none overlaps a base span; two that different patterns found may overlap, and both are told."""
    texts = ["mail: jo (at) example (dot) org or call phone: 0555 123 4567 890", "card: 4111.1111.1111.1111 and card 1234 5678 9012 3456", "fe80::1 2001:db8:0:0:0:0:2:1"] * 3
    accept = {k: [5.0, 1.0, 1.0, 1.0, 1.0, 1.0] for k in pii.KINDS}
    for r in pii.detect(frame(spark, texts), accept).collect():
        for x in r.added:
            assert not any(b.kind == x.kind and b.start < x.end and x.start < b.end for b in r.base)
        assert len(set(r.added)) == len(r.added) and Counter(r.all) == Counter([*r.base, *r.added])
        assert [(pii.KINDS.index(x.kind), x.start) for x in r.all] == sorted((pii.KINDS.index(x.kind), x.start) for x in r.all)


def test_toxicity_by_brute_force(spark):
    """The whole model again: log-odds from plain counts, the extreme-value law, every segment by its definition, calibration."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    label = {r.doc_id: r.toxic for r in labels.collect() if r.toxic in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    words = {i: toxicity.tokens(texts[i].encode()) for i in label if i in texts}
    n = Counter(label[i] for i in words)
    count = (Counter(), Counter())
    for i, w in words.items():
        count[label[i]].update({*w, *("^" + x[: toxicity.STEM] for x in w)})
    every = {w: (count[0][w], count[1][w]) for w in count[0] | count[1] if count[0][w] + count[1][w] >= toxicity.LEAST_TEXTS}
    value = {}
    for w, (c0, c1) in every.items():
        prior = toxicity.PRIOR * (c0 + c1) / (n[0] + n[1])
        odds = lambda c, k: math.log((c + prior) / (n[k] + toxicity.PRIOR - c - prior))  # noqa: B023, E731
        delta = odds(c1, 1) - odds(c0, 0)
        z = delta / math.sqrt(1 / (c1 + prior) + 1 / (c0 + prior))
        value[w] = (delta if z > 3 else min(delta, 0.0) if z < -3 else 0.0) - toxicity.DRIFT
    want = {w: v for w, v in value.items() if w[0] != "^" or v > 0}
    assert set(model.scores) == set(want) and all(model.scores[w] == pytest.approx(v, abs=1e-12) for w, v in want.items())
    weight = {w: (every[w][0] if w[0] != "^" else 0) + 1e-9 for w in every}
    total = sum(weight.values()) + 1 + 1e-9
    mean = lambda f: (sum(weight[w] * f(value[w]) for w in every) + (1 + 1e-9) * f(-toxicity.DRIFT)) / total
    assert mean(lambda s: math.exp(model.rate * s)) == pytest.approx(1, abs=1e-6) and mean(lambda s: s) < 0
    assert model.scale == pytest.approx(min(1, max(1e-4, mean(lambda s: s) ** 2 / mean(lambda s: s * math.exp(model.rate * s)))), rel=1e-6)

    def segments(v):
        """By definition: the greatest sum (of equal ones the shortest, then the first), then the parts on both sides."""
        best = None
        for a in range(len(v)):
            s = 0.0
            for b in range(a, len(v)):
                s += v[b]
                if s > 0 and (best is None or s > best[2] + 1e-12):
                    best = (a, b + 1, s)
        if best is None:
            return []
        a, b, s = best
        return segments(v[:a]) + [best] + [(x + b, y + b, z) for x, y, z in segments(v[b:])]

    x, y = [], []
    for i in sorted(words):
        x.append(model.summary(words[i])[:2])
        y.append(label[i])
    checked = 0
    for i in sorted(words, key=lambda i: len(words[i])):
        w = words[i][:120]
        v = [model.scores.get(t, model.scores.get("^" + t[: toxicity.STEM], -toxicity.DRIFT)) for t in w]
        found = segments(v)
        # with float sums, equal ones may be told apart by a last digit: totals and passages are compared
        assert sum(s for _, _, s in found) == pytest.approx(sum(s for _, _, s, _ in model.segments(w)), abs=1e-6)
        best = max((s for *_, s in found), default=0.0)
        normal = max(-20.0, min(60.0, model.rate * best - math.log(model.scale * max(1, len(w)))))
        mass = math.log1p(sum(s for *_, s in found if model.scale * max(1, len(w)) * math.exp(-min(700, model.rate * s)) <= toxicity.SIGNIFICANT))
        got = model.summary(w)
        assert got[0] == pytest.approx(normal, abs=1e-6) and got[1] == pytest.approx(mass, abs=1e-6)
        checked += 1
        if checked == 80:
            break
    a = np.column_stack([np.ones(len(x)), np.array(x)])
    p = 1 / (1 + np.exp(-a @ np.array(model.weights)))
    gradient = a.T @ (np.array(y) - p) - np.array([1e-3, 0.1, 0.1]) * np.array(model.weights)
    assert np.abs(gradient).max() < 1e-4  # the best logistic fit, with its ridge
