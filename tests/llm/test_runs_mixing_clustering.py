"""Periodic runs, mixing and centroid clustering against brute force, and their defined cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_llm import ODD, frame
from tidemark.llm import clustering, mixing, runs

# ---------------------------------------------------------------- runs


def brute_runs(w):
    """All runs by comparing words q apart, for every q, and testing each stretch for smaller periods."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] == w[i + q]:
                j = i
                while j + q < n and w[j] == w[j + q]:
                    j += 1
                length = j - i + q
                smaller = any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q))
                if length >= max(6, 4 * q) and not smaller:
                    out.append((i, length, q))
                i = j
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_report(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    dropped = {k for s, length, q in found for k in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    kept = b" ".join(x for k, x in enumerate(w) if k not in dropped)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


pieces = st.tuples(st.lists(st.integers(0, 2), max_size=6), st.integers(0, 9))


@given(st.lists(st.lists(pieces, max_size=5), max_size=4))
@example([[([0], 5)]])
@example([[([0], 6)], [([0], 6)]])
@example([[([0, 1, 0, 0, 1], 4), ([0, 1], 5)]])
@settings(max_examples=500, deadline=None)
def test_runs_of_repeated_pieces(texts):
    words = [[bytes([97 + x]) for part, times in text for x in part * times] for text in texts]
    assert [list(map(tuple, r.tolist())) for r in runs.runs_of(words)] == [brute_runs(w) for w in words]


def test_runs_of_random_texts():
    rng = random.Random(5)
    for _ in range(400):
        words = [runs.rotated(rng.randrange(1000), [bytes([97 + rng.randrange(rng.choice([1, 2, 4]))]) for _ in range(rng.choice([0, 1, 7, 40, 90]))]) for _ in range(3)]
        assert [list(map(tuple, r.tolist())) for r in runs.runs_of(words)] == [brute_runs(w) for w in words]


def test_refinement_touches_each_place_a_logarithm_of_times():
    """The smaller-half strategy on a long period: a place is touched a few times, not once a level."""
    rng = np.random.default_rng(3)
    codes = np.tile(rng.integers(0, 50, 3000), 8)
    part, touched = runs.Partition(codes, np.append(np.full(len(codes), len(codes) // 4), 0)), 0
    while len(part.small):
        touched += len(part.small)
        part.refine()
    assert part.level > 3000 and touched < len(codes) * np.log2(len(codes))


def test_runs_report(spark):
    rng = random.Random(8)
    texts = [*ODD, "la " * 50, "a b c " * 4, "a b " * 3 + "x " + "q r s t " * 9, *[" ".join(rng.choice("abc") for _ in range(rng.randrange(120))) for _ in range(60)]]
    ids = [*range(len(texts) - 3), None, 7, 7]
    got = [tuple(r)[:8] for r in runs.report(frame(spark, texts, ids)).collect()]
    assert Counter(got) == Counter(brute_report(i, t) for i, t in zip(ids, texts))


def test_runs_of_a_text_beyond_a_step(spark):
    text = " ".join(f"w{i % 70_000}" for i in range(900_000))
    assert len(text) > 4 << 20
    row = runs.scan(frame(spark, [text, "a " * 9])).where("doc_id = 0").first()
    assert [tuple(r) for r in row["runs"]] == [(0, 900_000, 70_000)] and len(row["collapsed"].split()) == 70_000


# ---------------------------------------------------------------- mixing


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", "y") for i, t, s in rows], "doc_id long, text string, source string, size int, s string, key string").repartition(3)


def shared_out(sizes, share=1.5, most=2):
    """Targets by resharing the excess until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        rest = total - sum(target.values())
        each = rest / sum(weight[s] for s in free)
        above = {s for s in free if each * weight[s] >= most * sizes[s]}
        if not above:
            target |= {s: each * weight[s] for s in free}
            break
        target |= {s: float(most * sizes[s]) for s in above}
        free -= above
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mix_meets_targets_and_repeats_nothing(spark, seed):
    rng = random.Random(seed)
    sources = ["b", "a", "Z", "é", None, "hot", "hot", "hot"]
    rows = [(k if rng.random() < 0.95 else None, rng.choice([None, "", "w " * rng.choice([1, 3, 30, 400, 2500])]), rng.choice(sources)) for k in range(300)]
    rows += rows[:5]
    docs = documents(spark, rows)
    options = {"block_words": 700}
    got = mixing.taken(docs, **options).collect()
    size = lambda t: len((t or "").split())
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = shared_out(sizes)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert all(any(abs(r["target"] - want[s]) < 1e-6 * (1 + want[s]) and r["source_size"] == sizes[s] for s in sizes) for r in got)
    mixed = mixing.mix(docs, **options).collect()
    by_source, words = Counter(), Counter()
    for r in mixed:
        by_source[r["source"]] += r["length"]
        words.update((r["key"], r["pass"], w) for w in range(r["start"], r["start"] + r["length"]))
    assert by_source == {s: round(t) for s, t in want.items() if round(t)}
    copies = Counter((i, t, s) for i, t, s in rows)
    assert max(words.values()) <= max(copies.values())  # a pass takes a word of a row once
    again = mixing.mix(docs.repartition(7), **options).collect()
    assert Counter(mixed) == Counter(again)
    places = defaultdict(list)
    for r in mixed:
        places[r["shard"]].append(r["place"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and len(places) > 1
    text = {(r["shard"], r["place"]): r["text"] for r in mixing.texts(docs, mixing.mix(docs, **options)).collect()}
    assert len(text) == len(mixed) and all(len(text[r["shard"], r["place"]].split()) == r["length"] for r in mixed)


@given(st.lists(st.integers(0, 60), min_size=1, max_size=6), st.integers(1, 9), st.integers(0, 5))
@settings(max_examples=150, deadline=None)
def test_tree_meets_quotas_in_shards_of_like_size(quotas, shard_blocks, seed):
    tree = mixing.Tree(quotas, shard_blocks, seed)
    colour = np.repeat(np.arange(len(quotas)), quotas)
    block = np.concatenate([np.arange(q) for q in quotas])
    shard = tree.shard(colour, block)
    sizes = np.bincount(shard, minlength=tree.shards)
    assert len(sizes) == tree.shards and (not len(shard) or sizes.max() - sizes.min() <= 1)
    some = np.random.default_rng(seed).permutation(len(shard))[: len(shard) // 2]
    assert (tree.shard(colour[some], block[some]) == shard[some]).all()  # whatever else a task deals


def test_tree_draws_like_a_shuffle():
    """Over many seeds the blocks of a colour in a shard have the mean and variance of the hypergeometric distribution."""
    counts = np.array([(mixing.Tree([30, 10, 24], 16, seed).shard(np.repeat([0, 1, 2], [30, 10, 24]), np.concatenate([np.arange(30), np.arange(10), np.arange(24)])).reshape(-1)[:30] == 2).sum() for seed in range(3000)])
    n, total, k = 16, 64, 30
    assert abs(counts.mean() - n * k / total) < 0.1
    assert abs(counts.var() - n * k / total * (1 - k / total) * (total - n) / (total - 1)) < 0.25


def test_more_sources_than_colours_and_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COLOURS", 3)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    rows = [(k, "w " * (k % 17), f"s{k % 11}" if k % 11 else None) for k in range(200)]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    got = Counter()
    for r in mixing.mix(documents(spark, rows), block_words=20).collect():
        got[r["source"]] += r["length"]
    assert got == {s: round(t) for s, t in shared_out(sizes).items()}


def test_mix_of_nothing(spark):
    assert mixing.taken(documents(spark, [])).count() == 0
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.taken(documents(spark, [(1, None, None), (2, " ", "a")])).collect()] == [(0, 0.0, 0)] * 2


# ---------------------------------------------------------------- clustering


def brute_clusters(rows, k, rounds, width, scale=64, seed=1):
    import math

    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    ranked = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in ranked[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(own[j]) for x in zip(*own[j])] if j in own else c for j, c in enumerate(centroids)]
    return Counter((i, *nearest(v)[::-1]) for i, v in kept), centroids


@pytest.mark.parametrize("seed, k, spread", [(0, 16, 0.02), (1, 5, 3.0), (2, 40, 0.3), (3, 16, 0.0), (4, 1, 1.0)])
def test_clusters_by_brute_force(spark, seed, k, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 4))
    rows = [(n, [float(np.float32(x)) for x in centres[rng.integers(9)] + spread * rng.normal(size=4)]) for n in range(400)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (-7, None), (901, [1.0, None, 2.0, 3.0]), (902, [1.0, float("nan"), 0.0, 0.0]), (903, [float("inf")] * 4), (904, [1.0] * 3), (905, [])]
    df = spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], "vec_id long, embedding array<float>, cluster int, id string, u double").repartition(3)
    found, places = clustering.cluster(df, k=k, rounds=4, width=4)
    want, centroids = brute_clusters(rows, k, 4, 4)
    assert Counter(map(tuple, found.collect())) == want and places.tolist() == centroids


def test_ties_go_to_the_smaller_number(spark):
    """Vectors between two centroids, equal centroids, and fewer vectors than centroids."""
    rows = [(n, [float(x), 0.0]) for n, x in enumerate([0, 0, 2, 1, 1, 4, 3, 3, 5, 2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (2, 3, 10, 20):
        found, places = clustering.cluster(df, k=k, rounds=3, width=2, scale=1)
        want, centroids = brute_clusters(rows, k, 3, 2, scale=1)
        assert Counter(map(tuple, found.collect())) == want and places.tolist() == centroids


def test_balls_spare_most_distances():
    """On clustered vectors a later round compares few centroids, and finds what a full search finds."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (64, 8))
    v = centres[rng.integers(64, size=5000)] + rng.integers(-300, 300, (5000, 8))
    first = clustering.Centroids(centres)
    cluster, upper, lower, _ = first.start(v)
    second = clustering.Centroids(centres + rng.integers(-150, 150, centres.shape), first.places)
    seen = []
    got, up, low = second.search(v, cluster, upper, lower, seen)
    d = clustering.squared(v, second.places)
    assert (got == d.argmin(1)).all()
    two = np.sort(d, axis=1)
    assert (up >= np.sqrt(two[:, 0])).all() and (low <= np.sqrt(two[:, 1])).all()
    assert sum(a * b for a, b in seen) < 0.2 * d.size


def test_components_beyond_the_limit_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1e300, -1e300]), (2, [0.0, 0.0]), (3, [2.0**24, 3.0])], "vec_id long, embedding array<double>")
    rows = {r["vec_id"]: r for r in clustering.summary(df, k=1, rounds=0, width=2).collect()}
    top, seed = clustering.LIMIT, min((1, 2, 3), key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())
    whole = {1: (top, -top), 2: (0, 0), 3: (2**30 if 2**30 < top else top, 192)}
    assert {i: r["distance"] for i, r in rows.items()} == {i: sum((a - b) ** 2 for a, b in zip(v, whole[seed])) for i, v in whole.items()}
    assert clustering.summary(df.where(F.lit(False)), width=2).count() == 0
