import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tidemark import models
from tidemark.functions import segments as seg
from tidemark.functions import vectors as vec
from tidemark.operators import ann, answers, compilation, compiled, context, evaluation, fulltext, graph, phrases, postings, retrieval, rows, scans, smallworld, store, units
from tidemark.sources import pages, sessions
from tidemark.streaming import ingest


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "ünï", "x" * 30]) for _ in range(n))


@pytest.mark.parametrize("seed", range(8))
def test_chunks_keep_their_bounds(seed):
    rng = random.Random(seed)
    text = "\n\n".join(words(rng, rng.randint(1, 900)) for _ in range(6))
    chunks = seg.chunk_text(text)
    assert chunks and all(c.strip() and seg.tokens(c) <= seg.HARD_CAP for c in chunks)
    assert all(b.startswith(seg.overlap_tail(a)[:20]) for a, b in zip(chunks, chunks[1:]))
    assert seg.chunk_text(" \n\n ") == [] and seg.chunk_text(None) == []


def test_hard_split_keeps_the_text_and_pairs():
    text = "😀" * 3000 + " tail\n" + "y" * 9000
    pieces = seg.hard_split(text, 420)
    assert "".join(pieces) == text and all(seg.width(p) <= 1680 for p in pieces)
    assert seg.hard_split("", 10) == [""]


def test_trajectory_chunks_hold_one_role():
    chunks = seg.chunk_trajectory("ask " * 50, ["answer " * 400], ["thought " * 20], ["TOOL x: {}"] * 3, [])
    kinds = ["tool" if "TOOL" in c else "think" if "THINKING" in c else "prose" for c in chunks]
    assert kinds == sorted(kinds, key=["prose", "think", "tool"].index)
    assert chunks[-1].startswith("USER: ask") and "…" in chunks[-1].split("\n")[0]


def test_small_text_functions():
    assert seg.slugify("Étude  of--Ünits!") == "etude-of-units"
    assert seg.stable_json({"b": [1, {"d": 1, "c": 2}], "a": None}) == '{"a":null,"b":[1,{"c":2,"d":1}]}'
    assert seg.sanitize({"k\x00": "a\ud800b"}) == {"k�": "a�b"}
    assert seg.split_claims("One. [1][2] Two [9] three [1] rest", 2) == [("One. [1][2]", [1, 2]), ("three [1]", [1])]
    assert len(seg.page_chunks("t", "## a\n" + "x" * 3000 + "\n## b\n" + "y" * 3000)) == 2


def test_pages_round_trip(tmp_path, spark):
    page = {"slug": "a-b", "schema": 1, "title": "A: b", "kind": "topic", "summary": "s", "aliases": ["z", "a"], "sources": ["2", "1"], "trajectories": [], "fingerprint": "f", "created": "c", "updated": "u", "body": "text\n---\nmore"}
    text = pages.render_page(page)
    assert pages.parse_page("a-b", text) == page | {"sources": ["1", "2"]}
    assert pages.parse_page("x", "no front matter")["kind"] == "topic"
    (tmp_path / "a-b.md").write_text(text)
    (tmp_path / "Bad Name.md").write_text(text)
    assert [r.slug for r in pages.read_pages(spark, str(tmp_path)).collect()] == ["a-b"]


def test_sessions_from_json_lines(tmp_path, spark):
    block = lambda **k: k
    lines = [
        {"type": "user", "sessionId": "s", "uuid": "1", "timestamp": "2024-01-01T00:00:00Z", "cwd": "/w/repo", "message": {"role": "user", "content": "first question"}},
        {"type": "assistant", "sessionId": "s", "timestamp": "2024-01-01T00:00:01Z", "cwd": "/w/repo", "message": {"role": "assistant", "content": [block(type="text", text="answer"), block(type="tool_use", id="t1", name="Write", input={"file_path": "/a.py"}), block(type="text", text="  ")]}},
        {"type": "user", "sessionId": "s", "timestamp": "2024-01-01T00:00:02Z", "cwd": "/w/repo", "message": {"role": "user", "content": [block(type="tool_result", tool_use_id="t1", content=[block(type="text", text="ok"), block(type="text", text="done")])]}},
        {"type": "user", "sessionId": "s", "timestamp": "2024-01-01T00:00:03Z", "cwd": "/w/repo", "isMeta": True, "message": {"role": "user", "content": "meta"}},
        {"type": "summary", "message": {"role": "user", "content": "no"}},
        {"type": "user", "sessionId": "s", "timestamp": "2024-01-01T00:00:04Z", "cwd": "/w/repo", "message": {"role": "user", "content": "second"}},
    ]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "s.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    t = sorted(sessions.trajectories(sessions.parse_messages(sessions.read_lines(spark, str(tmp_path)))).collect(), key=lambda r: r.n)
    assert [r.user_message for r in t] == ["first question", "second"]
    assert t[0].assistant == ["answer"] and t[0].tool_calls[0].output == "ok\ndone" and t[0].repo == "repo"
    a = spark.createDataFrame([(["Write"], ['{"file_path":"/a.py"}'], "see https://github.com/o/r/pull/12, https://h.org/o/r/pull/12 and http://localhost/x http://[::1]/x"), (["Write"], ['{"path":"/b.py"}'], "")], "n array<string>, i array<string>, t string")
    got = a.select(sessions.artifacts(F.col("n"), F.col("i"), F.col("t")).alias("a"), sessions.file_paths(F.col("i")).alias("p")).collect()
    assert [(x.kind, x.ref) for x in got[0].a] == [("file", "/a.py"), ("pr", "https://github.com/o/r/pull/12,"), ("url", "https://h.org/o/r/pull/12")] and got[0].p == ["/a.py"]
    assert [(x.kind, x.ref) for x in got[1].a] == [("file", "/b.py")]


def test_retrieval_rules(spark):
    assert retrieval.clamp_limit(float("nan")) == 5 and retrieval.clamp_limit(0.2) == 1 and retrieval.clamp_limit(99, most=50) == 50
    assert retrieval.tiers("synth") == ("wiki", "dream") and retrieval.tiers(None) == ()
    with pytest.raises(ValueError):
        retrieval.tiers("other")
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in retrieval.vector_topk(df, [1.0, 0.1], 2).collect()] == [1, 2]
    with pytest.raises(Exception, match="expected 3"):
        df.select(vec.has_width(F.col("embedding"), 3)).collect()
    zero = retrieval.rescore(spark.createDataFrame([(0.5, 0.25, None, "raw")], "similarity double, keyword_score double, ts timestamp_ntz, tier string"), retrieval.Scoring(), F.current_timestamp()).first()
    assert zero.combined == pytest.approx(0.7 * 0.5 + 0.3 * 0.25)


def test_full_text(spark):
    assert fulltext.stem("running") == "run" and fulltext.stem("relational") == "relat" and fulltext.stem("hoping") == "hope"
    docs = spark.createDataFrame([("a", "the quick brown fox"), ("b", "brown quick fox foxes"), ("c", "slow turtle"), ("d", None)], "id string, content string")
    index = fulltext.postings(docs)
    ids = lambda q: sorted(r.id for r in fulltext.search(index, q).collect())
    assert ids("quick fox") == ["a", "b"] and ids('"quick brown"') == ["a"] and ids("quick -foxes") == [] and ids("turtle or quick") == ["a", "b", "c"] and ids("") == [] and ids("the") == [] and ids("-turtle") == []
    scores = {r.id: r.keyword_score for r in fulltext.search(index, "brown fox").collect()}
    assert all(0 < s < 1 for s in scores.values()) and scores["a"] > scores["b"] * 0.5


@given(st.from_regex("[a-z0-9]{1,8}(ing|ed|edly|ies|s|ational|fulness|y)?", fullmatch=True))
@settings(max_examples=300, deadline=None)
def test_stems_keep_the_first_letter(word):
    assert fulltext.stem(word)[:1] == word[0]


def test_text_rank_equals_stored_postings(spark, tmp_path):
    """Null, empty, very long and repeated texts; a column in the way; phrases, negation, stop words."""
    long = "Running runs of the fox " * 20_000
    rows = [("a", "Runs with foxes", 1), ("b", "fox running fox", 1), ("b", "fox running fox", 1), ("c", None, 1), ("d", "", 1), ("e", long, 1), ("f", "runner and turtles", 1)]
    docs = spark.createDataFrame(rows, "id string, content string, term int")
    once = docs.where("id <> 'b'")
    fulltext.write_index(fulltext.postings(once), str(tmp_path / "i"), buckets=4, splits=2)
    for q in ("run fox", '"running fox"', "fox -turtle", "runs or turtle", "the", "-fox", "", "absent"):
        stored = [tuple(r) for r in fulltext.search(fulltext.read_index(spark, str(tmp_path / "i"), q, buckets=4), q, limit=None).collect()]
        scanned = [tuple(r) for r in fulltext.best_first(once.select("id", fulltext.rank(F.col("content"), q).alias("keyword_score")), None).collect()]
        assert scanned == stored, q
    both = fulltext.best_first(docs.select("id", fulltext.rank(F.col("content"), "fox").alias("keyword_score")), None).collect()
    assert [r.id for r in both] == ["e", "b", "b", "a"]
    empty = docs.where("false")
    assert fulltext.postings(empty).count() == 0 and empty.select(fulltext.rank(F.col("content"), "fox")).count() == 0


def test_hybrid_pools(spark):
    """More rows than both pools hold: the pools are those of a full sort, and null vectors come last."""
    rng = random.Random(5)
    rows = [(f"{i:04}", "fox " * rng.randint(0, 6) + "turtle", [rng.gauss(0, 1) for _ in range(3)] if i % 9 else None, "raw", None, "r", "s", None) for i in range(900)]
    chunks = spark.createDataFrame(rows, "id string, content string, embedding array<float>, tier string, ts timestamp_ntz, repo string, session_id string, invalid_at timestamp_ntz").repartition(7)
    scored = chunks.join(spark.sql("SELECT array(1f, 0f, 0f) AS q")).select("id", retrieval.vec.cosine(F.col("embedding"), F.col("q")).alias("similarity"), fulltext.rank(F.col("content"), "fox").alias("keyword_score")).cache()
    got = sorted(r.id for r in retrieval._pools(scored, 100, 50, "id").collect())
    every = scored.collect()
    near = sorted((r for r in every if r.similarity is not None), key=lambda r: (-r.similarity, r.id))[:100]
    named = sorted((r for r in every if r.keyword_score is not None), key=lambda r: (-round(r.keyword_score, 12), r.id))[:50]
    assert got == sorted({r.id for r in near} | {r.id for r in named})
    found = retrieval.hybrid_search(chunks, spark.sql("SELECT array(1f, 0f, 0f) AS q"), "foxes", retrieval.Filters(limit=5), retrieval.Scoring(), F.current_timestamp()).collect()
    assert len(found) == 5 and found[0].combined >= found[-1].combined
    assert retrieval.hybrid_search(chunks.where("false"), spark.sql("SELECT array(1f, 0f, 0f) AS q"), "foxes", retrieval.Filters(), retrieval.Scoring(), F.current_timestamp()).count() == 0


def test_store_mutations(spark, tmp_path):
    old = spark.createDataFrame([("a", "x", 1, True), ("b", "y", 1, None)], "id string, content string, v int, dead boolean")
    new = spark.createDataFrame([("a", "z", 2, None), ("c", "w", 2, None)], "id string, content string, v int, dead boolean")
    once = store.upsert(old, new, "id", ["v"], ["dead"])
    assert sorted(map(tuple, once.collect())) == [("a", "x", 2, None), ("b", "y", 1, None), ("c", "w", 2, None)]
    assert sorted(map(tuple, store.upsert(once, new, "id", ["v"], ["dead"]).collect())) == sorted(map(tuple, once.collect()))
    s = store.Snapshots(spark, str(tmp_path / "t"))
    s.write(old)
    s.write(once)
    assert s.read().count() == 3
    assert store.append_new(once, new, ["id"]).count() == 0


def test_units_run_and_rerun(spark):
    c = spark.createDataFrame([("1", "s", "r", "hello", None), ("2", "s", None, "other", None)], "id string, session_id string, repo string, content string, ts timestamp")
    ledger = spark.createDataFrame([], "session_id string, repo string, fingerprint string")

    def extractor(text):
        if "other" in text:
            raise ValueError("no")
        return [{"kind": "odd", "text": text}, {"text": " "}]

    got = units.synthesize(c, ledger, extractor, F.current_timestamp())
    assert [(r.kind, r.text) for r in got["items"].collect()] == [("note", "hello")]
    done = got["ledger"].collect()
    assert len(done) == 1 and got["failed"].count() == 1
    again = units.status(units.aggregate_units(c), got["ledger"], ["session_id", "repo"])
    assert sorted(r.status for r in again.collect()) == ["new", "skipped"]


def test_close_names_match_brute_force(spark):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(120)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(a, b) for a in names for b in names if a < b and distance(a, b) <= int(0.25 * max(len(a), len(b)))}
    got = {tuple(r) for r in graph.close_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == want


def test_batches_and_context_budget(spark):
    df = spark.createDataFrame([("g", i, c) for i, c in enumerate([100_000, 60_000, 10, 200_000, 1])], "g string, o long, c long")
    assert [r.batch for r in sorted(rows.pack_batches(df, "g", "o", "c").collect(), key=lambda r: r.o)] == [0, 1, 1, 2, 3]
    items = spark.createDataFrame([("c", "page", 1, 500), ("c", "memory", 1, 600)], "group string, kind string, place int, cost long")
    assert rows.fold_budget(items, 100).count() == 1


def test_models_and_evaluation(spark):
    rows_ = spark.createDataFrame([("a",), ("a",), ("b",)], "content string")
    cache = spark.createDataFrame([], "content_sha256 string, embedding_model string, embedding array<float>")
    got = models.embed_missing(rows_, cache, lambda ts: [models.hashed_embedding(t, 8) for t in ts], "m").collect()
    assert len(got) == 3 and all(len(r.embedding) == 8 for r in got)
    images = spark.createDataFrame([("x", "image/png", 2048), ("y", "image/png", 10)], "sha256 string, media_type string, bytes int")
    captions = {r.sha256: (r.caption, r.fresh) for r in models.resolve_captions(images, spark.createDataFrame([], "sha256 string, caption string"), lambda s: "seen" if s == "x" else None, 2, ["sha256"]).collect()}
    assert captions == {"x": ("seen", True), "y": ("[image/png, 1 KB]", False)}
    none = evaluation.ask("q", spark.createDataFrame([], "position int, content string"), lambda q, c: "")
    assert none["outcome"] == "no_candidates"
    some = evaluation.ask("q", spark.createDataFrame([(1, "c"), (2, "d")], "position int, content string"), lambda q, c: "yes [2] [7]")
    assert some["outcome"] == "answered" and [s["cited"] for s in some["sources"]] == [False, True]


def test_streams_agree_with_batches(spark, tmp_path, sf):
    src = tmp_path / "in"
    log = [("g", i, q) for i, q in enumerate(["a", "ab", "abc", "x", "x", "xy", "q"])]
    for k, part in enumerate((log[:3], log[3:])):
        spark.createDataFrame(part, "g string, id long, q string").withColumn("ts", F.col("id")).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("g string, id long, q string, ts long").option("maxFilesPerTrigger", 1).parquet(str(src))
    out = sorted(r.id for r in ingest.run_to_table(ingest.typing_collapse(stream, "g", "q"), str(tmp_path / "typing")).collect())
    batch = sorted(r.id for r in rows.collapse_typing(spark.read.parquet(str(src)), ["g"], "q").collect())
    assert out == batch[:-1]  # the newest row is still open
    seen = []
    ingest.exactly_once(spark.readStream.schema("g string, id long, q string, ts long").parquet(str(src)), "id", lambda df, n: seen.extend(r.id for r in df.collect()), str(tmp_path / "cp"))
    ingest.exactly_once(spark.readStream.schema("g string, id long, q string, ts long").parquet(str(src)), "id", lambda df, n: seen.extend(r.id for r in df.collect()), str(tmp_path / "cp"))
    assert sorted(seen) == list(range(7))


def test_inverted_lists(spark, tmp_path):
    """Recall against brute force with measured probes; null, zero and repeated vectors; no rows, no queries."""
    import numpy as np

    rng = np.random.default_rng(7)
    hubs = rng.normal(size=(12, 8))
    v = [(hubs[i % 12] + rng.normal(size=8) * 0.6).tolist() for i in range(1200)]
    data = [(i, x) for i, x in enumerate(v)] + [(5000, v[3]), (5001, None), (5002, [0.0] * 8)]
    e = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    queries = e.where("vec_id % 20 = 0 AND vec_id < 5000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    centres = ann.fit(e, 24)
    ann.write(e, str(tmp_path / "i"), centres, splits=2)
    assert spark.read.parquet(str(tmp_path / "i" / "rows")).count() == len(data)
    probes = ann.probes_for(e, centres, queries, 10, 0.9)
    assert probes < 24
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in data if x is not None and np.linalg.norm(x) > 0}
    ids, m = list(unit), np.array(list(unit.values()))
    exact = {i: {ids[j] for j in np.argsort(-(m @ unit[i]))[:10]} for i in range(0, 1200, 20)}
    found: dict = {}
    for r in ann.search(spark, str(tmp_path / "i"), queries, 10, probes).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(exact[i] & found[i]) for i in exact) >= 0.9 * sum(map(len, exact.values()))
    assert ann.search(spark, str(tmp_path / "i"), queries.where("false"), 10, 3).count() == 0
    ann.write(e.where("false"), str(tmp_path / "none"), ann.fit(e.where("false"), 4))
    assert ann.search(spark, str(tmp_path / "none"), queries, 10, 3).count() == 0


def test_idle_state_leaves(spark, tmp_path):
    """A day after a group's last row its held row is put out; keys seen within the watermark count once."""
    src = str(tmp_path / "in")
    at = lambda day, i: f"2024-01-{day:02} 00:00:0{i}"
    for part in ([("g", 1, "a", at(1, 1)), ("g", 2, "ab", at(1, 2))], [("h", 3, "z", at(9, 1)), ("h", 3, "z", at(9, 1))], [("h", 4, "zz", at(9, 2))]):
        spark.createDataFrame(part, "g string, id long, q string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
    import os
    import time

    for i, f in enumerate(sorted((os.path.join(src, f) for f in os.listdir(src) if f.endswith(".parquet")), key=os.path.getmtime)):
        os.utime(f, (time.time() - 100 + i, time.time() - 100 + i))
    read = lambda: spark.readStream.schema("g string, id long, q string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    out = ingest.run_to_table(ingest.typing_collapse(read(), "g", "q", late="0 seconds"), str(tmp_path / "typing")).collect()
    assert [(r.g, r.id, r.q) for r in out] == [("g", 2, "ab")]
    seen = []
    ingest.exactly_once(read(), "id", lambda df, n: seen.extend(r.id for r in df.collect()), str(tmp_path / "cp"), ts="ts", late="1 day")
    assert sorted(seen) == [1, 2, 3, 4]


def test_the_first_page_that_fits_may_use_the_whole_budget(spark):
    items = lambda *rows_: spark.createDataFrame([("c", k, p, c) for p, (k, c) in enumerate(rows_)], "group string, kind string, place int, cost long")
    got = lambda df, *a: [(r["kind"], r["cost"]) for r in sorted(rows.fold_budget(df, *a).collect(), key=lambda r: r["place"])]
    assert got(items(("page", 120), ("page", 60)), 100) == [("page", 60)]
    assert got(items(("page", 120), ("page", 60), ("page", 5)), 100) == [("page", 60)]  # the share is spent, and the third pass ends at once
    assert got(items(("page", 120), ("page", 30), ("page", 10), ("memory", 60)), 100) == [("page", 30), ("page", 10), ("memory", 60)]
    frame = lambda p, m: 10 * p + F.when(m > 0, 5).otherwise(0)
    assert got(items(("page", 60), ("memory", 10)), 84, frame) == [("page", 60)]
    assert got(items(("page", 60), ("memory", 10)), 85, frame) == [("page", 60), ("memory", 10)]
    assert got(items(("page", 60), ("memory", 10)), 0, frame) == [("page", 60)]  # nothing fits


def test_budget_passes_match_a_fold(spark):
    """Against the passes taken item by item, as they are defined."""
    rng = random.Random(3)
    items = [(f"g{g}", kind, p, rng.choice([0, 1, 20, 39, 41, 60, 101, 130])) for g in range(120) for kind in ("page", "memory") for p in range(rng.randint(0, 13))]

    def fold(mine):
        pages, memories = (sorted(x for x in mine if x[1] == k)[:n] for k, n in (("page", 6), ("memory", 10)))
        left = max(0, 110 - len(pages) - (4 if memories else 0))
        taken, used = [], 0
        for x in pages:
            cap = left if not taken else int(left * 0.4)
            if used + x[3] <= cap:
                taken.append(x)
                used += x[3]
            elif taken:
                break
        for pool in (memories, [x for x in pages if x not in taken]):
            for x in pool:
                if used + x[3] > left:
                    break
                taken.append(x)
                used += x[3]
        return taken or (pages or memories)[:1]

    want = sorted(x for g in {i[0] for i in items} for x in fold([i for i in items if i[0] == g]))
    frame = lambda p, m: p + F.when(m > 0, 4).otherwise(0)
    got = rows.fold_budget(spark.createDataFrame(items, "group string, kind string, place int, cost long"), 110, frame).collect()
    assert sorted(map(tuple, got)) == want


def test_context_text(spark):
    """What frames the items is paid for, an unknown repo has no mentions, and the text stays within its budget."""
    at = F.expr("timestamp_ntz'2024-02-01 00:00:00'")
    day = lambda c: F.col(c).cast("timestamp_ntz")
    pages = spark.createDataFrame([("p1", "One", "First  page.", "2024-01-05T10:00:00Z", 2, "2024-01-20 00:00:00"), ("p2", "Two", "", None, 2, None)], "slug string, title string, summary string, updated string, evidence long, latest string").withColumn("latest", day("latest"))
    memories = spark.createDataFrame([("1", "use  tabs", "decision", "2024-01-31 12:00:00"), ("2", "beware", "gotcha", "2024-01-20 00:00:00")], "id string, content string, dream_type string, ts string").withColumn("ts", day("ts"))
    mentions = spark.createDataFrame([("p2", "Two", "two", 1), ("p3", "Three", "three", 2)], "slug string, title string, summary string, rank int")
    text = context.build(pages, memories, mentions, at, "my-repo", "feature/x1", 400).first()
    assert text["text"] == (
        "## Prior context — my-repo@feature/x1\n\n**Pages**\n- p1 — First  page. (updated 2024-01-05)\n- p2 — Two\n- p3 — three\n\n"
        "**Recent decisions & gotchas (30d)**\n- decision (today): use tabs\n- gotcha (12d ago): beware\n\n"
        '_3 pages, 2 memories · search "my OR repo OR feature OR x1" in my-repo to dig deeper_\n'
    )
    for budget in range(60, 110, 3):
        got = context.build(pages, memories, mentions, at, "my-repo", None, budget).first()
        assert got["tokens"] <= budget + 4 or got["text"].count("\n- ") == 1  # line breaks are not counted
    none = pages.where("false"), memories.where("false")
    assert context.build(*none, mentions, at, "my-repo", None, 400).count() == 0


def test_replay_leaves_out_what_it_cannot_read(spark):
    payloads = ['{"x": 1, "y": "a"}', "{", "", None, '{"x": null}', '{"z": 3}', '[1]', '{"x": "one"}', '{"x": 2} tail', "null", '{"x": 2}{"x": 3}', '{"x": 2},{"x": 3}', ' {"x": 5} ']
    events = spark.createDataFrame([(f"t{k}", "s", p) for k, p in enumerate(payloads)] + [("o", "other", '{"x": 9}')], "trajectory_id string, source string, payload string")
    got, bad = store.replay(events, "s", "x int, y string"), store.unreadable(events, "s", "x int, y string")
    assert sorted(map(tuple, got.collect())) == [("t0", 1, "a"), ("t12", 5, None), ("t4", None, None), ("t5", None, None)]
    assert {r["trajectory_id"] for r in bad.collect()} == {"t1", "t10", "t11", "t2", "t3", "t6", "t7", "t8", "t9"}


@pytest.mark.parametrize("seed", range(3))
def test_hot_groups_fill_and_gather_as_whole_ones(spark, seed):
    """Salted running sums against plain ones: a hot group, null and empty contents, units at both sides of the cap."""
    rng = random.Random(seed)
    data = [("hot" if i % 3 else f"u{i % 7}", i, rng.choice([None, "", "x" * rng.randint(1, 90)])) for i in range(900)] + [("none", 1000, None), ("edge", 1001, "y" * 300), (None, 1002, "z" * 301)]
    df = spark.createDataFrame(data, "s string, id int, content string").repartition(5)
    got = {r.s: r.transcript for r in units.transcript(df, ["s"], ["id"], 300).collect()}
    assert len(got) == len({d[0] for d in data})
    for s_, text in got.items():
        whole = "\n---\n".join(c for u, _, c in data if u == s_ and c is not None)
        head = (300 - 3) * 3 // 4
        assert text == (whole if len(whole) <= 300 else whole[:head] + "\n…\n" + whole[-(300 - 3 - head) :])
    costs = df.withColumn("cost", F.coalesce(F.length("content"), F.lit(0)))
    filled = sorted((r.s or "", r.id, r.used, r.place) for r in rows.running_fill(costs, ["s"], ["id"], "cost", 250).collect())
    want = []
    for s_ in {d[0] for d in data}:
        used = 0
        for place, (_, i, c) in enumerate((d for d in data if d[0] == s_), 1):
            used += len(c or "")
            if used <= 250 or place == 1:
                want.append((s_ or "", i, used, place))
    assert filled == sorted(want)


def test_cursor_looks_at_the_last_trajectory_again(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "session_id string, n long, digest string"
    for rows_ in ([("s", 0, "a"), ("s", 1, "b")], [("s", 1, "c")], [("s", 1, "c"), ("s", 2, "d")]):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(src)
    import os
    import time

    for i, f in enumerate(sorted((os.path.join(src, f) for f in os.listdir(src) if f.endswith(".parquet")), key=os.path.getmtime)):
        os.utime(f, (time.time() - 100 + i, time.time() - 100 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = [(r.n, r.digest, r.superseded) for r in ingest.run_to_table(ingest.cursor_suffix(stream), str(tmp_path / "cursor")).collect()]
    assert sorted(got) == [(0, "a", None), (1, "b", None), (1, "c", "b"), (2, "d", None)]


def page(slug, body, **more):
    base = {"slug": slug, "title": slug, "kind": "topic", "summary": "", "aliases": ["x"], "sources": ["s1"], "trajectories": ["t0"], "created": "2024-01-01", "updated": "2024-01-01", "body": body}
    return base | more


PAGE_SCHEMA = "slug string, title string, kind string, summary string, aliases array<string>, sources array<string>, trajectories array<string>, created string, updated string, body string"


def operation(slug, place, body, retry=None, **more):
    base = {"slug": slug, "place": place, "title": slug, "kind": "topic", "summary": "", "aliases": ["y", "x"], "sources": ["i1", "stray"], "unit_ids": ["i1"], "trajectory_id": f"t{place}", "body": body, "retry": retry, "at": "2024-02-01T00:00:00"}
    return base | more


OP_SCHEMA = "slug string, place long, title string, kind string, summary string, aliases array<string>, sources array<string>, unit_ids array<string>, trajectory_id string, body string, retry string, at string"


def test_page_operations_apply_in_order_with_the_guard(spark):
    long = "word " * 200
    pages_df = spark.createDataFrame([page("a", long), page("b", long), page("c", "short"), page("d", long), page("n", None, aliases=None, sources=None, trajectories=None)], PAGE_SCHEMA)
    ops = [
        operation("a", 1, " tiny "), operation("b", 1, "tiny", retry=long + "more"), operation("c", 2, "second"), operation("c", 1, "first"), operation("new", 5, "grown " * 150), operation("new", 6, "cut"),
        operation("d", 1, "tiny", retry="still tiny"), operation("n", 1, None, aliases=None, sources=None, unit_ids=None, trajectory_id=None, at=None), operation(None, 1, "lost"),
    ]
    for parts in (1, 7):
        got = {r["slug"]: r for r in compiled.merge_ops(pages_df.repartition(parts), spark.createDataFrame(ops, OP_SCHEMA).repartition(parts)).collect()}
        assert {k: r["outcome"] for k, r in got.items()} == {"a": "addendum", "b": "retried", "c": "updated", "d": "addendum", "n": "updated", "new": "addendum"}
        assert got["a"]["body"] == long.rstrip() + "\n\n## Addendum (2024-02-01)\n\ntiny" and got["b"]["body"] == long + "more"
        assert got["c"]["body"] == "second" and got["c"]["trajectories"] == ["t0", "t1", "t2"] and got["c"]["sources"] == ["s1", "i1"] and got["c"]["aliases"] == ["x", "y"]
        assert got["new"]["created"] == "2024-02-01T00:00:00" and got["a"]["created"] == "2024-01-01" and got["n"]["sources"] == []
    empty = spark.createDataFrame([], OP_SCHEMA)
    assert {r["outcome"] for r in compiled.merge_ops(pages_df, empty).collect()} == {"kept"} and compiled.merge_ops(pages_df.limit(0), empty).count() == 0


def test_a_page_streams_through_one_task_however_many_operations(spark):
    ops = spark.range(20_000).select(F.lit("hot").alias("slug"), F.col("id").alias("place"), F.lit("T").alias("title"), F.lit("topic").alias("kind"), F.lit("").alias("summary"), F.array(F.lit("x")).alias("aliases"), F.array(F.lit("i")).alias("sources"), F.array(F.lit("i")).alias("unit_ids"), F.lit("t").alias("trajectory_id"), F.col("id").cast("string").alias("body"), F.lit(None).cast("string").alias("retry"), F.lit("2024-02-01").alias("at"))
    (got,) = compiled.merge_ops(spark.createDataFrame([], PAGE_SCHEMA), ops).collect()
    assert got["body"] == "19999" and got["outcome"] == "updated" and got["sources"] == ["i"]


def test_a_store_follows_its_pages(spark):
    schema = "id string, content string, trajectory_id string, chunk_index int, owner string, tier string, ts timestamp, invalid_at timestamp, superseded_by string"
    v = lambda *bodies: spark.createDataFrame([page(f"p{i}", b) for i, b in enumerate(bodies) if b is not None], PAGE_SCHEMA)
    at = F.lit("2024-03-01").cast("timestamp")
    foreign = spark.createDataFrame([("z", "z", "wiki:p0", 0, "other", "wiki", None, None, None), ("y", "y", "wiki:p0", 0, "me", "raw", None, None, None)], schema)
    one = compiled.sync(foreign, v("a", "b"), "me", at)
    two = compiled.sync(one, v("A2", None), "me", at)
    state = lambda df: sorted((r["content"].rsplit("\n", 1)[-1], r["invalid_at"] is None, r["superseded_by"]) for r in df.collect())
    assert state(one) == [("a", True, None), ("b", True, None), ("y", True, None), ("z", True, None)]
    assert state(two) == [("A2", True, None), ("a", False, "wiki:p0"), ("b", True, None), ("y", True, None), ("z", True, None)]
    gone = compiled.sync(two, v("A2", None), "me", at, orphans=True)
    assert ("b", False, None) in state(gone)
    back = compiled.sync(gone, v("a", "b"), "me", at)
    assert {s[0] for s in state(back) if s[1]} == {"a", "b", "y", "z"}


def test_rankings_keep_whole_numbers_in_range_once(spark):
    cases = [('{"ranking": [2, 2, "1", 0.5, 1.0, 9, -1, null, true, 0]}', [2, 1, 0]), ("no json", None), ('{"ranking": []}', None), ('{"ranking": 3}', None), ('{"other": [1]}', None), (None, None), ('{"ranking": [7]}', None)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, a string")
    got = {r["i"]: r["r"] for r in df.select("i", answers.parse_ranking(F.col("a"), F.lit(5)).alias("r")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_batches_of_another_width_fail_whole(spark):
    rows = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("a", 2, [3.0, 4.0]), ("b", 1, None)], "id string, n int, embedding array<double>")
    assert sorted((r["id"], r["n"]) for r in store.checked(rows, 2, order=["n"]).collect()) == [("a", 1), ("b", 1)]
    with pytest.raises(Exception, match="expected width 3"):
        store.checked(rows, 3).collect()


def test_a_sweep_waits_for_a_clean_run(spark):
    rows = spark.createDataFrame([(1, 1, "raw"), (2, 2, "raw"), (3, None, "raw"), (4, 1, "wiki")], "id int, chunker_version int, tier string")
    kept = lambda *errors: sorted(r["id"] for r in store.sweep(rows, spark.createDataFrame([(e,) for e in errors], "error string"), F.lit(2), F.col("tier") == "raw").collect())
    assert kept(None, None) == [2, 4] and kept(None, "bad") == [1, 2, 3, 4] and kept() == [2, 4]


def test_prefixes_are_made_once_and_failures_are_absent(spark):
    def generate(around, chunk):
        if chunk == "bad":
            raise ValueError(chunk)
        return f"about {chunk}"

    items = spark.createDataFrame([("1", "a", ""), ("1", "a", ""), ("2", "bad", ""), ("3", "c", "")], "sha string, chunk string, context string")
    cache = spark.createDataFrame([("3", "known"), ("9", "other")], "sha string, prefix string")
    got = sorted((r["sha"], r["prefix"], r["fresh"]) for r in models.resolve_prefixes(items, cache, generate).collect())
    assert got == [("1", "about a", True), ("3", "known", False)]


def test_a_fallback_latches_only_at_the_same_width():
    calls = []

    def broken(texts):
        calls.append(len(texts))
        raise OSError("down")

    embed = models.Fallback(broken, 4, lambda t: [[0.0] * 4 for _ in t], 4)
    assert embed(["a"]) == [[0.0] * 4] and embed(["a", "b"]) and calls == [1]
    with pytest.raises(OSError):
        models.Fallback(broken, 4, lambda t: [[0.0] * 8 for _ in t], 8)(["a"])


def test_a_night_stamps_only_after_all_phases():
    from datetime import datetime

    from tidemark.operators import nightly

    seen, stamps, last, now = [], [], datetime(2024, 2, 2), datetime(2024, 2, 3)
    phase = lambda n: lambda since: seen.append((n, since)) or {"n": n}
    phases = {n: phase(n) for n in nightly.PHASES}
    assert list(nightly.run(phases, last, now, stamps.append)) == list(nightly.PHASES) and stamps == [now] and seen[0] == ("dream", datetime(2024, 2, 1))
    phases["wiki"] = lambda since: 1 / 0
    with pytest.raises(ZeroDivisionError):
        nightly.run(phases, None, now, stamps.append)
    assert stamps == [now] and nightly.window_start(None) is None


def test_older_and_shorter_queries_go(spark):
    q = lambda *names: spark.createDataFrame([(n, i) for i, n in enumerate(names)], "query string, ts int")
    got = lambda d, r: [x["query"] for x in answers.demand_queries(d, r).collect()]
    assert got(q("rea", "READ me", "read me now", "ab", "other"), q("recent")) == ["other", "read me now"]
    assert got(q("ab"), q("abc", "abcd")) == ["abcd"] and got(q("ab"), q("x")) == []


def clustered(seed, n=900, width=8, clusters=40):
    import numpy as np

    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    return centres[rng.integers(clusters, size=n)] + 0.3 * rng.normal(size=(n, width))


def exact_nearest(v, q, k, admitted=None):
    import numpy as np

    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    s = np.round(unit(v) @ unit(q), 12)
    rows_ = range(len(v)) if admitted is None else np.flatnonzero(admitted).tolist()
    return sorted(rows_, key=lambda i: (-s[i], i))[:k]


@pytest.mark.parametrize("seed", range(3))
def test_graph_search(spark, seed):
    """Every node can be reached, wide beams are exact, narrow ones find most at few distances, filters are whole."""
    import numpy as np

    v = clustered(seed)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    levels = np.floor(-np.log(np.random.default_rng(seed).random(len(v))) / np.log(8)).astype(int)
    g = smallworld.Layers(unit, levels, most=8).build(32)
    assert all(len(x) <= 17 for node in g.links for x in node)  # twice the links, and one more for what was lost
    hits = 0
    g.compared = 0
    for q in unit[::30]:
        nodes, s = g.nearest(q, 10, 20)
        hits += len(set(nodes[np.lexsort((nodes, -np.round(s, 12)))][:10].tolist()) & set(exact_nearest(v, q, 10)))
    assert hits >= 0.9 * 10 * 30 and g.compared < 0.25 * 30 * len(v)
    for q in unit[::100]:
        nodes, s = g.nearest(q, 10, len(v))
        assert nodes[np.lexsort((nodes, -np.round(s, 12)))][:10].tolist() == exact_nearest(v, q, 10) and len(nodes) == len(v)
        for share in (3, 2, 1.1):
            admitted = np.arange(len(v)) % 30 < 30 / share
            nodes, s = g.nearest(q, 10, 10, admitted)
            assert len(nodes) >= 10 and admitted[nodes].all()
        few = np.arange(len(v)) % 29 == 3
        nodes, s = g.nearest(q, 10, 10, few)
        assert nodes[np.lexsort((nodes, -np.round(s, 12)))][:10].tolist() == exact_nearest(v, q, 10, few)


def test_graph_index(spark, tmp_path):
    """Null and zero vectors, null ids in the kept columns, several shards and blocks of queries, an empty table."""
    v = clustered(5, 300)
    data = [(i, [float(x) for x in row], i % 7, None if i % 3 else "a") for i, row in enumerate(v)] + [(1000, None, 1, "a"), (1001, [0.0] * 8, 1, "a"), (1002, None, 2, None)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, tag string").repartition(5)
    smallworld.build(df, 3, ["label", "tag"]).write.parquet(str(tmp_path / "g"))
    index = spark.read.parquet(str(tmp_path / "g"))
    assert index.count() == 3 and sum(len(r[0]) for r in index.select("ids").collect()) == len(data)
    asked = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<float>").alias("q"))
    vectors = v.astype("float32").astype(float)
    by = lambda found: {q: [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in range(0, 300, 20)}
    whole = by(smallworld.search(index, asked, 5, beam=300).collect())
    assert whole == {q: exact_nearest(vectors, vectors[q], 5) for q in whole}
    tagged = by(smallworld.search(index, asked, 5, beam=8, admits=lambda r: (r["tag"] == "a") & (r["label"] == 2)).collect())
    admitted = [i % 3 == 0 and i % 7 == 2 for i in range(300)]
    import numpy as np

    assert tagged == {q: exact_nearest(vectors, vectors[q], 5, np.array(admitted)) for q in tagged}
    before = smallworld.QUERY_BLOCK
    try:
        smallworld.QUERY_BLOCK = 4
        assert by(smallworld.search(index, asked, 5, beam=300).collect()) == whole
    finally:
        smallworld.QUERY_BLOCK = before
    assert smallworld.search(index, asked.where("false"), 5).count() == 0
    assert smallworld.search(smallworld.build(df.where("vec_id >= 1000"), 2), asked, 5).count() == 0
    assert smallworld.build(df.where("false")).count() == 0


def test_blocks_bound_their_scores():
    """No text of a range has a score above the bound of the range's greatest counts."""
    rng = random.Random(4)
    for _ in range(3000):
        groups = [["a"], ["b", "c"], ["d"]][: rng.randint(1, 3)]
        clauses = [fulltext.Clause(tuple((t,) for t in g)) for g in groups]
        at = fulltext.places(" ".join(rng.choice("abcdx") for _ in range(rng.randint(1, 25))), {c: c for c in "abcdx"})
        score = fulltext.cover_density(clauses, at) if fulltext.matches(clauses, at) else 0.0
        covers = len(groups) * min(sum(len(at.get(t, ())) for t in g) for g in groups)
        assert score <= covers / (covers + 1) + 1e-12


def test_searches_read_few_blocks(spark, tmp_path):
    """The best rows of a common word, from some of many ranges; the same as from all postings."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["fox", "dog", "cat", "owl", "hen", "ant", "bee"]) for _ in range(rng.choice([3, 5, 8]))) + " fox" * (40 if k in (77, 150, 402) else 0) for k in range(600)]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "id string, content string")
    index = postings.TextIndex(spark, str(tmp_path / "t"), buckets=4, range_rows=8)
    index.upsert(df)
    whole = fulltext.postings(df)
    for query, limit in (("fox", 3), ("fox dog", 3), ('"fox dog" or bee', 5), ("fox -dog", 2), ("unicorn", 3), ("fox or dog cat", 4), ("-fox", 2), ("", 2), ("fox", 600)):
        read = []
        got = [tuple(r) for r in index.search(query, limit, read).collect()]
        assert got == [tuple(r) for r in fulltext.search(whole, query, limit).collect()], query
        if query == "fox" and limit == 3:
            first, more, total = read[0]
            assert total > 60 and first + more < 0.2 * total
    some = df.where("id % 50 = 0").select("id")
    everything = {r.id: r.keyword_score for r in fulltext.search(whole, "fox dog", None).collect()}
    assert {r.id: r.keyword_score for r in index.scores("fox dog", some).collect()} == {i: s for i, s in everything.items() if int(i) % 50 == 0}


@given(st.lists(st.tuples(st.sampled_from(["upsert", "upsert", "remove", "merge", "all"]), st.lists(st.tuples(st.integers(0, 9), st.sampled_from(["fox", "fox dog", "dog", "fox fox cat", ""])), min_size=1, max_size=4)), min_size=1, max_size=7))
@settings(max_examples=6, deadline=None)
def test_an_index_follows_the_store(spark, tmp_path_factory, steps):
    """After any sequence of changes a search equals that of a rebuild."""
    index, state = postings.TextIndex(spark, str(tmp_path_factory.mktemp("t") / "i"), buckets=2, range_rows=2), {}
    for what, rows_ in steps:
        df = spark.createDataFrame([(str(i), t) for i, t in rows_], "id string, content string").coalesce(1)
        if what == "upsert":
            index.upsert(df)
            state |= {i: max(t for j, t in rows_ if j == i) for i, _ in rows_}
        elif what == "remove":
            index.remove(df)
            state = {i: t for i, t in state.items() if i not in {j for j, _ in rows_}}
        else:
            index.merge(2, everything=what == "all")
    want = fulltext.postings(spark.createDataFrame([(str(i), t) for i, t in state.items()], "id string, content string").coalesce(1))
    for query in ("fox", "fox dog or cat"):
        assert [tuple(r) for r in index.search(query, 3).collect()] == [tuple(r) for r in fulltext.search(want, query, 3).collect()]


def plain_links(body, targets, own):
    """Links by trying each phrase on the body, phrase by phrase."""
    import re

    slug_of = {t["slug"]: t["slug"] for t in targets}
    for t in sorted(targets, key=lambda t: t["ordinal"]):
        for a in t["aliases"]:
            slug_of.setdefault(a if re.fullmatch("[a-z0-9-]{1,64}", a) else seg.slugify(a), t["slug"])
    bare = re.sub(r"(?s)~~~.*?~~~", "", re.sub(r"(?s)```.*?```", "", body))
    linked = {slug_of.get(x if re.fullmatch("[a-z0-9-]{1,64}", x) else seg.slugify(x)) for x in (y.strip() for y in re.findall(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]", bare))}
    needles = {}
    for t in targets:
        for phrase in (t["title"], *t["aliases"]):
            n = phrase.strip().lower()
            if len(n) >= 3 and t["slug"] not in linked and t["slug"] != own:
                needles.setdefault(n, set()).add(t["slug"])
    spans = [m.span() for p in phrases.PROTECTED for m in re.finditer(p, body)]
    new = []
    for n in sorted(needles, key=lambda n: (-len(n), n)):
        (slug,) = needles[n] if len(needles[n]) == 1 else (None,)
        if slug is None or any(slug == x[2] for x in new):
            continue
        for m in re.finditer(re.escape(n), body.lower()):
            word = re.compile("[A-Za-z0-9_]")
            a, b = m.span()
            if (a and word.match(body[a - 1])) or (b < len(body) and word.match(body[b])) or any(a < y and x < b for x, y, *_ in [*spans, *new]):
                continue
            new.append((a, b, slug))
            break
    for a, b, slug in sorted(new, reverse=True):
        body = body[:a] + (f"[[{slug}]]" if body[a:b] == slug else f"[[{slug}|{body[a:b]}]]") + body[b:]
    return body, [x[2] for x in sorted(new)]


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_autolink_pages(spark, block_bytes):
    """Against phrase by phrase, with guards, overlaps, aliases, ambiguous names, existing links, and a dictionary of several blocks."""
    rng = random.Random(12)
    base = ["alpha", "beta", "Gamma", "x-ray", "pg", "delta_1", "Éclair", "ray"]
    words = [*base, *(f"{x} {y}" for x in base for y in base), *(f"{x}-{y}" for x in base[:4] for y in base)]
    glue = [" ", ", ", " `", "` ", "\n```\n", " [[p3]] ", " [[alpha|x]] ", " [see alpha](u) ", "_", "", ". "]
    data = []
    for k in range(40):
        body = "".join(rng.choice(words) + rng.choice(glue if k % 4 == 0 else glue[:2] + glue[-3:]) for _ in range(rng.randrange(30)))
        data.append((f"p{k}", k, words[k * 2] if k % 9 else rng.choice(base), rng.sample([*words, "nobody"], rng.randrange(3)), body, "kept"))
    data += [("pnull", 100, "null body", [], None, "kept"), ("pempty", 101, "  ", [], "", "kept")]
    df = spark.createDataFrame(data, "slug string, ordinal int, title string, aliases array<string>, body string, n string").repartition(3)
    targets = [{"slug": d[0], "ordinal": d[1], "title": d[2], "aliases": d[3]} for d in data]
    got = {r["slug"]: (r["body"], r["added"]) for r in phrases.autolink_pages(df, block_bytes=block_bytes).collect()}
    assert phrases._blocks(phrases.names_of(df), ["phrase"], block_bytes)[0] > (1 if block_bytes < 1000 else 0)
    assert got == {d[0]: plain_links(d[4], targets, d[0]) if d[4] else (d[4], []) for d in data}
    assert sum(len(a) for _, a in got.values()) > 20
    body, added = phrases.linked(text := "A fingerprint skip beats a fingerprint. `fingerprint` pg pgvector", phrases.mentions(text, text.lower(), phrases._automaton(["fingerprint skip", "fingerprint", "pgv"]), [("fingerprint skip", ["skip"]), ("fingerprint", ["fp"]), ("pgv", ["pgv"])]), "me", set())
    assert body == "A [[skip|fingerprint skip]] beats a [[fp|fingerprint]]. `fingerprint` pg pgvector" and added == ["skip", "fp"]
    assert phrases.autolink_pages(df.where("false")).count() == 0


@pytest.mark.parametrize("block_bytes", [8 << 20, 200])
def test_candidate_pages(spark, block_bytes):
    rng = random.Random(2)
    words = ["alpha", "Beta", "gam", "ab", "alphabet", "İstanbul", "delta"]
    items = [(k, rng.choice([None, "", " ".join(rng.choice(words) + rng.choice(["s", ""]) for _ in range(4))])) for k in range(60)]
    titles = [(f"p{k}", rng.choice(words), rng.sample(words, 2), k) for k in range(30)]
    hits = [(k, f"p{rng.randrange(40)}", 1 + n) for k in range(0, 60, 3) for n in range(3)]
    got = phrases.candidate_pages(spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(titles, "slug string, title string, aliases array<string>, ordinal int"), spark.createDataFrame(hits, "item_id int, slug string, rank int"), 6, block_bytes)
    want = {}
    for k, text in items:
        ranked = {}
        for i, slug, rank in hits:
            if i == k:
                ranked[slug] = min(rank, ranked.get(slug, rank))
        for slug, title, aliases, _ in titles:
            if text and any(len(n.strip()) >= 3 and n.strip().lower() in text.lower() for n in (title, *aliases)):
                ranked.setdefault(slug, 1 << 30)
        want[k] = sorted(ranked, key=lambda s: (ranked[s], s))[:6]
    by = {}
    for r in sorted(got.collect(), key=lambda r: r["place"]):
        by.setdefault(r["item_id"], []).append(r["slug"])
    assert by == {k: v for k, v in want.items() if v}


@pytest.fixture
def by_parts(monkeypatch):
    monkeypatch.setattr(scans, "WINDOW_BYTES", -1)


def hot_log(spark, seed, n=900):
    """A third of the rows in one group, small groups, a null group, ties in time."""
    rng = random.Random(seed)
    words = ["a", "ab", "abc", "b", "bc", None]
    data = [(i, "hot" if i % 3 == 0 else None if i % 17 == 0 else f"g{i % 40}", rng.randrange(n // 3), rng.choice(words), rng.choice([0, 1, 5, 40, 120, 400, None])) for i in range(n)]
    return data, spark.createDataFrame(data, "id int, g string, ts int, q string, c int").repartition(7)


@pytest.mark.parametrize("seed", range(3))
def test_scans_over_parts_match_windows(spark, by_parts, seed):
    data, df = hot_log(spark, seed)
    w = "(PARTITION BY g ORDER BY ts, id)"
    df.createOrReplaceTempView("hot_log")
    key = lambda r: tuple((x is None, x) for x in r)
    plain = lambda sql: sorted(map(tuple, spark.sql(sql).collect()), key=key)
    rows_ = scans.parted(df, ["g"], ["ts", "id"], 9)
    got = scans.look(scans.look(scans.running(rows_, ["g"], ["ts", "id"], F.col("c"), "s"), ["g"], ["ts", "id"], "q", "n"), ["g"], ["ts", "id"], "c", "b", back=True)
    assert sorted(map(tuple, got.select("id", "s", "n", "b").collect()), key=key) == plain(f"SELECT id, coalesce(sum(c) OVER {w}, 0), lead(q) OVER {w}, lag(c) OVER {w} FROM hot_log")
    typed = rows.collapse_typing(df, ["g"], "q")
    assert typed.columns == df.columns
    assert sorted(r.id for r in typed.collect()) == sorted(r[0] for r in spark.sql(f"SELECT id FROM (SELECT *, lead(q) OVER {w} AS n FROM hot_log) WHERE NOT coalesce(startswith(n, q), false)").collect())
    index = rows.index_within(df, ["g"], ["ts", "id"])
    assert sorted(map(tuple, index.select("id", "chunk_index", "chunk_count").collect())) == plain(f"SELECT id, row_number() OVER {w} - 1, count(*) OVER (PARTITION BY g) FROM hot_log")
    from tidemark.operators import demand

    line = demand.spark_line(df, "g", "id", "c").select("id", F.round("scaled", 9), "delta")
    v = "(PARTITION BY g)"
    assert sorted(map(tuple, line.collect()), key=key) == plain(f"SELECT id, round(coalesce(try_divide(c - min(c) OVER {v}, max(c) OVER {v} - min(c) OVER {v}), 0.5), 9), c - lag(c) OVER (PARTITION BY g ORDER BY id) FROM hot_log")


@pytest.mark.parametrize("most_rows, most_cost, parts", [(64, 300, 9), (3, 150, 40), (1, 10, 5), (200, 10**9, 13), (5, 0, 300)])
def test_batches_compose_over_parts(spark, most_rows, most_cost, parts):
    """Resets that pass from part to part, parts shorter than a batch, costs beyond the limit."""
    data, df = hot_log(spark, most_rows)
    thin = df.select("g", F.col("id").cast("long").alias("o"), F.coalesce("c", F.lit(0)).cast("long").alias("c"))
    got = {(r.g, r.o): r.batch for r in scans.batches(scans.parted(thin, ["g"], ["o"], parts), most_rows, most_cost).collect()}
    want = {}
    for g in {d[1] for d in data}:
        batch, n, used = 0, 0, 0
        for i, _, _, _, c in sorted(d for d in data if d[1] == g):
            if n and (n == most_rows or used + (c or 0) > most_cost):
                batch, n, used = batch + 1, 0, 0
            n, used = n + 1, used + (c or 0)
            want[g, i] = batch
    assert got == want


def test_a_hot_group_is_spread_over_the_tasks(spark, by_parts):
    data, df = hot_log(spark, 1, 6000)
    sizes = [r["count"] for r in scans.parted(df, ["g"], ["ts", "id"], 12).where("g = 'hot'").groupBy("_part").count().collect()]
    assert len(sizes) >= 4 and max(sizes) <= 1.5 * 6000 / 12
    assert rows.collapse_typing(df.where("false"), ["g"], "q").count() == 0
    talk = spark.createDataFrame([("c", i, "user" if i % 5 == 0 else "assistant", str(i)) for i in range(200)] + [("d", 1, "assistant", "x"), ("d", 2, "user", "y")], "conv_id string, turn int, role string, text string")
    got = {(r.conv_id, r.turn): r.trajectory for r in rows.sessionize(talk).collect()}
    assert got == {("c", i): i // 5 + 1 for i in range(200)} | {("d", 2): 1}


@pytest.fixture
def by_value():
    """Tasks get the functions of this module with the closure: they cannot import it."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    yield
    cloudpickle.unregister_pickle_by_value(sys.modules[__name__])


def scripted_model(payload):
    """Writes the pages that an item names ("write slug title: words"): the new text after what the candidate page holds."""
    if any("boom" in i["text"] for i in payload["items"]):
        raise ValueError("no answer")
    held, ops = {c["slug"]: c for c in payload["candidates"]}, []
    for i in payload["items"]:
        if i["text"].startswith("write "):
            _, slug, title, body = i["text"].split(" ", 3)
            old = held.get(slug)
            text = body if old is None or "short" in body else f"{old['body']} {body}"
            ops.append({"slug": slug, "title": title, "kind": "note", "summary": f"seen {len(held)}", "aliases": [], "sources": [i["id"], "stray"], "body": text})
    return ops


def scripted_retry(payload):
    return [{"slug": p["slug"], "title": "r", "kind": "note", "summary": "", "aliases": [], "sources": [], "body": p["old"][:300] + " kept " + p["new"]} for p in payload["pages"] if "retry" in p["new"]]


def serial_run(units_, items, pages_):
    """The same one unit after the other, on dicts."""
    import re

    pages_, ledger, failed = {s: dict(p) for s, p in pages_.items()}, {}, set()
    for unit, day in units_:
        mine = sorted((i for i in items if i[0] == unit), key=lambda i: i[1])
        near = sorted(s for s, p in pages_.items() if any(len(n.strip()) >= 3 and n.strip().lower() in (i[3] or "").lower() for n in (p["title"], *p["aliases"]) for i in mine))[:8]
        payload = {"unit": unit, "items": [{"id": i[1], "kind": i[2], "text": i[3]} for i in mine], "candidates": [{"slug": s, **pages_[s]} for s in near]}
        try:
            ops = scripted_model(payload)
        except ValueError:
            failed.add(unit)
            continue
        ops = list({op["slug"]: op for op in ops}.values())
        names = {s: {"slug": s, "title": p["title"], "aliases": p["aliases"], "ordinal": 0} for s, p in pages_.items()}
        for op in ops:
            names[op["slug"]] = {"slug": op["slug"], "title": op["title"], "aliases": names.get(op["slug"], {"aliases": []})["aliases"], "ordinal": 0}
        targets = sorted(names.values(), key=lambda t: t["slug"])
        link = lambda body, own: plain_links(body, targets, own)[0] if body else body
        for op in ops:
            op["body"] = link(op["body"], op["slug"])
        shrunk = lambda old, new: len(old) > 500 and len(new) < 0.4 * len(old)
        bad = [{"slug": op["slug"], "old": pages_[op["slug"]]["body"], "new": op["body"]} for op in ops if op["slug"] in pages_ and shrunk(pages_[op["slug"]]["body"], op["body"])]
        again = {op["slug"]: link(op["body"], op["slug"]) for op in scripted_retry({"unit": unit, "pages": bad})} if bad else {}
        for op in ops:
            slug, old, body = op["slug"], pages_.get(op["slug"]), op["body"]
            if old and shrunk(old["body"], body):
                body = again[slug] if slug in again and not shrunk(old["body"], again[slug]) else f"{old['body'].rstrip()}\n\n## Addendum ({day[:10]})\n\n{body.strip()}"
            ids = {i[1] for i in mine}
            pages_[slug] = {"title": op["title"], "aliases": list((old or {"aliases": []})["aliases"]), "body": body, "summary": op["summary"], "sources": list(dict.fromkeys([*(old or {"sources": []})["sources"], *(x for x in op["sources"] if x in ids)]))}
        ledger[unit] = sorted(op["slug"] for op in ops)
    return pages_, ledger, failed


@pytest.mark.parametrize("seed", range(4))
def test_compiling_in_waves_equals_the_serial_run(spark, by_value, seed):
    rng = random.Random(seed)
    names = ["alpha", "bravo", "carol", "delta", "echos", "foxes"]
    start = {f"{n}-page": {"title": n, "aliases": rng.sample(["xx-" + n, "shared"], 1), "body": n + " start " + "long " * rng.choice([1, 150]), "summary": "s", "sources": [f"old-{n}"]} for n in names[:3]}
    units_, items = [], []
    for k in range(8):
        unit = f"u{k:02}"
        units_.append((unit, f"2024-01-{k + 1:02}T00:00:00Z"))
        for j in range(rng.randrange(4)):
            n = rng.choice(names)
            text = rng.choice([f"write {n}-page {n}: about {rng.choice(names)} {rng.choice(['', 'short', 'short retry'])}", f"mentions {n} only", f"write new{rng.randrange(3)}-page fresh{rng.randrange(3)} text of xx-{n}", None if rng.random() < 0.2 else "nothing", "boom" if rng.random() < 0.3 else "quiet"])
            items.append((unit, f"{unit}-{j}", "note", text or ""))
    want = serial_run(units_, items, start)
    schema = "slug string, title string, kind string, summary string, aliases array<string>, sources array<string>, trajectories array<string>, created string, updated string, body string"
    pages_ = spark.createDataFrame([(s, p["title"], "note", p["summary"], p["aliases"], p["sources"], [], "c", "u", p["body"]) for s, p in start.items()], schema)
    df = spark.createDataFrame([(u, d, d) for u, d in units_], "unit string, last_ts string, day string").repartition(3)
    calls = spark.sparkContext.accumulator(0)

    def counted(payload):
        calls.add(1)
        return scripted_model(payload)

    got = compilation.compile_units(df, spark.createDataFrame(items, "unit string, id string, kind string, text string"), pages_, counted, scripted_retry)
    rows_ = {r["slug"]: {"title": r["title"], "aliases": r["aliases"], "body": r["body"], "summary": r["summary"], "sources": r["sources"]} for r in got["pages"].collect()}
    assert rows_ == want[0]
    assert {r["unit"]: r["slugs"] for r in got["ledger"].collect()} == want[1] and {r["unit"] for r in got["failed"].collect()} == want[2]
    assert got["waves"] <= len(units_) and calls.value >= len(units_)


def test_units_apart_take_one_wave(spark, by_value):
    items = [(f"u{k}", f"i{k}", "note", f"write page{k} title{k} body number {k}") for k in range(6)]
    df = spark.createDataFrame([(f"u{k}", f"2024-01-0{k + 1}", f"2024-01-0{k + 1}") for k in range(6)], "unit string, last_ts string, day string")
    none = spark.createDataFrame([], "slug string, title string, kind string, summary string, aliases array<string>, sources array<string>, trajectories array<string>, created string, updated string, body string")
    got = compilation.compile_units(df, spark.createDataFrame(items, "unit string, id string, kind string, text string"), none, scripted_model)
    assert got["waves"] == 1 and got["pages"].count() == 6 and got["ledger"].count() == 6
    few = compilation.compile_units(df, spark.createDataFrame(items, "unit string, id string, kind string, text string"), none, scripted_model, limit=2)
    assert sorted(r["unit"] for r in few["ledger"].collect()) == ["u0", "u1"]
    assert compilation.compile_units(df.where("false"), spark.createDataFrame(items, "unit string, id string, kind string, text string"), none, scripted_model)["pages"].count() == 0
