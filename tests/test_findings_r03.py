"""Findings of round 3: one or more small tests for each."""

import re

from tidemark.plans import catalog


def _nulls_as_in_sql(spark, sf, duck, name):
    """Rows and nulls as SQL gives them: `canonical` takes a null for an empty text."""
    columns = duck.sql(catalog.ORACLE_SQL[name]).columns
    got = [tuple(r[c] for c in columns) for r in catalog.QUERIES[name](spark, sf).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, duck.sql(catalog.ORACLE_SQL[name]).fetchall()))


def test_lint_pages_without_detail_are_null(spark, sf, duck):
    _nulls_as_in_sql(spark, sf, duck, "lint_pages")


def test_lint_provenance_without_detail_is_null(spark, sf, duck):
    _nulls_as_in_sql(spark, sf, duck, "lint_provenance")


def test_lint_provenance_of_repeated_and_missing_ids(spark, sf, tmp_path):
    """A page that comes twice had its broken sources counted twice, and one without an id had a broken source."""
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE TABLE documents AS SELECT * FROM '{sf}/documents.parquet'")
    con.sql(f"CREATE TABLE pages AS SELECT * FROM '{sf}/pages.parquet' WHERE page_id < 20 UNION ALL SELECT * FROM '{sf}/pages.parquet' WHERE page_id < 7 UNION ALL SELECT NULL, url, html FROM '{sf}/pages.parquet' WHERE page_id < 2")
    for name in ("documents", "pages"):
        con.sql(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    _nulls_as_in_sql(spark, str(tmp_path), con, "lint_provenance")


def test_lint_parses_pages_once(spark, sf, duck):
    """Every rule, and the sort twice, read and parsed the bodies again."""
    found = catalog.QUERIES["lint_pages"](spark, sf)
    assert found.count() == len(duck.sql(catalog.ORACLE_SQL["lint_pages"]).fetchall())
    assert found.inputFiles() and not any("pages.parquet" in f for f in found.inputFiles())
    counts = catalog.QUERIES["lint_counts"](spark, sf)
    assert not any("pages.parquet" in f for f in counts.inputFiles())


def test_lint_of_some_rules_leaves_out_the_rest(spark):
    from pyspark.sql import functions as F
    from tidemark.operators import graph

    pages = spark.createDataFrame([("a", ["x"], "b" * 130), ("b", ["x"], "short")], "slug string, aliases array<string>, body string")
    links = spark.createDataFrame([("a", "b", False), ("b", "gone", True)], "src string, dst string, dangling boolean")
    want = [("warn", "dangling-link", "b", "gone"), ("warn", "spelling-drift", "a", "b"), ("info", "orphan", "a", None), ("info", "stub", "b", "5")]
    assert [tuple(r) for r in graph.lint(pages, links).collect()] == want
    sized = pages.select("slug", "aliases", F.length("body").alias("size"))
    some = graph.findings(sized, links).where("rule = 'stub'")
    assert [tuple(r) for r in some.collect()] == want[-1:] and "Join" not in some._jdf.queryExecution().optimizedPlan().toString()


def test_shards_keep_their_size(spark, sf):
    from tidemark.operators import smallworld

    before = smallworld.SHARD_ROWS
    try:
        smallworld.SHARD_ROWS = 40
        e = spark.range(200).selectExpr("id AS vec_id", "array(sin(id), cos(id), 1 + id / 7) AS embedding")
        index = smallworld.build(e, 2).selectExpr("size(ids) AS n", "vectors").collect()
        assert len(index) == 5 and sum(r["n"] for r in index) == 200
        stored = {x for r in index for x in r["vectors"]}
        assert {x for (v,) in e.selectExpr("CAST(embedding AS array<float>)").collect() for x in v} == stored  # as they were given
    finally:
        smallworld.SHARD_ROWS = before


def test_a_graph_is_built_by_products():
    """Building took some 20 milliseconds a vector; links and recall are held by the tests of the engine."""
    import time

    import numpy as np
    from tidemark.operators import smallworld

    v = np.random.default_rng(1).normal(size=(2000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    began = time.process_time()
    smallworld.Layers(v, np.arange(2000) % 16 // 15).build(64)
    assert time.process_time() - began < 8


def test_filtered_graph_is_exact_beyond_a_beam(spark, sf):
    """More rows pass than a beam of this width looked through: 1,000 of one shard."""
    import numpy as np
    from pyspark.sql import functions as F
    from tidemark.operators import smallworld

    v = np.random.default_rng(5).normal(size=(1500, 32)).astype("float32")
    e = spark.createDataFrame([(i, [float(x) for x in r], i % 3) for i, r in enumerate(v)], "vec_id long, embedding array<float>, label int")
    asked = e.where("vec_id < 40").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = smallworld.search(smallworld.build(e, 1, ["label"], width=16), asked, 10, 4, lambda r: r["label"] != 1).collect()
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    own = [i for i in range(1500) if i % 3 != 1]
    for q in range(40):
        best = sorted(own, key=lambda i: (-round(float(unit[q] @ unit[i]), 12), i))[:10]
        assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] == best


def test_close_names_of_a_series(spark):
    """A dense series shared its parts with all of itself: candidates grew with the square of the names."""
    from tidemark.operators import graph

    names = {f"p{i}" for i in range(1, 3000)}
    found = [tuple(r) for r in graph.close_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()]
    other = lambda n: {n[:i] + c + n[i + 1 :] for i in range(len(n)) for c in "p0123456789"} | {n[:i] + c + n[i:] for i in range(len(n) + 1) for c in "p0123456789"}
    want = {tuple(sorted((a, b))) for a in names for b in other(a) & names if a != b and max(len(a), len(b)) >= 4}
    assert len(found) == len(set(found)) and set(found) == want
    plan = graph.close_names(spark.range(9).selectExpr("concat('p', id) AS name"))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, .*\bi#\d+ = i#\d+", plan)  # the place of the edit is a key


def test_a_join_does_not_multiply_parts(spark, sf):
    """Catalyst takes the product of a join's sides for its size, which asked for millions of parts."""
    from tidemark.operators import scans
    from tidemark.plans.views import table

    c = table(spark, sf, "conversations").select("conv_id", "turn")
    joined = c.hint("merge").join(c.withColumnRenamed("turn", "other"), "conv_id").join(c.withColumnRenamed("turn", "third"), "conv_id")
    assert 0 < scans.plan_bytes(joined) <= 3 * scans.plan_bytes(table(spark, sf, "conversations"))


def test_trajectory_chunk_index_by_parts(spark, sf, duck, monkeypatch):
    from tidemark.operators import scans

    written = []
    monkeypatch.setattr(scans, "WINDOW_BYTES", 0)
    monkeypatch.setattr(scans, "materialise", lambda df, name, own=scans.materialise: written.append(df.columns) or own(df, name))
    _nulls_as_in_sql(spark, sf, duck, "trajectory_chunk_index")
    assert written and all("text" not in c for c in written)


def test_index_tasks_grow_with_the_table(spark, sf, tmp_path, monkeypatch):
    """A folder was one task's (or `splits` tasks') however large the table: files tell how many wrote it."""
    from tidemark.operators import fulltext, postings, scans
    from tidemark.plans import views

    chunks = views.chunks(spark, sf).select("id", "content")
    monkeypatch.setattr(scans, "PART_BYTES", 5_000)
    index = postings.TextIndex(spark, str(tmp_path / "t"), buckets=2, range_rows=8)
    index.upsert(chunks)
    fulltext.write_index(fulltext.postings(chunks), str(tmp_path / "p"), buckets=2, splits=1)
    postings.ordered_by_id(chunks, str(tmp_path / "r"), 1)
    files = lambda name: len(list((tmp_path / name).rglob("part-*.parquet")))
    assert files("t/blocks/batch-1") > 2 and files("p") > 2 and files("r") > 1
    query = "thties haing"
    one = [(r["id"], round(r["keyword_score"], 9)) for r in fulltext.search(fulltext.read_index(spark, str(tmp_path / "p"), query, buckets=2), query, 20).collect()]
    assert one == [(r["id"], round(r["keyword_score"], 9)) for r in index.search(query, 20).collect()]


def test_candidate_pages_join_no_more_than_can_be_taken(spark, monkeypatch):
    """Every item met every page of its phrases, though it takes a few: 300 pages share a name here."""
    from tidemark.operators import phrases

    written = []
    monkeypatch.setattr(phrases, "materialise", lambda df, name, own=phrases.materialise: written.append((name, own(df, name))) or written[-1][1])
    pages = spark.createDataFrame([(f"p{i:03d}", "About", [f"only {i}"]) for i in range(300)], "slug string, title string, aliases array<string>")
    items = spark.createDataFrame([(1, "all about it"), (2, "only 7 and about"), (3, "none")], "item_id int, text string")
    hits = spark.createDataFrame([(1, "p002", 1), (1, "p200", 0), (2, "p001", 0), (3, "p009", 0)], "item_id int, slug string, rank int")
    got = sorted(tuple(r) for r in phrases.candidate_pages(items, pages, hits, 4).collect())
    want = {1: ["p200", "p002", "p000", "p001"], 2: ["p001", "p000", "p002", "p003"], 3: ["p009"]}
    assert got == sorted((i, s, n + 1) for i, w in want.items() for n, s in enumerate(w))
    assert dict(written)["names"].where("phrase = 'about'").count() == 4


def test_autolink_holds_names_that_can_link(spark, monkeypatch):
    """Phrases of many pages went to every task with all their pages, though one page must be left of them."""
    from tidemark.operators import phrases
    from tidemark.sources import shared

    written = []
    monkeypatch.setattr(shared, "STEP_BYTES", 16)  # a step for each text
    monkeypatch.setattr(phrases, "materialise", lambda df, name, own=phrases.materialise: written.append((name, own(df, name))) or written[-1][1])
    targets = [(f"t{i:02d}", "Shared", [f"Pair {i // 2}", f"Trio {i // 3}"], i) for i in range(30)] + [("u", "Unique", ["Duo"], 30), ("v", "V", ["Duo"], 31)]
    pages = [("x", "shared, unique, pair 1 and trio 1"), ("t02", "pair 1 names another"), ("y", "[[t03]] and trio 1, pair 1"), ("z", "[[t03]] [[t04]] trio 1"), ("w", None)]
    rows = spark.createDataFrame(targets, "slug string, title string, aliases array<string>, ordinal int")
    got = {r["slug"]: r["added"] for r in phrases.autolink_pages(spark.createDataFrame(pages, "slug string, body string"), rows).collect()}
    assert got == {"x": ["u"], "t02": ["t03"], "y": ["t02"], "z": ["t05"], "w": []}
    held = dict(written)["phrases"]
    assert held.where("phrase = 'shared'").count() == 0 and held.where("phrase = 'trio 1'").count() == 1
    size = phrases._blocks(held, ["phrase", "slugs"], 2000)[0]
    assert size > phrases._blocks(held, ["phrase"], 2000)[0]


def test_positions_shuffle_no_pairs(spark, monkeypatch):
    """Every pair of a query and a row was sorted or gathered; now pairs are made where they are counted, some for each task."""
    import random

    from pyspark.sql import functions as F
    from tidemark.operators import retrieval

    rng = random.Random(3)
    ids = rng.sample(range(1000), 60)
    corpus = spark.createDataFrame([(i, i // 3, i % 2) for i in ids], "id long, pos long, label int")  # pos with gaps and ties
    ranking = [(q, i, n) for q in range(7) for n, i in enumerate(rng.sample(ids, q))] + [(3, 5000, 0), (8, 5000, 0)]
    asked = spark.createDataFrame(ranking, "query_id long, id long, rank int")
    order = sorted(ids, key=lambda i: (i // 3, i))
    want = {}
    for q in {q for q, _, _ in ranking}:
        first = [i for _, i in sorted((n, i) for p, i, n in ranking if p == q and i in ids)]
        want |= {(q, i): n + 1 for n, i in enumerate(first + [i for i in order if i not in first])}
    for pairs in (1 << 22, 20):
        monkeypatch.setattr(retrieval, "PAIRS", pairs)
        found = retrieval.full_ranking(corpus.select("id", "pos"), asked)
        assert sorted(map(tuple, found.collect())) == sorted((q, i, n) for (q, i), n in want.items())
        queries = asked.select("query_id").distinct().withColumn("label", (F.col("query_id") % 2).cast("int"))
        found = retrieval.full_ranking(corpus, asked, queries=queries, by="label")
        assert sorted(map(tuple, found.collect())) == sorted((q, i, n) for (q, i), n in want.items() if q % 2 == i % 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("Exchange")]
    assert "Join" in top and "Sort" not in top and "Window" not in top and "Aggregate" not in top
    got = retrieval.positions(corpus, asked, asked.select("query_id", "id").union(asked.select("query_id", F.lit(ids[0]).alias("id")))).collect()
    assert sorted(map(tuple, got)) == sorted((q, i, want[q, i]) for q, i in {(q, i) for q, i, _ in ranking if i in ids} | {(q, ids[0]) for q, _, _ in ranking})


def _asked_of(spark, rows, queries):
    from pyspark.sql import functions as F

    asked = spark.range(queries).select((F.col("id") * 20).alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("rank"))
    return asked.withColumn("id", (F.col("query_id") * 37 + F.col("rank") * F.col("rank") * 13) % rows)


def test_rankings_take_little_room(spark, tmp_path):
    """Rows of a ranking were written in an order that took 3.3 bytes for each here, now 1.1."""
    from pyspark.sql import functions as F
    from tidemark.operators import retrieval

    corpus = spark.range(6411).select("id", F.col("id").alias("pos"))
    retrieval.full_ranking(corpus, _asked_of(spark, 6411, 200)).coalesce(1).write.parquet(str(tmp_path / "r"))
    assert sum(f.stat().st_size for f in (tmp_path / "r").glob("*.parquet")) < 2 * 200 * 6411


def test_rankings_in_blocks_of_any_size(spark, monkeypatch):
    from pyspark.sql import functions as F
    from tidemark.operators import retrieval

    corpus = spark.range(4000).select("id", F.col("id").alias("pos"), F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 7).cast("int").alias("label"))
    asked = _asked_of(spark, 4000, 60)
    ranked = {(r["query_id"], r["id"]): r["rank"] for r in asked.collect()}
    want = {}
    for q in range(0, 1200, 20):
        order = sorted(range(4000), key=lambda i: (ranked.get((q, i), 99), i))
        want |= {(q, i): n + 1 for n, i in enumerate(order)}
    assert {(r[0], r[1]): r[2] for r in retrieval.full_ranking(corpus.select("id", "pos"), asked).collect()} == want
    queries = asked.select("query_id").distinct().withColumn("label", (F.col("query_id") % 7).cast("int"))
    label = lambda i: 0 if i < 3000 else i % 7
    for rows in (1, 50, 1 << 20):
        monkeypatch.setattr(retrieval, "BLOCK_ROWS", rows)
        found = retrieval.full_ranking(corpus, asked, queries=queries, by="label").collect()
        assert len(found) == len({r[:2] for r in found}) and {r[:2]: r[2] for r in map(tuple, found)} == {k: n for k, n in want.items() if label(k[1]) == k[0] % 7}


def test_chunks_and_pages_are_objects_step_by_step(spark, tmp_path, monkeypatch):
    """All texts of a batch, 10,000 rows, were objects at once, and so were their chunks and files."""
    import pyarrow as pa
    from tidemark.functions import segments
    from tidemark.sources import pages, shared

    texts = pa.array(["a b\n\n" + "word " * k for k in range(40)] + [None, "", "x" * 500])
    monkeypatch.setattr(shared, "STEP_BYTES", 300)
    made = list(segments.chunks_of.func(iter([texts, texts.slice(0, 0)])))
    assert len(made) > 10 and [c for m in made for c in m.to_pylist()] == [segments.chunk_text(t) for t in texts.to_pylist()]
    assert max(len(s.to_pylist()) for s in shared.steps([texts], 0)) < 30
    page = ("s", 1, "T", "howto", "sum", ["a"], ["z", "b"], [], "f", "c", "u", "Body\n")
    rows = spark.createDataFrame([(f"p{k}", *page[1:-1], "Body " * k) for k in range(9)], pages.PAGE)
    pages.write_pages(rows, str(tmp_path / "p"))
    back = sorted(tuple(r) for r in pages.read_pages(spark, str(tmp_path / "p")).collect())
    assert back == [(f"p{k}", *page[1:6], ["b", "z"], *page[7:-1], "Body " * k) for k in range(9)]


def test_base_scores_train_no_model(spark, sf, monkeypatch):
    """The columns of counts asked for a model that none of them needs."""
    from tidemark.llm import lm_score, queries

    monkeypatch.setattr(lm_score.LogBilinear, "update", None)
    got = queries.lm_base_scores(spark, sf).collect()
    assert len(got) == queries.table(spark, sf, "documents").count()
    docs = queries.table(spark, sf, "documents")
    assert lm_score.score(docs, fitted=lm_score.fit(docs, counts_only=True)).where("score IS NOT NULL").count() == 0


def test_masks_in_linear_time():
    """Every sign of a run looked for an @ up to the run's end; the masks are those of the plain pattern."""
    import random
    import time

    from tidemark.llm import edit_counts

    plain = re.compile(r"[^\s@]+@[^\s@]+|[0-9][0-9().+-]{3,}[0-9]|([*#$%&!])\1+")
    rng = random.Random(9)
    texts = ["".join(rng.choice("a1@ *#+-.\n9b!") * rng.randrange(1, 5) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["a@b@c@d", "**a@b", "12345@x 12345"]
    for t in texts:
        assert edit_counts.masking_edits(t) == [(m.start(), m.end(), "#" if m[1] else "MASK") for m in plain.finditer(t)], t
    began = time.process_time()
    assert edit_counts.masking_edits("a" * 100_000 + " @") == []
    assert time.process_time() - began < 1


def test_sums_of_a_tree_after_each_edit():
    """Sums above one leaf are moved by what an edit adds; they must stay those of its chunks."""
    import random

    from tidemark.llm import edit_counts
    from tidemark.llm.tokens import encoder

    rng, enc = random.Random(4), encoder(None)
    for text in ("", "one two  three\n12345", "word " * 400):
        tree, own = edit_counts.TokenTree(text, enc), text
        for _ in range(60):
            start = rng.randrange(len(own) + 1)
            end, new = min(len(own), start + rng.choice((0, 1, 9, 300))), rng.choice(("", "x", " y z", "ab " * 90))
            tree.apply(start, end, new)
            own = own[:start] + new + own[end:]
            assert tree.text() == own and tree.total == len(enc.encode(own)) // 4 and tree.chars[1] == len(own)


def test_blocks_are_made_where_their_texts_lie(spark):
    """Every posting was shuffled and gathered for its block; now a range's texts are, and a task inverts a range at a time."""
    from tidemark.operators import fulltext, postings

    texts = ["the parsed indexes", "an Index parses; index", None, "", "of the", "relational hopping, ponies 7"] * 20
    rows = [(f"r{i:03d}", t) for i, t in enumerate(texts)] + [("r000", "zebra parsed"), ("r001", None), (None, "index of none")]
    df = spark.createDataFrame(rows, "id string, content string").repartition(3)
    greatest: dict = {}
    for i, t in rows:
        greatest[i] = max(greatest.get(i, ""), t or "")
    for ranges in (1, 7):
        made = postings.blocks(df, ranges, 4)
        got = made.collect()
        entries = [(r["term"], i, tuple(p)) for r in got for i, p in zip(r["ids"], r["positions"])]
        want = [(s, i, tuple(p)) for i, t in greatest.items() for s, p in fulltext.places(t, fulltext._Stems()).items()]
        assert sorted(entries, key=repr) == sorted(want, key=repr)
        assert len({(r["term"], r["range"]) for r in got}) == len(got)
        assert all(r["most"] == max(map(len, r["positions"])) and r["ids"] == sorted(r["ids"], key=lambda i: (i is not None, i)) for r in got)
    plan = made._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert "Aggregate" not in plan


def test_a_task_writes_one_folder(spark, tmp_path, monkeypatch):
    """Folders and their splits were dealt by hash, several of them to one task; and splits followed the compressed files."""
    from tidemark.operators import postings, scans

    monkeypatch.setattr(scans, "PART_BYTES", 2_000)
    rows = spark.range(400).selectExpr("CAST(id AS string) AS id", "concat('common word', id % 50, ' and other', id) AS content")
    index = postings.TextIndex(spark, str(tmp_path / "t"), buckets=4, range_rows=8)
    index.upsert(rows)
    files = list((tmp_path / "t" / "blocks" / "batch-1").rglob("part-*.parquet"))
    assert len(files) > 8 and len({f.name.split("-")[1] for f in files}) == len(files)


def test_searches_of_a_block_step_together():
    """Each query walked the graph by itself; a step of all finds the same nodes with as many similarities computed."""
    import numpy as np
    from tidemark.operators import smallworld

    rng = np.random.default_rng(2)
    for n, width in ((1, 3), (2, 3), (700, 12)):
        v = smallworld._unit(rng.normal(size=(30, 16))[rng.integers(0, 30, n)] + 0.5 * rng.normal(size=(n, 16)))
        layers = smallworld.Layers(v, np.arange(n) % 16 // 15 + (np.arange(n) == n // 2)).build(24)
        q = smallworld._unit(rng.normal(size=(50, 16)))
        nodes, s, compared = layers.nearest_of(q, width)
        for j in range(len(q)):
            layers.compared = 0
            found = layers.beam(q[j], layers.descend(q[j], 0), 0, width)
            assert {x for _, x in found} == set(nodes[j][nodes[j] >= 0].tolist()) and layers.compared == compared[j]
