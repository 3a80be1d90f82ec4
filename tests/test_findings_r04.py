"""Faults that round 4's findings name."""

import numpy as np
from pyspark.sql import functions as F


def test_like_vectors_are_one_row(spark, sf):
    """Copies of a vector were searched one by one; the rows found are those of a search over all rows, ties by id as well."""
    from tidemark.operators import retrieval

    own = np.random.default_rng(4).integers(-2, 3, (40, 4)).astype("float32")  # many are alike, or have one direction
    rows = [(i, [float(x) for x in own[i * 7 % 40]]) for i in range(300)] + [(900, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    asked = v.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["similarity"], 9)) for r in df.collect())
    once = retrieval.once(v, 10)
    held = once.collect()
    assert len(held) == len({tuple(r["embedding"]) for r in held}) == len({tuple(x) for x in own.tolist()})
    assert all(r["alike"][:1] == [r["vec_id"]] and r["alike"] == sorted(r["alike"])[:10] for r in held)
    assert got(retrieval.spread(retrieval.batch_topk(once, asked, 10), once, 10)) == got(retrieval.batch_topk(v, asked, 10))


def test_graph_recall_of_like_orders(spark, sf, duck, tmp_path, monkeypatch):
    """Every order was a node of a shard, and shards grew with the orders, which each query walked through: repeated orders add none."""
    import os

    from tidemark.operators import smallworld
    from tidemark.plans import catalog

    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
    last = rows.agg(F.max("o_orderkey")).head()[0]
    shift = -(-(last + 1) // (499 * 20)) * 499 * 20
    rows.crossJoin(spark.range(3)).select((F.col("o_orderkey") + F.col("id") * shift).alias("o_orderkey"), (F.col("o_custkey") + F.col("id") * 500).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    os.symlink(f"{sf}/embeddings.parquet", f"{tmp_path}/embeddings.parquet")
    nodes, asked = [], []
    monkeypatch.setattr(smallworld, "build", lambda v, own=smallworld.build, **k: nodes.append(v.count()) or own(v, **k))
    monkeypatch.setattr(smallworld, "search", lambda i, q, *a, own=smallworld.search, **k: asked.append(q.count()) or own(i, q, *a, **k))
    got = [tuple(r) for r in catalog.graph_recall(spark, str(tmp_path)).collect()]
    sql = catalog.ORACLE_SQL["graph_recall"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert got == duck.sql(sql).fetchall() and got[0][1:] == (True, True)
    assert nodes[0] <= rows.count() and asked[0] <= rows.where("o_orderkey % 20 = 0").count()


def test_nearest_by_single_precision_is_exact():
    """Scores that single precision cannot tell apart, zero queries, and fewer rows than are asked for."""
    from tidemark.operators.retrieval import Nearest

    rng = np.random.default_rng(8)
    unit = lambda x: x / np.maximum(1e-300, np.linalg.norm(x, axis=1, keepdims=True))
    v = unit(np.repeat(rng.normal(size=(60, 16)), 20, axis=0) + 1e-9 * rng.normal(size=(1200, 16)))
    q = np.concatenate([v[::50], np.zeros((2, 16)), unit(rng.normal(size=(9, 16)))])
    ids = rng.permutation(1200)
    for k, step in ((5, 100), (30, 7), (2000, 400)):
        best, want = Nearest(len(q), k), Nearest(len(q), k)
        for at in range(0, 1200, step):
            best.near(q, v[at : at + step], ids[at : at + step])
            want.add(q @ v[at : at + step].T, ids[at : at + step])
        assert best.query.tolist() == want.query.tolist() and best.ids.tolist() == want.ids.tolist() and np.allclose(best.scores, want.scores, atol=1e-12)


def test_blocks_of_queries_have_a_bound_of_floats(spark, monkeypatch):
    """Blocks had a number of rows only, whatever their vectors' length, and a task's steps were the block."""
    from tidemark.operators import retrieval, smallworld

    e = spark.range(120).selectExpr("id AS vec_id", "array(sin(id), cos(id), 1 + id / 7) AS embedding")
    asked = e.selectExpr("vec_id AS query_id", "embedding AS q")
    index = smallworld.build(e, 2, width=32)
    got = lambda: [sorted((r["query_id"], r["vec_id"], r["rank"]) for r in df.collect()) for df in (retrieval.batch_topk(e, asked, 4), smallworld.search(index, asked, 4, beam=500), smallworld.search(index, asked, 4, beam=12))]
    whole, sizes = got(), []
    assert whole[0] == whole[1]
    monkeypatch.setattr(retrieval, "BLOCK_FLOATS", 3 * 50)
    for module in (retrieval, smallworld):
        monkeypatch.setattr(module, "QUERY_STEP", 16)
    monkeypatch.setattr(smallworld, "MOVED", 20)
    assert got() == whole
    retrieval.in_blocks(asked, lambda held: sizes.append(len(held)) or spark.range(len(held)))
    assert sizes == [50, 50, 20]


def test_page_files_are_written_by_tasks(spark, tmp_path, monkeypatch):
    """Each page was a folder and a file of Spark's writer, some 30 milliseconds a page; now folders have many files."""
    import os

    from tidemark.sources import pages

    page = ("T", "howto", "sum", ["a"], ["z", "b"], [], "f", "c", "u")
    rows = spark.range(3000).selectExpr("concat('p', id) AS slug").rdd.map(lambda r: (r[0], 1, *page, f"Body\r\n {r[0]} \u00e9\n")).toDF(pages.PAGE)
    root = tmp_path / "p"
    (root / "pages-old").mkdir(parents=True)
    (root / "pages-old" / "old.md").write_text("old")
    pages.write_pages(rows.limit(1), f"file://{root}")  # workers are up
    assert [r["slug"] for r in pages.read_pages(spark, f"file://{root}").collect()] == ["p0"]  # what was there is gone
    pages.write_pages(rows, f"file://{root}")
    back = sorted(tuple(r) for r in pages.read_pages(spark, f"file://{root}").collect())
    assert back == sorted((f"p{k}", 1, *page[:4], ["b", "z"], *page[5:], f"Body\r\n p{k} \u00e9\n") for k in range(3000))
    folders = os.listdir(root)
    assert len(folders) >= 3 and all(pages.FOLDER.fullmatch(n) and len(os.listdir(root / n)) <= pages.FOLDER_FILES for n in folders)
    (root / ".pages-lost").mkdir()  # of an attempt that did not end
    (root / ".pages-lost" / "p0.md").write_text("half")
    monkeypatch.setattr(pages, "_read_folders", lambda s, r, n, own=pages._read_folders: own(s, r, n[:1]))
    assert 0 < pages.read_pages(spark, str(root)).count() <= pages.FOLDER_FILES


def test_pages_of_odd_slugs(spark, tmp_path, monkeypatch):
    """Two pages of a slug were one file when one task wrote them; slugs that are no file names are written aside, never read."""
    import os

    from tidemark.sources import pages

    page = (1, "T", "howto", "sum", ["a"], [], [], "f", "c", "u")
    given = [("a", *page, "1"), ("a", *page, "2"), ("a", *page, "3"), ("b", *page, "4"), ("../c", *page, "5"), ("A b", *page, "6"), (None, *page, "7"), ("x" * 65, *page, "8")]
    monkeypatch.setattr(pages, "FOLDER_FILES", 2)
    pages.write_pages(spark.createDataFrame(given, pages.PAGE).coalesce(1), str(tmp_path / "p"))
    assert os.listdir(tmp_path) == ["p"]
    got = lambda: sorted((r["slug"], r["body"]) for r in pages.read_pages(spark, str(tmp_path / "p")).collect())
    assert got() == [("a", "1"), ("a", "2"), ("a", "3"), ("b", "4")]
    monkeypatch.setattr(pages, "_mounted", lambda *a: None)  # as in a store that is not mounted
    assert got() == [("a", "1"), ("a", "2"), ("a", "3"), ("b", "4")]
    pages.write_pages(spark.createDataFrame(given[3:], pages.PAGE), str(tmp_path / "p"))
    assert got() == [("b", "4")]
    pages.write_pages(spark.createDataFrame(given[:0], pages.PAGE), str(tmp_path / "p"))
    assert got() == []
