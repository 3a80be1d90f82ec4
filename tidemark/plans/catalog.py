"""The engine's queries over the test tables and the same as SQL for DuckDB, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import segments as seg
from ..functions import text as tx
from ..functions import vectors as vec
from ..operators import ann, answers, compilation, compiled, context, demand, evaluation, fulltext, graph, indexed, phrases, postings, retrieval, rows, smallworld, store, units
from ..sources import pages, sessions
from ..sources.shared import materialise, shared_path
from ..streaming import ingest
from . import views
from .views import CHUNKS, DEMAND, PAGES, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

AS_OF = "timestamp_ntz'2024-02-01 00:00:00'"
STAMP = "TIMESTAMP '2024-02-01 00:00:00'"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
COS = f"({DOT.format(a='{a}', b='{b}')} / (sqrt({DOT.format(a='{a}', b='{a}')}) * sqrt({DOT.format(a='{b}', b='{b}')})))"
SPACES = r"'\s+', ' ', 'g'"
NORMAL = rf"lower(trim(regexp_replace({{c}}, {SPACES})))"


_COLLAPSED = f"trim(regexp_replace({{c}}, {SPACES}))"
_FIRST = rf"(CASE WHEN regexp_extract({_COLLAPSED}, '^(.*?[.!?])(\s|$)', 1) <> '' THEN regexp_extract({_COLLAPSED}, '^(.*?[.!?])(\s|$)', 1) ELSE {_COLLAPSED} END)"
#: The first sentence, cut at 200 characters with a mark.
_SENTENCE = f"(CASE WHEN length({_FIRST}) > 200 THEN rtrim(left({_FIRST}, 200)) || '…' ELSE {_FIRST} END)"


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def as_of():
    return F.expr(AS_OF)


# ---------------------------------------------------------------- retrieval


def _vector(spark: SparkSession, sf_dir: str, vec_id: int = 7) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q"))


@query(f"SELECT e.vec_id, round({COS.format(a='e.embedding', b='q.embedding')}, 9) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY {COS.format(a='e.embedding', b='q.embedding')} DESC, e.vec_id LIMIT 5")
def vector_topk(spark, sf_dir):
    found = retrieval.vector_topk(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 5)
    return found.select("vec_id", F.round("similarity", 9).alias("similarity"))


_BATCH = f"""s AS (SELECT q.vec_id AS query_id, e.vec_id, {COS.format(a='e.embedding', b='q.embedding')} AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, vec_id) AS rank FROM s)"""


def _batch(spark, sf_dir, k=10):
    e = table(spark, sf_dir, "embeddings")
    return retrieval.batch_topk(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), k)


@query(f"WITH {_BATCH} SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 10")
def batch_vector_topk(spark, sf_dir):
    return _batch(spark, sf_dir).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def _graph(spark, vectors, keep=None, **options):
    """A graph index, written and read again."""
    path = shared_path(spark, "graph")
    smallworld.build(vectors, keep=keep, **options).write.parquet(path)
    return spark.read.parquet(path)


def _asked(e, every=20):
    return e.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query(f"WITH {_BATCH} SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 10")
def graph_whole_shards(spark, sf_dir):
    """The graph index with beams as wide as its shards, which is exact."""
    e = table(spark, sf_dir, "embeddings")
    found = smallworld.search(_graph(spark, e, shards=4, width=32), _asked(e), 10, beam=1 << 30)
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_BATCH.replace('q.vec_id % 20 = 0', 'q.vec_id % 20 = 0 AND e.label % 3 = 1')} SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 10")
def graph_filtered(spark, sf_dir):
    """Nearest rows of some labels by the graph index: a selective filter is exact at any beam."""
    e = table(spark, sf_dir, "embeddings")
    found = smallworld.search(_graph(spark, e, ["label"], shards=2, width=32), _asked(e), 10, 32, lambda r: r["label"] % 3 == 1)
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def _clustered(spark, sf_dir):
    """A vector per order: its customer's direction and some of its own."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 500).alias("a"), (F.col("o_orderkey") % 499).alias("b"))
    both = o.join(e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va")), "a").join(e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb")), "b")
    return both.select(F.col("o_orderkey").alias("vec_id"), F.zip_with("va", "vb", lambda x, y: (x + F.lit(0.4) * y).cast("float")).alias("embedding"))


@query("SELECT count(*) AS queries, true AS found, CASE WHEN (SELECT count(*) FROM orders) >= 2000 THEN true END AS cheap FROM orders WHERE o_orderkey % 20 = 0")
def graph_recall(spark, sf_dir):
    """On clustered vectors the graph index finds nine tenths of the ten nearest rows, and from 2,000 rows on at a tenth of the
    distances: what a search computes grows with the logarithm of a shard. Orders of like vectors are one node and one query."""
    v = materialise(_clustered(spark, sf_dir), "clustered")
    once = materialise(retrieval.once(v, 10), "once")
    asked = materialise(_asked(v).groupBy("q").agg(F.min("query_id").alias("query_id"), F.count(F.lit(1)).alias("alike")), "asked")
    n, tasks = v.count(), max(spark.sparkContext.defaultParallelism, once.count() // 100_000)
    exact = retrieval.spread(retrieval.batch_topk(once.repartition(tasks), asked, 10), once, 10)
    got = smallworld.measure(_graph(spark, once, width=40), exact, asked, 10, n, beam=12, unique=once)
    return got.select("queries", (F.col("recall") >= 0.9).alias("found"), F.when(F.lit(n >= 2000), F.col("share") <= 0.1).alias("cheap"))


_WORDS = "regexp_split_to_array(lower({c}), '[^a-z0-9]+')"
def _index(spark, sf_dir, lists):
    e, path = table(spark, sf_dir, "embeddings"), shared_path(spark, "lists")
    ann.write(e, path, ann.fit(e, lists))
    return e, path, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query()
def ann_topk(spark, sf_dir):
    """The ten nearest rows from the inverted lists, with the fewest probes that reach a recall of 0.95 on measured queries."""
    e, path, queries = _index(spark, sf_dir, 16)
    found = ann.search(spark, path, queries, 10, ann.probes_for(e, ann.read_centres(spark, path), queries, 10, 0.95))
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_BATCH} SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 10")
def ann_all_lists(spark, sf_dir):
    """With every list probed the index gives the exact result: it holds every row."""
    _, path, queries = _index(spark, sf_dir, 16)
    found = ann.search(spark, path, queries, 10, 16)
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


# Full text as SQL: tokens with positions, stems of the queries' terms by their forms, covers of two groups of terms.
_TOKENS = """tok AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (SELECT id, regexp_extract_all(lower(content), '[a-z0-9]+') AS ws FROM chunks)),
stems AS (SELECT id, p, CASE WHEN regexp_full_match(w, 'thti(ed|es|ing|edly|ingly)?') THEN 'thti' WHEN regexp_full_match(w, 'ha(ed|ing|edly|ingly)?') THEN 'ha' WHEN regexp_full_match(w, 'ea(ed|ing|edly|ingly)?') THEN 'ea'
  WHEN regexp_full_match(w, 'er(ed|es|ing|edly|ingly)?') THEN 'er' WHEN regexp_full_match(w, 'ly(ed|ing|edly|ingly)?') THEN 'ly' END AS s FROM tok)"""
_COVERS = """ev AS (SELECT id, p, max(CASE WHEN s = 'thti' THEN p END) OVER run AS l0, max(CASE WHEN s IN ({group}) THEN p END) OVER run AS l1 FROM stems WHERE s = 'thti' OR s IN ({group}) WINDOW run AS (PARTITION BY id ORDER BY p ROWS UNBOUNDED PRECEDING)),
cover AS (SELECT id, least(l0, l1) AS b, min(p) AS e FROM ev WHERE l0 IS NOT NULL AND l1 IS NOT NULL GROUP BY ALL),
dense AS (SELECT id, sum(1.0::DOUBLE / greatest(1, e - b)) / (sum(1.0::DOUBLE / greatest(1, e - b)) + 1) AS keyword_score FROM cover GROUP BY id)"""
_SCORED = f"""q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7),
live AS (SELECT c.*, e.embedding FROM chunks c JOIN embeddings e ON e.vec_id = c.doc_id WHERE invalid_at IS NULL),
{_TOKENS}, {_COVERS.format(group="'ha'")},
scored AS (SELECT id, tier, ts, repo, session_id, {COS.format(a='embedding', b='q.q')} AS similarity, coalesce(keyword_score, 0.0) AS keyword_score FROM live LEFT JOIN dense USING (id), q),
cand AS (SELECT * FROM (SELECT * FROM scored ORDER BY similarity DESC NULLS LAST, id LIMIT 100) UNION SELECT * FROM (SELECT * FROM scored WHERE keyword_score > 0 ORDER BY round(keyword_score, 12) DESC, id LIMIT 50)),
comb AS (SELECT *, (0.7 * similarity + 0.3 * keyword_score + 0.1 * CASE WHEN ts IS NULL THEN 0.0 ELSE least(1.0, exp(-ln(2) * (epoch_us({STAMP}) - epoch_us(ts)) / 86400000000.0 / 30.0)) END
  + 0.05 * CASE tier WHEN 'wiki' THEN 1.0 WHEN 'dream' THEN 0.85 ELSE 0.6 END) * coalesce(exp(-(epoch_us({STAMP}) - epoch_us(ts)) / 86400000000.0 / 365.0), 1.0) AS combined FROM cand)"""
_FOUND = f"""WITH {CHUNKS}, {_TOKENS}, {_COVERS.format(group="'er', 'ha', 'ea'")},
near AS (SELECT DISTINCT a.id FROM stems a JOIN stems b ON a.id = b.id AND b.p = a.p + 1 WHERE a.s = 'er' AND b.s = 'ha'),
hit AS (SELECT id FROM stems GROUP BY id HAVING bool_or(s = 'thti') AND (bool_or(s = 'ea') OR id IN (SELECT id FROM near)) AND NOT coalesce(bool_or(s = 'ly'), false))
SELECT id, round(keyword_score, 9) AS keyword_score FROM dense SEMI JOIN hit USING (id) ORDER BY round(dense.keyword_score, 12) DESC, id LIMIT 50"""


def _hybrid(spark, sf_dir, limit=12):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    s = retrieval.Scoring(recency=0.1, tier=0.05, half_life_days=30.0, decay_days=365.0)
    return retrieval.hybrid_search(views.chunks(spark, sf_dir), _vector(spark, sf_dir), "the thties haing", retrieval.Filters(limit=limit), s, as_of(), vectors=vectors, key="doc_id")


@query(f"WITH {CHUNKS}, {_SCORED} SELECT id, tier, round(similarity, 8) AS similarity, round(keyword_score, 8) AS keyword_score, round(combined, 8) AS combined FROM comb ORDER BY comb.combined DESC NULLS LAST, id LIMIT 12")
def hybrid_search(spark, sf_dir):
    found = _hybrid(spark, sf_dir)
    return found.select("id", "tier", *[F.round(c, 8).alias(c) for c in ("similarity", "keyword_score", "combined")])


@query(ORACLE_SQL["hybrid_search"])
def indexed_hybrid(spark, sf_dir):
    """The same from stored indexes: blocks of postings, the graph, and single rows by id."""
    chunks, root = views.chunks(spark, sf_dir), shared_path(spark, "indexed")
    texts = postings.TextIndex(spark, f"{root}/texts", buckets=8)
    texts.upsert(chunks.select("id", "content"))
    both = chunks.drop("content").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    postings.ordered_by_id(both, f"{root}/rows", 4)
    rows_ = spark.read.parquet(f"{root}/rows")
    smallworld.build(rows_, 4, indexed.KEPT, "doc_id", width=32).write.parquet(f"{root}/graph")
    s = retrieval.Scoring(recency=0.1, tier=0.05, half_life_days=30.0, decay_days=365.0)
    found = indexed.hybrid_search(rows_, texts, spark.read.parquet(f"{root}/graph"), _vector(spark, sf_dir), "the thties haing", retrieval.Filters(limit=12), s, as_of(), beam=1 << 30)
    return found.select("id", "tier", *[F.round(c, 8).alias(c) for c in ("similarity", "keyword_score", "combined")])


@query(_FOUND.replace("WITH {CHUNKS}", "WITH").replace("FROM documents)", "FROM documents WHERE doc_id % 13 <> 5)", 1))
def changed_index(spark, sf_dir):
    """An index that followed inserts, changes and removals, with its segments merged on the way, finds what one of the last
    state would: every chunk came with another text first, or was written again; every thirteenth is gone."""
    c, texts = views.chunks(spark, sf_dir).select("id", "content", "doc_id"), postings.TextIndex(spark, shared_path(spark, "texts"), buckets=8, range_rows=128)
    texts.upsert(c.withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("thties haing "), "content")).otherwise(F.col("content"))))
    for k in range(3):
        texts.upsert(c.where((F.col("doc_id") % 9 == 3 * k) | (F.col("doc_id") % 7 == k)))
    texts.remove(c.where(F.col("doc_id") % 13 == 5))
    return texts.search('thties "ering haing" or eaed -lying', 50).select("id", F.round("keyword_score", 9).alias("keyword_score"))


@query(f"WITH {CHUNKS}, {_SCORED} SELECT session_id, round(max(similarity), 8) AS similarity FROM scored GROUP BY session_id")
def session_max_similarity(spark, sf_dir):
    chunks = retrieval.live(views.chunks(spark, sf_dir), retrieval.Filters()).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    hits = chunks.join(F.broadcast(_vector(spark, sf_dir))).select("session_id", vec.cosine(F.col("embedding"), F.col("q")).alias("similarity"))
    return retrieval.max_similarity(hits).select("session_id", F.round("similarity", 8).alias("similarity"))


@query(f"WITH {_BATCH}, f AS (SELECT query_id, label, min(rank) AS first_rank FROM r JOIN embeddings USING (vec_id) WHERE rank <= 10 GROUP BY ALL) SELECT query_id, label, first_rank, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS position FROM f")
def first_appearance(spark, sf_dir):
    ranked = _batch(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return retrieval.first_appearance(ranked, "label").select("query_id", "label", F.col("first_rank").cast("long").alias("first_rank"), F.col("position").cast("long").alias("position"))


@query(f"""WITH {_BATCH}, p AS (SELECT query_id, vec_id, rank - 1 AS rank FROM r WHERE rank <= 10), o AS (SELECT * FROM (VALUES (0, 4), (1, 1), (2, 7), (3, 4), (4, 99)) t(place, idx)),
u AS (SELECT idx, min(place) AS place FROM o GROUP BY idx) SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY place NULLS LAST, rank) - 1 AS position FROM p LEFT JOIN u ON idx = rank""")
def rerank_merge(spark, sf_dir):
    pool = _batch(spark, sf_dir).select("query_id", "vec_id", (F.col("rank") - 1).alias("rank"))
    order = spark.createDataFrame([(0, 4), (1, 1), (2, 7), (3, 4), (4, 99)], "place int, idx int")
    return retrieval.rerank_merge(pool, order).select("query_id", "vec_id", F.col("position").cast("long").alias("position"))


@query(f"WITH {CHUNKS} SELECT id, round(CASE WHEN ts IS NULL THEN 0.0 ELSE least(1.0, exp(-ln(2) * (epoch_us({STAMP}) - epoch_us(ts)) / 86400000000.0 / 30.0)) END, 9) AS recency, round(coalesce(exp(-(epoch_us({STAMP}) - epoch_us(ts)) / 86400000000.0 / 30.0), 1.0), 9) AS decay, CASE tier WHEN 'wiki' THEN 1.0::DOUBLE WHEN 'dream' THEN 0.85::DOUBLE ELSE 0.6::DOUBLE END AS prior FROM chunks")
def scoring_priors(spark, sf_dir):
    c = views.chunks(spark, sf_dir)
    return c.select("id", F.round(retrieval.recency(F.col("ts"), as_of(), 30.0), 9).alias("recency"), F.round(retrieval.time_decay(F.col("ts"), as_of(), 30.0), 9).alias("decay"), retrieval.tier_prior(F.col("tier"), retrieval.TIER_PRIORS).alias("prior"))


@query(f"WITH {CHUNKS} SELECT id, tier, repo FROM chunks WHERE invalid_at IS NULL AND repo = 'en' AND branch = 'main' AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND owner = 'owner1' AND tier IN ('wiki', 'dream')")
def search_filters(spark, sf_dir):
    f = retrieval.Filters(repo="en", branch="main", since="2024-01-10 00:00:00", tier="synth", owner="owner1")
    return retrieval.live(views.chunks(spark, sf_dir), f).select("id", "tier", "repo")


_SET = "list_distinct(list_filter(" + _WORDS.format(c="text") + ", lambda w: length(w) > 3))"


@query(f"WITH s AS (SELECT conv_id, turn, {_SET} AS w FROM conversations) SELECT a.conv_id, a.turn AS a, b.turn AS b, round(len(list_intersect(a.w, b.w)) / greatest(1, least(len(a.w), len(b.w))), 9) AS overlap FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE len(list_intersect(a.w, b.w)) / greatest(1, least(len(a.w), len(b.w))) > 0.2")
def overlap_pairs(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", retrieval.word_set(F.col("text")).alias("w"))
    a, b = s.select("conv_id", F.col("turn").alias("a"), F.col("w").alias("wa")), s.select("conv_id", F.col("turn").alias("b"), F.col("w").alias("wb"))
    pairs = a.join(b, "conv_id").where("a < b").withColumn("overlap", retrieval.overlap_coefficient(F.col("wa"), F.col("wb")))
    return pairs.where("overlap > 0.2").select("conv_id", "a", "b", F.round("overlap", 9).alias("overlap"))


@query()
def collapse_similar(spark, sf_dir):
    """Greedy collapse of each conversation taken as a result page."""
    page = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.when(F.col("role") == "system", "wiki").otherwise("raw").alias("tier"), F.col("text").alias("content"))
    return retrieval.collapse_similar(page)


@query(f"""WITH {PAGES}, {_BATCH.replace('q.vec_id % 20 = 0', 'q.vec_id % 20 = 0 AND e.vec_id IN (SELECT page_id FROM pages)')},
i AS (SELECT doc_id AS item_id, text FROM documents WHERE doc_id % 20 = 0),
h AS (SELECT query_id AS item_id, 'p' || vec_id AS slug, rank FROM r JOIN i ON item_id = query_id WHERE rank <= 5),
n AS (SELECT slug, lower(trim(title)) AS phrase FROM wiki UNION SELECT slug, lower(trim(alias)) FROM wiki),
t AS (SELECT item_id, slug, 1000000 AS rank FROM i JOIN n ON length(phrase) >= 3 AND contains(lower(text), phrase)),
u AS (SELECT item_id, slug, min(rank) AS rank FROM (SELECT * FROM h UNION ALL SELECT * FROM t) GROUP BY ALL) SELECT item_id, slug, row_number() OVER (PARTITION BY item_id ORDER BY rank, slug) AS place FROM u QUALIFY place <= 8""")
def candidate_pages(spark, sf_dir):
    """Pages for items: the nearest ones by vector (page n has vector n), then those whose title or alias an item holds."""
    items = table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("item_id"), "text")
    pages = views.wiki(spark, sf_dir).select("slug", "title", F.array("alias").alias("aliases"), "ordinal")
    e = table(spark, sf_dir, "embeddings")
    near = retrieval.batch_topk(e.join(pages.select(F.col("ordinal").alias("vec_id")), "vec_id", "left_semi"), _asked(e), 5)
    hits = near.select(F.col("query_id").alias("item_id"), F.concat(F.lit("p"), "vec_id").alias("slug"), "rank").join(items.select("item_id"), "item_id", "left_semi")
    return phrases.candidate_pages(items, pages, hits).select("item_id", "slug", F.col("place").cast("long").alias("place"))


@query(r"""WITH t AS (SELECT doc_id, 'p' || doc_id AS slug, lower(regexp_extract(text, '([A-Za-z]{9,})', 1)) AS title FROM documents WHERE regexp_extract(text, '([A-Za-z]{9,})', 1) <> ''),
d AS (SELECT title, min(slug) AS slug FROM t GROUP BY title HAVING count(*) = 1), p AS (SELECT page_id, html FROM pages),
w AS (SELECT page_id, unnest(list_distinct(list_filter(regexp_split_to_array(translate(html, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^A-Za-z0-9_]+'), lambda x: length(x) >= 9))) AS word FROM p)
SELECT page_id, count(slug) AS links, coalesce(sha256(string_agg(slug, ',' ORDER BY slug)), '') AS slugs FROM p LEFT JOIN (SELECT page_id, slug FROM w JOIN d ON d.title = w.word) USING (page_id) GROUP BY page_id""")
def autolink_pages(spark, sf_dir):
    """Links from pages to documents, each named by its first long word; a word of two documents names none. Titles are single
    words here and the pages have no Markdown, so SQL can tell them; the tests compare phrases, guards and overlaps."""
    first = F.lower(F.regexp_extract("text", "([A-Za-z]{9,})", 1))
    targets = table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), "doc_id").alias("slug"), first.alias("title"), F.array().cast("array<string>").alias("aliases"), F.col("doc_id").alias("ordinal")).where("title <> ''")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), "page_id").alias("slug"), "page_id", F.translate("html", "`~[]", "    ").alias("body"))
    got = phrases.autolink_pages(pages, targets)
    return got.select("page_id", F.size("added").cast("long").alias("links"), F.when(F.size("added") == 0, "").otherwise(F.sha2(F.array_join(F.array_sort("added"), ","), 256)).alias("slugs"))


@query(f"""WITH {_BATCH}, c AS (SELECT vec_id AS id, vec_id AS pos FROM embeddings), k AS (SELECT query_id, vec_id AS id, rank FROM r WHERE rank <= 10),
f AS (SELECT q.query_id, c.id, row_number() OVER (PARTITION BY q.query_id ORDER BY k.rank NULLS LAST, c.pos) AS position FROM c CROSS JOIN (SELECT DISTINCT query_id FROM k) q LEFT JOIN k ON k.query_id = q.query_id AND k.id = c.id)
SELECT f.query_id, f.id, f.position FROM f JOIN embeddings a ON a.vec_id = f.query_id JOIN embeddings b ON b.vec_id = f.id WHERE a.label = b.label""")
def relevant_positions(spark, sf_dir):
    """Positions of the rows of each query's label in the full ranking, by counting."""
    e = table(spark, sf_dir, "embeddings")
    corpus = e.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), "label")
    ranking = _batch(spark, sf_dir).select("query_id", F.col("vec_id").alias("id"), "rank")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return retrieval.full_ranking(corpus, ranking, queries=queries, by="label")


@query(f"WITH {_BATCH}, c AS (SELECT vec_id AS id, vec_id AS pos FROM embeddings), k AS (SELECT query_id, vec_id AS id, rank FROM r WHERE rank <= 10) SELECT q.query_id, c.id, row_number() OVER (PARTITION BY q.query_id ORDER BY k.rank NULLS LAST, c.pos) AS position FROM c CROSS JOIN (SELECT DISTINCT query_id FROM k) q LEFT JOIN k ON k.query_id = q.query_id AND k.id = c.id")
def full_ranking(spark, sf_dir):
    ranking = _batch(spark, sf_dir).select("query_id", F.col("vec_id").alias("id"), "rank")
    corpus = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"))
    return retrieval.full_ranking(corpus, ranking)


_TEXT_QUERY = 'the thtied "ering haed" or eaing -lying'


@query(_FOUND)
def keyword_search(spark, sf_dir):
    """Full-text search with stems, stop words, boolean syntax, a phrase and cover density, over the texts."""
    c = views.chunks(spark, sf_dir)
    found = fulltext.best_first(c.select("id", fulltext.rank(F.col("content"), _TEXT_QUERY).alias("keyword_score")), 50)
    return found.withColumn("keyword_score", F.round("keyword_score", 9))


@query(_FOUND)
def indexed_search(spark, sf_dir):
    """The same from stored postings."""
    path = shared_path(spark, "postings")
    fulltext.write_index(fulltext.postings(views.chunks(spark, sf_dir)), path, buckets=16, splits=2)
    found = fulltext.search(fulltext.read_index(spark, path, _TEXT_QUERY, buckets=16), _TEXT_QUERY)
    return found.withColumn("keyword_score", F.round("keyword_score", 9))


@query(f"""WITH {CHUNKS}, {_TOKENS}, {_COVERS.format(group="'ha'")}
SELECT trajectory_id, sha256(content) AS sha, round(keyword_score, 9) AS keyword_score FROM dense JOIN chunks USING (id) WHERE owner = 'owner1' AND tier = 'raw' AND invalid_at IS NULL ORDER BY round(dense.keyword_score, 12) DESC, trajectory_id, id LIMIT 20""")
def tier_keyword_search(spark, sf_dir):
    found = retrieval.keyword_search(views.chunks(spark, sf_dir), "thties haing", "owner1", "raw", 20)
    return found.select("trajectory_id", F.sha2("content", 256).alias("sha"), F.round("keyword_score", 9).alias("keyword_score"))


@query(f"WITH {CHUNKS} SELECT id, coalesce(repo, '') AS repo, coalesce(nullif(branch, ''), '') AS branch, coalesce(session_id, '') AS session_id, tier FROM chunks")
def read_rows(spark, sf_dir):
    c = views.chunks(spark, sf_dir).withColumn("branch", F.nullif(F.col("branch"), F.lit("")))
    return retrieval.read_rows(c).select("id", "repo", "branch", "session_id", "tier")


@query("WITH n AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '-home-' || source || '-' || lang ELSE source || '-' || lang END AS name FROM documents), d AS (SELECT doc_id, CASE WHEN starts_with(name, '-') THEN '/' || replace(substr(name, 2), '-', '/') ELSE name END AS path FROM n) SELECT doc_id, path, list_last(string_split(path, '/')) AS repo FROM d")
def project_dirs(spark, sf_dir):
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("-home-")).otherwise(""), "source", F.lit("-"), "lang")
    path = table(spark, sf_dir, "documents").select("doc_id", tx.project_dir(name).alias("path"))
    return path.withColumn("repo", tx.repo_of(F.col("path")))


@query("WITH t AS (SELECT doc_id, " + _WORDS.format(c="text") + " AS w FROM documents) SELECT CAST(doc_id AS VARCHAR) AS id FROM t WHERE list_contains(w, 'thst') AND NOT list_contains(w, 'thnt')")
def boolean_match(spark, sf_dir):
    """The boolean part of full-text search, free of ranks; the terms are their own stems."""
    return fulltext.search(fulltext.postings(views.chunks(spark, sf_dir).select("id", "content")), "thst -thnt", limit=None).select("id")


# ---------------------------------------------------------------- sessions and window-like rows

_TRAJ = """t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS trajectory FROM conversations WHERE role IN ('user', 'assistant'))"""


@query(f"WITH {_TRAJ} SELECT conv_id, CAST(trajectory AS BIGINT) AS trajectory, count(*) AS n_messages, min(turn) AS first, sha256(arg_min(text, turn)) AS opening FROM t WHERE trajectory > 0 GROUP BY ALL")
def sessionize_trajectories(spark, sf_dir):
    t = rows.trajectories(table(spark, sf_dir, "conversations"))
    return t.select("conv_id", F.col("trajectory").cast("long").alias("trajectory"), "n_messages", "first", F.sha2("user_message", 256).alias("opening"))


@query(f"WITH {_TRAJ} SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, trajectory ORDER BY turn) - 1 AS chunk_index, count(*) OVER (PARTITION BY conv_id, trajectory) AS chunk_count FROM t WHERE trajectory > 0")
def trajectory_chunk_index(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")  # no text is written or shuffled
    t = rows.index_within(rows.sessionize(messages), ["conv_id", "trajectory"], ["turn"])
    return t.select("conv_id", "turn", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_count")


@query("SELECT u.conv_id, u.turn, r.turn AS result_turn FROM (SELECT conv_id, turn FROM conversations WHERE role = 'user') u LEFT JOIN (SELECT conv_id, turn FROM conversations WHERE role = 'assistant') r ON r.conv_id = u.conv_id AND r.turn = u.turn + 1")
def tool_result_join(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    uses = c.where("role = 'user'").select("conv_id", "turn", (F.col("turn") + 1).alias("call"))
    results = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("call"), F.col("turn").alias("result_turn"))
    return rows.join_tool_results(uses, results, ["conv_id", "call"]).select("conv_id", "turn", "result_turn")


@query(f"WITH {DEMAND} SELECT id, kind FROM demand QUALIFY row_number() OVER (PARTITION BY kind ORDER BY ts DESC, id DESC) <= 120")
def newest_per_kind(spark, sf_dir):
    return rows.newest(views.demand(spark, sf_dir), 120, ["kind"]).select("id", "kind")


@query(f"WITH {DEMAND} SELECT id FROM demand ORDER BY ts DESC, id DESC LIMIT 200")
def newest_overall(spark, sf_dir):
    return rows.newest(views.demand(spark, sf_dir), 200).select("id")


@query(f"WITH {DEMAND}, l AS (SELECT *, lead(query) OVER (PARTITION BY kind ORDER BY ts, id) AS nxt FROM demand) SELECT id, query FROM l WHERE NOT coalesce(nxt = query OR (kind = 'search' AND starts_with(nxt, query)), false)")
def collapse_typing(spark, sf_dir):
    return rows.collapse_typing(views.demand(spark, sf_dir), ["kind"], "query", prefixes=F.col("kind") == "search").select("id", "query")


@query(f"WITH {DEMAND}, o AS (SELECT * FROM demand QUALIFY row_number() OVER (PARTITION BY kind, query ORDER BY ts DESC, id DESC) = 1) SELECT id, kind, query FROM o QUALIFY row_number() OVER (PARTITION BY kind ORDER BY ts DESC, id DESC) <= 8")
def recently_used(spark, sf_dir):
    return rows.recently_used(views.demand(spark, sf_dir), "kind", "query").select("id", "kind", "query")


@query(f"WITH {DEMAND} SELECT query, min(id) AS id FROM (SELECT query, id FROM demand QUALIFY row_number() OVER (PARTITION BY query ORDER BY ts, id) = 1) GROUP BY query")
def first_occurrence(spark, sf_dir):
    return rows.first_of(views.demand(spark, sf_dir), ["query"], ["ts", "id"]).select("query", "id")


@query(f"WITH {CHUNKS}, u AS (SELECT id, session_id, CAST(ceil(length(content) / 4.0) AS BIGINT) AS cost, sum(CAST(ceil(length(content) / 4.0) AS BIGINT)) OVER w AS used, row_number() OVER w AS place FROM chunks WINDOW w AS (PARTITION BY session_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) SELECT id, session_id, CAST(used AS BIGINT) AS used FROM u WHERE used <= 6000 OR place = 1")
def budget_fill(spark, sf_dir):
    c = views.chunks(spark, sf_dir).withColumn("cost", tx.estimate_tokens(F.col("content")))
    return rows.running_fill(c, ["session_id"], ["doc_id"], "cost", 6000).select("id", "session_id", "used")


@query(f"""WITH RECURSIVE {CHUNKS}, c AS (SELECT session_id, doc_id, coalesce(length(content), 0) AS cost, row_number() OVER (PARTITION BY session_id ORDER BY doc_id) AS n FROM chunks),
f AS (SELECT session_id, doc_id, n, cost AS used, 1 AS k, 0 AS batch FROM c WHERE n = 1 UNION ALL SELECT c.session_id, c.doc_id, c.n, CASE WHEN f.k = 64 OR f.used + c.cost > 150000 THEN c.cost ELSE f.used + c.cost END,
  CASE WHEN f.k = 64 OR f.used + c.cost > 150000 THEN 1 ELSE f.k + 1 END, CASE WHEN f.k = 64 OR f.used + c.cost > 150000 THEN f.batch + 1 ELSE f.batch END FROM f JOIN c ON c.session_id = f.session_id AND c.n = f.n + 1) SELECT session_id, doc_id, batch FROM f""")
def batch_packing(spark, sf_dir):
    c = views.chunks(spark, sf_dir).withColumn("cost", F.length("content"))
    return rows.pack_batches(c, "session_id", "doc_id", "cost")


def _filled(items: str, budget: int, reserve: str, before: str = "") -> str:
    """The budget's three passes as a machine that takes one item a step. `items` has g, kind, n, cost; `reserve` speaks of
    the lists p and m of costs. The result f has g, p, m and the places of chosen pages (tp) and memories (tm)."""
    step = lambda k, where, fits, taken, over: f"WHEN k = {k} AND {where} THEN CASE WHEN {fits} THEN {taken} ELSE {over} END"
    next_pass = lambda k: f"WHEN k = {k} THEN {{{{'k': {k + 1}, 'i': 1, 'used': used, 'tp': tp, 'tm': tm}}}}"
    state = lambda i="i + 1", used="used", tp="tp", tm="tm", k="k": f"{{{{'k': {k}, 'i': {i}, 'used': {used}, 'tp': {tp}, 'tm': {tm}}}}}"
    page = state(used="used + p[i]", tp="list_append(tp, i)")
    arms = [
        step(1, "i <= len(p)", "used + p[i] <= CASE WHEN len(tp) = 0 THEN room ELSE CAST(floor(room * 0.4) AS BIGINT) END", page, f"CASE WHEN len(tp) = 0 THEN {state()} ELSE {state('1', k='2')} END"), next_pass(1),
        step(2, "i <= len(m)", "used + m[i] <= room", state(used="used + m[i]", tm="list_append(tm, i)"), state("1", k="3")), next_pass(2),
        f"WHEN k = 3 AND i <= len(p) AND list_contains(tp, i) THEN {state()}", step(3, "i <= len(p)", "used + p[i] <= room", page, state("1", k="4")), next_pass(3),
    ]
    moves = " ".join(arms).replace("{{", "{").replace("}}", "}")
    return f"""WITH RECURSIVE {before}, lists AS (
  SELECT g, coalesce(list(cost ORDER BY n) FILTER (kind = 'page' AND n <= 6), []) AS p, coalesce(list(cost ORDER BY n) FILTER (kind = 'memory' AND n <= 10), []) AS m FROM {items} GROUP BY g),
start AS (SELECT g, p, m, greatest(0, {budget} - ({reserve})) AS room FROM lists),
states AS (
  SELECT g, p, m, room, 1 AS k, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS tp, CAST([] AS BIGINT[]) AS tm FROM start
  UNION ALL
  SELECT g, p, m, room, s.k, CAST(s.i AS BIGINT), CAST(s.used AS BIGINT), s.tp, s.tm FROM (SELECT g, p, m, room, CASE {moves} END AS s FROM states WHERE k < 4)),
f AS (SELECT g, p, m, CASE WHEN len(tp) + len(tm) = 0 AND len(p) > 0 THEN [1] ELSE tp END AS tp, CASE WHEN len(tp) + len(tm) = 0 AND len(p) = 0 THEN [1] ELSE tm END AS tm FROM states WHERE k = 4)"""


_BUDGETED = f"""{CHUNKS}, i AS (SELECT session_id AS g, CASE WHEN tier = 'wiki' THEN 'page' ELSE 'memory' END AS kind, CAST(ceil(length(content) / 40.0) AS BIGINT) AS cost,
  row_number() OVER (PARTITION BY session_id, tier = 'wiki' ORDER BY doc_id) AS n FROM chunks)"""


@query(f"""{_filled("i", 100, "5 + CASE WHEN len(p) > 0 THEN 2 ELSE 0 END + CASE WHEN len(m) > 0 THEN 3 ELSE 0 END + len(p)", _BUDGETED)}
SELECT g AS "group", CAST(coalesce(list_sum(list_transform(tp, lambda x: p[x])), 0) + coalesce(list_sum(list_transform(tm, lambda x: m[x])), 0) AS BIGINT) AS used, len(tp) AS pages, len(tm) AS memories FROM f""")
def context_budget(spark, sf_dir):
    """Three-pass budget fill, one context per source."""
    place = F.row_number().over(Window.partitionBy("session_id", "kind").orderBy("doc_id"))
    items = views.chunks(spark, sf_dir).withColumn("kind", F.when(F.col("tier") == "wiki", "page").otherwise("memory")).withColumn("place", place).where("place <= 12")
    frame = lambda p, m: 5 + F.when(p > 0, 2).otherwise(0) + F.when(m > 0, 3).otherwise(0) + p
    return rows.pivot_budget_totals(rows.fold_budget(items.select(F.col("session_id").alias("group"), "kind", F.col("place"), F.ceil(F.length("content") / 40).cast("long").alias("cost")), 100, frame))


# ---------------------------------------------------------------- identity and text

_T = "coalesce(text, '')"


@query(rf"SELECT doc_id, sha256({NORMAL.format(c=_T)}) AS sha FROM documents")
def normalize_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.content_sha(tx.normalize(F.coalesce("text", F.lit("")))).alias("sha"))


@query(rf"SELECT doc_id, sha256('o' || chr(10) || CAST(doc_id AS VARCHAR) || chr(10) || text) AS trajectory, sha256(sha256('o' || chr(10) || CAST(doc_id AS VARCHAR) || chr(10) || text) || ':0:' || {NORMAL.format(c='text')}) AS chunk FROM documents")
def content_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("trajectory", tx.injected_id(F.lit("o"), F.col("doc_id").cast("string"), F.col("text")))
    return d.select("doc_id", "trajectory", tx.chunk_id(F.col("trajectory"), F.lit(0), F.col("text")).alias("chunk"))


_ONE = rf"trim(regexp_replace(text, {SPACES}))"


@query(rf"""SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS prose_tokens, CAST(ceil(length(text) / 3.0) AS BIGINT) AS tool_tokens,
CASE WHEN length({_ONE}) > 600 THEN left({_ONE}, 600) || '…' ELSE {_ONE} END AS snippet, 'USER: ' || CASE WHEN length({_ONE}) > 100 THEN left({_ONE}, 100) || '…' ELSE {_ONE} END AS prefix,
sha256(CASE WHEN length(text) <= 8000 THEN text ELSE left(text, 6000) || chr(10) || '…' || chr(10) || right(text, 2000) END) AS head_tail,
length(text) >= 40 AND NOT starts_with(text, '<') AND NOT starts_with(text, 'Caveat:') AS meaningful FROM documents""")
def text_shapes(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.estimate_tokens(t).alias("prose_tokens"), tx.estimate_tokens(t, tx.TOOL_CHARS).alias("tool_tokens"), tx.snippet(t).alias("snippet"), tx.intent_prefix(t).alias("prefix"), F.sha2(tx.head_tail(t), 256).alias("head_tail"),
        ((F.length(t) >= 40) & ~t.startswith("<") & ~t.startswith("Caveat:")).alias("meaningful"),
    )


@query(r"SELECT doc_id, len(t) AS n, sha256(array_to_string(list_sort(t), ' ')) AS terms FROM (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: length(t) >= 2)) AS t FROM documents)")
def query_terms(spark, sf_dir):
    t = tx.query_terms(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.sha2(F.array_join(F.array_sort(t), " "), 256).alias("terms"))


@query(r"SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) NOT IN ('localhost', '127.0.0.1', '0.0.0.0', '[::1]', 'api.openai.com') AS public FROM pages")
def url_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", tx.url_host(F.col("url")).alias("host"), tx.public_host(F.col("url")).alias("public"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, 'https?://[^\s"''<>)\]]+')) AS n_urls, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'https?://[^\s"''<>)\]]+'))), ' ') AS urls FROM pages""")
def extract_urls(spark, sf_dir):
    u = tx.urls(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(u).cast("long").alias("n_urls"), F.array_join(F.array_sort(F.array_distinct(u)), " ").alias("urls"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(left(regexp_replace(translate(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', '-', 'g').trim('-'), 64), '-+$', ''), '^$', '') AS slug FROM pages")
def page_slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.slugify(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("slug"))


@query(r"""WITH b AS (SELECT page_id, '[[' || CAST(page_id % 7 AS VARCHAR) || '-page]] and [[Page Two|label]] ~~~ [[hidden]] ~~~ [[' || sha256(url) || ']] x [' || CAST(page_id % 4 AS VARCHAR) || '] [2] [99]' AS body FROM pages)
SELECT page_id, CAST(page_id % 7 AS VARCHAR) || '-page page-two ' || regexp_extract(body, '[0-9a-f]{64}') AS links, regexp_replace(body, ' ?\[\[[0-9a-f]{40,64}\]\]', '', 'g') AS stripped,
array_to_string(list_filter(CASE WHEN page_id % 4 = 2 THEN ['2'] ELSE [CAST(page_id % 4 AS VARCHAR), '2'] END, lambda x: x <> '0'), ' ') AS cited FROM b""")
def link_text(spark, sf_dir):
    p = F.col("page_id")
    body = F.concat(F.lit("[["), (p % 7).cast("string"), F.lit("-page]] and [[Page Two|label]] ~~~ [[hidden]] ~~~ [["), F.sha2("url", 256), F.lit("]] x ["), (p % 4).cast("string"), F.lit("] [2] [99]"))
    b = table(spark, sf_dir, "pages").select("page_id", body.alias("body"))
    return b.select("page_id", F.array_join(tx.wikilinks(F.col("body")), " ").alias("links"), tx.strip_id_citations(F.col("body")).alias("stripped"), F.array_join(F.transform(tx.cited_indices(F.col("body"), F.lit(10)), lambda x: x.cast("string")), " ").alias("cited"))


@query(f"WITH {DEMAND} SELECT id, CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm' WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h' ELSE CAST(s // 86400 AS VARCHAR) || 'd' END AS age, outcome FROM (SELECT *, greatest(0, CAST(floor((epoch_us({STAMP}) - epoch_us(ts)) / 1000000.0) AS BIGINT)) AS s FROM demand)")
def age_labels(spark, sf_dir):
    return views.demand(spark, sf_dir).select("id", tx.age_label(F.col("ts"), as_of()).alias("age"), "outcome")


@query()
def chunk_documents(spark, sf_dir):
    """Token-aware chunks of every document with content-derived ids."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source", F.lit(None).cast("timestamp").alias("ts"))
    return sessions.inject(docs, "local").select("id", "trajectory_id", "chunk_index", "chunk_count", F.length("content").alias("chars"))


@query()
def page_chunks(spark, sf_dir):
    p = views.wiki(spark, sf_dir)
    return p.select("slug", F.posexplode(seg.page_chunks_of("title", "body")).alias("chunk_index", "chunk")).select("slug", "chunk_index", F.length("chunk").alias("chars"))


@query()
def split_claims(spark, sf_dir):
    answers = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", r"\. ", ". [1][2] ").alias("answer"))
    return answers.select("item_id", F.explode(seg.claims_of("answer", F.lit(2))).alias("c")).select("item_id", "c.claim", F.size("c.indices").alias("n"))


@query("SELECT event_id, props FROM (SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS props FROM events)")
def stable_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", seg.stable_json_of("props").alias("props"))


# ---------------------------------------------------------------- units and ledgers

_UNITS = "units AS (SELECT session_id, coalesce(repo, '') AS repo, string_agg(id, chr(10) ORDER BY id) AS ids, count(*) AS n, sum(length(content)) AS total_chars, max(ts) AS last_ts FROM chunks GROUP BY ALL)"
_LEDGER = "ledger AS (SELECT session_id, repo, sha256(string_agg(id, chr(10) ORDER BY id)) AS fingerprint FROM chunks WHERE doc_id % 97 <> 5 AND session_id <> 'src3' GROUP BY ALL)"


def _ledger(c: DataFrame) -> DataFrame:
    return units.aggregate_units(c.where("doc_id % 97 <> 5 AND session_id <> 'src3'")).select("session_id", "repo", "fingerprint")


@query(f"WITH {CHUNKS}, {_UNITS} SELECT session_id, repo, sha256(ids) AS fingerprint, n, CAST(total_chars AS BIGINT) AS total_chars, CAST(last_ts AS VARCHAR) AS last_ts FROM units WHERE last_ts >= TIMESTAMP '2024-01-05 00:00:00'")
def unit_fingerprint(spark, sf_dir):
    u = units.aggregate_units(views.chunks(spark, sf_dir), F.expr("timestamp_ntz'2024-01-05 00:00:00'"))
    return u.select("session_id", "repo", "fingerprint", F.size("chunk_ids").cast("long").alias("n"), "total_chars", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("last_ts"))


@query(f"WITH {CHUNKS}, {_UNITS}, {_LEDGER} SELECT u.session_id, u.repo, CASE WHEN l.fingerprint IS NULL THEN 'new' WHEN l.fingerprint = sha256(u.ids) THEN 'skipped' ELSE 'changed' END AS status FROM units u LEFT JOIN ledger l USING (session_id, repo)")
def fingerprint_short_circuit(spark, sf_dir):
    c = views.chunks(spark, sf_dir)
    return units.status(units.aggregate_units(c), _ledger(c), ["session_id", "repo"]).select("session_id", "repo", "status")


@query(f"WITH {CHUNKS}, {_UNITS}, {_LEDGER} SELECT u.session_id, u.repo, n AS chunks, CAST(ceil(least(total_chars, 24000) / 4.0) AS BIGINT) AS est_tokens FROM units u LEFT JOIN ledger l USING (session_id, repo) WHERE l.fingerprint IS DISTINCT FROM sha256(u.ids)")
def synthesis_plan(spark, sf_dir):
    c = views.chunks(spark, sf_dir)
    return units.plan(units.pending(units.aggregate_units(c), _ledger(c), ["session_id", "repo"])).select("session_id", "repo", "chunks", "est_tokens")


@query(f"WITH {CHUNKS}, {_UNITS} SELECT session_id, repo FROM units ORDER BY last_ts, session_id, repo LIMIT 10")
def oldest_units(spark, sf_dir):
    return units.fifo(units.aggregate_units(views.chunks(spark, sf_dir)), 10)[0].select("session_id", "repo")


@query()
def synthesize_units(spark, sf_dir):
    """Incremental synthesis with a scripted extractor: first line of each unit as a decision."""
    c = views.chunks(spark, sf_dir)
    return units.synthesize(c, _ledger(c), lambda t: [{"kind": "decision", "text": t.split("\n", 1)[0][:80]}], as_of())["items"].select("session_id", "repo", "kind", "text")


@query(f"WITH {CHUNKS} SELECT id FROM chunks WHERE doc_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM chunks n WHERE n.id = chunks.id AND n.doc_id % 3 = 0)")
def stale_ids(spark, sf_dir):
    c = views.chunks(spark, sf_dir)
    return store.stale(c.where("doc_id % 2 = 0"), c.where("doc_id % 3 = 0"))


@query(r"SELECT doc_id, length(text) > 500 AND length(n) < 0.4 * length(text) AS shrinks, length(CASE WHEN length(text) > 500 AND length(n) < 0.4 * length(text) THEN regexp_replace(text, '\s+$', '') || chr(10) || chr(10) || '## Addendum (2024-02-01)' || chr(10) || chr(10) || regexp_replace(n, '^\s+|\s+$', '', 'g') ELSE n END) AS body FROM (SELECT doc_id, text, left(text, CAST(length(text) * (doc_id % 10) // 10 AS INTEGER)) AS n FROM documents)")
def shrink_guard(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("n", F.expr("substring(text, 1, CAST(length(text) * (doc_id % 10) div 10 AS INT))"))
    body = units.guarded_body(F.col("text"), F.col("n"), F.lit(None).cast("string"), F.lit("2024-02-01"))
    return d.select("doc_id", units.shrinks(F.col("text"), F.col("n")).alias("shrinks"), F.length(body).cast("long").alias("body"))


@query("SELECT l_orderkey, string_agg(kind || ':' || ref, ' ' ORDER BY o, kind, ref) AS artifacts FROM (SELECT l_orderkey, l_returnflag AS kind, CAST(l_suppkey AS VARCHAR) AS ref, min(l_linenumber) AS o FROM lineitem GROUP BY ALL) GROUP BY 1")
def unit_artifacts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("kind"), F.lit("").alias("tool"), F.col("l_suppkey").cast("string").alias("ref"), "l_linenumber")
    got = units.artifacts_of_unit(li, ["l_orderkey"], ["l_linenumber"])
    return got.select("l_orderkey", F.array_join(F.transform("artifacts", lambda a: F.concat(a["kind"], F.lit(":"), a["ref"])), " ").alias("artifacts"))


# ---------------------------------------------------------------- ingest


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, conv_id || '-' || turn AS uuid, role, 1 AS blocks, sha256(text) AS text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''")
def session_log_round_trip(spark, sf_dir):
    """Conversations as session logs in JSON lines, and what the parser reads of them."""
    c = table(spark, sf_dir, "conversations")
    content = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))))
    line = F.struct(F.col("role").alias("type"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("uuid"), F.col("conv_id").cast("string").alias("sessionId"), F.struct("role", content.alias("content")).alias("message"))
    root = shared_path(spark, "session-logs")
    sessions.write_lines(c.select(line.alias("line")), root)
    found = sessions.parse_messages(sessions.read_lines(spark, root))
    return found.select("session_id", "uuid", "role", F.size("blocks").alias("blocks"), F.sha2(F.col("blocks")[0]["text"], 256).alias("text"))


@query(f"WITH {PAGES} SELECT slug, CASE WHEN title = '' THEN slug ELSE title END AS title, kind, sha256(body) AS body FROM wiki")
def page_files_round_trip(spark, sf_dir):
    """Pages written as files with front matter and read back."""
    none = F.array().cast("array<string>")
    p = views.wiki(spark, sf_dir).select("slug", F.lit(1).alias("schema"), "title", "kind", F.lit("s: 1").alias("summary"), none.alias("aliases"), F.array(F.lit("b"), F.lit("a")).alias("sources"), none.alias("trajectories"), F.lit("").alias("fingerprint"), F.lit("2024-01-01").alias("created"), F.lit("2024-01-02").alias("updated"), "body")
    root = shared_path(spark, "pages")
    pages.write_pages(p, root)
    return pages.read_pages(spark, root).select("slug", "title", "kind", F.sha2("body", 256).alias("body"))


# ---------------------------------------------------------------- store

_V = "SELECT id, content, chunker_version, invalid_at FROM chunks"


@query(f"""WITH {CHUNKS}, o AS ({_V} WHERE doc_id % 3 <> 0), n AS (SELECT id, 'new ' || id AS content, 9 AS chunker_version, NULL::TIMESTAMP AS invalid_at FROM chunks WHERE doc_id % 2 = 0)
SELECT coalesce(o.id, n.id) AS id, sha256(CASE WHEN o.id IS NULL THEN n.content ELSE o.content END) AS content, CASE WHEN n.id IS NOT NULL THEN n.chunker_version ELSE o.chunker_version END AS chunker_version, (CASE WHEN n.id IS NOT NULL THEN NULL ELSE o.invalid_at END) IS NULL AS live FROM o FULL JOIN n ON o.id = n.id""")
def upsert_merge(spark, sf_dir):
    c = views.chunks(spark, sf_dir)
    old = c.where("doc_id % 3 <> 0").select("id", "content", "chunker_version", "invalid_at")
    new = c.where("doc_id % 2 = 0").select("id", F.concat(F.lit("new "), "id").alias("content"), F.lit(9).alias("chunker_version"), F.lit(None).cast("timestamp_ntz").alias("invalid_at"))
    return store.upsert(old, new, "id", ["chunker_version"], ["invalid_at"]).select("id", F.sha2("content", 256).alias("content"), "chunker_version", F.col("invalid_at").isNull().alias("live"))


@query(f"WITH {CHUNKS}, e AS (SELECT sha256(content) AS sha, min(doc_id) AS first FROM chunks WHERE doc_id % 2 = 0 GROUP BY 1) SELECT sha, first FROM e WHERE sha NOT IN (SELECT sha256(content) FROM chunks WHERE doc_id % 3 = 0)")
def append_raw_events(spark, sf_dir):
    c = views.chunks(spark, sf_dir).select("doc_id", F.sha2("content", 256).alias("sha"))
    return store.append_new(c.where("doc_id % 3 = 0"), c.where("doc_id % 2 = 0"), ["sha"], ["doc_id"]).select("sha", F.col("doc_id").alias("first"))


@query(f"WITH {CHUNKS} SELECT id, (doc_id % 4 = 0 AND tier = 'wiki' AND owner = 'owner1' AND invalid_at IS NULL) AS flipped, invalid_at IS NULL AND NOT (doc_id % 4 = 0 AND tier = 'wiki' AND owner = 'owner1') AS live FROM chunks")
def tombstone(spark, sf_dir):
    c = views.chunks(spark, sf_dir)
    out = store.invalidate(c, c.where("doc_id % 4 = 0"), as_of(), (F.col("tier") == "wiki") & (F.col("owner") == "owner1"))
    return out.select("id", "flipped", F.col("invalid_at").isNull().alias("live"))


@query(f"WITH {CHUNKS} SELECT id FROM chunks WHERE NOT (doc_id % 2 = 0 AND tier = 'dream' AND owner = 'owner2') AND chunker_version IS NOT DISTINCT FROM 2 AND NOT starts_with(owner, 'owner0')")
def deletes(spark, sf_dir):
    c = views.chunks(spark, sf_dir)
    kept = store.delete_ids(c, c.where("doc_id % 2 = 0"), (F.col("tier") == "dream") & (F.col("owner") == "owner2"))
    return store.delete_owner(store.delete_stale(kept, F.lit(2)), "owner0", prefix=True).select("id")


@query("SELECT o_custkey, max_by(o_orderkey, (o_orderdate, s, o_orderkey)) AS o_orderkey FROM (SELECT *, 0 AS s FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT *, 1 FROM orders WHERE o_orderkey % 2 = 1) GROUP BY 1")
def ledger_last_writer(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("stamp"))
    best = lambda d: d.groupBy("o_custkey", "stamp").agg(F.max("o_orderkey").alias("o_orderkey"))  # noqa: E731  one row per key and stamp on either side
    return store.last_writer(best(o.where("o_orderkey % 2 = 0")), best(o.where("o_orderkey % 2 = 1")), ["o_custkey"], "stamp").select("o_custkey", "o_orderkey")


@query(f"WITH {CHUNKS}, k AS (SELECT DISTINCT sha256(content) AS sha, embedding_model FROM chunks WHERE doc_id % 2 = 0) SELECT c.embedding_model, count(*) AS n, count(*) FILTER (WHERE k.sha IS NOT NULL) AS hits, count(*) FILTER (WHERE k.sha IS NULL) AS misses FROM chunks c LEFT JOIN k ON k.sha = sha256(c.content) AND k.embedding_model = c.embedding_model GROUP BY 1")
def cache_lookup(spark, sf_dir):
    c = views.chunks(spark, sf_dir).select("doc_id", "embedding_model", F.sha2("content", 256).alias("sha"))
    cache = c.where("doc_id % 2 = 0").select("sha", "embedding_model").distinct().withColumn("hit", F.lit(True))
    found = store.lookup(c, cache, ["sha", "embedding_model"])
    return found.groupBy("embedding_model").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))


@query(f"WITH {CHUNKS} SELECT count(*) AS total, CAST(sum(length(content)) AS BIGINT) AS chars, count(*) FILTER (WHERE doc_id % 6 = 0 OR embedding_model IS DISTINCT FROM 'm1') AS todo FROM chunks")
def reembed_plan(spark, sf_dir):
    c = views.chunks(spark, sf_dir).withColumn("embedding", F.when(F.col("doc_id") % 6 != 0, F.lit(1)))
    todo = store.needs_embedding(c, "m1").agg(F.count(F.lit(1)).alias("todo"))
    return c.agg(F.count(F.lit(1)).alias("total"), F.sum(F.length("content")).alias("chars")).join(F.broadcast(todo))


@query(f"WITH {CHUNKS} SELECT id, CASE WHEN tier = 'raw' AND doc_id % 2 = 0 THEN 'x' || trajectory_id ELSE session_id END AS session_id FROM chunks")
def set_artifacts(spark, sf_dir):
    c = views.chunks(spark, sf_dir).select("id", "doc_id", "tier", "trajectory_id", "session_id")
    values = c.where("doc_id % 4 IN (0, 2)").select("trajectory_id", F.concat(F.lit("x"), "trajectory_id").alias("new_value")).distinct()
    return store.assign_where(c, values, "trajectory_id", "session_id", (F.col("tier") == "raw") & (F.col("doc_id") % 2 == 0)).select("id", "session_id")


# ---------------------------------------------------------------- joins and reads

@query(f"WITH {CHUNKS} SELECT id, chunk_index FROM chunks WHERE trajectory_id = '5' AND invalid_at IS NULL")
def trajectory_rows(spark, sf_dir):
    return views.chunks(spark, sf_dir).where("trajectory_id = '5' AND invalid_at IS NULL").orderBy(F.asc_nulls_last("chunk_index")).select("id", "chunk_index")


@query(f"WITH {CHUNKS} SELECT id FROM chunks WHERE repo = 'en' AND dream_type IN ('decision', 'gotcha') AND ts >= {STAMP} - INTERVAL 20 DAY AND invalid_at IS NULL ORDER BY ts DESC, id LIMIT 12")
def recent_memories(spark, sf_dir):
    return context.recent_memories(views.chunks(spark, sf_dir), "en", as_of(), days=20).select("id")


@query("SELECT o.o_orderkey, o.o_custkey, n.lines IS NULL OR n.lines < 3 AS pending FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) n ON n.l_orderkey = o.o_orderkey WHERE o.o_orderdate < TIMESTAMP '1996-01-01'")
def ledger_left_join(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.expr("timestamp_ntz'1996-01-01 00:00:00'"))
    return o.join(n, "o_orderkey", "left").select("o_orderkey", "o_custkey", (F.col("lines").isNull() | (F.col("lines") < 3)).alias("pending"))


@query(f"""WITH {CHUNKS}, w AS (SELECT 'p' || trajectory_id AS slug, chunk_index, content, unnest([CAST(doc_id AS VARCHAR), CAST(doc_id + 1 AS VARCHAR)]) AS sid FROM chunks WHERE tier = 'wiki')
SELECT slug, count(DISTINCT c.id) AS evidence, CAST(max(c.ts) AS VARCHAR) AS latest, sha256(arg_min(w.content, (w.chunk_index, w.content))) AS excerpt FROM w JOIN chunks c ON c.id = w.sid WHERE c.repo = 'en' GROUP BY slug""")
def membership_join(spark, sf_dir):
    c = views.chunks(spark, sf_dir)
    wiki = c.where("tier = 'wiki'").select(F.concat(F.lit("p"), "trajectory_id").alias("slug"), "chunk_index", "content", F.array(F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string")).alias("source_chunk_ids"))
    return context.pages_for_repo(wiki, c.select("id", "repo", "ts"), "en").select("slug", "evidence", F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"), F.sha2("excerpt", 256).alias("excerpt"))


@query(f"WITH {CHUNKS} SELECT DISTINCT c.id FROM chunks c JOIN (SELECT CAST(page_id * 3 AS VARCHAR) AS id FROM pages) p USING (id) WHERE tier = 'dream'")
def existing_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "pages").select((F.col("page_id") * 3).cast("string").alias("id"))
    return store.existing(views.chunks(spark, sf_dir), ids, "dream")


_UNITS = "SELECT session_id, repo, sha256(string_agg(id, chr(10) ORDER BY id)) AS fp FROM chunks WHERE tier = 'dream'"


@query(f"""WITH {CHUNKS}, u AS ({_UNITS} GROUP BY ALL), l AS ({_UNITS} AND doc_id % 9 <> 4 AND session_id <> 'src3' GROUP BY ALL)
SELECT u.session_id, u.repo, CASE WHEN l.fp IS NULL THEN 'new' ELSE 'changed' END AS status FROM u LEFT JOIN l USING (session_id, repo) WHERE u.fp IS DISTINCT FROM l.fp""")
def uncompiled_units(spark, sf_dir):
    c = views.chunks(spark, sf_dir).where("tier = 'dream'")
    of = lambda df: df.groupBy("session_id", "repo").agg(tx.fingerprint(F.collect_list("id")).alias("fingerprint"))
    return units.uncompiled(of(c), of(c.where("doc_id % 9 <> 4 AND session_id <> 'src3'")), ["session_id", "repo"]).select("session_id", "repo", "status")


@query(f"""WITH {CHUNKS}
SELECT c.id, CASE WHEN tier = 'raw' AND session_id = 'src0' AND doc_id % 9 <> 0 THEN '/' || repo || '.py' ELSE '/old.py' END AS ref FROM chunks c""")
def backfilled_artifacts(spark, sf_dir):
    """Artifacts of one source's raw chunks derived anew from stored payloads, every ninth of them torn."""
    c = views.chunks(spark, sf_dir).withColumn("trajectory_id", F.col("id"))
    payload = F.when(F.col("doc_id") % 9 == 0, F.lit("{")).otherwise(F.to_json(F.struct(F.concat(F.lit("/"), "repo", F.lit(".py")).alias("path"))))
    events = c.select("trajectory_id", F.col("session_id").alias("source"), payload.alias("payload"))
    old = F.array(F.struct(F.lit("file").alias("kind"), F.lit("/old.py").alias("ref"), F.lit("Write").alias("tool")))
    derive = lambda rows_: rows_.select("trajectory_id", sessions.artifacts(F.array(F.lit("Write")), F.array(F.to_json(F.struct("path"))), F.lit("")).alias("artifacts"))
    found = store.backfill_artifacts(c.withColumn("artifacts", old), events, "src0", "path string", derive)
    return found.select("id", F.col("artifacts")[0]["ref"].alias("ref"))


@query("SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_linestatus = 'O'")
def arm_coverage(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "k")
    return evaluation.covered([li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), li.where("l_linestatus = 'O'")], "k")


@query("SELECT a.p_name AS a, b.p_name AS b FROM (SELECT DISTINCT p_name FROM part) a, (SELECT DISTINCT p_name FROM part) b WHERE a.p_name < b.p_name AND levenshtein(a.p_name, b.p_name) <= floor(0.25 * greatest(length(a.p_name), length(b.p_name)))")
def edit_distance_pairs(spark, sf_dir):
    return graph.close_names(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))


@query(f"WITH {PAGES}, t AS (SELECT slug, unnest(list_distinct(targets)) AS token, lower(title) AS text FROM wiki) SELECT slug, token FROM t WHERE contains(text, token)")
def containment_join(spark, sf_dir):
    p = views.wiki(spark, sf_dir)
    tokens = p.select(F.col("slug").alias("unit"), F.explode(F.array_distinct("targets")).alias("token"))
    found = graph.containment(p.select(F.col("slug").alias("unit"), F.lower("title").alias("text")), tokens)
    return found.select(F.col("unit").alias("slug"), "token")


@query(f"WITH {PAGES} SELECT slug, CASE WHEN ordinal % 2 = 0 THEN kind ELSE {_SENTENCE.format(c='body')} END AS summary FROM wiki")
def page_hydration(spark, sf_dir):
    p = views.wiki(spark, sf_dir)
    files = p.where("ordinal % 2 = 0").select("slug", "title", F.col("kind").alias("summary"))
    return context.hydrate(p.select("slug", F.col("body").alias("excerpt")), files).select("slug", "summary")


@query("SELECT c_custkey AS answer_id, n, CASE WHEN n <= c_custkey % 4 THEN CASE WHEN c_custkey % 3 = 0 THEN 'supported' ELSE 'unsupported' END ELSE 'unsupported' END AS verdict, CASE WHEN n <= c_custkey % 4 AND c_custkey % 2 = 0 THEN 'because' ELSE 'no reason given' END AS reason FROM customer, (VALUES (1), (2), (3)) v(n)")
def judged_claims(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("answer_id"))
    claims = c.withColumn("claims", F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    given = c.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where("n <= answer_id % 4")
    verdicts = given.select("answer_id", "n", F.when(F.col("answer_id") % 3 == 0, " Supported ").otherwise("maybe").alias("verdict"), F.when(F.col("answer_id") % 2 == 0, "because").otherwise(" ").alias("reason"))
    return evaluation.judged(claims, verdicts).select("answer_id", "n", "verdict", "reason")


# ---------------------------------------------------------------- demand and formation

_UNMET = "((kind = 'ask' AND outcome IN ('not_covered', 'no_candidates')) OR (kind = 'search' AND (result_count = 0 OR top_similarity < 0.35)))"


@query(f"WITH {DEMAND} SELECT lower(query) AS query, count(*) AS times, CAST(max(ts) AS VARCHAR) AS latest, arg_max(top_session_id, (coalesce(top_similarity, -1e308), -id)) AS top_session_id, arg_max(top_tier, (coalesce(top_similarity, -1e308), -id)) AS top_tier FROM demand WHERE {_UNMET} GROUP BY 1")
def unmet_demand(spark, sf_dir):
    return demand.unmet_demand(views.demand(spark, sf_dir)).withColumn("latest", F.regexp_replace(F.date_format("latest", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", ""))


@query(f"WITH {DEMAND} SELECT count(*) AS total, count(*) FILTER (WHERE kind = 'ask') AS asks, count(*) FILTER (WHERE kind = 'search') AS searches, count(*) FILTER (WHERE {_UNMET}) AS unmet, count(DISTINCT CASE WHEN {_UNMET} THEN lower(query) END) AS distinct_unmet FROM demand WHERE ts >= {STAMP} - INTERVAL 14 DAY")
def demand_summary(spark, sf_dir):
    return demand.summary(demand.window(views.demand(spark, sf_dir), as_of(), 14))


@query(f"WITH {DEMAND} SELECT query, epoch_us(max(ts)) AS latest FROM demand WHERE kind = 'ask' AND outcome = 'answered' GROUP BY 1")
def answered_questions(spark, sf_dir):
    return demand.answered_questions(views.demand(spark, sf_dir)).select("query", F.unix_micros(F.col("latest").cast("timestamp")).alias("latest"))


@query(f"WITH {DEMAND}, u AS (SELECT lower(query) AS q, count(*) AS times, max(ts) AS latest, arg_max(top_session_id, (coalesce(top_similarity, -1e308), -id)) AS s, arg_max(top_tier, (coalesce(top_similarity, -1e308), -id)) AS t FROM demand WHERE {_UNMET} GROUP BY 1) SELECT s AS top_session_id, max(times) AS times FROM u WHERE t = 'raw' AND s IS NOT NULL GROUP BY s ORDER BY max(times) DESC, max(latest) DESC, s LIMIT 5")
def targeted_sessions(spark, sf_dir):
    return demand.targeted_sessions(demand.unmet_demand(views.demand(spark, sf_dir))).select("top_session_id", "times")


@query(f"WITH {DEMAND} SELECT count(*) AS total, epoch_us(max(ts)) AS latest, count(*) FILTER (WHERE ts >= {STAMP} - INTERVAL 7 DAY) AS last_week FROM demand")
def context_stats(spark, sf_dir):
    return demand.context_stats(views.demand(spark, sf_dir), as_of()).select("total", F.unix_micros(F.col("latest").cast("timestamp")).alias("latest"), "last_week")


@query(f"WITH {DEMAND} SELECT id FROM demand WHERE ts >= {STAMP} - INTERVAL 10 DAY")
def log_retention(spark, sf_dir):
    return demand.retained(views.demand(spark, sf_dir), as_of(), 10).select("id")


_DAILY = "daily AS (SELECT strftime(ts, '%Y-%m-%d') AS day, tier, count(*) AS n, sum(length(content)) AS chars FROM chunks WHERE ts IS NOT NULL GROUP BY ALL), totals AS (SELECT day, sum(n) AS total FROM daily GROUP BY day)"


@query(f"WITH {CHUNKS}, {_DAILY} SELECT day, tier, n, CAST(chars AS BIGINT) AS chars FROM daily WHERE day >= '2024-01-03' AND day < '2024-01-20'")
def daily_counts(spark, sf_dir):
    return demand.daily_counts(views.chunks(spark, sf_dir), F.expr("timestamp_ntz'2024-01-03 00:00:00'"), F.expr("timestamp_ntz'2024-01-20 00:00:00'"))


def _totals(spark, sf_dir):
    return demand.day_totals(demand.daily_counts(views.chunks(spark, sf_dir).where("ts IS NOT NULL")))


@query(f"WITH {CHUNKS}, {_DAILY} SELECT day, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (WHERE tier = 'raw'), 0) AS BIGINT) AS n_raw, CAST(coalesce(sum(n) FILTER (WHERE tier = 'dream'), 0) AS BIGINT) AS n_dream, CAST(coalesce(sum(n) FILTER (WHERE tier = 'wiki'), 0) AS BIGINT) AS n_wiki FROM daily GROUP BY day")
def heatmap_days(spark, sf_dir):
    return _totals(spark, sf_dir)


_CUTS = "cuts AS (SELECT v[CAST(floor(len(v) * 0.25) AS INT) + 1] AS q1, v[CAST(floor(len(v) * 0.5) AS INT) + 1] AS q2, v[CAST(floor(len(v) * 0.75) AS INT) + 1] AS q3 FROM (SELECT list_sort(list(total)) AS v FROM totals WHERE total > 0))"


@query(f"WITH {CHUNKS}, {_DAILY}, {_CUTS} SELECT CAST(q1 AS BIGINT) AS q1, CAST(q2 AS BIGINT) AS q2, CAST(q3 AS BIGINT) AS q3 FROM cuts")
def heatmap_quartiles(spark, sf_dir):
    return demand.quartile_cuts(_totals(spark, sf_dir))


@query(f"WITH {CHUNKS}, {_DAILY}, {_CUTS} SELECT day, CASE WHEN total <= q1 THEN 1 WHEN total <= q2 THEN 2 WHEN total <= q3 THEN 3 ELSE 4 END AS level FROM totals, cuts")
def heatmap_levels(spark, sf_dir):
    return demand.heat_levels(_totals(spark, sf_dir)).select("day", "level")


@query(f"WITH {CHUNKS}, {_DAILY} SELECT tier, day, round(coalesce((n - min(n) OVER w) / nullif(max(n) OVER w - min(n) OVER w, 0), 0.5), 9) AS scaled, n - lag(n) OVER (PARTITION BY tier ORDER BY day) AS delta FROM daily WINDOW w AS (PARTITION BY tier)")
def spark_lines(spark, sf_dir):
    d = demand.daily_counts(views.chunks(spark, sf_dir).where("ts IS NOT NULL"))
    return demand.spark_line(d, "tier", "day", "n").select("tier", "day", F.round("scaled", 9).alias("scaled"), "delta")


@query(f"WITH {CHUNKS} SELECT unnest(generate_series(2026, CAST(year(min(ts)) AS BIGINT), -1)) AS year FROM chunks")
def year_options(spark, sf_dir):
    first = views.chunks(spark, sf_dir).agg(F.min("ts").alias("first_day"))
    return demand.years(first, 2026).select(F.col("year").cast("long").alias("year"))


@query(f"WITH {CHUNKS} SELECT owner, count(*) AS n, count(invalid_at) AS dead, strftime(min(ts), '%Y-%m-%d') AS first_day, count(DISTINCT embedding_model) AS models FROM chunks GROUP BY owner")
def owner_snapshot(spark, sf_dir):
    return views.chunks(spark, sf_dir).groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.count("invalid_at").alias("dead"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.count_distinct("embedding_model").alias("models"))


@query(f"WITH {CHUNKS} SELECT owner, count(*) AS n, count(DISTINCT trajectory_id) AS trajectories, round(avg(length(content)), 6) AS mean, round(quantile_cont(length(content), 0.5), 6) AS p50, round(quantile_cont(length(content), 0.9), 6) AS p90, max(length(content)) AS largest, round(count(*) / count(DISTINCT trajectory_id), 6) AS per_trajectory FROM chunks GROUP BY owner")
def chunk_size_stats(spark, sf_dir):
    found = demand.size_stats(views.chunks(spark, sf_dir), "owner", F.length("content").cast("long"))
    return found.withColumns({c: F.round(c, 6) for c in ("p50", "p90")})


# ---------------------------------------------------------------- graph and lint

_NAMES = "names AS (SELECT slug AS name, slug FROM wiki UNION ALL SELECT alias, arg_min(slug, (ordinal, slug)) FROM wiki WHERE alias <> '' AND alias NOT IN (SELECT slug FROM wiki) GROUP BY alias)"
_EDGES = "edges AS (SELECT src, coalesce(n.slug, target) AS dst, n.slug IS NULL AS dangling FROM (SELECT slug AS src, unnest(list_distinct(targets)) AS target FROM wiki) l LEFT JOIN names n ON n.name = target WHERE src <> coalesce(n.slug, target))"


def _wiki(spark, sf_dir):
    return views.wiki(spark, sf_dir).withColumn("aliases", F.when(F.col("alias") != "", F.array("alias")).otherwise(F.array().cast("array<string>")))


def _edges(spark, sf_dir, pages=None):
    p = _wiki(spark, sf_dir) if pages is None else pages
    return graph.edges(p.select(F.col("slug").alias("src"), F.explode(F.array_distinct("targets")).alias("target")), graph.resolution(p))


@query(f"WITH {PAGES}, {_NAMES} SELECT name, slug FROM names")
def alias_resolution(spark, sf_dir):
    return graph.resolution(_wiki(spark, sf_dir))


@query(f"WITH {PAGES}, {_NAMES}, {_EDGES} SELECT src, dst, dangling FROM edges")
def link_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"WITH {PAGES}, {_NAMES}, {_EDGES}, o AS (SELECT src AS node, count(DISTINCT dst) AS outbound FROM edges GROUP BY 1), i AS (SELECT dst AS node, count(*) AS inbound FROM edges WHERE NOT dangling GROUP BY 1) SELECT node, coalesce(outbound, 0) AS outbound, coalesce(inbound, 0) AS inbound FROM o FULL JOIN i USING (node)")
def link_graph_degree(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


_LINT = f"""WITH {PAGES}, {_NAMES}, {_EDGES}, f AS (
SELECT 'info' AS severity, 'orphan' AS rule, slug AS page, NULL AS detail FROM wiki WHERE slug NOT IN (SELECT dst FROM edges WHERE NOT dangling)
UNION ALL SELECT 'info', 'link-less', slug, NULL FROM wiki WHERE slug NOT IN (SELECT src FROM edges)
UNION ALL SELECT 'warn', 'dangling-link', src, dst FROM edges WHERE dangling
UNION ALL SELECT 'info', 'stub', slug, CAST(length(body) AS VARCHAR) FROM wiki WHERE length(body) < 120
UNION ALL SELECT 'info', 'oversized', slug, CAST(length(body) AS VARCHAR) FROM wiki WHERE length(body) > 8000
UNION ALL SELECT 'warn', 'spelling-drift', a, b FROM (SELECT a.slug AS a, b.slug AS b FROM wiki a JOIN wiki b ON a.slug < b.slug AND levenshtein(a.slug, b.slug) <= floor(0.25 * greatest(length(a.slug), length(b.slug)))
  UNION SELECT f.a, w.slug FROM wiki w JOIN (SELECT alias, min(slug) AS a FROM wiki WHERE alias <> '' GROUP BY 1) f USING (alias) WHERE w.slug <> f.a))"""


def _parsed(spark, sf_dir):
    """What links and lint need of the pages, so that they are parsed once."""
    return materialise(_wiki(spark, sf_dir).select("slug", "ordinal", "targets", "aliases", F.length("body").alias("size")), "parsed")


@query(f"{_LINT} SELECT severity, rule, count(*) AS n FROM f GROUP BY ALL")
def lint_counts(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    found = graph.findings(p, materialise(_edges(spark, sf_dir, p), "edges"))
    return found.groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_LINT} SELECT severity, rule, page, detail FROM f")
def lint_pages(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    return graph.lint(p, _edges(spark, sf_dir, p))


@query(f"WITH {CHUNKS}, d AS (SELECT session_id, repo, sha256(string_agg(id, chr(10) ORDER BY id)) AS fp, max(ts) AS at FROM chunks WHERE tier = 'dream' GROUP BY ALL), w AS (SELECT session_id, repo, sha256(string_agg(id, chr(10) ORDER BY id)) AS fp FROM chunks WHERE tier = 'dream' AND doc_id % 13 <> 1 GROUP BY ALL) SELECT d.session_id, d.repo FROM d LEFT JOIN w USING (session_id, repo) WHERE d.at < {STAMP} - INTERVAL 48 HOUR AND w.fp IS DISTINCT FROM d.fp")
def pending_units(spark, sf_dir):
    c = views.chunks(spark, sf_dir).where("tier = 'dream'")
    d = c.groupBy("session_id", "repo").agg(F.collect_list("id").alias("dream_chunk_ids"), F.max("ts").alias("synthesized_at"))
    w = c.where("doc_id % 13 <> 1").groupBy("session_id", "repo").agg(tx.fingerprint(F.collect_list("id")).alias("fingerprint"))
    return graph.pending_units(d, w, as_of(), ["session_id", "repo"]).select("session_id", "repo")


@query(f"WITH {PAGES} SELECT kind, sha256(string_agg('- [[' || slug || ']] ' || title || ': ' || alias, chr(10) ORDER BY ordinal % 10 DESC, slug DESC)) AS lines FROM wiki GROUP BY kind")
def index_markdown(spark, sf_dir):
    p = views.wiki(spark, sf_dir).select("kind", "slug", "title", F.col("alias").alias("summary"), (F.col("ordinal") % 10).alias("updated"))
    return graph.index_markdown(p).select("kind", F.sha2("lines", 256).alias("lines"))


@query(f"""WITH {PAGES}, {_NAMES}, {_EDGES} SELECT kind, count(*) AS pages, CAST(sum((SELECT count(*) FROM edges e WHERE e.src = wiki.slug)) AS BIGINT) AS links,
count(*) FILTER (slug NOT IN (SELECT dst FROM edges WHERE NOT dangling)) AS orphans FROM wiki GROUP BY kind""")
def wiki_status(spark, sf_dir):
    return graph.status(views.wiki(spark, sf_dir), _edges(spark, sf_dir))


@query(f"""WITH {PAGES}, {_NAMES}, {_EDGES}, l AS (SELECT *, '- [[' || slug || ']] — ' || coalesce(nullif(alias, ''), title) AS line FROM wiki)
SELECT CASE kind WHEN 'decision' THEN 2 WHEN 'topic' THEN 6 ELSE 7 END AS section, kind AS title, CAST(ordinal % 10 AS VARCHAR) AS updated, slug, line FROM l
UNION ALL SELECT 8, 'orphans', '', slug, line FROM l WHERE slug NOT IN (SELECT dst FROM edges WHERE NOT dangling)""")
def index_lines(spark, sf_dir):
    p = views.wiki(spark, sf_dir).select("kind", "slug", "title", F.col("alias").alias("summary"), (F.col("ordinal") % 10).alias("updated"))
    return graph.index_lines(p, _edges(spark, sf_dir))


@query(f"""WITH {PAGES}, {CHUNKS}, s AS (SELECT slug, unnest([CAST(ordinal AS VARCHAR), CAST(ordinal * 7 AS VARCHAR)]) AS id, ordinal FROM wiki),
f AS (SELECT 'fingerprint-mismatch' AS rule, slug AS page, NULL AS detail FROM wiki WHERE ordinal % 5 = 0
UNION ALL SELECT 'broken-provenance', slug, CAST(count(*) AS VARCHAR) FROM (SELECT DISTINCT slug, id FROM s) WHERE id NOT IN (SELECT id FROM chunks WHERE tier = 'dream') GROUP BY slug
UNION ALL SELECT 'dead-artifact', slug, '/gone/' || ordinal FROM wiki WHERE ordinal % 3 = 1)
SELECT rule, page, detail FROM f""")
def lint_provenance(spark, sf_dir):
    """The rules on sources, fingerprints and files: every page has two sources, every fifth a stale fingerprint, every third
    a file that is gone."""
    sources = F.array_distinct(F.array(F.col("ordinal").cast("string"), (F.col("ordinal") * 7).cast("string")))
    p = _wiki(spark, sf_dir).withColumn("sources", sources).withColumn("fingerprint", F.when(F.col("ordinal") % 5 == 0, F.lit("stale")).otherwise(tx.fingerprint(F.col("sources"))))
    p = p.withColumn("paths", F.array(F.lit("/kept"), F.when(F.col("ordinal") % 3 == 1, F.concat(F.lit("/gone/"), "ordinal")).otherwise(F.lit("/kept"))))
    known = views.chunks(spark, sf_dir).where("tier = 'dream'").select("id")
    found = graph.findings(p, _edges(spark, sf_dir), known, spark.createDataFrame([("/kept",)], "path string"))
    return found.where(F.col("rule").isin("fingerprint-mismatch", "broken-provenance", "dead-artifact")).select("rule", "page", "detail")


# ---------------------------------------------------------------- evaluation

_RANKED = f"{_BATCH}, k AS (SELECT query_id, rank AS position, e.label = q.label AS relevant FROM r JOIN embeddings e ON e.vec_id = r.vec_id JOIN embeddings q ON q.vec_id = query_id WHERE rank <= 20)"
_PER = """m AS (SELECT query_id, min(position) FILTER (WHERE relevant) AS first, sum(CASE WHEN relevant AND position <= 10 THEN 1 / log2(position + 1) ELSE 0 END) AS dcg, count(*) FILTER (WHERE relevant AND position <= 10) AS hits FROM k GROUP BY 1),
per AS (SELECT query_id, CAST(coalesce(first <= 1, false) AS INTEGER) AS hit1, CAST(coalesce(first <= 3, false) AS INTEGER) AS hit3, CAST(coalesce(first <= 5, false) AS INTEGER) AS hit5, CAST(coalesce(first <= 10, false) AS INTEGER) AS recall10,
CASE WHEN first <= 10 THEN 1.0 / first ELSE 0.0 END AS mrr10, CASE WHEN hits = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, hits + 1), lambda i: 1 / log2(i + 1))) END AS ndcg FROM m)"""


def _ranked(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    hits = _batch(spark, sf_dir, 20).join(e.select("vec_id", "label"), "vec_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return hits.select("query_id", F.col("rank").alias("position"), (F.col("label") == F.col("own")).alias("relevant"))


@query(f"WITH {_RANKED}, {_PER} SELECT query_id, hit1, hit3, hit5, recall10, round(mrr10, 6) AS mrr10, round(ndcg, 6) AS ndcg_retrieved FROM per")
def rank_metrics(spark, sf_dir):
    m = evaluation.rank_metrics(_ranked(spark, sf_dir))
    return m.select("query_id", "hit1", "hit3", "hit5", "recall10", F.round("mrr10", 6).alias("mrr10"), F.round("ndcg_retrieved", 6).alias("ndcg_retrieved"))


@query(f"WITH {_RANKED}, {_PER}, g AS (SELECT per.*, CAST(label AS VARCHAR) AS slice FROM per JOIN embeddings ON vec_id = query_id) SELECT slice, count(*) AS n, round(avg(hit1), 6) AS hit1, round(avg(mrr10), 6) AS mrr10, round(avg(ndcg), 6) AS ndcg_retrieved FROM g GROUP BY ROLLUP (slice)")
def metrics_rollup(spark, sf_dir):
    slices = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("slice"))
    return evaluation.metrics_by(evaluation.rank_metrics(_ranked(spark, sf_dir)).join(slices, "query_id"), "slice", ["hit1", "mrr10", "ndcg_retrieved"])


@query("WITH v AS (SELECT CASE WHEN event_type IN ('view') THEN 'supported' WHEN event_type = 'click' THEN 'partial' ELSE 'unsupported' END AS v FROM events) SELECT count(*) AS claims, count(*) FILTER (WHERE v = 'supported') AS supported, count(*) FILTER (WHERE v = 'partial') AS partial, count(*) FILTER (WHERE v = 'unsupported') AS unsupported, round(count(*) FILTER (WHERE v = 'supported') / count(*), 6) AS faithful, round(count(*) FILTER (WHERE v = 'unsupported') / count(*), 6) AS unsupported_share, round(count(*) * 100 * 3.0 / 1e6 + count(*) * 10 * 15.0 / 1e6, 6) AS cost FROM v")
def faithfulness(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "view", "SUPPORTED").when(F.col("event_type") == "click", " partial").otherwise(F.col("event_type")).alias("verdict"), F.lit(100).alias("tokens_in"), F.lit(10).alias("tokens_out"))
    return evaluation.faithfulness(e, 3.0, 15.0)


@query(f"WITH {_BATCH}, t AS (SELECT vec_id AS query_id, label AS true_label FROM embeddings WHERE vec_id % 20 = 0) SELECT t.query_id, min(CASE WHEN e.label <> t.true_label THEN rank END) AS true_rank FROM t LEFT JOIN r ON r.query_id = t.query_id AND rank <= 10 LEFT JOIN embeddings e ON e.vec_id = r.vec_id GROUP BY 1")
def true_rank(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    hits = _batch(spark, sf_dir).join(e.select("vec_id", "label"), "vec_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    results = hits.select("query_id", F.col("rank").cast("long").alias("position"), F.when(F.col("label") != F.col("own"), F.lit("x")).otherwise("y").alias("trajectory_id"))
    truth = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.lit("x").alias("true_id"))
    return evaluation.with_rank(results, truth)


@query("SELECT doc_id FROM documents ORDER BY sha256('42:' || CAST(doc_id AS VARCHAR)) LIMIT 100")
def seeded_sample(spark, sf_dir):
    return evaluation.seeded_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)


def _append_ids(payload: dict) -> list[dict]:
    """A stand-in for the model: the page named by the unit's items gets a line with their ids."""
    title = payload["items"][0]["text"].split(" ")[0]
    old = next((c["body"] + chr(10) for c in payload["candidates"] if c["slug"] == f"{title}-page"), "")
    ids = [i["id"] for i in payload["items"]]
    return [{"slug": f"{title}-page", "title": title, "kind": "topic", "summary": str(len(payload["candidates"])), "aliases": [], "sources": ids, "body": f"{old}{title}: {' '.join(ids)}"}]


@query("""WITH c AS (SELECT conv_id, lpad(CAST(conv_id AS VARCHAR), 9, '0') AS unit, 'topic' || lpad(CAST(conv_id % (SELECT (max(conv_id) + 2) // 2 FROM conversations) AS VARCHAR), 9, '0') AS title, lpad(CAST(conv_id AS VARCHAR), 9, '0') || '-' || lpad(CAST(turn AS VARCHAR), 6, '0') AS id FROM conversations),
u AS (SELECT unit, title, title || ': ' || string_agg(id, ' ' ORDER BY id) AS line, list(id) AS ids FROM c GROUP BY unit, title)
SELECT title || '-page' AS slug, sha256(string_agg(line, chr(10) ORDER BY unit)) AS body, sha256(array_to_string(list_sort(flatten(list(ids))), chr(10))) AS fingerprint, CASE WHEN count(*) > 1 THEN '1' ELSE '0' END AS summary FROM u GROUP BY title""")
def compiled_units(spark, sf_dir):
    """Conversations compiled into pages, oldest first: two of them share a page, so the second reads what the first wrote."""
    c = table(spark, sf_dir, "conversations")
    half = c.agg(F.floor((F.max("conv_id") + 2) / 2).alias("half"))
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    items = c.join(F.broadcast(half)).select(pad(F.col("conv_id"), 9).alias("unit"), F.concat(pad(F.col("conv_id"), 9), F.lit("-"), pad(F.col("turn"), 6)).alias("id"), F.lit("note").alias("kind"), F.concat(F.lit("topic"), pad(F.col("conv_id") % F.col("half"), 9), F.lit(" of a talk")).alias("text"))
    units_ = items.select("unit").distinct().select("unit", F.col("unit").alias("last_ts"), F.lit("2024-01-01T00:00:00Z").alias("day"))
    none = spark.createDataFrame([], "slug string, title string, kind string, summary string, aliases array<string>, sources array<string>, trajectories array<string>, created string, updated string, body string")
    got = compilation.compile_units(units_, items, none, _append_ids)
    return got["pages"].select("slug", F.sha2("body", 256).alias("body"), "fingerprint", "summary")


# ---------------------------------------------------------------- context and streams


_LINES = f"""{CHUNKS}, {PAGES},
w AS (SELECT 'p' || trajectory_id AS slug, chunk_index, content, unnest([CAST(doc_id AS VARCHAR), CAST(doc_id + 1 AS VARCHAR)]) AS sid FROM chunks WHERE tier = 'wiki'),
own AS (SELECT slug, count(DISTINCT c.id) AS evidence, max(c.ts) AS latest, arg_min(w.content, (w.chunk_index, w.content)) AS excerpt FROM w JOIN chunks c ON c.id = w.sid WHERE c.repo = 'en' GROUP BY slug
        ORDER BY evidence DESC, latest DESC NULLS LAST, slug LIMIT 8),
mem AS (SELECT * FROM chunks WHERE repo = 'en' AND dream_type IS NOT NULL AND ts >= {STAMP} - INTERVAL 30 DAY AND invalid_at IS NULL ORDER BY ts DESC, id LIMIT 12),
men AS (SELECT slug, title, alias, row_number() OVER (ORDER BY slug) AS rank FROM wiki WHERE contains(title, 'en') QUALIFY rank <= 4),
pages_ AS (
  SELECT o.slug, coalesce(nullif({_COLLAPSED.format(c='t.title')}, ''), o.slug) AS title, CASE WHEN t.slug IS NOT NULL THEN {_COLLAPSED.format(c='t.alias')} ELSE {_SENTENCE.format(c='o.excerpt')} END AS summary,
         CASE WHEN t.ordinal % 3 <> 0 THEN '2024-01-0' || (t.ordinal % 9 + 1) || 'T00:00:00Z' END AS updated, 0 AS a, -evidence AS b, latest FROM own o LEFT JOIN wiki t ON t.slug = o.slug
  UNION ALL SELECT slug, title, alias, NULL, 1, rank, NULL FROM men WHERE slug NOT IN (SELECT slug FROM own) AND (EXISTS (FROM own) OR EXISTS (FROM mem))),
c AS (
  SELECT 'page' AS kind, row_number() OVER (ORDER BY a, b, latest DESC NULLS LAST, slug) AS n, '- ' || slug || ' — ' || coalesce(nullif(summary, ''), title) || coalesce(' (updated ' || left(updated, 10) || ')', '') AS line FROM pages_
  UNION ALL SELECT 'memory', row_number() OVER (ORDER BY ts DESC, id), '- ' || dream_type || ' (' || CASE WHEN ts > {STAMP} - INTERVAL 1 DAY THEN 'today' ELSE CAST(date_diff('second', ts, {STAMP}) // 86400 AS VARCHAR) || 'd ago' END || '): ' || {_COLLAPSED.format(c='content')} FROM mem),
i AS (SELECT 'context' AS g, *, CAST(ceil(length(line) / 4.0) AS BIGINT) AS cost FROM c)"""
_FOOTER = """('_' || {p} || CASE WHEN {p} = 1 THEN ' page, ' ELSE ' pages, ' END || {m} || CASE WHEN {m} = 1 THEN ' memory' ELSE ' memories' END || ' · search "en OR main" in en to dig deeper_')"""
_FRAME = f"""ceil(length('## Prior context — en@main') / 4.0) + ceil(length({_FOOTER.format(p='len(p)', m='len(m)')}) / 4.0) + CASE WHEN len(p) > 0 THEN ceil(length('**Pages**') / 4.0) ELSE 0 END
+ CASE WHEN len(m) > 0 THEN ceil(length('**Recent decisions & gotchas (30d)**') / 4.0) ELSE 0 END"""
_SECTION = "(SELECT chr(10) || chr(10) || '{title}' || chr(10) || string_agg(line, chr(10) ORDER BY n) FROM i WHERE kind = '{kind}' AND list_contains({chosen}, n))"


@query(f"""{_filled("i", 2000, _FRAME, _LINES)}, texts AS (SELECT '## Prior context — en@main' || coalesce({_SECTION.format(title=context.PAGES_TITLE, kind='page', chosen='tp')}, '')
|| coalesce({_SECTION.format(title=context.MEMORIES_TITLE, kind='memory', chosen='tm')}, '') || chr(10) || chr(10) || {_FOOTER.format(p='len(tp)', m='len(tm)')} || chr(10) AS text FROM f)
SELECT text, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM texts""")
def build_context(spark, sf_dir):
    """Context of one repository: pages by evidence, decisions, mentions, budget, text."""
    c = views.chunks(spark, sf_dir)
    wiki = c.where("tier = 'wiki'").select(F.concat(F.lit("p"), "trajectory_id").alias("slug"), "chunk_index", "content", F.array(F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string")).alias("source_chunk_ids"))
    pages = context.pages_for_repo(wiki, c.select("id", "repo", "ts"), "en").orderBy(F.desc("evidence"), F.desc_nulls_last("latest"), "slug").limit(context.PAGES)
    files = views.wiki(spark, sf_dir).withColumn("updated", F.when(F.col("ordinal") % 3 != 0, F.concat(F.lit("2024-01-0"), F.col("ordinal") % 9 + 1, F.lit("T00:00:00Z"))))
    titles = files.select("slug", "title", F.col("alias").alias("summary"), "updated")
    mentions = titles.drop("updated").where(F.contains("title", F.lit("en"))).orderBy("slug").limit(4).withColumn("rank", F.row_number().over(Window.orderBy("slug")))  # four rows
    return context.build(context.hydrate(pages, titles), context.recent_memories(c, "en", as_of()), mentions, as_of(), "en", "main", 2000)


@query(f"""WITH {CHUNKS}, w AS (SELECT 'p' || trajectory_id AS slug, unnest([CAST(doc_id AS VARCHAR), CAST(doc_id + 1 AS VARCHAR), CAST(doc_id * 3 AS VARCHAR)]) AS sid FROM chunks WHERE tier = 'wiki')
SELECT slug, count(DISTINCT session_id) AS sessions, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM w LEFT JOIN chunks c ON c.id = w.sid GROUP BY slug""")
def page_evidence(spark, sf_dir):
    c = views.chunks(spark, sf_dir)
    wiki = c.where("tier = 'wiki'").select(F.concat(F.lit("p"), "trajectory_id").alias("slug"), F.array(*[x.cast("string") for x in (F.col("doc_id"), F.col("doc_id") + 1, F.col("doc_id") * 3)]).alias("source_chunk_ids"))
    day = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss").alias(x)
    return context.page_evidence(wiki, c).select("slug", "sessions", day("first_seen"), day("last_seen"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_day_counts(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    source = _stream(spark, path)
    return ingest.run_to_table(ingest.day_counts(source, "event_type", late="60 days"), shared_path(spark, "day-counts"), ["day", "event_type"])


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS opens FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS "end", count(*) AS n FROM s GROUP BY user_id, g
HAVING max(ts) + INTERVAL 15 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM events)""")
def stream_quiet_sessions(spark, sf_dir):
    """Sessions of users with a 15 minute gap; those still open at the last watermark are not out yet."""
    path = f"{sf_dir}/events.parquet"
    found = ingest.run_to_table(ingest.quiet_sessions(_stream(spark, path), "user_id"), shared_path(spark, "quiet"))
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("start", "end")})


def _stream(spark, path):
    """A stream over the folder of a table, which may be one file."""
    folder, _, name = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


# ---------------------------------------------------------------- compiled pages

_HUBS = """hubs AS (SELECT slug, ordinal, title, kind, alias, targets, ['s' || CAST(ordinal AS VARCHAR), 's' || CAST(ordinal + 1 AS VARCHAR)] AS sources FROM wiki),
kids AS (SELECT DISTINCT slug AS hub, ordinal, sources, alias, unnest(targets) AS target FROM hubs WHERE ordinal % 5 <> 0),
made AS (SELECT target AS slug, arg_min({'hub': hub, 'ordinal': ordinal, 'sources': sources}, hub) AS k FROM kids WHERE target <> alias AND target NOT IN (SELECT slug FROM wiki) GROUP BY target),
won AS (SELECT slug, k.hub AS hub, k.ordinal AS ordinal, k.sources AS sources FROM made)"""


@query(f"""WITH {PAGES}, {_HUBS} SELECT hub, slug, 'child' AS role, NULL AS reason, sha256(array_to_string(list_sort(CASE WHEN ordinal % 3 = 0 THEN sources ELSE [sources[2]] END), chr(10))) AS fingerprint FROM won
UNION ALL SELECT slug, slug, CASE WHEN slug IN (SELECT hub FROM won) THEN 'hub' ELSE 'failed' END, CASE WHEN slug IN (SELECT hub FROM won) THEN NULL WHEN ordinal % 5 = 0 THEN 'not exactly one update of the hub' ELSE 'no valid child' END,
CASE WHEN slug IN (SELECT hub FROM won) THEN sha256(array_to_string(list_sort(sources), chr(10))) END FROM hubs""")
def split_pages(spark, sf_dir):
    """Every page as a hub; the alias target's operation is an update, and every fifth hub has no operation on itself."""
    p = views.wiki(spark, sf_dir)
    s = lambda n: F.concat(F.lit("s"), (F.col("ordinal") + n).cast("string"))
    hubs = p.select("slug", "ordinal", "title", F.lit("").alias("summary"), F.array("alias").alias("aliases"), F.array(s(0), s(1)).alias("sources"), F.array(F.lit("t")).alias("trajectories"), F.lit("2024-01-01").alias("created"))
    tail = [F.lit("topic").alias("kind"), F.lit("").alias("summary"), F.array().cast("array<string>").alias("aliases"), F.when(F.col("ordinal") % 3 == 0, F.array(F.lit("x"))).otherwise(F.array(s(1), F.lit("x"))).alias("sources"), F.lit("text").alias("body")]
    kids = p.select("*", F.posexplode("targets").alias("place", "target")).where((F.col("ordinal") % 5 != 0) & (F.col("target") != F.col("alias"))).select(F.col("slug").alias("hub"), "place", F.lit("create").alias("action"), F.col("target").alias("slug"), F.col("target").alias("title"), *tail)
    own = p.where("ordinal % 5 <> 0").select(F.col("slug").alias("hub"), F.lit(-1).alias("place"), F.lit("update").alias("action"), "slug", "title", *tail)
    stray = p.where("alias <> '' AND ordinal % 5 <> 0").select(F.col("slug").alias("hub"), F.lit(-2).alias("place"), F.lit("update").alias("action"), F.col("alias").alias("slug"), "title", *tail)
    out = compiled.split_pages(hubs, own.union(kids).union(stray), p.select("slug"), F.lit("2024-02-01"))
    return out.select("hub", "slug", "role", "reason", "fingerprint")


_SHORT = "CASE WHEN ordinal % 2 = {m} THEN title || ' new' ELSE title END"
_PAGE_ID = "sha256('wiki:' || slug || ':0:' || " + NORMAL.format(c="'Page' || chr(10) || chr(10) || b") + ")"


def _page_versions(spark, sf_dir):
    """Two versions of the pages, with short bodies: odd ones change, every fifth goes, every seventh is new."""
    p = views.wiki(spark, sf_dir).select("slug", "ordinal", F.col("title").alias("t"), "kind", F.lit("Page").alias("title"), F.array("alias").alias("sources"), as_of().alias("updated"))
    p = p.withColumn("title", F.lit("Page"))
    return p.where("ordinal % 7 <> 0").withColumn("body", F.col("t")), p.where("ordinal % 5 <> 0").withColumn("body", F.when(F.col("ordinal") % 2 == 1, F.concat("t", F.lit(" new"))).otherwise(F.col("t")))


@query(f"""WITH {PAGES}, v1 AS (SELECT slug, {_PAGE_ID} AS id FROM (SELECT slug, title AS b FROM wiki WHERE ordinal % 7 <> 0)), v2 AS (SELECT slug, {_PAGE_ID} AS id FROM (SELECT slug, {_SHORT.format(m=1)} AS b FROM wiki WHERE ordinal % 5 <> 0))
SELECT coalesce(v2.id, v1.id) AS id, v2.id IS NOT NULL AS live, CASE WHEN v2.id IS NULL AND v1.slug IN (SELECT slug FROM v2) THEN 'wiki:' || v1.slug END AS superseded_by FROM v1 FULL JOIN v2 USING (id)""")
def reindex_pages(spark, sf_dir):
    """The store of the pages' first version after a reindex with the second."""
    v1, v2 = _page_versions(spark, sf_dir)
    old = compiled.page_rows(v1, "owner1").withColumn("invalid_at", F.lit(None).cast("timestamp_ntz")).withColumn("superseded_by", F.lit(None).cast("string"))
    return compiled.sync(old, v2, "owner1", as_of(), orphans=True).select("id", F.col("invalid_at").isNull().alias("live"), "superseded_by")


@query(f"""WITH {CHUNKS}, s AS (SELECT 'p' || trajectory_id AS slug, unnest([CAST(doc_id + 1 AS VARCHAR), CAST(doc_id + 2 AS VARCHAR), CAST(doc_id + 1 AS VARCHAR)]) AS sid, unnest([0, 1, 2]) AS pos FROM chunks WHERE tier = 'wiki'),
a AS (SELECT slug, pos, -coalesce(epoch_us(ts), 0) AS age, unnest([session_id, repo]) AS ref, unnest([0, 1]) AS i FROM s JOIN chunks ON id = sid),
f AS (SELECT slug, ref, min((age, pos, i)) AS o FROM a GROUP BY ALL) SELECT slug, string_agg(ref, ' ' ORDER BY o) AS refs FROM f GROUP BY slug""")
def page_artifacts(spark, sf_dir):
    c = views.chunks(spark, sf_dir)
    one = lambda c: F.struct(F.lit("file").alias("kind"), F.lit("Write").alias("tool"), F.col(c).alias("ref"))
    ids = [(F.col("doc_id") + n).cast("string") for n in (1, 2, 1)]
    found = compiled.derived_artifacts(c.where("tier = 'wiki'").select(F.concat(F.lit("p"), "trajectory_id").alias("slug"), F.array(*ids).alias("sources")), c.select("id", "ts", F.array(one("session_id"), one("repo")).alias("artifacts")))
    return found.select("slug", F.array_join(F.transform("artifacts", lambda a: a["ref"]), " ").alias("refs"))


_SHRUNK = "(length({old}) > 500 AND length({new}) < 0.4 * length({old}))"
_ADDED = r"regexp_replace({old}, '\s+$', '') || chr(10) || chr(10) || '## Addendum ({day})' || chr(10) || chr(10) || regexp_replace({new}, '^\s+|\s+$', '', 'g')"


@query(f'''WITH {PAGES}, a AS (SELECT *, CASE WHEN {_SHRUNK.format(old='body', new='title')} THEN {_ADDED.format(old='body', new='title', day='2024-02-01')} ELSE title END AS one, body || chr(10) || 'more' AS more FROM wiki),
b AS (SELECT *, CASE WHEN {_SHRUNK.format(old='one', new='more')} THEN {_ADDED.format(old='one', new='more', day='2024-02-02')} ELSE more END AS two FROM a)
SELECT slug, CASE WHEN ordinal % 3 <> 0 THEN 'kept' WHEN {_SHRUNK.format(old='one', new='more')} THEN 'addendum' ELSE 'updated' END AS outcome, length(CASE WHEN ordinal % 3 = 0 THEN two ELSE body END) AS chars,
CASE WHEN ordinal % 3 = 0 THEN alias || ',alias 1,alias 2' ELSE alias END AS aliases, CASE WHEN ordinal % 3 = 0 THEN slug || ',i1,i2' ELSE slug END AS sources,
sha256(CASE WHEN ordinal % 3 = 0 THEN 'i1' || chr(10) || 'i2' || chr(10) || slug ELSE slug END) AS fingerprint FROM b''')
def merge_pages(spark, sf_dir):
    """All pages after two operations on each third one: a rewrite by a summary that may trip the guard, then a longer text."""
    p = views.wiki(spark, sf_dir).select("slug", "ordinal", "title", "kind", F.lit("").alias("summary"), F.array("alias").alias("aliases"), F.array("slug").alias("sources"), F.array(F.lit("t0")).alias("trajectories"), F.lit("2024-01-01").alias("created"), F.lit("2024-01-01").alias("updated"), "body")
    op = lambda n, body: p.where("ordinal % 3 = 0").select("slug", F.lit(n).alias("place"), "title", "kind", "summary", F.array(F.lit(f"alias {n}")).alias("aliases"), F.array(F.lit(f"i{n}"), F.lit("stray")).alias("sources"), F.array(F.lit(f"i{n}")).alias("unit_ids"), F.lit(f"t{n}").alias("trajectory_id"), body.alias("body"), F.lit(None).cast("string").alias("retry"), F.lit(f"2024-02-0{n}").alias("at"))
    out = compiled.merge_ops(p, op(1, F.col("title")).union(op(2, F.concat("body", F.lit("\nmore")))))
    return out.select("slug", "outcome", F.length("body").alias("chars"), F.array_join("aliases", ",").alias("aliases"), F.array_join("sources", ",").alias("sources"), "fingerprint")


@query(f"WITH {PAGES} SELECT slug, '- ' || slug || ' — ' || kind || ' — ' || title || CASE WHEN alias <> '' THEN ' (aliases: ' || alias || ')' ELSE '' END AS line FROM wiki")
def inventory_lines(spark, sf_dir):
    return _wiki(spark, sf_dir).select("slug", compiled.inventory_line(F.col("slug"), F.col("kind"), F.col("title"), F.col("aliases")).alias("line"))


@query("SELECT max(event_id) FILTER (WHERE event_type = 'view') >= max(event_id) FILTER (WHERE event_type <> 'view') AS fresh FROM events")
def index_freshness(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("modified"))
    return compiled.index_is_fresh(e.where("event_type <> 'view'"), e.where("event_type = 'view'"))


@query(f"WITH {CHUNKS} SELECT id, trajectory_id FROM chunks WHERE tier = 'wiki' AND owner = 'owner1'")
def page_chunk_ids(spark, sf_dir):
    return compiled.chunk_ids(views.chunks(spark, sf_dir), "owner1")


# ---------------------------------------------------------------- answers and their logs

_REF = "CASE WHEN tier = 'wiki' THEN trajectory_id ELSE repo || '@' || CASE WHEN branch <> '' THEN branch ELSE '(no-branch)' END END"
_DAY = "coalesce(strftime(ts, '%Y-%m-%d'), 'unknown')"


@query(f"""WITH {CHUNKS} SELECT id, '[' || CAST(doc_id % 12 + 1 AS VARCHAR) || '] [' || CASE WHEN tier = 'raw' THEN 'raw' ELSE tier || ':' || coalesce(dream_type, '?') END || '] ' || {_REF} || ' · ' || {_DAY} || ' · '
|| CASE WHEN tier = 'dream' THEN trajectory_id ELSE 'chunk ' || left(sha256(id), 8) || '…' END || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' · 1 artifact' ELSE ' · 2 artifacts' END AS line,
'[' || CAST(doc_id % 12 + 1 AS VARCHAR) || '] ' || CASE WHEN tier = 'raw' THEN 'raw' ELSE tier || '/' || coalesce(dream_type, '?') END || ' · ' || {_REF} || ' · ' || {_DAY} AS header,
sha256(CASE WHEN length(content) > 2000 THEN left(content, 2000) || chr(10) || '[truncated]' ELSE content END) AS body FROM chunks""")
def source_lines(spark, sf_dir):
    n, c = (F.col("doc_id") % 12 + 1), F.col
    ref = answers.reference(c("tier"), c("repo"), c("branch"), c("trajectory_id"))
    line = answers.source_line(n, c("tier"), c("dream_type"), ref, c("ts"), c("trajectory_id"), F.sha2("id", 256), F.col("doc_id") % 3)
    return views.chunks(spark, sf_dir).select("id", line.alias("line"), answers.candidate_header(n, c("tier"), c("dream_type"), ref, c("ts")).alias("header"), F.sha2(answers.candidate_body(c("content")), 256).alias("body"))


@query(f"""WITH {_BATCH}, h AS (SELECT query_id, vec_id, rank - 1 AS rank FROM r WHERE rank <= 10), o AS (SELECT * FROM (VALUES (0, 2), (1, 0)) t(place, rank)),
m AS (SELECT h.*, CASE WHEN query_id % 40 = 0 THEN place END AS place FROM h LEFT JOIN o USING (rank)), p AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY place NULLS LAST, rank) - 1 AS position FROM m)
SELECT query_id, vec_id, position FROM p WHERE position < 6""")
def reranked_pages(spark, sf_dir):
    """Result pages with a reranker that answers every other query; its answers hold invalid and repeated indices."""
    pool = _batch(spark, sf_dir).select("query_id", "vec_id", (F.col("rank") - 1).cast("int").alias("rank"))
    answer = F.when(F.col("query_id") % 40 == 0, F.lit('{"ranking": [2, "1", 2, 0.5, 8, -1, 0]}')).otherwise("sorry")
    said = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), answer.alias("answer"))
    return answers.reranked_pages(pool, said, 8, 6).select("query_id", "vec_id", F.col("position").cast("long").alias("position"))


@query(f"""WITH {_BATCH}, h AS (SELECT query_id, rank, vec_id FROM r WHERE rank <= 10 AND query_id % 60 <> 0)
SELECT e.vec_id AS query_id, 'search' AS kind, CASE WHEN vec_id % 100 = 0 THEN 0 ELSE (SELECT count(*) FROM h WHERE query_id = e.vec_id) END AS result_count, CASE WHEN vec_id % 100 <> 0 THEN (SELECT 's' || CAST(vec_id AS VARCHAR) FROM h WHERE query_id = e.vec_id AND rank = 1) END AS top_session_id,
CASE WHEN vec_id % 100 = 0 THEN 'error' END AS outcome FROM embeddings e WHERE vec_id % 20 = 0""")
def search_demand_rows(spark, sf_dir):
    """Demand rows of the stated queries: every third has no result, every fifth failed."""
    found = _batch(spark, sf_dir).where("query_id % 60 <> 0").select("query_id", F.col("rank").alias("position"), "similarity", F.lit("raw").alias("tier"), F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("session_id"))
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.lit("cli").alias("surface"), F.lit("q").alias("query"), F.lit("all").alias("tier"), F.lit(None).cast("string").alias("repo"), (F.col("vec_id") % 100 == 0).alias("failed"))
    return answers.search_rows(asked, found).select("query_id", "kind", "result_count", "top_session_id", "outcome")


@query("""WITH t AS (SELECT conv_id AS q, turn + 1 AS n, role FROM conversations), g AS (SELECT q, count(*) AS result_count, arg_min(role, n) AS top_tier, count(*) FILTER (WHERE role = 'assistant' AND q % 4 <> 0) AS cited_count FROM t WHERE q % 3 <> 0 GROUP BY q)
SELECT q AS query_id, coalesce(result_count, 0) AS result_count, top_tier, CASE WHEN q % 3 = 0 THEN 'no_candidates' WHEN cited_count = 0 THEN 'not_covered' ELSE 'answered' END AS outcome, coalesce(cited_count, 0) AS cited_count FROM (SELECT DISTINCT q FROM t) LEFT JOIN g USING (q)""")
def ask_demand_rows(spark, sf_dir):
    """Conversations as answers whose turns are the sources."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("n"), F.col("role").alias("tier"), ((F.col("role") == "assistant") & (F.col("conv_id") % 4 != 0)).alias("cited"))
    asked = t.select("query_id").distinct().select("query_id", F.lit("ui").alias("surface"), F.lit("q").alias("query"), F.lit("all").alias("tier"), F.lit("").alias("repo"), F.when(F.col("query_id") % 3 != 0, "a").alias("answer"))
    return answers.ask_rows(asked, t.where("query_id % 3 <> 0")).select("query_id", "result_count", "top_tier", "outcome", "cited_count")


@query(f"WITH {CHUNKS}, c AS (SELECT doc_id AS answer_id, unnest([1, 2, 3]) AS n FROM chunks), s AS (SELECT doc_id AS answer_id, unnest([1, 2]) AS n, unnest([CAST(doc_id + 3 AS VARCHAR), CAST(doc_id AS VARCHAR)]) AS chunk_id FROM chunks) SELECT answer_id, n, sha256(content) AS content FROM c JOIN s USING (answer_id, n) LEFT JOIN chunks ON id = chunk_id")
def cited_texts(spark, sf_dir):
    c = views.chunks(spark, sf_dir)
    cites = c.select(F.col("doc_id").alias("answer_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n"))
    sources = c.select(F.col("doc_id").alias("answer_id"), F.posexplode(F.array((F.col("doc_id") + 3).cast("string"), F.col("doc_id").cast("string"))).alias("at", "chunk_id")).select("answer_id", (F.col("at") + 1).alias("n"), "chunk_id")
    return answers.cited_texts(cites, sources, c).select("answer_id", "n", F.sha2("content", 256).alias("content"))


@query(f"WITH {CHUNKS} SELECT doc_id, sha256('B:' || trajectory_id || ':' || CAST(chunk_index AS VARCHAR) || ':' || doc_id) AS id, sha256(CASE WHEN doc_id % 4 <> 0 THEN 'About ' || repo || chr(10) || chr(10) || content ELSE content END) AS text FROM chunks")
def arm_chunks(spark, sf_dir):
    """Chunks of one arm of an experiment, some with a situating prefix."""
    c, prefix = views.chunks(spark, sf_dir), F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("About "), "repo"))
    return c.select("doc_id", answers.arm_chunk_id(F.lit("B"), F.col("trajectory_id"), F.col("chunk_index"), F.col("doc_id").cast("string")).alias("id"), F.sha2(answers.prefixed(prefix, F.col("content")), 256).alias("text"))


@query(f"WITH {_RANKED} SELECT query_id, " + ", ".join(f"CAST(coalesce(min(position) FILTER (WHERE relevant) <= {k}, false) AS INTEGER) AS recall{k}" for k in (1, 3, 5, 10)) + " FROM k GROUP BY query_id")
def recall_any(spark, sf_dir):
    return answers.recall_any(_ranked(spark, sf_dir))


@query("SELECT conv_id, sha256(left(string_agg(text, chr(10) ORDER BY turn), 24000)) AS content FROM conversations WHERE role = 'user' GROUP BY conv_id")
def user_corpus(spark, sf_dir):
    return answers.user_corpus(table(spark, sf_dir, "conversations")).select("conv_id", F.sha2("content", 256).alias("content"))


@query(f"""WITH {DEMAND}, d AS (SELECT query, max(ts) AS ts FROM demand GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20), n AS (SELECT query, row_number() OVER (ORDER BY ts DESC, query) AS n FROM d)
SELECT n, query FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.n < a.n AND starts_with(lower(b.query), lower(a.query))) ORDER BY n LIMIT 20""")
def demand_queries(spark, sf_dir):
    d = views.demand(spark, sf_dir).select("query", "ts")
    return answers.demand_queries(d, d.where("false")).select(F.col("n").cast("long").alias("n"), "query")


@query(f"WITH {CHUNKS} SELECT id FROM chunks WHERE NOT (tier = 'raw' AND chunker_version IS DISTINCT FROM 2)")
def reindex_sweep(spark, sf_dir):
    reports = spark.createDataFrame([("a", None), ("b", None)], "path string, error string")
    return store.sweep(views.chunks(spark, sf_dir), reports, F.lit(2), F.col("tier") == "raw").select("id")


@query(f"WITH {CHUNKS} SELECT id FROM chunks")
def reindex_sweep_failed(spark, sf_dir):
    """A file of the reindex has failed, so nothing is swept."""
    reports = spark.createDataFrame([("a", None), ("b", "unreadable")], "path string, error string")
    return store.sweep(views.chunks(spark, sf_dir), reports, F.lit(2), F.col("tier") == "raw").select("id")


@query(f"""WITH {DEMAND}, d AS (SELECT query, max(ts) AS ts FROM demand WHERE length(query) >= 3 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30), n AS (SELECT trim(query) AS query, row_number() OVER (ORDER BY ts DESC, query) AS n FROM d)
SELECT n, query FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.n < a.n AND starts_with(lower(b.query), lower(a.query))) ORDER BY n LIMIT 20""")
def recent_queries(spark, sf_dir):
    """Queries of the recents, where there is no demand."""
    d = views.demand(spark, sf_dir).select("query", "ts")
    return answers.demand_queries(d.where("query IS NULL"), d).select(F.col("n").cast("long").alias("n"), "query")


@query(f"WITH {CHUNKS} SELECT trajectory_id, doc_id, repo AS path FROM chunks WHERE session_id = 'src0' AND doc_id % 9 <> 0")
def raw_replay(spark, sf_dir):
    """Raw payloads of one source, every ninth of them torn."""
    c = views.chunks(spark, sf_dir)
    payload = F.to_json(F.struct("doc_id", F.col("repo").alias("path")))
    events = c.select("trajectory_id", F.col("session_id").alias("source"), F.when(F.col("doc_id") % 9 == 0, F.lit("{")).otherwise(payload).alias("payload"))
    return store.replay(events, "src0", "doc_id long, path string")


@query(f"WITH {CHUNKS} SELECT trajectory_id, CASE WHEN doc_id % 9 = 0 THEN '{{' ELSE '[' || doc_id || ']' END AS payload FROM chunks WHERE session_id = 'src0' AND (doc_id % 9 = 0 OR doc_id % 7 = 0)")
def raw_unreadable(spark, sf_dir):
    """Payloads that are torn or no object."""
    c = views.chunks(spark, sf_dir)
    payload = F.when(F.col("doc_id") % 9 == 0, F.lit("{")).when(F.col("doc_id") % 7 == 0, F.concat(F.lit("["), "doc_id", F.lit("]"))).otherwise(F.to_json(F.struct("doc_id")))
    return store.unreadable(c.select("trajectory_id", F.col("session_id").alias("source"), payload.alias("payload")), "src0", "doc_id long").select("trajectory_id", "payload")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, coalesce(strftime(CASE WHEN event_id % 4 <> 0 THEN ts END, '%Y-%m-%d'), 'unknown') AS day FROM events")
def iso_times(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", answers.iso_text(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("iso"), answers.iso_day(F.when(F.col("event_id") % 4 != 0, F.col("ts"))).alias("day"))
