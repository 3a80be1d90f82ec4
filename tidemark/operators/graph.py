"""Link graph and lint rules over compiled pages (slug, title, kind, summary, aliases, sources, body, updated)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.shared import materialise

STUB_CHARS, LARGE_CHARS = 120, 8000
DRIFT = 0.25
PENDING_HOURS = 48


def resolution(pages: DataFrame) -> DataFrame:
    """name -> slug: a slug names itself; an alias names the first page that claims it and is no slug."""
    own = pages.select(F.col("slug").alias("name"), "slug")
    aliases = pages.select("slug", "ordinal", F.explode("aliases").alias("alias")).withColumn("name", F.when(tx.valid_slug(F.col("alias")), F.col("alias")).otherwise(tx.slugify(F.col("alias"))))
    claimed = aliases.where("name <> ''").groupBy("name").agg(F.min_by("slug", F.struct("ordinal", "slug")).alias("slug"))
    return own.union(claimed.join(own.select("name"), "name", "left_anti").select("name", "slug"))


def edges(links: DataFrame, names: DataFrame) -> DataFrame:
    """src, dst, dangling of links (src, target) after resolution; links of a page to itself are dropped."""
    found = links.join(names.select(F.col("name").alias("target"), F.col("slug").alias("dst_known")), "target", "left")
    out = found.select("src", F.coalesce("dst_known", "target").alias("dst"), F.col("dst_known").isNull().alias("dangling"))
    return out.where("src <> dst")


def page_links(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("slug").alias("src"), F.explode(tx.wikilinks(F.col("body"))).alias("target"))


def degrees(graph: DataFrame) -> DataFrame:
    """Distinct links out of and all links into each node."""
    out = graph.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("outbound"))
    into = graph.where("NOT dangling").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("inbound"))
    return out.join(into, "node", "full_outer").select("node", F.coalesce("outbound", F.lit(0)).alias("outbound"), F.coalesce("inbound", F.lit(0)).alias("inbound"))


def close_names(names: DataFrame, share: float = DRIFT, column: str = "name") -> DataFrame:
    """Pairs a < b within an edit distance of share * longer length. Exact and without a cross join: such a pair agrees in
    one of k + 1 parts of the shorter name up to a shift of k (k: edits allowed at the length), so parts are the join keys.
    Names as long as 1 / share have parts of one character at least; shorter ones are compared within their length."""
    base = names.select(F.col(column).alias("x")).distinct().where(F.length("x") > 0)
    # Names of a series (p1041, p1042, ...) share parts with all of it, so where one edit is allowed the keys are exact: the
    # name without one character and the place of that in names of one length, and the shorter name itself.
    once = (F.floor(share * F.length("x")) == 1) & F.lit(share > 0)
    gaps = F.transform(F.sequence(F.lit(1), F.length("x")), lambda i: F.struct(i.alias("i"), F.concat(F.substring(F.col("x"), F.lit(1), i - 1), F.substring(F.col("x"), i + 1, F.length("x"))).alias("p")))
    without = base.where(once).select("x", F.explode(gaps).alias("q")).select("x", "q.i", "q.p")
    same = without.join(without.select(F.col("x").alias("y"), "i", "p"), ["i", "p"]).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    missing = without.select(F.col("x").alias("y"), "p").distinct().join(base.select(F.col("x").alias("p")), "p").select(F.least("p", "y").alias("a"), F.greatest("p", "y").alias("b"))
    n = F.length("x")
    # Longer partner's length m satisfies m - n <= share * m; the edits allowed with it are floor(share * m).
    longest = F.floor(n / F.lit(1 - share))
    edits = F.floor(longest * share).cast("int")
    parts = edits + 1
    cut = lambda i: F.floor(i * n / parts).cast("int")
    piece = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(i.alias("i"), F.substring(F.col("x"), cut(i) + 1, cut(i + 1) - cut(i)).alias("p")))
    shorter = base.where(edits > 1).select("x", n.alias("n"), F.explode(piece).alias("q")).select("x", "n", F.col("q.p").alias("p"))
    long_names = base.where(F.floor(share * n) > 1).select(F.col("x").alias("y"), n.alias("m"))
    # All substrings of the longer name that a part can equal: lengths of parts are bounded by n / parts + 1.
    least = F.ceil(F.col("m") * (1 - share)).cast("int")
    width = F.lit(int(1 / share) + 1)
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), width), lambda w: F.when(w > F.col("m"), F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.col("m") - w + 1), lambda s: F.substring(F.col("y"), s, w))))))
    longer = long_names.select("y", "m", least.alias("least"), F.explode(grams).alias("p"))
    pairs = shorter.join(longer, "p").where((F.col("n") <= F.col("m")) & (F.col("n") >= F.col("least")) & (F.col("x") != F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    pairs = pairs.where(F.levenshtein("a", "b") <= F.floor(share * F.greatest(F.length("a"), F.length("b"))))
    return pairs.union(same.union(missing).distinct())


def shared_aliases(pages: DataFrame) -> DataFrame:
    """Pairs of pages that claim one alias: an alias of many pages gives a star around the first, which shows each of them."""
    rows = pages.select("slug", F.explode("aliases").alias("alias"))
    first = rows.groupBy("alias").agg(F.min("slug").alias("a"))
    return rows.join(first, "alias").where("slug <> a").select("a", F.col("slug").alias("b")).distinct()


def _finding(df: DataFrame, severity: str, rule: str, detail: Column | None = None) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.col("slug").alias("page"), (detail if detail is not None else F.lit(None).cast("string")).alias("detail"))


def _sized(pages: DataFrame) -> DataFrame:
    """What rules need of the pages, without the bodies."""
    kept = [c for c in ("slug", "aliases", "fingerprint", "sources", "paths") if c in pages.columns]
    size = F.col("size") if "size" in pages.columns else F.length("body")
    return pages.select(*kept, size.alias("size"))


def findings(pages: DataFrame, graph: DataFrame, known_sources: DataFrame | None = None, known_paths: DataFrame | None = None) -> DataFrame:
    """severity, rule, page, detail of every finding, in no order: a filter on rules leaves out the work for others. Pages may have
    the `size` of their bodies alone."""
    pages = _sized(pages)
    degree = degrees(graph)
    joined = pages.join(degree, pages["slug"] == degree["node"], "left").withColumn("inbound", F.coalesce("inbound", F.lit(0))).withColumn("outbound", F.coalesce("outbound", F.lit(0)))
    size = F.col("size")
    found = [
        _finding(joined.where("inbound = 0"), "info", "orphan"),
        _finding(joined.where("outbound = 0"), "info", "link-less"),
        _finding(graph.where("dangling").withColumnRenamed("src", "slug"), "warn", "dangling-link", F.col("dst")),
        _finding(pages.where(size < STUB_CHARS), "info", "stub", size.cast("string")),
        _finding(pages.where(size > LARGE_CHARS), "info", "oversized", size.cast("string")),
    ]
    if "fingerprint" in pages.columns:
        found.append(_finding(pages.where(~F.col("fingerprint").eqNullSafe(tx.fingerprint(F.col("sources")))), "warn", "fingerprint-mismatch"))
    if known_sources is not None:
        missing = pages.select("slug", F.explode("sources").alias("id")).where("id IS NOT NULL").distinct().join(known_sources.select("id"), "id", "left_anti")
        found.append(_finding(missing.groupBy("slug").agg(F.count(F.lit(1)).alias("n")), "warn", "broken-provenance", F.col("n").cast("string")))
    if known_paths is not None:
        dead = pages.select("slug", F.explode("paths").alias("path")).join(known_paths.select("path"), "path", "left_anti")
        found.append(_finding(dead, "warn", "dead-artifact", F.col("path")))
    found.append(_finding(close_names(pages, column="slug").union(shared_aliases(pages)).distinct().withColumnRenamed("a", "slug"), "warn", "spelling-drift", F.col("b")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def lint(pages: DataFrame, graph: DataFrame, known_sources: DataFrame | None = None, known_paths: DataFrame | None = None) -> DataFrame:
    """``findings``, warnings first, by rule, page and detail. Most rules read the pages and several the edges, and a sort by range
    reads its input twice, so each of the three is written first."""
    found = findings(materialise(_sized(pages), "linted"), materialise(graph, "edges"), known_sources, known_paths)
    out = materialise(found, "findings")
    return out.orderBy(F.when(F.col("severity") == "warn", 0).otherwise(1), "rule", "page", "detail")


def pending_units(dream_ledger: DataFrame, wiki_ledger: DataFrame, as_of: Column, keys: list[str], hours: int = PENDING_HOURS) -> DataFrame:
    """Dream units that have content, are old enough and are not compiled into pages as they are now."""
    old = dream_ledger.where((F.size("dream_chunk_ids") > 0) & (F.col("synthesized_at") < as_of - F.make_dt_interval(F.lit(0), F.lit(hours))))
    current = old.withColumn("fp", tx.fingerprint(F.col("dream_chunk_ids")))
    return current.join(wiki_ledger.select(*keys, F.col("fingerprint").alias("wiki_fp")), keys, "left").where(~F.col("fp").eqNullSafe(F.col("wiki_fp"))).drop("wiki_fp")


def index_markdown(pages: DataFrame) -> DataFrame:
    """One line block per kind, newest pages first (see ``index_lines`` for the whole index, a row per line)."""
    line = F.format_string("- [[%s]] %s: %s", F.col("slug"), F.col("title"), F.col("summary"))
    rows = pages.select("kind", F.struct(F.col("updated").alias("u"), F.col("slug").alias("s"), line.alias("l")).alias("r"))
    ordered = F.transform(F.sort_array(F.collect_list("r"), asc=False), lambda x: x["l"])
    return rows.groupBy("kind").agg(F.array_join(ordered, "\n").alias("lines"))


# Kinds of pages in the order of the index.
KINDS = ("project", "decision", "gotcha", "tool", "person", "topic")


def index_lines(pages: DataFrame, graph: DataFrame) -> DataFrame:
    """The index page as rows (section, title, updated, slug, line) in order: the kinds that have pages, in the order of KINDS
    and others by name after them, newest page first, then section `orphans`, the pages that no page links to, by slug. The sort
    is by range, so no section is gathered in one task."""
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0).cast("bigint")), F.lit(len(KINDS) + 1)).cast("int")
    line = F.concat(F.lit("- [["), "slug", F.lit("]] — "), F.coalesce(F.nullif("summary", F.lit("")), "title"))
    listed = pages.select(order.alias("section"), F.col("kind").alias("title"), F.coalesce(F.col("updated").cast("string"), F.lit("")).alias("updated"), "slug", line.alias("line"))
    linked = graph.where("NOT dangling").select(F.col("dst").alias("slug")).distinct()
    orphans = pages.join(linked, "slug", "left_anti").select(F.lit(len(KINDS) + 2).alias("section"), F.lit("orphans").alias("title"), F.lit("").alias("updated"), "slug", line.alias("line"))
    return listed.union(orphans).orderBy("section", "title", F.desc("updated"), "slug")


def status(pages: DataFrame, graph: DataFrame) -> DataFrame:
    """kind, pages, links out of them, and orphans, pages that no page links to."""
    degree = degrees(graph).withColumnRenamed("node", "slug")
    links = graph.groupBy(F.col("src").alias("slug")).agg(F.count(F.lit(1)).alias("links"))
    rows = pages.select("slug", "kind").join(links, "slug", "left").join(degree.select("slug", "inbound"), "slug", "left")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.coalesce("links", F.lit(0))).alias("links"), F.count_if(F.coalesce("inbound", F.lit(0)) == 0).alias("orphans"))


def containment(units: DataFrame, tokens: DataFrame) -> DataFrame:
    """Artifact tokens that occur verbatim in a unit's text: equi-join on the unit, then a substring test."""
    return units.join(tokens, "unit").where(F.contains("text", F.col("token")))
