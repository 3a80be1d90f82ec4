"""Many phrases in many texts: one pass over the texts for each block of phrases.

The phrases of a block, bounded in bytes, go to the tasks as an Aho-Corasick automaton, which finds all of them while it reads
a text once, however many there are. No text is shuffled and no pair of text and phrase is formed that does not occur. A
dictionary beyond one block takes further passes; the driver holds one block at a time, and each pass but the last is written.

Null texts hold nothing; phrases count in lower case and from three characters on; repeated phrases count once."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.shared import materialise, steps
from . import graph

LEAST = 3  # characters
BLOCK_BYTES = 8 << 20
MOST_SLUGS = 1000  # of one phrase; one of more pages names none of them

# Stretches of Markdown in which nothing is linked.
PROTECTED = (r"```[\s\S]*?```", r"~~~[\s\S]*?~~~", r"`[^`]*`", r"\[\[[^\]]*\]\]", r"\[[^\]]*\]\([^)]*\)")
_GUARDS = [re.compile(p) for p in PROTECTED]
_WORD = re.compile("[A-Za-z0-9_]")


def lowered(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _blocks(phrases: DataFrame, columns: list[str], block_bytes: int) -> tuple[int, Iterator[list]]:
    """How many blocks of a dictionary (phrase, ...), and their rows; slugs of a phrase count as well."""
    held = F.octet_length("phrase") + 32
    if "slugs" in columns:
        held = held + F.aggregate("slugs", F.lit(0), lambda a, s: a + F.octet_length(s) + 8)
    size = phrases.agg(F.sum(held)).first()[0] or 0
    n = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    block = F.pmod(F.xxhash64("phrase"), F.lit(n))
    return n, (phrases.where(block == k).select(*columns).collect() for k in range(n))


def _automaton(phrases: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, phrase in enumerate(phrases):
        found.add_word(phrase, k)
    if phrases:
        found.make_automaton()
    return found


def contained(items: DataFrame, phrases: DataFrame, id_col: str = "id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, phrase: which phrases (phrase) a text holds anywhere, inside words too; each once for a text."""
    known = materialise(phrases.select(F.lower("phrase").alias("phrase")).where(F.length("phrase") >= LEAST).distinct(), "phrases")
    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(id_col).alias("id"), F.lower(F.col(text_col).cast("string")).alias("text"))
    n, blocks = _blocks(known, ["phrase"], block_bytes)
    out = None
    for block in blocks:
        names = [r[0] for r in block]

        def scan(batches, names=names):
            import pyarrow as pa

            held = _automaton(names)
            for batch in steps(batches, 1) if names else ():
                at, found = [], []
                for r, text in enumerate(batch.column(1).to_pylist()):
                    if text:
                        own = {k for _, k in held.iter(text)}
                        at += [r] * len(own)
                        found += [names[k] for k in own]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], ["id", "phrase"])

        part = rows.mapInArrow(scan, f"id {kind}, phrase string")
        part = materialise(part, "contained") if n > 1 else part  # and the block can go
        out = part if out is None else out.union(part)
    return out.withColumnRenamed("id", id_col)


def names_of(pages: DataFrame) -> DataFrame:
    """phrase, slug: titles and aliases of pages (slug, title, aliases) in lower case, without white space around them."""
    every = pages.select("slug", F.explode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("phrase"))
    return every.select(F.lower(F.trim("phrase")).alias("phrase"), "slug").where(F.length("phrase") >= LEAST).distinct()


def candidate_pages(items: DataFrame, pages: DataFrame, hits: DataFrame, cap: int = 8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, slug, place of at most `cap` pages for each item (item_id, text): ranked hits (item_id, slug, rank) first, then
    pages whose title or an alias occurs in the item, by slug."""
    # An item with h hits has room for cap - h other pages, the first by slug. Before any of those come at most h hits and the
    # others themselves, so it is among the first `cap` pages of its phrase: no more are joined, however many pages share one.
    first = F.row_number().over(Window.partitionBy("phrase").orderBy("slug"))
    names = materialise(names_of(pages).withColumn("_n", first).where(F.col("_n") <= cap).drop("_n"), "names")
    held = contained(items, names.select("phrase"), "item_id", "text", block_bytes)
    named = held.join(names, "phrase").select("item_id", "slug", F.lit(1 << 30).alias("rank"))
    once = hits.select("item_id", "slug", F.col("rank").cast("int")).union(named).groupBy("item_id", "slug").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("rank", "slug"))
    return once.withColumn("place", place).where(F.col("place") <= cap).select("item_id", "slug", "place")


def mentions(body: str, low: str, held, names: list) -> list[tuple[str, int, list[str]]]:
    """(phrase, start, slugs) of the whole-word occurrences of a block's phrases outside protected stretches, each phrase's
    first ones up to the first after which another occurrence could not matter: all that do not overlap."""
    guarded = [m.span() for g in _GUARDS for m in g.finditer(body)]
    free = bytearray(len(body) + 1)
    for a, b in guarded:
        free[a:b] = b"\1" * (b - a)
    out, last = [], {}
    for end, k in held.iter(low):
        phrase, slugs = names[k]
        end += 1
        start = end - len(phrase)
        if start < last.get(k, 0):
            continue  # overlaps an occurrence of its own
        last[k] = end
        if (start and _WORD.match(body[start - 1])) or (end < len(body) and _WORD.match(body[end])) or 1 in free[start:end]:
            continue
        out.append((phrase, start, slugs))
    return out


def linked(body: str, found: list[tuple[str, int, list[str]]], own: str, known: set[str]) -> tuple[str, list[str]]:
    """The body with one link for each page that its phrases name: longer phrases first, then by the alphabet, each at its first
    place that no link has taken. A phrase of several pages, the page itself and those it links already left out, names none."""
    by: dict[str, tuple[list[int], list[str]]] = {}
    for phrase, start, slugs in found:
        by.setdefault(phrase, ([], slugs))[0].append(start)
    taken: list[tuple[int, int, str]] = []
    done: set[str] = set()
    for phrase in sorted(by, key=lambda p: (-len(p), p)):
        starts, slugs = by[phrase]
        left = [s for s in slugs if s != own and s not in known]
        if len(left) != 1 or left[0] in done:
            continue
        for start in sorted(starts):
            end = start + len(phrase)
            if all(end <= a or b <= start for a, b, _ in taken):
                taken.append((start, end, left[0]))
                done.add(left[0])
                break
    out, at, added = [], 0, []
    for a, b, slug in sorted(taken):
        out += [body[at:a], f"[[{slug}]]" if body[a:b] == slug else f"[[{slug}|{body[a:b]}]]"]
        at = b
        added.append(slug)
    return "".join(out) + body[at:], added


def autolink_pages(pages: DataFrame, targets: DataFrame | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The pages (slug, body, ...) with links to the targets (slug, title, aliases, ordinal; the pages themselves where none are
    given) at their first free mentions, and `added`, the slugs linked in the order of the text. The links that a page has are
    resolved through aliases; mentions inside code, links and words are left alone."""
    targets = pages if targets is None else targets
    names = materialise(names_of(targets), "names")
    links = graph.page_links(pages).join(graph.resolution(targets).withColumnRenamed("name", "target"), "target").groupBy(F.col("src").alias("slug")).agg(F.collect_set("slug").alias("_known"))
    links = materialise(links, "known")
    # A phrase links where one slug is left of its own, and a page takes away itself and those it links: with more than two
    # beyond the most links of a page, a phrase can link nowhere.
    most = min(MOST_SLUGS, 2 + (links.agg(F.max(F.size("_known"))).first()[0] or 0))
    few = names.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).select("phrase")
    known = materialise(names.join(few, "phrase").groupBy("phrase").agg(F.sort_array(F.collect_list("slug")).alias("slugs")), "phrases")
    rows = pages.join(links, "slug", "left")
    mention = "array<struct<phrase:string,start:int,slugs:array<string>>>"
    n, blocks = _blocks(known, ["phrase", "slugs"], block_bytes)
    rows = rows.withColumn("_found", F.array().cast(mention)).withColumn("added", F.array().cast("array<string>"))
    for k, block in enumerate(blocks):
        held_names = [(r[0], r[1]) for r in block]

        def scan(batches, names=held_names, last=k == n - 1):
            import pyarrow as pa

            held = _automaton([p for p, _ in names])
            for batch in steps(batches, "body"):
                columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
                bodies = columns["body"].to_pylist()
                found = [[(m["phrase"], m["start"], m["slugs"]) for m in f] for f in columns["_found"].to_pylist()]
                if names:
                    found = [f + mentions(b, lowered(b), held, names) if b else f for f, b in zip(found, bodies)]
                if last:
                    made = [linked(b, f, s, set(o or ())) if b else (b, []) for b, f, s, o in zip(bodies, found, columns["slug"].to_pylist(), columns["_known"].to_pylist())]
                    columns["body"] = pa.array([b for b, _ in made], columns["body"].type)
                    columns["added"] = pa.array([a for _, a in made], columns["added"].type)
                    found = [[] for _ in found]
                columns["_found"] = pa.array([[{"phrase": p, "start": s, "slugs": g} for p, s, g in f] for f in found], columns["_found"].type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        rows = rows.mapInArrow(scan, rows.schema)
        rows = materialise(rows, "mentions") if k < n - 1 else rows
    return rows.drop("_found", "_known")
