"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as ECMAScript's \s has it.
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
PROSE_CHARS, TOOL_CHARS = 4, 3  # characters that count as a token
URL = r"https?://[^\s\"'<>)\]]+"
PULL_REQUEST = r"github\.com/[^/]+/[^/]+/pull/[0-9]+"


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def normalize(c: Column) -> Column:
    return F.lower(collapse(c))


def content_sha(c: Column) -> Column:
    return F.sha2(c, 256)


def chunk_id(trajectory: Column, index: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws(":", trajectory, index.cast("string"), normalize(content)), 256)


def injected_id(owner: Column, doc: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("\n", owner, doc, content), 256)


def fingerprint(ids: Column) -> Column:
    """sha256 of the sorted ids, one per line."""
    return F.sha2(F.array_join(F.array_sort(ids), "\n"), 256)


def estimate_tokens(c: Column, per_token: int = PROSE_CHARS) -> Column:
    return F.ceil(F.length(c) / F.lit(per_token)).cast("long")


def truncate(c: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def snippet(c: Column, n: int = 600) -> Column:
    return truncate(collapse(c), n)


def intent_prefix(c: Column, n: int = 100) -> Column:
    return F.concat(F.lit("USER: "), truncate(collapse(c), n))


def head_tail(c: Column, head: int = 6000, tail: int = 2000, mark: str = "\n…\n") -> Column:
    """The whole text, or its head and tail around a mark."""
    return F.when(F.length(c) <= head + tail, c).otherwise(F.concat(F.substring(c, 1, head), F.lit(mark), F.substring(c, -tail, tail)))


def first_sentence(c: Column, cap: int = 200) -> Column:
    one = collapse(c)
    found = F.regexp_extract(one, r"^(.*?[.!?])(?:\s|$)", 1)
    whole = F.when(found != "", found).otherwise(one)
    return F.when(F.length(whole) > cap, F.concat(F.rtrim(F.substring(whole, 1, cap)), F.lit("…"))).otherwise(whole)


def query_terms(c: Column) -> Column:
    """Distinct alphanumeric terms of two characters or more, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: F.length(t) >= 2))


def valid_slug(c: Column) -> Column:
    return c.rlike("^[a-z0-9-]{1,64}$")


def hex_id(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{40,64}$")


_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def slugify(c: Column) -> Column:
    """Kebab case of at most 64 characters; Latin-1 letters lose their accents (see ``segments.slugify`` for all of Unicode)."""
    plain = F.translate(F.lower(c), _ACCENTED, _PLAIN)
    dashed = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(dashed, 1, 64), "-+$", "")


def wikilinks(body: Column) -> Column:
    """Distinct link targets outside fenced blocks, as slugs."""
    bare = F.regexp_replace(F.regexp_replace(body, r"(?s)```.*?```", ""), r"(?s)~~~.*?~~~", "")
    raw = F.transform(F.regexp_extract_all(bare, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1)), lambda x: F.trim(x))
    return F.array_distinct(F.filter(F.transform(raw, lambda x: F.when(valid_slug(x), x).otherwise(slugify(x))), lambda x: x != ""))


def strip_id_citations(body: Column) -> Column:
    named = F.regexp_replace(body, r"\[\[([0-9a-f]{40,64})\|([^\]]*)\]\]", "$2")
    return F.regexp_replace(named, r" ?\[\[[0-9a-f]{40,64}\]\]", "")


def cited_indices(answer: Column, most: Column) -> Column:
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(found, lambda n: (n >= 1) & (n <= most)))


def urls(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(URL), F.lit(0))


def url_host(c: Column) -> Column:
    return F.lower(F.try_parse_url(c, F.lit("HOST")))


# Hosts whose URLs are no artifacts.
DENIED_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "[::1]", "api.openai.com")


def public_host(c: Column, denied: tuple[str, ...] = DENIED_HOSTS) -> Column:
    host = url_host(c)
    return host.isNotNull() & ~host.isin(*denied)


def repo_of(cwd: Column) -> Column:
    return F.element_at(F.split(F.rtrim(cwd, F.lit("/")), "/"), -1)


def project_dir(name: Column) -> Column:
    """The path that a project folder's name stands for: a name with a leading dash has dashes for slashes."""
    return F.when(name.startswith("-"), F.translate(name, "-", "/")).otherwise(name)


def edit_share(a: Column, b: Column) -> Column:
    """Edit distance over the longer length."""
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def ask_outcome(answer: Column, cited: Column) -> Column:
    return F.when(answer.isNull(), "no_candidates").when(F.size(cited) == 0, "not_covered").otherwise("answered")


def verdict(c: Column) -> Column:
    known = F.lower(F.trim(c))
    return F.when(known.isin("supported", "partial", "unsupported"), known).otherwise("unsupported")


def age_label(ts: Column, as_of: Column) -> Column:
    """'now', minutes, hours or days before as_of."""
    s = F.greatest(F.lit(0), F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 1_000_000))
    return (
        F.when(s < 60, F.lit("now"))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h")))
        .otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit("d")))
    )


def day_label(ts: Column, as_of: Column) -> Column:
    """'today' or the whole days before as_of."""
    days = F.floor(age_days(ts, as_of))
    return F.when(days <= 0, F.lit("today")).otherwise(F.concat(days.cast("string"), F.lit("d ago")))


def age_days(ts: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(86_400_000_000.0)


def placeholder_caption(media: Column, size: Column) -> Column:
    return F.concat(F.lit("["), media, F.lit(", "), F.greatest(F.lit(1), F.round(size / 1024)).cast("long").cast("string"), F.lit(" KB]"))


def image_facts(data: Column) -> Column:
    """sha256 and size of base64 image data."""
    raw = F.unbase64(data)
    return F.struct(F.sha2(raw, 256).alias("sha256"), F.octet_length(raw).alias("bytes"))
