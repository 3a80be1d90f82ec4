"""Personal data by weak supervision, in DataFrame functions only (operator 4).

Four kinds of spans are found by fixed patterns (the base). Wider patterns propose further candidates: spelt-out
addresses, numbers without a country prefix, cards with other separators or a failed check, IPv6. Five labelers
vote on every candidate: a strict shape, a gazetteer, a validity rule, a cue before it, and a counter-cue. Expectation
maximisation over the counted vote patterns estimates how reliable each labeler is; the posteriors train a logistic
span classifier, whose weights become column expressions. The base spans always stay; what the classifier accepts
and no base span overlaps is added; a span that fails its validity rule needs a cue besides.

The driver sees counts by vote pattern only: 5 * 3^5 rows at most, whatever the input. Texts are searched once: places
and votes (no text) are written to the shared folder, where both the training and the detection read them.

Patterns are written so that they find what the plain ones find while long runs take linear time and no deep stack
(possessive loops; starts only where a run begins or a match has just ended).

Defined cases: null text counts as empty; very long texts are searched whole, by the JVM, in the task that reads them;
texts without matches have empty spans, counts 0 and the digest of the empty text; an added span that overlaps a base span of
its kind goes, and of added ones that overlap each other, found by different patterns, all stay, by start, then end; repeated rows and null ids are treated each for itself; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise, quoted

KINDS = ("email", "ip", "card", "phone")

# The base patterns, in Java's syntax.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{2,63}+(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]{2,63}+){1,4}+",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){5,7}+[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[. -])[0-9]{3}[. -][0-9]{4}(?![0-9A-Za-z])",
}
GUARD = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.contains(t, F.lit(".")) & t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
WIDE_GUARD = {
    "email": lambda t: t.rlike(r"[(\[{]at[)\]}]"),
    "ip": lambda t: t.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:"),
    "card": lambda t: t.rlike(r"[0-9]{4}[./_][0-9]{4}[./_]"),
    "phone": lambda t: t.rlike(r"[0-9]{3}[. -][0-9]{4}"),
}
CUES = {
    "email": r"(?:e-?mail|mail|contact|write|reach|address|adresse|correo|kontakt)[^a-z]{0,3}(?:\w+ ){0,2}$",
    "ip": r"(?:ip|host|server|address|addr|login|from|client)[^a-z]{0,3}(?:\w+ ){0,1}$",
    "card": r"(?:card|visa|credit|debit|payment|karte|tarjeta|carte|account|acct)[^a-z]{0,3}(?:\w+ ){0,2}$",
    "phone": r"(?:phone|tel|telephone|call|mobile|cell|fax|telefon|teléfono|contact|number)[^a-z]{0,4}(?:\w+ ){0,2}$",
}
COUNTER_CUES = r"(?:version|order|isbn|issn|ref|sku|build|invoice|serial|release|rev|ticket|commit|hash|page)[^a-z]{0,3}(?:\w+ ){0,1}$"
DOMAINS = r"(?i)(?:com|net|org|edu|gov|info|io|co|uk|de|fr|es|it|eu|us|ca)$"
CALLING = r"^\+?(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|36|6011|65)"
CONTEXT = 28
LABELERS = ("shape", "gazetteer", "valid", "cue", "counter")
SEPARATOR = "\n"


def _of(function, kind: str):
    """A function of one argument, with the kind filled in."""
    return lambda x: function(kind, x)


def _spans(text: Column, pattern: str, guard: Column) -> tuple[Column, Column]:
    """The matches, and the pieces between them."""
    none = F.array().cast("array<string>")
    return F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), F.when(guard, F.split(text, pattern, -1)).otherwise(none)


def _placed(matches: Column, pieces: Column) -> Column:
    """array<struct<s, e, m>> with code point offsets, from the running lengths of pieces and matches."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("found"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["g"])
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.when(x["m"].isNull(), F.array().cast("array<struct<s:int,e:int,m:string>>")).otherwise(F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))))
        return F.struct(e.alias("at"), F.concat(acc["found"], one).alias("found"))

    return F.aggregate(F.zip_with(pieces, matches, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), start, add, lambda acc: acc["found"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)

    def add(acc: Column, i: Column) -> Column:
        x = F.coalesce(F.substring(d, -i, F.lit(1)).try_cast("int"), F.lit(0)) * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return (F.length(d) > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), add) % 10 == 0)


def _small_parts(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))


VALID = {
    "email": lambda m: F.lit(True),
    "ip": _small_parts,
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _votes(kind: str, text: Column, span: Column) -> Column:
    """One character per labeler: + for, - against, 0 no vote."""
    m, d = span["m"], _digits(span["m"])
    before = F.lower(F.substring(text, F.greatest(span["s"] - CONTEXT, F.lit(0)) + 1, F.least(span["s"], F.lit(CONTEXT))))
    yes = lambda c: F.when(c, "+").otherwise("-")
    shape = {
        "email": m.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*[ (\[{@].*[A-Za-z]{2,6}$"),
        "ip": m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$|^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$"),
        "card": F.length(d).isin(13, 15, 16, 19) & ~m.rlike(r"[ -][0-9]{1,2}[ -]"),
        "phone": m.rlike(r"^(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4})?$"),
    }[kind]
    gazetteer = {
        "email": yes(m.rlike(DOMAINS)),
        "ip": yes(F.when(F.contains(m, F.lit(":")), m.rlike("(?i)^(?:2|3|f[cde])")).otherwise(~m.rlike(r"^0*(?:0|22[4-9]|2[3-5][0-9])\."))),
        "card": yes(d.rlike(ISSUERS)),
        "phone": F.when(m.startswith("+"), yes(m.rlike(CALLING))).otherwise(F.when(d.rlike("^[2-9]"), "+").otherwise("-")),
    }[kind]
    valid = {
        "email": yes(~m.rlike(r"\.\.|^[.]|-$")),
        "ip": yes(F.when(F.contains(m, F.lit(":")), m.rlike("[1-9A-Fa-f]")).otherwise(_small_parts(m))),
        "card": yes(F.length(d).between(13, 19) & _luhn(m)),
        "phone": yes(F.length(d).between(9, 15)),
    }[kind]
    cue = F.when(before.rlike(CUES[kind]), "+").otherwise("0")
    counter = F.when(before.rlike(COUNTER_CUES), "-").otherwise("0")
    return F.concat(yes(shape), gazetteer, valid, cue, counter)


def _found(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """i and, per kind, b_kind (base spans) and c_kind (every candidate with its votes)."""
    rows = df.select(quoted(id_col).cast("long").alias("i"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("t"))
    t = F.col("t")
    raw = {}
    for k in KINDS:
        raw[f"m_{k}"], raw[f"g_{k}"] = _spans(t, BASE[k], GUARD[k](t))
        raw[f"wm_{k}"], raw[f"wg_{k}"] = _spans(t, WIDER[k], WIDE_GUARD[k](t))
    rows = rows.withColumns(raw)
    rows = rows.select("i", "t", *[_placed(F.col(f"m_{k}"), F.col(f"g_{k}")).alias(f"a_{k}") for k in KINDS], *[_placed(F.col(f"wm_{k}"), F.col(f"wg_{k}")).alias(f"w_{k}") for k in KINDS])
    base = {f"b_{k}": F.filter(f"a_{k}", _of(lambda k, x: VALID[k](x["m"]), k)) for k in KINDS}
    rows = rows.withColumns(base)
    voted = lambda k: F.transform(F.concat(f"a_{k}", f"w_{k}"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), _votes(k, t, x).alias("v")))
    places = lambda k: F.transform(f"b_{k}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    return rows.select("i", *[places(k).alias(f"b_{k}") for k in KINDS], *[voted(k).alias(f"c_{k}") for k in KINDS])


def reliabilities(counts: dict[str, int], rounds: int = 50) -> tuple[float, list[float], dict[str, float]]:
    """Expectation maximisation over vote patterns: share of real spans, accuracy of each labeler, posteriors."""
    n = len(LABELERS)
    prior, right = 0.5, [0.8] * n
    post: dict[str, float] = {}
    for _ in range(rounds):
        for pattern in counts:
            log = math.log(prior) - math.log(1 - prior)
            for v, r in zip(pattern, right):
                if v != "0":
                    log += (1 if v == "+" else -1) * (math.log(r) - math.log(1 - r))
            post[pattern] = 1 / (1 + math.exp(-max(-50, min(50, log))))
        total = sum(counts.values())
        if not total:
            break
        prior = min(0.98, max(0.02, (1 + sum(c * post[p] for p, c in counts.items())) / (2 + total)))
        for k in range(n):
            voted = [(c, post[p] if p[k] == "+" else 1 - post[p]) for p, c in counts.items() if p[k] != "0"]
            right[k] = min(0.98, max(0.55, (4 + sum(c * x for c, x in voted)) / (5 + sum(c for c, _ in voted))))
    return prior, right, post


def classifier(counts: dict[str, int], post: dict[str, float], rounds: int = 300) -> list[float]:
    """Logistic regression of the posteriors on the votes (+1, -1, 0): bias and one weight per labeler."""
    weights = [0.0] * (len(LABELERS) + 1)
    total = max(1, sum(counts.values()))
    code = {"+": 1.0, "-": -1.0, "0": 0.0}
    rows = [([1.0, *(code[v] for v in p)], c / total, post[p]) for p, c in counts.items()]
    for _ in range(rounds):
        slope = [0.0] * len(weights)
        for x, c, y in rows:
            z = sum(w * v for w, v in zip(weights, x))
            q = 1 / (1 + math.exp(-max(-50, min(50, z))))
            for k, v in enumerate(x):
                slope[k] += c * (y - q) * v
        weights = [w + 2.0 * (s - 0.002 * w) for w, s in zip(weights, slope)]
    return weights


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, list[float]]:
    """Weights of the span classifier by kind, from the votes on all candidates of df."""
    return _weights(_found(df, id_col, text_col))


def _weights(found: DataFrame) -> dict[str, list[float]]:
    every = F.concat(*[F.transform(f"c_{k}", _of(lambda k, x: F.concat(F.lit(f"{k}:"), x["v"]), k)) for k in KINDS])
    got = found.select(F.explode(every).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for k in KINDS:
        counts = {p.partition(":")[2]: n for p, n in got if p.partition(":")[0] == k}
        _, _, post = reliabilities(counts)
        out[k] = classifier(counts, post)
    return out


def detect(df: DataFrame, weights: dict[str, list[float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and added: arrays of struct<kind, start, end> in the order of KINDS and of start."""
    return _decided(_found(df, id_col, text_col), weights, id_col)


def _decided(found: DataFrame, weights: dict[str, list[float]], id_col: str) -> DataFrame:
    def accepted(k: str) -> Column:
        vote = lambda x, j: F.when(F.substring(x["v"], j + 1, 1) == "+", 1.0).when(F.substring(x["v"], j + 1, 1) == "-", -1.0).otherwise(0.0)

        def good(x: Column) -> Column:
            z = F.lit(weights[k][0])
            for j in range(len(LABELERS)):
                z = z + F.lit(weights[k][j + 1]) * vote(x, j)
            clear = F.col(f"b_{k}")
            sound = (F.substring(x["v"], 3, 1) == "+") | (F.substring(x["v"], 4, 1) == "+")  # a failed check needs a cue
            return (z > 0) & sound & ~F.exists(clear, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))

        return F.filter(f"c_{k}", good)

    named = lambda k, a: F.transform(a, lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("start"), x["e"].alias("end")))
    added = {f"x_{k}": F.array_sort(F.array_distinct(named(k, accepted(k)))) for k in KINDS}
    rows = found.withColumns(added)
    return rows.select(
        F.col("i").alias(id_col),
        F.concat(*[named(k, F.col(f"b_{k}")) for k in KINDS]).alias("base"),
        F.concat(*[F.col(f"x_{k}") for k in KINDS]).alias("added"),
        F.concat(*[F.array_sort(F.concat(named(k, F.col(f"b_{k}")), F.col(f"x_{k}"))) for k in KINDS]).alias("all"),
    )


def _text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts of base spans by kind, digest of the base spans, all spans as text."""
    places = materialise(_found(df, id_col, text_col), "pii-places")
    found = _decided(places, _weights(places), id_col)
    counts = [F.size(F.filter("base", _of(lambda k, x: x["kind"] == k, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(quoted(id_col), *counts, F.sha2(_text("base"), 256).alias("base_sha256"), _text("all").alias("spans"))


#: Counts of the base spans, by the plain patterns.
COUNTS_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
  list_transform(regexp_extract_all(t, '[0-9]([ -]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card, list_transform(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone FROM t)
SELECT doc_id, len(email) AS n_email,
  len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: coalesce(TRY_CAST(ltrim(p, '0') || '' AS BIGINT), CASE WHEN ltrim(p, '0') = '' THEN 0 ELSE 999 END) > 255)) = 0)) AS n_ip,
  len(list_filter(card, lambda d: length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(d[length(d) - i + 1] AS INTEGER)
    WHEN CAST(d[length(d) - i + 1] AS INTEGER) > 4 THEN 2 * CAST(d[length(d) - i + 1] AS INTEGER) - 9 ELSE 2 * CAST(d[length(d) - i + 1] AS INTEGER) END)) % 10 = 0)) AS n_card,
  len(list_filter(phone, lambda d: length(d) BETWEEN 9 AND 15)) AS n_phone FROM m
"""
