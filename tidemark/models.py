"""Seams for models. Nothing here reaches a network: the defaults are deterministic stand-ins."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embed = Callable[[list[str]], list[list[float]]]


def hashed_embedding(text: str, width: int = 64) -> list[float]:
    """Unit vector of hashed words."""
    out = [0.0] * width
    for word in re.findall(r"\w+", text.lower()):
        h = hashlib.blake2b(word.encode(), digest_size=8).digest()
        out[int.from_bytes(h[:4], "little") % width] += 1.0 if h[4] & 1 else -1.0
    size = math.sqrt(sum(x * x for x in out)) or 1.0
    return [x / size for x in out]


def embed_missing(rows: DataFrame, cache: DataFrame, embed: Embed, model: str, text_col: str = "content", cap: int = 24_000) -> DataFrame:
    """Adds embedding: from the cache (content_sha256, embedding_model, embedding), or by one call per batch of distinct
    contents that it lacks. No content is embedded twice."""
    import pandas as pd

    keyed = rows.withColumn("content_sha256", F.sha2(text_col, 256))
    have = cache.where(F.col("embedding_model") == model).select("content_sha256", "embedding")
    missing = keyed.select("content_sha256", F.substring(text_col, 1, cap).alias("t")).join(have, "content_sha256", "left_anti").dropDuplicates(["content_sha256"])

    def run(batches):
        for part in batches:
            yield pd.DataFrame({"content_sha256": part["content_sha256"], "embedding": embed(list(part["t"]))}, columns=["content_sha256", "embedding"])

    made = missing.mapInPandas(run, T.StructType([T.StructField("content_sha256", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]))
    return keyed.join(have.select("content_sha256", F.col("embedding").cast("array<float>").alias("embedding")).unionByName(made), "content_sha256", "left")


def resolve_captions(images: DataFrame, cache: DataFrame, caption: Callable[[str], str | None], most: int, order: list[str]) -> DataFrame:
    """caption of each image (sha256, media_type, bytes): cached, else called for the first `most` distinct images, else
    a placeholder; only successes are new cache rows (column fresh)."""
    import pandas as pd

    from .functions import text as tx

    missing = images.join(cache.select("sha256"), "sha256", "left_anti").groupBy("sha256").agg(F.min(F.struct(*order)).alias("o")).orderBy("o").limit(most)

    def run(batches):
        for part in batches:
            yield pd.DataFrame({"sha256": part["sha256"], "made": [caption(s) for s in part["sha256"]]}, columns=["sha256", "made"])

    made = missing.select("sha256").mapInPandas(run, "sha256 string, made string").where("made IS NOT NULL")
    joined = images.join(cache.select("sha256", F.col("caption").alias("known")), "sha256", "left").join(made, "sha256", "left")
    text: Column = F.coalesce("known", "made", tx.placeholder_caption(F.col("media_type"), F.col("bytes")))
    return joined.select(*images.columns, text.alias("caption"), (F.col("known").isNull() & F.col("made").isNotNull()).alias("fresh"))


class Fallback:
    """Embeds with the primary until it fails, then with the fallback for the rest of the process. A fallback of another
    width is refused, and the failure stands: vectors of two widths must never meet in one table."""

    def __init__(self, primary: Embed, width: int, fallback: Embed, fallback_width: int) -> None:
        self.active, self.fallback, self.same_width, self.latched = primary, fallback, width == fallback_width, False

    def __call__(self, texts: list[str]) -> list[list[float]]:
        try:
            return self.active(texts)
        except Exception:
            if self.latched or not self.same_width:
                raise
            self.active, self.latched = self.fallback, True
            return self.active(texts)


def resolve_prefixes(items: DataFrame, cache: DataFrame, generate: Callable[[str, str], str]) -> DataFrame:
    """sha, prefix, fresh of the distinct items (sha, chunk, context): cached, or generated once per sha. Those whose
    generation fails are absent, so the caller falls back to the bare chunk; only fresh rows go into the cache."""
    import pandas as pd

    once = items.dropDuplicates(["sha"])
    missing = once.join(cache.select("sha"), "sha", "left_anti").select("sha", "chunk", "context")

    def run(batches):
        for part in batches:
            out = []
            for sha, chunk, around in zip(part["sha"], part["chunk"], part["context"]):
                try:
                    out.append((sha, generate(around, chunk)))
                except Exception:  # noqa: BLE001  a failed prefix is absent
                    continue
            yield pd.DataFrame(out, columns=["sha", "prefix"])

    made = missing.mapInPandas(run, "sha string, prefix string").where("prefix IS NOT NULL").withColumn("fresh", F.lit(True))
    known = once.select("sha").join(cache.select("sha", "prefix"), "sha").withColumn("fresh", F.lit(False))
    return known.unionByName(made)
