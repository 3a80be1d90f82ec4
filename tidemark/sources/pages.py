"""Compiled pages as markdown files with a front matter block.

In a folder that driver and executors mount, tasks write slug.md files themselves, into hidden folders of FOLDER_FILES files at
most; the driver shows those of the attempts that counted. Reading takes a task for each such folder, so the driver lists folders
and never files. Elsewhere Spark's writer makes a folder per slug."""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .shared import steps

FOLDER_FILES = 1_000
FOLDER = re.compile(r"pages-[0-9a-f]{32}")
KINDS = ("topic", "entity", "decision", "howto")
KEYS = ("schema", "title", "kind", "summary", "aliases", "sources", "trajectories", "fingerprint", "created", "updated")
PAGE = "slug string, schema int, title string, kind string, summary string, aliases array<string>, sources array<string>, trajectories array<string>, fingerprint string, created string, updated string, body string"


def parse_page(slug: str, text: str) -> dict:
    """Front matter of `key: JSON` lines; a bad kind becomes topic, a missing title the slug; bad values are left out."""
    fields: dict = {}
    m = re.match(r"---\n(.*?)\n---\n?(.*)\Z", text, re.S)
    for line in m[1].splitlines() if m else ():
        key, _, value = line.partition(":")
        try:
            fields[key.strip()] = json.loads(value)
        except ValueError:
            fields[key.strip()] = value.strip()
    strings = lambda k: [str(x) for x in fields[k]] if isinstance(fields.get(k), list) else []
    word = lambda k: str(fields.get(k) or "")
    return {
        "slug": slug, "schema": fields["schema"] if isinstance(fields.get("schema"), int) else 1, "title": word("title") or slug, "kind": fields["kind"] if fields.get("kind") in KINDS else "topic", "summary": word("summary"),
        "aliases": strings("aliases"), "sources": strings("sources"), "trajectories": strings("trajectories"), "fingerprint": word("fingerprint"), "created": word("created"), "updated": word("updated"), "body": m[2] if m else text,
    }


def render_page(page: dict) -> str:
    """The same bytes for the same page: fixed key order, sources and trajectories sorted, values as JSON."""
    value = lambda k: sorted(page[k]) if k in ("sources", "trajectories") else list(page[k]) if k == "aliases" else page[k]
    return "---\n" + "".join(f"{k}: {json.dumps(value(k), ensure_ascii=False)}\n" for k in KEYS) + "---\n" + page["body"]


def _mounted(spark: SparkSession, root: str) -> str | None:
    """The path of root where Hadoop takes it for a mounted folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    local = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getUri().getScheme() == "file"
    return path.toUri().getPath() if local and path.isAbsolute() else None


def _parsed(slugs: list[str], texts: list[str]) -> pa.RecordBatch:
    text, texts_of = pa.string(), pa.list_(pa.string())
    types = {"int": pa.int32(), "string": text, "array<string>": texts_of}
    return pa.RecordBatch.from_pylist([parse_page(s, t) for s, t in zip(slugs, texts)], pa.schema([(x.split()[0], types[x.split()[1]]) for x in PAGE.split(", ")]))


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """Pages of the files below root: slug.md, or as ``write_pages`` lays them out."""
    mounted = _mounted(spark, root)
    names = sorted(n for n in os.listdir(mounted) if n[0] not in "._") if mounted and os.path.isdir(mounted) else []
    if names and all(FOLDER.fullmatch(n) for n in names):
        return _read_folders(spark, mounted, names)
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").text(root, wholetext=True)
    slug = F.regexp_extract("_metadata.file_path", r"(?:slug=([a-z0-9-]{1,64})/[^/]*\.txt|/([a-z0-9-]{1,64})\.md)$", 0)
    files = files.select(F.regexp_extract(slug, r"^(?:slug=|/)([a-z0-9-]{1,64})", 1).alias("slug"), F.when(slug.startswith("/"), F.col("value")).otherwise(F.regexp_replace("value", r"\n\z", "")).alias("value")).where("slug <> ''")

    def parse(batches):
        for rows in steps(batches, "value"):
            yield _parsed(rows.column(0).to_pylist(), rows.column(1).to_pylist())

    return files.mapInArrow(parse, PAGE)


def _read_folders(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    def parse(batches):
        for name in (n for rows in batches for n in rows.column(1).to_pylist()):
            slugs, texts, size = [], [], 0
            for file in sorted(os.listdir(f"{root}/{name}")):
                if not re.fullmatch(r"[a-z0-9-]{1,64}\.md", file):
                    continue
                with open(f"{root}/{name}/{file}", "rb") as f:
                    data = f.read()
                if size and size + len(data) > shared.STEP_BYTES:
                    yield _parsed(slugs, texts)
                    slugs, texts, size = [], [], 0
                slugs.append(file[:-3])
                texts.append(data.decode("utf-8", "replace"))
                size += len(data)
            yield _parsed(slugs, texts)

    rows = spark.createDataFrame(list(enumerate(names)), "n int, name string")
    return rows.repartitionById(len(names), F.col("n")).mapInArrow(parse, PAGE)


def rendered(pages: DataFrame) -> DataFrame:
    """slug, text of every page."""

    def render(batches):
        for rows in steps(batches, "body"):
            yield pa.RecordBatch.from_arrays([rows.column("slug").cast(pa.string()), pa.array([render_page(r) for r in rows.to_pylist()], pa.string())], ["slug", "text"])

    return pages.mapInArrow(render, "slug string, text string")


def write_pages(pages: DataFrame, root: str) -> None:
    """A file for each page below root, which holds nothing else afterwards. Pages of one slug are files of different folders."""
    mounted = _mounted(pages.sparkSession, root)
    if mounted is None:
        rendered(pages).write.mode("overwrite").partitionBy("slug").text(root)
        return

    def write(batches):
        made: list[set[str]] = []  # of each open folder the files
        names: list[str] = []

        def full(k):
            yield pa.RecordBatch.from_arrays([pa.array([names.pop(k)])], ["name"])
            made.pop(k)

        for batch in batches:
            for slug, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = "__none__" if slug is None else quote(slug, safe="") + ".md"
                k = next((k for k, files in enumerate(made) if file not in files), len(made))
                if k == len(made):
                    made.append(set())
                    names.append(f"pages-{uuid.uuid4().hex}")
                    os.makedirs(f"{mounted}/.{names[k]}")
                with open(f"{mounted}/.{names[k]}/{file}", "wb") as out:
                    out.write(text.encode())
                made[k].add(file)
                if len(made[k]) >= FOLDER_FILES:
                    yield from full(k)
        while names:
            yield from full(0)

    os.makedirs(mounted, exist_ok=True)
    names = [r["name"] for r in rendered(pages).mapInArrow(write, "name string").collect()]  # one for FOLDER_FILES pages
    for old in os.listdir(mounted):
        if old.removeprefix(".") not in names:
            path = f"{mounted}/{old}"
            shutil.rmtree(path) if os.path.isdir(path) and not os.path.islink(path) else os.remove(path)
    for name in names:
        os.rename(f"{mounted}/.{name}", f"{mounted}/{name}")
