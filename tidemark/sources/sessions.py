"""Session logs: JSON lines to messages, trajectories and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

BLOCK = T.StructType([T.StructField(n, k) for n, k in (("type", T.StringType()), ("text", T.StringType()), ("thinking", T.StringType()), ("id", T.StringType()), ("name", T.StringType()), ("input", T.StringType()), ("tool_use_id", T.StringType()), ("content", T.StringType()), ("is_error", T.BooleanType()), ("source", T.StructType([T.StructField("type", T.StringType()), T.StructField("media_type", T.StringType()), T.StructField("data", T.StringType())])))])
LINE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("type", "uuid", "parentUuid", "sessionId", "cwd", "gitBranch", "timestamp")]
    + [T.StructField("isMeta", T.BooleanType()), T.StructField("isSidechain", T.BooleanType()), T.StructField("message", T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))]
)


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """Every line of the *.jsonl files below root (and of the *.txt files that ``write_lines`` makes), with its file and number of lines before it in the file's part."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jsonl,txt}").text(root)
    return lines.select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line_no"))


def write_lines(rows: DataFrame, root: str) -> None:
    """A JSON line for each row's struct `line`."""
    rows.select(F.to_json("line").alias("value")).write.format("text").option("lineSep", "\n").save(root)


def parse_messages(lines: DataFrame) -> DataFrame:
    """Messages of the user and the assistant; unparsable lines, other types and empty messages are skipped."""
    clean = F.regexp_replace(F.col("value"), r"\\u0000", r"\\uFFFD")
    rows = lines.withColumn("m", F.from_json(clean, LINE)).where("m IS NOT NULL AND m.type IN ('user', 'assistant') AND m.message IS NOT NULL")
    raw = F.col("m.message.content")
    blocks = F.when(raw.startswith("["), F.from_json(raw, T.ArrayType(BLOCK))).otherwise(F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), raw.alias("text"))), BLOCK)))
    rows = rows.withColumn("blocks", normal_blocks(blocks))
    ts = F.coalesce(F.try_to_timestamp(F.col("m.timestamp")), F.current_timestamp())
    return rows.where(F.size("blocks") > 0).select(
        "path", "line_no", F.col("m.sessionId").alias("session_id"), F.col("m.uuid").alias("uuid"), F.col("m.type").alias("role"), F.col("m.cwd").alias("cwd"), F.col("m.gitBranch").alias("branch"), ts.alias("ts"),
        F.coalesce("m.isMeta", F.lit(False)).alias("is_meta"), F.coalesce("m.isSidechain", F.lit(False)).alias("is_sidechain"), "blocks",
    )


def normal_blocks(blocks: Column) -> Column:
    """Typed blocks: empty text, redacted thinking and linked images go; a tool result's parts become its text, and
    images inside it become blocks of their own."""
    parts = lambda b: F.when(b["content"].startswith("["), F.from_json(b["content"], T.ArrayType(BLOCK)))
    joined = lambda b: F.coalesce(F.array_join(F.transform(F.filter(parts(b), lambda p: p["type"] == "text"), lambda p: p["text"]), "\n"), b["content"])

    def own(b: Column) -> Column:
        return F.struct(
            b["type"].alias("type"), F.coalesce(b["text"], b["thinking"]).alias("text"), b["name"].alias("name"), b["input"].alias("input"), b["id"].alias("id"), b["tool_use_id"].alias("tool_use_id"),
            F.when(b["type"] == "tool_result", joined(b)).alias("output"), F.coalesce(b["is_error"], F.lit(False)).alias("is_error"), b["source"]["media_type"].alias("media_type"), b["source"]["data"].alias("data"),
        )

    nested = F.flatten(F.transform(blocks, lambda b: F.coalesce(F.when(b["type"] == "tool_result", F.filter(parts(b), lambda p: p["type"] == "image")), F.array().cast(T.ArrayType(BLOCK)))))
    keep = lambda b: (b["type"].isin("text", "thinking") & (F.trim(F.coalesce(b["text"], F.lit(""))) != "")) | b["type"].isin("tool_use", "tool_result") | ((b["type"] == "image") & b["data"].isNotNull())
    return F.filter(F.concat(F.transform(blocks, own), F.transform(nested, own)), keep)


def file_paths(inputs: Column) -> Column:
    """Distinct paths that tool inputs (array of JSON) name."""
    return F.array_distinct(F.filter(F.flatten(F.transform(inputs, lambda j: F.array(*[F.get_json_object(j, f"$.{k}") for k in ("file_path", "path", "notebook_path")]))), lambda x: x.isNotNull() & (x != "")))


def artifacts(names: Column, inputs: Column, text: Column, cap: int = 20) -> Column:
    """Written files, pull requests and other public URLs, distinct, at most cap."""
    kind = lambda k, r, t: F.struct(F.lit(k).alias("kind"), r.alias("ref"), t.alias("tool"))
    files = F.filter(F.transform(F.arrays_zip(names.alias("n"), inputs.alias("i")), lambda z: kind("file", F.coalesce(*[F.get_json_object(z["i"], f"$.{k}") for k in ("file_path", "path", "notebook_path")]), z["n"])), lambda a: a["tool"].isin("Write", "Edit", "MultiEdit", "NotebookEdit") & a["ref"].isNotNull())
    found = F.filter(F.array_distinct(tx.urls(text)), lambda u: tx.public_host(u))
    links = F.transform(found, lambda u: F.struct(F.when(u.rlike(tx.PULL_REQUEST), "pr").otherwise("url").alias("kind"), u.alias("ref"), F.lit("").alias("tool")))
    return F.slice(F.array_distinct(F.concat(files, links)), 1, cap)


def trajectories(messages: DataFrame) -> DataFrame:
    """One row per trajectory: a user message with text opens it; tool results on the opening message are ignored."""
    rows = messages.where("NOT is_meta AND NOT is_sidechain")
    opens = (F.col("role") == "user") & F.exists("blocks", lambda b: b["type"] == "text")
    w = Window.partitionBy("session_id").orderBy("ts", "line_no")
    rows = rows.withColumn("opens", opens).withColumn("n", F.sum(opens.cast("int")).over(w)).where("n > 0")
    usable = F.when(F.col("opens"), F.filter("blocks", lambda b: b["type"] != "tool_result")).otherwise(F.col("blocks"))
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ts", "line_no", "role", usable.alias("blocks")))), lambda m: F.transform(m["blocks"], lambda b: F.struct(m["role"].alias("role"), b.alias("b")))))
    grouped = rows.groupBy("session_id", "n").agg(ordered.alias("all"), F.min_by("cwd", F.struct("ts", "line_no")).alias("cwd"), F.min_by("branch", F.struct("ts", "line_no")).alias("branch"), F.min("ts").alias("ts"))
    texts = lambda t, r: F.transform(F.filter("all", lambda x: (x["b"]["type"] == t) & (x["role"] == r)), lambda x: x["b"]["text"])
    uses, results = F.filter("all", lambda x: x["b"]["type"] == "tool_use"), F.filter("all", lambda x: x["b"]["type"] == "tool_result")

    def call(u: Column) -> Column:
        mine = F.try_element_at(F.filter(results, lambda r: r["b"]["tool_use_id"] == u["b"]["id"]), F.lit(1))
        return F.struct(u["b"]["name"].alias("name"), u["b"]["input"].alias("input"), mine["b"]["output"].alias("output"), F.coalesce(mine["b"]["is_error"], F.lit(False)).alias("is_error"))

    images = F.transform(F.filter("all", lambda x: x["b"]["type"] == "image"), lambda x: F.struct(tx.image_facts(x["b"]["data"])["sha256"].alias("sha256"), x["b"]["media_type"].alias("media_type"), tx.image_facts(x["b"]["data"])["bytes"].alias("bytes")))
    return grouped.select(
        "session_id", "n", "ts", "cwd", tx.repo_of(F.col("cwd")).alias("repo"), "branch", F.array_join(texts("text", "user"), "\n").alias("user_message"), texts("text", "assistant").alias("assistant"),
        texts("thinking", "assistant").alias("thinking"), F.transform(uses, call).alias("tool_calls"), F.array_distinct(images).alias("images"),
    )


def inject(docs: DataFrame, owner: str) -> DataFrame:
    """Any (id, content, source, ts) as chunk rows with content-derived ids."""
    from ..functions.segments import chunks_of

    whole = docs.withColumn("trajectory_id", tx.injected_id(F.lit(owner), F.col("id").cast("string"), F.col("content")))
    parts = whole.withColumn("parts", chunks_of("content")).select("*", F.size("parts").alias("chunk_count"), F.posexplode("parts").alias("chunk_index", "chunk"))
    return parts.select(tx.chunk_id(F.col("trajectory_id"), F.col("chunk_index"), F.col("chunk")).alias("id"), F.lit(owner).alias("owner"), "source", "ts", "trajectory_id", "chunk_index", "chunk_count", F.col("chunk").alias("content"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """id, question, repo of JSON lines; a line without one of the first two fails the job."""
    rows = spark.read.schema("id string, question string, repo string").json(path)
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a question lacks {c}"))).otherwise(F.col(c)).alias(c)
    return rows.select(need("id"), need("question"), "repo")


def read_prefix_cache(spark: SparkSession, path: str) -> DataFrame:
    """sha, prefix of JSON lines; corrupt lines are skipped and the first line of a key counts."""
    rows = spark.read.text(path).select(F.from_json("value", "sha string, prefix string").alias("r"), F.monotonically_increasing_id().alias("n")).where("r.sha IS NOT NULL AND r.prefix IS NOT NULL")
    return rows.groupBy("r.sha").agg(F.min_by("r.prefix", "n").alias("prefix"))
