"""Readers of conversation files: JSON lines, documents, key-value lines, step logs, markdown and code trees. What can't be read is
kept apart, never dropped."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import columns as c

MESSAGE = "role string, speaker string, content string, text string, message string, _bad string"


def jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(messages with role and text, unreadable lines with their file): the first of several spellings of each field."""
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("file", F.input_file_name())
    raw = lines.select("file", F.from_json("value", MESSAGE, {"columnNameOfCorruptRecord": "_bad"}).alias("m")).select("file", "m.*")
    good = raw.where("_bad IS NULL").select(F.coalesce("role", "speaker", F.lit("unknown")).alias("role"), F.coalesce("content", "text", "message").alias("text"))
    return good, raw.where("_bad IS NOT NULL").select("file", F.col("_bad").alias("line"), F.lit("not a JSON object").alias("error"))


def quarantined(bad: DataFrame, folder: str) -> None:
    """Moves unreadable lines aside, with their file and what was wrong."""
    bad.write.mode("append").json(folder)


def message_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Lines that hold a message or an array of them under `messages`."""
    raw = spark.read.schema("role string, content string, messages array<struct<role: string, content: string>>").json(path)
    many = raw.where("messages IS NOT NULL").select(F.explode("messages").alias("m")).select("m.role", F.col("m.content").alias("text"))
    return many.unionByName(raw.where("messages IS NULL").select("role", F.col("content").alias("text")))


MESSAGES = "array<struct<role: string, content: string>>"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, role, text) of a file, or of all below a folder: a file that is an array of messages, or an object with `messages`, or else lines of messages."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("file"), F.col("value").alias("body"))
    listed = F.from_json("body", MESSAGES)
    inner = F.from_json("body", f"messages {MESSAGES}")["messages"]
    each = F.filter(F.transform(c.lines(F.col("body")), lambda x: F.from_json(x, "role string, content string")), lambda m: m["role"].isNotNull() | m["content"].isNotNull())
    whole = F.when(F.trim("body").startswith("["), listed).otherwise(inner)
    found = F.when(F.size(F.coalesce(whole, F.array().cast(MESSAGES))) > 0, whole).otherwise(each)
    return raw.select("file", F.posexplode(found).alias("place", "m")).select("file", "place", F.coalesce("m.role", F.lit("unknown")).alias("role"), F.coalesce("m.content", F.lit("")).alias("text"))


def assigned(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, role, text) of lines role = "..." and content = "...", in any order of the two; what is no message is read over."""

    def pairs(s: pd.Series) -> pd.Series:
        return s.map(_pairs)

    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("body"))
    made = F.pandas_udf(pairs, MESSAGES)
    return raw.select("file", F.posexplode(made("body")).alias("place", "m")).select("file", "place", "m.role", F.col("m.content").alias("text"))


def _pairs(body: str | None) -> list[dict[str, str]]:
    out, now = [], {}
    for line in (body or "").splitlines():
        name, mark, rest = line.strip().partition("=")
        name, quoted = name.rstrip(), rest.split('"')
        if mark and name in ("role", "content") and len(quoted) > 2:
            now[name] = quoted[1]
        if now.get("role") and now.get("content"):
            out.append(now)
            now = {}
    return out


def step_log(spark: SparkSession, path: str) -> DataFrame:
    """User inputs and planner responses of a log in one document a file, in order; the first created_at dates it. A file, or all below a folder."""
    raw = spark.read.option("recursiveFileLookup", "true").schema("step_index int, type string, content string, created_at string").json(path).withColumn("file", F.input_file_name())
    kept = raw.where(F.col("type").isin("USER_INPUT", "PLANNER_RESPONSE"))
    parts = F.array_sort(F.collect_list(F.struct("step_index", F.concat(F.lit("## "), "type", F.lit("\n"), "content").alias("s"))))
    return kept.groupBy("file").agg(F.array_join(F.transform(parts, lambda x: x["s"]), "\n\n").alias("text"), F.min("created_at").alias("created_at"))


# Folders that a workspace walk leaves out.
IGNORED = [".git", "node_modules", "target", "dist", "build", ".venv", "__pycache__"]


def files(spark: SparkSession, folder: str, pattern: str = "*", depth: int | None = None) -> DataFrame:
    """path, sha256 and text of every file below a folder, down to a depth; folders that hold no sources are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    below = F.split(F.regexp_replace("path", r"^.*?" + folder.rstrip("/").rpartition("/")[2] + "/", ""), "/")
    kept = raw.where(~F.exists(F.slice(below, 1, F.greatest(F.size(below) - 1, F.lit(0))), lambda x: x.isin(IGNORED)))
    if depth is not None:
        kept = kept.where(F.size(below) <= depth)
    return kept.select("path", F.sha2("content", 256).alias("sha256"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def markdown(spark: SparkSession, folder: str, keys: tuple[str, ...] = ("title", "scope"), pattern: str = "*.md", depth: int | None = None) -> DataFrame:
    """path, sha256, the front matter's `keys` (null where a file has none), name (the title, or else the file's name without its ending) and body of each
    markdown file below a folder. Spark gives no row for an empty file."""
    found = files(spark, folder, pattern, depth)
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    values = [c.front_matter(F.col("text"), k).alias(k) for k in keys]
    name = F.coalesce(c.front_matter(F.col("text"), "title"), stem)
    return found.select("path", "sha256", *values, name.alias("name"), c.body_of(F.col("text")).alias("body"))


def tail(spark: SparkSession, folder: str, offsets: DataFrame) -> DataFrame:
    """(path, text, next): what each file holds behind its stored offset (path, offset; none is 0); a file that is shorter than that is read
    from its start. Only whole lines are taken, `next` is the offset behind them."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content", "length")
    known = raw.join(offsets, "path", "left")
    start = F.when(F.coalesce("offset", F.lit(0)) > F.col("length"), 0).otherwise(F.coalesce("offset", F.lit(0))).cast("int")
    behind = F.substring("content", start + 1, F.greatest(F.col("length").cast("int") - start, F.lit(0)))
    whole = F.regexp_extract(F.make_valid_utf8(behind.cast("string")), r"(?s)\A(.*\n)", 1)
    return known.select("path", whole.alias("text"), (start + F.octet_length(whole)).cast("long").alias("next"))


QUESTION = """question_id string, question_type string, question string, question_date string, answer_session_ids array<string>,
haystack_session_ids array<string>, haystack_sessions array<array<struct<role: string, content: string, has_answer: boolean>>>"""


def _question_rows(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    return spark.read.option("multiLine", str(not lines).lower()).schema(QUESTION).json(path)


def asked(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A row a question: question_id, question_type, question, question_date, answer_session_ids (empty where left out). A file holds an array of
    questions, or with `lines` one a line; its haystacks aren't read."""
    ids = F.coalesce("answer_session_ids", F.array().cast("array<string>")).alias("answer_session_ids")
    return _question_rows(spark, path, lines).select("question_id", "question_type", "question", "question_date", ids)


def questions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A row a turn of each question's haystack."""
    raw = _question_rows(spark, path, lines)
    sessions = raw.select("question_id", "question", "haystack_session_ids", F.posexplode("haystack_sessions").alias("s", "turns"))
    turns = sessions.select("question_id", "question", F.get("haystack_session_ids", F.col("s")).alias("session_id"), F.posexplode("turns").alias("turn", "t"))
    return turns.select("question_id", "question", "session_id", "turn", "t.role", F.col("t.content").alias("text"), F.coalesce("t.has_answer", F.lit(False)).alias("has_answer"))
