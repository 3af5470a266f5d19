"""Operators on the lines and words of texts: diffs, code symbols, facts, answers, terms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from recollect.functions import columns as c
from recollect.functions import stem, words


def exploded(df: DataFrame, text: str) -> DataFrame:
    """A row a line: place and line."""
    return df.select(*(x for x in df.columns if x != text), F.posexplode(c.lines(F.col(text))).alias("place", "line"))


def gathered(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of a key, in order, as one text."""
    parts = F.array_sort(F.collect_list(F.struct("place", "line")))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias(text))


def without_diffs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Fenced diffs become a mark, lines of a diff outside of fences go. Fences open and close in turn."""
    rows = exploded(df.select(key, text), text).withColumn("bare", c.trimmed(F.col("line")))
    upto = Window.partitionBy(key).orderBy("place")
    fence = F.col("bare").startswith("```")
    rows = rows.withColumn("fences", F.sum(fence.cast("int")).over(upto))
    opens = fence & (F.col("fences") % 2 == 1)
    rows = rows.withColumn("diff", F.last(F.when(opens, F.col("bare").startswith("```diff")), ignorenulls=True).over(upto))
    inside = F.coalesce(F.col("diff") & ((F.col("fences") % 2 == 1) | fence), F.lit(False))
    bare_diff = F.col("bare").rlike(r"^(diff --git |--- |\+\+\+ |@@ )") & (F.col("fences") % 2 == 0) & ~fence
    kept = rows.withColumn("line", F.when(inside & opens, "[Diff Truncated]").otherwise(F.col("line"))).where(~bare_diff & (~inside | opens))
    return gathered(kept, key, text)


# What begins a symbol, by ending.
SYMBOL = {
    "rs": r"^\s*(?:pub(?:\([^)]+\))?\s+)?(?:async\s+)?(?:unsafe\s+)?(fn|struct|enum|trait|type|const)\s+([A-Za-z0-9_]+)",
    "py": r"^\s*(def|class)\s+([A-Za-z0-9_]+)",
    "ts": r"^\s*(?:export\s+)?(?:async\s+)?(function|class|interface|type|const|enum)\s+([A-Za-z0-9_]+)",
    "go": r"^\s*(func|type|const|var)\s+([A-Za-z0-9_]+)",
}
BLOCK = {"rs": r"^\s*(?:pub\s+)?(?:struct|fn|enum|trait|impl)\s+[\p{L}\p{N}_]", "ts": r"^\s*(?:export\s+)?(?:class|function|interface|type)\s+[\p{L}\p{N}_]", "py": r"^\s*(?:class|def)\s+[\p{L}\p{N}_]"}
SAME = {"tsx": "ts", "js": "ts", "jsx": "ts"}


def ending(path: str) -> Column:
    ext = F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)
    return c.first_match([(ext == k, F.lit(v)) for k, v in SAME.items()], ext)


def by_ending(patterns: dict[str, str], make) -> Column:
    return c.first_match([(F.col("ext") == k, make(p)) for k, p in patterns.items()], F.lit(None))


def symbols(files: DataFrame, key: str, path: str, content: str) -> DataFrame:
    """Functions, types and the like by line: kind, name, start_line, end_line (14 lines on at most), signature, and for `rs` the
    comment lines above."""
    n_lines = F.size(c.lines(F.col(content)))
    rows = exploded(files.select(key, path, content, n_lines.alias("n"), ending(path).alias("ext")), content)
    rows = rows.withColumn("kind", by_ending(SYMBOL, lambda p: F.regexp_extract("line", p, 1))).withColumn("name", by_ending(SYMBOL, lambda p: F.regexp_extract("line", p, 2)))
    bare = c.trimmed(F.col("line"))
    before = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("block", F.coalesce(F.sum((~bare.startswith("//")).cast("int")).over(before), F.lit(0)))  # any line but a comment ends a comment
    said = rows.where((F.col("ext") == "rs") & bare.rlike("^//[/!]")).withColumn("line", c.trimmed(F.regexp_replace(c.trimmed(F.col("line")), "^(///)+|^(//!)+", "")))
    parts = F.array_sort(F.collect_list(F.struct("place", "line")))
    docs = said.groupBy(key, "block").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("doc"))
    found = rows.where("kind <> ''").where(~((F.col("ext") == "rs") & bare.rlike("^//[/!]")))
    out = found.join(docs, [key, "block"], "left")
    return out.select(key, path, (F.col("place") + 1).alias("start_line"), F.least(F.col("place") + 15, F.col("n")).alias("end_line"), "kind", "name", c.trimmed(F.col("line")).alias("signature"), "doc")


def _segments(files: DataFrame, key: str, path: str, content: str) -> DataFrame:
    rows = exploded(files.select(key, content, ending(path).alias("ext")), content)
    starts = F.coalesce(by_ending(BLOCK, lambda p: F.col("line").rlike(p)), F.lit(False))
    return rows.withColumn("segment", F.sum(starts.cast("int")).over(Window.partitionBy(key).orderBy("place")))


def blocks(files: DataFrame, key: str, path: str, content: str) -> DataFrame:
    """Symbol lines up to the next one, as a block with a reference of its own."""
    parts = F.array_sort(F.collect_list(F.struct("place", "line")))
    rows = _segments(files, key, path, content).where("segment > 0").groupBy(key, "segment").agg(F.min("place").alias("place"), F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("block"))
    return rows.withColumn("reference", F.concat(F.col(key).cast("string"), F.lit("-"), F.col("segment").cast("string")))


MARK = "[Paged Symbol: Reference "


def paged(files: DataFrame, found: DataFrame, key: str, content: str, path: str = "path") -> DataFrame:
    """Files with a reference in place of each block."""
    kept = _segments(files, key, path, content).where("segment = 0").select(key, "place", "line")
    marks = found.select(key, "place", F.concat(F.lit(MARK), "reference", F.lit("]")).alias("line"))
    return gathered(kept.unionByName(marks), key, content)


def restored(files: DataFrame, found: DataFrame, key: str, content: str) -> DataFrame:
    """Files with their blocks read back."""
    rows = exploded(files.select(key, content), content).withColumn("reference", F.regexp_extract("line", r"^\[Paged Symbol: Reference ([^\]]+)\]$", 1))
    back = rows.join(found.select("reference", "block"), "reference", "left").withColumn("line", F.coalesce("block", "line"))
    return gathered(back.select(key, "place", "line"), key, content)


def user_facts(turns: DataFrame, text: str) -> DataFrame:
    """key and value of what users say about degree, favourites, preference, bookings, work and garden, sentence by sentence."""
    low = F.replace(F.lower(F.col(text)), F.lit("favourite"), F.lit("favorite"))
    rows = turns.where(F.lower("role") == "user").select("*", F.explode(F.split(low, r"\.")).alias("sentence")).withColumn("sentence", c.trimmed(F.col("sentence")))
    s = F.col("sentence")

    def behind(*marks: str) -> Column:
        """What stands behind the first mark that is there."""
        return c.first_match([(s.contains(m), F.regexp_extract(s, rf"(?s){m}(.*)$", 1)) for m in marks], F.lit(None))

    favorite, value = F.regexp_extract(s, r"(?s)favorite (.*?) is (.*)$", 1), F.regexp_extract(s, r"(?s)favorite (.*?) is (.*)$", 2)
    word = c.trimmed(favorite)
    rules = [
        (F.lit("degree"), behind("degree in", "majored in")),
        (F.concat(F.lit("favorite_"), word), F.when(word.rlike(r"^[\p{L}\p{N}_]+$"), value)),
        (F.lit("preference"), behind("prefer")),
        (F.lit("booked"), behind("chose", "selected", "booked")),
        (F.lit("occupation"), behind("work as a", "work at")),
        (F.when(s.contains("harvested"), "harvested").otherwise("garden"), behind("harvested", "garden")),
    ]
    said = rows.select("*", F.explode(F.array(*(F.struct(k.alias("key"), v.alias("value")) for k, v in rules))).alias("fact")).select("*", "fact.key", "fact.value")
    clean = c.trimmed(F.regexp_replace(c.trimmed(F.col("value")), "^(the |a |an )", ""))
    return said.withColumn("value", clean).where("value <> ''").drop("fact", "sentence")


def clean_answer(text: Column) -> Column:
    """An answer without its thoughts and without the fence around it, or around its first block."""
    t = c.trimmed(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    whole = F.regexp_replace(F.regexp_replace(t, r"(?s)\A[^\n]*\n", ""), r"```\n?\z", "")
    line = F.regexp_replace(F.regexp_replace(t, r"\A```(?:json|markdown)?", ""), r"```\z", "")
    rest = F.regexp_extract(t, r"(?s)```(?:json|markdown)?(.*)\z", 1)
    inner = F.when(rest.contains("```"), F.regexp_extract(rest, r"(?s)\A(.*)```", 1)).otherwise(rest)
    return c.trimmed(c.first_match([(t.startswith("```") & t.contains("\n"), whole), (t.startswith("```"), line), (t.contains("```"), inner)], t))


def titles(text: Column, n: int) -> Column:
    """What stands behind the first mark of each line; none at all if their number isn't n."""
    mark = "(:|-|:)"
    rest = F.transform(F.filter(c.lines(text), lambda x: x.contains(mark)), lambda x: c.trimmed(F.regexp_replace(x, r"^.*?\(:\|-\|:\)", "")))
    return F.when(F.size(rest) == n, rest).otherwise(F.array().cast("array<string>"))


def terms(text: Column) -> Column:
    """Words of letters, digits and dashes in lower case, without stop words."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}-]+"), lambda x: (x != "") & ~x.isin(words.STOP_WORDS))


@F.pandas_udf(StringType())
def stemmed(s: pd.Series) -> pd.Series:
    return s.map(stem.stem, na_action="ignore")


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, stem and count of every stemmed term. Texts are dealt by key once, the stemmer sees each word of a text once; no join by term."""
    counts = docs.select(key, text).repartition(key).select(key, F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    return counts.withColumn("stem", stemmed("term")).groupBy(key, "stem").agg(F.sum("n").alias("n"))


PRIORITY = ["Temporal", "Preference", "User", "Default"]


def dictionary_class(asked: DataFrame, keys: list[str], text: str, known: DataFrame) -> DataFrame:
    """Class of each query by the dictionary's stems (stem, class; a small table). A phrase about the user comes first."""
    said = asked.select(*keys, F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))).alias("word")).where("word <> ''")
    stems = said.select("word").distinct().select("word", stemmed("word").alias("stem"))
    rank = c.first_match([(F.col("class") == k, i) for i, k in enumerate(PRIORITY)], len(PRIORITY) - 1)
    best = said.join(stems, "word").join(F.broadcast(known), "stem").groupBy(*keys).agg(F.min(rank).alias("rank"))
    name = F.element_at(F.array(*(F.lit(k) for k in PRIORITY)), F.coalesce("rank", F.lit(len(PRIORITY) - 1)) + 1)
    phrase = c.any_of(F.lower(text), words.USER_PHRASES)
    return asked.join(best, keys, "left").select(*keys, F.when(phrase, "User").otherwise(name).alias("category"))
