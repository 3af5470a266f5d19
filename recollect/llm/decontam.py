"""Benchmark decontamination: finds short test items inside long documents. DataFrame operations only.

An item is contained in a document that has at least `threshold` of the item's distinct five-word shingles (words: runs of
letters and digits, lower case; each sign of a script written without spaces is a word). An item of fewer words is one shingle,
its whole sequence.

Search is by size-partitioned MinHash with one permutation. Items are partitioned by the length of their shingles and the
power of two below their size n. An item may lack m = n - ceil(threshold n) shingles; its signature is its m + 3 least hash values
(all, if there are fewer). A partition's bound is the greatest value in its signatures; a document's sketch for the partition is
every shingle hash up to that bound, so it has each value of a signature that the document has. The share of a signature found in
the sketch estimates the containment, and an item that is contained has all but m of its signature there: candidates are the
pairs with that estimate or more, and none is lost. Each is verified on the shingles as text.

Signatures, candidates and shingles of items are broadcast where there are at most `broadcast_rows` of them, else joined by a
shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.llm import common

N, THRESHOLD, MORE, BROADCAST_ROWS = 5, 0.8, 3, 1 << 20
UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}])"


def split_words(text: Column) -> Column:
    parted = F.when(text.rlike(UNSPACED), F.regexp_replace(text, UNSPACED, " $1 ")).otherwise(text)
    return F.array_remove(F.split(F.lower(parted), r"[^\p{L}\p{N}]+"), "")


def runs(rows: DataFrame, n: int, *keep: str, text: bool = False) -> DataFrame:
    """A row for each run of n words: `keep`, n, the run's hash and with `text` the run. The words are split once and stay a
    variable of the generated code."""
    starts = F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n))
    long = rows.select(*keep, "words", F.explode(starts).alias("i"))
    words = [F.get("words", F.col("i") + k) for k in range(n)]
    return long.select(*keep, F.lit(n).alias("n_words"), F.xxhash64(*words).alias("hash"), *([F.concat_ws(" ", *words).alias("shingle")] if text else []))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def containment(spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = N, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared, containment): n_shared of the item's n_item distinct shingles are in the
    document. Null and empty texts, and texts without a letter or digit, have no shingles. Rows that share a doc_id or item_id but
    not the text are searched one by one; a pair is reported once, with its best containment. Null ids are carried as null. Very
    long texts are searched whole; other columns aren't read."""
    split = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    split = split.select("item_id", split_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    test = common.staged(spark, split.withColumn("item", F.monotonically_increasing_id()).withColumn("k", F.least(F.size("words"), F.lit(n))), "items")
    lengths = sorted(r["k"] for r in test.select("k").distinct().collect())  # n at most
    cut = [runs(test.where(F.col("k") == k), k, "item", "item_id", text=True) for k in lengths] or [runs(test, n, "item", "item_id", text=True)]
    shingles = common.staged(spark, union(cut).distinct(), "item-shingles")
    order, every = Window.partitionBy("item").orderBy("hash"), Window.partitionBy("item")
    ranked = shingles.select("item", "n_words", "hash").distinct().withColumn("place", F.row_number().over(order)).withColumn("n_item", F.count("*").over(every))
    lacking = F.col("n_item") - F.ceil(F.col("n_item") * F.lit(threshold) - F.lit(1e-9))
    ranked = ranked.withColumn("lacking", lacking).where(F.col("place") <= F.col("lacking") + MORE)
    signatures = common.staged(spark, ranked.withColumn("need", F.least("n_item", F.col("lacking") + MORE) - F.col("lacking")).select("item", "n_words", "n_item", "hash", "need"), "signatures")
    bounds = signatures.groupBy("n_words", F.floor(F.log2("n_item")).alias("size")).agg(F.max("hash").alias("bound")).collect()  # a row a power of two
    texts = common.ids_and_text(docs).select("doc_id", F.xxhash64("text").alias("row"), "text")
    words = texts.select("doc_id", "row", split_words(F.col("text")).alias("words"))
    sketches = [runs(words, k, "doc_id", "row").where(F.col("hash") <= max(b["bound"] for b in bounds if b["n_words"] == k)) for k in lengths]
    sketch = union(sketches or [runs(words, n, "doc_id", "row").limit(0)])
    met = common.beside(sketch, signatures, ["n_words", "hash"], signatures.count(), broadcast_rows).select("doc_id", "row", "item", "need", "hash").distinct()
    pairs = common.staged(spark, met.groupBy("doc_id", "row", "item").agg(F.count("*").alias("found"), F.first("need").alias("need")).where("found >= need").select("doc_id", "row", "item"), "leak-candidates")
    some = common.staged(spark, pairs.select(F.col("doc_id").alias("id"), F.col("row").alias("of")).distinct(), "leak-documents")
    here = common.beside(texts, some, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("of")), some.count(), broadcast_rows, how="left_semi")
    here = here.select("doc_id", "row", split_words(F.col("text")).alias("words"))
    cut = union([runs(here, k, "doc_id", "row", text=True) for k in lengths] or [runs(here, n, "doc_id", "row", text=True)])
    shared = common.beside(cut, shingles.select("item", "n_words", "shingle"), ["n_words", "shingle"], shingles.count(), broadcast_rows)
    counted = shared.select("doc_id", "row", "item", "shingle").distinct().groupBy("doc_id", "row", "item").agg(F.count("*").alias("n_shared"))
    sizes = shingles.groupBy("item", "item_id").agg(F.countDistinct("shingle").alias("n_item"))
    both = counted.join(sizes, "item").where(F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(threshold) - F.lit(1e-9)))
    best = both.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_item", "n_shared")).alias("b"))
    out = common.staged(spark, best.select("doc_id", "item_id", F.col("b.n_item").cast("long").alias("n_item"), F.col("b.n_shared").cast("long").alias("n_shared"), "b.containment"), "leaks")
    common.drop_staged(spark, test, shingles, signatures, pairs, some)
    return out


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """Rows of `docs` whose doc_id is in no pair, with all their columns, whatever their names. Null and empty texts stay; of rows
    that share a doc_id (null is one) all go if one has an item; an empty table stays empty."""
    return common.without(docs, containment(spark, docs, items, threshold, n).select("doc_id").distinct(), nulls=True)


def oracle(threshold: float = THRESHOLD, n: int = N) -> str:
    """DuckDB SQL of containment() over documents and benchmark: every shingle against every shingle."""
    parted = r"regexp_replace(coalesce(text, ''), '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}])', ' \1 ', 'g')"
    words = rf"list_filter(regexp_split_to_array(lower({parted}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    cut = "list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))"
    return f"""WITH items AS (SELECT item_id, w, least(len(w), {n}) AS k FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT k FROM items),
d AS (SELECT doc_id, k, unnest({cut}) AS s FROM (SELECT doc_id, {words} AS w FROM documents) CROSS JOIN lengths WHERE len(w) >= k),
b AS (SELECT item_id, k, len(all_s) AS n_item, unnest(all_s) AS s FROM (SELECT item_id, k, {cut} AS all_s FROM items))
SELECT doc_id, item_id, CAST(n_item AS BIGINT) AS n_item, CAST(count(DISTINCT s) AS BIGINT) AS n_shared, count(DISTINCT s) / CAST(n_item AS DOUBLE) AS containment
FROM d JOIN b USING (k, s) GROUP BY doc_id, item_id, n_item HAVING count(DISTINCT s) >= {threshold} * n_item - 1e-9"""
