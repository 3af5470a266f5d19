"""Exact Jaccard self-join of texts on word n-grams, by rare-first prefix filtering.

1. Every text becomes the set of its distinct n-gram hashes (64 bits). Texts with equal sets (by a 128-bit key) form a class with a
   number of its own; from here on a class is one row, so copies are never expanded into pairs.
2. All n-grams are counted in a table of 2**20 counters. Sorting a set by (counter, hash) is the same total order everywhere
   and puts frequent n-grams last; any such order is exact, counters only make it cheap. Their size doesn't grow with the data.
3. Of a set of n only the prefix takes part: with similarity t two sets share one of the first n - ceil(t n) + 1 n-grams, and
   the smaller set one of its first n - ceil(2t / (1 + t) n) + 1. N-grams in the prefix of one class alone are sieved out by a bit
   table of fixed size. The others meet in an equi join under these conditions: length (t times the larger is at most the
   smaller), position (enough n-grams are left after this one) and suffix: what stands behind the shared n-gram is parted into 256
   segments, and the segments' sizes, modulo 2, must not differ in more places than the suffixes may. A pair comes from its first
   shared n-gram: rows that share the one before, too, are left out. The sieve counts n-grams together with a class of sizes,
   so an n-gram that only sets of very different sizes share is out.
4. Each pair is verified once on the whole sets, by all 64 bits of their hashes.

`components` finds the same components with few pairs. Every set is first compared with a single one, a centre: in the group of an n-gram
that is the set most of whose prefix others share, as a text's edited copies have n-grams of their own and it has not. Only sets that
are in different components then go through the full join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import common, graph

COUNTERS = 1 << 20
SETS = "doc_id long, n long, k1 long, k2 long, block int, data binary"
SEGMENTS = 256
PREFIXES = "doc_id long, k1 long, k2 long, n int, segments binary, grams array<bigint>"
CODES = [f"s{i}" for i in range(SEGMENTS // 64)]
POSTS = "class long, n int, pos int, shared int, h long, v1 long, " + ", ".join(f"{q} long" for q in CODES)
TABLE_BITS = 27
KEY_BITS = 40


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _keys(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    keys = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
    return [k & (1 << 64) - 1 for k in keys], [k >> 64 for k in keys]


def set_keys(docs: DataFrame, n: int) -> DataFrame:
    """Per document: doc_id, n (size of its set) and a 128-bit key of the set; per task also the blocks of its counters."""

    def run(batches):
        counters = np.zeros(COUNTERS, np.int64)
        for whole in batches:
            for batch in common.chunks(whole):
                sets = common.shingle_sets(common.Words(batch.column(1), lower=True), n)
                if len(sets):
                    counters += np.bincount(_slot(np.concatenate(sets)), minlength=COUNTERS)
                low, high = _keys(sets)
                none = pa.nulls(len(sets))
                yield pa.record_batch(
                    [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), _signed(low), _signed(high), none.cast(pa.int32()), none.cast(pa.binary())],
                    names=["doc_id", "n", "k1", "k2", "block", "data"],
                )
        if counters.any():
            packed = common.pack_array(counters)
            none = pa.nulls(packed.num_rows).cast(pa.int64())
            yield pa.record_batch([none, none, none, none, packed.column(0), packed.column(1)], names=["doc_id", "n", "k1", "k2", "block", "data"])

    return common.ids_and_text(docs).mapInArrow(run, SETS)


def prefixes(docs: DataFrame, n: int, counters, num: int, den: int) -> DataFrame:
    """Per document whose set can have an unequal partner: key and size of the set, the sizes of its segments, and the prefix,
    rare n-grams first. A task sends repeated rows once."""
    least = next(k for k in range(1, 10**6) if num * (k + 1) <= den * k)  # a smaller set has no partner but its equals

    def run(batches):
        table, seen = counters.value, set()
        for whole in batches:
            for batch in common.chunks(whole):
                rows: list[tuple] = []
                sets = common.shingle_sets(common.Words(batch.column(1), lower=True), n)
                for doc, s, k1, k2 in zip(batch.column(0).to_pylist(), sets, *_keys(sets), strict=True):
                    if len(s) < least or doc is None or (doc, k1) in seen:
                        continue
                    seen.add((doc, k1))
                    order = np.argsort(table[_slot(s)], kind="stable")[: len(s) - -(-num * len(s) // den) + 1]
                    segments = np.bincount((s & np.uint64(SEGMENTS - 1)).astype(np.int64), minlength=SEGMENTS)
                    rows.append((doc, k1, k2, len(s), np.packbits((segments & 1).astype(np.uint8), bitorder="little").tobytes(), s[order].view(np.int64)))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    grams = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cols[5])]), pa.int32()), pa.array(np.concatenate(cols[5])))
                    made = [pa.array(cols[0], pa.int64()), _signed(cols[1]), _signed(cols[2]), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary()), grams]
                    yield pa.record_batch(made, names=["doc_id", "k1", "k2", "n", "segments", "grams"])

    return common.ids_and_text(docs).mapInArrow(run, PREFIXES)


def suffix_codes(segments: bytes, h: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Parities of the segments behind each of the `kept` places of a prefix `h`; `segments`: the whole set's."""
    seg = (h.view(np.uint64) & np.uint64(SEGMENTS - 1)).astype(np.int64)
    passed = np.zeros((len(h), len(CODES)), np.uint64)
    passed[np.arange(len(h)), seg >> 6] = np.uint64(1) << (seg & 63).astype(np.uint64)
    return np.bitwise_xor.accumulate(passed, axis=0)[kept] ^ np.frombuffer(segments, np.uint64)


def sieve_keys(h: np.ndarray, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Two keys of KEY_BITS bits for each n-gram of a prefix, of which sets that may be similar share one: the n-gram with the set's
    size class, in steps of num / den, and with the next one."""
    level = np.floor(np.log(np.maximum(sizes, 1)) / (np.log(den / num) * (1 + 1e-9))).astype(np.uint64) if num < den else sizes.astype(np.uint64)
    return np.concatenate([common.finish(h.view(np.uint64) + (level + np.uint64(k)) * common.MIX[0]) for k in (0, 1)]) >> np.uint64(64 - KEY_BITS)


def shared_posts(spark: SparkSession, prefix: DataFrame, num: int, den: int, bits: int = TABLE_BITS) -> DataFrame:
    """A row for each n-gram of a prefix that another prefix of about the size may have: its place, the n-gram before, the set's size, the
    parities behind it, and how many thousandths of the prefix are such n-grams."""

    def grams_of(batch):
        lists = batch.column(3)
        n = np.diff(lists.offsets.to_numpy())
        return n, lists.flatten().to_numpy(), np.repeat(batch.column(1).to_numpy(), n)

    def keys(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                _, h, sizes = grams_of(whole.slice(at, 256))
                yield pa.record_batch([pa.array(sieve_keys(h, sizes, num, den).view(np.int64))], names=["key"])

    rows = prefix.select("class", "n", "segments", "grams")
    twice = rows.mapInArrow(keys, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    marked = spark.sparkContext.broadcast(common.bit_table(twice.select(F.shiftleft("key", 64 - KEY_BITS)), bits))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                n, h, sizes = grams_of(batch)
                known = common.bits_set(marked.value, sieve_keys(h, sizes, num, den) << np.uint64(64 - KEY_BITS), bits)
                keep = np.flatnonzero(known[: len(h)] | known[len(h) :])
                if not len(keep):
                    continue
                first = np.cumsum(n) - n
                row = np.repeat(np.arange(len(n)), n)[keep]
                pos = keep - first[row]
                codes, segments = [], batch.column(2)
                for i, places in zip(*_grouped(row, pos), strict=True):
                    codes.append(suffix_codes(segments[i].as_py(), h[first[i] : first[i] + n[i]], places))
                packed = np.concatenate(codes).view(np.int64)
                shared = (np.bincount(row, minlength=len(n)) * 1000 // np.maximum(n, 1))[row]
                cols = [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(pos.astype(np.int32)), pa.array(shared.astype(np.int32)), pa.array(h[keep]), pa.array(h[np.maximum(keep - 1, 0)], mask=pos < 1)]
                yield pa.record_batch([*cols, *(pa.array(np.ascontiguousarray(packed[:, k])) for k in range(len(CODES)))], names=["class", "n", "pos", "shared", "h", "v1", *CODES])

    return rows.mapInArrow(run, POSTS)


def _grouped(row: np.ndarray, pos: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Rows (ascending) and the places of each."""
    at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    return row[at].tolist(), np.split(pos, at[1:])


def filters(a: str, b: str, num: int, den: int) -> list[str]:
    """Position and suffix filter of two posts: the n-grams before are not shared."""
    need = f"({num} * ({a}.n + {b}.n) + {num + den - 1}) DIV {num + den}"  # the least intersection
    left = f"({a}.n - {a}.pos + {b}.n - {b}.pos - 2 * ({need}))"  # suffixes (n - pos - 1 each) may differ in so many places
    apart = " + ".join(f"bit_count({a}.{q} ^ {b}.{q})" for q in CODES)
    return [f"least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {need}", f"{apart} <= {left}"]


def candidates(posts: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of classes that pass all filters, a the smaller set."""
    a, b = posts.alias("a"), posts.alias("b")
    tests = [
        "a.h = b.h",
        "(a.n < b.n OR a.n = b.n AND a.class < b.class)",
        f"{den} * a.n >= {num} * b.n",
        f"a.pos <= a.n - ({2 * num} * a.n + {num + den - 1}) DIV {num + den}",
        *filters("a", "b", num, den),
        "NOT coalesce(a.v1 = b.v1, false)",
    ]
    if "part" in posts.columns:
        tests.append("a.part <> b.part")  # those in one part reach each other already
    return a.join(b, F.expr(" AND ".join(tests))).select(F.col("a.class").alias("a"), F.col("b.class").alias("b")).distinct()


def verified(spark: SparkSession, docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, num: int, den: int, share: int = 256) -> DataFrame:
    """Those of `pairs` (a, b) whose whole sets are similar enough. The set of b travels with the pair; the set of a is sent once
    to each task that holds its pairs, in shares of about `share`, so a set with many partners is spread over tasks. What a set is sent
    for is known before it is made from its text, so it is shuffled once."""

    def sets(batches):
        seen = set()  # repeated rows are sent once a task
        for whole in batches:
            for batch in common.chunks(whole):
                found = common.shingle_sets(common.Words(batch.column(1), lower=True), n)
                low, high = _keys(found)
                made = pa.record_batch([batch.column(0), _signed(low), _signed(high), pa.array([s.tobytes() for s in found], pa.binary())], names=["rep", "k1", "k2", "grams"])
                fresh = [(doc, k) not in seen and not seen.add((doc, k)) for doc, k in zip(batch.column(0).to_pylist(), low, strict=True)]
                yield made.filter(pa.array(fresh, pa.bool_()))

    def check(batches):
        now, x = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for a, b, grams in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                y = np.frombuffer(grams.as_buffer(), np.uint64)
                if b is None:
                    now, x = a, y.copy()
                    keep.append(False)
                    continue
                assert a == now
                both = len(x) + len(y) - len(common.distinct(np.concatenate((x, y))))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column(0), batch.column(2)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / share).cast("int").alias("shares"))
    heads = shares.select(F.col("a").alias("class"), "a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("b"))
    dealt = pairs.join(shares, "a").select(F.col("b").alias("class"), "a", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"), "b")
    sent = common.staged(spark, heads.unionByName(dealt).join(classes, "class").select("rep", "k1", "k2", "a", "share", "b"), "sent")
    n_sent = sent.count()
    some = sent.select(F.col("rep").alias("doc_id")).distinct()
    texts = common.beside(common.ids_and_text(docs), some, "doc_id", n_sent, how="left_semi")
    made = texts.mapInArrow(sets, "rep long, k1 long, k2 long, grams binary")
    rows = common.beside(made, sent, ["rep", "k1", "k2"], n_sent).select("a", "share", "b", "grams")
    out = rows.repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first()).mapInArrow(check, "a long, b long")
    out = common.staged(spark, out.distinct(), "links")
    common.drop_staged(spark, sent)
    return out


def representatives(spark: SparkSession, docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes and keys of all documents' sets; classes of equal sets: class, rep (its smallest doc_id), k1, k2; prefixes, one a
    class)."""
    keys = common.staged(spark, set_keys(docs, n), "set-keys")
    table = common.merge_arrays(keys.where("block IS NOT NULL").select("block", "data"), "int64", "sum")
    counters = spark.sparkContext.broadcast(table if len(table) else np.zeros(COUNTERS, np.int64))
    rows = keys.where("block IS NULL").select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2")
    groups = rows.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    classes = common.staged(spark, groups.select(F.monotonically_increasing_id().alias("class"), "rep", "k1", "k2"), "classes")
    named = classes.withColumnRenamed("rep", "doc_id")
    prefix = prefixes(docs, n, counters, num, den).join(named, ["doc_id", "k1", "k2"]).select("class", "n", "segments", "grams")
    # the same row in several tasks; a class is in one partition of the join already
    return rows, classes, common.staged(spark, prefix, "prefixes")


def once(spark: SparkSession, prefix: DataFrame) -> DataFrame:
    """Prefixes without repeats of a class, which only rows make that share doc_id and set and were read by different tasks."""
    twice = prefix.groupBy("class").agg(F.count("*").alias("copies")).where("copies > 1").select("class")
    few = common.staged(spark, twice, "repeated")
    if few.isEmpty():
        return prefix
    single = prefix.join(few, "class", "left_semi").groupBy("class").agg(*(F.first(c).alias(c) for c in prefix.columns[1:]))
    return common.staged(spark, prefix.join(few, "class", "left_anti").unionByName(single), "prefixes")


def jaccard_join(spark: SparkSession, docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, links): members has a row a document (doc_id, n_shingles, class), classes a row a set (class, rep: its
    smallest doc_id), links all similar pairs (a, b) of classes, each once. Two texts are similar where den * intersection >= num *
    union. Null and empty texts have an empty set, no class, and link with nothing. Rows with null doc_id are members; a class of
    such rows alone has no links. Rows that share a doc_id are in the classes of their own texts. Very long texts are one set;
    other columns of `docs` aren't read."""
    rows, classes, prefix = representatives(spark, docs, n, num, den)
    pairs = common.staged(spark, candidates(shared_posts(spark, once(spark, prefix), num, den), num, den), "pairs")
    common.drop_staged(spark, prefix)
    links = verified(spark, docs, classes, pairs, n, num, den)
    common.drop_staged(spark, pairs)
    return rows.join(classes, ["k1", "k2"], "left").select("doc_id", "n_shingles", "class"), classes.select("class", "rep"), links


def stars(posts: DataFrame, num: int, den: int) -> DataFrame:
    """A pair of each class with the centre that it shares most n-grams with, as far as sizes, positions and suffixes allow: at most
    one a class, however large a group is."""
    centre = F.struct("shared", (-F.col("class")).alias("order"), "class", "n", "pos", *CODES)
    best = posts.groupBy("h").agg(F.max(centre).alias("m"))
    tests = ["p.class <> m.class", f"{den} * least(p.n, m.n) >= {num} * greatest(p.n, m.n)", *filters("p", "m", num, den)]
    met = posts.select(F.struct("class", "n", "pos", *CODES).alias("p"), "h").join(best, "h").where(" AND ".join(tests))
    counts = met.groupBy(F.col("p.class").alias("own"), F.col("m.class").alias("centre")).agg(F.count("*").alias("n"))
    chosen = counts.groupBy("own").agg(F.max(F.struct("n", (-F.col("centre")).alias("order"))).alias("c"))
    return chosen.select(F.least("own", -F.col("c.order")).alias("a"), F.greatest("own", -F.col("c.order")).alias("b")).distinct()


def components(spark: SparkSession, docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(rows, parts): rows has doc_id, n_shingles and rep (the smallest doc_id with an equal set; null for an empty set) of every
    document, parts (doc_id, part) the smallest doc_id reachable, of representatives and repeated ids where it isn't themselves."""
    rows, classes, prefix = representatives(spark, docs, n, num, den)
    posts = common.staged(spark, shared_posts(spark, once(spark, prefix), num, den), "posts")
    common.drop_staged(spark, prefix)
    first = common.staged(spark, stars(posts, num, den), "stars")
    close = verified(spark, docs, classes, first, n, num, den)
    known = common.staged(spark, graph.components(spark, close), "first-components")
    marked = common.beside(posts, known.withColumnRenamed("node", "class"), "class", known.count(), how="left").withColumn("part", F.coalesce("component", "class")).drop("component")
    mixed = common.staged(spark, marked.groupBy("h").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("h"), "mixed")
    open_posts = common.staged(spark, common.beside(marked, mixed, "h", mixed.count(), how="left_semi"), "open-posts")
    second = common.staged(spark, candidates(open_posts, num, den), "pairs")
    common.drop_staged(spark, mixed, open_posts)
    far = verified(spark, docs, classes, second, n, num, den)
    common.drop_staged(spark, posts, first, known, second)
    named = rows.join(classes, ["k1", "k2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).alias("rep"))
    named = common.staged(spark, named, "members")
    reps = classes.select("class", "rep")
    to_rep = lambda side: reps.select(F.col("class").alias(side), F.col("rep").alias(f"rep_{side}"))
    edges = close.union(far).join(to_rep("a"), "a").join(to_rep("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    ids = named.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), (F.count("rep") < F.count("*")).alias("empty"))
    several = ids.where("low < high OR empty AND low < doc_id").select("doc_id")  # repeated ids
    bridges = named.where("rep IS NOT NULL").join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = common.staged(spark, graph.components(spark, edges.union(bridges)), "components")
    common.drop_staged(spark, close, far, classes)
    return named, found.where("node > component").select(F.col("node").alias("doc_id"), F.col("component").alias("part"))


def linked_components(spark: SparkSession, docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, or by equal sets), class_id (smallest doc_id with an
    equal set; for an empty set the doc_id). Null and empty texts link with nothing; rows that share a doc_id are one node, whatever their
    texts; a null doc_id gets what its text's class has. Very long texts are one set; other columns of `docs` aren't read."""
    rows, parts = components(spark, docs, n, num, den)
    named = parts.select(F.col("doc_id").alias("node"), "part")
    out = rows.withColumn("node", F.coalesce("rep", "doc_id")).join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("part", "node").alias("component_id"), F.col("node").alias("class_id"))


def parts(spark: SparkSession, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, part) of documents that reach a smaller one by links or equal sets: part is the smallest."""
    out = linked_components(spark, docs, n, num, den)
    return out.where("component_id < doc_id").select("doc_id", F.col("component_id").alias("part")).distinct()


def one_of_each(spark: SparkSession, docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """`docs`, all columns, without those that reach a smaller doc_id by links. Rows with null doc_id stay, and so do null and
    empty texts, which link with nothing; rows that share the least doc_id of their component all stay. An empty table stays empty.
    Extra columns may have any names."""
    gone = common.staged(spark, parts(spark, docs, n, num, den).select("doc_id"), "near-copies")
    return common.without(docs, gone)


def oracle(n: int = 3, num: int = 90, den: int = 100) -> str:
    """DuckDB SQL of linked_components() over documents, from all pairs that share a shingle."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"list_filter(regexp_split_to_array({low}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    cut = f"CASE WHEN len(w) >= {n} THEN list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
    return f"""WITH RECURSIVE sets AS (SELECT doc_id, list_sort({cut}) AS s FROM (SELECT doc_id, {words} AS w FROM documents)),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, (SELECT min(y) FROM reach r WHERE r.x = s.doc_id) AS component_id,
  CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE min(s.doc_id) OVER (PARTITION BY s.s) END AS class_id FROM sets s"""
