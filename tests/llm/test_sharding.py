import itertools
import zlib

from pyspark.sql import functions as F

from recollect.llm import sharding

DOCS = "doc_id long, text string, lang string, source string, shard string, size string"


def test_curve_visits_neighbours(spark):
    for dims, bits in ((2, 3), (3, 2)):
        cells = list(itertools.product(range(1 << bits), repeat=dims))
        df = spark.createDataFrame(cells, ", ".join(f"c{i} int" for i in range(dims)))
        rows = df.select("*", sharding.hilbert_index([F.col(f"c{i}") for i in range(dims)], bits).alias("h")).collect()
        path = [tuple(r)[:dims] for r in sorted(rows, key=lambda r: r["h"])]
        assert sorted(r["h"] for r in rows) == list(range(len(cells)))
        assert all(sum(abs(a - b) for a, b in zip(x, y, strict=True)) == 1 for x, y in itertools.pairwise(path))


def fixture():
    rows = [(i, f"text {i} é" * (i % 50), ["en", "de", None][i % 3], f"s{i % 7 if i % 3 else 0}", "x", "y") for i in range(500)]
    return rows + [(600 + i, "copy", "en", "s0", "", "") for i in range(200)] + [(None, None, None, None, "", ""), (5, "", "en", "s0", "", ""), (5, "", "en", "s0", "", "")]


def test_rows_law(spark, tmp_path):
    rows = fixture()
    docs = spark.createDataFrame(rows, DOCS)
    got = sharding.placed(spark, docs).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert sorted(by) == list(range(16))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    along = [r["curve"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert along == sorted(along)
    sharding.write_shards(spark, docs, f"{tmp_path}/out", 16)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == len(rows) and set(docs.columns) <= set(back.columns)
    spread = back.groupBy("_shard").agg(F.countDistinct("lang", "source").alias("n")).agg(F.avg("n")).first()[0]
    assert spread < 6  # of 21 combinations


def test_few_rows(spark):
    assert sharding.placed(spark, spark.createDataFrame([], DOCS)).collect() == []
    assert len({r["shard"] for r in sharding.placed(spark, spark.createDataFrame(fixture()[:3], DOCS)).collect()}) == 3


def test_equal_texts_stand_together_whatever_their_metadata(spark):
    rows = [(i, f"copy {i % 40}", f"l{i % 7}", f"s{i % 11}", "", "") for i in range(2000)] + [(3000 + i, "hot", f"l{i % 5}", f"s{i % 13}", "", "") for i in range(1500)]
    got = sharding.placed(spark, spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    groups = [crc for crc, _ in itertools.groupby(r["text_crc32"] for r in ordered)]
    assert len(groups) == len(set(groups)) == 41
    assert {r["curve"] for r in got if r["doc_id"] >= 3000} == {next(r["curve"] for r in got if r["doc_id"] == 3000)}


def test_clashing_names_and_a_very_long_text(spark, tmp_path):
    docs = spark.createDataFrame([(1, "z" * 2_000_000, "en", "s", 1), (2, "b", "en", "s", 2)], "doc_id long, text string, lang string, source string, _shard int")
    sharding.write_shards(spark, docs, f"{tmp_path}/out", 2)
    assert sorted((r["doc_id"], r["_shard"], len(r["text"])) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 1, 2_000_000), (2, 2, 1)]
