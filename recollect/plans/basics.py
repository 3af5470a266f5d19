"""DataFrame plans of the plain rows, checked against the SQL in the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import columns as c
from recollect.functions import words
from recollect.operators import dml, folds, graphs, lines, ranks
from recollect.plans.catalog import PLANS
from recollect.plans.registry import Tables, query
from recollect.plans.retrieval import near
from recollect.plans.tables import anchor


def checked(rows: str):
    """Registers a plan beside the SQL of its name in the catalog."""

    def add(build):
        return query(rows, PLANS[build.__name__].duck())(build)

    return add


def episode(t: Tables) -> DataFrame:
    return t("conversations").select(F.concat(F.lit("episode:"), "conv_id", F.lit("_"), "turn").alias("id"), F.concat(F.lit("conv_"), "conv_id").alias("session_id"), "conv_id", "turn", "role", "text")


def sha(column: str = "text") -> Column:
    return F.sha2(column, 256)


# Text


@checked("A5 T1")
def term_frequencies(t: Tables):
    terms = t("documents").select("doc_id", F.explode(lines.terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return terms.groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("n").alias("n_tokens"), F.max("n").alias("most"))


@checked("S16")
def token_overlap(t: Tables):
    long_words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: F.octet_length(x) > 3))
    rows = t("documents").select("doc_id", long_words.alias("w")).withColumn("v", F.lag("w").over(Window.partitionBy(F.col("doc_id") % 50).orderBy("doc_id")))
    both = F.size(F.array_intersect("w", "v"))
    return rows.where("v IS NOT NULL").select("doc_id", F.round(F.when((F.size("w") == 0) | (F.size("v") == 0), 0.0).otherwise(5.0 * both / F.size(F.array_union("w", "v"))), 6).alias("overlap"))


@checked("S24 H7")
def content_hash(t: Tables):
    return t("documents").select("doc_id", sha().alias("content_hash"))


@checked("H6")
def exact_dedup(t: Tables):
    return t("documents").groupBy(sha().alias("content_hash")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "content_hash")


@checked("H6")
def dup_groups(t: Tables):
    return t("documents").groupBy(sha().alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("kept")).where("copies > 1")


@checked("J6")
def new_hashes(t: Tables):
    rows = t("documents").select("doc_id", "source", sha().alias("h"))
    return rows.where("source <> 'src0'").join(rows.where("source = 'src0'").select("h"), "h", "left_anti").select("doc_id")


@checked("T6")
def temporal_words_removed(t: Tables):
    return t("conversations").select("conv_id", "turn", c.without_temporal(F.lower("text")).alias("cleaned"))


@checked("T5")
def synonyms_expanded(t: Tables):
    """Spelling, then synonyms, each a lookup."""
    table = lambda d: F.create_map(*(F.lit(x) for pair in d.items() for x in pair))
    said = t("conversations").select("conv_id", "turn", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("w <> ''")
    spelled = said.withColumn("w", F.coalesce(F.element_at(table(words.SPELLING), F.col("w")), "w"))
    return spelled.withColumn("term", F.coalesce(F.element_at(table(words.SYNONYMS), F.col("w")), "w")).groupBy("conv_id", "turn", "term").agg(F.count("*").alias("n"))


@checked("P3")
def user_prefix(t: Tables):
    return episode(t).select("id", c.user_prefix(F.col("session_id")).alias("prefix"))


@checked("T26")
def turn_index(t: Tables):
    return episode(t).select("id", c.turn_number(F.concat(F.lit("Session "), "session_id", F.lit(" - Turn "), F.col("turn").cast("string"))).alias("turn_index"))


@checked("")
def scope_from_url(t: Tables):
    scope = F.regexp_extract("url", r"^https?://[^/]+/([^/?#]+)", 1)
    return t("pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.when(scope == "", "general").otherwise(scope).alias("scope"))


@checked("T22")
def checklist_lines(t: Tables):
    rows = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.where(c.any_of(F.col("line"), ["- [ ]", "- [x]"])).select("doc_id", c.trimmed(F.col("line")).alias("line"))


@checked("T28")
def sanitised_ids(t: Tables):
    kept = F.regexp_replace("url", "[^A-Za-z0-9_-]", "")
    return t("pages").select("page_id", F.when(kept == "", "unknown").otherwise(kept).alias("id"))


@checked("H3")
def headings(t: Tables):
    """A heading's section ends where the next one begins; places are bytes."""
    rows = t("documents").where("text IS NOT NULL").select("doc_id", F.octet_length("text").cast("long").alias("total"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start_byte", F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)).cast("long"))
    heads = placed.where(F.col("line").rlike(r"^\s*#+ \s*\S")).withColumn("end_byte", F.coalesce(F.lead("start_byte").over(Window.partitionBy("doc_id").orderBy("start_byte")), "total"))
    named = heads.select("doc_id", c.trimmed(F.regexp_replace("line", r"^\s*#+", "")).alias("title"), "start_byte", "end_byte")
    whole = t("documents").where("text IS NOT NULL").join(heads.select("doc_id").distinct(), "doc_id", "left_anti")
    return named.unionByName(whole.select("doc_id", F.lit("Document Root").alias("title"), F.lit(0).cast("long").alias("start_byte"), F.octet_length("text").cast("long").alias("end_byte")))


# Scans, filters, sets


@checked("C3 J5")
def point_lookup(t: Tables):
    wanted = t.spark.createDataFrame([("episode:1_0",), ("episode:2_1",), ("bad",), ("rule:7",)], "id string")
    return episode(t).join(F.broadcast(wanted), "id", "left_semi").select("id", "role")


@checked("C15")
def missing_values(t: Tables):
    return t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left").where("quality IS NULL").select("doc_id")


@checked("P1 P5")
def scope_visibility(t: Tables):
    return episode(t).where((F.col("session_id").isin("conv_1", "conv_2") | (F.col("role") == "system")) & (F.col("role") != "tool")).select("id")


@checked("P8 E5")
def substring_any(t: Tables):
    has = F.col("text").contains("thening")
    parts = [("document", "documents", F.col("doc_id")), ("benchmark", "benchmark", F.col("item_id")), ("conversation", "conversations", F.col("conv_id") * 1000 + F.col("turn"))]
    found = [t(name).where(has).select(F.lit(kind).alias("kind"), key.alias("id")) for kind, name, key in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])


@checked("P10")
def utility_default(t: Tables):
    utility = F.coalesce(F.col("quality") * 100.0, F.lit(50.0))
    return t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", utility.alias("utility"), F.round(0.7 + 0.3 * utility, 6).alias("factor"))


@checked("P13")
def ttl_expired(t: Tables):
    return t("events").where(F.unix_timestamp("ts") + 20 * 86400 < anchor()).select("event_id")


@checked("P19")
def disclosure_levels(t: Tables):
    sim = F.round("sim", 9)
    return near(t).select("vec_id", F.when(sim >= 0.8, "full").when(sim >= 0.6, "index").otherwise("drop").alias("level"))


@checked("E2")
def union_last_wins(t: Tables):
    counts = t("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n")).withColumn("pri", F.lit(1))
    both = counts.unionByName(t("customer").select(F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("pri")))
    return both.groupBy("id").agg(F.max_by("n", "pri").alias("n"))


@checked("D12 E3")
def edge_difference(t: Tables):
    pairs = t("orders").select(F.col("o_custkey").alias("src"), F.col("o_orderstatus").alias("dst"), (F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz")).alias("old"))
    gone, added = dml.sync_edges(pairs.where("old").select("src", "dst").distinct(), pairs.where("NOT old").select("src", "dst").distinct(), ["src", "dst"])
    return gone.select(F.lit("delete").alias("op"), "src", "dst").unionByName(added.select(F.lit("add").alias("op"), "src", "dst"))


@checked("A3")
def distinct_scopes(t: Tables):
    return t("documents").select(F.col("source").alias("scope")).union(t.spark.createDataFrame([("general",)], "scope string")).distinct()


# Aggregates


@checked("A1")
def row_counts(t: Tables):
    return t("documents").agg(F.count("*").alias("n"), F.count_distinct("source").alias("scopes"))


@checked("A8 A10")
def metrics_rollup(t: Tables):
    """All and each in one pass."""
    percent = 100.0 * F.count_if(F.col("n_chars") > 1000) / F.count("*")
    return t("documents").rollup("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"), F.round(percent, 4).alias("percent")).select(F.coalesce("source", F.lit("all")).alias("type"), "n", "mean", "percent")


@checked("A9")
def p95_nearest_rank(t: Tables):
    rows = ranks.within(t("events").select("event_type", "value", "event_id"), ["event_type"], "value", "event_id")
    return rows.where(F.col("k") == F.ceil(0.95 * F.col("n_group"))).select("event_type", F.col("value").alias("p95"))


@checked("A11 H10")
def event_ngrams(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ahead = t("events").select(*(F.lead("event_type", k).over(w).alias(f"e{k}") if k else F.col("event_type").alias("e0") for k in range(4)))
    grams = F.array(*(F.when(F.col(f"e{n}").isNotNull(), F.concat_ws(">", *(f"e{k}" for k in range(n + 1)))) for n in (1, 2, 3)))
    return ahead.select(F.explode(F.array_compact(grams)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n >= 2")


@checked("A14")
def human_messages(t: Tables):
    return t("conversations").where((F.col("role") == "user") & ~F.col("text").contains("<command-message>")).groupBy("conv_id").agg(F.count("*").alias("n"))


@checked("A15")
def status_rates(t: Tables):
    """Both rates in one aggregation; a side without rows counts as 0."""
    old = F.col("o_orderdate") < F.lit("1995-06-17").cast("timestamp_ntz")
    done = (F.col("o_orderstatus") == "F").cast("double")
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rates = joined.groupBy(F.col("n_name").alias("name")).agg(F.avg(F.when(old, done)).alias("a"), F.avg(F.when(~old, done)).alias("b"))
    return rates.select("name", F.round(F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0)), 6).alias("delta"))


@checked("A16")
def last_activity(t: Tables):
    last = t("events").groupBy("user_id").agg(F.unix_timestamp(F.max("ts")).alias("last_seen"))
    return last.withColumn("stale", anchor() - F.col("last_seen") > 3 * 86400)


# Windows


@checked("W4")
def last_n_per_session(t: Tables):
    return folds.first_of_each(t("conversations").select("conv_id", "turn"), ["conv_id"], 3, F.desc("turn")).select("conv_id", "turn")


@checked("W5")
def budgeted_suffix(t: Tables):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return t("conversations").select("conv_id", "turn", F.sum(F.length("text") + 1).over(w).alias("used")).where("used - 1 <= 1000").select("conv_id", "turn")


@checked("W9 D3 J15 J3")
def sequence_edges(t: Tables):
    return episode(t).select(F.col("id").alias("src"), F.lead("id").over(Window.partitionBy("conv_id").orderBy("turn", "id")).alias("dst")).where("dst IS NOT NULL")


@checked("W10")
def window_slope(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    rows = t("events").select("event_id", "value", ((F.col("value") - F.first("value").over(w)) / 4.0).alias("s"), F.count("*").over(w).alias("n")).where("n = 5")
    state = F.when((F.col("s") < 0.01) & (F.col("value") < 70), "shift").when(F.col("s") < 0.05, "stagnant").otherwise("converging")
    return rows.select("event_id", F.round("s", 6).alias("slope"), state.alias("state"))


@checked("W12")
def stratified_first_n(t: Tables):
    quota = c.first_match([(F.col("lang") == k, F.lit(n)) for k, n in (("en", 13), ("de", 8), ("fr", 6))], 3)
    return folds.first_of_each(t("documents").select("lang", "doc_id"), ["lang"], 13, "doc_id").where(F.col("k") <= quota).select("lang", "doc_id")


@checked("W16")
def save_points(t: Tables):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").select("user_id", "event_id", n.alias("n")).where("n % 15 = 0").select("user_id", "event_id")


@checked("J14")
def timeline_neighbours(t: Tables):
    """The five nearest on either side: a limit each, no window."""
    e = t("events").select("event_id", "ts")
    mark = e.where("event_id = 50").select(F.col("ts").alias("t"), F.col("event_id").alias("e"))
    rows = e.crossJoin(F.broadcast(mark)).where("event_id <> e")
    rows = rows.select("event_id", F.expr("CASE WHEN ts > t OR ts = t AND event_id > e THEN 'after' ELSE 'before' END").alias("side"), F.abs(F.unix_timestamp("ts") - F.unix_timestamp("t")).alias("gap"))
    first = lambda side: rows.where(F.col("side") == side).orderBy("gap", "event_id").limit(5)
    return first("after").unionByName(first("before")).select("event_id", "side")


# Vectors and scores


@checked("K2")
def knn_by_label(t: Tables):
    return folds.first_of_each(near(t), ["label"], 3, F.round("sim", 9).desc(), "vec_id").select("label", "vec_id")


@checked("S6")
def vector_norms(t: Tables):
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return t("embeddings").select("vec_id", norm.alias("raw")).select("vec_id", F.round("raw", 4).alias("norm"), (F.abs(F.col("raw") - 1) < 0.01).alias("unit"))


def aged(t: Tables) -> DataFrame:
    rows = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return rows.withColumn("hours", (anchor() - F.unix_timestamp("last")) / 3600.0)


@checked("S7")
def gaussian_decay(t: Tables):
    return aged(t).select("user_id", F.round(F.greatest(F.exp(-0.5 * F.pow(F.col("hours") / 375.0, 2)), F.lit(0.1)), 6).alias("decay"))


@checked("S8")
def exponential_decay(t: Tables):
    return aged(t).select("user_id", F.round(F.greatest(F.exp(-0.05 * F.col("hours") / 24), F.lit(0.1)), 6).alias("decay"))


@checked("S18")
def access_reinforcement(t: Tables):
    return aged(t).select("user_id", F.round(50 + F.log2(F.col("n") + 1) * F.exp(-0.05 * F.col("hours") / 24), 6).alias("utility"))


@checked("S10")
def sigmoid_gate(t: Tables):
    return near(t).select("vec_id", F.round(1 / (1 + F.exp(-20 * (F.col("sim") - 0.6))), 6).alias("gate"))


@checked("S15")
def distance_boosts(t: Tables):
    """A person's name and a quotation take a share of the distance, time and a known entity a step, the same session half of it."""
    base, label = 1 - F.col("sim"), F.col("label")
    less = c.first_match([(label == 0, 0.4 * base), (label == 1, 0.6 * base), (label == 2, F.lit(0.2)), (label == 3, F.lit(0.3)), (label == 4, 0.5 * base)], F.lit(0.0))
    return near(t).select("vec_id", F.round(F.least(F.lit(2.0), F.greatest(F.lit(-2.0), base - less)), 6).alias("distance"))


@checked("S22")
def archived_demotion(t: Tables):
    archived, own = F.col("label") % 2 == 1, F.col("label") == 1
    return near(t).select("vec_id", F.when(archived & ~(own & (F.round("sim", 9) >= 0.8)), 0.4).otherwise(1.0).alias("factor"))


# Graph and lifecycle


@checked("R5")
def one_hop(t: Tables):
    f = sequence_edges(t)
    both = f.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(0).alias("dir")).union(f.select("dst", "src", F.lit(1)))
    return folds.first_of_each(both, ["node"], 50, "dir", "other").select("node", "other")


def intervals(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    return t("orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), day.alias("valid_from"), F.when(F.col("o_orderstatus") == "F", F.date_add(day, 90)).alias("valid_to"))


@checked("P12 R6 J13")
def asof_edges(t: Tables):
    at = F.lit("1995-06-17").cast("date")
    return intervals(t).where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") >= at))).select("src", "dst")


@checked("")
def edge_validation(t: Tables):
    return intervals(t).agg(F.count("*").alias("n"), F.count_if(F.col("valid_to") < F.col("valid_from")).alias("inverted"))


@checked("R10")
def tree_ancestors(t: Tables):
    """How deep a node is: the steps to its farthest ancestor."""
    parents = t("documents").select(F.col("doc_id").alias("node"), F.when(F.col("doc_id") > 0, F.expr("doc_id DIV 10")).alias("parent"))
    return graphs.ancestors(parents).groupBy("node").agg(F.max("steps").alias("depth"))


@checked("R10 K8")
def uct_select(t: Tables):
    """An unvisited child comes first, then the best of score and curiosity."""
    n = t("orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("child"), (F.col("o_totalprice") % 100).alias("score"), (F.col("o_orderkey") % 5).alias("visits"))
    total = n.groupBy("parent").agg((F.sum("visits") + 1).alias("total"))
    uct = F.when(F.col("visits") == 0, 1e9).otherwise(F.col("score") / 100 + 1.414 * F.sqrt(F.ln("total") / F.col("visits")))
    return n.join(total, "parent").groupBy("parent").agg(F.max_by("child", F.struct(F.round(uct, 9), -F.col("child"))).alias("child"))


# Fixed value: lines of a task that makes or counts pairs.
LINES_A_TASK = 250_000


@checked("J9")
def entity_cooccurrence(t: Tables):
    """Pairs within an order, from its set of suppliers. Orders, and then pairs, are dealt to as many tasks as there are lines for, so that no task holds
    more of them in a larger table."""
    tasks = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), -(-t("lineitem").count() // LINES_A_TASK))
    sets = t("lineitem").select("l_orderkey", "l_suppkey").repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("left_id"), y.alias("right_id")))))
    dealt = sets.select(F.explode(pairs).alias("p")).select("p.left_id", "p.right_id").repartition(tasks, "left_id", "right_id")
    return dealt.groupBy("left_id", "right_id").agg(F.count("*").alias("n")).where("n >= 2")


@checked("D18")
def history_rows(t: Tables):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return t("events").select("user_id", F.col("event_type").alias("key"), F.col("event_id").alias("version"), F.lead("event_id").over(w).alias("replaced_by"))


@checked("D8")
def cascade_delete(t: Tables):
    gone = t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return dml.delete_node({"lines": (t("lineitem"), ["l_orderkey"])}, gone)["lines"].select("l_orderkey", "l_linenumber")
