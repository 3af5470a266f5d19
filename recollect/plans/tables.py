"""Scans, changes of tables, predicates, joins, aggregates, windows and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import columns as c
from recollect.operators import dml, folds, graphs, ranks, vectors
from recollect.plans.registry import Tables, query

ANCHOR = "2024-02-01 00:00:00"
A = f"TIMESTAMP '{ANCHOR}'"


def epoch(column: str = "ts"):
    return F.unix_timestamp(column)


def anchor():
    return F.unix_timestamp(F.lit(ANCHOR).cast("timestamp"))


def episodes(t: Tables) -> DataFrame:
    """Turns as episodes: id, session_id, conv_id, turn, role, text."""
    return t("conversations").select(F.concat(F.lit("episode:"), "conv_id", F.lit("_"), "turn").alias("id"), F.concat(F.lit("u"), F.col("conv_id") % 5, F.lit("_"), F.col("conv_id") % 100).alias("session_id"), "conv_id", "turn", "role", "text")


EPISODES = """episode AS (SELECT 'episode:' || conv_id || '_' || turn AS id, 'u' || (conv_id % 5) || '_' || (conv_id % 100) AS session_id, conv_id, turn, role, text FROM conversations)"""


# Scans


@query("C2 K5", """SELECT doc_id, (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM documents) > 40 AS has_more, 40 AS next_offset FROM documents
  ORDER BY doc_id LIMIT 20 OFFSET 20""")
def page_with_totals(t: Tables):
    """The second page of 20: sorted rows behind an offset, and a count."""
    total = t("documents").agg(F.count("*").alias("total"))
    return t("documents").select("doc_id").orderBy("doc_id").offset(20).limit(20).crossJoin(F.broadcast(total)).select("doc_id", "total", (F.col("total") > 40).alias("has_more"), F.lit(40).alias("next_offset"))


@query(
    "C4",
    """WITH d AS (SELECT doc_id, 'wiki/' || lang || '/' || doc_id || '.md' AS path, sha256(coalesce(text, '')) AS hash, 'Title ' || (doc_id % 40) AS title, source AS scope FROM documents), w AS (SELECT * FROM d WHERE doc_id = 7)
SELECT 'path' AS by, min(d.doc_id) AS doc_id FROM d JOIN w USING (path) UNION ALL SELECT 'hash', min(d.doc_id) FROM d JOIN w USING (hash) UNION ALL
  SELECT 'title', min(d.doc_id) FROM d JOIN w USING (title) UNION ALL SELECT 'name and scope', min(d.doc_id) FROM d JOIN w USING (title, scope)""",
)
def secondary_lookup(t: Tables):
    """The first row with a path, a hash, a title, or a name in a scope."""
    title = F.concat(F.lit("Title "), F.col("doc_id") % 40)
    d = t("documents").select("doc_id", F.concat(F.lit("wiki/"), "lang", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), title.alias("title"), F.col("source").alias("scope"))
    probe = d.where("doc_id = 7").select(*(F.col(k).alias(f"p_{k}") for k in ("path", "hash", "title", "scope")))
    both = d.crossJoin(F.broadcast(probe))  # one row
    same = lambda k: F.col(k) == F.col(f"p_{k}")
    first = both.agg(F.min(F.when(same("path"), F.col("doc_id"))).alias("path"), F.min(F.when(same("hash"), F.col("doc_id"))).alias("hash"), F.min(F.when(same("title"), F.col("doc_id"))).alias("title"), F.min(F.when(same("title") & same("scope"), F.col("doc_id"))).alias("name and scope"))
    return first.select(F.explode(F.array(*(F.struct(F.lit(k).alias("by"), F.col(k).alias("doc_id")) for k in first.columns))).alias("r")).select("r.*")


@query("C16", """SELECT user_id, arg_max('log/' || CAST(value AS INT) || '.jsonl', (ts, event_id)) AS path FROM events WHERE event_type = 'view' GROUP BY user_id""")
def registered_sources(t: Tables):
    """The transcript each session has registered last, from a key-value table. Halves go to the even number, as in a cast of the SQL."""
    kv = t("events").select("user_id", F.when(F.col("event_type") == "view", "_transcript_path").otherwise(F.col("event_type")).alias("key"), F.concat(F.lit("log/"), F.rint("value").cast("int"), F.lit(".jsonl")).alias("value"), "ts", "event_id")
    return kv.where("key = '_transcript_path'").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("path"))


@query("C19", """SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1) ORDER BY doc_id LIMIT 50""")
def work_set(t: Tables):
    """The first page of rows that aren't processed yet."""
    done = t("labels").where("quality = 1").select("doc_id", F.lit(True).alias("processed"))
    flagged = t("documents").select("doc_id").join(done, "doc_id", "left").withColumn("processed", F.coalesce("processed", F.lit(False)))
    return flagged.where(~F.col("processed")).select("doc_id").orderBy("doc_id").limit(50)


# Changes of tables


@query(
    "D1 H6",
    """WITH r AS (SELECT doc_id, source || '/' || (doc_id // 4 % 60) AS path, sha256(coalesce(text, '')) AS hash FROM documents), have AS (SELECT path,
  min(doc_id) AS id, arg_min(hash, doc_id) AS hash FROM r WHERE doc_id % 2 = 0 GROUP BY path),
b AS (SELECT * FROM r WHERE doc_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY path ORDER BY doc_id DESC) = 1),
  p AS (SELECT b.doc_id, b.path, b.hash, h.id AS by_path, (SELECT min(id) FROM have x WHERE x.hash = b.hash) AS by_hash FROM b LEFT
  JOIN have h ON h.path = b.path),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY hash, by_path IS NULL AND by_hash IS NULL) AS first FROM p)
SELECT doc_id, CASE WHEN by_path IS NOT NULL THEN 'update' WHEN by_hash IS NOT NULL OR first < doc_id THEN 'keep' ELSE 'insert' END AS action,
  coalesce(by_path, by_hash, first) AS id, CASE WHEN by_path IS NULL AND by_hash IS NULL AND first = doc_id THEN 50 END AS utility FROM f""",
)
def episode_upserts(t: Tables):
    """What a batch does to a table: its path's row is updated, else a row of the same content is kept, else a row is inserted, with its
    metrics."""
    path = F.concat("source", F.lit("/"), F.expr("doc_id DIV 4 % 60"))
    rows = t("documents").select("doc_id", path.alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    have = rows.where("doc_id % 2 = 0").groupBy("path").agg(F.min("doc_id").alias("id"), F.min_by("hash", "doc_id").alias("hash"))
    return dml.upsert_actions(have, dml.latest(rows.where("doc_id % 2 = 1"), ["path"], F.desc("doc_id")))


@query("D4", """SELECT item_id, sha256('p' || (item_id % 9) || ':avoid:' || coalesce(text, '') || ':do') AS content_hash FROM benchmark
  QUALIFY row_number() OVER (PARTITION BY item_id % 9 ORDER BY item_id DESC) = 1""")
def rule_upserts(t: Tables):
    """The last rule of each path, with the hash of pattern, action, cause and remedy."""
    rules = t("benchmark").select("item_id", (F.col("item_id") % 9).alias("path"), F.concat(F.lit("p"), F.col("item_id") % 9).alias("p"), F.lit("avoid").alias("a"), F.coalesce("text", F.lit("")).alias("c"), F.lit("do").alias("r"))
    return dml.latest(rules, ["path"], F.desc("item_id")).select("item_id", F.sha2(F.concat_ws(":", "p", "a", "c", "r"), 256).alias("content_hash"))


@query("D5", """WITH n AS (SELECT doc_id, source AS scope, lang || (doc_id % 30) AS name, coalesce(text, '') AS text FROM documents), k AS (SELECT * FROM n
  QUALIFY row_number() OVER (PARTITION BY name, scope ORDER BY doc_id DESC) = 1),
l AS (SELECT scope, string_agg('- [[' || name || ']]', chr(10) ORDER BY name) AS links FROM (SELECT scope, name FROM k
  QUALIFY row_number() OVER (PARTITION BY scope ORDER BY name) <= 50) GROUP BY scope)
SELECT name, scope, sha256('---' || chr(10) || 'name: ' || name || chr(10) || 'scope: ' || scope || chr(10) || '---' || chr(10) || text || chr(10) || '## Related' || chr(10) || links) AS content_hash FROM k JOIN l USING (scope)""")
def wiki_upserts(t: Tables):
    """The last node of each name and scope, its content rewritten with a head and at most 50 links, hashed as it is stored."""
    nodes = t("documents").select("doc_id", F.col("source").alias("scope"), F.concat("lang", F.col("doc_id") % 30).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    kept = dml.latest(nodes, ["name", "scope"], F.desc("doc_id"))
    first = kept.withColumn("k", F.row_number().over(Window.partitionBy("scope").orderBy("name"))).where("k <= 50")
    links = first.groupBy("scope").agg(F.array_join(F.transform(F.array_sort(F.collect_list("name")), lambda n: F.concat(F.lit("- [["), n, F.lit("]]"))), "\n").alias("links"))
    content = F.concat(F.lit("---\nname: "), "name", F.lit("\nscope: "), "scope", F.lit("\n---\n"), "text", F.lit("\n## Related\n"), "links")
    return kept.join(links, "scope").select("name", "scope", F.sha2(content, 256).alias("content_hash"))


@query("D6", """WITH m AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT p_brand AS entity, count(*) AS mentions,
  min(l_orderkey) AS first_seen FROM m GROUP BY p_brand""")
def entity_mentions(t: Tables):
    """Entities by name, inserted once and counted on, with an edge from each order that has one."""
    edges = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("src"), F.col("p_brand").alias("dst")).distinct()
    return edges.groupBy(F.col("dst").alias("entity")).agg(F.count("*").alias("mentions"), F.min("src").alias("first_seen"))


KV = """kv AS (SELECT user_id, CASE event_id % 3 WHEN 0 THEN event_type ELSE 'broadcast:' || event_type END AS key, value,
  CAST(floor(epoch(ts)) AS BIGINT) AS said, CASE event_id % 3 WHEN 1 THEN 300 WHEN 2 THEN 60 END AS ttl, ts, event_id FROM events)"""


@query("D7 P13 M3", f"""WITH {KV}, l AS (SELECT * FROM kv QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY ts DESC, event_id DESC) = 1)
  SELECT user_id, key, value, said + ttl AS expires_at, ttl IS NULL OR said + ttl > 1706745600 - 86400 AS live FROM l""")
def kv_upserts(t: Tables):
    """Latest values by session and key. A broadcast key may end in its seconds to live, 300 else; they aren't part of the key."""
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("broadcast:"), "event_type")).otherwise(F.concat(F.lit("broadcast:"), "event_type", F.lit(":60")))
    rows = dml.kv_rows(t("events").select(F.col("user_id").alias("session_id"), raw.alias("key"), "value", F.col("ts").alias("updated_at"), "event_id"))
    last = dml.latest(rows, ["session_id", "key"], F.desc("updated_at"), F.desc("event_id"))
    live = F.col("expires_at").isNull() | (F.col("expires_at") > anchor() - 86400)
    return last.select(F.col("session_id").alias("user_id"), "key", "value", "expires_at", live.alias("live"))


@query("D9", """SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus IN ('F', 'O') AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY)""")
def aged_deletes(t: Tables):
    """What is left once finished rows older than a year are gone."""
    end = t("orders").agg(F.max("o_orderdate").alias("end"))
    old = F.col("o_orderstatus").isin("F", "O") & (F.col("o_orderdate") < F.col("end") - F.expr("INTERVAL 365 DAYS"))
    return t("orders").crossJoin(F.broadcast(end)).where(~old).select("o_orderkey")


EDGES = """e AS (SELECT o_custkey AS src, o_orderkey % 500 AS dst, min(CAST(o_orderdate AS DATE)) AS valid_from, max(CASE
  WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 90 END) AS valid_to, max(CASE
  WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 100) / 100e0 END) AS confidence FROM orders GROUP BY 1, 2)"""


def dated_edges(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    return t("orders").groupBy(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 500).alias("dst")).agg(F.min(day).alias("valid_from"), F.max(F.when(F.col("o_orderstatus") == "F", F.date_add(day, 90))).alias("valid_to"), F.max(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 100 / 100.0)).alias("confidence"))


@query("D10", f"WITH {EDGES} SELECT src, dst, round(coalesce(confidence, 1e0), 6) AS confidence, valid_to < valid_from AS refused FROM e")
def checked_edges(t: Tables):
    """Edges once a pair, sure where nothing is said; an interval that ends before it starts is refused."""
    edges = dml.checked_edges(dated_edges(t), strict=False)
    return edges.select("src", "dst", F.round("confidence", 6).alias("confidence"), "refused")


@query("D11", f"""WITH {EDGES}, c AS (SELECT DISTINCT src FROM e WHERE dst = 7) SELECT src, dst, valid_from, CASE WHEN src IN (SELECT src
  FROM c) AND dst = 7 THEN DATE '1999-01-01' ELSE valid_to END AS valid_to FROM e""")
def edges_closed(t: Tables):
    """Edges to a node are closed, not deleted."""
    edges = dated_edges(t)
    return dml.close_edges(edges, edges.where("dst = 7"), F.lit("1999-01-01").cast("date")).select("src", "dst", "valid_from", "valid_to")


@query("D13", """SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING min(doc_id) < 10) ORDER BY doc_id""")
def mirrored(t: Tables):
    """Rows whose folder is still there; others are gone."""
    live = t("documents").groupBy("source").agg(F.min("doc_id").alias("first")).where("first < 10")
    return dml.mirror(t("documents"), live, "source").select("doc_id")


@query("D2 D14", """WITH d AS (SELECT doc_id, source, lang, sha256(coalesce(text, '')) AS hash, n_chars IS NULL OR doc_id % 97 = 0 AS bad FROM documents),
  h AS (SELECT DISTINCT hash FROM d WHERE lang = 'en'), b AS (SELECT * FROM d WHERE lang <> 'en'), n AS (SELECT *, hash IN (SELECT hash
  FROM h) AS known FROM b)
SELECT source, CAST(CASE WHEN bool_or(bad) THEN 0 ELSE count(DISTINCT hash) FILTER (NOT known) END AS BIGINT) AS inserted,
  CAST(count(*) FILTER (known) AS BIGINT) AS skipped, bool_or(bad) AS rolled_back FROM n GROUP BY source""")
def staged_saves(t: Tables):
    """Batches are saved as a whole or not at all; contents that are there already are skipped."""
    rows = t("documents").select("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), (F.col("n_chars").isNull() | (F.col("doc_id") % 97 == 0)).alias("bad"))
    known = rows.where("lang = 'en'").select("content_hash").distinct().withColumn("known", F.lit(True))
    batch = rows.where("lang <> 'en'").join(known, "content_hash", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    sums = batch.groupBy("source").agg(F.count_distinct(F.when(~F.col("known"), F.col("content_hash"))).alias("new"), F.count_if("known").alias("skipped"), F.bool_or("bad").alias("rolled_back"))
    return sums.select("source", F.when(F.col("rolled_back"), 0).otherwise(F.col("new")).cast("long").alias("inserted"), "skipped", "rolled_back")


@query("D16", """SELECT event_type AS key, arg_max(value, (ts, event_id)) AS value, CAST(floor(epoch(max(ts))) AS BIGINT) AS updated_at FROM events GROUP BY event_type""")
def profile_values(t: Tables):
    """Settings: one row a key, the last value wins."""
    return t("events").groupBy(F.col("event_type").alias("key")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max(epoch()).alias("updated_at"))


@query("D17", """WITH l AS (SELECT user_id AS session_id, event_type AS key, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2)
  SELECT session_id, key, value FROM l UNION ALL SELECT session_id + 100000, key, value FROM l WHERE session_id % 10 = 0""")
def handoff_copy(t: Tables):
    """A child session starts with all values of its parent."""
    kv = t("events").groupBy(F.col("user_id").alias("session_id"), F.col("event_type").alias("key")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    children = kv.where("session_id % 10 = 0").select("session_id", (F.col("session_id") + 100_000).alias("child")).distinct()
    return dml.hand_over_all(kv, children)


@query("D20", """SELECT doc_id, doc_id % 3 = 0 OR source = 'src1' AS processed, CASE WHEN doc_id % 5 = 0 THEN 'T' || doc_id ELSE lang END AS title, CASE
  WHEN n_chars > 5000 THEN 'completed' WHEN n_chars > 1000 THEN 'active' ELSE 'pending' END AS status FROM documents""")
def flag_updates(t: Tables):
    """Flags, titles and states that a table of changes sets; rows without a change stay."""
    rows = t("documents").select("doc_id", "source", F.lit(False).alias("processed"), F.col("lang").alias("title"), F.lit("pending").alias("status"), "n_chars")
    changes = [(F.expr("doc_id % 3 = 0 OR source = 'src1'"), {"processed": F.lit(True)}), (F.col("doc_id") % 5 == 0, {"title": F.concat(F.lit("T"), "doc_id")}), (F.col("n_chars") > 1000, {"status": F.lit("active")}), (F.col("n_chars") > 5000, {"status": F.lit("completed")})]
    return dml.updated(rows, changes).select("doc_id", "processed", "title", "status")


# Predicates


@query("P2 P3", f"""WITH {EPISODES}, s AS (SELECT id, CASE WHEN conv_id % 4 > 0 THEN session_id END AS session_id FROM episode) SELECT id FROM s
  WHERE session_id IS NULL OR regexp_replace(session_id, '_[0-9]{{1,3}}$', '') = 'u3'""")
def session_isolation(t: Tables):
    """Rows without a session and those of the user. The prefix u3 must not let u30 in."""
    rows = episodes(t).withColumn("session_id", F.when(F.col("conv_id") % 4 > 0, F.col("session_id")))
    return rows.where(F.col("session_id").isNull() | (c.user_prefix(F.col("session_id")) == "u3")).select("id")


@query("P1 P4 P5 P6 P7", """WITH d AS (SELECT doc_id, source AS scope, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS archived, CASE
  WHEN doc_id % 4 = 0 THEN 'x/wiki/artifacts/' || doc_id WHEN doc_id % 4 = 1 THEN 'x/notes' END AS vault_path, CASE doc_id % 5
  WHEN 0 THEN 'superseded' ELSE 'active' END AS status, CASE doc_id % 6 WHEN 0 THEN 'tool_execution' WHEN 1 THEN 'system_log'
  WHEN 2 THEN 'handoff_event' ELSE 'insight' END AS node_type FROM documents)
SELECT doc_id FROM d WHERE scope IN ('src1', 'general', 'src2') AND archived IS DISTINCT
  FROM true AND (vault_path IS NULL OR vault_path NOT LIKE '%wiki/artifacts/%') AND status <> 'superseded' AND node_type NOT IN ('tool_execution', 'system_log', 'handoff_event')""")
def visible_rows(t: Tables):
    """Scope, archive, artifacts, status and node type, together."""
    i = F.col("doc_id")
    kinds = c.first_match([(i % 6 == 0, "tool_execution"), (i % 6 == 1, "system_log"), (i % 6 == 2, "handoff_event")], "insight")
    rows = t("documents").select(
        "doc_id", F.col("source").alias("scope"), F.when(i % 3 == 0, True).when(i % 3 == 1, False).alias("archived"),
        F.when(i % 4 == 0, F.concat(F.lit("x/wiki/artifacts/"), "doc_id")).when(i % 4 == 1, "x/notes").alias("vault_path"),
        F.when(i % 5 == 0, "superseded").otherwise("active").alias("status"), kinds.alias("node_type"),
    )
    return rows.where(folds.visible(["src1", "src2"])).select("doc_id")


@query("P9", "SELECT conv_id, turn FROM conversations WHERE list_contains(regexp_split_to_array(lower(text), '[^a-zà-ÿ]+'), 'the')")
def array_membership(t: Tables):
    """Rows whose concepts have a word."""
    return t("conversations").where(F.array_contains(F.split(F.lower("text"), "[^a-zà-ÿ]+"), "the")).select("conv_id", "turn")


@query("P11", """WITH p AS (SELECT vec_id, [label % 3, label] AS concepts, ['f' || (vec_id % 6)] AS files_read, ['f' || (vec_id % 7)] AS files_modified,
  row_number() OVER (ORDER BY vec_id DESC) AS k FROM embeddings), q AS (SELECT * FROM p WHERE k <= 45), f AS (SELECT * FROM q
  WHERE (list_contains(concepts, 2) OR list_contains(concepts, 7)) AND (list_contains(files_read, 'f1') OR list_contains(files_modified, 'f1')))
SELECT vec_id FROM (SELECT * FROM f UNION ALL SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM f)) x ORDER BY k LIMIT 15""")
def structured_filter(t: Tables):
    """Three times the limit is fetched and filtered by concepts and files; if nothing is left, the filter doesn't count."""
    rows = t("embeddings").select("vec_id", F.array(F.col("label") % 3, "label").alias("concepts"), F.array(F.concat(F.lit("f"), F.col("vec_id") % 6)).alias("files_read"), F.array(F.concat(F.lit("f"), F.col("vec_id") % 7)).alias("files_modified"))
    return folds.structured(rows, F.desc("vec_id"), [2, 7], ["f1"], 15).select("vec_id")


@query("P11", """SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 15""")
def structured_floor(t: Tables):
    """The same filter where nothing passes it."""
    rows = t("embeddings").select("vec_id", F.array("label").alias("concepts"), F.array(F.lit("a")).alias("files_read"), F.array(F.lit("b")).alias("files_modified"))
    return folds.structured(rows, F.col("vec_id"), [-1], ["a"], 15).select("vec_id")


@query("P14 P15", """SELECT vec_id, CASE WHEN label >= 8 THEN 'keyword' ELSE 'vector' END AS path, (vec_id % 100) / 100e0 >= CASE WHEN label >= 8 THEN 0.7e0 * 0.55e0
  ELSE 0.5e0 * 0.55e0 END AS kept FROM embeddings""")
def score_thresholds(t: Tables):
    """High confidence skips the vector search; each path has a share of the threshold of its own."""
    path = F.when(0.77 + F.col("label") / 100.0 >= 0.85, "keyword").otherwise("vector")
    bar = F.when(F.col("path") == "keyword", 0.7 * 0.55).otherwise(0.5 * 0.55)
    return t("embeddings").withColumn("path", path).select("vec_id", "path", (F.col("vec_id") % 100 / 100.0 >= bar).alias("kept"))


@query("P19", """WITH n AS (SELECT item_id, (item_id % 10) / 10e0 AS sim, text FROM benchmark) SELECT item_id, CASE WHEN sim >= 0.8 THEN 'full'
  WHEN sim >= 0.6 THEN 'index' ELSE 'drop' END AS level, CASE WHEN sim >= 0.8 THEN text
  WHEN sim >= 0.6 THEN trim(regexp_extract(text, '^[^.!?]*')) END AS said FROM n""")
def disclosure(t: Tables):
    """All of a close text, the first sentence of a near one, nothing of others."""
    sim = F.col("item_id") % 10 / 10.0
    first = F.trim(F.regexp_extract("text", r"^[^.!?]*", 0))
    return t("benchmark").select("item_id", F.when(sim >= 0.8, "full").when(sim >= 0.6, "index").otherwise("drop").alias("level"), F.when(sim >= 0.8, F.col("text")).when(sim >= 0.6, first).alias("said"))


@query("P16", """WITH r AS (SELECT item_id, unnest(list_distinct(list_transform(range(0,
  CAST(floor((length(text) - 1) / 5e0) AS BIGINT) + 1), lambda i: lower(substr(text, CAST(i * 5 + 1 AS INT), 5))))) AS p FROM benchmark
  WHERE text <> ''), h AS (SELECT p, count(*) AS hits FROM (SELECT DISTINCT p FROM r) a JOIN conversations c ON contains(lower(c.text), a.p)
  GROUP BY p) SELECT item_id, CAST(sum(hits) AS BIGINT) AS hits FROM r JOIN h USING (p) GROUP BY item_id""")
def guardrails(t: Tables):
    """Turns that contain a rule's pattern. Patterns are pieces of a few characters; all of them are looked for in one pass through a turn."""
    text = F.col("text")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / 5).cast("int")), lambda i: F.lower(F.substring(text, i * 5 + 1, F.lit(5))))
    rules = t("benchmark").where("text <> ''").select("item_id", F.explode(F.array_distinct(cut)).alias("pattern"))
    return folds.contained(rules, t("conversations").select(F.lower("text").alias("text")), "pattern", "text", 5).groupBy("item_id").agg(F.sum("hits").alias("hits"))


@query("P16", """WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT r.vec_id AS rule_id, e.vec_id,
  round(list_dot_product(r.e, e.e) / sqrt(list_dot_product(r.e, r.e) * list_dot_product(e.e, e.e)), 9) AS s FROM u r JOIN u e ON r.vec_id <> e.vec_id
  WHERE r.vec_id % 100 = 0) SELECT rule_id, vec_id AS turn_id FROM c WHERE s > 0.3""")
def guardrail_neighbours(t: Tables):
    """Turns that a rule's vector is close to: the rules pass the turns in blocks."""
    e = t("embeddings").select(F.col("vec_id").alias("id"), vectors.unit(F.col("embedding")).alias("embedding"))
    return vectors.within(e, e.where("id % 100 = 0"), 0.3, strict=True).select(F.col("query_id").alias("rule_id"), F.col("id").alias("turn_id"))


# Joins


@query("J4 A7", """WITH e AS (SELECT o_custkey AS src, o_orderkey AS dst, o_totalprice / 1000000e0 AS confidence FROM orders), s AS (SELECT c_custkey AS id
  FROM customer WHERE c_mktsegment = 'BUILDING') SELECT id, round(max(confidence) * 0.7e0, 5) AS activation FROM (SELECT dst AS id, confidence FROM e
  WHERE src IN (SELECT id FROM s) UNION ALL SELECT src, confidence FROM e WHERE dst IN (SELECT id FROM s)) x GROUP BY id""")
def spreading_activation(t: Tables):
    """From matched entities over edges at either end to episodes, the strongest one counts."""
    edges = t("orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), (F.col("o_totalprice") / 1000000.0).alias("confidence"))
    matched = t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    return graphs.activated(edges, matched, 0.7).select("id", F.round("activation", 5).alias("activation"))


@query("J10", """SELECT d.doc_id, coalesce(m.n, 0) AS accesses, coalesce(m.utility, 50e0) AS utility FROM documents d LEFT JOIN (SELECT user_id, count(*) AS n,
  round(avg(value), 4) AS utility FROM events GROUP BY user_id) m ON m.user_id = d.doc_id""")
def metrics_lookup(t: Tables):
    """Rows with their metrics, or what holds where there are none."""
    metrics = t("events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("utility"))
    return t("documents").select("doc_id").join(metrics, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("accesses"), F.coalesce("utility", F.lit(50.0)).alias("utility"))


@query("J11", f"""WITH {EPISODES}, n AS (SELECT id, conv_id, turn, CASE WHEN conv_id % 4 > 0 THEN 'u' || (conv_id % 5) END AS prefix FROM episode), p AS (SELECT *
  FROM n WHERE turn = 0) SELECT p.id AS primary_id, n.id AS neighbour FROM p
  JOIN n ON n.conv_id IN (p.conv_id, p.conv_id + 5, p.conv_id + 1) AND n.turn = 1 AND n.prefix IS NOT DISTINCT FROM p.prefix""")
def same_user_neighbours(t: Tables):
    """Neighbours of the same user; no user meets no user."""
    rows = episodes(t).withColumn("prefix", F.when(F.col("conv_id") % 4 > 0, c.user_prefix(F.col("session_id"))))
    primary = rows.where("turn = 0").select(F.col("id").alias("primary_id"), F.explode(F.array("conv_id", F.col("conv_id") + 5, F.col("conv_id") + 1)).alias("conv_id"), F.col("prefix").alias("p"))
    near = rows.where("turn = 1").select(F.col("id").alias("neighbour"), "conv_id", "prefix")
    return primary.join(near, (primary["conv_id"] == near["conv_id"]) & F.col("p").eqNullSafe(F.col("prefix"))).select("primary_id", "neighbour")


@query("J2 R5", """WITH f AS (SELECT c_nationkey AS src, c_custkey AS dst FROM customer), e AS (SELECT src AS node, dst AS other, 0 AS dir FROM f UNION
  SELECT dst + 1000, src, 1 FROM f) SELECT node, other FROM e QUALIFY row_number() OVER (PARTITION BY node ORDER BY dir, other) <= 10""")
def related_nodes(t: Tables):
    """At most ten related nodes a node, outgoing ones first; only the ten best of a hot node leave a task."""
    f = t("customer").select(F.col("c_nationkey").alias("src"), F.col("c_custkey").alias("dst"))
    both = f.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(0).alias("dir")).union(f.select(F.col("dst") + 1000, "src", F.lit(1))).distinct()
    return folds.first_of_each(both, ["node"], 10, "dir", "other").select("node", "other")


# Aggregates


@query("A12", """SELECT source, CAST(len(list_distinct(flatten(list(w)))) AS BIGINT) AS words
  FROM (SELECT source, regexp_split_to_array(lower(coalesce(text, '')), '\\s+') AS w FROM documents) x GROUP BY source""")
def array_unions(t: Tables):
    """Distinct elements of all rows' arrays. Elements are counted as rows, so no array holds a whole group."""
    return t("documents").select("source", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")).alias("w")).groupBy("source").agg(F.count_distinct("w").alias("words"))


@query("A13", "SELECT conv_id, string_agg(role || ' ' || turn, ' | ' ORDER BY turn) AS insights FROM conversations GROUP BY conv_id")
def joined_insights(t: Tables):
    """Children's texts in order, as one."""
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(" "), "turn").alias("s"))))
    return t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["s"]), " | ").alias("insights"))


# Windows


@query("W6 W5", """WITH h AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '- **User**: ' ELSE '- **Assistant**: ' END || coalesce(text, '') || chr(10) AS line
  FROM conversations), r AS (SELECT *, row_number() OVER w AS k, sum(CAST(ceil(strlen(line) / 4e0) AS BIGINT)) OVER w AS used
  FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) SELECT conv_id, turn, k FROM r WHERE k <= 10 AND 1500 + used <= 2048""")
def budgeted_history(t: Tables):
    """The newest ten turns, until the first one that the budget behind the context doesn't hold."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    line = F.concat(F.when(F.col("role") == "user", "- **User**: ").otherwise("- **Assistant**: "), F.coalesce("text", F.lit("")), F.lit("\n"))
    rows = t("conversations").select("conv_id", "turn", F.ceil(F.octet_length(line) / 4).alias("tokens"))
    return rows.withColumn("k", F.row_number().over(w)).where("k <= 10").withColumn("used", F.sum("tokens").over(w)).where(1500 + F.col("used") <= 2048).select("conv_id", "turn", "k")


@query("W7 R20", """WITH r AS (SELECT source, doc_id, n_chars, doc_id % 9 = 0 AS pinned, 0.2e0 * sum(n_chars) OVER (PARTITION BY source) AS excess FROM documents),
  f AS (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY source
  ORDER BY n_chars, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM r WHERE NOT pinned) SELECT source, doc_id FROM f
  WHERE freed < excess""")
def evictions(t: Tables):
    """Unpinned rows, the least important first, until enough is freed."""
    excess = t("documents").groupBy("source").agg((0.2 * F.sum("n_chars")).alias("excess"))
    rows = t("documents").select("source", "doc_id", "n_chars", (F.col("doc_id") % 9 == 0).alias("pinned")).join(excess, "source")
    held = ranks.within(rows.where(~F.col("pinned")), ["source"], "n_chars", "doc_id", total="n_chars")
    return held.where(F.col("upto") - F.coalesce("n_chars", F.lit(0)) < F.col("excess")).select("source", "doc_id")


@query("R20", """WITH a AS (SELECT user_id % 3 AS shard, user_id, max(ts) AS last_use, user_id % 7 = 0 AS pinned FROM events GROUP BY user_id), k AS (SELECT *,
  count(*) OVER (PARTITION BY shard) AS n, row_number() OVER (PARTITION BY shard, pinned ORDER BY last_use, user_id) AS k FROM a)
  SELECT shard, user_id FROM k WHERE NOT pinned AND k <= n - 4""")
def lru_evictions(t: Tables):
    """Over the capacity of four, the least recently used rows that aren't pinned go."""
    used = t("events").groupBy("user_id").agg(F.max("ts").alias("last_use")).select((F.col("user_id") % 3).alias("shard"), "user_id", "last_use", (F.col("user_id") % 7 == 0).alias("pinned"))
    sizes = used.groupBy("shard").agg(F.count("*").alias("n"))
    rows = ranks.within(used.where(~F.col("pinned")), ["shard"], "last_use", "user_id").join(sizes, "shard")
    return rows.where(F.col("k") <= F.col("n") - 4).select("shard", "user_id")


@query("W14", """WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN 'tool_result'
  WHEN role = 'assistant' AND turn % 4 = 1 THEN 'computer' ELSE role END AS role FROM conversations), k AS (SELECT *,
  row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM r) SELECT conv_id, turn, CASE WHEN role = 'user' THEN CASE
  WHEN k = 1 THEN 'user_input' ELSE 'user_feedback' END WHEN role = 'assistant' THEN 'agent_thought'
  WHEN role IN ('tool', 'computer', 'tool_result') THEN 'tool_execution' WHEN role = 'system' THEN 'system_log' END AS node_type FROM k""")
def node_types_of_turns(t: Tables):
    """Node types by role; a user's first turn is the input, later ones are feedback."""
    role = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 3), "tool_result").when((F.col("role") == "assistant") & (F.col("turn") % 4 == 1), "computer").otherwise(F.col("role"))
    rows = t("conversations").select("conv_id", "turn", role.alias("role")).withColumn("first", F.min(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id")))
    kind = c.first_match([((F.col("role") == "user") & (F.col("turn") == F.col("first")), "user_input"), (F.col("role") == "user", "user_feedback"), (F.col("role") == "assistant", "agent_thought"), (F.col("role").isin("tool", "computer", "tool_result"), "tool_execution"), (F.col("role") == "system", "system_log")], F.lit(None))
    return rows.select("conv_id", "turn", kind.alias("node_type"))


@query(
    "W15",
    """WITH RECURSIVE s AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f(user_id, event_id, i, kind, inputs, segment) AS (SELECT user_id, event_id, i, event_type, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END, 0 FROM s
  WHERE i = 1 UNION ALL
SELECT s.user_id, s.event_id, s.i, s.event_type, CASE
  WHEN s.event_type = 'view' AND f.inputs >= 3 OR (s.event_type = 'purchase') <> (f.kind = 'purchase') OR (s.event_type = 'click') <> (f.kind = 'click') THEN 0 ELSE f.inputs END + CASE WHEN s.event_type = 'view' THEN 1 ELSE 0 END,
  f.segment + CASE WHEN s.event_type = 'view' AND f.inputs >= 3 OR (s.event_type = 'purchase') <> (f.kind = 'purchase') OR (s.event_type = 'click') <> (f.kind = 'click') THEN 1 ELSE 0 END FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)
SELECT user_id, event_id, segment FROM f""",
)
def transcript_segments(t: Tables):
    """Segments end where edits or tool calls begin or end, and before an input behind so many (three here). The count starts anew with
    each segment, which makes the cuts behind a change a division."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    edit, tool, said = F.col("event_type") == "purchase", F.col("event_type") == "click", F.col("event_type") == "view"
    change = F.coalesce((edit != F.lag(edit).over(w)) | (tool != F.lag(tool).over(w)), F.lit(False))
    rows = t("events").select("user_id", "event_id", "event_type", "ts").withColumn("base", F.sum(change.cast("int")).over(w))
    inside = Window.partitionBy("user_id", "base").orderBy("ts", "event_id")
    rows = rows.withColumn("inputs", F.sum(said.cast("int")).over(inside)).withColumn("part", F.expr("(greatest(inputs, 1) - 1) DIV 3"))
    fresh = F.coalesce((F.col("base") != F.lag("base").over(w)) | (F.col("part") != F.lag("part").over(w)), F.lit(False))
    return rows.withColumn("segment", F.sum(fresh.cast("int")).over(w).cast("int")).select("user_id", "event_id", "segment")


@query("W17 R17 S9", f"""WITH a AS (SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id),
  u AS (SELECT user_id, n * exp(-(epoch({A}) - floor(epoch(last))) / 86400e0 * ln(2) / 365) AS u FROM a) SELECT user_id, round(u, 6) AS utility
  FROM u ORDER BY round(u, 9) DESC, user_id LIMIT 500""")
def half_life_cap(t: Tables):
    """The 500 of the greatest utility after decay."""
    rows = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    u = F.col("n") * F.exp(-(anchor() - epoch("last")) / 86400 * F.log(F.lit(2.0)) / 365)
    return rows.select("user_id", u.alias("u")).orderBy(F.round("u", 9).desc(), "user_id").limit(500).select("user_id", F.round("u", 6).alias("utility"))


# Top and order


@query("K6", "SELECT doc_id FROM documents ORDER BY md5('5:' || doc_id), doc_id LIMIT 5")
def random_five(t: Tables):
    """A sample of five that a seed decides, whatever the order of the rows."""
    return t("documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("5:"), "doc_id").cast("binary")), "doc_id").limit(5)


@query("K7", """WITH p AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE o_orderpriority WHEN '1-URGENT' THEN 'Immediate' ELSE 'Normal' END AS priority FROM orders
  WHERE o_orderstatus = 'O'), i AS (SELECT o_custkey, o_orderkey FROM p WHERE priority = 'Immediate'
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1)
SELECT o_custkey, o_orderkey FROM i UNION ALL SELECT o_custkey, o_orderkey FROM p WHERE o_custkey NOT IN (SELECT o_custkey FROM i)
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) <= 3""")
def priority_pick(t: Tables):
    """Each customer's first immediate task, or else the first three others."""
    rows = t("orders").where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_orderpriority") == "1-URGENT").alias("immediate"))
    w = Window.partitionBy("o_custkey").orderBy(F.desc("immediate"), "o_orderdate", "o_orderkey")
    rows = rows.withColumn("k", F.row_number().over(w)).withColumn("urgent", F.max("immediate").over(Window.partitionBy("o_custkey")))
    return rows.where(F.col("k") <= F.when(F.col("urgent"), 1).otherwise(3)).select("o_custkey", "o_orderkey")


@query("K9", """SELECT user_id, event_id, k FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events
  WHERE event_type = 'purchase') x WHERE k <= 5""")
def latest_checkpoints(t: Tables):
    """Checkpoints of a session, the latest first."""
    kept = folds.first_of_each(t("events").where("event_type = 'purchase'").select("user_id", "event_id", "ts"), ["user_id"], 5, F.desc("ts"), F.desc("event_id"))
    return kept.select("user_id", "event_id", "k")


# Sets


@query("E1", """SELECT 'episode:' || conv_id || '_' || turn AS id, 'session' AS tier, role AS title, text AS content, 'u' || (conv_id % 5) AS session_id,
  CAST(NULL AS VARCHAR) AS scope, CAST(NULL AS DOUBLE) AS utility FROM conversations UNION ALL
  SELECT 'wiki_node:' || doc_id, 'project', lang, text, NULL, source, 50e0 FROM documents
UNION ALL SELECT 'wisdom:' || item_id, 'wisdom', 'rule', text, NULL, 'general', item_id % 101 + 0e0 FROM benchmark UNION ALL
  SELECT 'code_symbol:' || p_partkey, 'project', p_name, NULL, NULL, p_brand, NULL FROM part""")
def candidate_union(t: Tables):
    """Episodes, insights, rules and symbols in one shape."""
    ep = t("conversations").select(F.concat(F.lit("episode:"), "conv_id", F.lit("_"), "turn").alias("id"), F.lit("session").alias("tier"), F.col("role").alias("title"), F.col("text").alias("content"), F.concat(F.lit("u"), F.col("conv_id") % 5).alias("session_id"))
    wiki = t("documents").select(F.concat(F.lit("wiki_node:"), "doc_id").alias("id"), F.lit("project").alias("tier"), F.col("lang").alias("title"), F.col("text").alias("content"), F.col("source").alias("scope"), F.lit(50.0).alias("utility"))
    rule = t("benchmark").select(F.concat(F.lit("wisdom:"), "item_id").alias("id"), F.lit("wisdom").alias("tier"), F.lit("rule").alias("title"), F.col("text").alias("content"), F.lit("general").alias("scope"), (F.col("item_id") % 101).cast("double").alias("utility"))
    symbol = t("part").select(F.concat(F.lit("code_symbol:"), "p_partkey").alias("id"), F.lit("project").alias("tier"), F.col("p_name").alias("title"), F.col("p_brand").alias("scope"))
    out = ep
    for other in (wiki, rule, symbol):
        out = out.unionByName(other, allowMissingColumns=True)
    return out.select("id", "tier", "title", "content", "session_id", "scope", "utility")


@query("V6", """WITH b AS (SELECT item_id, list_transform(range(0, CAST(floor(length(text) / 40e0) AS BIGINT) + 1), lambda i: substr(text,
  CAST(i * 40 + 1 AS INT), 40)) AS parts FROM benchmark) SELECT b.item_id, count(d.doc_id) AS hits FROM b LEFT
  JOIN documents d ON contains(d.text, b.parts[1]) AND len(list_filter(b.parts, lambda x: NOT contains(d.text, x))) = 0 GROUP BY b.item_id""")
def fragment_recall(t: Tables):
    """Documents that hold every fragment of an item. A word inside a fragment finds the few documents to look at."""
    text = F.col("text")
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / 40).cast("int")), lambda i: F.substring(text, i * 40 + 1, F.lit(40)))
    items = t("benchmark").select("item_id", parts.alias("parts"))
    return folds.all_parts(items, "item_id", "parts", t("documents").select("doc_id", "text"), "text")
