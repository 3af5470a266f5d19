"""SQL that DataFrame plans of the same name are checked against, by their common parts. Each over the whole of its tables."""

from __future__ import annotations

from recollect.functions.words import SPELLING, STOP_WORDS, SYNONYMS, TEMPORAL
from recollect.plans.dialect import Plan

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
QUERY = ("thnd", "ering", "oner")  # terms of the sample query, in any corpus of the test generator
ANCHOR = "TIMESTAMP '2024-02-01 00:00:00'"

TOKENS = f"""tokens AS (SELECT doc_id, source, @EXPLODE(@KEEP(@SPLIT(lower(text), @R'[^\\p{{L}}\\p{{N}}-]+'), x => x <> '' AND NOT x IN ({STOPS}))) AS term
  FROM documents),
tf AS (SELECT doc_id, source, term, count(*) AS n FROM tokens GROUP BY doc_id, source, term),
lengths AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS dl FROM tf GROUP BY doc_id),
corpus AS (SELECT (SELECT count(*) FROM documents) AS n_docs, CAST(sum(dl) AS DOUBLE) / (SELECT count(*) FROM documents) AS avgdl FROM lengths)"""
TERMS = "wanted AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in QUERY) + ") AS v(term))"
BM25 = f"""{TOKENS}, {TERMS},
hits AS (SELECT tf.doc_id, tf.term, tf.n, l.dl FROM tf JOIN wanted w ON tf.term = w.term JOIN lengths l ON tf.doc_id = l.doc_id),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
scored AS (SELECT h.doc_id, sum(ln((c.n_docs - d.df + 0.5) / (d.df + 0.5) + 1) * h.n * 2.2 / (h.n + 1.2 * (1 - 0.6 + 0.6 * h.dl / c.avgdl))) AS bm25
  FROM hits h JOIN df d ON h.term = d.term CROSS JOIN corpus c GROUP BY h.doc_id)"""
VECTOR = """probe AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
near AS (SELECT vec_id, label, @DOT(embedding, q) AS sim FROM embeddings CROSS JOIN probe WHERE vec_id <> 0)"""
EPISODES = """episode AS (SELECT concat('episode:', CAST(conv_id AS VARCHAR(20)), '_', CAST(turn AS VARCHAR(20))) AS id, concat('conv_',
  CAST(conv_id AS VARCHAR(20))) AS session_id, conv_id, turn, role, text FROM conversations)"""
ACCESS = f"""access AS (SELECT user_id, count(*) AS n, max(ts) AS last_ts FROM events GROUP BY user_id),
aged AS (SELECT user_id, n, (@EPOCH({ANCHOR}) - @EPOCH(last_ts)) / 3600.0 AS hours, (@EPOCH({ANCHOR}) - @EPOCH(last_ts)) / 86400.0 AS days
  FROM access)"""
EDGES = """edges AS (SELECT o_custkey AS src, o_orderkey AS dst, CAST(o_orderdate AS DATE) AS valid_from, CASE
  WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + INTERVAL '90' DAY END AS valid_to, o_totalprice / 1000000.0 AS confidence FROM orders)"""
FOLLOWS = f"""{EPISODES}, followed AS (SELECT id AS src, lead(id) OVER (PARTITION BY conv_id ORDER BY turn, id) AS dst FROM episode)"""
RANKED = """ranked AS (SELECT q.vec_id AS query_id, q.label AS gold, e.vec_id, e.label, row_number() OVER (PARTITION BY q.vec_id
  ORDER BY round(@DOT(q.embedding, e.embedding), 9) DESC, e.vec_id) AS rank
  FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q JOIN embeddings e ON q.vec_id <> e.vec_id), top AS (SELECT * FROM ranked WHERE rank <= 10)"""


def spelled(word: str) -> str:
    first = "CASE " + word + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPELLING.items()) + f" ELSE {word} END"
    return "CASE (" + first + ") " + " ".join(f"WHEN '{w}' THEN '{k}'" for w, k in SYNONYMS.items()) + f" ELSE ({first}) END"


def redacted_sql(text: str) -> str:
    """A text without its secrets."""
    return r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(""" + text + r""",
 '((?i:password|passwd|secret|token|api[_-]?key)["'']?\s*[:=]\s*)"[^"\n]+"', '\1"[REDACTED]"', 'g'), '((?i:password|passwd|secret|token|api[_-]?key)["'']?\s*[:=]\s*)''[^''\n]+''', '\1''[REDACTED]''', 'g'),
 'AKIA[0-9A-Z]{16}', '[REDACTED]', 'g'), 'gh[pousr]_[A-Za-z0-9]{36,}', '[REDACTED]', 'g'), '(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----', '[REDACTED]', 'g'),
 'eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+', '[REDACTED]', 'g'), '(export\s+[A-Za-z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD)[A-Za-z0-9_]*=)\S+', '\1[REDACTED]', 'g')"""


PLANS: dict[str, Plan] = {
    # lexical
    "bm25_topk": Plan("C1 T1 T2 A4 A5 S11 S12 K1 K3", f"WITH {BM25} SELECT doc_id, round(bm25, 6) AS bm25 FROM scored ORDER BY round(bm25, 6) DESC, doc_id LIMIT 10"),
    "bm25_normalized": Plan("S13 A6", f"""WITH {BM25}, e AS (SELECT min(bm25) AS lo, max(bm25) AS hi FROM scored) SELECT doc_id, round(CASE WHEN hi - lo > 1e-6 THEN (bm25 - lo) / (hi - lo)
  WHEN hi > 1e-6 THEN 1.0 ELSE 0.0 END, 6) AS score FROM scored CROSS JOIN e"""),
    "term_df_two_scopes": Plan("A2", f"WITH {TOKENS} SELECT term, count(*) AS document_frequency FROM tf WHERE source IN ('src0', 'src1') GROUP BY term"),
    "document_lengths": Plan("A5", f"WITH {TOKENS} SELECT l.doc_id, l.dl, round(l.dl / c.avgdl, 6) AS ratio FROM lengths l CROSS JOIN corpus c"),
    "term_frequencies": Plan("A5 T1", f"WITH {TOKENS} SELECT doc_id, count(*) AS terms, CAST(sum(n) AS BIGINT) AS n_tokens, max(n) AS most FROM tf GROUP BY doc_id"),
    "sentence_rerank": Plan(
        "S14",
        f"""WITH {BM25}, idf AS (SELECT d.term, ln((c.n_docs - d.df + 0.5) / (d.df + 0.5) + 1) AS idf FROM df d CROSS JOIN corpus c),
pool AS (SELECT doc_id, bm25 FROM scored ORDER BY round(bm25, 9) DESC, doc_id LIMIT 20),
cut AS (SELECT doc_id, @SPLIT(text, @R'[.\\n]') AS parts FROM documents), sent AS (SELECT p.doc_id, n.i, lower(@GET(p.parts, n.i)) AS s
  FROM (SELECT cut.* FROM cut JOIN pool ON cut.doc_id = pool.doc_id) p JOIN (SELECT doc_id, @EXPLODE(@RANGE(1, @LEN(parts))) AS i
  FROM cut) n ON p.doc_id = n.doc_id),
words AS (SELECT doc_id, i, @EXPLODE(@KEEP(@SPLIT(s, @R'[^\\p{{L}}\\p{{N}}-]+'), x => x <> '' AND NOT x IN ({STOPS}))) AS term FROM sent),
counts AS (SELECT doc_id, i, term, count(*) AS n FROM words GROUP BY doc_id, i, term),
cos AS (SELECT k.doc_id, k.i, sum(k.n * f.idf * f.idf) / (sqrt(sum(CAST(k.n AS DOUBLE) * k.n * coalesce(f.idf, 1.0) * coalesce(f.idf, 1.0))) * (SELECT sqrt(sum(idf * idf)) FROM idf)) AS c FROM counts k LEFT JOIN idf f ON k.term = f.term GROUP BY k.doc_id, k.i)
SELECT p.doc_id, round(p.bm25 + 0.1 * coalesce(max(c.c), 0.0), 6) AS score FROM pool p LEFT JOIN cos c ON p.doc_id = c.doc_id
  GROUP BY p.doc_id, p.bm25""",
    ),
    "token_overlap": Plan("S16", """WITH a AS (SELECT doc_id, @DISTINCT(@KEEP(@SPLIT(lower(text), @R'\\s+'), x => @BYTES(x) > 3)) AS w FROM documents),
  p AS (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS v FROM a) SELECT doc_id, round(CASE
  WHEN @LEN(w) = 0 OR @LEN(v) = 0 THEN 0.0
  ELSE 5.0 * @LEN(@KEEP(w, x => array_contains(v, x))) / (@LEN(w) + @LEN(v) - @LEN(@KEEP(w, x => array_contains(v, x)))) END, 6) AS overlap FROM p
  WHERE v IS NOT NULL"""),
    # text
    "content_hash": Plan("S24 H7", "SELECT doc_id, @SHA(text) AS content_hash FROM documents"),
    "exact_dedup": Plan("H6", """SELECT doc_id, content_hash FROM (SELECT doc_id, @SHA(text) AS content_hash, row_number() OVER (PARTITION BY @SHA(text) ORDER BY doc_id) AS k
  FROM documents) t WHERE k = 1"""),
    "dup_groups": Plan("H6", "SELECT @SHA(text) AS content_hash, count(*) AS copies, min(doc_id) AS kept FROM documents GROUP BY @SHA(text) HAVING count(*) > 1"),
    "new_hashes": Plan("J6", """SELECT d.doc_id FROM documents d WHERE d.source <> 'src0' AND NOT EXISTS (SELECT 1 FROM documents o
  WHERE o.source = 'src0' AND @SHA(o.text) = @SHA(d.text))"""),
    "temporal_words_removed": Plan("T6", "SELECT conv_id, turn, trim(@SUB(@SUB(lower(text), @R'\\b(" + "|".join(TEMPORAL) + ")\\b', ''), @R'\\s+', ' ')) AS cleaned FROM conversations"),
    "synonyms_expanded": Plan("T5", "WITH w AS (SELECT conv_id, turn, @EXPLODE(@SPLIT(lower(text), @R'[^a-z]+')) AS w FROM conversations) SELECT conv_id, turn, " + spelled("w") + " AS term, count(*) AS n FROM w WHERE w <> '' GROUP BY conv_id, turn, " + spelled("w")),
    "user_prefix": Plan("P3", f"WITH {EPISODES} SELECT id, @SUB(session_id, @R'_[0-9]{{1,3}}$', '') AS prefix FROM episode"),
    "turn_index": Plan("T26", f"""WITH {EPISODES}, t AS (SELECT id, concat('Session ', session_id, ' - Turn ', CAST(turn AS VARCHAR(20))) AS title FROM episode) SELECT id,
  CAST(@FIND(title, @R' - Turn ([0-9]+)$', 1) AS BIGINT) AS turn_index FROM t"""),
    "scope_from_url": Plan("", """SELECT page_id, @FIND(url, @R'^https?://([^/?#]+)', 1) AS host,
  coalesce(nullif(@FIND(url, @R'^https?://[^/]+/([^/?#]+)', 1), ''), 'general') AS scope FROM pages"""),
    "checklist_lines": Plan("T22", """WITH l AS (SELECT doc_id, @EXPLODE(@SPLIT(text, @R'\\n')) AS line FROM documents) SELECT doc_id, @SUB(line, @R'^\\s+|\\s+$', '') AS line FROM l
  WHERE contains(line, '- [ ]') OR contains(line, '- [x]')"""),
    "sanitised_ids": Plan("T28", "SELECT page_id, coalesce(nullif(@SUB(url, @R'[^A-Za-z0-9_-]', ''), ''), 'unknown') AS id FROM pages"),
    # scans, filters, sets
    "point_lookup": Plan("C3 J5", f"WITH {EPISODES} SELECT id, role FROM episode WHERE id IN ('episode:1_0', 'episode:2_1', 'bad', 'rule:7')"),
    "missing_values": Plan("C15", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL"),
    "scope_visibility": Plan("P1 P5", f"WITH {EPISODES} SELECT id FROM episode WHERE (session_id IN ('conv_1', 'conv_2') OR role = 'system') AND role NOT IN ('tool')"),
    "substring_any": Plan("P8 E5", """SELECT 'document' AS kind, doc_id AS id FROM documents WHERE contains(text, 'thening') UNION ALL SELECT 'benchmark', item_id FROM benchmark
  WHERE contains(text, 'thening') UNION ALL SELECT 'conversation', conv_id * 1000 + turn FROM conversations WHERE contains(text, 'thening')"""),
    "utility_default": Plan("P10", """SELECT d.doc_id, coalesce(l.quality * 100.0, 50.0) AS utility, round(0.7 + 0.3 * coalesce(l.quality * 100.0, 50.0), 6) AS factor FROM documents d
  LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    "ttl_expired": Plan("P13", f"SELECT event_id FROM events WHERE @EPOCH(ts) + 20 * 86400 < @EPOCH({ANCHOR})"),
    "disclosure_levels": Plan("P19", f"""WITH {VECTOR} SELECT vec_id, CASE WHEN round(sim, 9) >= 0.8 THEN 'full' WHEN round(sim, 9) >= 0.6 THEN 'index' ELSE 'drop' END AS level FROM near"""),
    "union_last_wins": Plan("E2", """WITH u AS (SELECT o_custkey AS id, 1 AS pri, count(*) AS n FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey, 0, 0 FROM customer)
  SELECT id, n FROM (SELECT id, n, row_number() OVER (PARTITION BY id ORDER BY pri DESC) AS k FROM u) t WHERE k = 1"""),
    "edge_difference": Plan("D12 E3", """WITH have AS (SELECT DISTINCT o_custkey AS src, o_orderstatus AS dst FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01 00:00:00'),
  want AS (SELECT DISTINCT o_custkey AS src, o_orderstatus AS dst FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00')
  SELECT 'delete' AS op, src, dst FROM (SELECT * FROM have EXCEPT SELECT * FROM want) a UNION ALL SELECT 'add', src, dst FROM (SELECT *
  FROM want EXCEPT SELECT * FROM have) b"""),
    "distinct_scopes": Plan("A3", "SELECT source AS scope FROM documents GROUP BY source UNION SELECT 'general'"),
    # aggregates
    "row_counts": Plan("A1", "SELECT count(*) AS n, count(DISTINCT source) AS scopes FROM documents"),
    "metrics_rollup": Plan("A8 A10", """SELECT coalesce(source, 'all') AS type, count(*) AS n, round(avg(n_chars), 4) AS mean, round(100.0 * sum(CASE WHEN n_chars > 1000 THEN 1
  ELSE 0 END) / count(*), 4) AS percent FROM documents GROUP BY ROLLUP (source)"""),
    "p95_nearest_rank": Plan("A9", """SELECT event_type, value AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS k,
  count(*) OVER (PARTITION BY event_type) AS n FROM events) t WHERE k = CAST(ceil(0.95 * n) AS BIGINT)"""),
    "event_ngrams": Plan("A11 H10", """WITH s AS (SELECT event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c, lead(event_type, 3) OVER w AS d
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT concat(a, '>', b) AS gram FROM s WHERE b IS NOT NULL UNION ALL
  SELECT concat(a, '>', b, '>', c) FROM s WHERE c IS NOT NULL UNION ALL SELECT concat(a, '>', b, '>', c, '>', d) FROM s WHERE d IS NOT NULL)
  SELECT gram, count(*) AS n FROM g GROUP BY gram HAVING count(*) >= 2"""),
    "human_messages": Plan("A14", "SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' AND NOT contains(text, '<command-message>') GROUP BY conv_id"),
    "status_rates": Plan("A15", """WITH a AS (SELECT n.n_name, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS rate FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation n ON c_nationkey = n_nationkey WHERE o_orderdate < TIMESTAMP '1995-06-17 00:00:00' GROUP BY n.n_name), b AS (SELECT n.n_name, avg(CASE
  WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS rate FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation n ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1995-06-17 00:00:00' GROUP BY n.n_name)
  SELECT coalesce(a.n_name, b.n_name) AS name, round(coalesce(b.rate, 0) - coalesce(a.rate, 0), 6) AS delta FROM a FULL OUTER
  JOIN b ON a.n_name = b.n_name"""),
    "last_activity": Plan("A16", f"""SELECT user_id, @EPOCH(max(ts)) AS last_seen, @EPOCH({ANCHOR}) - @EPOCH(max(ts)) > 3 * 86400 AS stale FROM events GROUP BY user_id"""),
    # windows
    "rank_ladder": Plan("W1 W2", f"""WITH {VECTOR}, r AS (SELECT vec_id, sim, row_number() OVER (ORDER BY round(sim, 9) DESC, vec_id) AS k FROM near) SELECT vec_id, round(sim + 0.15 *
  CASE k WHEN 1 THEN 0.15 WHEN 2 THEN 0.10 WHEN 3 THEN 0.06 WHEN 4 THEN 0.03 WHEN 5 THEN 0.01 ELSE 0.0 END, 6) AS score FROM r"""),
    "last_n_per_session": Plan("W4", """SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) t WHERE k <= 3"""),
    "budgeted_suffix": Plan("W5", """SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text) + 1) OVER (PARTITION BY conv_id
  ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM conversations) t WHERE used - 1 <= 1000"""),
    "sequence_edges": Plan("W9 D3 J15 J3", f"WITH {FOLLOWS} SELECT src, dst FROM followed WHERE dst IS NOT NULL"),
    "window_slope": Plan("W10", """WITH s AS (SELECT user_id, event_id, value AS last_v, first_value(value) OVER w AS first_v, count(*) OVER w AS n
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT event_id,
  round((last_v - first_v) / 4.0, 6) AS slope, CASE WHEN (last_v - first_v) / 4.0 < 0.01 AND last_v < 70 THEN 'shift'
  WHEN (last_v - first_v) / 4.0 < 0.05 THEN 'stagnant' ELSE 'converging' END AS state FROM s WHERE n = 5"""),
    "stratified_first_n": Plan("W12", """SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) t WHERE k <= CASE lang
  WHEN 'en' THEN 13 WHEN 'de' THEN 8 WHEN 'fr' THEN 6 ELSE 3 END"""),
    "every_tenth": Plan("W13", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k FROM events) t WHERE (k - 1) % 10 = 0"),
    "save_points": Plan("W16", """WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT user_id, event_id FROM n
  WHERE n % 15 = 0"""),
    "timeline_neighbours": Plan("J14", """WITH a AS (SELECT ts AS t, event_id AS e FROM events WHERE event_id = 50), n AS (SELECT event_id, CASE
  WHEN ts > t OR ts = t AND event_id > e THEN 'after' ELSE 'before' END AS side, abs(@EPOCH(ts) - @EPOCH(t)) AS gap FROM events CROSS JOIN a
  WHERE event_id <> e) SELECT event_id, side FROM (SELECT event_id, side, row_number() OVER (PARTITION BY side ORDER BY gap, event_id) AS k FROM n) x
  WHERE k <= 5"""),
    # vectors
    "knn_cosine": Plan("K2 S4 S5", f"WITH {VECTOR} SELECT vec_id, round(sim, 5) AS sim FROM near ORDER BY round(sim, 9) DESC, vec_id LIMIT 50"),
    "knn_by_label": Plan("K2", f"""WITH {VECTOR} SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(sim, 9) DESC, vec_id) AS k
  FROM near) t WHERE k <= 3"""),
    "vector_norms": Plan("S6", """SELECT vec_id, round(sqrt(@DOT(embedding, embedding)), 4) AS norm, abs(sqrt(@DOT(embedding, embedding)) - 1) < 0.01 AS unit FROM embeddings"""),
    "scope_graduation": Plan("J8", """WITH n AS (SELECT vec_id, label, embedding, sqrt(@DOT(embedding, embedding)) AS norm FROM embeddings),
  m AS (SELECT a.vec_id AS query_id, a.label AS scope, b.vec_id AS other_id, b.label AS other_scope,
  round(@DOT(a.embedding, b.embedding) / nullif(a.norm * b.norm, 0), 9) AS sim FROM n a JOIN n b ON a.label <> b.label),
  f AS (SELECT query_id, scope, other_id, other_scope, sim, row_number() OVER (PARTITION BY query_id ORDER BY other_id) AS k FROM m
  WHERE sim >= 0.85) SELECT query_id, scope, other_id, other_scope, round(sim, 6) AS sim FROM f WHERE k = 1"""),
    # ranking
    "gaussian_decay": Plan("S7", f"WITH {ACCESS} SELECT user_id, round(greatest(exp(-0.5 * (hours / 375.0) * (hours / 375.0)), 0.1), 6) AS decay FROM aged"),
    "exponential_decay": Plan("S8", f"WITH {ACCESS} SELECT user_id, round(greatest(exp(-0.05 * days), 0.1), 6) AS decay FROM aged"),
    "access_reinforcement": Plan("S18", f"WITH {ACCESS} SELECT user_id, round(50 + log2(n + 1) * exp(-0.05 * days), 6) AS utility FROM aged"),
    "sigmoid_gate": Plan("S10", f"WITH {VECTOR} SELECT vec_id, round(1 / (1 + exp(-20 * (sim - 0.6))), 6) AS gate FROM near"),
    "distance_boosts": Plan("S15", f"""WITH {VECTOR}, d AS (SELECT vec_id, 1 - sim AS base, label FROM near) SELECT vec_id, round(least(2.0, greatest(-2.0, base - CASE
  WHEN label = 0 THEN 0.4 * base ELSE 0 END - CASE WHEN label = 1 THEN 0.6 * base ELSE 0 END - 0.2 * CASE WHEN label = 2 THEN 1 ELSE 0 END - 0.3 *
  CASE WHEN label = 3 THEN 1 ELSE 0 END - CASE WHEN label = 4 THEN 0.5 * base ELSE 0 END)), 6) AS distance FROM d"""),
    "archived_demotion": Plan("S22", f"""WITH {VECTOR} SELECT vec_id, CASE WHEN label % 2 = 0 THEN 1.0 WHEN label = 1 AND round(sim, 9) >= 0.8 THEN 1.0 ELSE 0.4 END AS factor FROM near"""),
    "adaptive_fusion": Plan(
        "J1 S10 S13",
        f"""WITH {BM25}, {VECTOR}, b AS (SELECT greatest(0.2, least(0.8, 0.2 + 0.15 * greatest(0.0, avg(ln((c.n_docs - d.df + 0.5) / (d.df + 0.5) + 1)) - 2.5))) AS beta FROM df d CROSS JOIN corpus c),
e AS (SELECT min(bm25) AS lo, max(bm25) AS hi FROM scored), n AS (SELECT doc_id AS id, CASE WHEN hi - lo > 1e-6 THEN (bm25 - lo) / (hi - lo)
  ELSE 1.0 END AS kw FROM scored CROSS JOIN e),
f AS (SELECT coalesce(v.vec_id, n.id) AS id, (1 - beta) * coalesce(v.sim, 0.0) + beta * coalesce(n.kw, 0.0) AS fused FROM near v FULL OUTER
  JOIN n ON v.vec_id = n.id CROSS JOIN b)
SELECT id, round(fused / (1 + exp(-20 * (fused - 0.6))), 6) AS score FROM f""",
    ),
    # graph
    "one_hop": Plan("R5", f"""WITH {FOLLOWS}, e AS (SELECT src AS node, dst AS other, 0 AS dir FROM followed WHERE dst IS NOT NULL UNION ALL SELECT dst, src, 1 FROM followed
  WHERE dst IS NOT NULL) SELECT node, other FROM (SELECT node, other, row_number() OVER (PARTITION BY node ORDER BY dir, other) AS k FROM e) t
  WHERE k <= 50"""),
    "asof_edges": Plan("P12 R6 J13", f"""WITH {EDGES} SELECT src, dst FROM edges WHERE valid_from <= DATE '1995-06-17' AND (valid_to IS NULL OR valid_to >= DATE '1995-06-17')"""),
    "edge_validation": Plan("", f"WITH {EDGES} SELECT count(*) AS n, CAST(sum(CASE WHEN valid_to < valid_from THEN 1 ELSE 0 END) AS BIGINT) AS inverted FROM edges"),
    "tree_ancestors": Plan("", """WITH RECURSIVE up(node, parent, depth) AS (SELECT doc_id, CAST(floor(doc_id / 10) AS BIGINT), 1 FROM documents WHERE doc_id > 0 UNION ALL
  SELECT node, CAST(floor(parent / 10) AS BIGINT), depth + 1 FROM up WHERE parent > 0) SELECT node, max(depth) AS depth FROM up GROUP BY node"""),
    "uct_select": Plan("R10 K8", """WITH n AS (SELECT o_custkey AS parent, o_orderkey AS child, o_totalprice % 100 AS score, CAST(o_orderkey % 5 AS BIGINT) AS visits FROM orders),
  p AS (SELECT parent, sum(visits) + 1 AS total FROM n GROUP BY parent), u AS (SELECT n.parent, n.child, CASE WHEN visits = 0 THEN 1e9
  ELSE score / 100 + 1.414 * sqrt(ln(total) / visits) END AS uct FROM n JOIN p ON n.parent = p.parent) SELECT parent, child
  FROM (SELECT parent, child, row_number() OVER (PARTITION BY parent ORDER BY round(uct, 9) DESC, child) AS k FROM u) t WHERE k = 1"""),
    "entity_cooccurrence": Plan("J9", """WITH m AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem) SELECT a.s AS left_id, b.s AS right_id, count(*) AS n FROM m a
  JOIN m b ON a.o = b.o AND a.s < b.s GROUP BY a.s, b.s HAVING count(*) >= 2"""),
    # lifecycle
    "history_rows": Plan("D18", """SELECT user_id, event_type AS key, event_id AS version, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS replaced_by
  FROM events"""),
    "cascade_delete": Plan("D8", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')"""),
    # evaluation
    "recall_at_5": Plan("V1", f"""WITH {RANKED}, g AS (SELECT label, count(*) - 1 AS n FROM embeddings GROUP BY label) SELECT query_id, max(CASE
  WHEN top.label = gold AND rank <= 5 THEN 1 ELSE 0 END) AS recall_any, round(sum(CASE WHEN top.label = gold AND rank <= 5 THEN 1.0
  ELSE 0.0 END) / least(5, max(g.n)), 6) AS recall FROM top JOIN g ON g.label = gold GROUP BY query_id"""),
    "ndcg_binary": Plan("V3", f"""WITH {RANKED}, g AS (SELECT label, count(*) - 1 AS n FROM embeddings GROUP BY label), i AS (SELECT k, sum(1 / log2(k2 + 1)) AS ideal
  FROM (SELECT a.rank AS k, b.rank AS k2 FROM (SELECT DISTINCT rank FROM top) a JOIN (SELECT DISTINCT rank FROM top) b ON b.rank <= a.rank) t
  GROUP BY k) SELECT query_id, round(sum(CASE WHEN top.label = gold THEN 1 / log2(rank + 1) ELSE 0.0 END) / max(ideal), 6) AS ndcg FROM top
  JOIN g ON g.label = gold JOIN i ON i.k = least(10, g.n) GROUP BY query_id"""),
    "ndcg_graded": Plan("V2", f"""WITH {RANKED}, r AS (SELECT query_id, rank, CASE WHEN label = gold THEN 3 WHEN label % 2 = gold % 2 THEN 2 ELSE 0 END AS rel FROM top),
  s AS (SELECT query_id, rel, rank, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS best FROM r) SELECT query_id, round(CASE
  WHEN sum(rel) = 0 THEN 0.0 ELSE sum(rel / log2(rank + 1)) / sum(rel / log2(best + 1)) END, 6) AS ndcg FROM s GROUP BY query_id"""),
    "mrr_penalty": Plan("V4", f"""WITH {RANKED}, f AS (SELECT query_id, min(CASE WHEN label = gold THEN rank END) AS hit FROM top GROUP BY query_id) SELECT query_id,
  round(coalesce(1.0 / hit, 0.0), 6) AS reciprocal, CASE WHEN hit <= 3 THEN 1 ELSE 0 END AS recall_3, CASE WHEN hit IS NULL OR hit >= 5 THEN 1
  ELSE 0 END AS penalty FROM f"""),
    "parameter_sweep": Plan("V8", f"""WITH {RANKED}, p AS (SELECT * FROM (VALUES (1), (3), (5), (10)) AS v(k)) SELECT k, round(avg(hit), 6) AS recall_any FROM (SELECT p.k, query_id,
  max(CASE WHEN label = gold AND rank <= p.k THEN 1.0 ELSE 0.0 END) AS hit FROM top CROSS JOIN p GROUP BY p.k, query_id) t GROUP BY k"""),
    # chunks
    "fixed_chunks": Plan("H1", """WITH w AS (SELECT doc_id, @KEEP(@SPLIT(text, @R'\\s+'), x => x <> '') AS w FROM documents), s AS (SELECT doc_id, @EXPLODE(@RANGE(0, CAST(CASE
  WHEN @LEN(w) <= 200 THEN 0 ELSE ceil((@LEN(w) - 200) / 180.0) END AS BIGINT))) AS i FROM w WHERE @LEN(w) > 0)
  SELECT s.doc_id, s.i AS part, @JOINED(@SLICE(w.w; CAST(s.i * 180 + 1 AS INT); 200), ' ') AS chunk FROM s JOIN w ON s.doc_id = w.doc_id"""),
    "headings": Plan(
        "H3",
        """WITH d AS (SELECT doc_id, CAST(@BYTES(text) AS BIGINT) AS total, @SPLIT(text, @R'\\n') AS parts FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, total, parts, @EXPLODE(@RANGE(1, @LEN(parts))) AS i FROM d), l AS (SELECT doc_id, total, i, @GET(parts, i) AS line FROM n),
o AS (SELECT doc_id, total, line, CAST(coalesce(sum(@BYTES(line) + 1) OVER (PARTITION BY doc_id
  ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte FROM l),
h AS (SELECT doc_id, @SUB(@SUB(line, @R'^\\s*#+', ''), @R'^\\s+|\\s+$', '') AS title, start_byte, coalesce(lead(start_byte) OVER (PARTITION BY doc_id
  ORDER BY start_byte), total) AS end_byte FROM o WHERE @HAS(line, @R'^\\s*#+ \\s*\\S'))
SELECT doc_id, title, start_byte, end_byte FROM h UNION ALL SELECT doc_id, 'Document Root', 0, total FROM d WHERE NOT EXISTS (SELECT 1 FROM h
  WHERE h.doc_id = d.doc_id)""",
    ),
}
