"""Sources, sinks and streams as queries: the tables are written in the form that an operator reads, and read back through it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.plans.catalog import redacted_sql
from recollect.plans.registry import Tables, query
from recollect.sources import sinks, staging, tails, transcripts
from recollect.streaming import events, stateful


def written(df: DataFrame, label: str, **options) -> str:
    """One column of lines as a text folder."""
    path = staging.new_path(df.sparkSession, label)
    df.write.options(**options).text(path)
    return path


def named(key: str) -> Column:
    """The path of a key's own file."""
    return sinks.dealt(F.col(key), F.concat(F.lit(f"{key}="), key, F.lit(".txt")))


def turns(t: Tables) -> DataFrame:
    return t("conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


MESSAGES = "SELECT role, sha256(coalesce(text, '')) AS text_sha256 FROM conversations"


@query("C5", "SELECT CASE WHEN turn % 4 = 3 THEN 'unknown' ELSE role END AS role, sha256(coalesce(text, '')) AS text_sha256 FROM conversations")
def jsonl_messages(t: Tables):
    """JSON lines in which role and text have several names."""
    k = F.col("turn") % 4
    forms = [F.to_json(F.struct("role", F.col("text").alias("content"))), F.to_json(F.struct(F.col("role").alias("speaker"), "text")), F.to_json(F.struct("role", F.col("text").alias("message"))), F.to_json(F.struct(F.col("text").alias("message")))]
    value = F.when(k == 0, forms[0]).when(k == 1, forms[1]).when(k == 2, forms[2]).otherwise(forms[3])
    good, _ = transcripts.jsonl(t.spark, written(turns(t).select(value.alias("value")), "jsonl"))
    return good.select("role", F.sha2("text", 256).alias("text_sha256"))


@query("C17", "SELECT 'broken ' || conv_id || ' {' AS line, 'not a JSON object' AS error FROM conversations WHERE turn = 0")
def quarantined_lines(t: Tables):
    """Lines that are no JSON are moved aside with what was wrong; the others are read."""
    good = turns(t).select(F.to_json(F.struct("role", F.col("text").alias("content"))).alias("value"))
    broken = t("conversations").where("turn = 0").select(F.concat(F.lit("broken "), "conv_id", F.lit(" {")).alias("value"))
    _, bad = transcripts.jsonl(t.spark, written(good.unionByName(broken), "mixed"))
    aside = staging.new_path(t.spark, "quarantine")
    transcripts.quarantined(bad, aside)
    return t.spark.read.schema("file string, line string, error string").json(aside).select("line", "error")


@query("C6", MESSAGES)
def message_arrays(t: Tables):
    """Lines of one message, and lines of many."""
    one = turns(t).where("conv_id % 2 = 0").select(F.to_json(F.struct("role", F.col("text").alias("content"))).alias("value"))
    many = turns(t).where("conv_id % 2 = 1").groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(F.struct("role", F.col("text").alias("content"))).alias("messages"))).alias("value")).select("value")
    return transcripts.message_arrays(t.spark, written(one.unionByName(many), "arrays")).select("role", F.sha2("text", 256).alias("text_sha256"))


@query("C7", """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, role, sha256(coalesce(text, '')) AS text_sha256
  FROM conversations""")
def message_documents(t: Tables):
    """Files that hold an array, an object with messages, or lines."""
    message = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    plain = F.transform(message, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    grouped = turns(t).groupBy("conv_id").agg(plain.alias("m"))
    k = F.col("conv_id") % 3
    body = F.when(k == 0, F.to_json("m")).when(k == 1, F.to_json(F.struct(F.col("m").alias("messages")))).otherwise(F.array_join(F.transform("m", lambda m: F.to_json(m)), "\n"))
    path = staging.new_path(t.spark, "documents")
    sinks.write_files(grouped.select(named("conv_id").alias("path"), F.concat(body, F.lit("\n")).alias("value")), path)
    read = transcripts.documents(t.spark, path)
    conv = F.regexp_extract("file", r"conv_id=(-?\d+)", 1).cast("long")
    return read.select(conv.alias("conv_id"), F.col("place").cast("long").alias("place"), "role", F.sha2("text", 256).alias("text_sha256"))


@query("C9", "SELECT role, sha256('say ' || conv_id || ' ' || turn) AS text_sha256 FROM conversations")
def assigned_messages(t: Tables):
    """Lines role = "..." and content = "..."."""
    say = F.concat(F.lit("say "), "conv_id", F.lit(" "), "turn")
    value = F.concat(F.lit('[[messages]]\nrole = "'), "role", F.lit('"\n# note\ncontent="'), say, F.lit('" # x\n'))
    path = written(turns(t).select(value.alias("value")), "assigned")
    return transcripts.assigned(t.spark, path).select("role", F.sha2("text", 256).alias("text_sha256"))


@query("C8", """WITH k AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'USER_INPUT' ELSE 'PLANNER_RESPONSE' END AS type, coalesce(text, '') AS text
  FROM conversations WHERE role <> 'system') SELECT sha256(string_agg('## ' || type || chr(10) || text, chr(10) || chr(10)
  ORDER BY turn)) AS text_sha256, min('2024-01-0' || (turn + 1)) AS created_at FROM k GROUP BY conv_id""")
def step_logs(t: Tables):
    """Inputs and responses of a log as one document, dated by the first of them."""
    kind = F.when(F.col("role") == "user", "USER_INPUT").when(F.col("role") == "assistant", "PLANNER_RESPONSE").otherwise("TOOL")
    line = F.to_json(F.struct(F.col("turn").cast("int").alias("step_index"), kind.alias("type"), F.col("text").alias("content"), F.concat(F.lit("2024-01-0"), F.col("turn") + 1).alias("created_at")))
    path = staging.new_path(t.spark, "logs")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "value"))), lambda x: F.concat(x["value"], F.lit("\n"))), "")
    logs = turns(t).select("conv_id", "turn", line.alias("value")).groupBy("conv_id").agg(body.alias("value"))
    sinks.write_files(logs.select(named("conv_id").alias("path"), "value"), path)
    return transcripts.step_log(t.spark, path).select(F.sha2("text", 256).alias("text_sha256"), "created_at")


@query("C14", "SELECT sha256('# ' || item_id || chr(10) || coalesce(text, '') || chr(10)) AS sha256 FROM benchmark WHERE item_id % 5 > 0")
def workspace_files(t: Tables):
    """Hashes of a folder's files; folders that are ignored aren't walked."""
    rows = t("benchmark").select("item_id", F.when(F.col("item_id") % 5 == 0, "node_modules").otherwise("docs").alias("folder"), F.concat(F.lit("# "), "item_id", F.lit("\n"), F.coalesce("text", F.lit(""))).alias("value"))
    path = staging.new_path(t.spark, "workspace")
    name = F.concat("folder", F.lit("/"), named("item_id"))
    sinks.write_files(rows.select(name.alias("path"), F.concat("value", F.lit("\n")).alias("value")), path)
    return transcripts.files(t.spark, path, "*.txt", depth=10).select("sha256")


@query("C12 T8", """SELECT item_id, CASE WHEN item_id % 3 > 0 THEN 'Item ' || item_id END AS title, CASE WHEN item_id % 3 = 1 THEN 's' || (item_id % 4) END AS scope,
  sha256('Body of ' || coalesce(text, '') || chr(10)) AS body_sha256 FROM benchmark""")
def markdown_files(t: Tables):
    """Markdown files with a head, with a short one, and without; their keys and what stands behind."""
    i, body = F.col("item_id"), F.concat(F.lit("Body of "), F.coalesce("text", F.lit("")))
    long = F.concat(F.lit('---\ntitle: "Item '), i, F.lit("\"\nscope: s"), i % 4, F.lit("\ntags: [a, b]\n---\n\n"), body)
    short = F.concat(F.lit("---\ntitle: Item "), i, F.lit("\n---\n"), body)
    path = staging.new_path(t.spark, "vault")
    text = F.when(i % 3 == 1, long).when(i % 3 == 2, short).otherwise(body)
    sinks.write_files(t("benchmark").select(named("item_id").alias("path"), F.concat(text, F.lit("\n")).alias("value")), path)
    read = transcripts.markdown(t.spark, path, pattern="*.txt")
    ends = F.concat(F.regexp_replace("body", r"\n+\z", ""), F.lit("\n"))  # the writer ends a file by a line break
    return read.select(F.regexp_extract("path", r"item_id=(-?\d+)", 1).cast("long").alias("item_id"), "title", "scope", F.sha2(ends, 256).alias("body_sha256"))


@query("M1", """SELECT conv_id, CAST(CASE conv_id % 3 WHEN 1 THEN 0 ELSE 7 END AS BIGINT) AS start, CASE conv_id % 3 WHEN 0 THEN 'line 2' || chr(10)
  ELSE 'line 1' || chr(10) || 'line 2' || chr(10) END AS text FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 3 < 2)""")
def tailed_files(t: Tables):
    """What files hold behind their stored offset; a file that shrank is read anew."""
    path = staging.new_path(t.spark, "tail")
    ids = t("conversations").where("conv_id % 3 < 2").select("conv_id").distinct()
    sinks.write_files(ids.select(named("conv_id").alias("path"), F.lit("line 1\nline 2\n").alias("value")), path)
    found = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    conv = F.regexp_extract("path", r"conv_id=(-?\d+)", 1).cast("long")
    offsets = found.select("path", F.when(conv % 3 == 0, 7).otherwise(1000).alias("offset"))
    read = transcripts.tail(t.spark, path, offsets)
    return read.select(conv.alias("conv_id"), F.when(conv % 3 == 0, 7).otherwise(0).cast("long").alias("start"), "text")


REDACTED = redacted_sql("""coalesce(text, '') || ' password = "hunter2"'""")


@query("D15", f"SELECT doc_id, sha256({REDACTED}) AS text_sha256 FROM documents")
def redacted_files(t: Tables):
    """Texts are redacted before they are stored; a committed write stands in for a temporary file."""
    path = staging.new_path(t.spark, "texts")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(' password = "hunter2"'))
    sinks.write_texts(t("documents").select("doc_id", text.alias("text")), path)
    return t.spark.read.parquet(path).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query("D19", """SELECT 'result' AS part, 'document ' || doc_id AS name, length(text) AS n FROM documents UNION ALL SELECT 'manifest', 'documents', count(*) FROM documents UNION ALL SELECT 'report', 'lines', 3""")
def written_results(t: Tables):
    """Result lines, a manifest and a report, read back."""
    path = staging.new_path(t.spark, "results")
    rows = t("documents").select("doc_id", F.length("text").alias("n"))
    sinks.write_run(rows, rows.agg(F.count("*").alias("n")), {"dataset": "documents"}, path)
    results = t.spark.read.schema("doc_id long, n long").json(f"{path}/results").select(F.lit("result").alias("part"), F.concat(F.lit("document "), "doc_id").alias("name"), "n")
    manifest = t.spark.read.schema("dataset string, results long").json(f"{path}/manifest").select(F.lit("manifest").alias("part"), F.col("dataset").alias("name"), F.col("results").alias("n"))
    report = t.spark.read.text(f"{path}/report").agg(F.count("*").alias("n")).select(F.lit("report").alias("part"), F.lit("lines").alias("name"), "n")
    return results.unionByName(manifest).unionByName(report)


# Streams: the table's rows arrive as files.


# Fixed value: rows of an arriving file, and of a task that keeps state.
ROWS_A_TASK = 250_000


def arriving(t: Tables, label: str, files: int = 1, by: str = "user_id") -> DataFrame:
    """At least so many files, and more of a larger table, so that it isn't written by one task."""
    path = staging.new_path(t.spark, label)
    t("events").repartition(max(files, -(-t("events").count() // ROWS_A_TASK)), by).write.parquet(path)
    return events.stream(t.spark, path)


def drained(t: Tables, df: DataFrame, label: str) -> DataFrame:
    out = staging.new_path(t.spark, label)
    events.run(df, out, staging.new_path(t.spark, f"{label}-state"))
    return t.spark.read.schema(df.schema).parquet(out)


@query("M10", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(t: Tables):
    """Counts of each hour, kept up to date batch by batch."""
    out = staging.new_path(t.spark, "hours")

    def write(batch: DataFrame, number: int) -> None:
        batch.select(F.col("window.start").alias("start"), "event_type", "n").write.mode("overwrite").parquet(out)

    events.run_batches(events.windowed(arriving(t, "ticks", 3)), write, staging.new_path(t.spark, "hours-state"), "complete")
    return t.spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("M2", """WITH s AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id
  ORDER BY ts, event_id)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM s)
  SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM g GROUP BY user_id, g""")
def stream_bursts(t: Tables):
    """The last event of each burst of a user."""
    out = staging.new_path(t.spark, "bursts")

    def write(batch: DataFrame, number: int) -> None:
        batch.select("user_id", "event_id", "n").write.mode("overwrite").parquet(out)

    tasks = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), -(-t("events").count() // ROWS_A_TASK))
    events.run_batches(events.debounced(arriving(t, "bursting"), tasks=tasks), write, staging.new_path(t.spark, "bursts-state"), "complete", tasks)
    return t.spark.read.parquet(out)


@query("M7", """SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was
  FROM events) x WHERE was IS DISTINCT FROM event_type""")
def stream_changes(t: Tables):
    """Events that repeat the content before them are suppressed."""
    return drained(t, events.changes(arriving(t, "saves")), "changes")


@query("M7", "SELECT event_id FROM events")
def stream_once(t: Tables):
    """Events that arrive twice count once."""
    path = staging.new_path(t.spark, "twice")
    t("events").unionByName(t("events").where("event_id % 3 = 0")).repartition(4).write.parquet(path)
    return drained(t, events.once(events.stream(t.spark, path)), "once").select("event_id")


@query("M8", """SELECT user_id, CAST(least(20, count(*)) AS INT) AS n, (list(event_type ORDER BY ts, event_id))[greatest(1, count(*) - 19)] AS oldest FROM events
  GROUP BY user_id""")
def stream_recent(t: Tables):
    """The last names of each user, up to a cap (twenty here)."""
    rows = drained(t, events.recent_names(arriving(t, "names"), 20), "recent")
    return rows.groupBy("user_id").agg(F.max_by(F.struct("n", "oldest"), "at").alias("r")).select("user_id", "r.*")


@query(
    "M4",
    """WITH s AS (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER w <= 3600 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id
  ORDER BY ts, event_id)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM s),
  r AS (SELECT *, (row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) - 1) // 3 AS c FROM g),
b AS (SELECT user_id, g, c, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last, max(g) OVER (PARTITION BY user_id) AS end_g FROM r
  GROUP BY user_id, g, c) SELECT user_id, n, last FROM b WHERE n = 3 OR g < end_g""",
)
def stream_triggers(t: Tables):
    """Work starts after so many waiting events (three here) or a pause (an hour); what waits at the end is still waiting."""
    return drained(t, events.batches(arriving(t, "waiting"), 3, "3600 seconds"), "triggers").select("user_id", F.col("n").cast("long").alias("n"), "last")


@query("M3 M6", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def stream_values(t: Tables):
    """A keyed table that one writer keeps, batch after batch: a batch's newest values replace the older ones by time."""
    state = {"path": ""}

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("v"))
        both = new if not state["path"] else new.unionByName(spark.read.parquet(state["path"]))
        path = staging.new_path(spark, "values")
        both.groupBy("user_id", "event_type").agg(F.max("v").alias("v")).write.parquet(path)
        state["path"] = path

    events.run_batches(arriving(t, "writes", 2, "event_type"), write, staging.new_path(t.spark, "values-state"))
    return t.spark.read.parquet(state["path"]).select("user_id", "event_type", "v.value")


@query("M5", """WITH a AS (SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id) SELECT user_id,
  round(n * exp(-(epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(last))) / 86400e0 * ln(2) / 365), 6) AS utility FROM a WHERE n >= 40""")
def periodic_decay(t: Tables):
    """A job that runs over what has arrived, decays utilities and prunes the rest, and stops: to be started each day."""
    out = staging.new_path(t.spark, "decayed")

    def write(batch: DataFrame, number: int) -> None:
        days = (F.unix_timestamp(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_timestamp("last")) / 86400
        batch.where("n >= 40").select("user_id", F.round(F.col("n") * F.exp(-days * F.log(F.lit(2.0)) / 365), 6).alias("utility")).write.mode("overwrite").parquet(out)

    counts = arriving(t, "accesses").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    events.run_batches(counts, write, staging.new_path(t.spark, "decay-state"), "complete")
    return t.spark.read.parquet(out)


@query("M9", """SELECT event_id FROM events WHERE event_id % 4 > 0 AND floor(epoch(ts)) + (event_id % 4) * 86400 < epoch(TIMESTAMP '2024-01-20 00:00:00')""")
def expired_tasks(t: Tables):
    """Injected tasks whose time to live is over at the sweep."""
    now = F.unix_timestamp(F.lit("2024-01-20 00:00:00").cast("timestamp"))
    ttl = F.col("event_id") % 4 * 86400
    return t("events").where((F.col("event_id") % 4 > 0) & (F.unix_timestamp("ts") + ttl < now)).select("event_id")


# By the clock: nothing further has to arrive.


@query("M4", """WITH r AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 3 AS c FROM events)
  SELECT user_id, CASE WHEN count(*) = 3 THEN 'threshold' ELSE 'idle' END AS reason, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last FROM r GROUP BY user_id, c""")
def stream_due(t: Tables):
    """Work is due after so many waiting events (three here) or a second without one on the clock; in the end nothing waits."""
    n, out = t("events").count(), staging.new_path(t.spark, "due")
    due = stateful.triggers(arriving(t, "due-in"), 3, 1.0)
    stateful.run_until(due, out, staging.new_path(t.spark, "due-state"), lambda d: (d.agg(F.sum("n").alias("n")).first()["n"] or 0) == n, most_seconds=900)
    return t.spark.read.schema(due.schema).parquet(out).select("user_id", "reason", F.col("n").cast("long").alias("n"), "last")


@query("M2", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM events GROUP BY user_id")
def stream_settled(t: Tables):
    """The latest event of each user once no other has come for a second; its state goes with it."""
    n, out = t("events").select("user_id").distinct().count(), staging.new_path(t.spark, "settled")
    rows = stateful.settled(arriving(t, "settling"), 1.0)
    stateful.run_until(rows, out, staging.new_path(t.spark, "settled-state"), lambda d: d.count() == n, most_seconds=900)
    return t.spark.read.schema(rows.schema).parquet(out).select("user_id", "event_id", F.col("n").cast("long").alias("n"))


def in_two(t: Tables, run) -> None:
    """Runs a stream over a first file, and again once a second one with every tenth event has come."""
    path = staging.new_path(t.spark, "late-in")
    for later in ("event_id % 10 > 0", "event_id % 10 = 0"):
        t("events").where(later).coalesce(1).write.mode("append").parquet(path)
        run(events.stream(t.spark, path))


CLOCKS = """WITH c AS (SELECT max(ts) FILTER (event_id % 10 > 0) AS first, max(ts) AS last FROM events)"""


@query("M10", CLOCKS + """ SELECT event_id FROM events, c WHERE event_id % 10 = 0 AND ts < first - INTERVAL 1 HOUR""")
def stream_late(t: Tables):
    """Rows that come over an hour late are put aside, each once."""
    aside, clock, state, good = (staging.new_path(t.spark, x) for x in ("late", "clock", "late-state", "on-time"))
    in_two(t, lambda df: stateful.run_with_late_aside(df, lambda b, n: b.write.mode("overwrite").parquet(f"{good}/batch={n}"), aside, clock, state, 3600))
    return stateful.late_rows(t.spark, aside, events.EVENTS).select("event_id")


@query("M10", CLOCKS + """, k AS (SELECT date_trunc('hour', ts) AS start, event_type FROM events, c WHERE event_id % 10 > 0 OR date_trunc('hour', ts) + INTERVAL 1 HOUR > first - INTERVAL 10 MINUTE)
  SELECT start, event_type, count(*) AS n FROM k, c WHERE start + INTERVAL 1 HOUR <= last - INTERVAL 10 MINUTE GROUP BY start, event_type""")
def stream_closed(t: Tables):
    """Counts of hours that the watermark has closed; what comes for a closed hour is dropped."""
    out, state = staging.new_path(t.spark, "closed"), staging.new_path(t.spark, "closed-state")
    rows = []
    in_two(t, lambda df: rows.append(events.windowed(df)) or events.run(rows[-1], out, state))
    return t.spark.read.schema(rows[-1].schema).parquet(out).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("M1 C5", "SELECT conv_id, turn, sha256('turn ' || conv_id || ' ' || turn || ' ' || role) AS line_sha256 FROM conversations")
def stream_tailed(t: Tables):
    """Lines of growing folders of text files, each once, over two runs."""
    t.spark.dataSource.register(tails.Tail)
    path, out, state = staging.new_path(t.spark, "logs"), staging.new_path(t.spark, "lines"), staging.new_path(t.spark, "lines-state")
    line = F.concat(F.lit("turn "), "conv_id", F.lit(" "), "turn", F.lit(" "), "role")
    total = 0
    for part in ("turn % 2 = 0", "turn % 2 = 1"):
        rows = t("conversations").where(part)
        rows.select(line.alias("value")).write.mode("append").text(path)
        total += rows.count()
        df = t.spark.readStream.format("tail").option("folder", path).load()
        stateful.run_until(df, out, state, lambda d, n=total: d.count() >= n, most_seconds=300)
    found = t.spark.read.schema(tails.SCHEMA).parquet(out)
    said = F.split("line", " ")
    return found.select(said[1].cast("long").alias("conv_id"), said[2].cast("long").alias("turn"), F.sha2("line", 256).alias("line_sha256"))
