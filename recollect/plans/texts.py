"""Text, date and scalar rows. Where the tables hold no such text, a query writes one around their values, and its SQL says what has
to come out by construction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import columns as c
from recollect.functions import stem, texts, words
from recollect.operators import lines, walks
from recollect.plans.catalog import redacted_sql, spelled
from recollect.plans.registry import Tables, query


def listed(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def said(*parts):
    """A text of literals and columns, null as empty."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


# Markdown


@query(
    "T13",
    r"""WITH d AS (SELECT doc_id, source, doc_id % 50 AS n FROM documents)
SELECT doc_id, 0 AS place, source AS target FROM d UNION ALL SELECT doc_id, 1, 'doc-' || n FROM d UNION ALL SELECT doc_id, 2, 'a|b' FROM d UNION ALL
  SELECT doc_id, 3, 'x [[in' FROM d UNION ALL SELECT doc_id, 4, 'in' FROM d""",
)
def wikilinks(t: Tables):
    """Links of a text, with a label, an escaped bar, a repeat, an empty one and one inside another."""
    text = said("See [[", F.col("source"), "|Label ", F.col("lang"), "]] and [[doc-", F.col("doc_id") % 50, "]], [[ a\\|b ]], [[", F.col("source"), "]], [[]], [[x [[in]] and [[open")
    return t("documents").select("doc_id", F.posexplode(c.wikilinks(text)).alias("place", "target"))


@query(
    "J12",
    """WITH nodes AS (SELECT doc_id, 'doc-' || doc_id AS id, source || '/' || (doc_id % 7) AS name, 'wiki/' || lang || '-' || doc_id || '.md' AS path
  FROM documents),
links AS (SELECT doc_id, unnest(['doc-' || (doc_id + 1), source || '/' || (doc_id % 7), 'wiki/' || lang || '-' || doc_id, 'wiki/' || lang || '-' || doc_id || '.md', 'missing']) AS target FROM documents),
met AS (SELECT l.doc_id, l.target, CASE WHEN n.id = l.target THEN 1 WHEN n.name = l.target THEN 2 WHEN n.path = l.target || '.md' THEN 3
  ELSE 4 END AS how, n.doc_id AS node
  FROM links l JOIN nodes n ON n.id = l.target OR n.name = l.target OR n.path = l.target || '.md' OR n.path = l.target)
SELECT doc_id, target, how, node FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, target ORDER BY how, node) AS k FROM met) x WHERE k = 1""",
)
def link_resolution(t: Tables):
    """A link's target is looked up as id, name, path without its ending, path; the first that is there counts."""
    d = t("documents")
    path = F.concat(F.lit("wiki/"), "lang", F.lit("-"), "doc_id")
    name = F.concat("source", F.lit("/"), F.col("doc_id") % 7)
    keys = [(F.concat(F.lit("doc-"), "doc_id"), 1), (name, 2), (path, 3), (F.concat(path, F.lit(".md")), 4)]
    known = d.select(F.explode(F.array(*(F.struct(k.alias("target"), F.lit(i).alias("how")) for k, i in keys))).alias("k"), F.col("doc_id").alias("node")).select("k.*", "node")
    known = known.groupBy("target").agg(F.min(F.struct("how", "node")).alias("best"))  # one node a key
    targets = F.array(F.concat(F.lit("doc-"), F.col("doc_id") + 1), name, path, F.concat(path, F.lit(".md")), F.lit("missing"))
    links = d.select("doc_id", F.explode(targets).alias("target")).distinct()
    return links.join(known, "target").select("doc_id", "target", "best.how", "best.node")


@query("T10", """SELECT doc_id, 'Title ' || doc_id || ' Some bold and it with snake_case and code ' || lang || ' end. A link ' || source || ' and pic item one item two quote raw block ' || doc_id || ' last' AS plain FROM documents""")
def plain_texts(t: Tables):
    """Markdown to one line of text and code."""
    text = said("# Title ", F.col("doc_id"), "\n\nSome **bold** and _it_ with snake_case and\n`code ", F.col("lang"), "` end. A [link ", F.col("source"), "](http://x/y_z_) and ![pic](a.png)\n\n- item one\n* item two\n\n> quote <b>raw</b>\n\n---\n\n```py\nblock ", F.col("doc_id"), "\n```\n\n__last__\n")
    return t("documents").select("doc_id", c.plain_text(text).alias("plain"))


@query("T9", """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '' ELSE 'Body of ' || doc_id || chr(10) || chr(10) || source END AS body FROM documents""")
def titles_removed(t: Tables):
    """Leading lines that only say the title go, whole or its last part, once or again and again."""
    title = said("Notes/", F.col("source"), " Plan")
    head = said("\n## Notes/", F.col("source"), " Plan\n\n", F.upper("source"), " plan\n", F.col("source"), " Plan ", F.col("source"), " PLAN\n")
    text = F.when(F.col("doc_id") % 4 == 3, head).when(F.col("doc_id") % 4 == 0, said("Body of ", F.col("doc_id"), "\n\n", F.col("source"))).otherwise(F.concat(head, said("Body of ", F.col("doc_id"), "\n\n", F.col("source"))))
    return t("documents").select("doc_id", c.without_title(text, title).alias("body"))


@query("T8 C12", """SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'Doc ' || doc_id END AS title, CASE WHEN doc_id % 3 > 0 THEN lang END AS scope, sha256(CASE
  WHEN doc_id % 3 = 0 THEN coalesce(text, '') ELSE 'Body ' || coalesce(source, '') END) AS body_sha256 FROM documents""")
def front_matters(t: Tables):
    """Keys of the head and the body behind it."""
    head = said(F.when(F.col("doc_id") % 3 == 1, "\n ").otherwise(""), "---\ntitle: \"Doc ", F.col("doc_id"), "\"\n  scope : '", F.col("lang"), "'\ntags: a\n---\n\nBody ", F.col("source"))
    text = F.when(F.col("doc_id") % 3 == 0, F.coalesce("text", F.lit(""))).otherwise(head)
    plain = ~text.rlike(r"(?s)\A\s*---.*?---")
    return t("documents").select("doc_id", c.front_matter(text, "title").alias("title"), c.front_matter(text, "scope").alias("scope"), F.sha2(F.when(plain, text).otherwise(c.body_of(text)), 256).alias("body_sha256"))


@query("T15", """SELECT doc_id, 'a ' || doc_id || chr(10) || '[Diff Truncated]' || chr(10) || 'b' || chr(10) || '```py' || chr(10) || '--- kept ' || source || chr(10) || '```' || chr(10) || '--+ also kept' AS cleaned FROM documents""")
def diffs_stripped(t: Tables):
    """Fenced diffs become a mark, bare lines of a diff go, other fences stay as they are."""
    text = said("a ", F.col("doc_id"), "\n  ```diff\n+x ", F.col("lang"), "\n@@ y\n```\nb\ndiff --git a b\n--- a\n+++ b\n @@ 1\n```py\n--- kept ", F.col("source"), "\n```\n--+ also kept")
    return lines.without_diffs(t("documents").select("doc_id", text.alias("text")), "doc_id", "text").select("doc_id", F.col("text").alias("cleaned"))


@query(
    "T16",
    """WITH n AS (SELECT doc_id, text, i FROM documents, range(1, 501) r(i) WHERE i <= length(text)), h AS (SELECT doc_id, substr(any_value(text), 1,
  CAST(max(i) AS INT)) AS head FROM n WHERE strlen(substr(text, 1, CAST(i AS INT))) <= 500 GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS summary, CASE
  WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS subtitle,
  CAST(length(substr(text, 1, 10000)) AS BIGINT) AS hydrated,
  CASE WHEN strlen(text) <= 500 THEN text
  WHEN contains(head, chr(10) || chr(10)) THEN regexp_extract(head, '(?s)^(.*)\\n\\n', 1) || '... [truncated]'
  WHEN contains(head, '. ') THEN regexp_extract(head, '(?s)^(.*[.]) ', 1) || '... [truncated]' ELSE head || '... [truncated]' END AS excerpt
FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id""",
)
def truncations(t: Tables):
    """Summary, subtitle, hydration and excerpt."""
    text = F.col("text")
    return t("documents").select("doc_id", c.summary(text).alias("summary"), c.summary(text, 120).alias("subtitle"), F.length(F.substring(text, 1, 10_000)).cast("long").alias("hydrated"), c.excerpt(text).alias("excerpt"))


@query("T11 T12 H12", r"""SELECT doc_id, CASE WHEN s = '' THEN 'rule' ELSE s END AS slug, CASE WHEN d = '' THEN 'untitled' WHEN length(d) <= 65 THEN d
  WHEN regexp_matches(substr(d, 1, 65), '^.+-') THEN regexp_extract(substr(d, 1, 65), '^(.+)-[^-]*$', 1)
  ELSE substr(d, 1, 65) END || '-' || substr(sha256(text), 1, 8) || '.md' AS name
FROM (SELECT doc_id, text, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '_', 'g'), '_') AS s, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS d FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) q) x""")
def slugs(t: Tables):
    """Slugs of whole texts, and file names cut at a word."""
    text = F.coalesce("text", F.lit(""))
    return t("documents").select("doc_id", c.slug(text).alias("slug"), c.canonical_name(text, text).alias("name"))


@query("T7", r"""SELECT doc_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(regexp_replace(text, '(\p{Ll})(\p{Lu})', concat('\1', chr(1), '\2'), 'g'), concat('[\p{L}\p{N}]+|::|->|=>|[^', chr(1), ']')), lambda p: CASE WHEN regexp_matches(p, '^[\p{L}\p{N}]') THEN (strlen(p) + 2) // 3 ELSE 1 END)), 0) AS BIGINT) AS tokens FROM documents""")
def token_estimates(t: Tables):
    """Tokens of a text, estimated by its words' humps."""
    return t("documents").select("doc_id", F.coalesce(c.token_estimate(F.col("text")), F.lit(0)).alias("tokens"))


@query("T14 D15", f"SELECT doc_id, sha256({redacted_sql('text')}) AS redacted_sha256 FROM documents")
def secret_redaction(t: Tables):
    """Secrets in quotes after their key, and those known by their form."""
    return t("documents").select("doc_id", F.sha2(c.redacted(F.col("text")), 256).alias("redacted_sha256"))


@query("T22", "SELECT doc_id, '* - [ ] open ' || lang AS line FROM documents UNION ALL SELECT doc_id, '- [x] done ' || doc_id FROM documents")
def checklists(t: Tables):
    """Lines of a list that are to be ticked, ticked or not, without the white space around them."""
    text = said("head\n  * - [ ] open ", F.col("lang"), "\n- no\n- [x] done ", F.col("doc_id"), " \n| a |")
    rows = t("documents").select("doc_id", F.explode(c.lines(text)).alias("line"))
    return rows.where(c.any_of(F.col("line"), ["- [ ]", "- [x]"])).select("doc_id", c.trimmed(F.col("line")).alias("line"))


# Entities, facts, code


@query("T18", rf"""WITH s AS (SELECT conv_id, turn, unnest(regexp_split_to_array(coalesce(text, '') || ' Then Turn-' || turn || ' met ' || upper(role) || '! The End', '[.?!\n]')) AS s FROM conversations), w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '') AS w FROM s),
e AS (SELECT conv_id, turn, regexp_replace(unnest(w[2:]), '[^\p{{L}}\p{{N}}_-]', '', 'g') AS entity FROM w) SELECT entity,
  count(DISTINCT (conv_id, turn)) AS turns FROM e WHERE regexp_matches(entity, '^[A-Z]') AND lower(entity) NOT IN ({listed(words.NO_ENTITY)})
  GROUP BY entity""")
def capitalised_entities(t: Tables):
    """Capitalised words that don't begin a sentence, without those that are no names."""
    return t("conversations").select("conv_id", "turn", F.explode(entity_words(said(F.col("text"), " Then Turn-", F.col("turn"), " met ", F.upper("role"), "! The End"))).alias("entity")).groupBy("entity").agg(F.count("*").alias("turns"))


def entity_words(text):
    sentences = F.transform(F.split(text, r"[.?!\n]"), lambda s: F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    later = F.flatten(F.transform(sentences, lambda w: F.slice(w, 2, F.greatest(F.size(w), F.lit(1)))))
    clean = F.transform(later, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_-]", ""))
    return F.array_distinct(F.filter(clean, lambda w: w.rlike("^[A-Z]") & ~F.lower(w).isin(words.NO_ENTITY)))


def entity_phrases(text):
    """Runs of capitalised words."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])[A-Z][a-zA-Z0-9_-]+(?:\s+[A-Z][a-zA-Z0-9_-]+)+(?![\p{L}\p{N}_])"), F.lit(0)))


@query("T18", """SELECT doc_id, ['Alpha_1', 'Data-Team', 'New', 'New York', 'Paris', 'The Data-Team Alpha_1', 'York'] AS entities FROM documents""")
def entities(t: Tables):
    """Phrases and single names of a text."""
    text = said("We met in New York. The Data-Team Alpha_1 (", F.lower("lang"), ") left for Paris! It rained, The end?")
    one = F.array_distinct(F.concat(entity_phrases(text), entity_words(text)))
    return t("documents").select("doc_id", F.array_sort(one).alias("entities"))


CODE = {
    "rs": ["/// Adds.", "/// Twice.", "pub(crate) async fn add_{n}(x: i32) -> i32 {{", "    x + 1", "}}", "", "/// lost", "let y = 1;", "struct S{n};", "// note", "pub const K{n}: u8 = 1;"],
    "py": ["import x", "class C{n}:", "    def run_{n}(self):", "        return 1", "async def no(): pass"],
    "ts": ["export async function go{n}() {{", "}}", "interface I{n} {{}}", "export const k{n} = 1"],
    "go": ["package x", "func F{n}() {{", "}}", "type T{n} struct {{}}"],
}
SYMBOLS = {"rs": [(3, "fn", "add_", "Adds.\nTwice."), (9, "struct", "S", None), (11, "const", "K", None)], "py": [(2, "class", "C", None), (3, "def", "run_", None)], "ts": [(1, "function", "go", None), (3, "interface", "I", None), (4, "const", "k", None)], "go": [(2, "func", "F", None), (4, "type", "T", None)]}
LANGUAGES = list(CODE)


def code_files(t: Tables):
    """A source file a document: path, content."""
    text = F.lit(None).cast("string")
    for i, (ext, rows) in enumerate(CODE.items()):
        body = "\n".join(rows).replace("{{", "{").replace("}}", "}")
        text = F.when(F.col("doc_id") % 4 == i, F.replace(F.lit(body), F.lit("{n}"), F.col("doc_id").cast("string"))).otherwise(text)
    ext = F.element_at(F.array(*(F.lit(x) for x in LANGUAGES)), (F.col("doc_id") % 4 + 1).cast("int"))
    return t("documents").select("doc_id", F.concat(F.lit("src/file"), "doc_id", F.lit("."), ext).alias("path"), text.alias("content"))


@query(
    "T19",
    " UNION ALL ".join(
        f"""SELECT doc_id, CAST({line} AS INT) AS start_line,
  CAST({min(line + 14, len(CODE[ext]))} AS INT) AS end_line, '{kind}' AS kind, '{name}' || doc_id AS name, {'NULL' if doc is None else chr(39) + doc.replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39)) + chr(39)} AS doc FROM documents WHERE doc_id % 4 = {i}"""
        for i, ext in enumerate(LANGUAGES)
        for line, kind, name, doc in SYMBOLS[ext]
    ),
)
def code_symbols(t: Tables):
    """Symbols of source files by line, with the comment above them."""
    return lines.symbols(code_files(t), "doc_id", "path", "content").select("doc_id", "start_line", "end_line", "kind", "name", "doc")


@query("T20", """SELECT doc_id, true AS same, CAST(CASE doc_id % 4 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS blocks FROM documents WHERE doc_id % 4 < 3""")
def paged_symbols(t: Tables):
    """Symbol blocks are paged out to references and read back: the file is as it was."""
    files = code_files(t)
    blocks = lines.blocks(files, "doc_id", "path", "content")
    paged = lines.paged(files, blocks, "doc_id", "content")
    back = lines.restored(paged, blocks, "doc_id", "content").select("doc_id", F.col("content").alias("back"))
    counts = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"))
    changed = paged.select("doc_id", F.col("content").contains("[Paged Symbol: Reference ").alias("paged"))
    return files.join(back, "doc_id").join(changed, "doc_id").join(counts, "doc_id").select("doc_id", ((F.col("back") == F.col("content")) & F.col("paged")).alias("same"), "blocks")


@query(
    "T21",
    """SELECT conv_id, turn, 'degree' AS key, 'history of ' || role AS value FROM conversations WHERE role = 'user' UNION ALL
  SELECT conv_id, turn, 'favorite_color', 'deep blue' FROM conversations WHERE role = 'user' UNION ALL
  SELECT conv_id, turn, 'preference', 'tea ' || turn FROM conversations WHERE role = 'user'
UNION ALL SELECT conv_id, turn, 'booked', 'hotel ' || conv_id FROM conversations WHERE role = 'user' UNION ALL
  SELECT conv_id, turn, 'occupation', 'baker' FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn, 'harvested', 'plums'
  FROM conversations WHERE role = 'user'""",
)
def user_facts(t: Tables):
    """Facts that users tell about themselves, sentence by sentence."""
    text = said("I majored in the History of ", F.col("role"), ". My favourite color is a deep blue. I prefer Tea ", F.col("turn"), ". We booked the Hotel ", F.col("conv_id"), ". I work as a baker. Then I harvested plums. My favorite two things is x. I prefer ")
    return lines.user_facts(t("conversations").select("conv_id", "turn", "role", text.alias("text")), "text").select("conv_id", "turn", "key", "value")


@query("T23", """SELECT conv_id, turn, 'first' || chr(10) || 'text ' || turn || chr(10) || 'inner ' || role || chr(10) || 'deep' || chr(10) || 'out' || chr(10) || 'in' AS content FROM conversations""")
def nested_contents(t: Tables):
    """Content that is a string, a block or blocks within blocks becomes text."""
    block = lambda **f: F.struct(*(v.alias(k) for k, v in f.items()))
    inner = F.to_json(F.struct(F.array(block(text=said("inner ", F.col("role")), content=F.lit("deep"))).alias("x")))
    text = said('["first", {"type": "text", "text": "text ', F.col("turn"), '", "content": ', F.get_json_object(inner, "$.x"), ', "output": "out", "input": "in", "id": 3}, 4, null]')
    return t("conversations").select("conv_id", "turn", texts.flattened(text).alias("content"))


@query("T24", """SELECT doc_id, CASE doc_id % 5 WHEN 4 THEN 'plain ' || doc_id ELSE '{"id": ' || doc_id || '}' END AS answer FROM documents""")
def cleaned_answers(t: Tables):
    """Answers without their thoughts and fences."""
    body = said('{"id": ', F.col("doc_id"), "}")
    kinds = [said("```json\n", body, "\n```"), said("Here it is:\n```json\n", body, "\n``` done"), said("<think>no ```\n</think>\n```", body, "```"), said("text ```markdown\n", body), said("  plain ", F.col("doc_id"), " ")]
    text = kinds[4]
    for i in range(4):
        text = F.when(F.col("doc_id") % 5 == i, kinds[i]).otherwise(text)
    return t("documents").select("doc_id", lines.clean_answer(text).alias("answer"))


@query("T24", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['A ' || doc_id, 'B (:|-|:) b'] END AS titles FROM documents""")
def batched_titles(t: Tables):
    """Titles of an answer in lines, all or none."""
    text = said("1(:|-|:) A ", F.col("doc_id"), "\nnote\n2(:|-|:) B (:|-|:) b", F.when(F.col("doc_id") % 3 == 0, "\n3(:|-|:) C").otherwise(""))
    return t("documents").select("doc_id", lines.titles(text, 2).alias("titles"))


@query("T29", """SELECT doc_id, '{"a":{"list":[1,null,{"d":' || doc_id || '}],"s":"' || lang || '"},"z":[]}' AS compact FROM documents""")
def without_json_nulls(t: Tables):
    """Members that are null go, at any depth; elements of an array stay."""
    text = said('{"a": {"n": null, "list": [1, null, {"c": null, "d": ', F.col("doc_id"), '}], "s": "', F.col("lang"), '"}, "b": null, "z": []}')
    return t("documents").select("doc_id", texts.without_nulls(text).alias("compact"))


# Dates


@query("S1", """SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL WHEN 4 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS at FROM events""")
def parsed_dates(t: Tables):
    """Dates in several forms, one of them broken."""
    f = lambda p: F.date_format("ts", p)
    forms = [f("yyyy-MM-dd HH:mm:ss"), f("yyyy/MM/dd'T'HH:mm:ss'Z'"), F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00")), F.concat(f("yyyy-M/d H:m:s"), F.lit("+02")), f("yyyy/MM/dd"), F.concat(f("yyyy"), F.lit("-13-01"))]
    text = forms[5]
    for i in range(5):
        text = F.when(F.col("event_id") % 6 == i, forms[i]).otherwise(text)
    return t("events").select("event_id", c.flexible_date(text).cast("timestamp_ntz").alias("at"))


@query("S2", """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS seconds, CASE WHEN event_id % 3 = 2 THEN NULL
  ELSE date_trunc('second', ts) END AS at FROM events""")
def unix_timestamps(t: Tables):
    """The first run of ten digits in a text, not of eleven, and not beside a letter."""
    at = F.unix_timestamp("ts").cast("string")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("id 12345678901 a1234567890 at "), at, F.lit(", then 1111111111"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), at, F.lit("]"))).otherwise(F.concat(F.lit("x"), at, F.lit(" 123456789")))
    found = c.unix_time(text)
    return t("events").select("event_id", found.alias("seconds"), F.timestamp_seconds(found).cast("timestamp_ntz").alias("at"))


@query("S3", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:00Z') END AS at FROM events""")
def haystack_dates(t: Tables):
    """Dates with a day's name; anything else is null."""
    return t("events").select("event_id", c.haystack_date(F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy/MM/dd (EEE) HH:mm")).otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm"))).alias("at"))


# Paths and ids


@query("T25", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'my-proj.x' WHEN 1 THEN 'app' || page_id WHEN 2 THEN 'c' ELSE NULL END AS scope FROM pages""")
def scopes_from_paths(t: Tables):
    """The deepest folder that says something."""
    kinds = [F.lit("/Users/keith/repos/My-Proj.x!/src/.git/session_logs"), said("/home/app", F.col("page_id"), "/Wiki/3f2504e0-4f89-41d3-9a0c-0305e82c3301/build"), F.lit("/a/b/c/tests/.d"), F.lit("/src/lib/.x")]
    text = kinds[3]
    for i in range(3):
        text = F.when(F.col("page_id") % 4 == i, kinds[i]).otherwise(text)
    return t("pages").select("page_id", c.scope_from_path(text).alias("scope"))


@query("T26 T27 T28 P3", r"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN turn END AS turn_index, 'conv_turn_' || conv_id AS session, 'u_' || conv_id AS user_id, 'C:/x/' || role || '/log.jsonl' AS path FROM conversations""")
def identities(t: Tables):
    """Turn of a title, session of a corpus id, user of a session, path in one form."""
    title = F.concat(F.lit("Session s - Turn "), F.col("turn"), F.when(F.col("turn") % 2 == 1, " - Turn x").otherwise(""))
    corpus = F.concat(F.lit("conv_turn_"), "conv_id", F.lit("_turn_"), "turn")
    path = F.regexp_replace(F.replace(F.concat(F.lit("C:\\x\\"), "role", F.lit("\r\n\\log.jsonl")), F.lit("\\"), F.lit("/")), "[\u0000\r\n]", "")
    return t("conversations").select("conv_id", "turn", c.turn_number(title).alias("turn_index"), F.regexp_extract(corpus, "^(.*)_turn_", 1).alias("session"), c.user_prefix(F.concat(F.lit("u_"), "conv_id", F.lit("_"), F.col("turn"))).alias("user_id"), path.alias("path"))


# Queries


SEARCHED = f"""WITH s AS (SELECT conv_id, turn, coalesce(text, '') AS q FROM conversations),
k AS (SELECT conv_id, turn, q, list_transform(list_filter(regexp_split_to_array(translate(q, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{{L}}\\p{{N}}]+'),
  lambda x: strlen(x) >= 2 AND x NOT IN ({listed(words.SEARCH_STOPS)})), lambda w: {spelled("w")})[1:8] AS kept FROM s)
SELECT conv_id, turn, CASE WHEN len(kept) > 0 THEN array_to_string(kept, ' ') ELSE trim(regexp_replace(q, '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')) END AS words FROM k"""


@query("T3 T5", SEARCHED)
def fts_words(t: Tables):
    """The words by which a turn's text is looked up."""
    return t("conversations").select("conv_id", "turn", F.array_join(c.search_words(F.coalesce("text", F.lit(""))), " ").alias("words"))


ASKED = ["what did i eat before lunch?", "Which hotel do you like", "who am I really", "Show the build log", "My MTG notes", "tell me About Me please"]
CLASSES = ["Temporal", "Preference", "User", "Default", "Temporal", "User"]


@query("S28", "SELECT conv_id, turn, " + "CASE (conv_id + turn) % 6 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(CLASSES)) + " END AS category FROM conversations")
def query_categories(t: Tables):
    """Static classes of a query."""
    text = F.element_at(F.array(*(F.lit(x) for x in ASKED)), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    return t("conversations").select("conv_id", "turn", c.category(text).alias("category"))


DICTIONARY = {**dict.fromkeys(["preference", "preferred", "vendors"], "Preference"), **dict.fromkeys(["meeting", "appointments", "yesterday"], "Temporal"), **dict.fromkeys(["my", "career", "employer"], "User")}
LOOKED_UP = {"no prefer here": "Preference", "all meetings with vendors": "Temporal", "careers in general": "User", "plain words": "Default", "about me and my appointment": "User", "employers": "User"}


@query("S29 J7", "SELECT conv_id, turn, CASE (conv_id + turn) % 6 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(LOOKED_UP.values())) + " END AS category FROM conversations")
def dictionary_categories(t: Tables):
    """Classes by a dictionary that is joined on stems: the stemmer runs once a distinct word."""
    text = F.element_at(F.array(*(F.lit(x) for x in LOOKED_UP)), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    asked = t("conversations").select("conv_id", "turn", text.alias("text"))
    known = t.spark.createDataFrame([(stem.stem(w), k) for w, k in DICTIONARY.items()], "stem string, class string").distinct()
    return lines.dictionary_class(asked, ["conv_id", "turn"], "text", known)


CUES = {"before that I left": ("preceding", 1.0), "and after it, what": ("succeeding", 1.0), "the newest entry": ("relative", 1.0), "Where have we taken this?": ("procedural", 3.0), "it was much later then": ("succeeding", 3.0), "nothing to see": (None, None), "I did run it": (None, None), "way recently": ("relative", 1.0)}


@query("S30", "SELECT conv_id, turn, CASE (conv_id + turn) % 8 " + " ".join(f"WHEN {i} THEN {k!r}" if k else f"WHEN {i} THEN NULL" for i, (k, _) in enumerate(CUES.values())) + " END AS kind, CASE (conv_id + turn) % 8 " + " ".join(f"WHEN {i} THEN {d}e0" if d else f"WHEN {i} THEN NULL" for i, (_, d) in enumerate(CUES.values())) + " END AS depth FROM conversations")
def temporal_cues(t: Tables):
    """Cue of a question and how far it looks."""
    text = F.element_at(F.array(*(F.lit(x) for x in CUES)), ((F.col("conv_id") + F.col("turn")) % 8 + 1).cast("int"))
    cue = c.temporal_cue(text)
    return t("conversations").select("conv_id", "turn", cue["kind"].alias("kind"), cue["depth"].alias("depth"))


ERRORS = ["error[E0308]: mismatch TS9", "src: TS2345 bad", "403  Forbidden", "RocksDB Lock held", "all fine"]


@query("S31", """WITH r AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'E0308 pattern' WHEN 1 THEN 'on permission' WHEN 2 THEN 'other' ELSE 'a lock' END AS pattern,
  CASE WHEN item_id % 8 = 0 THEN 'superseded' ELSE 'active' END AS status FROM benchmark),
e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'E0308' WHEN 1 THEN 'TS2345' WHEN 2 THEN 'permission' WHEN 3 THEN 'lock' END AS signature
  FROM events)
SELECT event_id, signature, (SELECT min(item_id) FROM r WHERE status <> 'superseded' AND contains(pattern, signature)) AS rule FROM e""")
def error_signatures(t: Tables):
    """What an error is known by, and the first live rule about it."""
    text = F.element_at(F.array(*(F.lit(x) for x in ERRORS)), (F.col("event_id") % 5 + 1).cast("int"))
    pattern = F.element_at(F.array(*(F.lit(x) for x in ("E0308 pattern", "on permission", "other", "a lock"))), (F.col("item_id") % 4 + 1).cast("int"))
    rules = t("benchmark").where("item_id % 8 <> 0").select("item_id", pattern.alias("pattern"))
    found = t("events").select("event_id", c.error_signature(text).alias("signature"))
    kinds = found.select("signature").where("signature IS NOT NULL").distinct()  # a few codes meet the rules, not the errors
    first = kinds.join(rules, F.col("pattern").contains(F.col("signature"))).groupBy("signature").agg(F.min("item_id").alias("rule"))
    return found.join(first, "signature", "left").select("event_id", "signature", "rule")


LISTS = {"corrects": words.CORRECTING, "repairs": words.REPAIRING, "directs": words.DIRECTING, "advises": words.ADVISING}


@query("P17 P18", "SELECT conv_id, turn, " + ", ".join("(" + " OR ".join("contains(lower(t), '" + w.replace("'", "''") + "')" for w in v) + f") AS {k}" for k, v in LISTS.items()) + " FROM (SELECT conv_id, turn, role, text || CASE (conv_id + turn) % 7 WHEN 0 THEN ' That''s WRONG.' WHEN 1 THEN ' You forgot it' WHEN 2 THEN ' always use x' WHEN 3 THEN ' remember to' ELSE '' END AS t, text FROM conversations) x WHERE text IS NOT NULL AND trim(text) <> '' AND NOT (role = 'assistant' AND length(trim(text)) <= 20)")
def correction_turns(t: Tables):
    """Turns that correct, ask for a repair, direct or advise, by four word lists; short answers and empty turns are left out."""
    added = {0: " That's WRONG.", 1: " You forgot it", 2: " always use x", 3: " remember to"}
    end = F.lit("")
    for k, v in added.items():
        end = F.when((F.col("conv_id") + F.col("turn")) % 7 == k, v).otherwise(end)
    kept = t("conversations").where("text IS NOT NULL AND trim(text) <> '' AND NOT (role = 'assistant' AND length(trim(text)) <= 20)")
    low = F.lower(F.concat("text", end))
    return kept.select("conv_id", "turn", *(c.any_of(low, v).alias(k) for k, v in LISTS.items()))


# Tiers, routes, scores

NAMES = ["Permanent", "skills", "forge", "wiki_node", "user", "episode", "STM", "odd"]


@query(
    "S20 S21 S23",
    """WITH n AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'wisdom' WHEN 1 THEN 'wisdom' WHEN 2 THEN 'project' WHEN 3 THEN 'project' WHEN 4 THEN 'user'
  WHEN 5 THEN 'session' WHEN 6 THEN 'working' END AS tier, CASE doc_id % 3 WHEN 0 THEN 'Temporal' WHEN 1 THEN 'User' ELSE 'Default' END AS about,
  CASE WHEN doc_id % 5 = 0 THEN 'wiki/skills/a.md' WHEN doc_id % 5 = 1 THEN 'wiki/project_brief.md' END AS path, CASE
  WHEN doc_id % 7 = 0 THEN 'Compaction: x' ELSE 'Note' END AS title FROM documents)
SELECT doc_id, tier, CASE WHEN tier = 'session' AND about <> 'Default' THEN 1.3e0 WHEN tier = 'wisdom' THEN 1.2e0 WHEN tier = 'project' THEN 1.1e0
  ELSE 1e0 END AS boost,
  CASE WHEN tier = 'wisdom' THEN CASE WHEN path LIKE '%skills%' THEN 0 ELSE 1 END WHEN tier = 'project' THEN CASE WHEN path IS NOT NULL THEN CASE
  WHEN path LIKE '%project_brief%' THEN 2 ELSE 3 END WHEN title LIKE 'Compaction:%' THEN 2 ELSE 3 END WHEN tier = 'session' THEN 4
  ELSE 5 END AS hierarchy FROM n""",
)
def tier_names(t: Tables):
    """Tier of a name, its boost by what is asked, its place in packing."""
    name = F.element_at(F.array(*(F.lit(x) for x in NAMES)), (F.col("doc_id") % 8 + 1).cast("int"))
    about = F.element_at(F.array(F.lit("Temporal"), F.lit("User"), F.lit("Default")), (F.col("doc_id") % 3 + 1).cast("int"))
    path = F.when(F.col("doc_id") % 5 == 0, "wiki/skills/a.md").when(F.col("doc_id") % 5 == 1, "wiki/project_brief.md")
    title = F.when(F.col("doc_id") % 7 == 0, "Compaction: x").otherwise("Note")
    known = t("documents").select("doc_id", c.tier(name).alias("tier"), about.alias("about"), path.alias("path"), title.alias("title"))
    return known.select("doc_id", "tier", c.tier_boost(F.col("tier"), F.col("about")).alias("boost"), c.hierarchy(F.col("tier"), F.col("path"), F.col("title")).alias("hierarchy"))


ARCHETYPES = {"Summarization": 20, "Extraction": 40, "Chat": 50, "Code": 80, "Reasoning": 90}


@query(
    "S27",
    """WITH s AS (SELECT doc_id, [20, 40, 50, 80, 90][1 + doc_id % 5] - CASE WHEN doc_id % 3 = 0 THEN 25 ELSE 0 END + CASE WHEN n_chars IS NULL THEN 0
  WHEN n_chars // 4 > 8000 THEN 30 WHEN n_chars // 4 > 4000 THEN 15 WHEN n_chars // 4 > 2000 THEN 5 WHEN n_chars // 4 < 500 THEN -10
  ELSE 0 END AS score FROM documents)
SELECT doc_id, CASE WHEN score < 30 THEN 'micro' WHEN score < 55 THEN 'small' WHEN score < 75 THEN 'medium' WHEN score < 95 THEN 'large'
  ELSE 'cloud' END AS tier FROM s""",
)
def task_routing(t: Tables):
    """Model tier of a task by archetype, latency and tokens."""
    base = F.element_at(F.array(*(F.lit(v) for v in ARCHETYPES.values())), (F.col("doc_id") % 5 + 1).cast("int"))
    tokens = F.floor(F.col("n_chars") / 4)
    size = c.first_match([(tokens > 8000, 30), (tokens > 4000, 15), (tokens > 2000, 5), (tokens < 500, -10)], 0)
    score = base - F.when(F.col("doc_id") % 3 == 0, 25).otherwise(0) + size
    return t("documents").select("doc_id", c.first_match([(score < 30, "micro"), (score < 55, "small"), (score < 75, "medium"), (score < 95, "large")], "cloud").alias("tier"))


@query("S25 S6", """SELECT d.doc_id, CAST(768 AS INT) AS n, 1e0 AS norm, d.doc_id = f.first AS first_of_its_text FROM documents d JOIN (SELECT coalesce(text, '') AS t,
  min(doc_id) AS first FROM documents GROUP BY 1) f ON coalesce(d.text, '') = f.t""")
def mock_embeddings(t: Tables):
    """A unit vector that the text's hash decides: equal texts have equal vectors, others don't."""
    rows = t("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    seed = F.array_repeat(F.xxhash64("text"), 768)  # the text is hashed once
    raw = rows.select("doc_id", F.transform(seed, lambda x, i: F.xxhash64(x, i) / 2.0**63).alias("raw"))
    length = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
    unit = raw.select("doc_id", F.zip_with("raw", F.array_repeat(length, 768), lambda x, y: x / y).alias("v"))
    marked = unit.select("doc_id", F.size("v").alias("n"), F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"), F.xxhash64("v").alias("h"))
    first = marked.groupBy("h").agg(F.min("doc_id").alias("first"))
    return marked.join(first, "h").select("doc_id", "n", "norm", (F.col("doc_id") == F.col("first")).alias("first_of_its_text"))


@query("S5 S4", """SELECT vec_id, CASE WHEN vec_id % 5 < 3 THEN 0e0 ELSE round(list_dot_product(CAST(embedding AS DOUBLE[]),
  CAST(q AS DOUBLE[])) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]),
  CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[])))), 6) END AS cosine
  FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 3)""")
def cosine_rules(t: Tables):
    """Cosine with vectors of another length, none and zeros among them."""
    probe = t("embeddings").where("vec_id = 3").select(F.col("embedding").alias("q"))
    odd = F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 10)).when(F.col("vec_id") % 5 == 1, F.array().cast("array<float>")).when(F.col("vec_id") % 5 == 2, F.transform("embedding", lambda x: x * F.lit(0).cast("float"))).otherwise(F.col("embedding"))
    return t("embeddings").crossJoin(F.broadcast(probe)).select("vec_id", F.round(c.cosine(odd, F.col("q")), 6).alias("cosine"))


ORDERED = "list({} ORDER BY ts, event_id)"


@query("S19", """SELECT user_id, CAST(list_reduce(list_prepend(50, list(CASE WHEN event_type = 'error' THEN -5 ELSE 2 END
  ORDER BY ts, event_id)), lambda s, x: greatest(0, least(100, s + x))) AS BIGINT) AS confidence FROM events GROUP BY user_id""")
def confidence_walk(t: Tables):
    """Confidence in hundredths: up by 2, down by 5, between 0 and 100, from 50 on."""
    step = F.when(F.col("event_type") == "error", -5).otherwise(2)
    return walks.clamped(t("events").withColumn("step", step), "user_id", ["ts", "event_id"], F.to_date("ts"), "step", 0, 100, 50).select("user_id", F.col("value").alias("confidence"))


@query("S26", """SELECT user_id, CAST(list_reduce(list_prepend(55, list(CASE WHEN event_type = 'error' THEN -5 ELSE 1 END ORDER BY ts, event_id)), lambda s, x: CASE
  WHEN x > 0 THEN least(85, s + x) ELSE greatest(20, s + x) END) AS BIGINT) AS threshold FROM events GROUP BY user_id""")
def threshold_walk(t: Tables):
    """A search threshold in hundredths: up by 1 after a hit to 85 at most, down by 5 after a miss to 20 at least."""
    step = F.when(F.col("event_type") == "error", -5).otherwise(1)
    return walks.clamped(t("events").withColumn("step", step), "user_id", ["ts", "event_id"], F.to_date("ts"), "step", 20, 85, 55).select("user_id", F.col("value").alias("threshold"))


@query("S17 R18", """WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS back,
  count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(sum(0.3e0 * CASE WHEN event_type = 'error' THEN 0 ELSE 100 END * power(0.7e0, back)) + 50 * power(0.7e0,
  max(n)), 6) AS feedback, round(sum(0.1e0 * CASE WHEN event_type = 'purchase' THEN 10 ELSE 1 END * power(0.9e0, back)) + 5 * power(0.9e0,
  max(n)), 6) AS importance, CAST(100 * count(*) FILTER (event_type = 'purchase') // count(*) AS BIGINT) AS utilisation FROM o GROUP BY user_id""")
def moving_averages(t: Tables):
    """Utility after feedback, importance after citations, and the share of injected rows that were used."""
    e = t("events").withColumn("good", F.when(F.col("event_type") == "error", 0.0).otherwise(100.0)).withColumn("cited", F.when(F.col("event_type") == "purchase", 10.0).otherwise(1.0))
    order = ["ts", "event_id"]
    feedback = walks.smoothed(e, "user_id", order, F.to_date("ts"), "good", 0.3, 50.0).withColumnRenamed("value", "feedback")
    cited = walks.smoothed(e, "user_id", order, F.to_date("ts"), "cited", 0.1, 5.0).withColumnRenamed("value", "importance")
    used = e.groupBy("user_id").agg(F.floor(100 * F.count_if(F.col("event_type") == "purchase") / F.count("*")).alias("utilisation"))
    return feedback.join(cited, "user_id").join(used, "user_id").select("user_id", F.round("feedback", 6).alias("feedback"), F.round("importance", 6).alias("importance"), "utilisation")


@query("T1 T2 T4", None)
def stemmed_postings(t: Tables):
    """Stemmed terms of each document with their counts; the stemmer runs once a distinct word, and stems are joined back."""
    return lines.postings(t("documents").select("doc_id", "text"), "doc_id", "text")


@query("T17", None)
def compacted_results(t: Tables):
    """A result list's texts, cut to what a budget leaves: without the reason, without the last paragraphs, or short of a character."""

    @F.pandas_udf("string")
    def compacted(s: pd.Series) -> pd.Series:
        return s.map(lambda x: texts.compacted(x, 120))

    reason = said("**Avoid**: ", F.col("source"), "\n**Why**: ", F.col("text"), "\n**Prescribed Remedy**: use ", F.col("lang"))
    text = F.when(F.col("doc_id") % 3 == 0, reason).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("First.\n\nSecond.\n\n"), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    return t("documents").select("doc_id", compacted(text).alias("content"))


@query("E4", None)
def session_diffs(t: Tables):
    """How the words of a session's last user turn differ from those of its first, as a unified diff."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    users = t("conversations").where("role = 'user'").withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    ends = users.where("k = 1 OR k = n").groupBy("conv_id").agg(F.min_by("text", "turn").alias("a"), F.max_by("text", "turn").alias("b"))

    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([texts.sequence_diff((x or "").split(), (y or "").split()) for x, y in zip(a, b, strict=True)])

    return ends.select("conv_id", diff("a", "b").alias("diff"))
