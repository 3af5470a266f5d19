"""Text and date functions as column expressions, so that they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.functions import words


def any_of(text: Column, parts: list[str]) -> Column:
    """Contains one of some literal parts."""
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def first_match(pairs: list[tuple[Column, object]], other: object) -> Column:
    """The value of the first condition that holds."""
    out = F.when(pairs[0][0], pairs[0][1])
    for test, value in pairs[1:]:
        out = out.when(test, value)
    return out.otherwise(other)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeezed(c: Column) -> Column:
    """White space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def lines(text: Column) -> Column:
    """The lines of a text; a line break at its end opens none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n"))


def word_list(text: Column) -> Column:
    """Words between white space, without the marks around them, in lower case."""
    return F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def holds(found: Column, of: list[str]) -> Column:
    """One of the words is in an array."""
    return F.exists(found, lambda w: w.isin(of))


ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def looked_up(word: Column, table: dict[str, str]) -> Column:
    """A word's entry in a small table, or the word."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), word), word)


def search_words(query: Column, most: int = 8) -> Column:
    """The first `most` words by which a query is looked up, in order and with repeats: two bytes or more, no stop word, in one spelling and one
    word for synonyms. Where none is left, the query without marks; an empty array where nothing is left of that."""
    parts = F.split(F.translate(query, ASCII_UPPER, ASCII_LOWER), r"[^\p{L}\p{N}]+")
    kept = F.filter(parts, lambda w: (F.octet_length(w) >= 2) & ~w.isin(words.SEARCH_STOPS))
    found = F.slice(F.transform(kept, lambda w: looked_up(looked_up(w, words.SPELLING), words.SYNONYMS)), 1, most)
    bare = trimmed(F.regexp_replace(query, r"[^\p{L}\p{N}\s]", ""))
    return F.when(F.size(found) > 0, found).when(bare != "", F.array(bare)).otherwise(F.array().cast("array<string>"))


# What a question and a text share


def names(text: Column) -> Column:
    """Capitalised words that don't begin a sentence."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<=[\p{L}\p{N},;:] )(\p{Lu}\p{Ll}+)"), F.lit(1)))


def quotations(text: Column) -> Column:
    """What stands between double quotation marks."""
    return F.filter(F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1)), lambda x: F.trim(x) != "")


def dates(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1)), lambda x: x.try_cast("date")), lambda x: x.isNotNull())


def closeness(a: Column, b: Column, days: int = 30) -> Column:
    """1 for a common date, falling to 0 over some days; 0 without a date on either side."""
    gaps = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.abs(F.datediff(x, y)))))
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.array_min(gaps) / F.lit(days)), F.lit(0.0))


def boosted_distance(base: Column, person: Column, quote: Column, near: Column, overlap: Column, known: Column) -> Column:
    """A distance less what a text shares with a question: a name and a quotation take a share of it, dates and words a step, a known symbol half."""
    less = F.when(person, 0.4 * base).otherwise(0.0) + F.when(quote, 0.6 * base).otherwise(0.0) + 0.2 * near + 0.3 * overlap + 0.5 * known * base
    return F.least(F.lit(2.0), F.greatest(F.lit(-2.0), base - less))


# Markdown


def wikilinks(text: Column) -> Column:
    r"""Targets of [[target|label]] links, each once, in order; \| is a bar in a target. Links inside a link count too."""
    inside = r"(?:\\.|[^\]\\]|\](?!\]))*"
    target = r"((?:\\.|[^|\]\\]|\](?!\]))*)"
    raw = F.regexp_extract_all(text, F.lit(rf"\[\[(?={target}(?:\|{inside})?\]\])"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(raw, lambda x: F.replace(trimmed(x), F.lit("\\|"), F.lit("|"))), lambda x: x != ""))


def plain_text(markdown: Column) -> Column:
    """Text and code of a markdown text in one line: no marks of headings, lists, quotes, emphasis, links, images, HTML or fences."""
    steps = [
        (r"(?m)^\s*(?:```|~~~).*$", " "),
        (r"(?m)^\s*(?:[-*_]\s*){3,}$", " "),
        (r"(?m)^\s{0,3}#{1,6}\s+", ""),
        (r"(?m)^\s*(?:>\s?)+", ""),
        (r"(?m)^\s*(?:[-*+]|\d{1,9}[.)])\s+", ""),
        (r"<[!/a-zA-Z][^>]*>", ""),
        (r"!?\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(\*\*|__)(.+?)\1", "$2"),
        (r"(?<![\p{L}\p{N}])([*_])(\S(?:.*?\S)?)\1(?![\p{L}\p{N}])", "$2"),
        (r"`+([^`]*)`+", "$1"),
    ]
    for pattern, new in steps:
        markdown = F.regexp_replace(markdown, pattern, new)
    return squeezed(markdown)


def without_title(body: Column, title: Column) -> Column:
    """Drops the leading lines that are empty, or are the title or its last path component, alone or repeated, with or without
    marks of a heading."""
    name = F.lower(trimmed(F.regexp_replace(trimmed(title), "^#+", "")))
    names = F.filter(F.array(name, F.element_at(F.split(name, "/"), -1)), lambda n: n != "")

    def is_title(line: Column) -> Column:
        said = F.lower(trimmed(F.regexp_replace(trimmed(line), "^#+", "")))
        said_words = F.filter(F.split(said, r"\s+"), lambda w: w != "")

        def repeats(n: Column) -> Column:
            one = F.filter(F.split(n, r"\s+"), lambda w: w != "")
            times = F.floor(F.size(said_words) / F.size(one)).cast("int")
            same = F.array_join(said_words, " ") == F.array_join(F.array_repeat(F.array_join(one, " "), times), " ")
            return (said == n) | ((F.size(one) > 0) & (times >= 2) & same)

        return F.exists(names, repeats)

    rows = lines(body)
    first = F.array_position(F.transform(rows, lambda x: ~((trimmed(x) == "") | is_title(x))), True)
    return F.when(first == 0, "").otherwise(F.array_join(F.slice(rows, F.greatest(first, F.lit(1)).cast("int"), F.greatest(F.size(rows), F.lit(1))), "\n"))


def front_matter(text: Column, key: str) -> Column:
    """A key's value in the head between two --- lines, without quotes; null without it."""
    head = F.regexp_extract(trimmed(text), r"(?s)\A---(.*?)---", 1)
    value = F.regexp_extract(head, rf"(?m)^[ \t]*{key}[ \t]*:[ \t]*(.*?)[ \t]*$", 1)
    return F.nullif(F.regexp_replace(value, r"^[\"']|[\"']$", ""), F.lit(""))


def body_of(text: Column) -> Column:
    """The text behind its head; all of it where there is none."""
    return F.when(trimmed(text).rlike(r"(?s)\A---.*?---"), F.regexp_replace(F.regexp_replace(trimmed(text), r"(?s)\A---.*?---", ""), r"\A\n+", "")).otherwise(text)


# Cuts


def summary(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def excerpt(text: Column, most: int = 500) -> Column:
    """At most so many bytes, cut at the last paragraph or else sentence that ends there."""
    head = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string")), "�+\\z", "")
    paragraph = F.regexp_extract(head, r"(?s)\A(.*)\n\n", 1)
    sentence = F.regexp_extract(head, r"(?s)\A(.*\.) ", 1)
    cut = F.when(head.contains("\n\n"), paragraph).when(head.contains(". "), sentence).otherwise(head)
    return F.when(F.octet_length(text) > most, F.concat(cut, F.lit("... [truncated]"))).otherwise(text)


def slug(text: Column, mark: str = "_", empty: str = "rule") -> Column:
    """Letters and digits in lower case, runs of others as one mark, none at the ends."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", mark), f"^{mark}+|{mark}+$", "")
    return F.when(out == "", empty).otherwise(out)


def canonical_name(title: Column, content: Column, most: int = 65) -> Column:
    """A slug with dashes, cut at a word, with eight digits of the content's hash."""
    whole = slug(title, "-", "untitled")
    head = F.substring(whole, 1, most)
    cut = F.when(F.length(whole) <= most, whole).when(head.rlike("^.+-"), F.regexp_replace(head, "-[^-]*$", "")).otherwise(head)
    return F.concat(cut, F.lit("-"), F.substring(F.sha2(content, 256), 1, 8), F.lit(".md"))


# Secrets; fixed values: the patterns of the redaction.
SECRETS = [
    (r"""(?i)((?:password|passwd|secret|token|api[_-]?key)["']?\s*[:=]\s*)"[^"\n]+\"""", '$1"[REDACTED]"'),
    (r"""(?i)((?:password|passwd|secret|token|api[_-]?key)["']?\s*[:=]\s*)'[^'\n]+'""", "$1'[REDACTED]'"),
    (r"AKIA[0-9A-Z]{16}", "[REDACTED]"),
    (r"gh[pousr]_[A-Za-z0-9]{36,}", "[REDACTED]"),
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED]"),
    (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[REDACTED]"),
    (r"(export\s+[A-Za-z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD)[A-Za-z0-9_]*=)\S+", "$1[REDACTED]"),
]


def redacted(text: Column) -> Column:
    for pattern, new in SECRETS:
        text = F.regexp_replace(text, pattern, new)
    return text


def token_estimate(text: Column) -> Column:
    """White space and marks count 1 (`::`, `->`, `=>` together), underscores too; words are cut into humps, of (bytes + 2) / 3 each."""
    humps = F.regexp_replace(text, r"(\p{Ll})(\p{Lu})", "$1\u0001$2")
    pieces = F.regexp_extract_all(humps, F.lit("[\\p{L}\\p{N}]+|::|->|=>|[^\u0001]"), F.lit(0))
    sizes = F.transform(pieces, lambda p: F.when(p.rlike(r"^[\p{L}\p{N}]"), F.floor((F.octet_length(p) + 2) / 3)).otherwise(F.lit(1).cast("long")))
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x)


# Paths and ids


def scope_from_path(path: Column) -> Column:
    """The deepest component that isn't dotted, a UUID, generic, or about a session; only its letters, digits, -, _ and dots."""
    uuid = r"(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"
    low = lambda x: F.lower(x)
    kept = F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.startswith(".") & ~x.rlike(uuid) & ~low(x).isin(words.GENERIC_FOLDERS) & ~low(x).contains("session"))
    clean = F.filter(F.transform(kept, lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}._-]", ""), r"^\.+|\.+$", "")), lambda x: x != "")
    return F.when(F.size(clean) > 0, F.element_at(clean, -1))


def user_prefix(session: Column) -> Column:
    return F.regexp_replace(session, r"_[0-9]{1,3}$", "")


def turn_number(title: Column) -> Column:
    """N of a title `... - Turn N` with just one such mark."""
    parts = F.split(title, " - Turn ", -1)
    return F.when(F.size(parts) == 2, F.expr("1") * F.element_at(parts, 2).try_cast("long"))


# Dates


def flexible_date(text: Column) -> Column:
    """Year, month and day between - or /, a time behind T or a space; a zone is read over. Null where that isn't a date."""
    pattern = r"^(\d+)[-/](\d+)[-/](\d+)(?:[T ](\d+):(\d+):(\d+))?(?:Z|[+-]\d+(?::\d+)?)?"
    part = lambda k: F.regexp_extract(text, pattern, k).try_cast("int")
    made = F.try_make_timestamp(part(1), part(2), part(3), F.coalesce(part(4), F.lit(0)), F.coalesce(part(5), F.lit(0)), F.coalesce(part(6), F.lit(0)))
    broken = text.rlike(r"^\d+[-/]\d+[-/]\d+[T ]") & ~text.rlike(r"^\d+[-/]\d+[-/]\d+[T ]\d+:\d+:\d+")
    return F.when(text.rlike(pattern) & ~broken, made)


def unix_time(text: Column) -> Column:
    """The first run of exactly ten digits with no letter or digit beside it."""
    return F.nullif(F.regexp_extract(text, r"(?<![\p{L}\p{N}])(\d{10})(?![\p{L}\p{N}])", 1), F.lit("")).cast("long")


def haystack_date(text: Column) -> Column:
    """YYYY/MM/DD (Ddd) HH:MM as an ISO time; anything else is null."""
    pattern = r"^(\d{4})/(\d{2})/(\d{2}) \([A-Z][a-z]{2}\) (\d{2}):(\d{2})$"
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, "$1-$2-$3T$4:$5:00Z"))


# Queries


def without_temporal(text: Column) -> Column:
    return squeezed(F.regexp_replace(text, rf"\b({'|'.join(words.TEMPORAL)})\b", ""))


def category(text: Column) -> Column:
    """Temporal words come before preference words, these before words about the user."""
    found = word_list(text)
    about = holds(found, words.ABOUT_USER) | any_of(F.lower(text), words.USER_PHRASES)
    return first_match([(holds(found, words.ABOUT_TIME), "Temporal"), (holds(found, words.ABOUT_TASTE), "Preference"), (about, "User")], "Default")


def temporal_cue(text: Column) -> Column:
    """struct(kind, depth). A question with a verb of action behind it looks three steps back; a cue does so behind a word of depth;
    any other cue looks one step. The first cue counts."""
    low = F.lower(text)
    said = F.transform(F.filter(F.split(low, r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(w, r"^[?.,]+|[?.,]+$", ""))
    asked = F.get(said, 0).isin(words.ASKING) & holds(F.slice(said, 2, F.greatest(F.size(said), F.lit(1))), words.ACTING)
    plain = F.transform(F.filter(F.split(low, r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    kind_of = lambda w: first_match([(w.isin(words.PRECEDING), "preceding"), (w.isin(words.SUCCEEDING), "succeeding"), (w.isin(words.RELATIVE), "relative")], F.lit(None))
    deep = F.filter(F.transform(plain, lambda w, i: F.when((i > 0) & F.get(plain, i - 1).isin(words.DEEP) & ~w.isin(words.RELATIVE), kind_of(w))), lambda k: k.isNotNull())
    cues = F.filter(F.transform(plain, kind_of), lambda k: k.isNotNull())
    cue = lambda kind, depth: F.struct(kind.alias("kind"), F.lit(depth).alias("depth"))
    return F.when(asked, cue(F.lit("procedural"), 3.0)).when(F.size(deep) > 0, cue(F.get(deep, 0), 3.0)).when(F.size(cues) > 0, cue(F.get(cues, 0), 1.0))


def error_signature(text: Column) -> Column:
    """A compiler's code, or a word for refused permission or a lock."""
    code = lambda p: F.regexp_extract(text, p, 0)
    return first_match(
        [
            (text.rlike(r"E\d{4}"), code(r"E\d{4}")),
            (text.rlike(r"TS\d{4}"), code(r"TS\d{4}")),
            (text.rlike(r"(?i)401\s+Unauthorized|403\s+Forbidden|Permission\s+denied|permission_denied"), F.lit("permission")),
            (text.rlike(r"(?i)lock\s+acquisition\s+failure|RocksDB\s+lock|lock\s+conflict"), F.lit("lock")),
        ],
        F.lit(None),
    )


# Tiers


def tier(name: Column) -> Column:
    """The tier that a name stands for; null for none."""
    n = F.lower(name)
    return first_match([(n.isin(names), t) for t, names in words.TIERS.items()], F.lit(None))


def tier_boost(t: Column, about: Column) -> Column:
    return first_match([((t == "session") & about.isin("User", "Preference", "Temporal"), 1.3), (t == "wisdom", 1.2), (t == "project", 1.1)], 1.0)


def hierarchy(t: Column, path: Column, title: Column) -> Column:
    """Order in which results are packed: skills, rules, briefs and syntheses, insights, episodes, others."""
    brief = F.coalesce(path.contains("compaction") | path.contains("project_brief"), title.contains("Compaction:") | title.contains("Synthesis"))
    return first_match([((t == "wisdom") & F.coalesce(path.contains("skills"), F.lit(False)), 0), (t == "wisdom", 1), ((t == "project") & brief, 2), (t == "project", 3), (t == "session", 4)], 5)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ, one is empty or has no length."""
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(wide(a), wide(b), lambda x, y: x * y))
    norm = F.sqrt(total(F.transform(wide(a), lambda x: x * x))) * F.sqrt(total(F.transform(wide(b), lambda x: x * x)))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norm == 0), 0.0).otherwise(dot / norm)
