"""Row functions that a column expression can't say: splitting, compaction, nested JSON."""

from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


TOKEN = re.compile(r"(?s)[^\W_]+|::|->|=>|.")
CAPITAL = re.compile(r"(?<=[^\W\d_])(?=[A-Z])")


def _token_cost(token: str) -> int:
    """A mark's is 1, a word's that of its humps."""
    if not token[0].isalnum():
        return 1
    humps = CAPITAL.sub(lambda k: "\0" if token[k.start() - 1].islower() else "", token).split("\0") if not token.islower() else [token]
    return sum((len(h.encode()) + 2) // 3 for h in humps)


def token_estimate(text: str, most: int | None = None) -> int:
    """White space and marks count 1 (`::`, `->`, `=>` together), underscores too; words are cut into humps, of (bytes + 2) / 3 each.
    The same as columns.token_estimate, for texts that a Python function makes. With `most`, counting ends once it is over that."""
    total = 0
    for m in TOKEN.finditer(text):
        if most is not None and m.end() - m.start() > 3 * most + 1:
            return most + 1
        total += _token_cost(m[0])
        if most is not None and total > most:
            break
    return total


def head_of(text: str, most: int) -> int:
    """The length of the longest head that counts `most` at most: whole tokens, and then as much of a word as fits; read no further than that."""
    left = most
    for m in TOKEN.finditer(text):
        cost = _token_cost(m[0]) if m.end() - m.start() <= 3 * left + 1 else left + 1  # each three bytes cost 1 at least
        if cost <= left:
            left -= cost
            continue
        low, high = m.start(), min(m.end(), m.start() + 3 * left + 1)  # a longer one never costs less
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if _token_cost(text[m.start() : middle]) <= left else (low, middle)
        return low
    return len(text)


def split_recursive(text: str, most: int, marks: tuple[str, ...] = ("\n---\n", "\n# ", "\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most `most` characters, cut at the strongest mark that helps and regrouped greedily with it."""
    if len(text) <= most:
        return [text] if text else []
    mark, *rest = marks
    if not mark:
        return [text[i : i + most] for i in range(0, len(text), most)]
    out, now = [], ""
    for k, part in enumerate(text.split(mark)):
        part = mark.strip("\n") + part if k and mark == "\n# " else part
        joined = now + ("\n" if mark == "\n# " else mark) + part if now else part
        if len(joined) <= most:
            now = joined
            continue
        if now:
            out.append(now)
        now = part
        if len(part) > most:
            *full, now = split_recursive(part, most, tuple(rest))
            out += full
    return [*out, now] if now else out


def sequence_diff(a: list[str], b: list[str]) -> str:
    return "\n".join(difflib.unified_diff(a, b, "a", "b", lineterm=""))


def sections(text: str) -> list[tuple[str, str]]:
    """(title, text) of each section that a line of # marks opens; the whole text where there is none. What stands before the first goes."""
    heads = [(m.start(), m[1].strip()) for m in re.finditer(r"(?m)^[ \t]*#+ +(\S.*)$", text)]
    if not heads:
        return [("Document Root", text)]
    ends = [at for at, _ in heads[1:]] + [len(text)]
    return [(title, text[at:end]) for (at, title), end in zip(heads, ends, strict=True)]


def windows(text: str, size: int, overlap: int) -> list[str]:
    """Windows of `size` words, each `overlap` words into the one before."""
    w = text.split()
    out = [" ".join(w[at : at + size]) for at in range(0, max(1, len(w) - overlap), size - overlap)]
    return out if w else []


def grouped_sections(text: str, tokens: int = 24_000, overlap: int = 2_400, most: int = 20_000) -> list[tuple[str, str]]:
    """Neighbouring sections together, up to `tokens` words; a longer one in windows; what is over `most` bytes cut again."""
    groups: list[tuple[str, str]] = []
    batch: list[tuple[str, str]] = []
    used = 0

    def close() -> None:
        nonlocal batch, used
        if batch:
            title = batch[0][0] if len(batch) == 1 else f"{batch[0][0]} - {batch[-1][0]}"
            groups.append((title, "".join(b for _, b in batch)))
        batch, used = [], 0

    for title, body in sections(text):
        n = len(body.split())
        if n > tokens:
            close()
            groups.extend((f"{title} (Part {k})", w) for k, w in enumerate(windows(body, tokens, overlap), 1))
            continue
        if used + n > tokens:
            close()
        batch.append((title, body))
        used += n
    close()
    out = []
    for title, body in groups:
        if len(body.encode()) > most:
            out += [(f"{title} (Part {k})", p) for k, p in enumerate(split_recursive(body, most // 4 if not body.isascii() else most), 1)]
        else:
            out.append((title, body))
    return out or [("Document Root", text)]


CUT = "... [Truncated (Inner-Node Compaction)]"


CUT_TOKENS = token_estimate(CUT)


def compacted(text: str | None, budget: int) -> str | None:
    """A text of at most `budget` tokens: without the part between reason and remedy, else without its last paragraphs, else cut
    behind a character. None if not even that fits. Counting ends where the budget does; neither a line break nor the mark's first point ever
    joins the token before, so counts of parts add up."""
    text = text or ""
    if token_estimate(text, budget) <= budget:
        return text
    why, remedy = text.find("\n**Why**:"), text.find("\n**Prescribed Remedy**:")
    if why >= 0 and remedy >= 0 and token_estimate(shorter := text[:why] + text[remedy:], budget) <= budget:
        return shorter
    left = budget - CUT_TOKENS
    if left < 0:
        return None
    parts = text.split("\n\n")
    least = 2 if parts[0].startswith("---") and len(parts) > 2 else 1
    used, n = 0, 0
    while n < len(parts) - 1 and used <= left:
        used += token_estimate(parts[n], left) + 2  # with the line breaks behind it
        n += used <= left
    if n >= least:
        return "\n\n".join(parts[:n]) + "\n\n" + CUT
    return text[: head_of(text, left)] + CUT


def flat(value) -> str:
    """Text of a string, of blocks, or of blocks within blocks: text, content, output and input of each, line by line."""
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        value = [value]
    out = []
    for block in value if isinstance(value, list) else []:
        if isinstance(block, str):
            out.append(block)
        elif isinstance(block, dict):
            inner = flat(block.get("content"))
            out += [x for x in (block.get("text"),) if isinstance(x, str)] + ([inner] if inner else [])
            out += [x for x in (block.get("output"), block.get("input")) if isinstance(x, str)]
    return "\n".join(out)


@F.pandas_udf(StringType())
def flattened(s: pd.Series) -> pd.Series:
    return s.map(lambda x: flat(json.loads(x)) if x else "")


def members(value):
    """A JSON value without members that are null."""
    if isinstance(value, dict):
        return {k: members(v) for k, v in value.items() if v is not None}
    return [members(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(StringType())
def without_nulls(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else json.dumps(members(json.loads(x)), separators=(",", ":"), ensure_ascii=False))
