"""The shorthand in which the catalog's SQL is written, and its rendering for DuckDB. Names that start with @ stand for longer forms."""

from __future__ import annotations

import re
from dataclasses import dataclass

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

DUCK = {
    "FIND": lambda x: "regexp_extract(" + x + ")",
    "SPLIT": "regexp_split_to_array",
    "EXPLODE": "unnest",
    "LEN": "len",
    "DISTINCT": "list_distinct",
    "SHA": lambda x: f"sha256({x})",
    "EPOCH": lambda x: f"CAST(floor(epoch({x})) AS BIGINT)",
    "BYTES": lambda x: f"strlen({x})",
    "SUB": lambda x: f"regexp_replace({x}, 'g')",
    "HAS": lambda x: f"regexp_matches({x})",
    "KEEP": lambda x: "list_filter(" + re.sub(r", (\w+) => ", r", lambda \1: ", x) + ")",
    "MAP": lambda x: "list_transform(" + re.sub(r", (\w+) => ", r", lambda \1: ", x) + ")",
    "DOT": lambda x: "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))".format(*x.split(", ")),
    "RANGE": lambda x: "range({0}, CAST(({1}) AS BIGINT) + 1)".format(*x.split(", ")),
    "JOINED": lambda x: "array_to_string(" + x + ")",
    "SLICE": lambda x: "({0})[{1} : ({1}) + ({2}) - 1]".format(*x.split("; ")),
    "GET": lambda x: "{0}[{1}]".format(*x.split(", ")),
    "R": "",
}


def render(sql: str, names: dict) -> str:
    """Replaces @NAME and @NAME(arguments), innermost first. Numbers with a point become doubles."""
    sql = "'".join(x if i % 2 else re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", x) for i, x in enumerate(sql.split("'")))
    while found := list(re.finditer(r"@([A-Z]+)", sql)):
        m = found[-1]  # the last one has no other inside its arguments
        value = names[m[1]]
        if callable(value):
            depth, at = 1, m.end() + 1
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[at], 0)
                at += 1
            sql = sql[: m.start()] + value(sql[m.end() + 1 : at - 1]) + sql[at:]
        else:
            sql = sql[: m.start()] + value + sql[m.end() :]
    return sql


@dataclass(frozen=True)
class Plan:
    """rows: the survey rows it covers; sql: its text."""

    rows: str
    sql: str

    def duck(self) -> str:
        return render(self.sql, DUCK)
