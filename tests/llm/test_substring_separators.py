import random

import pytest
from test_substring import DOCS, WORD, brute

from recollect.llm import substring


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_with_all_separators(spark, seed):
    rng = random.Random(seed)
    passages = [[f"p{i}q{rng.randrange(99)}" for i in range(n)] for n in (13, 20, 90)]
    page = " ".join(passages[2])
    rows = [(1, page, 0, ""), (2, page.replace(" ", "\x0c", 1), 0, ""), (3, "a " + page.replace(" p50", "\x0bp50"), 0, "")]
    for i in range(4, 60):
        w = [x for _ in range(3) for x in (rng.choice(passages) if rng.random() < 0.5 else [f"w{rng.randrange(400)}" for _ in range(rng.randint(1, 20))])]
        rows.append((i, "".join(x + rng.choice([" "] * 30 + ["\x0b", "\x0c", "\n", "\t", "\r"]) for x in w), i, "x"))
    want = brute(rows)
    assert all(len(WORD.findall(rows[i][1])) >= 90 and int(next(x[2] for x in want if x[0] == str(i + 1))) >= 90 for i in (1, 2))
    got = substring.dedup(spark, spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
