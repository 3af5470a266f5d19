"""Places and running sums within groups that many tasks share."""

import random

from recollect.operators import ranks


def test_places_and_sums(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(60), i, rng.choice([None, 1, 5])) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, o int, i int, v int").repartition(7)
    got = {r["i"]: (r["k"], r["n_group"], r["upto"]) for r in ranks.within(df, ["g"], "o", "i", total="v").collect()}
    want = {}
    for g in ("a", "b", None):
        own, total = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 0
        for k, (_, _, i, v) in enumerate(own, 1):
            total += v or 0
            want[i] = (k, len(own), total)
    assert got == want
    assert {(r["i"], r["k"]) for r in ranks.within(df, ["g"], "o", "i").collect()} == {(i, k) for i, (k, _, _) in want.items()}
    assert ranks.within(df.limit(0), ["g"], "o").collect() == []
