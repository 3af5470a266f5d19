"""Tree search in rounds against one tree after the other."""

import math

from pyspark.sql import functions as F

from recollect.operators import trees
from recollect.plans.queries import QUERIES

SCORE = lambda tree, node: (tree * 31 + node * node * 17) % 101


def alone(tree, rounds, width):
    nodes = {0: [None, 50.0, 0]}
    for _ in range(rounds):
        at, path = 0, [0]
        while kids := sorted(n for n, (p, _, _) in nodes.items() if p == at):
            above = nodes[at][2]
            value = lambda n, above=above: math.inf if nodes[n][2] == 0 else nodes[n][1] / 100 + 1.414 * math.sqrt(math.log(max(above, 1)) / nodes[n][2])
            at = max(kids, key=lambda n: (value(n), -n))
            path.append(at)
        if nodes[at][2] > 0 or at == 0:
            for kid in range(at * width + 1, at * width + width + 1):
                nodes[kid] = [at, float(SCORE(tree, kid)), 0]
            path.append(at * width + 1)
        for n in path:
            nodes[n][2] += 1
    return nodes


def test_rounds_equal_a_sequential_run(spark):
    roots = spark.createDataFrame([(t,) for t in range(6)], "tree long")
    got = trees.searched(roots, 6, 3, lambda t, n: F.pmod(t * 31 + n * n * 17, F.lit(101))).collect()
    want = {(t, n): (p, s, v) for t in range(6) for n, (p, s, v) in alone(t, 6, 3).items()}
    assert {(r["tree"], r["node"]): (r["parent"], r["score"], r["visits"]) for r in got} == want and len(got) == len(want)


def test_query(spark):
    rows = QUERIES["tree_search"](spark, "/root/testdata/sf0.001").collect()
    assert all(r["visits"] == 5 for r in rows if r["node"] == 0) and len({r["tree"] for r in rows}) == sum(r["node"] == 0 for r in rows)
