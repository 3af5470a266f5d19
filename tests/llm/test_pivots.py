"""Hard negatives against brute force, and how much the pivot table leaves to be checked."""

import math
import random

import numpy as np
import pytest

from recollect.llm import pivots

ROWS = "vec_id long, label int, embedding array<double>, gid long, home string"


def brute(rows, every=50, positives=5, negatives=3):
    kept = []
    for vec_id, label, v, *_ in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((vec_id, math.fmod(label + 1, 10) if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for i, (a, label, q) in enumerate(kept):
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, w)), b, of) for j, (b, of, w) in enumerate(kept) if j != i)  # noqa: B905
        for ps, p, _ in [s for s in scored if s[2] == label][:positives]:
            few = [(-s, b) for s, b, of in scored if of != label and -50 * ps <= -100 * s <= -95 * ps][:negatives]
            out += [(a, p, k + 1, b, -ps, s) for k, (s, b) in enumerate(few)]
    return sorted(out)


def fixture(kind):
    rng = random.Random(kind)
    vec = lambda n=6: [rng.gauss(0, 0.4) for _ in range(n)]
    rows = [(i, rng.randrange(4), vec(), 0, "h") for i in range(700)]
    if kind == "copies":  # a third are one vector, many scores are equal
        rows = [(i, label, [0.5, -0.25, 0.75] if i % 3 == 0 else [round(x) / 4 for x in v[:3]], g, h) for i, label, v, g, h in rows]
    if kind == "odd":
        rows = [r for r in rows if r[0] % 11] + [rows[50], rows[50], rows[100], (150, 1, [], 0, ""), (200, 2, vec(9), 0, ""), (250, None, vec(), 0, ""), (300, 1, None, 0, ""), (None, 1, vec(), 0, ""), (350, 1, [0.1, None], 0, ""), (400, 1, [float("nan")] * 6, 0, ""), (450, 1, [float("inf")] * 6, None, None), (-50, 3, vec(), 0, ""), (-49, 9, vec(), 0, ""), (800, 17, vec(), 0, ""), (801, 17, vec(2), 0, "")]
    if kind == "large":
        rows = [(i, label, [x * 3e4 for x in v], g, h) for i, label, v, g, h in rows[:260]]
    return rows


@pytest.mark.parametrize("kind", ["plain", "copies", "odd", "large"])
def test_equals_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK_BYTES", 300)
    monkeypatch.setattr(pivots, "ANCHORS", 3)
    rows = fixture(kind)
    got = sorted(map(tuple, pivots.mined(spark, spark.createDataFrame(rows, ROWS).repartition(3)).collect()))
    assert got == brute(rows) and got


def test_whole_numbers_that_a_double_cannot_hold():
    rng = np.random.default_rng(1)
    a, b = np.floor(rng.normal(0, 1e8, (5, 4))), np.floor(rng.normal(0, 1e8, (7, 4)))
    want = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b.tolist()] for u in a.tolist()]
    assert pivots.products(a, b, False).tolist() == want


def test_the_table_prunes_clustered_rows():
    """Tight clusters: few rows outside an anchor's own are checked, and none is lost."""
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (12, 32))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = np.floor(256 * (np.repeat(centres, 200, axis=0) + rng.normal(0, 0.02, (2400, 32))))
    space = pivots.Space(32, float(abs(x).max()), float((x * x).sum(axis=1).max()))
    space.choose(x[rng.permutation(len(x))[:500]], 16)
    d = space.distances(space.augmented(x), np.full(len(x), space.m2))
    cell = d.argmin(axis=1)
    order = np.lexsort((d[np.arange(len(x)), cell], cell))
    group, tags = pivots.Group(space), np.arange(len(x))
    for c in range(d.shape[1]):
        of = order[cell[order] == c]
        for at in range(0, len(of), 64):
            part = of[at : at + 64]
            group.add(pivots.pack(0, 0, 0, c, space, x[part], tags[part].tolist(), tags[part]))
    anchors = rng.permutation(len(x))[:40]
    for one in anchors:
        b = pivots.pack(1, 0, 0, -1, space, x[[one]], [int(one)], tags[[one]])
        best = group.search(b, np.full((1, 1), pivots.LOWEST), np.full((1, 1), pivots.HIGHEST), 5)
        score = x @ x[one]
        score[one] = -np.inf
        want = sorted(zip(-score, tags, strict=True))[:5]
        assert best.pool[1].tolist() == [-s for s, _ in want] and best.pool[2].tolist() == [t for _, t in want]
    assert group.checked < 0.25 * group.pairs


def test_empty(spark):
    assert pivots.mined(spark, spark.createDataFrame([], ROWS)).collect() == []
