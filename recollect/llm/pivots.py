"""Hard negatives by a pivot table.

Components are whole numbers, and a score is an inner product. A vector x is augmented by one coordinate to the length M of the longest
vector, and an anchor q by a zero, so that |q' - x'|**2 = |q|**2 + M**2 - 2 q.x: a greater score is a smaller distance. The table stores each row's
distances to some pivots: by the triangle inequality |d(q', p) - d(x', p)| <= d(q', x') <= d(q', p) + d(x', p), which brackets the score
without the vectors.

Rows are sorted by label, nearest pivot and distance to it, and cut into blocks of that order, each with the least and greatest distance to every
pivot; runs of blocks of one label are groups. Anchors are packed likewise and go, block by block, through each group that can hold partners. A block
of rows whose bracket lies outside what an anchor still looks for is skipped; of any other, the rows in the range that the bracket leaves are
found by binary search in their stored distances, and those survivors are checked exactly. The positives are found first, in the groups of the
anchor's label; their scores are the windows for the negatives, in the other groups. Each group gives its best few, merged by rank.

Spark sends blocks of anchors to groups of rows; a task holds one group, whose size is a parameter, and streams the anchors through it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.llm import common

PIVOTS, SAMPLE, GROUP_ROWS, BLOCK_BYTES, ANCHORS = 16, 1024, 1 << 17, 32 << 10, 128
POSITIVES, NEGATIVES = 5, 3
ROWS = "vec_id long, label long, data binary, width int, top double, norm double"
KEYED = "vec_id long, label long, data binary, cell int, dist double"
BLOCKS = "kind int, gid long, label long, home long, cell int, n int, ids binary, tags binary, data binary, dists binary, norms binary, low array<double>, high array<double>"
FOUND = "home long, i int, k int, anchor_id long, score long, vec_id long"
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def whole_numbers(rows: DataFrame) -> DataFrame:
    """vec_id, label (of every seventh id the next one), data (floor(256 x) as doubles), and width, greatest component, squared length. Rows with a null id, label,
    vector or component, or one that isn't finite, are left out."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                vectors = part.column(2)
                width = np.diff(vectors.offsets.to_numpy())
                flat = vectors.flatten()
                x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
                ends = np.concatenate(([0], np.cumsum(width)))
                bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
                x = np.floor(256 * x)
                ids, labels, out = part.column(0).to_pylist(), part.column(1).to_pylist(), []
                for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                    if bad[b] == bad[a]:
                        v = x[a:b]
                        out.append((ids[i], labels[i], v.tobytes(), b - a, float(np.abs(v).max(initial=0)), float(v @ v)))
                types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.float64(), pa.float64()]
                cols = list(zip(*out, strict=True)) or [()] * 6
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["vec_id", "label", "data", "width", "top", "norm"])

    given = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    return given.dropna().select("vec_id", label, "embedding").mapInArrow(run, ROWS)


class Space:
    """Pivots and the scale of the augmented vectors."""

    def __init__(self, width: int, top: float, norm: float):
        self.width, self.m2 = width, norm
        self.type = np.dtype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8")
        self.exact = norm < 1 << 53  # so every sum of products is a whole number that a double can hold
        self.slack = 1e-9 * norm + 1e-6
        self.pivots = np.zeros((0, width + 1))

    def matrix(self, data: list[bytes]) -> np.ndarray:
        out = np.zeros((len(data), self.width))
        for i, d in enumerate(data):
            out[i, : len(d) >> 3] = np.frombuffer(d, "<f8")
        return out

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack((x, np.sqrt(np.maximum(0.0, self.m2 - (x * x).sum(axis=1)))))

    def distances(self, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """To all pivots, of augmented vectors with these squared lengths."""
        return np.sqrt(np.maximum(0.0, norms[:, None] + (self.pivots * self.pivots).sum(axis=1) - 2 * x @ self.pivots.T))

    def choose(self, sample: np.ndarray, n: int) -> None:
        """Each next pivot is the row of the sample farthest from those before."""
        x = self.augmented(sample)
        far = np.full(len(x), np.inf)
        chosen = []
        for _ in range(min(n, len(x))):
            k = int(np.argmax(far)) if chosen else 0
            if far[k] <= 0:
                break
            chosen.append(k)
            far = np.minimum(far, ((x - x[k]) ** 2).sum(axis=1))
            far[k] = 0
        self.pivots = x[chosen]


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as whole numbers; an error where one isn't a 64-bit number."""
    if exact:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    whole = np.array([[int(v) for v in row] for row in a.tolist()], object), np.array([[int(v) for v in row] for row in b.tolist()], object)
    return np.array((whole[0].reshape(a.shape) @ whole[1].reshape(b.shape).T).tolist(), np.int64).reshape(len(a), len(b))


def pack(kind: int, gid: int, label: int, cell: int, space: Space, x: np.ndarray, ids: list[int], tags: np.ndarray) -> dict:
    """A block of rows (kind 0) or anchors (kind 1), with their distances: rows keep that to their own pivot, anchors those to all."""
    norms = (x * x).sum(axis=1)
    d = space.distances(np.column_stack((x, np.zeros(len(x)))) if kind else space.augmented(x), norms if kind else np.full(len(x), space.m2))
    own = d if kind else d[:, cell]
    return {"kind": kind, "gid": gid, "label": label, "home": int(tags[0]), "cell": cell, "n": len(ids), "ids": np.array(ids, "<i8").tobytes(), "tags": tags.astype("<i8").tobytes(), "data": x.astype(space.type).tobytes(), "dists": own.astype("<f8").tobytes(), "norms": norms.astype("<f8").tobytes(), "low": d.min(axis=0).tolist(), "high": d.max(axis=0).tolist()}


def blocks_of(space: Space, group_rows: int, every: int):
    """Function for mapInArrow: rows in order of label, cell and distance -> blocks, numbered by group."""
    size = max(1, BLOCK_BYTES // (space.width * space.type.itemsize or 1))
    schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}[t]) for n, t in (c.split() for c in BLOCKS.split(", "))])

    def run(batches):
        from pyspark import TaskContext

        gid = (TaskContext.get().partitionId() << 24) - 1
        key = label = None
        in_group, held, anchors = group_rows, [], []

        def tags(of):
            return np.array([gid * group_rows + t for t, _, _ in of])

        def rows_out():
            made = pack(0, gid, key[0], key[1], space, space.matrix([d for _, _, d in held]), [i for _, i, _ in held], tags(held))
            held.clear()
            return made

        def anchors_out():
            made = pack(1, gid, label, -1, space, space.matrix([d for _, _, d in anchors]), [i for _, i, _ in anchors], tags(anchors))
            anchors.clear()
            return made

        for batch in batches:
            out = []
            for vec_id, of, data, cell in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                new_group = of != label or in_group == group_rows
                if held and (new_group or (of, cell) != key or len(held) == size):
                    out.append(rows_out())
                if anchors and (new_group or len(anchors) == ANCHORS):
                    out.append(anchors_out())
                if new_group:
                    gid, label, in_group = gid + 1, of, 0
                key = (of, cell)
                held.append((in_group, vec_id, data))
                if vec_id % every == 0:
                    anchors.append((in_group, vec_id, data))
                in_group += 1
            yield pa.RecordBatch.from_pylist(out, schema)
        out = ([rows_out()] if held else []) + ([anchors_out()] if anchors else [])
        yield pa.RecordBatch.from_pylist(out, schema)

    return run


class Best:
    """The best few of each (anchor, window): scores from the greatest, equal ones by id."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, keep: int):
        self.lo, self.hi, self.keep = lo.copy(), hi, keep  # lo rises to the last score kept
        self.pool = (np.empty(0, np.int64),) * 3

    def offer(self, k: int, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates within the window of their slot, anchor * windows + k."""
        slot, score, ids = (np.concatenate(x) for x in zip(self.pool, (slot, score, ids), strict=True))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        few = place < self.keep
        self.pool = slot[few], score[few], ids[few]
        last = place == self.keep - 1
        self.lo.reshape(-1)[slot[last]] = score[last]


class Group:
    """One group of rows, in blocks."""

    def __init__(self, space: Space):
        self.space, self.blocks, self.checked, self.pairs = space, [], 0, 0

    def add(self, b: dict) -> None:
        x = np.frombuffer(b["data"], self.space.type).reshape(b["n"], self.space.width)
        self.blocks.append((x, np.frombuffer(b["ids"], "<i8"), np.frombuffer(b["tags"], "<i8"), np.frombuffer(b["dists"], "<f8"), b["cell"], np.array(b["low"]), np.array(b["high"])))

    def search(self, b: dict, lo: np.ndarray, hi: np.ndarray, keep: int) -> Best:
        """Partners of a block of anchors; lo, hi: anchors by windows. A row is no partner of itself."""
        space = self.space
        q = np.frombuffer(b["data"], space.type).reshape(b["n"], space.width)
        tags, norms, d = np.frombuffer(b["tags"], "<i8"), np.frombuffer(b["norms"], "<f8"), np.frombuffer(b["dists"], "<f8").reshape(b["n"], -1)
        best, reach = Best(lo, hi, keep), norms + space.m2
        low, high = np.array([x[5] for x in self.blocks]), np.array([x[6] for x in self.blocks])
        if d.shape[1]:
            near = np.maximum(0.0, np.maximum(low[:, None, :] - d, d - high[:, None, :]).max(axis=2))
            upper, lower = (reach - near**2) / 2 + space.slack, (reach - (d + high[:, None, :]).min(axis=2) ** 2) / 2 - space.slack
        else:
            upper, lower = np.full((len(low), len(q)), np.inf), np.full((len(low), len(q)), -np.inf)
        ceiling = np.where(lo <= hi, hi, LOWEST).max(axis=1)
        for at in np.argsort(-upper.max(axis=1), kind="stable").tolist():
            x, ids, row_tags, dist, cell, _, _ = self.blocks[at]
            floor = np.where(best.lo <= hi, best.lo, HIGHEST).min(axis=1)
            live = np.flatnonzero((upper[at] >= floor) & (lower[at] <= ceiling))
            self.pairs += len(q) * len(ids)
            if not len(live):
                continue
            a, z = 0, len(ids)
            if d.shape[1]:
                radius = np.sqrt(np.maximum(0.0, reach[live] - 2 * np.maximum(floor[live].astype(np.float64), -reach[live]) + 2 * space.slack)) * (1 + 1e-9)
                a, z = np.searchsorted(dist, (d[live, cell] - radius).min(), "left"), np.searchsorted(dist, (d[live, cell] + radius).max(), "right")
            if a >= z:
                continue
            self.checked += len(live) * int(z - a)
            score = products(q[live], x[a:z], space.exact)
            i, j = np.nonzero((score >= floor[live][:, None]) & (score <= ceiling[live][:, None]))
            s, other = score[i, j], row_tags[a:z][j] != tags[live][i]
            i, j, s = live[i[other]], j[other] + a, s[other]
            for k in range(lo.shape[1]):
                fits = (s >= best.lo[i, k]) & (s <= hi[i, k])
                if fits.any():
                    best.offer(k, i[fits] * lo.shape[1] + k, s[fits], ids[j[fits]])
        return best


def through_groups(blocks: DataFrame, asked: DataFrame, space: Space, keep: int) -> DataFrame:
    """Streams blocks of anchors (`asked`: columns of blocks, the target as `gid`, and their windows `marks`) through the groups of rows."""

    def run(batches):
        group, gid = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                b = batch.slice(k, 1).to_pylist()[0]
                if b["gid"] != gid:
                    group, gid = Group(space), b["gid"]
                if b["kind"] == 0:
                    group.add(b)
                    continue
                if b["marks"] is None:
                    lo, hi = np.full((b["n"], 1), LOWEST), np.full((b["n"], 1), HIGHEST)
                else:
                    n = max(m["k"] for m in b["marks"]) + 1
                    lo, hi = np.full((b["n"], n), HIGHEST), np.full((b["n"], n), LOWEST)
                    for m in b["marks"]:
                        lo[m["i"], m["k"]], hi[m["i"], m["k"]] = -(-m["score"] // 2), 95 * m["score"] // 100
                slot, score, ids = group.search(b, lo, hi, keep).pool
                i, window = np.divmod(slot, lo.shape[1])
                anchor = np.frombuffer(b["ids"], "<i8")[i]
                yield pa.record_batch([pa.array(np.full(len(slot), b["home"])), pa.array(i.astype(np.int32)), pa.array(window.astype(np.int32)), *map(pa.array, (anchor, score, ids))], names=["home", "i", "k", "anchor_id", "score", "vec_id"])

    rows = blocks.where("kind = 0").withColumn("marks", F.lit(None).cast("array<struct<i:int,k:int,score:bigint>>"))
    both = rows.unionByName(asked.select(rows.columns))
    return both.repartition("gid").sortWithinPartitions("gid", "kind").mapInArrow(run, FOUND)


def mined(spark: SparkSession, rows: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null vec_id, label, vector or component, or one that isn't finite, take no part; others may have any width, and a missing component
    counts as 0. Rows that share a vec_id are rows of their own: a row is no partner of itself, but may be of its twin. An anchor without
    positives, or a positive without negatives, gives no row; so does an empty table. Scores beyond 64 bits are an error. Other columns aren't read."""
    clean = common.staged(spark, whole_numbers(rows), "whole-numbers")
    sizes = clean.agg(F.count("*").alias("n"), F.max("width").alias("width"), F.max("top").alias("top"), F.max("norm").alias("norm")).first()
    space = Space(sizes["width"] or 0, sizes["top"] or 0.0, sizes["norm"] or 0.0)
    sample = clean.orderBy(F.xxhash64("data"), "vec_id").select("data").limit(SAMPLE).collect()  # SAMPLE rows, for the pivots alone
    space.choose(space.matrix([bytes(r["data"]) for r in sample]), PIVOTS)
    group_rows = max(1024, min(group_rows, sizes["n"] >> 6))  # small tables are spread over tasks

    def keyed(batches):
        for batch in batches:
            x = space.matrix(batch.column(2).to_pylist())
            d = space.distances(space.augmented(x), np.full(len(x), space.m2))
            cell = d.argmin(axis=1) if d.shape[1] else np.zeros(len(x), np.int64)
            dist = d[np.arange(len(x)), cell] if d.shape[1] else np.zeros(len(x))
            yield pa.record_batch([*batch.columns[:3], pa.array(cell.astype(np.int32)), pa.array(dist)], names=["vec_id", "label", "data", "cell", "dist"])

    order = ["label", "cell", "dist", "vec_id"]
    dealt = clean.select("vec_id", "label", "data").mapInArrow(keyed, KEYED).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = common.staged(spark, dealt.mapInArrow(blocks_of(space, group_rows, every), BLOCKS), "blocks")
    common.drop_staged(spark, clean)
    groups = common.staged(spark, blocks.where("kind = 0").select("gid", F.col("label").alias("of")).distinct(), "groups")  # a row a group of rows
    n_groups = groups.count()
    anchors = blocks.where("kind = 1").drop("gid")
    marks = F.lit(None).cast("array<struct<i:int,k:int,score:bigint>>")
    own = common.beside(anchors, groups, F.col("label") == F.col("of"), n_groups).withColumn("marks", marks)
    rank = F.row_number().over(Window.partitionBy("home", "i").orderBy(F.desc("score"), "vec_id"))
    best = through_groups(blocks, own, space, positives).withColumn("k", rank - 1).where(F.col("k") < positives)
    best = common.staged(spark, best, "positives")
    windows = best.groupBy("home").agg(F.collect_list(F.struct("i", "k", "score")).alias("marks"))  # ANCHORS * positives at most
    others = common.beside(anchors.join(windows, "home"), groups, F.col("label") != F.col("of"), n_groups)
    rank = F.row_number().over(Window.partitionBy("home", "i", "k").orderBy(F.desc("score"), "vec_id"))
    below = through_groups(blocks, others, space, negatives).withColumn("rank", rank).where(F.col("rank") <= negatives)
    below = below.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    named = best.withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"}).drop("anchor_id")
    out = named.join(below, ["home", "i", "k"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def oracle(every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES) -> str:
    return f"""WITH v AS (SELECT row_number() OVER () AS tag, vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.tag, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.e, b.e), lambda z: coalesce(z[1] * z[2], 0))), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.tag <> b.tag WHERE a.vec_id % {every} = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY score DESC, vec_id) AS k FROM s WHERE same QUALIFY k <= {positives}),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.tag, p.k ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.tag = p.tag AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {negatives}"""
