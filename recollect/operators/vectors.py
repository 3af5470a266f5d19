"""Exact nearest neighbours in blocks: no table of pairs, and neither side has to fit into a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.sources import staging

BLOCKS = "scope string, ids array<bigint>, width int, data binary"


def blocks(rows: DataFrame, size: int = 1024) -> DataFrame:
    """Rows (id, embedding, perhaps scope) packed into blocks of some rows of one scope and width: ids and their matrix in doubles. Null
    vectors are left out."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                vectors = part.column(1)
                n = np.diff(vectors.offsets.to_numpy())
                ids, flat = part.column(0).to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False).astype("<f8")
                begin, scopes = np.cumsum(n) - n, part.column(2).to_pylist()
                groups: dict[tuple, list[int]] = {}
                for i, key in enumerate(zip(scopes, n.tolist(), strict=True)):
                    groups.setdefault(key, []).append(i)
                for (scope, width), of in groups.items():
                    data = flat[(begin[of][:, None] + np.arange(width)).ravel()].tobytes()
                    yield pa.record_batch([pa.array([scope], pa.string()), pa.array([ids[of]], pa.list_(pa.int64())), pa.array([width], pa.int32()), pa.array([data], pa.binary())], names=["scope", "ids", "width", "data"])

    scope = F.col("scope").cast("string") if "scope" in rows.columns else F.lit("")
    return rows.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), scope.alias("scope")).where("embedding IS NOT NULL AND id IS NOT NULL").mapInArrow(run, BLOCKS)


def unit(embedding):
    """A vector of length 1; null for a vector without one."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.zip_with(wide, F.array_repeat(length, F.size(wide)), lambda x, y: x / y))  # the length is taken once


def best(sims: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest, rounded to 9 places, equal ones by id; without the query itself."""
    other = ids != own
    sims, ids = np.round(sims[other], 9), ids[other]
    if len(sims) > k:
        few = sims >= np.partition(sims, len(sims) - k)[len(sims) - k]
        sims, ids = sims[few], ids[few]
    order = np.lexsort((ids, -sims))[:k]
    return ids[order], sims[order]


def top_k(rows: DataFrame, queries: DataFrame, k: int, part_blocks: int = 128) -> DataFrame:
    """(query_id, id, sim, rank): the k rows with the greatest dot product with each query, other than itself. Both: id, embedding."""
    near = matched(rows, queries, lambda sims, ids, own: best(sims, ids, own, k), part_blocks)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


class Cells:
    """Cells around some pivots, and what the triangle inequality says of them. A row x is taken as (x, sqrt(M**2 - |x|**2)), with M the greatest length, and
    a query as (q, 0), so a dot product of `least` or more is a distance of `reach` at most."""

    def __init__(self, sample: np.ndarray, longest: float, most: int):
        self.m2, self.sample = longest, sample
        x = self.rows(sample)
        far, chosen = np.full(len(x), np.inf), []
        while len(chosen) < min(most, len(x)) and (not chosen or far.max() > 1e-9):
            chosen.append(int(np.argmax(far)))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        self.pivots = x[chosen]

    def rows(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack((x, np.sqrt(np.maximum(0.0, self.m2 - (x * x).sum(axis=1)))))

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1) - 2 * x @ self.pivots.T))

    def wide(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.pivots.shape[1] - 1 - x.shape[1])))

    def reach(self, q: np.ndarray, least: float) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (q * q).sum(axis=1) + self.m2 - 2 * least)) + 1e-6

    def share(self, least: float) -> float:
        """The part of the sample's products that the cells leave."""
        own = self.distances(self.rows(self.sample)).argmin(axis=1)
        d, r = self.distances(np.column_stack((self.sample, np.zeros(len(self.sample))))), self.reach(self.sample, least)
        near = d <= (d.min(axis=1) + 2 * r)[:, None]
        return float((near * np.bincount(own, minlength=len(self.pivots))).sum() / max(1, len(own)) ** 2)

    def one(self) -> Cells:
        """A single cell: where the others rule out little, each only adds a copy of the queries."""
        return Cells(self.sample, self.m2, 1)


def matrices(batch: pa.RecordBatch, column: int):
    """(places, matrix) for each width in a list column."""
    vectors = batch.column(column)
    offsets = vectors.offsets.to_numpy()
    n, flat = np.diff(offsets), vectors.values.to_numpy(zero_copy_only=False).astype("<f8")
    for width in np.unique(n).tolist():
        of = np.flatnonzero(n == width)
        yield of, flat[(offsets[of][:, None] + np.arange(width)).ravel()].reshape(len(of), width)


UNIT = "unit long, scope string, width int, cell int, low double, high double, n long"


def sided(rows: DataFrame) -> DataFrame:
    """Typed rows with `apart`, null where they have none."""
    return rows.select("id", "embedding", "scope", F.col("apart") if "apart" in rows.columns else F.lit(None).cast("long").alias("apart"))


def binaries(x: np.ndarray) -> pa.Array:
    """A row of the matrix each, without a Python object a row."""
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1] * 8)), pa.py_buffer(np.ascontiguousarray(x))])


def placed(rows: DataFrame, cells: Cells, unit_rows: int) -> tuple[DataFrame, DataFrame]:
    """(stored rows: unit, id, width, apart, data; units: scope, width, cell and the least and greatest distance to the pivot). A unit is a run of at most
    `unit_rows` rows of a cell by distance, and of UNIT_VALUES numbers, so a cell that many rows share is many units."""

    def keyed(batches):
        for batch in batches:
            for of, x in matrices(batch, 1):
                d = cells.distances(cells.rows(cells.wide(x)))
                cell = d.argmin(axis=1)
                take = pa.array(of)
                yield pa.record_batch([batch.column(0).take(take), batch.column(2).take(take), batch.column(3).take(take), pa.array(np.full(len(of), x.shape[1], np.int32)), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(of)), cell]), binaries(x)], names=["id", "scope", "apart", "width", "cell", "dist", "data"])

    def united(batches):
        from pyspark import TaskContext

        unit, key, inside = (TaskContext.get().partitionId() << 32) - 1, None, 0
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("scope", "width", "cell")), strict=True))
            out = np.empty(len(keys), np.int64)
            for i, k in enumerate(keys):
                if k != key or inside == max(1, min(unit_rows, UNIT_VALUES // max(1, k[1]))):
                    unit, key, inside = unit + 1, k, 0
                out[i] = unit
                inside += 1
            yield pa.record_batch([pa.array(out), *(batch.column(c) for c in ("scope", "width", "cell", "dist", "id", "apart", "data"))], names=["unit", "scope", "width", "cell", "dist", "id", "apart", "data"])

    order = ["scope", "width", "cell", "dist", "id"]
    sorted_rows = sided(rows).mapInArrow(keyed, "id long, scope string, apart long, width int, cell int, dist double, data binary").repartitionByRange(*order).sortWithinPartitions(*order)
    held = staging.staged(sorted_rows.mapInArrow(united, "unit long, scope string, width int, cell int, dist double, id long, apart long, data binary"), "units")
    units = held.groupBy("unit", "scope", "width", "cell").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.count("*").alias("n"))
    return held.select("unit", "id", "width", "apart", "data"), staging.staged(units.select(*(c.split()[0] for c in UNIT.split(", "))), "units")


def visits(queries: DataFrame, units: DataFrame, cells: Cells, least: float) -> DataFrame:
    """(unit, id, width, apart, data): the units in which a query can have a partner."""

    def aimed(batches):
        for batch in batches:
            for every, matrix in matrices(batch, 1):
                step = max(1, UNIT_VALUES // 4 // (matrix.shape[1] + 1) // len(cells.pivots))  # what leaves at once is bounded, however many cells a query visits
                for at in range(0, len(every), step):
                    of, x = every[at : at + step], matrix[at : at + step]
                    wide = cells.wide(x)
                    d, r = cells.distances(np.column_stack((wide, np.zeros(len(wide))))), cells.reach(wide, least)
                    i, c = np.nonzero(d <= (d.min(axis=1) + 2 * r)[:, None])  # a row of a farther cell would be nearer to another pivot
                    take = pa.array(of[i])
                    yield pa.record_batch([*(batch.column(k).take(take) for k in (0, 2, 3)), pa.array(np.full(len(i), x.shape[1], np.int32)), pa.array(c.astype(np.int32)), pa.array(d[i, c] - r[i]), pa.array(d[i, c] + r[i]), binaries(x[i])], names=["id", "scope", "apart", "width", "cell", "from", "to", "data"])

    asked = sided(queries).mapInArrow(aimed, "id long, scope string, apart long, width int, cell int, from double, to double, data binary").alias("q")
    u = (F.broadcast(units) if units.count() <= 1 << 16 else units).alias("u")
    same = [F.col(f"q.{c}") == F.col(f"u.{c}") for c in ("scope", "width", "cell")]
    met = asked.join(u, same[0] & same[1] & same[2] & (F.col("q.from") <= F.col("u.high")) & (F.col("q.to") >= F.col("u.low")))
    return met.select("u.unit", "q.id", "q.width", "q.apart", "q.data")


PIVOTS, SAMPLE, UNIT_ROWS = 128, 2048, 1 << 16
UNIT_VALUES = 1 << 22  # 32 MB of doubles


def celled(rows: DataFrame, pivots: int = PIVOTS) -> Cells:
    """Pivots from SAMPLE rows by a hash of the id, each as far as can be from those before."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    ends = rows.agg(F.max(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x)).alias("m"), F.max(F.size("embedding")).alias("w")).first()
    sample = [r["embedding"] for r in rows.orderBy(F.xxhash64("id"), "id").select("embedding").limit(SAMPLE).collect()]
    matrix = np.zeros((len(sample), ends["w"] or 0))
    for k, v in enumerate(sample):
        matrix[k, : len(v)] = v
    return Cells(matrix, ends["m"] or 0.0, pivots)


def typed(rows: DataFrame) -> DataFrame:
    scope = F.coalesce(F.col("scope").cast("string"), F.lit("")) if "scope" in rows.columns else F.lit("")
    apart = [F.col("apart").cast("long").alias("apart")] if "apart" in rows.columns else []
    return rows.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), scope.alias("scope"), *apart).where("embedding IS NOT NULL AND id IS NOT NULL")


def runs(batches):
    """(unit, kind, ids, apart, matrix) of each run of equal unit, slice and kind in a batch; all rows of a unit have one width."""
    for batch in batches:
        n, data = batch.num_rows, batch.column("data")
        if not n:
            continue
        unit, part, kind, ids, width, apart = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "slice", "kind", "id", "width", "apart"))
        offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + n + 1]
        flat = data.buffers()[2]
        cuts = np.flatnonzero((np.diff(unit) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
            matrix = np.zeros((b - a, 0)) if width[a] == 0 else np.frombuffer(flat, np.uint8)[offsets[a] : offsets[b]].view("<f8").reshape(b - a, int(width[a]))
            yield (int(unit[a]), int(part[a])), int(kind[a]), ids[a:b].copy(), apart[a:b].copy(), matrix.copy()


def within(rows: DataFrame, queries: DataFrame, least: float, strict: bool = False, unit_rows: int = UNIT_ROWS, first: bool = False) -> DataFrame:
    """(query_id, id, sim): all rows whose dot product with a query is at least (`strict`: over) `least`, other than the query itself; of the same
    scope, where there are scopes, and of another `apart` (a number; rows without it have no partner), where both have it. `first`: of each query only the one with the least id. Exact: units
    of rows are left out only where the triangle inequality rules a partner out, so on vectors without any clusters all units are visited, and on clustered
    ones few. A task holds a unit and streams a slice of its queries; a table of 256 queries by 4096 rows is made at once."""
    differ = "apart" in rows.columns and "apart" in queries.columns
    rows, queries = typed(rows), typed(queries)
    if differ:
        rows, queries = rows.where("apart IS NOT NULL"), queries.where("apart IS NOT NULL")
    cells = celled(rows)
    if not len(cells.pivots):
        return rows.sparkSession.createDataFrame([], "query_id long, id long, sim double")
    if cells.share(least) > 0.3:
        cells = cells.one()
    held, units = placed(rows, cells, unit_rows)
    asked = visits(queries, units, cells, least)
    size = units.agg(F.count("*").alias("units"), F.sum("n").alias("rows"), F.count_distinct("scope").alias("scopes")).first()
    # a task for every 4e9 products or fewer; where units are few, their queries are dealt over slices
    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-size["rows"] * queries.count() // max(1, size["scopes"]) // 4_000_000_000))
    slices = max(1, min(16, -(-tasks // max(1, size["units"]))))

    def hits(ids, apart, x, own, other, q):
        sims = q @ x.T
        i, j = np.nonzero(sims >= least - 1e-8)
        sims = np.round(sims[i, j], 9)
        good = ((sims > least) if strict else (sims >= least)) & (own[i] != ids[j])
        if differ:
            good &= other[i] != apart[j]
        return i[good], j[good], sims[good]

    def run(batches):
        key, parts = None, []
        for at, kind, ids, apart, matrix in runs(batches):
            if at != key:
                key, parts = at, []
            if kind == 0:  # rows come before the queries, by id
                parts.append((ids, apart, matrix))
                continue
            if len(parts) > 1:
                parts = [tuple(np.concatenate(p) for p in zip(*parts, strict=True))]
            if not parts:
                continue
            every, sides, x = parts[0]
            for begin in range(0, len(ids), 256):
                own, other, q = ids[begin : begin + 256], apart[begin : begin + 256], matrix[begin : begin + 256]
                for low in range(0, len(every), 4096):
                    i, j, sims = hits(every[low : low + 4096], sides[low : low + 4096], x[low : low + 4096], own, other, q)
                    if first and len(i):  # rows go by id, so a query that has met one is done
                        i, k = np.unique(i, return_index=True)
                        j, sims = j[k], sims[k]
                    if len(i):
                        yield pa.record_batch([pa.array(own[i]), pa.array(every[low + j]), pa.array(sims)], names=["query_id", "id", "sim"])
                    if first and len(i):
                        left = np.ones(len(own), bool)
                        left[i] = False
                        own, other, q = own[left], other[left], q[left]
                        if not len(own):
                            break

    every = F.explode(F.array(*(F.lit(k) for k in range(slices))))
    columns = ("id", "width", "apart", "data")
    dealt = held.select("unit", every.alias("slice"), F.lit(0).alias("kind"), *columns).unionByName(asked.select("unit", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("kind"), *columns))
    tasks = int(max(1, min(tasks, size["units"] * slices)))
    dealt = dealt.withColumn("apart", F.coalesce("apart", F.lit(0))).repartition(tasks, "unit", "slice").sortWithinPartitions("unit", "slice", "kind", "id")
    found = dealt.mapInArrow(run, "query_id long, id long, sim double")
    if not first:
        return found
    least_id = F.min_by(F.struct("id", "sim"), "id").alias("o")
    return found.groupBy("query_id").agg(least_id).select("query_id", "o.id", "o.sim")


def matched(rows: DataFrame, queries: DataFrame, choose, part_blocks: int) -> DataFrame:
    """(query_id, id, sim) as `choose` takes them from a part's products with a query of the same scope (if there are scopes). Rows are
    dealt into parts of some blocks; the queries pass every part block by block."""
    base = blocks(rows)
    parts = max(1, -(-rows.count() // (part_blocks * 1024)))
    dealt = base.select(F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), "scope", "ids", "width", "data")
    asked = blocks(queries).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "scope", "ids", "width", "data")

    def run(batches):
        part, held = None, []
        for batch in batches:
            for p, kind, scope, ids, width, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if p != part:
                    part, held = p, []
                matrix = np.frombuffer(data, "<f8").reshape(-1, width)
                if kind == 0:
                    held.append(((scope, width), np.array(ids, np.int64), matrix.copy()))
                    continue
                out = []
                same = [(i, m) for key, i, m in held if key == (scope, width)]
                if not same:
                    continue
                every = np.concatenate([i for i, _ in same])
                for at in range(0, len(ids), 64):  # some queries at once: a table of part rows by 64
                    sims = np.concatenate([m @ matrix[at : at + 64].T for _, m in same])
                    for j, own in enumerate(ids[at : at + 64]):
                        near, found = choose(sims[:, j], every, own)
                        out.append((np.full(len(near), own, np.int64), near, found))
                if out:
                    yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["query_id", "id", "sim"])

    return dealt.unionByName(asked).repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(run, "query_id long, id long, sim double")
