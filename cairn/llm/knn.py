"""Exact top-k search by a Voronoi kNN join.

1. Pivots, a bounded number of the queries, split the queries into Voronoi cells; few queries are all pivots. A summary tells how
   many queries a cell has and how far from its pivot they lie.
2. With r that distance, p the pivot and x a data vector, every query q of the cell has p.x - r|x| <= q.x <= p.x + r|x|
   (Cauchy-Schwarz). The (k + 1)-th largest of the lower bounds, over all data, is a score that every query of the cell reaches
   with k rows other than its own.
3. A data vector travels to a cell only if its upper bound reaches that score. Cells which nearly everything can
   reach (their queries lie far apart) share one group, so that such a vector travels once and not once a cell.
4. Each cell, or group, is solved in tiles of a bounded number of queries and data vectors; the tiles' best are merged.

Bounds only decide what travels, with a margin for rounding; scores are computed as whole numbers. Vectors of each length are a
space of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

#: Pivots of a space; queries and data vectors of a tile, about; rows that are scored at once.
PIVOTS, TILE_QUERIES, TILE_DATA, STEP = 1024, 4_000, 20_000, 128
#: The share of all data vectors from which on a cell joins the group of those that need nearly everything.
WIDE = 0.25
MARGIN = 1e-9


def scaled(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(row, vec_id, v): floor(scale * component) as longs, and a number for each row; without vectors that are null or empty, or hold null or non-finite components."""
    c = F.col(f"`{vec_col}`")
    fine = F.forall(c, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull() & c.isNotNull() & (F.size(c) > 0) & fine)
    whole = F.transform(c, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("vec_id"), whole.alias("v"))


@dataclass
class Space:
    """The cells of the queries of one length: pivots, how many queries and how far off; the score to reach; tiles."""

    pivots: np.ndarray
    n: np.ndarray = field(init=False)  # queries of a cell
    far: np.ndarray = field(init=False)
    reach: np.ndarray = field(init=False)
    wide: np.ndarray = field(init=False)  # whether a cell is of the group that needs nearly everything
    parts: np.ndarray = field(init=False)  # tiles that a cell's data are dealt to; those of the group: wide_parts, times blocks of queries
    wide_parts: int = 1
    blocks: int = 1

    def __post_init__(self):
        size = len(self.pivots)
        self.n, self.far, self.reach = np.zeros(size, np.int64), np.zeros(size), np.full(size, -np.inf)
        self.wide, self.parts = np.zeros(size, bool), np.ones(size, np.int64)

    def cells(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each query, and how far from its pivot it lies."""
        d = (q * q).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * (q @ self.pivots.T)
        cell = d.argmin(1)
        return cell, np.sqrt(((q - self.pivots[cell]) ** 2).sum(1))

    def covered(self, q: np.ndarray) -> np.ndarray:
        """A cell for each query, within whose radius it lies: its own one, unless rounding chose between two that are equally near."""
        cell, off = self.cells(q)
        for i in np.flatnonzero((off > self.far[cell]) | (self.n[cell] == 0)).tolist():
            every = np.sqrt(((q[i] - self.pivots) ** 2).sum(1))
            cell[i] = np.where((every <= self.far) & (self.n > 0), every, np.inf).argmin()
        return cell

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector and cell, a score that all of the cell's queries reach with it, and one that none exceeds."""
        length = np.sqrt((x * x).sum(1))[:, None]
        middle, more = x @ self.pivots.T, self.far * length
        slack = MARGIN * (np.sqrt((self.pivots * self.pivots).sum(1)) * length + more)
        return middle - more - slack, middle + more + slack

    def needs(self, x: np.ndarray) -> np.ndarray:
        return (self.bounds(x)[1] >= self.reach) & (self.n > 0)


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _steps(batches: Iterator[pa.RecordBatch], spaces: dict[int, Space]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Some rows of one length at a time: the length, the rows, their vectors."""
    for b in batches:
        sizes = b.column("v").value_lengths().to_numpy()
        for dim in np.unique(sizes).tolist():
            if dim not in spaces:
                continue
            own = b.take(pa.array(np.flatnonzero(sizes == dim)))
            for i in range(0, own.num_rows, 8 * STEP):
                part = own.slice(i, 8 * STEP)
                yield dim, part, _matrix(part.column("v"), part.num_rows).astype(np.float64)


def _radii(spaces: dict[int, Space]):
    """Of each cell how many queries of a task it has, and how far off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {d: np.zeros(len(s.n), np.int64) for d, s in spaces.items()}
        far = {d: np.zeros(len(s.n)) for d, s in spaces.items()}
        for d, _, q in _steps(batches, spaces):
            cell, off = spaces[d].cells(q)
            n[d] += np.bincount(cell, minlength=len(n[d]))
            np.maximum.at(far[d], cell, off)
        for d in spaces:
            some = np.flatnonzero(n[d])
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(n[d][some]), pa.array(far[d][some])], names=["dim", "cell", "n", "far"])

    return run


def _lower(spaces: dict[int, Space], k: int):
    """Of each cell the k + 1 largest lower bounds among a task's data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: np.full((k + 1, len(s.n)), -np.inf) for d, s in spaces.items()}
        for d, _, x in _steps(batches, spaces):
            both = np.concatenate([best[d], spaces[d].bounds(x)[0]])
            best[d] = np.partition(both, len(both) - k - 1, axis=0)[len(both) - k - 1 :]
        for d, b in best.items():
            some = np.flatnonzero(np.isfinite(b).any(0))
            lists = [c[np.isfinite(c)].tolist() for c in b[:, some].T]
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(lists, pa.list_(pa.float64()))], names=["dim", "cell", "low"])

    return run


def _needed(spaces: dict[int, Space]):
    """Of each cell how many of a task's data vectors it needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {d: np.zeros(len(s.n), np.int64) for d, s in spaces.items()}
        for d, _, x in _steps(batches, spaces):
            n[d] += spaces[d].needs(x).sum(0)
        for d in spaces:
            some = np.flatnonzero(n[d])
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(n[d][some])], names=["dim", "cell", "n"])

    return run


def _route(spaces: dict[int, Space]):
    """Copies of each row for the tiles that need it."""
    schema = pa.schema([("tile", pa.string()), ("row", pa.int64()), ("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("as_query", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, b, x in _steps(batches, spaces):
            s = spaces[d]
            number = b.column("row").to_numpy()
            spread = number ^ number >> 33
            take, names, kinds = [], [], []
            needs = s.needs(x)
            for i in np.flatnonzero(needs[:, s.wide].any(1)).tolist():
                for q in range(s.blocks):
                    take.append(i), names.append(f"{d}/all/{q}/{spread[i] % s.wide_parts}"), kinds.append(False)
            for i, c in np.argwhere(needs & ~s.wide).tolist():
                take.append(i), names.append(f"{d}/{c}/{spread[i] % s.parts[c]}"), kinds.append(False)
            queries = np.flatnonzero(np.asarray(b.column("is_query").to_numpy(zero_copy_only=False), bool))
            cells = s.covered(x[queries]).tolist() if len(queries) else []
            for i, c in zip(queries.tolist(), cells, strict=True):
                if s.wide[c]:
                    to = [f"{d}/all/{spread[i] % s.blocks}/{part}" for part in range(s.wide_parts)]
                else:
                    to = [f"{d}/{c}/{part}" for part in range(int(s.parts[c]))]
                take += [i] * len(to)
                names += to
                kinds += [True] * len(to)
            some = b.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), some.column("row"), some.column("vec_id"), some.column("v"), pa.array(kinds, pa.bool_())], schema=schema)

    return run


def _solve(k: int):
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def tile(table: pa.Table) -> pa.Table:
        ids, row = table.column("vec_id").to_numpy(), table.column("row").to_numpy()
        kind = table.column("as_query").to_numpy()
        v = _matrix(table.column("v"), table.num_rows)
        data = np.flatnonzero(~kind)
        data = data[np.argsort(ids[data], kind="stable")]
        queries = np.flatnonzero(kind)
        out: list[list[np.ndarray]] = [[], [], [], []]
        if len(data) and len(queries):
            x, xid, xrow = v[data], ids[data], row[data]
            exact = float(np.abs(v).max()) ** 2 * v.shape[1] < 2**52  # then sums of products are whole in float64
            xt = x.T.astype(np.float64) if exact else x.T
            for i in range(0, len(queries), STEP):
                some = queries[i : i + STEP]
                scores = v[some].astype(np.float64) @ xt if exact else v[some] @ xt
                for line, q, own in zip(scores, ids[some].tolist(), row[some].tolist(), strict=True):
                    others = np.flatnonzero(xrow != own)
                    s = line[others]
                    best = s if len(s) <= k else np.partition(s, len(s) - k)[len(s) - k :]
                    if not len(best):
                        continue
                    floor = best.min()
                    over, tied = np.flatnonzero(s > floor), np.flatnonzero(s == floor)
                    top = np.concatenate([over, tied[: k - len(over)]])  # data stand by id, so the first ties are the smallest
                    out[0].append(np.full(len(top), own))
                    out[1].append(np.full(len(top), q))
                    out[2].append(xid[others[top]])
                    out[3].append(s[top].astype(np.int64))
        return pa.Table.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out], schema=schema)

    return tile


@dataclass
class Routing:
    """What travels where: the spaces by length of vector, the rows, and how many pairs of a vector and a cell are kept of how many."""

    spaces: dict[int, Space]
    rows: DataFrame
    kept: int
    pairs: int


def routing(vectors: DataFrame, is_query: Callable[[Column], Column], k: int, id_col: str, vec_col: str, scale: int) -> Routing:
    """Bounds of all cells, from three passes over the rows that each return a few numbers a task and cell."""
    rows = scaled(vectors, id_col, vec_col, scale).withColumn("is_query", F.coalesce(is_query(F.col("vec_id")), F.lit(False)))
    rows = checkpointed(rows)
    dim = F.size("v").alias("dim")
    total = {x.dim: x.n for x in rows.groupBy(dim).agg(F.count("*").alias("n")).collect()}  # a row for each length
    asked = rows.where("is_query")
    first = Window.partitionBy("dim").orderBy(F.xxhash64("row"), "row")
    picked = asked.select(dim, "row", "v").withColumn("r", F.row_number().over(first)).where(F.col("r") <= PIVOTS).select("dim", "v").collect()
    points: dict[int, list] = {}
    for p in picked:
        points.setdefault(p.dim, []).append(p.v)
    spaces = {d: Space(np.unique(np.array(v, np.float64), axis=0)) for d, v in points.items()}
    if not spaces:
        return Routing({}, rows, 0, 0)
    for x in asked.select("v").mapInArrow(_radii(spaces), "dim int, cell int, n long, far double").groupBy("dim", "cell").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect():
        spaces[x.dim].n[x.cell], spaces[x.dim].far[x.cell] = x.n, x.far * (1 + MARGIN)
    bare = rows.select("v")
    lows = bare.mapInArrow(_lower(spaces, k), "dim int, cell int, low array<double>")
    largest = F.slice(F.sort_array(F.flatten(F.collect_list("low")), asc=False), 1, k + 1)  # tasks x (k + 1) numbers a cell
    for x in lows.groupBy("dim", "cell").agg(largest.alias("low")).collect():
        if len(x.low) > k:
            spaces[x.dim].reach[x.cell] = x.low[k]
    kept = pairs = 0
    needed = {d: np.zeros(len(s.n), np.int64) for d, s in spaces.items()}
    for x in bare.mapInArrow(_needed(spaces), "dim int, cell int, n long").groupBy("dim", "cell").agg(F.sum("n").alias("n")).collect():
        needed[x.dim][x.cell] = x.n
    for d, s in spaces.items():
        kept, pairs = kept + int(needed[d].sum()), pairs + total[d] * int((s.n > 0).sum())
        s.wide = needed[d] > WIDE * total[d]
        s.parts = np.maximum(1, -(-needed[d] // TILE_DATA))
        s.wide_parts, s.blocks = max(1, -(-total[d] // TILE_DATA)), max(1, -(-int(s.n[s.wide].sum()) // TILE_QUERIES))
    return Routing(spaces, rows, kept, pairs)


def voronoi_knn(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each row where is_query(column of ids) holds, its k best other rows.

    Scores are inner products of floor(scale * component); ties go to the smaller id. Rows that repeat an id are rows of
    their own: each is a candidate, and each a query if its id is one. Vectors that are null, empty, or hold null or non-finite
    components take no part, nor do rows without an id. Only vectors of one length are compared with each other. Fewer
    than k others give fewer rows; an empty table gives none. Extra columns are left out.
    """
    plan = routing(vectors, is_query, k, id_col, vec_col, scale)
    if not plan.spaces:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sent = plan.rows.mapInArrow(_route(plan.spaces), "tile string, row long, vec_id long, v array<long>, as_query boolean")
    found = sent.groupBy("tile").applyInArrow(_solve(k), "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
