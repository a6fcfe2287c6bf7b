"""Exact nearest neighbours, pruned by pivots.

Every row belongs to the cell of its nearest pivot, a row of the table; of a cell the least and greatest distance
to its pivot is kept. A query first meets its own cell, which bounds how far its k-th neighbour can be. By the
triangle inequality a cell can hold a nearer row only if the query's distance to its pivot is within that bound of the cell's
range, and, as cells end half-way between pivots, only if that distance is less than twice the bound beyond the distance to the query's own
pivot. The second round meets the cells that are left, so results are exact. Cells go in blocks, queries in packs,
both of bounded size, that meet by an equality join; what is broadcast is the pivots, 1024 at most.

Where vectors fill their space the ranges rule out next to nothing. If queries would visit more than a tenth of all cells, the
second round is a sweep: queries are dealt to parts of bounded size, every block passes every part once, and a part keeps the nearest rows of its
queries so far. All pairs are compared then, by matrix products, and a vector is moved once for every part and not once for every cell.

Distances are ranked as rounded to nine digits, ties by id, and returned as they are.

Cosine distances are searched as distances of unit vectors. A zero vector has distance 1 to all: such
rows lie in a cell that every query visits, and such queries visit all cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.vectors import unit
from gridloom.operators.sampling import draw_exactly
from gridloom.sources.scratch import durable

BLOCK, PACK, MOST_PIVOTS = 1000, 128, 1024
#: Rows placed at once, and cells whose packs are handed on at once: a task's arrays don't grow with the pivots.
PLACED, HANDED = 1000, 32
#: Queries of one part of a sweep at most, queries that meet a block at once, and the share of cells from which a search is a sweep.
SWEPT, AT_ONCE, SWEEP_FROM = 1 << 15, 512, 0.1
DIGITS = 9
_ZERO = -1


@dataclass
class Cells:
    """Pivots as rows, and of each cell the range of distances to its pivot; empty cells have the range (inf, -inf)."""

    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    cosine: bool
    zero: bool = False

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * x @ self.pivots.T, 0))

    def visited(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(own, may): each query's own cell, and which other cells may hold a row within its reach."""
        d = self.distances(x)
        own = np.where(np.isfinite(self.low), d, np.inf).argmin(1)
        room = reach[:, None] + 1e-6
        nearest = d[np.arange(len(x)), own][:, None]
        may = np.isfinite(self.low) & (d - self.high <= room) & (self.low - d <= room) & (d - nearest <= 2 * room)
        if self.cosine:
            may |= np.isfinite(self.low) & ~x.any(1)[:, None]
        may[np.arange(len(x)), own] = False
        return own, may


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _rows(df: DataFrame, key: str, vector: str, metric: str) -> DataFrame:
    v = unit(F.col(vector)) if metric == "cosine" else F.transform(vector, lambda x: x.cast("double"))
    return df.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def place(batch: pa.RecordBatch, cells: Cells) -> Iterator[pa.RecordBatch]:
    """The batch with each row's cell and its distance to the pivot."""
    for b in (batch.slice(s, PLACED) for s in range(0, batch.num_rows, PLACED)):
        d = cells.distances(_vectors(b.column(1)))
        cell = d.argmin(1)
        gap = d[np.arange(len(cell)), cell]
        if cells.cosine:
            cell = np.where(_vectors(b.column(1)).any(1), cell, _ZERO)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(gap)], names=["id", "v", "cell", "gap"])


def _placed(rows: DataFrame, cells: Cells) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        for b in batches:
            yield from place(b, held.value)

    return rows.mapInArrow(run, "id long, v array<double>, cell int, gap double")


def packs_by_cell(batch: pa.RecordBatch, cells: Cells, first: bool) -> Iterator[pa.RecordBatch]:
    """(cell, ids, vectors) of a batch of queries, for a bounded number of cells at a time."""
    for b in (batch.slice(s, PACK) for s in range(0, batch.num_rows, PACK)):
        own, may = cells.visited(_vectors(b.column(1)), np.asarray(b.column(2)))
        if first:
            row, cell = np.arange(len(own)), own
            if cells.zero:
                row, cell = np.tile(row, 2), np.concatenate([cell, np.full(len(own), _ZERO)])
        else:
            row, cell = np.nonzero(may)
        order = np.argsort(cell, kind="stable")
        row, cell = row[order], cell[order]
        begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, int)
        ends = np.append(begin, len(row))
        for s in range(0, len(begin), HANDED):
            some = ends[s : s + HANDED + 1]
            taken = b.take(pa.array(row[some[0] : some[-1]], pa.int64()))
            at = pa.array(some - some[0], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(cell[some[:-1]], pa.int32()), *(pa.ListArray.from_arrays(at, taken.column(i)) for i in (0, 1))], names=["cell", "ids", "vectors"])


def plan_visits(queries: DataFrame, cells: Cells, first: bool) -> DataFrame:
    """(cell, ids, vectors): packs of the queries (id, v, reach) that visit a cell, their own one first, then all others within reach."""
    held = queries.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        for b in batches:
            yield from packs_by_cell(b, held.value, first)

    return queries.select("id", "v", "reach").mapInArrow(run, "cell int, ids array<long>, vectors array<array<double>>")


def _meet(visits: DataFrame, blocks: DataFrame, want: int, cosine: bool) -> DataFrame:
    def run(batches):
        for b in (b.slice(s, 1) for b in batches for s in range(b.num_rows)):
            ids, own = np.asarray(b.column(0).flatten()), _vectors(b.column(1).flatten())
            others, there = np.asarray(b.column(2).flatten()), _vectors(b.column(3).flatten())
            distance = 1 - own @ there.T if cosine else np.sqrt(sum((own[:, [i]] - there[:, i]) ** 2 for i in range(own.shape[1])))
            rounded = np.where(ids[:, None] == others, np.inf, np.round(distance, DIGITS))
            rows, at = [], []
            for _ in range(min(want, len(others))):
                best = rounded.argmin(1)  # a block is in order of id, so the first of equals is the one of least id
                some = np.flatnonzero(np.isfinite(rounded[np.arange(len(ids)), best]))
                rows.append(some)
                at.append((best[some], distance[some, best[some]]))
                rounded[some, best[some]] = np.inf
            row = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row], pa.int64()), pa.array(others[np.concatenate([x for x, _ in at])], pa.int64()), pa.array(np.concatenate([x for _, x in at]))], names=["query", "neighbour", "distance"])

    # Packs and blocks compress well and are large all the same: neither is broadcast.
    met = visits.join(blocks.hint("merge"), "cell").select("ids", "vectors", "others", "there")
    return met.mapInArrow(run, "query long, neighbour long, distance double")


class Nearest:
    """The ``want`` nearest rows so far of some queries (ids, x), none of them farther than ``reach``.

    Blocks are compared by one matrix product, cosines in single precision with room for its error; what may be near enough is measured in double precision.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, reach: np.ndarray, want: int, cosine: bool):
        self.ids, self.x, self.want, self.cosine = ids, x, want, cosine
        self.last, self.last_id = np.round(reach, DIGITS) + 10.0**-DIGITS, np.full(len(ids), np.iinfo(np.int64).max)
        self.left = x.astype(np.float32) if cosine else np.column_stack([x, np.ones(len(x))])
        self.size, self.room = (x * x).sum(1), (x.shape[1] + 4) * 1.2e-7 if cosine else 1e-9
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.fresh = 0

    def meet(self, others: np.ndarray, there: np.ndarray) -> None:
        right = there.astype(np.float32) if self.cosine else np.column_stack([there, -(there * there).sum(1) / 2])
        for s in range(0, len(self.ids), AT_ONCE):
            last = self.last[s : s + AT_ONCE]
            least = 1 - last - self.room if self.cosine else (self.size[s : s + AT_ONCE] - last * last) / 2 - self.room
            hit = np.flatnonzero(self.left[s : s + AT_ONCE] @ right.T >= least.astype(right.dtype)[:, None])
            row, col = np.divmod(hit, len(others))
            row += s
            if self.cosine:
                distance = 1 - np.einsum("ij,ij->i", self.x[row], there[col])
            else:
                distance = np.sqrt(((self.x[row] - there[col]) ** 2).sum(1))
            rounded = np.round(distance, DIGITS)
            better = (rounded < self.last[row]) | (rounded == self.last[row]) & (others[col] < self.last_id[row])
            some = np.flatnonzero(better & (self.ids[row] != others[col]))
            self.found.append((row[some], others[col[some]], distance[some]))
            self.fresh += len(some)
            if self.fresh > self.want * len(self.ids):
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, other, distance, rank) of the nearest so far; from now on only nearer rows count."""
        row, other, distance = (np.concatenate(c) for c in zip(*self.found, strict=True))
        rounded = np.round(distance, DIGITS)
        order = np.lexsort((other, rounded, row))
        rank = np.arange(len(row)) - np.searchsorted(row[order], row[order])
        order, rank = order[rank < self.want], rank[rank < self.want]
        row, other, distance = row[order], other[order], distance[order]
        full = np.flatnonzero(rank == self.want - 1)
        self.last[row[full]], self.last_id[row[full]] = rounded[order[full]], other[full]
        self.found, self.fresh = [(row, other, distance)], 0
        return row, other, distance, rank + 1


def sweep(asked: DataFrame, blocks: DataFrame, n: int, want: int, cosine: bool) -> DataFrame:
    """(query, neighbour, distance, rank): the nearest rows of ``n`` queries (id, v, reach), each of which meets every block."""
    tasks = asked.sparkSession.sparkContext.defaultParallelism
    parts = -(-n // SWEPT) if n > tasks * SWEPT else min(tasks, -(-n // BLOCK))
    parts = -(-parts // tasks) * tasks if parts > tasks else parts
    # Ids are hashed to parts with another seed than to the parts of a block.
    own = asked.select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int").alias("at"), F.lit(True).alias("asks"), F.array("id").alias("ids"), F.array("v").alias("vectors"), "reach")
    passing = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("at"), F.lit(False).alias("asks"), F.col("others").alias("ids"), F.col("there").alias("vectors"), F.lit(None).cast("double").alias("reach"))
    dealt = own.unionByName(passing).repartitionById(parts, F.col("at")).sortWithinPartitions(F.desc("asks"))

    def run(batches):
        held, nearest = [], None
        for b in batches:
            asks = b.column(1).to_numpy(zero_copy_only=False).sum()
            if asks:
                mine = b.slice(0, asks)
                held.append((np.asarray(mine.column(2).flatten()), _vectors(mine.column(3).flatten()), np.asarray(mine.column(4))))
            for i in range(asks, b.num_rows if held else 0):
                if nearest is None:
                    nearest = Nearest(*(np.concatenate(c) for c in zip(*held, strict=True)), want, cosine)
                nearest.meet(np.asarray(b.column(2).slice(i, 1).flatten()), _vectors(b.column(3).slice(i, 1).flatten()))
        if nearest is not None:
            row, other, distance, rank = nearest.settle()
            for s in range(0, len(row), 1 << 16):
                some = slice(s, s + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(nearest.ids[row[some]]), pa.array(other[some]), pa.array(distance[some]), pa.array(rank[some], pa.int32())], names=["query", "neighbour", "distance", "rank"])

    return dealt.mapInArrow(run, "query long, neighbour long, distance double, rank int")


def visits(queries: DataFrame, cells: Cells) -> DataFrame:
    """(queries, visits): how many cells beyond their own the queries (id, v, reach) visit."""
    held = queries.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        for b in (b.slice(s, PLACED) for b in batches for s in range(0, b.num_rows, PLACED)):
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([int(held.value.visited(_vectors(b.column(0)), np.asarray(b.column(1)))[1].sum())])], names=["queries", "visits"])

    return queries.select("v", "reach").mapInArrow(run, "queries long, visits long").agg(F.sum("queries").alias("queries"), F.sum("visits").alias("visits"))


def build_cells(rows: DataFrame, metric: str, cell_rows: int) -> tuple[Cells, DataFrame]:
    """Cells, and the blocks (cell, part, others, there) of all rows (id, v)."""
    n = rows.count()
    chosen = draw_exactly(rows if metric != "cosine" else rows.filter(F.exists("v", lambda x: x != 0)), "id", min(MOST_PIVOTS, max(1, -(-n // cell_rows))), 42).select("v").collect()
    width = len(chosen[0].v) if chosen else 1
    pivots = np.array([r.v for r in chosen]).reshape(-1, width) if chosen else np.zeros((1, width))
    cells = Cells(pivots, np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf), metric == "cosine")
    placed = durable(_placed(rows, cells))
    sizes = placed.groupBy("cell").agg(F.min("gap").alias("lo"), F.max("gap").alias("hi"), F.count("*").alias("n")).collect()  # a row for each pivot
    for r in sizes:
        if r.cell == _ZERO:
            cells.zero = True
        else:
            cells.low[r.cell], cells.high[r.cell] = r.lo, r.hi
    parts = F.broadcast(rows.sparkSession.createDataFrame([(r.cell, -(-r.n // BLOCK)) for r in sizes], "cell int, parts long"))
    dealt = placed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    packed = dealt.groupBy("cell", "part").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("r"))
    return cells, durable(packed.select("cell", F.transform("r", lambda x: x["id"]).alias("others"), F.transform("r", lambda x: x["v"]).alias("there")))


def knn(df: DataFrame, key: str, vector: str, k: int, *, metric: str = "cosine", skip_first: int = 0, queries: DataFrame | None = None, cell_rows: int = 500) -> DataFrame:
    """(query, neighbour, distance, rank): the k nearest other rows of each query, ties by id.

    ``skip_first=1`` drops the nearest and keeps ranks 2 to k + 1, as published overlaps did. Without ``queries`` every row is one.
    """
    want, cosine = k + skip_first, metric == "cosine"
    rows = durable(_rows(df, key, vector, metric))
    cells, blocks = build_cells(rows, metric, cell_rows)
    asked = rows if queries is None else durable(_rows(queries, key, vector, metric))
    # Queries of one cell follow each other, so that packs visit few cells.
    asked = durable(_placed(asked, cells).drop("gap").sort("cell", "id").withColumn("reach", F.lit(float("inf"))))
    order = Window.partitionBy("query").orderBy(F.round("distance", DIGITS), "neighbour")
    top = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= want)
    one = durable(top(_meet(plan_visits(asked, cells, True), blocks, want, cosine)))
    bounds = one.filter(F.col("rank") == want).select(F.col("query").alias("_q"), "distance")
    reach = F.sqrt(F.greatest(2 * F.col("distance"), F.lit(0.0))) if cosine else F.col("distance")
    wide = asked.drop("reach").join(bounds, F.col("id") == F.col("_q"), "left").withColumn("reach", F.coalesce(reach, F.lit(float("inf"))))
    wide = durable(wide.withColumn("distance", F.coalesce("distance", F.lit(float("inf")))).sort("cell", "id"))
    ahead = visits(wide, cells).first()
    if ahead.queries and ahead.visits > SWEEP_FROM * ahead.queries * len(cells.low):
        ranked = sweep(wide.withColumn("reach", F.col("distance")), blocks, ahead.queries, want, cosine)
    else:
        two = _meet(plan_visits(wide, cells, False), blocks, want, cosine)
        ranked = top(one.drop("rank").unionByName(two))
    return ranked.filter(F.col("rank") > skip_first).withColumn("rank", (F.col("rank") - skip_first).cast("int"))
