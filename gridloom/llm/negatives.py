"""Hard negatives by exact window searches in a multiway hyperplane tree.

Each inner node of the tree has split points, and a row goes to the nearest one. Beside each
split point stand the least and the greatest distance from it to the rows of every sibling
subtree. A search looks for rows whose score (inner product) with an anchor lies in a window; with the
norms of a subtree's rows that window is an annulus of distances around the anchor. A subtree
whose ranges no row of that annulus can meet is passed over, at every level; the leaves that are left
are compared row by row, so results are exact whatever the tree looks like.

A search has two rounds. In the first every anchor visits the one leaf nearest to its annulus; the k-th score
found there is the new lower end of its window. In the second it visits all leaves that the tree cannot rule out.
Anchors near each other are packed, rows of a leaf are dealt to blocks, both of bounded size, and a pack meets the
blocks of a leaf that it visits by an equality join; each meeting is one matrix product that keeps k rows of a window.

The tree is fitted on at most ``sample`` rows, and every row is indexed. What the driver holds is the tree and its
ranges: at most ``sample`` split points, with a fan-out of 16.

Rows without an id, label or vector, or with a component that is null, NaN or infinite, take no part. Equal rows
count once. Rows that share an id are never each other's partners, and each is an anchor if the id is one.
Missing components of shorter vectors are 0. Ties go to the smaller id. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import durable, unit_hash

#: Components are held within this bound, so that scores times 100 stay within 64 bits.
MOST = 1 << 24
FAN_OUT = 16
#: Rows of a block and anchors of a pack, about.
BLOCK, PACK = 1024, 128
_LEAST, _GREATEST = -(1 << 63), (1 << 63) - 1


@dataclass
class Node:
    """``child[j]`` is the node below split point j, or -1 - leaf; ranges are from split point i (row) to subtree j (column)."""

    points: np.ndarray
    child: list[int]
    low: np.ndarray = field(default=None)
    high: np.ndarray = field(default=None)
    norm_low: np.ndarray = field(default=None)
    norm_high: np.ndarray = field(default=None)

    def squares(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of rows to the split points."""
        return np.maximum((x * x).sum(1)[:, None] + (self.points * self.points).sum(1) - 2 * x @ self.points.T, 0)


class Tree:
    def __init__(self, width: int) -> None:
        self.width, self.nodes, self.leaves = width, [], 0

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, leaf_rows: int = BLOCK) -> Tree:
        """A tree whose leaves hold about ``leaf_rows`` of ``rows`` rows, as far as the sample has points to split by."""
        tree = cls(sample.shape[1])
        tree._grow(sample.astype(np.float64), rows / max(1, len(sample)), leaf_rows)
        return tree

    def _grow(self, x: np.ndarray, weight: float, leaf_rows: int) -> int:
        want = min(FAN_OUT, int(-(-len(x) * weight // leaf_rows)), len(x) // 4)
        points = spread_points(x, want) if want > 1 else x[:0]
        if len(points) < 2:
            self.leaves += 1
            return -self.leaves
        at = len(self.nodes)
        self.nodes.append(node := Node(points, []))
        nearest = node.squares(x).argmin(1)
        node.child = [self._grow(x[nearest == j], weight, leaf_rows) for j in range(len(points))]
        return at

    def paths(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(node, rows of x that pass it, split point each of them goes to) from the root down."""
        todo = [(0, np.arange(len(x)))] if self.nodes else []
        while todo:
            at, rows = todo.pop()
            if len(rows):
                nearest = self.nodes[at].squares(x[rows]).argmin(1)
                yield at, rows, nearest
                todo += [(c, rows[nearest == j]) for j, c in enumerate(self.nodes[at].child) if c >= 0]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        for at, rows, nearest in self.paths(x):
            child = np.array(self.nodes[at].child)[nearest]
            out[rows[child < 0]] = -1 - child[child < 0]
        return out

    def ranges(self, batches: Iterator[np.ndarray]) -> Iterator[tuple[int, int, int, float, float]]:
        """(node, i, j, least, greatest) of the given rows: distances from split point i to subtree j, and squared norms of subtree j as i = -1."""
        found: dict[tuple[int, int, int], tuple[float, float]] = {}
        for x in batches:
            norms = (x * x).sum(1)
            for at, rows, nearest in self.paths(x):
                distance = np.sqrt(self.nodes[at].squares(x[rows]))
                for j in np.unique(nearest):
                    own = nearest == j
                    for i, v in [(-1, norms[rows[own]]), *enumerate(distance[own].T)]:
                        lo, hi = found.get((at, i, int(j)), (np.inf, -np.inf))
                        found[at, i, int(j)] = min(lo, float(v.min())), max(hi, float(v.max()))
        for key, (lo, hi) in found.items():
            yield *key, lo, hi

    def set_ranges(self, ranges: list[tuple[int, int, int, float, float]]) -> None:
        for node in self.nodes:
            m = len(node.points)
            node.low, node.high = np.full((m, m), np.inf), np.full((m, m), -np.inf)
            node.norm_low, node.norm_high = np.full(m, np.inf), np.full(m, -np.inf)
        for at, i, j, lo, hi in ranges:
            node = self.nodes[at]
            if i < 0:
                node.norm_low[j], node.norm_high[j] = lo, hi
            else:
                node.low[i, j], node.high[i, j] = lo, hi

    def visits(self, q: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The leaf nearest to the annulus of each row's first window; and (row, leaf) of all leaves that may hold a row whose score is in some window.

        Window w belongs to row ``of[w]`` of ``q``, in order of rows; ``low`` and ``high`` are its ends, infinite
        where open. Comparisons leave room for rounding.
        """
        first = np.zeros(len(q), np.int32)
        if not self.nodes:
            return first, np.arange(len(q)), first
        sizes, head = (q * q).sum(1), np.searchsorted(of, np.arange(len(q)))
        rows, leaves = [], []
        todo = [(0, np.arange(len(q)), np.arange(len(q)))]
        while todo:
            at, own, down = todo.pop()
            node = self.nodes[at]
            every = np.union1d(own, down)
            c = np.sqrt(node.squares(q[every]))
            full = np.isfinite(node.norm_low)
            norm_low, norm_high = np.where(full, node.norm_low, 0), np.where(full, node.norm_high, 0)
            nearest = np.sqrt(np.maximum(sizes[down, None] + norm_low - 2 * high[head[down], None], 0))
            best = np.where(full, np.abs(c[np.searchsorted(every, down)] - nearest), np.inf).argmin(1)
            near, far = np.zeros(c.shape), np.full(c.shape, np.inf)
            for i in range(len(node.points)):
                near = np.maximum(near, np.maximum(c[:, i, None] - node.high[i], node.low[i] - c[:, i, None]))
                far = np.minimum(far, c[:, i, None] + node.high[i])
            room = 1e-6 * (1 + np.sqrt(sizes[every]) + c.max(1))
            w = np.flatnonzero(np.isin(of, own))
            k = np.searchsorted(every, of[w])
            inner = np.sqrt(np.maximum(sizes[of[w], None] + norm_low - 2 * high[w, None], 0))
            outer = sizes[of[w], None] + norm_high - 2 * low[w, None]
            slack = room[k, None]
            good = full & (outer >= -slack * slack) & (near[k] <= np.sqrt(np.maximum(outer, 0)) + slack) & (far[k] >= inner - slack)
            may = np.zeros(c.shape, bool)
            np.logical_or.at(may, k, good)
            for j, child in enumerate(node.child):
                on, to = every[may[:, j]], down[best == j]
                if child >= 0:
                    if len(on) or len(to):
                        todo.append((child, on, to))
                else:
                    rows.append(on)
                    leaves.append(np.full(len(on), -1 - child, np.int32))
                    first[to] = -1 - child
        return first, np.concatenate(rows), np.concatenate(leaves)


def spread_points(x: np.ndarray, want: int) -> np.ndarray:
    """Up to ``want`` distinct rows far apart: of three times as many candidates, each time the one farthest from those chosen."""
    candidates = x[np.linspace(0, len(x) - 1, min(len(x), 3 * want)).astype(int)]
    chosen = [0]
    gap = ((candidates - candidates[0]) ** 2).sum(1)
    while len(chosen) < want and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((candidates - candidates[chosen[-1]]) ** 2).sum(1))
    return candidates[chosen]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists as rows of whole numbers, filled up with zeros."""
    sizes = np.asarray(column.value_lengths())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.asarray(column.flatten())
    return out


@dataclass
class Index:
    """``blocks``: (leaf, ids, labels, vectors) with rows in order of id; ``tree`` and ``rows``, the indexed rows with their leaf."""

    tree: Tree
    rows: DataFrame
    blocks: DataFrame


def build_index(rows: DataFrame, sample: int = 20_000) -> Index:
    """Index every row (id, label, v) of distinct rows without nulls."""
    spark = rows.sparkSession
    rows = durable(rows)
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    share = min(sample, (1 << 24) // max(1, width)) / max(1, n)
    chosen = rows.filter(unit_hash(F.col("id"), "tree") < share).select("v").toArrow() if n else None
    tree = Tree.fit(matrix(chosen["v"].combine_chunks(), width), n) if n else Tree(width)
    held = spark.sparkContext.broadcast(tree)

    def assign(batches):
        tree = held.value
        for b in batches:
            x = matrix(b.column(2), tree.width)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.leaf_of(x.astype(np.float64)), pa.int32())], names=["id", "label", "v", "leaf"])

    def measure(batches):
        tree = held.value
        found = list(tree.ranges(matrix(b.column(0), tree.width).astype(np.float64) for b in batches))
        columns = list(zip(*found, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32()] * 3 + [pa.float64()] * 2, strict=True)], names=["node", "i", "j", "lo", "hi"])

    placed = durable(rows.select("id", "label", "v").mapInArrow(assign, "id long, label long, v array<long>, leaf int"))
    ranges = placed.select("v").mapInArrow(measure, "node int, i int, j int, lo double, hi double").groupBy("node", "i", "j").agg(F.min("lo"), F.max("hi"))
    tree.set_ranges([tuple(r) for r in ranges.toLocalIterator()])  # one row for each two split points of a node
    counts = placed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = placed.join(counts, "leaf").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    blocks = dealt.groupBy("leaf", "part").agg(F.sort_array(F.collect_list(F.struct("id", "label", "v"))).alias("r"))
    # Ids of equal rows are distinct, so a block is in order of id; vectors stand one behind the other.
    blocks = blocks.select("leaf", F.transform("r", lambda x: x["id"]).alias("ids"), F.transform("r", lambda x: x["label"]).alias("labels"), F.transform("r", lambda x: x["v"]).alias("vectors"))
    return Index(tree, placed, durable(blocks))


WINDOWS = "array<struct<window:int,same:boolean,low:long,high:long>>"
_VISITORS = f"array<struct<anchor:long,id:long,label:long,v:array<long>,windows:{WINDOWS}>>"


def _plan(index: Index, anchors: DataFrame, first: bool) -> DataFrame:
    """(leaf, visitors): packs of the anchors (anchor, id, label, v, windows) that visit a leaf, the first one or all others that the tree cannot rule out.

    Anchors that follow one another in a task are packed together.
    """
    held = anchors.sparkSession.sparkContext.broadcast(index.tree)

    def run(batches):
        tree = held.value
        for b in (b.slice(s, PACK) for b in batches for s in range(0, b.num_rows, PACK)):
            windows = b.column(4)
            flat, sizes = windows.flatten(), np.asarray(windows.value_lengths())
            low = np.asarray(flat.field("low").cast(pa.float64()).fill_null(-np.inf))
            high = np.asarray(flat.field("high").cast(pa.float64()).fill_null(np.inf))
            of, open_ = np.repeat(np.arange(len(b)), sizes), low <= high
            some = np.unique(of[open_])
            one, rows, leaves = tree.visits(matrix(b.column(3), tree.width)[some].astype(np.float64), np.searchsorted(some, of[open_]), low[open_], high[open_])
            if first:
                rows, leaves = np.arange(len(some)), one
            else:
                other = leaves != one[rows]
                rows, leaves = rows[other], leaves[other]
            order = np.argsort(leaves, kind="stable")
            rows, leaves = some[rows[order]], leaves[order]
            begin = np.flatnonzero(np.append(True, leaves[1:] != leaves[:-1])) if len(leaves) else np.zeros(0, int)
            packs = pa.StructArray.from_arrays(b.take(pa.array(rows, pa.int64())).columns, names=b.schema.names)
            yield pa.RecordBatch.from_arrays([pa.array(leaves[begin], pa.int32()), pa.ListArray.from_arrays(pa.array(np.append(begin, len(rows)), pa.int32()), packs)], names=["leaf", "visitors"])

    return anchors.select("anchor", "id", "label", "v", "windows").mapInArrow(run, f"leaf int, visitors {_VISITORS}")


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: as doubles where these are exact, else as 64-bit integers."""
    if len(a) and len(b) and float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _best(own: np.ndarray, anchors: dict, other: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(window's row, id, score) of the k best rows of a block, in order of id, for each window of a pack of anchors."""
    product = scores(own, other)
    part = anchors["row"]
    good = ((labels == anchors["label"][:, None])[part] == anchors["same"][:, None]) & (ids != anchors["id"][:, None])[part]
    value = product[part]
    good &= (value >= anchors["low"][:, None]) & (value <= anchors["high"][:, None])
    value = np.where(good, value, _LEAST)
    rows, found, score = [], [], []
    every = np.flatnonzero(good.any(1))
    value = value[every]
    for _ in range(k):
        if not len(every):
            break
        best = value.argmax(1)
        top = value[np.arange(len(every)), best]
        some = top > _LEAST
        rows.append(every[some])
        found.append(ids[best[some]])
        score.append(top[some])
        value[np.arange(len(every)), best] = _LEAST
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else empty for x in (rows, found, score))


def _meet(index: Index, visits: DataFrame, k: int) -> DataFrame:
    """(anchor, window, found, score): up to k rows for each window and block."""
    width = index.tree.width

    def run(batches):
        for b in (b.slice(s, 1) for b in batches for s in range(b.num_rows)):
            visitors = b.column(0).flatten()
            own = matrix(visitors.field("v"), width)
            windows = visitors.field("windows")
            flat = windows.flatten()
            row = np.repeat(np.arange(len(visitors)), np.asarray(windows.value_lengths()))
            anchors = {"row": row, "id": np.asarray(visitors.field("id")), "label": np.asarray(visitors.field("label")), "same": np.asarray(flat.field("same").to_numpy(zero_copy_only=False))}
            anchors |= {"low": np.asarray(flat.field("low").fill_null(_LEAST)), "high": np.asarray(flat.field("high").fill_null(_GREATEST))}
            at, found, score = _best(own, anchors, matrix(b.column(3).flatten(), width), np.asarray(b.column(1).flatten()), np.asarray(b.column(2).flatten()), k)
            key = np.asarray(visitors.field("anchor"))[row[at]]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(np.asarray(flat.field("window"))[at], pa.int32()), pa.array(found, pa.int64()), pa.array(score, pa.int64())], names=["anchor", "window", "found", "score"])

    # Both sides are large beside what their compressed size says: neither is broadcast.
    met = visits.join(index.blocks.hint("merge"), "leaf").select("visitors", "ids", "labels", "vectors")
    return met.mapInArrow(run, "anchor long, window int, found long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    ordered = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc("found"))
    return found.withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= k)


def window_search(index: Index, anchors: DataFrame, k: int) -> DataFrame:
    """(anchor, window, found, score, rank): the k best rows of each window of each anchor (anchor, id, label, v, windows).

    A window takes rows of the anchor's label or (``same`` false) of others, with scores from ``low`` to ``high``.
    """
    one = durable(_top(_meet(index, _plan(index, anchors, True), k), k))
    full = one.groupBy("anchor", "window").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") >= k)
    reached = full.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("reached"))

    def raised(w: Column) -> Column:
        at = F.try_element_at(F.coalesce("reached", F.create_map().cast("map<int,long>")), w["window"])
        return F.struct(w["window"].alias("window"), w["same"].alias("same"), F.greatest(w["low"], at).alias("low"), w["high"].alias("high"))

    wide = anchors.join(reached, "anchor", "left").withColumn("windows", F.transform("windows", raised)).drop("reached").sort("leaf", "anchor")
    two = _meet(index, _plan(index, wide, False), k)
    return _top(one.drop("rank").unionByName(two), k)


def hard_negatives(rows: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, sample: int = 20_000) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over rows (id, label, v).

    An anchor's positives are the ``positives`` best other rows of its label; for each, the negatives are the best
    rows of other labels that score between ``low`` and ``high`` hundredths of it.
    """
    whole = lambda x: F.greatest(F.least(x.cast("long"), F.lit(MOST)), F.lit(-MOST))
    full = rows.filter("id is not null and label is not null and v is not null").filter(F.forall("v", lambda x: x.isNotNull()))
    used = full.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform("v", whole).alias("v"))
    index = build_index(used.dropDuplicates(["id", "label", "v"]), sample)
    anchors = durable(index.rows.filter(is_anchor).select(F.monotonically_increasing_id().alias("anchor"), "id", "label", "v", "leaf").sort("leaf", "id"))
    nothing = F.lit(None).cast("long")
    own = anchors.withColumn("windows", F.array(F.struct(F.lit(0).alias("window"), F.lit(True).alias("same"), nothing.alias("low"), nothing.alias("high"))))
    best = durable(window_search(index, own, positives).select("anchor", F.col("rank").alias("window"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")))
    up, down = F.col("positive_score") * low, F.col("positive_score") * high
    ends = F.struct("window", F.lit(False).alias("same"), F.expr(f"(positive_score * {low} + pmod(-positive_score * {low}, 100)) div 100").alias("low"), F.expr(f"(positive_score * {high} - pmod(positive_score * {high}, 100)) div 100").alias("high"))
    windows = best.filter(up <= down).groupBy("anchor").agg(F.collect_list(ends).alias("windows"))
    found = window_search(index, anchors.join(windows, "anchor"), negatives)
    return found.join(best, ["anchor", "window"]).join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor").select("anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def quantised(embeddings: DataFrame) -> DataFrame:
    """(id, label, v) of the rows with a label and finite components: floor(256 x), and the label moved on by one where 7 divides the id."""
    x = embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda c: c.cast("double")).alias("x"))
    x = x.filter("label is not null and x is not null").filter(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return x.select("id", moved.alias("label"), F.transform("x", lambda c: F.floor(256 * c)).alias("v"))


def mine_embeddings(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the anchors whose id 50 divides."""
    return hard_negatives(quantised(embeddings), F.col("id") % 50 == 0)


SQL = """
WITH rows AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
pairs AS (
  SELECT a.id AS anchor_id, b.id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM rows a JOIN rows b ON a.id <> b.id WHERE a.id % 50 = 0),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 3
"""
