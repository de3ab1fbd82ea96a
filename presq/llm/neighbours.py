"""Problem 3: most similar vectors for every vector.

Method: vectors of unit length are projected to a few dimensions by 2-stable (Gaussian) matrices, so that a squared
projected difference over the squared distance follows a chi-square law. Each projection is indexed by a kd-tree, and
a vector's projected neighbours are verified by their true similarity until a chi-square stopping test holds, twice:
within a cell of the tree, leaf by leaf in growing projected distance; and over cells, tree by tree. There the law with
one degree of freedom for each dimension gives the chance that a neighbour at the distance of the worst one kept was
cut off from the vector's own cell; the chances of independent projections multiply, and a vector is looked up in
further trees until the product is at most 1 - confidence. So no vector is sent to cells other than its own, and its
work doesn't grow with the number of cells as a search of all cells in reach would.

The tops of the trees, built on a bounded sample, cut the space into cells that tasks hold whole, at places where few
sampled vectors lie. Vectors that MOST_TREES don't settle get further trees, to twice that number, while these move fewer
rows than a search of all cells of one tree that the test radius touches; then they search those cells. That is done in
portions that move about as many rows as a turn of trees, and a task holds one cell's points and passes those that ask
in batches, so its memory depends neither on their number nor on the cells they touch. Equal vectors are one point with
its least ids, so copies never fill a cell.

Defined cases: a vector is usable if it has the given number of elements, all finite and not all zero; others, and
null ids, take no part; an id counts once, by its least vector; ties go to the smaller id; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presq.plans.shared import materialize, partitions_for

DIMENSIONS = 8
CONFIDENCE = 0.9995
CELL_ROWS = 512
#: Rows of a leaf within a cell, queries searched together, and leaves they visit between two tests.
LEAF = 128
GROUP = 256
AT_ONCE = 4
#: Trees of each turn; the last number goes on. Between turns, vectors whose test holds leave.
TREES = (5, 7, 9)
MOST_TREES = 48
#: (row, cell) pairs that a search of all cells in reach works out at once, and those that it ships in one batch.
TOUCH_PAIRS = 2_000_000
SHIP_PAIRS = 10_000
#: Rows of cells that a task holds.
TASK_ROWS = 50_000
#: Rows that the cells are laid out on: a bound of the sample alone, every row is indexed.
LAYOUT_ROWS = 20_000
SEED = 20240229


def chi_square(x: float, m: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def stop_factor(m: int, confidence: float) -> float:
    """Least x with chi_square(x) >= confidence: projected over true squared distance at which a search may stop."""
    lo, hi = 0.0, 1.0
    while chi_square(hi, m) < confidence:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, m) < confidence else (lo, mid)
    return hi


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def projection(width: int, m: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, m))


def _cut(p: np.ndarray) -> tuple[int, float]:
    """Dimension and value of the cut that the fewest rows lie close to, among the middle third of each dimension."""
    best = (np.inf, -1, 0.0)
    for d in range(p.shape[1]):
        x = np.sort(p[:, d])
        values = x[(len(x) * np.linspace(0.35, 0.65, 7)).astype(int)]
        near = np.searchsorted(x, values + 0.2, "right") - np.searchsorted(x, values - 0.2, "left")
        at = int(near.argmin())
        if x[0] < values[at] and (near[at], d) < best[:2]:
            best = (near[at], d, float(values[at]))
    return best[1], best[2]


class Tree(NamedTuple):
    """Top of a kd-tree: each node's dimension, value and children, or -1, nothing and its cell; corners of each cell."""

    dim: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray


def layout(points: np.ndarray, cells: int) -> Tree:
    nodes: list[tuple] = []
    corners: list[tuple] = []

    def grow(p: np.ndarray, n: int, low: np.ndarray, high: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(())
        d, value = _cut(p) if n > 1 and len(p) > 1 else (-1, 0.0)
        if d < 0:
            nodes[at] = (-1, 0.0, len(corners), -1)
            corners.append((low, high))
            return at
        left = p[:, d] < value
        few = min(n - 1, max(1, round(n * left.mean())))
        lh, rl = high.copy(), low.copy()
        lh[d] = rl[d] = value
        nodes[at] = (d, value, grow(p[left], few, low, lh), grow(p[~left], n - few, rl, high))
        return at

    m = points.shape[1]
    grow(points, cells, np.full(m, -np.inf), np.full(m, np.inf))
    dim, value, left, right = (np.array(x) for x in zip(*nodes, strict=True))
    return Tree(dim, value, left, right, np.stack([x[0] for x in corners]), np.stack([x[1] for x in corners]))


def _home(tree: Tree, p: np.ndarray) -> np.ndarray:
    out = np.zeros(len(p), np.int32)
    todo = [(0, np.arange(len(p)))]
    while todo:
        k, rows = todo.pop()
        if tree.dim[k] < 0:
            out[rows] = tree.left[k]
        else:
            left = p[rows, tree.dim[k]] < tree.value[k]
            todo += [(tree.left[k], rows[left]), (tree.right[k], rows[~left])]
    return out


def _touched(tree: Tree, p: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every cell within the squared distance reach of a row, by descent."""
    rows, cells = [], []
    todo = [(0, np.arange(len(p)), np.zeros_like(p))]
    while todo:
        k, at, gap = todo.pop()
        if not len(at):
            continue
        d = tree.dim[k]
        if d < 0:
            rows.append(at)
            cells.append(np.full(len(at), tree.left[k]))
            continue
        over = p[at, d] - tree.value[k]
        for child, beyond in ((tree.left[k], np.maximum(over, 0)), (tree.right[k], np.maximum(-over, 0))):
            far = gap.copy()
            far[:, d] = np.maximum(far[:, d], beyond)
            go = (far * far).sum(1) <= reach[at] + 1e-12
            todo.append((child, at[go], far[go]))
    return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(cells or [np.zeros(0, int)])


def _touches(tree: Tree, p: np.ndarray, reach: np.ndarray):
    """The pairs of _touched in pieces of SHIP_PAIRS at most; TOUCH_PAIRS, or one row's, are held."""
    step = max(1, TOUCH_PAIRS // len(tree.low))
    for lo in range(0, len(p), step):
        row, cell = _touched(tree, p[lo : lo + step], reach[lo : lo + step])
        for at in range(0, len(row), SHIP_PAIRS):
            yield lo + row[at : at + SHIP_PAIRS], cell[at : at + SHIP_PAIRS]


def _chi_one(x: np.ndarray) -> np.ndarray:
    """Chi-square distribution function of one degree of freedom at x * x; a rational approximation good to 2e-7."""
    z = x / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    return 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-z * z)


def log_cut_off(tree: Tree, p: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Log of the chance that a neighbour at the given true distance lies outside the cell of a projected row."""
    home = _home(tree, p)
    low, high = tree.low[home], tree.high[home]
    d = np.maximum(distance, 1e-9)[:, None]
    inside = (_chi_one(np.minimum((p - low) / d, 40.0)) + _chi_one(np.minimum((high - p) / d, 40.0))) / 2
    return np.log(np.maximum(1 - inside.prod(1), 1e-300))


def _leaves(p: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows of each leaf of a kd-tree over p; ties are parted by position, so leaves are always small."""
    out, todo = [], [np.arange(len(p))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        x = p[rows]
        d = int((x.max(0) - x.min(0)).argmax())
        half = len(rows) // 2
        rows = rows[np.argpartition(x[:, d], half)]
        todo += [rows[:half], rows[half:]]
    return out


def _top(sim: np.ndarray, pos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by similarity, then by position."""
    order = np.lexsort((pos, -np.round(sim, 12)), axis=1)[:, :k]
    return np.take_along_axis(sim, order, 1), np.take_along_axis(pos, order, 1)


def search(index: np.ndarray, ids: np.ndarray, queries: np.ndarray, qids: np.ndarray, bound: np.ndarray, k: int, factor: float, matrix: np.ndarray, floor: float):
    """(similarities, positions) of the k best index rows of each query, positions -1 where there are fewer.

    index rows are in the order of ids; bound holds squared distances beyond which nothing is wanted.
    """
    p, q = index @ matrix, queries @ matrix
    leaves = _leaves(p, LEAF)
    low = np.stack([p[r].min(0) for r in leaves])
    high = np.stack([p[r].max(0) for r in leaves])
    place = np.concatenate(leaves)  # rows of a leaf lie together
    ends = np.cumsum([len(r) for r in leaves])
    begins = ends - [len(r) for r in leaves]
    rows_of, ids_of = index[place], ids[place]
    none = np.iinfo(np.int64).max
    best = np.full((len(queries), k), -2.0)
    where = np.full((len(queries), k), none)
    for group in _leaves(q, GROUP):
        # queries of a group lie together, so they visit leaves in about the same order
        qq, vv, own, b, w = q[group], queries[group], qids[group], best[group], where[group]
        gap = np.zeros((len(group), len(leaves)))
        for d in range(q.shape[1]):
            x = qq[:, d : d + 1]
            g = np.maximum(np.maximum(low[:, d] - x, x - high[:, d]), 0)
            gap += g * g
        limit = bound[group].copy()
        least = np.maximum(floor, 1 - limit / 2 - 1e-12)  # a candidate below this changes nothing
        left = np.argsort(gap.min(0), kind="stable")
        while len(left):
            need = gap[:, left] <= factor * limit[:, None] + 1e-12
            left = left[need.any(0)]
            now, left = left[:AT_ONCE], left[AT_ONCE:]
            if not len(now):
                break
            rows = np.flatnonzero((gap[:, now] <= factor * limit[:, None] + 1e-12).any(1))
            at = np.concatenate([np.arange(begins[x], ends[x]) for x in now.tolist()])
            sim = vv[rows] @ rows_of[at].T
            good = (sim >= least[rows][:, None]) & (ids_of[at][None, :] != own[rows][:, None])
            hit = np.flatnonzero(good.any(1))
            if not len(hit):
                continue
            rows, good = rows[hit], good[hit]
            cols = np.flatnonzero(good.any(0))
            new = np.where(good[:, cols], sim[np.ix_(hit, cols)], -2.0)
            pos = np.where(good[:, cols], place[at[cols]][None, :], none)
            s, w[rows] = _top(np.hstack([b[rows], new]), np.hstack([w[rows], pos]), k)
            b[rows] = s
            full = rows[s[:, -1] > -2.0]
            least[full] = np.maximum(least[full], b[full, -1] - 1e-12)
            limit[full] = np.minimum(limit[full], 2 - 2 * b[full, -1])
        best[group], where[group] = b, w
    where[best == -2.0] = -1
    return best, where


def _matrix(column, width: int) -> np.ndarray:
    """Vectors of a column of 32-bit floats as bytes."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.float32, len(column) * width, int(offsets[0])).reshape(-1, width)


def _as_bytes(batches):
    """(rep, vec) with vectors as bytes, which are moved as they are."""
    for b in batches:
        flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        width = 4 * (len(flat) // max(1, b.num_rows))
        offsets = (np.arange(b.num_rows + 1) * width).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
        yield pa.RecordBatch.from_arrays([b.column(0), data], names=["rep", "vec"])


def _task(batches):
    held = list(batches)
    return pa.Table.from_batches(held).combine_chunks() if held else None


_CELL_SCHEMA = "cell int, rep string, vec binary, bound double, role byte"
_HIT_SCHEMA = "rep string, other string, sim double"
#: Roles of a row in a cell: found only, found and searching, searching only.
FOUND, BOTH, ASKS = 0, 1, 2


def _rows(cell, rep, vec, bound, role):
    return pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), rep, vec, pa.array(bound, pa.float64()), pa.array(role, pa.int8())], names=["cell", "rep", "vec", "bound", "role"])


def nearest(vectors: DataFrame, width: int, k: int = 5, min_similarity: float = -1.0, dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE, cell_rows: int = CELL_ROWS, most_trees: int = MOST_TREES, key: str = "id", vec: str = "vec", report: list | None = None) -> DataFrame:
    """(id, other, sim): the k most similar other vectors of each usable one, of those that reach min_similarity.

    report gets a dict of counts per turn: cells of a tree, vectors looked up, and cells visited by them.
    """
    if dimensions < 2 or dimensions % 2:
        raise ValueError("dimensions is even")
    spark = vectors.sparkSession
    finite = F.forall(F.col(vec), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.where(F.col(key).isNotNull() & (F.size(vec) == width)).where(finite & F.exists(F.col(vec), lambda x: x != 0))
    one = usable.groupBy(F.col(key).cast("string").alias("id")).agg(F.min(F.col(vec).cast("array<float>")).alias("vec"))
    one = materialize(one.select("id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(5), "vec").alias("h2")), "p3-vectors")
    # of equal vectors the k + 1 least ids are enough; they are found in two steps so that no copy group is gathered
    some = one.groupBy("h1", "h2", F.pmod(F.xxhash64("id"), F.lit(1024)).alias("salt")).agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("l"))
    few = some.groupBy("h1", "h2").agg(F.slice(F.array_sort(F.flatten(F.collect_list("l"))), 1, k + 1).alias("least"))
    few = materialize(few.withColumn("rep", F.col("least")[0]), "p3-copies")
    points = one.join(few.select("rep").withColumnRenamed("rep", "id"), "id", "left_semi").select(F.col("id").alias("rep"), "vec")
    points = materialize(points.mapInArrow(_as_bytes, "rep string, vec binary"), "p3-points")
    n = points.count()
    if n == 0:
        return spark.createDataFrame([], "id string, other string, sim double")
    factor = stop_factor(dimensions, confidence)
    drawn = points.select("vec") if n <= LAYOUT_ROWS else points.where(F.pmod(F.xxhash64("rep"), F.lit(n)) < LAYOUT_ROWS).select("vec")
    sample = _unit(np.frombuffer(b"".join(bytes(r[0]) for r in drawn.collect()), np.float32).reshape(-1, width))
    cells = max(1, min(-(-n // cell_rows), len(sample) // 8))
    top_bound, floor, enough = 2 - 2 * min_similarity, min_similarity - 1e-12, math.log(1 - confidence)
    matrices = [projection(width, dimensions, SEED + i) for i in range(2 * most_trees)]
    trees: list[Tree] = []

    def placed(shipped, first: int, last: int):
        """Each point once per tree, in its own cell; those that are open ask, too."""

        def run(batches):
            trees = shipped.value
            for b in batches:
                v = _unit(_matrix(b.column(1), width))
                asks = np.asarray(b.column(2).is_valid()).astype(np.int8)
                for t in range(first, last):
                    yield _rows(t * cells + _home(trees[t], v @ matrices[t]), b.column(0), b.column(1), b.column(2), asks * BOTH)

        return run

    def searched(batches):
        """The rows that ask in each cell against all that can be found there."""
        t = _task(batches)
        if t is None:
            return
        t = t.sort_by([("cell", "ascending"), ("rep", "ascending")]).combine_chunks()
        cell, role = t["cell"].to_numpy(), t["role"].to_numpy()
        number = t["rep"].combine_chunks().dictionary_encode().indices.to_numpy()
        begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        for lo, hi in zip(begin, np.r_[begin[1:], len(cell)], strict=True):
            own, r = t.slice(lo, hi - lo), role[lo:hi]
            at, q = np.flatnonzero(r != ASKS), np.flatnonzero(r != FOUND)
            if not len(at) or not len(q):
                continue
            v = _unit(_matrix(own["vec"].chunk(0), width))
            bound = own["bound"].to_numpy()
            same = number[lo:hi]
            best, where = search(v[at], same[at], v[q], same[q], bound[q], k, factor, matrices[int(cell[lo]) // cells], floor)
            i, j = np.nonzero(where >= 0)
            rep = own["rep"].chunk(0)
            yield pa.RecordBatch.from_arrays([rep.take(pa.array(q[i])), rep.take(pa.array(at[where[i, j]])), pa.array(best[i, j])], names=["rep", "other", "sim"])

    def unsettled(shipped, last: int):
        """(rep, bound) of the points whose stopping test doesn't hold after so many trees."""

        def run(batches):
            trees = shipped.value
            for b in batches:
                v, bound = _unit(_matrix(b.column(1), width)), b.column(2).to_numpy()
                chance = sum(log_cut_off(trees[t], v @ matrices[t], np.sqrt(np.maximum(bound, 0))) for t in range(last))
                yield b.filter(pa.array(chance > enough)).select([0, 2])

        return run

    def spread(shipped):
        """Each open point once for every cell of the first tree that its test radius touches."""

        def run(batches):
            (tree, *_) = shipped.value
            for b in batches:
                bound = b.column(2).to_numpy()
                for row, cell in _touches(tree, _unit(_matrix(b.column(1), width)) @ matrices[0], factor * bound):
                    pick = pa.array(row)
                    yield _rows(cell, b.column(0).take(pick), b.column(1).take(pick), bound[row], np.full(len(row), ASKS, np.int8))

        return run

    def counted(shipped):
        """Number of cells in reach, for each batch."""

        def run(batches):
            (tree, *_) = shipped.value
            for b in batches:
                pairs = _touches(tree, _unit(_matrix(b.column(1), width)) @ matrices[0], factor * b.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([sum(len(row) for row, _ in pairs)], pa.int64())], names=["pairs"])

        return run

    def looked_up(batches):
        """Rows sorted by cell, role and rep: a cell's points are held, those that ask pass in batches."""
        held, at = [], None
        for b in batches:
            cell, role = b.column(0).to_numpy(), b.column(4).to_numpy()
            begin = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (role[1:] != role[:-1])][: len(cell)])
            for lo, hi in zip(begin, np.r_[begin[1:], len(cell)], strict=False):
                part = b.slice(lo, hi - lo)
                if role[lo] == FOUND:
                    held, at = [*(held if at == cell[lo] else []), part], cell[lo]
                elif at == cell[lo]:
                    held = pa.Table.from_batches(held).combine_chunks().to_batches()
                    (own,) = held
                    number = pa.concat_arrays([own.column(1), part.column(1)]).dictionary_encode().indices.to_numpy()
                    best, where = search(_unit(_matrix(own.column(2), width)), number[: len(own)], _unit(_matrix(part.column(2), width)), number[len(own) :], part.column(3).to_numpy(), k, factor, matrices[0], floor)
                    i, j = np.nonzero(where >= 0)
                    yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(i)), own.column(1).take(pa.array(where[i, j])), pa.array(best[i, j])], names=["rep", "other", "sim"])

    def kept(hits: DataFrame) -> DataFrame:
        found = hits.groupBy("rep", "other").agg(F.max("sim").alias("sim"))
        rank = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc(F.round("sim", 12)), "other"))
        return found.withColumn("r", rank).where(F.col("r") <= k).drop("r")

    def visit(rows: DataFrame, n_rows: int) -> DataFrame:
        return rows.repartition(partitions_for(spark, n_rows, TASK_ROWS), "cell").mapInArrow(searched, _HIT_SCHEMA)

    def pairs_of(open_: DataFrame, n_open: int, shipped) -> int:
        """Cells that open points touch, all together; estimated where they are many."""
        some = open_.where(F.pmod(F.xxhash64("rep"), F.lit(n_open)) < LAYOUT_ROWS) if n_open > LAYOUT_ROWS else open_
        (r,) = points.join(some, "rep").select("rep", "vec", "bound").mapInArrow(counted(shipped), "pairs long").agg(F.sum("pairs").alias("pairs")).collect()
        return max(1, int((r.pairs or 0) * max(1.0, n_open / LAYOUT_ROWS)))

    def reached(open_: DataFrame, pairs: int, shipped) -> list[DataFrame]:
        """What open points find in every cell in reach of one tree, as a table for each portion of them."""
        portions, out = -(-pairs // (n * TREES[-1])), []
        for i in range(portions):
            own = open_.where(F.pmod(F.xxhash64(F.lit(3), "rep"), F.lit(portions)) == i) if portions > 1 else open_
            rows = points.select("rep", "vec", F.lit(None).cast("double").alias("bound")).mapInArrow(placed(shipped, 0, 1), _CELL_SCHEMA)
            rows = rows.union(points.join(own, "rep").select("rep", "vec", "bound").mapInArrow(spread(shipped), _CELL_SCHEMA))
            rows = rows.repartition(partitions_for(spark, n + pairs // portions, TASK_ROWS), "cell").sortWithinPartitions("cell", "role", "rep")
            out.append(materialize(kept(rows.mapInArrow(looked_up, _HIT_SCHEMA)), "p3-reached"))
        return out

    open_, n_open, best, turn, shipped, extra = points.select("rep", F.lit(float(top_bound)).alias("bound")), n, None, 0, None, 0
    while n_open:
        first, pairs = len(trees), 0
        if first >= most_trees:
            pairs = pairs_of(open_, n_open, shipped)
        over = first >= 2 * most_trees or 0 < pairs <= n * TREES[-1] + extra
        if over:
            # further trees cost more than every cell in reach of one tree
            found = reached(open_, pairs, shipped)
            best = materialize(kept(reduce(DataFrame.union, found, best)), "p3-best")
            if report is not None:
                report.append({"cells": cells, "asked": n_open, "trees": 0, "pairs": pairs, "portions": len(found)})
            break
        last = min(most_trees * (1 + (first >= most_trees)), first + TREES[min(turn, len(TREES) - 1)]) if cells > 1 else 1
        extra += n * (last - first) if pairs else 0
        trees += [layout(sample @ matrices[t], cells) for t in range(first, last)]
        if shipped is not None:
            shipped.unpersist()
        shipped = spark.sparkContext.broadcast(trees)
        asked = points.join(open_, "rep", "left").select("rep", "vec", "bound")
        new = visit(asked.mapInArrow(placed(shipped, first, last), _CELL_SCHEMA), n * (last - first))
        best = materialize(kept(new if best is None else new.union(best)), "p3-best")
        if report is not None:
            report.append({"cells": cells, "asked": n_open, "trees": last - first})
        if cells == 1:
            break
        bounds = best.groupBy("rep").agg(F.count("*").alias("c"), F.min("sim").alias("worst")).where(F.col("c") == k)
        bounds = bounds.select("rep", F.greatest(F.lit(0.0), F.least(F.lit(float(top_bound)), 2 - 2 * F.col("worst"))).alias("now"))
        left = asked.where(F.col("bound").isNotNull()).join(bounds, "rep", "left").select("rep", "vec", F.coalesce("now", "bound").alias("bound"))
        open_ = materialize(left.mapInArrow(unsettled(shipped, last), "rep string, bound double"), "p3-open")
        n_open, turn = open_.count(), turn + 1
    # classes: own copies and the least ids of the neighbours', best k + 1 of them; each member takes k others
    least = few.select(F.col("rep").alias("other"), "least")
    wide = best.join(least, "other").select("rep", "sim", F.explode("least").alias("other"))
    own = few.where((F.size("least") > 1) & F.lit(min_similarity <= 1)).select("rep", F.lit(1.0).alias("sim"), F.explode("least").alias("other"))
    wide = wide.union(own)
    listed = wide.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc(F.round("sim", 12)), "other"))).where(F.col("r") <= k + 1)
    member = one.join(few.select("h1", "h2", "rep"), ["h1", "h2"]).select("id", "rep")
    took = member.join(listed, "rep").where(F.col("id") != F.col("other"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("r"))
    return took.withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("sim") >= min_similarity)).select("id", "other", "sim")
