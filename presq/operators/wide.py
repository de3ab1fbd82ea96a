"""All pairs of wide matrices: rows meet in blocks, and a task counts the alleles in common of its two blocks, so that
neither pairs nor alleles in common are ever shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presq.plans.index import with_index
from presq.plans.shared import drop_table, materialize
from presq.plans.ship import ship

#: Most rows of a block where every pair comes out and where few do, and most cells of a block.
BLOCK_ROWS = 3_000
NEAR_ROWS = 16_000
BLOCK_CELLS = 4_000_000
#: An allele that one of so many rows carries is a bit of a row's words; others are counted by lists of their carriers.
HOT_SHARE = 16
#: Pairs, and alleles in common counted one by one, that are worked out at once.
CHUNK = 200_000
CHUNK_COMMON = 2_000_000

_EVERY = "ga array<string>, ma array<int>, gb array<string>, mb array<int>, d array<int>"
_NEAR = "guid_a string, guid_b string, distance int"


def rows_of(frame, labels: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(_rank, row_idx, guid, mass, cells) of labels as a table, and the numbers of the hot alleles, sorted. _rank goes
    by row_idx; cells are numbers of alleles, without those that a single row carries."""
    ship(frame.spark)
    ranked = with_index(labels.where(F.col("row_idx").isNotNull()), "row_idx", "_rank")
    cells = materialize(frame.presence.join(ranked.select("guid", "_rank"), "guid").select("_rank", "allele"), "wide-cells")
    ids = with_index(cells.groupBy("allele").agg(F.count("*").alias("n")).where("n > 1"), "allele", "id")
    hot = ids.where(F.col("n") * HOT_SHARE > ranked.count()).select("id").toArrow()["id"].to_numpy()
    packed = cells.join(ids.select("allele", "id"), "allele", "left").groupBy("_rank").agg(F.count("*").alias("n"), F.collect_list("id").alias("cells"))
    own = [F.coalesce("n", F.lit(0)).cast("int").alias("mass"), F.coalesce("cells", F.array().cast("array<int>")).alias("cells")]
    rows = materialize(ranked.join(packed, "_rank", "left").select("_rank", "row_idx", "guid", *own), "wide-rows")
    drop_table(cells)
    return rows, np.sort(hot)


def _in_blocks(rows: DataFrame, least: int, most_rows: int, within: int | None) -> DataFrame:
    """rows in a partition for each two blocks i <= j, as _left in those of block i and not in those of block j. With
    within, _rank goes by the mass, and blocks whose masses differ by more don't meet."""
    n, mass = rows.agg(F.count("*"), F.coalesce(F.sum("mass"), F.lit(0))).first()
    blocks = max(least, -(-n // most_rows), -(-mass // BLOCK_CELLS))
    per = max(1, -(-n // blocks))
    rows = rows.withColumn("_b", F.floor(F.col("_rank") / per).cast("int"))
    reach = {b: (0, blocks - 1) for b in range(blocks)}
    if within is not None:
        ends = {r[0]: (r[1], r[2]) for r in rows.groupBy("_b").agg(F.min("mass"), F.max("mass")).collect()}
        for b, (low, high) in ends.items():
            met = [c for c, (lo, hi) in ends.items() if lo - high <= within and low - hi <= within]
            reach[b] = (min(met), max(met))
    reach = rows.sparkSession.createDataFrame([(b, *ends) for b, ends in reach.items()], "_b int, _first int, _last int")
    rows = rows.join(F.broadcast(reach), "_b")
    left = rows.withColumn("_j", F.explode(F.sequence("_b", "_last"))).withColumn("_i", F.col("_b")).withColumn("_left", F.lit(True))
    right = rows.withColumn("_i", F.explode(F.sequence("_first", "_b"))).withColumn("_j", F.col("_b")).withColumn("_left", F.lit(False))
    number = (F.col("_i") * blocks - F.expr("_i * (_i - 1) div 2") + F.col("_j") - F.col("_i")).cast("int")
    both = left.unionByName(right).select(number.alias("_k"), "_left", "_rank", "row_idx", "guid", "mass", "cells")
    return both.repartitionById(blocks * (blocks + 1) // 2, F.col("_k"))


class _Side:
    """The rows of one block: hot alleles as bits, the others by row."""

    def __init__(self, rows: pa.Table, hot: np.ndarray):
        rows = rows.sort_by("_rank").combine_chunks()
        self.n = rows.num_rows
        self.guid = pc.cast(rows["guid"].combine_chunks(), pa.string())
        self.rank, self.row, self.mass = (rows[c].to_numpy() for c in ("_rank", "row_idx", "mass"))
        cells = rows["cells"].combine_chunks()
        ids = cells.flatten().to_numpy()
        owner = np.repeat(np.arange(self.n), pc.list_value_length(cells).to_numpy(zero_copy_only=False))
        at = np.searchsorted(hot, ids)
        is_hot = np.zeros(len(ids), bool)
        is_hot[at < len(hot)] = hot[at[at < len(hot)]] == ids[at < len(hot)]
        bits = np.zeros((self.n, -(-len(hot) // 64) * 64), bool)
        bits[owner[is_hot], at[is_hot]] = True
        self.words = np.ascontiguousarray(np.packbits(bits, axis=1).view(np.uint64).T) if len(hot) else np.zeros((0, self.n), np.uint64)
        self.owner, self.ids = owner[~is_hot], ids[~is_hot]
        self.start = np.searchsorted(self.owner, np.arange(self.n + 1))


def _chunks(x: _Side, y: _Side):
    """(first, end, alleles in common) of portions of x's rows with all of y's rows."""
    order = np.argsort(y.ids, kind="stable")
    tokens, begin = np.unique(y.ids[order], return_index=True)
    carriers, ends = y.owner[order], np.append(begin, len(order))
    at = np.searchsorted(tokens, x.ids)
    known = np.flatnonzero(at < len(tokens))
    known = known[tokens[at[known]] == x.ids[known]]
    first, count = np.zeros(len(x.ids), np.int64), np.zeros(len(x.ids), np.int64)
    first[known] = ends[at[known]]
    count[known] = ends[at[known] + 1] - first[known]
    upto = np.append(0, np.cumsum(count))[x.start]
    a = 0
    while a < x.n:
        most = int(np.searchsorted(upto, upto[a] + CHUNK_COMMON, "right")) - 1
        end = max(a + 1, min(x.n, a + max(1, CHUNK // y.n), most))
        cell = slice(x.start[a], x.start[end])
        n = count[cell]
        which = np.repeat(first[cell] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(np.repeat((x.owner[cell] - a) * y.n, n) + carriers[which], minlength=(end - a) * y.n).reshape(end - a, y.n)
        for p, q in zip(x.words, y.words, strict=True):
            common += np.bitwise_count(p[a:end, None] & q)
        yield a, end, common
        a = end


def _one(values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _every(x: _Side, y: _Side):
    """The distances of each portion as one array, row by row; -1 where the pair isn't in matrix order."""
    mixed = x.row.max() >= y.row.min()
    for a, end, common in _chunks(x, y):
        d = (x.mass[a:end, None] + y.mass - 2 * common).astype(np.int32)
        if mixed:
            d[x.row[a:end, None] >= y.row] = -1
        columns = [x.guid[a:end], pa.array(x.mass[a:end]), y.guid, pa.array(y.mass), pa.array(d.ravel())]
        yield pa.RecordBatch.from_arrays([_one(c) for c in columns], ["ga", "ma", "gb", "mb", "d"])


def _near(x: _Side, y: _Side, within: int):
    """(guid_a, guid_b, distance) of the pairs within a distance."""
    guids, same = pa.concat_arrays([x.guid, y.guid]), x.rank[0] == y.rank[0]
    for a, end, common in _chunks(x, y):
        d = x.mass[a:end, None] + y.mass - 2 * common
        i, j = np.nonzero(d <= within)
        keep = x.row[a + i] != y.row[j]
        if same:
            keep &= a + i < j
        i, j = i[keep], j[keep]
        if len(i):
            later = x.row[a + i] > y.row[j]
            p, q = a + i, x.n + j
            names = [guids.take(pa.array(np.where(later, q, p))), guids.take(pa.array(np.where(later, p, q)))]
            yield pa.RecordBatch.from_arrays([*names, pa.array(d[i, j].astype(np.int32))], ["guid_a", "guid_b", "distance"])


def _meeting(hot: np.ndarray, within: int | None):
    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        for k in pc.unique(rows["_k"]):
            own = rows.filter(pc.equal(rows["_k"], k))
            x, y = own.filter(own["_left"]), own.filter(pc.invert(own["_left"]))
            if x.num_rows and y.num_rows:
                x, y = _Side(x, hot), _Side(y, hot)
                yield from _every(x, y) if within is None else _near(x, y, within)

    return run


def every_pair(frame, labels: DataFrame, least: int) -> DataFrame:
    """(guid_a, guid_b, mass_a, mass_b, distance) of every pair of labels in matrix order, in at least so many blocks."""
    rows, hot = rows_of(frame, labels)
    met = _in_blocks(rows, least, BLOCK_ROWS, None).mapInArrow(_meeting(hot, None), _EVERY)
    met = met.select("*", F.posexplode("d").alias("_p", "distance")).where("distance >= 0")
    a, b = F.expr("int(_p div size(gb))"), F.expr("_p % size(gb)")
    return met.select(F.get("ga", a).alias("guid_a"), F.get("gb", b).alias("guid_b"), F.get("ma", a).alias("mass_a"), F.get("mb", b).alias("mass_b"), "distance")


def near_pairs(frame, n: int, least: int) -> DataFrame:
    """(guid_a, guid_b, distance) of the pairs within n, in at least so many blocks."""
    rows, hot = rows_of(frame, frame.labels)
    rows = with_index(rows.drop("_rank"), "mass", "_rank")
    return _in_blocks(rows, least, NEAR_ROWS, n).mapInArrow(_meeting(hot, n), _NEAR)
