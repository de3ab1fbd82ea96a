"""Problem 1: all similar pairs between set-valued records.

Method: size-aware overlap join. A similarity threshold t asks of a record of s tokens that it shares k of its
s - ceil(t s) + k rarest tokens with any partner that reaches t. That turns the similarity join into an overlap
join with the small threshold k: records whose rare part is small enumerate its k-token subsets (k is 2) and meet
in a common subset; records whose rare part is large scan the inverted lists of its tokens. The union of both is
filtered by a bit signature that bounds the overlap, then by the exact similarity. The full overlap that the similarity
asks for can't be enumerated: at 0.7 two sets of 70 share 58 tokens, and 70 tokens have more than 10^13 such subsets.

A subset travels as its rarest token with the tokens after it, so a record costs as many rows as its rare part has
tokens. Where the rarest token is hot, its subsets are spread by their second token. A key of more than KEY_ROWS rows
all the same is cut into blocks, and each two blocks meet in a task of their own. Equal sets are joined once, by
a representative. Tokens are ordered by a frequency sketch of at most 64 MB, which is broadcast with the keys cut.

Defined cases: null records or tokens hold no cell; repeated cells count once; records without a cell take no part;
similarity equal to the threshold is included; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presq.llm.sets import classes, frequency, level, reaches, sketch
from presq.plans.shared import drop_table, materialize, partitions_for

#: Rare parts of more tokens than this scan inverted lists instead of enumerating subsets.
SMALL_PART = 64
#: Tokens of at least this many records spread their subsets by the second token.
HOT_TOKEN = 20_000
TASK_ROWS = 1_000_000
#: Rows of one key that meet in one task.
KEY_ROWS = 50_000
PAIRS_AT_ONCE = 2_000_000
WORDS = 4
_M = np.uint64(0xD6E8FEB86659FD93)


def _floors(threshold: Fraction, size: np.ndarray) -> np.ndarray:
    """ceil(threshold * size)."""
    return -((-threshold.numerator * size) // threshold.denominator)


def _hash(x: np.ndarray) -> np.ndarray:
    x = x.view(np.uint64) if x.dtype == np.int64 else x
    x = (x ^ (x >> np.uint64(32))) * _M
    return x ^ (x >> np.uint64(29))


def _signatures(tokens: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Parity of the tokens in each of 256 places: places that differ are at most the tokens that differ."""
    place = (_hash(tokens) >> np.uint64(56)).astype(np.int64)
    odd = (np.bincount(row * 256 + place, minlength=n * 256) & 1).astype(np.uint8).reshape(n, 256)
    return np.packbits(odd, axis=1).view(np.uint64)


_SCHEMA = "key long, token long, rest array<int>, id long, size int, side byte, kind byte, " + ", ".join(f"w{i} long" for i in range(WORDS))
_NAMES = ["key", "token", "rest", "id", "size", "side", "kind"] + [f"w{i}" for i in range(WORDS)]


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


def _rare_parts(shipped, threshold: Fraction, k: int, small: int, hot: int, any_large: bool):
    """Rows of each record's rare part: side 0 for the subsets of small ones, 1 for scanned lists of large ones, 2 for
    places of small ones in lists that their subsets don't visit, 3 for records that need fewer than k common tokens."""
    short = _short(threshold) if k > 1 else 0

    def run(batches):
        counts = shipped.value
        for b in batches:
            for at in range(0, b.num_rows, 4000):
                part = b.slice(at, 4000)
                yield from one(part, counts)

    def one(b, counts):
        lists = b.column(2)
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy()
        n = len(size)
        row = np.repeat(np.arange(n), size)
        sign = _signatures(flat, row, n)
        ids = b.column(0).to_numpy()
        kind = b.column(1).to_numpy()
        f = frequency(counts, flat)
        order = np.lexsort((_hash(flat), f, row))
        flat, f, row = flat[order], f[order], row[order]
        begin = np.cumsum(size) - size
        rank = np.arange(len(flat)) - begin[row]
        reach = np.minimum(size, size - _floors(threshold, size) + k)
        # a token that one record alone has can't be shared; the sketch may only overestimate
        use = (rank < reach[row]) & (f > 1)
        flat, f, row = flat[use], f[use], row[use]
        length = np.bincount(row, minlength=n)
        begin = np.cumsum(length) - length
        pos = np.arange(len(flat)) - begin[row]
        after = length[row] - 1 - pos
        little = (_hash(flat) >> np.uint64(32)).astype(np.uint32).view(np.int32)

        def rows(pick, key, rest_offsets, rest, side):
            r = row[pick]
            cols = [pa.array(key), pa.array(flat[pick]), _lists(rest_offsets, rest), pa.array(ids[r]), pa.array(size[r].astype(np.int32)), pa.array(np.full(len(pick), side, np.int8)), pa.array(kind[r])]
            cols += [pa.array(sign[r, w].view(np.int64)) for w in range(WORDS)]
            return pa.RecordBatch.from_arrays(cols, names=_NAMES)

        def suffixes(pick):
            c = after[pick]
            off = np.r_[0, np.cumsum(c)]
            at = np.repeat(pick + 1, c) + np.arange(off[-1]) - np.repeat(off[:-1], c)
            return off, at

        large = length[row] > small
        heavy = f >= level(hot)
        if k == 1:
            pick = np.flatnonzero(~large)
            yield rows(pick, flat[pick], np.zeros(len(pick) + 1, np.int64), little[:0], 0)
        else:
            pick = np.flatnonzero(~large & ~heavy & (after > 0))
            off, at = suffixes(pick)
            yield rows(pick, flat[pick], off, little[at], 0)
            pick = np.flatnonzero(~large & heavy & (after > 0))
            if len(pick):
                off, at = suffixes(pick)
                each = np.repeat(pick, np.diff(off))
                key = (_hash(flat[each]) ^ (_hash(flat[at]) * np.uint64(3))).view(np.int64)
                yield rows(each, key, np.arange(len(each) + 1), little[at], 0)
        single = {1: large, 2: ~large & heavy & (k > 1) & any_large, 3: size[row] <= short}
        for side, which in single.items():
            pick = np.flatnonzero(which)
            if len(pick):
                yield rows(pick, flat[pick], np.zeros(len(pick) + 1, np.int64), little[:0], side)

    return run


def _pairs(first: np.ndarray, count: np.ndarray):
    """All i < j within groups of consecutive rows, some two million at a time."""
    group = np.flatnonzero(count > 1)
    first, count = first[group], count[group]
    row = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    later = np.repeat(first + count, count) - row - 1
    done = np.cumsum(later)
    at = 0
    while at < len(row):
        stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        r, c = row[at:stop], later[at:stop]
        i = np.repeat(r, c)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        at = stop


_PAIR_SCHEMA = "a long, b long"


def _scans(large: np.ndarray, first: np.ndarray, count: np.ndarray):
    """Each row of large with all rows of its group, some two million pairs at a time."""
    done = np.cumsum(count)
    at = 0
    while at < len(large):
        stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        c = count[at:stop]
        yield np.repeat(large[at:stop], c), np.repeat(first[at:stop], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        at = stop


def _candidates(threshold: Fraction, k: int):
    """Pairs of records that share a subset, or a list of a large one, and whose signatures allow the threshold."""
    p, q = threshold.numerator, threshold.denominator

    def fit(x, i, j):
        """Pairs that differ and that sizes and signatures allow; strains are never paired."""
        a, b = x["id"][i], x["id"][j]
        s, t = x["size"][i].astype(np.int64), x["size"][j].astype(np.int64)
        ok = (a != b) & ((x["kind"][i] == 0) | (x["kind"][j] == 0)) & (np.minimum(s, t) * q >= np.maximum(s, t) * p)
        i, j, s, t = i[ok], j[ok], s[ok], t[ok]
        apart = np.zeros(len(i), np.int64)
        for w in range(WORDS):
            apart += np.bitwise_count(x[f"w{w}"][i] ^ x[f"w{w}"][j])
        # overlap >= p/(p+q) (s+t) means at most (s+t)(q-p)/(q+p) tokens differ
        ok = apart * (q + p) <= (s + t) * (q - p)
        return i[ok], j[ok]

    def run(batches):
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        del held
        x = {c: t[c].to_numpy() for c in _NAMES if c != "rest"}
        for w in range(WORDS):
            x[f"w{w}"] = x[f"w{w}"].view(np.uint64)
        rest = t["rest"].chunk(0) if t["rest"].num_chunks else None
        seen: list[np.ndarray] = []

        def emit(i, j, last=False):
            """Pairs found, without repeats, once there are enough of them."""
            a, b = x["id"][i], x["id"][j]
            if len(a):
                seen.append(_distinct(np.minimum(a, b), np.maximum(a, b)))
            if seen and (last or sum(map(len, seen)) > PAIRS_AT_ONCE):
                got = np.concatenate(seen)
                seen.clear()
                got = _distinct(got[:, 0], got[:, 1])
                for s in range(0, len(got), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(got[s : s + 200_000, 0]), pa.array(got[s : s + 200_000, 1])], names=["a", "b"])

        small = np.flatnonzero(x["side"] == 0)
        if len(small):
            if k > 1:
                lens = rest.value_lengths().to_numpy(zero_copy_only=False)[small].astype(np.int64)
                offs = rest.offsets.to_numpy()[small].astype(np.int64)
                vals = rest.values.to_numpy()
                row = np.repeat(small, lens)
                val = vals[np.repeat(offs, lens) + np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)]
                order = np.lexsort((val, x["token"][row]))
                row, val = row[order], val[order]
                new = np.r_[True, (val[1:] != val[:-1]) | (x["token"][row][1:] != x["token"][row][:-1])] if len(row) else np.zeros(0, bool)
            else:
                row = small[np.argsort(x["token"][small], kind="stable")]
                new = np.r_[True, x["token"][row][1:] != x["token"][row][:-1]]
            first = np.flatnonzero(new)
            for i, j in _pairs(first, np.diff(np.r_[first, len(row)])):
                yield from emit(*fit(x, row[i], row[j]))
        short = np.flatnonzero(x["side"] == 3)
        if len(short):
            row = short[np.argsort(x["token"][short], kind="stable")]
            first = np.flatnonzero(np.r_[True, x["token"][row][1:] != x["token"][row][:-1]])
            for i, j in _pairs(first, np.diff(np.r_[first, len(row)])):
                yield from emit(*fit(x, row[i], row[j]))
        large = np.flatnonzero(x["side"] == 1)
        if len(large):
            order = np.argsort(x["token"], kind="stable")
            key = x["token"][order]
            is_large = np.flatnonzero(x["side"][order] == 1)
            first, last = np.searchsorted(key, key[is_large], "left"), np.searchsorted(key, key[is_large], "right")
            for i, j in _scans(is_large, first, last - first):
                yield from emit(*fit(x, order[i], order[j]))
        none = np.zeros(0, np.int64)
        yield from emit(none, none, True)

    return run


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    return np.stack([a[new], b[new]], 1)


def _blocks(parts: DataFrame, key_rows: int) -> DataFrame:
    """parts with the keys of more than key_rows rows cut: a row goes to each pair of blocks that its own block is in."""
    hot = parts.groupBy("key").count().where(F.col("count") > key_rows)
    # at most a key for every key_rows rows
    hot = materialize(hot.select("key", F.ceil(F.col("count") / key_rows).cast("int").alias("blocks")), "p1-hot")
    if hot.isEmpty():
        return parts
    own = F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")
    met = parts.join(F.broadcast(hot), "key", "left").withColumn("o", own)
    met = met.withColumn("q", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    cut = lambda c: F.when(F.col("blocks").isNull(), F.col(c)).otherwise(F.xxhash64(c, F.least("o", "q"), F.greatest("o", "q"))).alias(c)
    return met.select(*[cut(c) if c in ("key", "token") else c for c in parts.columns])


def similar_classes(sets: DataFrame, threshold: str = "7/10", subset: int = 2, small_part: int = SMALL_PART, hot_token: int = HOT_TOKEN, task_rows: int = TASK_ROWS, key_rows: int = KEY_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of equal sets: similar pairs (rep_a, kind_a, rep_b, kind_b) of two different ones, once; the members
    (rep, id, kind) of those with copies; and all (rep, kind). Copies aren't expanded into pairs."""
    spark, t = sets.sparkSession, Fraction(threshold)
    if not 0 < t <= 1 or subset not in (1, 2):
        raise ValueError("threshold is in (0, 1], subset is 1 or 2")
    sets = materialize(sets.where(F.size("tokens") > 0), "p1-sets")
    reps, members = classes(sets, "p1-members")
    reps = materialize(reps.withColumn("num", F.xxhash64("rep", "kind")), "p1-reps")
    n_rows = reps.agg(F.sum(F.size("tokens")).alias("t"), F.max(F.size("tokens")).alias("m")).first()
    top = np.array([n_rows.m or 0])
    counts = spark.sparkContext.broadcast(sketch(reps, n_rows.t or 0))
    any_large = bool((top - _floors(t, top) + subset)[0] > small_part)
    parts = materialize(reps.select("num", "kind", "tokens").mapInArrow(_rare_parts(counts, t, subset, small_part, hot_token, any_large), _SCHEMA), "p1-parts")
    n = partitions_for(spark, (n_rows.t or 0) // 2, task_rows)
    pairs = materialize(_blocks(parts, key_rows).repartition(n, "key").mapInArrow(_candidates(t, subset), _PAIR_SCHEMA).distinct(), "p1-pairs")
    drop_table(parts)
    left = reps.select(F.col("num").alias("a"), F.col("rep").alias("rep_a"), F.col("kind").alias("kind_a"), F.col("tokens").alias("ta"))
    right = reps.select(F.col("num").alias("b"), F.col("rep").alias("rep_b"), F.col("kind").alias("kind_b"), F.col("tokens").alias("tb"))
    near = pairs.join(left, "a").join(right, "b").where(reaches("ta", "tb", t)).select("rep_a", "kind_a", "rep_b", "kind_b")
    return near, members, reps.select("rep", "kind")


def linked(sets: DataFrame, threshold: str = "7/10", **options) -> DataFrame:
    """(id, kind, class_id, n_links) of every record: the least id among its equal sets, and how many similar partners
    it has. The links of copies are counted by class, so their number never grows with the square of a class."""
    near, members, reps = similar_classes(sets, threshold, **options)
    near = materialize(near, "p1-near")
    sizes = reps.join(members.groupBy("rep", "kind").agg(F.count("*").alias("c")), ["rep", "kind"], "left").select("rep", "kind", F.coalesce("c", F.lit(1)).alias("c"))
    ends = near.union(near.select("rep_b", "kind_b", "rep_a", "kind_a"))
    of = sizes.select(F.col("rep").alias("rep_b"), F.col("kind").alias("kind_b"), F.col("c").alias("partners"))
    other = ends.join(of, ["rep_b", "kind_b"]).groupBy(F.col("rep_a").alias("rep"), F.col("kind_a").alias("kind")).agg(F.sum("partners").alias("n"))
    twins = F.when(F.col("kind") == 0, F.col("c") - 1).otherwise(0)
    per = sizes.join(other, ["rep", "kind"], "left").select("rep", "kind", (F.coalesce("n", F.lit(0)) + twins).cast("long").alias("n_links"))
    return per.join(members, ["rep", "kind"], "left").select(F.coalesce("id", "rep").alias("id"), "kind", F.col("rep").alias("class_id"), "n_links")


def similar_pairs(sets: DataFrame, threshold: str = "7/10", **options) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of sets(id, kind, tokens) whose similarity reaches the threshold, a fraction.

    Pairs of two records of kind 1 are left out: kind 0 is joined with itself and with kind 1. Options are those of
    similar_classes. All pairs among copies are listed; linked() gives each record's class and number of links instead.
    """
    near, members, _ = similar_classes(sets, threshold, **options)
    # copies: a representative's pairs hold for its members, and the members of a class are pairs themselves
    ma = members.select(F.col("rep").alias("rep_a"), F.col("kind").alias("kind_a"), F.col("id").alias("id_a"))
    mb = members.select(F.col("rep").alias("rep_b"), F.col("kind").alias("kind_b"), F.col("id").alias("id_b"))
    out = near.join(ma, ["rep_a", "kind_a"], "left").join(mb, ["rep_b", "kind_b"], "left")
    out = out.select(F.coalesce("id_a", "rep_a").alias("x"), F.coalesce("id_b", "rep_b").alias("y"))
    twins = members.where("kind = 0").select("rep", F.col("id").alias("x")).join(members.where("kind = 0").select("rep", F.col("id").alias("y")), "rep").where(F.col("x") < F.col("y")).select("x", "y")
    both = out.union(twins)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a < id_b").distinct()


def _short(t: Fraction) -> int:
    """Largest record for which one common token may be enough: its partners may need an overlap below two."""
    s = 1
    while _floors(t, np.array([s + 1]))[0] < 2:
        s += 1
    return s


__all__ = ["linked", "similar_classes", "similar_pairs"]
