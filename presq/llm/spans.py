"""Problem 8: long exact spans shared between records.

Method: level-wise doubling. Windows of a quarter of the length, picked so that every window of full length holds
one at a place that its own text decides, are looked up first; those that repeat in another record are extended to
twice the length on either side, which narrows the full windows that may be shared; these are looked up last. Where
all full windows around a picked one agree with another record's, one hash settles them together.

Lengths double from a quarter of the full one to the full one, where the question is decided: longer spans are unions
of full windows. Levels move hashes and offsets, packed as bytes by column, and never texts. Copies within a batch of
records are combined before the exchange, and a window frequent within a batch skips the middle levels, so hot passages
don't pile up in a task.

Equal hashes only claim that texts are equal. Each window found keeps the place of another record's that it was taken
to be equal to, and in the end the texts of all such stretches, a record's and the other's, are compared by their
SHA-256 digests. Where a claim fails, hashes have met by chance: its windows are looked up in all texts by digest, and
so is what was held equal to them. Failures too many to be looked up (REPAIR_BYTES) make the search begin anew with
other hash values.
Offsets count code points. Defined cases: null texts and ids, and texts shorter than the length, have no span;
repeats within one record alone aren't shared; equal texts are shared whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presq.plans.shared import drop_table, materialize, partitions_for, scan_bytes

#: Characters hashed at a time; a longer text makes its batch longer.
BATCH_CHARS = 2_000_000
#: A first-level window with more differing surroundings than this within a batch skips the middle levels.
BATCH_HOT = 64
TASK_ROWS = 500_000
#: Hashes of failed windows that are broadcast at most; some claims fail beyond 10^12 characters, a few windows each.
REPAIR_BYTES = 8 << 20
#: Searches with other hash values before giving up.
SEEDS = 4
#: The optimiser's size of what it can't tell is beyond this.
UNKNOWN = 1 << 60
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
FULL, DONE, OPEN, GIVER, HOT = 0, 1, 2, 3, 4


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


@lru_cache(maxsize=1)
def _letters(seed: int) -> np.ndarray:
    return _mix(np.arange(0x110000, dtype=np.uint64) + _U(0x1234567 + (seed << 24)))


class _Batch:
    """Texts of a batch as one array of code points, with hashes of any window."""

    def __init__(self, texts: pa.Array, seed: int):
        raw = pa.concat_arrays([texts]) if texts.offset else texts
        offsets = np.frombuffer(raw.buffers()[1], np.int64 if pa.types.is_large_string(raw.type) else np.int32, len(raw) + 1)
        body = memoryview(raw.buffers()[2] or b"")[offsets[0] : offsets[-1]]
        data = np.frombuffer(body, np.uint8)
        begins = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=begins[1:])
        self.starts = begins[offsets - offsets[0]]
        points = np.frombuffer(str(body, "utf-8").encode("utf-32-le"), np.uint32)
        self.n = len(points)
        pw, self.inverse = _powers(1 << max(16, int(self.n).bit_length()))
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_letters(seed)[points] * pw[: self.n], out=self.sums[1:])

    def rolling(self, length: int) -> np.ndarray:
        return (self.sums[length:] - self.sums[:-length]) * self.inverse[: max(0, self.n - length + 1)]

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def _sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """Least value of each span by doubling."""
    m, w = x, 1
    while w * 2 <= span:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return np.minimum(m[: len(m) - (span - w)], m[span - w :]) if span > w else m


def _repeated(key: np.ndarray, doc: np.ndarray, given: np.ndarray | None = None) -> np.ndarray:
    """For each row, whether its key is with two different docs, or on a row where given holds."""
    if not len(key):
        return np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    k, d = key[order], doc[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    many = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
    if given is not None:
        many |= np.logical_or.reduceat(given[order], first)
    out = np.empty(len(k), bool)
    out[order] = np.repeat(many, np.diff(np.r_[first, len(k)]))
    return out


def _partners(key: np.ndarray, doc: np.ndarray, at: np.ndarray, given: np.ndarray, pdoc: np.ndarray, pat: np.ndarray):
    """For each row whether its key is with two different docs or on a row where given holds, and the doc and place of
    another doc's row of the key; that of the given row if there is no other doc's."""
    n = len(key)
    if not n:
        return np.zeros(0, bool), pdoc, pat
    order = np.lexsort((doc, key))
    k = key[order]
    new = np.r_[True, k[1:] != k[:-1]]
    first = np.flatnonzero(new)
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(new) - 1
    low, high = order[first], order[np.r_[first[1:], n] - 1]
    many = (doc[low] != doc[high])[group]
    other = np.where(doc != doc[low][group], low[group], high[group])
    says = np.full(len(first), -1)
    says[group[given]] = np.flatnonzero(given)
    says = says[group]
    told = ~many & (says >= 0)
    told_doc, told_at = pdoc[says], pat[says]
    return many | told, np.where(many, doc[other], np.where(told, told_doc, -1)), np.where(many, at[other], np.where(told, told_at, -1))


def _firsts(key: np.ndarray) -> np.ndarray:
    """Places of the first row of each key."""
    return np.unique(key, return_index=True)[1]


def _batches(batches, chars: int):
    """The columns of batches of about so many characters; texts are the second."""
    held, size = [], 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            step = b.slice(at, 256)
            held.append(step)
            size += step.column(1).nbytes
            at += 256
            if size >= chars:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    t = pa.Table.from_batches(held).combine_chunks()
    return [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in t.columns]


_PACKED_SCHEMA = "part int, rows binary"
_PICK = {"key": "i8", "ctx": "i8", "left": "i8", "right": "i8", "doc": "i8", "at": "i4", "lo": "i2", "hi": "i2", "state": "i1", "pdoc": "i8", "shift": "i4"}


def _packed(cols: list[np.ndarray], types: dict[str, str], parts: int):
    """Rows as bytes, column by column, one for each part of the exchange: the first column's hash bits name the part."""
    part = (_mix(cols[0].view(np.uint64)) % _U(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    used = np.flatnonzero(np.diff(bounds))
    cols = [c[order].astype(t) for c, t in zip(cols, types.values(), strict=True)]
    blobs = [b"".join(c[bounds[p] : bounds[p + 1]].tobytes() for c in cols) for p in used.tolist()]
    for at in range(0, len(used), 64):
        yield pa.RecordBatch.from_arrays([pa.array(used[at : at + 64].astype(np.int32)), pa.array(blobs[at : at + 64], pa.binary())], names=["part", "rows"])


def _unpacked(batches, types: dict[str, str]) -> dict[str, np.ndarray] | None:
    """All rows of a task by column; tasks are sized to hold them."""
    width = sum(np.dtype(t).itemsize for t in types.values())
    held: dict[str, list[np.ndarray]] = {c: [] for c in types}
    for b in batches:
        for blob in b.column(1):
            raw = blob.as_buffer()
            n, at = raw.size // width, 0
            for c, t in types.items():
                held[c].append(np.frombuffer(raw, t, n, at))
                at += n * np.dtype(t).itemsize
    return {c: np.concatenate(x) for c, x in held.items()} if held[next(iter(types))] else None


def _picker(length: int, k: int, hot: int, seed: int, parts: int):
    """First level: each picked window with the hashes of its surroundings and the full windows [at - lo, at - hi] that hold it."""

    def run(batches):
        for keys, texts in _batches(batches, BATCH_CHARS):
            docs = keys.to_numpy(zero_copy_only=False).astype(np.int64)
            b = _Batch(texts, seed)
            if b.n < length:
                continue
            order = ((b.rolling(k) * _U(0xC4CEB9FE1A85EC53)) >> _U(32)) << _U(32)
            order |= np.arange(len(order), dtype=np.uint64)
            low = (_sliding_min(order, length - k + 1) & _U(0xFFFFFFFF)).astype(np.int64)
            size = np.diff(b.starts)
            # full windows that begin in a text and stay within it
            mark = np.zeros(b.n + 1, np.int32)
            fits = size >= length
            np.add.at(mark, b.starts[:-1][fits], 1)
            np.add.at(mark, (b.starts[1:] - length + 1)[fits], -1)
            ok = np.cumsum(mark[: len(low)]) > 0
            change = np.r_[True, low[1:] != low[:-1]] | np.r_[True, ~ok[:-1]]
            first = np.flatnonzero(ok & change)
            if not len(first):
                continue
            last = np.flatnonzero(ok & np.r_[change[1:] | ~ok[1:], True])
            at = low[first]
            row = np.searchsorted(b.starts, at, "right") - 1
            begin, end = b.starts[row], b.starts[row + 1]
            core = b.at(at, at + k)
            ctx = b.at(first, last + length) ^ _mix((at - first).astype(np.uint64) * _U(1 << 20) + (last - first).astype(np.uint64))
            # a side that leaves the text gets a hash of its own place: it never repeats
            own = _mix(docs[row].astype(np.uint64) * _U(_BASE) + (at - begin).astype(np.uint64))
            left = np.where(at - k >= begin, b.at(np.maximum(at - k, 0), at + k), own)
            right = np.where(at + 2 * k <= end, b.at(at, np.minimum(at + 2 * k, b.n)), ~own)
            d = docs[row]
            state = np.full(len(at), FULL, np.int8)
            # copies within the batch are settled here; one of them goes on for the rest
            none = np.full(len(at), -1)
            twin, pdoc, pat = _partners(ctx, d, at - begin, np.zeros(len(at), bool), none, none)
            shift = np.where(twin, pat - (at - begin), 0)
            lead = np.zeros(len(at), bool)
            lead[_firsts(ctx)] = True
            state[twin & ~lead] = DONE
            state[twin & lead] = GIVER
            # too many different surroundings: one mark for the other batches, the rest skip to the last level
            go = np.flatnonzero(~twin)
            u, inv, n = np.unique(core[go], return_inverse=True, return_counts=True)
            much = n[inv] > hot
            state[go[much]] = OPEN
            marks = go[np.flatnonzero(much)[_firsts(core[go][much])]] if much.any() else go[:0]
            pick = np.r_[np.arange(len(at)), marks]
            state = np.r_[state, np.full(len(marks), HOT, np.int8)]
            key = core[pick].copy()
            free = (state == DONE) | (state == OPEN)
            key[free] = own[pick][free]
            out = [key.view(np.int64), ctx[pick].view(np.int64), left[pick].view(np.int64), right[pick].view(np.int64), d[pick], (at - begin)[pick], (at - first)[pick], (at - last)[pick], state, pdoc[pick], shift[pick]]
            yield from _packed(out, _PICK, parts)

    return run


def _whole(batches, names):
    """All rows of a task as arrays by name; tasks are sized to hold them."""
    t = pa.Table.from_batches(batches)
    return {c: t[c].to_numpy() for c in names}


_RANGE_SCHEMA = "doc long, lo int, hi int, state byte, pdoc long, shift int"


def _narrow(length: int, k: int):
    """Middle levels: settles, narrows or drops the full windows [lo, hi] around each picked window."""

    def run(batches):
        x = _unpacked(batches, _PICK)
        if x is None:
            return
        state, doc, at = x["state"], x["doc"], x["at"].astype(np.int64)
        pdoc, shift = x["pdoc"].copy(), x["shift"].astype(np.int64)
        lo, hi = at - x["lo"].astype(np.int64), at - x["hi"].astype(np.int64)
        out = np.full(len(at), -1, np.int8)
        out[state == DONE] = DONE
        out[state == OPEN] = OPEN
        live = np.flatnonzero((state == FULL) | (state == GIVER) | (state == HOT))
        many = state[live] == GIVER
        hot = _repeated(x["key"][live], np.zeros(len(live), np.int8), state[live] == HOT)
        live, many, hot = (v[_repeated(x["key"][live], doc[live], many) | hot] for v in (live, many, hot))
        real = state[live] != HOT
        live, many, hot = live[real], many[real], hot[real]
        left = _repeated(x["left"][live], doc[live], many) | hot
        right = _repeated(x["right"][live], doc[live], many) | hot
        settled, other, place = _partners(x["ctx"][live], doc[live], at[live], many, pdoc[live], at[live] + shift[live])
        pdoc[live], shift[live] = np.where(settled, other, -1), np.where(settled, place - at[live], 0)
        lo[live] = np.where(left, lo[live], np.maximum(lo[live], at[live] - k + 1))
        hi[live] = np.where(right, hi[live], np.minimum(hi[live], at[live] - (length - 2 * k) - 1))
        full_lo, full_hi = at - x["lo"].astype(np.int64), at - x["hi"].astype(np.int64)
        lo[live[settled]], hi[live[settled]] = full_lo[live[settled]], full_hi[live[settled]]
        out[live[settled]] = DONE
        rest = live[~settled & (lo[live] <= hi[live])]
        out[rest] = OPEN
        # settled windows go on, once per surroundings, where an open one shares a side with them
        sides = np.r_[x["left"][rest], x["right"][rest]]
        also = live[settled]
        near = np.isin(x["left"][also], sides) | np.isin(x["right"][also], sides) | (hot[settled])
        also = also[near]
        also = also[_firsts(x["ctx"][also])]
        keep = np.flatnonzero(out >= 0)
        # a giver stands for copies that are settled already: its own row is settled too
        pick = np.r_[keep, also]
        st = np.r_[out[keep], np.full(len(also), GIVER, np.int8)]
        cols = [doc[pick], lo[pick].astype(np.int32), hi[pick].astype(np.int32), st, pdoc[pick], shift[pick].astype(np.int32)]
        for s in range(0, len(pick), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[s : s + 200_000]) for c in cols], names=["doc", "lo", "hi", "state", "pdoc", "shift"])

    return run


_WINDOW = {"hash": "i8", "doc": "i8", "lo": "i4", "hi": "i4", "state": "i1", "pdoc": "i8", "shift": "i4"}


def _runs(doc: np.ndarray, lo: np.ndarray, pdoc: np.ndarray, shift: np.ndarray):
    """(row of the first, last place) of each run of consecutive places with one partner and shift; rows are in order."""
    new = np.r_[True, (doc[1:] != doc[:-1]) | (lo[1:] != lo[:-1] + 1) | (pdoc[1:] != pdoc[:-1]) | (shift[1:] != shift[:-1])]
    first = np.flatnonzero(new)
    return first, lo[np.r_[first[1:], len(lo)] - 1]


def _windows(length: int, seed: int, parts: int):
    """Last level: the hash of every open full window; copies within the batch are settled, as runs of windows."""

    def run(batches):
        for keys, texts, spans in _batches(batches, BATCH_CHARS):
            docs = keys.to_numpy(zero_copy_only=False).astype(np.int64)
            b = _Batch(texts, seed)
            count = np.diff(spans.offsets.to_numpy())
            flat = spans.flatten()
            row = np.repeat(np.arange(len(docs)), count)
            lo, hi, st, pd, sh = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("lo", "hi", "state", "pdoc", "shift"))
            n = hi - lo + 1
            total = int(n.sum())
            if not total:
                continue
            which = np.repeat(np.arange(len(n)), n)
            start = lo[which] + np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            r = row[which]
            g = b.starts[r] + start
            h = b.at(g, g + length)
            d, giver = docs[r], st[which] == GIVER
            twin, pdoc, pat = _partners(h, d, start, giver, pd[which], start + sh[which])
            shift = np.where(twin, pat - start, 0)
            lead = np.zeros(total, bool)
            lead[_firsts(h)] = True
            done, extra, open_ = np.flatnonzero(twin & ~giver), np.flatnonzero(twin & lead), np.flatnonzero(~twin)
            done = done[np.lexsort((start[done], d[done]))]
            first, last = _runs(d[done], start[done], pdoc[done], shift[done]) if len(done) else (done, done)
            pick = np.r_[done[first], open_, extra]
            end = np.r_[last, start[open_], start[extra]]
            state = np.repeat(np.array([DONE, OPEN, GIVER], np.int8), [len(first), len(open_), len(extra)])
            yield from _packed([h[pick].view(np.int64), d[pick], start[pick], end, state, pdoc[pick], shift[pick]], _WINDOW, parts)

    return run


_FOUND = ["doc", "s", "e", "pdoc", "shift"]
_FOUND_SCHEMA = "doc long, s int, e int, pdoc long, shift int"


def _settle(length: int):
    """Full windows that repeat, as stretches of their texts, each with the place that it repeats."""

    def run(batches):
        x = _unpacked(batches, _WINDOW)
        if x is None:
            return
        state, shift, lo, hi = x["state"], x["shift"].astype(np.int64), x["lo"].astype(np.int64), x["hi"].astype(np.int64)
        met = np.flatnonzero(state != DONE)
        found, other, place = _partners(x["hash"][met], x["doc"][met], lo[met], state[met] == GIVER, x["pdoc"][met], lo[met] + shift[met])
        pdoc = x["pdoc"].copy()
        pdoc[met], shift[met] = other, place - lo[met]
        hit = state == DONE
        hit[met[found & (state[met] == OPEN)]] = True
        doc, s, e, pdoc, shift = _merged(x["doc"][hit], lo[hit], hi[hit] + 1, pdoc[hit], shift[hit])
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(s.astype(np.int32)), pa.array((e - 1 + length).astype(np.int32)), pa.array(pdoc), pa.array(shift.astype(np.int32))], names=_FOUND)

    return run


def _merged(doc: np.ndarray, s: np.ndarray, e: np.ndarray, pdoc: np.ndarray, shift: np.ndarray):
    """Stretches of overlapping or adjoining intervals of one doc, partner and shift each."""
    if not len(doc):
        return doc, s, e, pdoc, shift
    order = np.lexsort((shift, pdoc, doc))
    new = np.r_[True, (doc[order][1:] != doc[order][:-1]) | (pdoc[order][1:] != pdoc[order][:-1]) | (shift[order][1:] != shift[order][:-1])]
    group = np.empty(len(doc), np.int64)
    group[order] = np.cumsum(new) - 1
    g, s, e = _merge(group, s, e)
    first = order[np.flatnonzero(new)][g]
    return doc[first], s, e, pdoc[first], shift[first]


def _merge(doc: np.ndarray, s: np.ndarray, e: np.ndarray):
    """Stretches of overlapping or adjoining intervals of each doc."""
    if not len(doc):
        return doc, s, e
    order = np.lexsort((s, doc))
    doc, s, e = doc[order], s[order], e[order]
    new_doc = np.r_[True, doc[1:] != doc[:-1]]
    shift = (np.cumsum(new_doc) - 1) * np.int64(1 << 32)
    top = np.maximum.accumulate(e + shift)
    first = np.flatnonzero(new_doc | np.r_[True, (s + shift)[1:] > top[:-1]])
    last = np.r_[first[1:], len(doc)] - 1
    return doc[first], s[first], top[last] - shift[last]


def _stretches(batches):
    """Each doc's stretches (pdoc is null), and its stretches by the place that they repeat."""
    held = list(batches)
    if not held:
        return
    x = _whole(held, _FOUND)
    s, e = x["s"].astype(np.int64), x["e"].astype(np.int64)
    claims = _merged(x["doc"], s, e, x["pdoc"], x["shift"].astype(np.int64))
    doc, s, e = _merge(x["doc"], s, e)
    none = np.zeros(len(doc), np.int64)
    for cols, whole in (((doc, s, e, none, none), True), (claims, False)):
        d, s, e, p, h = cols
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(p, mask=np.full(len(d), whole)), pa.array(h.astype(np.int32))], names=_FOUND)


def _digests(batches):
    """(doc, s, e, digest): the SHA-256 of each stretch asked for."""
    for b in batches:
        doc, at, end, out = [], [], [], []
        for d, text, places in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            for p in places:
                doc.append(d)
                at.append(p["s"])
                end.append(p["e"])
                out.append(hashlib.sha256(text[p["s"] : p["e"]].encode("utf-8", "surrogatepass")).digest())
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(end, pa.int32()), pa.array(out, pa.binary())], names=["doc", "s", "e", "digest"])


def _failed(texts: DataFrame, claims: DataFrame) -> DataFrame:
    """Those of claims(doc, s, e, pdoc, shift) whose stretch doesn't have the text of the place that it is said to repeat."""
    there = claims.select("doc", "s", "e", "pdoc", "shift", (F.col("s") + F.col("shift")).alias("ps"), (F.col("e") + F.col("shift")).alias("pe"))
    # a place that many records repeat is hashed once
    places = there.select("doc", "s", "e").union(there.select("pdoc", "ps", "pe")).distinct()
    asked = places.groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("places"))
    known = materialize(texts.join(asked, "doc").select("doc", "text", "places").mapInArrow(_digests, "doc long, s int, e int, digest binary"), "p8-digests")
    own = there.join(known.withColumnRenamed("digest", "own"), ["doc", "s", "e"], "left")
    other = known.select(F.col("doc").alias("pdoc"), F.col("s").alias("ps"), F.col("e").alias("pe"), F.col("digest").alias("other"))
    same = F.coalesce(F.col("own") == F.col("other"), F.lit(False))
    out = materialize(own.join(other, ["pdoc", "ps", "pe"], "left").where(~same).select("doc", "s", "e", "pdoc", "shift"), "p8-failed")
    drop_table(known)
    return out


def _hashes_of(length: int, seed: int):
    """The hash of every full window of each stretch."""

    def run(batches):
        for _, texts, places in _batches(batches, BATCH_CHARS):
            b = _Batch(texts, seed)
            out = []
            for begin, own in zip(b.starts.tolist(), places.to_pylist(), strict=False):
                for p in own:
                    at = begin + np.arange(p["s"], p["e"] - length + 1)
                    out.append(b.at(at, at + length).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)))], names=["hash"])

    return run


def _lookup(length: int, seed: int, shipped):
    """(digest, doc, s) of every full window whose hash is asked for."""

    def run(batches):
        wanted = shipped.value
        for keys, texts in _batches(batches, BATCH_CHARS):
            b = _Batch(texts, seed)
            docs, held = keys.to_pylist(), texts.to_pylist()
            doc, at, out = [], [], []
            for i, text in enumerate(held):
                start = b.starts[i] + np.arange(len(text) - length + 1)
                h = b.at(start, start + length).view(np.int64)
                place = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                for s in np.flatnonzero(wanted[place] == h).tolist():
                    doc.append(docs[i])
                    at.append(s)
                    out.append(hashlib.sha256(text[s : s + length].encode("utf-8", "surrogatepass")).digest())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(doc, pa.int64()), pa.array(at, pa.int32())], names=["digest", "doc", "s"])

    return run


def _repaired(texts: DataFrame, failed: DataFrame, length: int, seed: int) -> DataFrame | None:
    """(doc, s, e) of the windows of failed stretches, and of windows equal to them, that other records have too."""
    asked = failed.groupBy("doc").agg(F.collect_set(F.struct("s", "e")).alias("places"))
    hashes = materialize(texts.join(asked, "doc").select("doc", "text", "places").mapInArrow(_hashes_of(length, seed), "hash long").distinct(), "p8-asked")
    if hashes.count() * 8 > REPAIR_BYTES:
        return None
    wanted = texts.sparkSession.sparkContext.broadcast(np.sort(hashes.toArrow()["hash"].to_numpy()))
    met = materialize(texts.select("doc", "text").mapInArrow(_lookup(length, seed, wanted), "digest binary, doc long, s int"), "p8-met")
    many = met.groupBy("digest").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("digest")
    return met.join(many, "digest", "left_semi").select("doc", "s", (F.col("s") + length).alias("e"))


def shared_spans(docs: DataFrame, length: int = 160, key: str = "doc_id", text: str = "text", batch_hot: int = BATCH_HOT, task_rows: int = TASK_ROWS) -> DataFrame:
    """(doc_id, span_start, span_end) of docs(key: a whole number, unique; text)."""
    if length < 4:
        raise ValueError("length is at least 4")
    spark, k = docs.sparkSession, length // 4
    long_enough = docs.where(F.col(key).isNotNull() & (F.length(text) >= length)).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    # about one window in (length - k + 2) / 2 characters is picked; files hold texts at a third of their size
    chars = 3 * scan_bytes(docs)
    if chars >= UNKNOWN:
        chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    picked = chars * 2 // (length - k + 2)
    for seed in range(SEEDS):
        n = partitions_for(spark, picked, task_rows)
        first = long_enough.mapInArrow(_picker(length, k, batch_hot, seed, n), _PACKED_SCHEMA)
        ranges = materialize(first.repartitionById(n, F.col("part")).mapInArrow(_narrow(length, k), _RANGE_SCHEMA), "p8-ranges")
        done = ranges.where(F.col("state") == DONE).select("doc", F.col("lo").alias("s"), (F.col("hi") + length).alias("e"), "pdoc", "shift")
        open_ = ranges.where(F.col("state") != DONE)
        windows = open_.agg(F.sum(F.col("hi") - F.col("lo") + 1)).first()[0] or 0
        by_doc = open_.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi", "state", "pdoc", "shift")).alias("spans"))
        n = partitions_for(spark, windows, task_rows)
        again = long_enough.join(by_doc, "doc").select("doc", "text", "spans").mapInArrow(_windows(length, seed, n), _PACKED_SCHEMA)
        found = again.repartitionById(n, F.col("part")).mapInArrow(_settle(length), _FOUND_SCHEMA)
        merged = done.union(found).repartition(partitions_for(spark, picked // 4, task_rows), "doc").mapInArrow(_stretches, _FOUND_SCHEMA)
        merged = materialize(merged, "p8-stretches")
        drop_table(ranges)
        whole = merged.where(F.col("pdoc").isNull())
        claims = merged.where(F.col("pdoc").isNotNull())
        failed = _failed(long_enough, claims)
        if not failed.isEmpty():
            again = _repaired(long_enough, failed, length, seed + SEEDS)
            if again is None:
                drop_table(merged)
                continue
            # records with a failure are put together anew from what holds and what was looked up
            none = [F.lit(0).cast("long").alias("pdoc"), F.lit(0).alias("shift")]
            kept = claims.join(failed, ["doc", "s", "e", "pdoc", "shift"], "left_anti")
            new = kept.union(again.select("doc", "s", "e", *none))
            merged = new.repartition(partitions_for(spark, picked // 4, task_rows), "doc").mapInArrow(_stretches, _FOUND_SCHEMA)
            whole = merged.where(F.col("pdoc").isNull())
        return whole.select(F.col("doc").alias("doc_id"), F.col("s").alias("span_start"), F.col("e").alias("span_end"))
    raise RuntimeError("too many hashes of different texts met, with every seed")


def shared_share(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """How much of each record is shared elsewhere; null texts have 0 of 0 characters."""
    held = spans.groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count("*").alias("n_spans"))
    size = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars"))
    zero = F.lit(0).cast("long")
    return size.join(held, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("shared_chars", zero).alias("shared_chars"))
