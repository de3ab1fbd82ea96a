"""Problem 7: evaluation texts leaking into training text.

Method: the normalised word n-grams of the test items form a hash set, which is broadcast as a bitmap of fixed size
whatever the number of items. Each training text is scanned once: its word windows are tested against the set, and those
that pass meet the items' n-grams by hash and are verified word by word. Leaked spans or documents can be removed.

Words are maximal runs of letters and digits, compared case-folded. The corpus is never shuffled, only the windows that
pass: with few items those that leak, with so many items that the bitmap fills more of them, but no hit is lost.
Defined cases: null texts and passages, and passages shorter than n words, have no case; items with equal passages
are all reported; repeated rows give one case; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presq.plans.shared import materialize

WORD = re.compile(r"[^\W_]+")
N = 13
#: Bits of the broadcast hash set, two for each n-gram.
SET_BITS = 27
#: Words whose hashes a worker remembers; beyond it memory starts anew. Results don't depend on it.
MEMORY_WORDS = 500_000
_BLOCK_BITS = 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def words(text: str) -> list[str]:
    """Case-folded words of a text."""
    folded = text.casefold()
    if len(folded) == len(text) and "\u0345" not in text:
        return WORD.findall(folded)
    return [w.casefold() for w in WORD.findall(text)]  # folding may add marks that would part a word


class _WordHashes(dict):
    """Hashes of words, the same in every process."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _windows(texts: list[list[str]], n: int, known: _WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, word) of every window of n words within a text."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    x = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.uint64, int(length.sum()))
    size = np.maximum(0, len(x) - n + 1)
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h = h * _BASE + x[k : size + k]
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    count = np.maximum(0, length - n + 1)
    text = np.repeat(np.arange(len(texts)), count)
    word = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return h[np.repeat(np.cumsum(length) - length, count) + word], text, word


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> _U(64 - bits)).astype(np.int64), ((h >> _U(8)) & _U((1 << bits) - 1)).astype(np.int64)


def _item_grams(n: int):
    """(h, item, gram) of every distinct window of each passage; the gram is its words."""

    def run(batches):
        known = _WordHashes()
        for b in batches:
            names = b.column(0).to_pylist()
            for at in range(0, b.num_rows, 500):
                own = [words(t) for t in b.column(1).slice(at, 500).to_pylist()]
                h, text, word = _windows(own, n, known)
                grams = [" ".join(own[t][w : w + n]) for t, w in zip(text.tolist(), word.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([names[at + t] for t in text.tolist()], pa.string()), pa.array(grams, pa.string())], names=["h", "item", "gram"])

    return run


def _bitmap(grams: DataFrame, bits: int) -> np.ndarray:
    """The set of the grams' hashes, put together in tasks, a block of bits each; 2^bits bits reach the driver."""

    def ends(batches):
        for b in batches:
            place = np.unique(np.concatenate(_places(b.column(0).to_numpy().view(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(place >> _BLOCK_BITS)], names=["place", "block"])

    def block(table: pa.Table) -> pa.Table:
        on = np.zeros(1 << _BLOCK_BITS, bool)
        on[table["place"].to_numpy() & ((1 << _BLOCK_BITS) - 1)] = True
        return pa.table({"block": table["block"].slice(0, 1), "bits": pa.array([np.packbits(on).tobytes()], pa.binary())})

    out = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (_BLOCK_BITS - 3)
    for r in grams.select("h").mapInArrow(ends, "place long, block long").distinct().groupBy("block").applyInArrow(block, "block long, bits binary").collect():
        out[r.block * size : (r.block + 1) * size] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _scanner(shipped, key: str, n: int, bits: int):
    """The windows of each text that the set may hold: (key, h, word, span_start, span_end, gram)."""

    def inside(held, place):
        return (held[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1

    def run(batches):
        held, known = shipped.value, _WordHashes()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, len(texts), 500):
                own = [words(t) for t in texts[at : at + 500]]
                h, text, word = _windows(own, n, known)
                first, second = _places(h, bits)
                hit = np.flatnonzero(inside(held, first))
                hit = hit[inside(held, second[hit]) == 1]
                if not len(hit):
                    continue
                spans, starts, ends, grams = {}, [], [], []
                for t, w in zip(text[hit].tolist(), word[hit].tolist(), strict=True):
                    if t not in spans:
                        spans = {t: [m.span() for m in WORD.finditer(texts[at + t])]}
                    starts.append(spans[t][w][0])
                    ends.append(spans[t][w + n - 1][1])
                    grams.append(" ".join(own[t][w : w + n]))
                cols = [keys.take(pa.array(at + text[hit])), pa.array(h[hit].view(np.int64)), pa.array(word[hit].astype(np.int32)), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(grams, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[key, "h", "_word", "span_start", "span_end", "_gram"])

    return run


def leaks(docs: DataFrame, items: DataFrame, n: int = N, set_bits: int = SET_BITS, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage") -> DataFrame:
    """(key, item, span_start, span_end): each maximal stretch of a text, as code point offsets, covered by windows
    of n words that also stand in the item's passage."""
    spark = docs.sparkSession
    key_type = docs.schema[key].dataType.simpleString()
    kept = items.where(F.col(passage).isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("string"), passage)
    grams = materialize(kept.mapInArrow(_item_grams(n), "h long, item string, gram string").distinct(), "p7-grams")
    shipped = spark.sparkContext.broadcast(_bitmap(grams, set_bits))
    scanned = docs.where(F.col(text).isNotNull()).select(key, text)
    schema = f"`{key}` {key_type}, h long, _word int, span_start int, span_end int, _gram string"
    found = scanned.mapInArrow(_scanner(shipped, key, n, set_bits), schema)
    # equal hashes are compared word by word
    g = grams.select(F.col("h").alias("_h"), F.col("item").alias(item), F.col("gram").alias("_item_gram"))
    hits = found.hint("merge").join(g, (F.col("h") == F.col("_h")) & (F.col("_gram") == F.col("_item_gram")))
    by = Window.partitionBy(key, item).orderBy("_word", "span_start")
    # windows that overlap or adjoin are one stretch
    new = F.coalesce(F.col("_word") > F.lag("_word").over(by) + n, F.lit(True))
    island = hits.select(key, item, "_word", "span_start", "span_end", new.cast("int").alias("_new")).withColumn("_island", F.sum("_new").over(by))
    return island.groupBy(key, item, "_island").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end")).drop("_island").distinct()


def leaked_items(found: DataFrame, item: str = "item_id", key: str = "doc_id") -> DataFrame:
    """Which items leaked, and into how many documents."""
    return found.select(item, key).distinct().groupBy(item).agg(F.count("*").alias("n_docs"))


def without_leaks(docs: DataFrame, found: DataFrame, mode: str = "document", key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that leak (mode document), or with the leaked spans cut out (mode span)."""
    if mode == "document":
        return docs.join(found.select(key).distinct(), key, "left_anti")
    if mode != "span":
        raise ValueError("mode is document or span")
    spans = found.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("span_start", "span_end"))).alias("_spans"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("kept"))
    # spans are met in order; what lies before each and after the last is kept
    step = F.aggregate(
        "_spans",
        start,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["span_end"]).alias("at"),
            F.when(s["span_start"] > acc["at"], F.concat(acc["kept"], F.col(text).substr(acc["at"] + 1, s["span_start"] - acc["at"]))).otherwise(acc["kept"]).alias("kept"),
        ),
        lambda acc: F.concat(acc["kept"], F.col(text).substr(acc["at"] + 1, F.length(text))),
    )
    cut = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(step)
    return docs.join(spans, key, "left").withColumn(text, cut).select(*docs.columns)
