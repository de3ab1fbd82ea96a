"""Problem 6: encoding of the whole corpus with a public byte-level BPE tokenizer.

Method: a segment tree over the byte positions of a word holds the leftmost minimum pair rank; each merge updates
the leaves of the merged pair and of its two live neighbours in logarithmic time. Words are the tokenizer's own
pre-tokens, so an unbroken word of any length costs n log n. Ids of words that recur are remembered per worker.

Defined cases: null and empty texts give an empty list; a text is encoded whole, special-token strings in it as
ordinary text; every row keeps its key; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed pattern of the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words a worker remembers; beyond it memory starts anew. Results don't depend on it.
MEMORY_WORDS = 150_000
#: "\x1c".."\x1f" are spaces here but not to the pattern; they only make the parts longer.
_GAP = re.compile(r"(?<=\S)(?= \S)")
#: Parts longer than this many characters are hardly ever met again.
_LONG = 64
_NONE = 1 << 62


def load_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its id on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def bpe(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the leftmost pair of least rank is merged until no pair has a rank."""
    n = len(word)
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if n == 1:
        raise ValueError(f"byte {word!r} isn't in the vocabulary")
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    end = list(range(1, n + 1))  # end of the part that begins at a position
    prev = list(range(-1, n - 1))
    get = ranks.get
    for i in range(n - 1):
        r = get(word[i : i + 2])
        if r is not None:
            tree[size + i] = r << 32 | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            value = a if a < b else b
            if tree[k] == value:
                break
            tree[k] = value
            k >>= 1

    def rank(i: int) -> int:
        j = end[i]
        if j >= n:
            return _NONE
        r = get(word[i : end[j]])
        return _NONE if r is None else r << 32 | i

    while (top := tree[1]) != _NONE:
        i = top & 0xFFFFFFFF
        j = end[i]
        end[i] = after = end[j]
        if after < n:
            prev[after] = i
        put(j, _NONE)
        put(i, rank(i))
        if (p := prev[i]) >= 0:
            put(p, rank(p))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class _Memory(dict):
    """Ids by key, found out on first use and forgotten all at once when there are too many keys."""

    def __init__(self, find, limit: int):
        super().__init__()
        self.find, self.limit = find, limit

    def __missing__(self, key: str):
        ids = self.find(key)
        if len(key) <= _LONG:
            if len(self) >= self.limit:
                self.clear()
            self[key] = ids
        return ids


class Encoder:
    """Encodes texts with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, memory: int = MEMORY_WORDS):
        self.ranks, self.words = ranks, regex.compile(pattern)
        self.known = _Memory(lambda w: tuple(bpe(w.encode(), ranks)), memory)
        self.pieces = _Memory(self._piece, memory)
        self.spaced = _Memory(lambda p: None if not p or p[0].isspace() or p[-1].isspace() else self._piece(" " + p), memory)

    def _piece(self, piece: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.known.__getitem__, self.words.findall(piece))))

    def parts(self, text: str) -> list[tuple[int, ...]]:
        """Ids of the parts of a text. A single space between two visible characters always begins a word, so a
        text may be split there; other spaces stay within a part."""
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            got = list(map(self.spaced.__getitem__, rest))
            if None not in got:
                return [self.pieces[first], *got]
        return list(map(self.pieces.__getitem__, _GAP.split(text)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.parts(text)))


@lru_cache(maxsize=4)
def _encoder(raw: bytes, pattern: str) -> Encoder:
    return Encoder(load_ranks(raw), pattern)


def encode_corpus(docs: DataFrame, vocabulary: str | Path, key: str = "doc_id", text: str = "text", pattern: str = PATTERN) -> DataFrame:
    """(key, ids) of every row of docs; vocabulary is the path of a rank file, read on the driver (fixed, about 1 MB)."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches):
        parts = _encoder(shipped.value, pattern).parts
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [np.fromiter(chain.from_iterable(parts(t)) if t else (), np.int32) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {key_type}, ids array<int>")
