"""Byte-level BPE token counts by merging all sequences of a batch in step, as ragged numpy arrays.

A batch's distinct pre-tokens are laid end to end as symbol ids. In each round every sequence finds its lowest-ranked
adjacent pair and merges all its occurrences, left to right, at once; a sequence without a mergeable pair is done, and
its surviving symbols are its count. This gives the library's merges because a pair made by a merge ranks after it, which
``Merges`` checks of the vocabulary. Pre-tokens of over ``LONG`` bytes, which would need as many rounds, are merged with
a heap in the same order instead.

Cases: a null or empty text has 0 tokens; special strings inside a text count as their one token, as the library does
it; null ids, repeated rows and ties give one output row for each input row; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.textbatch import parts

#: The published pre-token pattern of this vocabulary family.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG = 512
CACHED = 300_000
#: Characters of texts that are split at a time.
PART = 4 << 20
NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte in vocabularies of this family."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    by = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}
    return [by[b] for b in range(256)]


class Merges:
    """Merge table of a vocabulary file of the ``tokenizers`` library (byte-level, no normaliser)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocabulary = data["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
        self.width = len(vocabulary) + 1
        self.first = np.array([vocabulary[s] for s in byte_symbols()], dtype=np.int64)
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(pairs):
            if max(made.get(a, -1), made.get(b, -1)) >= rank or a + b in made:
                raise ValueError("a merge uses or makes a symbol out of rank order; such vocabularies need the heap for all")
            made[a + b] = rank
        keys = np.array([vocabulary[a] * self.width + vocabulary[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.result = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        self.special = [t["content"] for t in data.get("added_tokens", [])]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def merged_counts(tokens: list[bytes], merges: Merges) -> np.ndarray:
    """Symbols that survive all merges, for each byte string."""
    lengths = np.array([len(t) for t in tokens], dtype=np.int64)
    out, short = lengths.copy(), np.flatnonzero((lengths > 1) & (lengths <= LONG))
    for k in np.flatnonzero(lengths > LONG):
        out[k] = _heap_count(tokens[k], merges)
    if not len(short):
        return out
    sizes = lengths[short]
    ids = merges.first[np.frombuffer(b"".join(tokens[k] for k in short), dtype=np.uint8)]
    while True:
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        rank = np.full(len(ids), NONE)
        rank[:-1] = merges.rank(ids[:-1], ids[1:])
        rank[starts[1:] - 1] = NONE  # a pair never spans two sequences
        best = np.minimum.reduceat(rank, starts)
        open_ = best != NONE
        if not open_.any():
            return out
        hit = (rank == np.repeat(best, sizes)) & (rank != NONE)
        # In a row of overlapping occurrences (aaaa) every other one counts, from the left.
        place = np.arange(len(ids))
        head = np.where(hit & ~np.concatenate([[False], hit[:-1]]), place, -1)
        hit &= (place - np.maximum.accumulate(head)) % 2 == 0
        at = np.flatnonzero(hit)
        ids[at] = merges.result[rank[at]]
        keep = np.ones(len(ids), dtype=bool)
        keep[at + 1] = False
        sizes = np.add.reduceat(keep, starts, dtype=np.int64)
        out[short] = sizes
        going = open_ & (sizes > 1)
        keep &= np.repeat(going, np.diff(np.concatenate([starts, [len(ids)]])))
        ids, sizes, short = ids[keep], sizes[going], short[going]
        if not len(short):
            return out


def _heap_count(token: bytes, merges: Merges) -> int:
    """The same merges one by one, lowest rank and leftmost first."""
    ids = merges.first[np.frombuffer(token, dtype=np.uint8)]
    ranks = merges.rank(ids[:-1], ids[1:]).tolist()
    ids, n = ids.tolist(), len(ids)
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r != NONE]
    heapq.heapify(heap)
    count = n
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], right[i] = int(merges.result[r]), False, right[j]
        if right[i] < n:
            left[right[i]] = i
        count -= 1
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y < n:
                new = int(merges.rank(np.array([ids[x]]), np.array([ids[y]]))[0])
                if new != NONE:
                    heapq.heappush(heap, (new, x, ids[x], ids[y]))
    return count


@lru_cache(maxsize=2)
def _merges(path: str) -> Merges:
    return Merges(path)


class Counter:
    """Counts texts batch by batch; remembers the counts of up to ``CACHED`` pre-tokens."""

    def __init__(self, path: str):
        self.merges = _merges(path)
        self.find = regex.compile(PRE_TOKEN).findall
        self.special = regex.compile("|".join(map(regex.escape, self.merges.special))) if self.merges.special else None
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        out = []
        at = 0
        while at < len(texts):  # bounds the lists of pre-tokens
            to, size = at + 1, len(texts[at])
            while to < len(texts) and to - at < 1000 and size + len(texts[to]) <= PART:
                size += len(texts[to])
                to += 1
            out += self._count(texts[at:to])
            at = to
        return out

    def _count(self, texts: list[str]) -> list[int]:
        pieces, extra = [], []
        for text in texts:
            between = self.special.split(text) if self.special else [text]
            extra.append(len(between) - 1)
            pieces.append(self.find(between[0]) if len(between) == 1 else [x for p in between for x in self.find(p)])
        if len(self.known) > CACHED:
            self.known.clear()
        new = list({x for p in pieces for x in p if x not in self.known})
        self.known.update(zip(new, merged_counts([x.encode() for x in new], self.merges).tolist(), strict=True))
        return [sum(map(self.known.__getitem__, p)) + e for p, e in zip(pieces, extra, strict=True)]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens (long) and over_limit (n_tokens > ``limit``)."""

    def run(batches):
        counter = Counter(vocabulary)
        for batch in parts(batches, 1, size=4 << 20):
            n = pa.array(counter.count(batch.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
