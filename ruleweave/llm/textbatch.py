"""Whole Arrow batches of texts as flat numpy arrays of words, hashes and shingles."""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that gives freed memory back, where it has one."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def release() -> None:
    """Give freed memory back to the system: Python workers are used again by later stages, which would add to it."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def parts(batches, text: int = 0, rows: int = 2000, size: int = 2 << 20):
    """The batches cut to at most ``rows`` rows and, but for single longer texts, ``size`` bytes of the column ``text``."""
    try:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
                yield batch.slice(at, to - at)
                at = to
    finally:
        release()


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a batch: ``starts`` (one more than rows), ``codes`` into ``vocabulary``."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if not isinstance(texts, pa.Array):
            texts = pa.array([], pa.string())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.ascii_split_whitespace(texts)
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        real = np.asarray(pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False), dtype=bool)
        self.starts = np.concatenate([[0], np.cumsum(real)]).astype(np.int64)[offsets - offsets[0]]
        coded = flat.filter(pa.array(real)).dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # Lower-casing A-Z after the split may leave equal words with two codes, but they hash alike.
        self.vocabulary = pc.ascii_lower(coded.dictionary) if lower else coded.dictionary

    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every process."""
        if not len(self.vocabulary):
            return np.zeros(0, _U)
        return pd.util.hash_array(np.asarray(self.vocabulary.to_pylist(), dtype=object), categorize=False)[self.codes]


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows and the starts of each row; a shorter row gives one window of all it has."""
    n, h = words.counts(), words.hashes()
    windows = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(windows)])
    total = int(starts[-1])
    out = np.zeros(total, _U)
    if not total:
        return out, starts
    row = np.repeat(np.arange(len(n)), windows)
    at = words.starts[:-1][row] + np.arange(total) - starts[:-1][row]
    if len(h) >= width:  # a hash for each place of the batch, of which those within a row are taken
        every = np.zeros(len(h) - width + 1, _U)
        for k in range(width):
            every = mix(every * _U(0x9E3779B97F4A7C15) + h[k : k + len(every)] + _U(k + 1))
        out = every[np.minimum(at, len(every) - 1)]
    short = np.flatnonzero(n[row] < width)
    at, left = at[short], n[row[short]]
    part = np.zeros(len(short), _U)
    for k in range(width):
        nxt = h[np.minimum(at + k, len(h) - 1)]
        part = np.where(left > k, mix(part * _U(0x9E3779B97F4A7C15) + nxt + _U(k + 1)), part)
    out[short] = part
    return out, starts
