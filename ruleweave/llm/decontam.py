"""Benchmark decontamination by spaced seeds.

Tokens are lower-cased words without the marks at their ends. A seed hashes the tokens at the 1s of a fixed mask and
ignores those at its 0s, so that it survives substitutions there. The seeds of the benchmark make one table; a bit table
of fixed size, in which each sets a few bits, tells nearly all of the documents' seeds from them. What passes it, with its
place, is joined with the benchmark's seeds by their hash; a hit fixes how document and item align. Each distinct alignment
is compared token by token over the whole item: the item counts as leaked if ``min_share`` of its tokens match in place,
or if some ``window`` tokens of it match but for a few substitutions (``min_window``). Items under 5 tokens are too short
to tell from chance; one leaks into a document that consists of just its tokens. Documents with one text are one text.

The bit table has the same size for any benchmark; the larger the benchmark, the more seeds pass it, and the join decides.

Cases: null or empty texts and items (or such of marks alone) neither leak nor match; items shorter than a mask use the
masks that fit; null ids are one id; repeated rows give one result row; ties (several alignments of an item) count by the
most matches; empty tables give empty results; other columns are carried along by ``decontaminate``, where names that
start with ``_dc_`` are reserved, and ignored by ``leaks``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import settle, small
from ruleweave.llm.textbatch import Words, mix, parts

MASKS = ("11111", "11011001", "10110011", "111010001")
LEAST = 5
#: Bits of the table that sorts out seeds, as a power of two: 16 MB. Each seed sets the bits named by these shifts.
BITS, SHIFTS = 27, (0, 27, 37, 13)
MARKS = " \t\n\r\x0b\x0c!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…–—¡¿"
_U = np.uint64


def tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts end to end, and where each text starts (one more than texts)."""
    words = Words(texts)
    bare = np.asarray([w.strip(MARKS).lower() for w in words.vocabulary.to_pylist()], dtype=object)
    if not len(bare):
        return np.zeros(0, _U), words.starts * 0
    hashed, real = pd.util.hash_array(bare, categorize=False), bare != ""
    keep = real[words.codes]
    return hashed[words.codes][keep], np.concatenate([[0], np.cumsum(keep)])[words.starts]


def seeds(t: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seed, place) of all seeds that lie within a text; a text of fewer than LEAST tokens has one, of all of them."""
    n = np.diff(starts)
    row = np.repeat(np.arange(len(n)), n)
    found, places = [], []
    for number, mask in enumerate(MASKS, 1):
        many = max(0, len(t) - len(mask) + 1)
        at = np.flatnonzero(row[:many] == row[len(mask) - 1 : len(mask) - 1 + many])
        seed = np.full(many, number, _U)
        for k, c in enumerate(mask):
            if c == "1":
                seed = mix(seed * _U(0x9E3779B97F4A7C15) + t[k : k + many])
        found.append(seed[at])
        places.append(at)
    for k in np.flatnonzero((n > 0) & (n < LEAST)):
        seed = np.full(1, len(MASKS) + 1, _U)
        for token in t[starts[k] : starts[k + 1]]:
            seed = mix(seed * _U(0x9E3779B97F4A7C15) + token)
        found.append(seed)
        places.append(starts[k : k + 1])
    return np.concatenate(found), np.concatenate(places)


def _lists(values: np.ndarray, row: np.ndarray, rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of ``values`` by their ``row`` (sorted), for the given ``rows``."""
    ends = np.concatenate([np.searchsorted(row, rows), [len(row)]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _blobs(t: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> pa.Array:
    return pa.array([t[starts[k] : starts[k + 1]].tobytes() for k in rows], pa.binary())


def item_rows(bench: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Settled rows (key, item, n, tokens, seeds, places): a row for each different item with tokens."""

    def run(batches):
        for batch in parts(batches, 2):
            t, starts = tokens(batch.column(2))
            seed, place = seeds(t, starts)
            row = np.searchsorted(starts, place, side="right") - 1
            order = np.argsort(row, kind="stable")
            seed, place, row = seed[order], place[order], row[order]
            rows = np.flatnonzero(np.diff(starts))
            own = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(np.diff(starts)[rows]), _blobs(t, starts, rows), _lists(seed.view(np.int64), row, rows, pa.int64()), _lists(place - starts[row], row, rows, pa.int64())], ["key", "item", "n", "tokens", "seeds", "places"])

    rows = bench.select(F.xxhash64(item_col, text_col).alias("key"), F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null").dropDuplicates(["key"])
    return settle(rows.mapInArrow(run, f"key long, item {rows.schema['item'].dataType.simpleString()}, n long, tokens binary, seeds array<long>, places array<long>"))


def bit_table(items: DataFrame) -> np.ndarray:
    """The bits that the items' seeds set, at most 2 ** BITS / 8 bytes."""
    seed, low = F.col("seed"), F.lit((1 << BITS) - 1)
    places = items.select(F.explode("seeds").alias("seed")).select(F.explode(F.array(*[F.shiftrightunsigned(seed, k).bitwiseAND(low) + 1 for k in SHIFTS])).alias("p"))
    rows = places.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    out = np.zeros(1 << BITS - 3, np.uint8)
    for r in rows:
        part = np.frombuffer(r["bits"], np.uint8)
        out[(r["b"] - 1) * 4096 : (r["b"] - 1) * 4096 + len(part)] = part
    return out


def passing(table: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Places of the seeds all of whose bits are set."""
    at = np.arange(len(seed))
    for shift in SHIFTS:
        p = (seed[at] >> _U(shift)) & _U((1 << BITS) - 1)
        at = at[(table[(p >> _U(3)).astype(np.int64)] >> (p & _U(7)).astype(np.uint8)) & 1 == 1]
    return at


def _text_key(text_col: str) -> dict[str, Column]:
    """128 bits that stand for a text."""
    return {"_dc_a": F.xxhash64(F.col(text_col)), "_dc_b": F.xxhash64(F.lit(1), F.col(text_col))}


def leaked_texts(docs: DataFrame, bench: DataFrame, text_col: str, item_col: str, item_text: str, min_share: float, window: int, min_window: int) -> DataFrame:
    """Settled rows (_dc_a, _dc_b, item, n_matched, n_tokens): different texts of ``docs`` and the items that leak into them."""
    items = item_rows(bench, item_col, item_text)
    table = docs.sparkSession.sparkContext.broadcast(bit_table(items))

    def search(batches):
        seen: set[tuple[int, int]] = set()
        for batch in parts(batches):
            t, starts = tokens(batch.column(0))
            seed, place = seeds(t, starts)
            at = passing(table.value, seed)
            seed, place = seed[at], place[at]
            row = np.searchsorted(starts, place, side="right") - 1
            order = np.argsort(row, kind="stable")
            seed, place, row = seed[order], place[order], row[order]
            rows = np.unique(row)
            keys = list(zip(batch.column(1).take(pa.array(rows)).to_pylist(), batch.column(2).take(pa.array(rows)).to_pylist(), strict=True))
            if len(seen) > 100_000:
                seen.clear()
            new = np.array([k not in seen and not seen.add(k) for k in keys], dtype=bool)
            rows, keep = rows[new], np.isin(row, rows[new])
            seed, place, row = seed[keep], place[keep], row[keep]
            own = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([own.column(1), own.column(2), pa.array(np.diff(starts)[rows]), _blobs(t, starts, rows), _lists(seed.view(np.int64), row, rows, pa.int64()), _lists(place - starts[row], row, rows, pa.int64())], ["_dc_a", "_dc_b", "n_text", "tokens", "seeds", "places"])

    def verify(batches):
        for batch in batches:
            a, b, n, n_text = (batch.column(k) for k in (5, 6, 3, 4))
            m, n, n_text = pc.binary_length(a).to_numpy().astype(np.int64) // 8, n.to_numpy(), n_text.to_numpy()
            same = np.frombuffer(b"".join(a.to_pylist()), _U) == np.frombuffer(b"".join(b.to_pylist()), _U)
            ends, run = np.cumsum(m), np.concatenate([[0], np.cumsum(same)])
            total = run[ends] - run[ends - m]
            best, owner = np.where(m < window, total, 0), np.repeat(np.arange(len(m)), m)
            begin = np.flatnonzero(np.arange(len(same)) + window <= np.repeat(ends, m))
            np.maximum.at(best, owner[begin], run[begin + window] - run[begin])
            ok = (total >= np.ceil(min_share * n)) | ((n >= window) & (best >= min_window))
            ok &= (n >= LEAST) | ((n == n_text) & (total == n))
            kept = batch.select(["_dc_a", "_dc_b", "key", "n"]).append_column("n_matched", pa.array(total))
            yield kept.filter(pa.array(ok))

    found = docs.select(F.col(text_col).alias("text"), *[c.alias(name) for name, c in _text_key(text_col).items()])
    found = found.mapInArrow(search, "_dc_a long, _dc_b long, n_text long, tokens binary, seeds array<long>, places array<long>")
    found = settle(found.dropDuplicates(["_dc_a", "_dc_b"]))
    hits = found.select("_dc_a", "_dc_b", "n_text", F.inline(F.arrays_zip(F.col("seeds").alias("seed"), F.col("places").alias("place"))))
    known = items.select("key", "n", F.inline(F.arrays_zip(F.col("seeds").alias("seed"), F.col("places").alias("item_place"))))
    aligned = hits.join(small(known), "seed").select("_dc_a", "_dc_b", "key", "n", "n_text", (F.col("place") - F.col("item_place")).alias("first")).distinct()
    # The tokens where document and item overlap, 8 bytes each.
    low, high = F.greatest(F.lit(0), "first"), F.least("n_text", F.col("first") + F.col("n"))
    both = aligned.join(found.select("_dc_a", "_dc_b", "tokens"), ["_dc_a", "_dc_b"]).join(small(items.select("key", F.col("tokens").alias("item_tokens"))), "key")
    sides = [F.substring(c, (8 * at + 1).cast("int"), (8 * (high - low)).cast("int")) for c, at in (("tokens", low), ("item_tokens", low - F.col("first")))]
    right = both.select("_dc_a", "_dc_b", "key", "n", "n_text", sides[0].alias("x"), sides[1].alias("y")).mapInArrow(verify, "_dc_a long, _dc_b long, key long, n long, n_matched long")
    return settle(right.join(small(items.select("key", "item")), "key").groupBy("_dc_a", "_dc_b", "item").agg(F.max("n_matched").alias("n_matched"), F.max("n").alias("n_tokens")))


def leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_share: float = 0.6, window: int = 13, min_window: int = 10) -> DataFrame:
    """One row per document id and leaked item: n_matched tokens in place, n_tokens of the item."""
    found = leaked_texts(docs, bench, text_col, item_col, item_text, min_share, window, min_window)
    rows = docs.select(F.col(id_col).alias("_dc_id"), *[c.alias(name) for name, c in _text_key(text_col).items()]).join(small(found), ["_dc_a", "_dc_b"])
    best = rows.groupBy("_dc_id", "item").agg(F.max("n_matched").alias("n_matched"), F.max("n_tokens").alias("n_tokens"))
    return best.select(F.col("_dc_id").alias(id_col), F.col("item").alias(item_col), "n_matched", "n_tokens")


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_share: float = 0.6, window: int = 13, min_window: int = 10) -> DataFrame:
    """``docs`` without those in which an item leaks."""
    found = leaked_texts(docs, bench, text_col, item_col, item_text, min_share, window, min_window).select("_dc_a", "_dc_b").distinct()
    return docs.withColumns(_text_key(text_col)).join(small(found), ["_dc_a", "_dc_b"], "left_anti").select(*docs.columns)
