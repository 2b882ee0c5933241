"""Quality of whole texts by a generalised additive model with pairwise interactions over surface measurements.

The model is fitted on at most ``max_train`` labelled rows (those with the least hash of the id); each batch of texts is
then measured and scored as one numpy matrix. Cases: a null or empty text is scored by its
features, which are all 0; null ids are scored and never train; labels with a null id or label are ignored, and an id
with both labels trains twice; without labels, or with one class only, the score is constant; repeated rows and ties give
one output row for each input row; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.additive_model import AdditiveModel, fit
from ruleweave.llm.common import held_out
from ruleweave.llm.textbatch import Words, parts

FEATURES = ("log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "bangs", "stops", "other_marks", "newlines", "non_ascii", "gaps", "distinct_words", "top_word", "next_equal", "pairs_again", "line_bytes")

_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!", b".", b",;:?'\"()[]{}=+-_/\\@~^`", b"\n"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 8
_CLASS[list(b" \t\r\x0b\x0c")] = 9


def _kinds(data: np.ndarray, offsets: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Bytes of each class in each text, a bounded run of bytes at a time."""
    rows = len(offsets) - 1
    out = np.zeros(rows * 10, np.int64)
    for a in range(0, len(data), step):
        b = min(len(data), a + step)
        first, last = np.searchsorted(offsets, (a, b - 1), side="right") - 1
        many = np.minimum(offsets[first + 1 : last + 2], b) - np.maximum(offsets[first : last + 1], a)
        row = np.repeat(np.arange(last - first + 1), many)
        out[first * 10 : (last + 1) * 10] += np.bincount(row * 10 + _CLASS[data[a:b]], minlength=(last - first + 1) * 10)
    return out.reshape(rows, 10)


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    rows = len(texts)
    if not rows:
        return np.zeros((0, len(FEATURES)))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + rows + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    kinds = _kinds(data, offsets - offsets[0])
    words = Words(texts)
    n, at = words.counts(), words.rows()
    per_word = lambda x: x / np.maximum(n, 1)
    key = at * max(1, len(words.vocabulary)) + words.codes
    seen, times = np.unique(key, return_counts=True)
    seen_row = seen // max(1, len(words.vocabulary))
    distinct = np.bincount(seen_row, minlength=rows)
    top = np.zeros(rows)
    np.maximum.at(top, seen_row, times)
    same_row = at[1:] == at[:-1]
    equal = np.bincount(at[1:][same_row & (words.codes[1:] == words.codes[:-1])], minlength=rows)
    h = words.hashes()
    two = (h[1:] * np.uint64(3) + h[:-1])[same_row]
    pair_key = np.stack([at[1:][same_row], two.view(np.int64)], 1) if len(two) else np.zeros((0, 2), np.int64)
    order = np.lexsort((pair_key[:, 1], pair_key[:, 0]))
    pair_key = pair_key[order]
    again = np.bincount(pair_key[1:][(pair_key[1:] == pair_key[:-1]).all(1)][:, 0], minlength=rows)
    per_byte = lambda x: x / np.maximum(size, 1)
    return np.stack(
        [np.log1p(size), np.log1p(n), per_word(size - kinds[:, 9] - kinds[:, 7]), *[per_byte(kinds[:, k]) for k in (1, 2)], *[per_word(kinds[:, k]) for k in (3, 4, 5, 6, 7)], per_byte(kinds[:, 8]), per_byte(kinds[:, 9]), per_word(distinct), per_word(top), per_word(equal), per_word(again), size / (kinds[:, 7] + 1.0)],
        axis=1,
    )


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id: str = "doc_id", max_train: int = 20_000) -> AdditiveModel:
    """Model from at most ``max_train`` labelled rows outside the held-out fold, least hash of the id first."""

    def run(batches):
        for batch in parts(batches):
            x = features(batch.column(0))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([flat, batch.column(1), batch.column(2)], ["f", "label", "at"])

    known = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").distinct()
    chosen = known.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "label").limit(max_train)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").select("text", "label", F.xxhash64("id", "label").alias("at"))
    got = sample.mapInArrow(run, "f array<double>, label int, at long").orderBy("at").limit(max_train).collect()
    x = np.array([r["f"] for r in got], dtype=float).reshape(len(got), len(FEATURES))
    return fit(x, np.array([r["label"] for r in got], dtype=float))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= threshold)."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, id_col, text_col, **options))

    def run(batches):
        for batch in parts(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(features(batch.column(1))))], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """``docs``, with all their columns, without the documents that score below ``threshold``."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, id_col, text_col, **options))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in parts(batches, at):
            yield batch.filter(pa.array(model.value.score(features(batch.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
