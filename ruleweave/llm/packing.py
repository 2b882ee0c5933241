"""Best-fit packing planned over the histogram of lengths.

Documents become pieces of at most ``capacity`` tokens. Only the count of pieces of each length reaches the driver (at
most ``capacity`` numbers). ``plan`` runs best-fit decreasing on these counts: open sequences with the same free space
form one group with a count, so a step places many pieces of a length at once, and its cost doesn't depend on the number
of documents. The plan is a list of runs (length, first rank, count, first sequence, offset); the piece with rank r
within its length takes slot r by a join of rank with runs. Ranks are dealt over salts, so that no length, however
frequent, is sorted by one task.

Cases: a null or empty text is one piece of just the end token; null ids and repeated rows are packed as often as they
come; ties in length are ranked in any order; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import settle
from ruleweave.llm.textbatch import Words, parts

#: Bytes of distinct words that an ``Encoder`` remembers, with their ids.
CACHED = 24 << 20
#: Parts that all pieces are dealt over, besides one more for each length.
SALTS = 16_384


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over ``counts`` (pieces by length): runs (length, first rank, count, first sequence, offset).

    Runs of one length have adjoining ranks from 0, and sequences are numbered from 0 without gaps. A group of sequences
    with equal free space is kept as ranges of sequence numbers; the length that fits tightest fills a whole range at a
    time, so there are at most as many runs as lengths plus splits of ranges, whatever the counts are.
    """
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # space -> ranges (first sequence, count)
    present = np.zeros(capacity + 1, dtype=bool)
    runs, opened = [], 0
    for length in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            fits = np.flatnonzero(present[length:])
            if len(fits):
                space = length + int(fits[0])
                first, many = free[space].pop()
                present[space] = bool(free[space])
            else:
                # New sequences: as many as hold all that is left, each filled as far as this length goes.
                space, first, many = capacity, opened, -(-left // (capacity // length))
                opened += many
            take = min(left, many)
            runs.append((length, rank, take, first, capacity - space))
            rank, left = rank + take, left - take
            if space - length > 0:
                free[space - length].append((first, take))
                present[space - length] = True
            if take < many:
                free[space].append((first + take, many - take))
                present[space] = True
    return runs


#: What ``Encoder`` relies on; other files are refused.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: Fixed value: the published pre-token pattern of this vocabulary family.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The library's tokenizer, and which of its ids end a pre-token."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    steps = [x["type"] for x in data["normalizer"]["normalizers"]]
    split = data["pre_tokenizer"]["pretokenizers"][0]
    if steps != NORMALIZERS or split["pattern"] != {"Regex": PRE_TOKEN} or any("<|" not in x["content"] for x in data["added_tokens"]):
        raise ValueError(f"{path}: texts of this tokenizer can't be encoded word by word")
    suffix, vocabulary = data["model"]["end_of_word_suffix"], data["model"]["vocab"]
    ends = np.zeros(max([*vocabulary.values(), *(x["id"] for x in data["added_tokens"])]) + 1, dtype=bool)
    ends[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True
    return Tokenizer.from_file(path), ends


def _gather(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``picks`` of a ragged array end to end, and their sizes."""
    many = sizes[picks]
    ends = np.cumsum(many)
    return flat[np.repeat(first[picks] - (ends - many), many) + np.arange(int(many.sum()))], many


def _numbers(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False)


class Encoder:
    """Ids of whole texts by a tokenizer that drops white space, lower-cases, and never merges across words and marks.

    Such a tokenizer gives a text the ids of its white-space separated parts in turn, and a part that is a word with
    ASCII marks (no apostrophe) behind it the ids of word and marks, if the word's last character is a letter or number
    when composed and lower-cased too (the dot of a lower-cased Turkish capital I is a mark, which joins those behind it). Each distinct
    word or run of marks is encoded once and remembered (up to ``CACHED`` bytes). Parts that may hold a special string
    are encoded as they stand.
    """

    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str):
        self.tokenizer, self.ends = _tokenizer(path)
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _alone(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [np.zeros(0, np.uint32)], []
        for k in range(0, len(units), 2000):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(units[k : k + 2000], add_special_tokens=False)]
            sizes += map(len, got)
            ids.append(np.fromiter(chain.from_iterable(got), np.uint32, sum(map(len, got))))
        return np.concatenate(ids), np.array(sizes, np.int64)

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters alone, each one pre-token, in texts of many words."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            found = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            size = np.diff(np.flatnonzero(self.ends[found]), prepend=-1)
            if len(size) != len(part):  # some letter isn't one to the library
                found, size = self._alone(part)
            ids.append(found)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def _places(self, units: pa.Array) -> np.ndarray:
        """Where distinct ``units`` are remembered, after learning the new ones."""
        place = pc.index_in(units, value_set=self.known)
        if not place.null_count:
            return _numbers(place)
        if self.known.nbytes + self.ids.nbytes + self.sizes.nbytes > CACHED:
            self.forget()
            place = pa.nulls(len(units), pa.int32())
        new = units.filter(pc.is_null(place))
        plain = pc.and_(pc.utf8_is_alpha(new), pc.invert(pc.match_substring(new, "\u0130")))
        words, rest = new.filter(plain), new.filter(pc.invert(plain))
        learned = [self._together(words.to_pylist()), self._alone(rest.to_pylist())]
        order = np.concatenate([np.flatnonzero(_numbers(plain)), np.flatnonzero(~_numbers(plain).astype(bool))])
        out = np.empty(len(units), np.int64)
        old = _numbers(pc.is_valid(place)).astype(bool)
        out[old] = _numbers(place.drop_null())
        out[np.flatnonzero(~old)[order]] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, words, rest])
        self.ids = np.concatenate([self.ids, *(x for x, _ in learned)])
        self.sizes = np.concatenate([self.sizes, *(x for _, x in learned)])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) end to end, and where each text starts (one more than texts)."""
        words = Words(texts)
        if not len(words.codes):
            return np.zeros(0, np.uint32), words.starts * 0
        special = pc.match_substring(words.vocabulary, "<|")
        whole = pc.if_else(special, words.vocabulary, pc.ascii_lower(words.vocabulary)).cast(pa.large_string())
        core = pc.ascii_rtrim(whole, characters=self.MARKS)
        size, left = _numbers(pc.binary_length(whole)), _numbers(pc.binary_length(core))
        last = pc.utf8_slice_codeunits(core, start=-1, stop=None).dictionary_encode()
        firm = np.array([x != "" and unicodedata.normalize("NFC", x).lower()[-1].isalnum() for x in last.dictionary.to_pylist()], dtype=bool)
        cut = firm[_numbers(last.indices)] & (left < size) & ~_numbers(special).astype(bool)
        flat, offsets = np.frombuffer(whole.buffers()[2], np.uint8), np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
        marks, many = _gather(flat, offsets[:-1] + left, size - left, np.flatnonzero(cut))
        marks = pa.LargeStringArray.from_buffers(len(many), pa.py_buffer(np.concatenate([[0], np.cumsum(many)]).astype(np.int64)), pa.py_buffer(marks))
        units = pa.concat_arrays([pc.if_else(pa.array(cut), core, whole), marks]).dictionary_encode()
        at = self._places(units.dictionary)[_numbers(units.indices)]
        # The units of each part in turn: the word or whole part, then its marks.
        first = np.arange(len(cut)) + np.cumsum(cut) - cut
        order = np.empty(len(at), np.int64)
        order[first] = at[: len(cut)]
        order[first[cut] + 1] = at[len(cut) :]
        ids, n = _gather(self.ids, np.cumsum(self.sizes) - self.sizes, self.sizes, order)
        sizes = np.add.reduceat(n, first)  # of each part
        out, n = _gather(ids, np.cumsum(sizes) - sizes, sizes, words.codes)
        return out, np.concatenate([[0], np.cumsum(n)])[words.starts]


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32."""

    def run(batches):
        encoder = Encoder(vocabulary)
        for batch in parts(batches, 1, size=3 << 20):
            ids, starts = encoder.encode(batch.column(1))
            rows = []
            for i in range(batch.num_rows):
                own = np.append(ids[starts[i] : starts[i + 1]], np.uint32(end_id)).astype("<u4")
                rows += [(i, j, at, len(cut := own[at : at + capacity]), zlib.crc32(cut.tobytes())) for j, at in enumerate(range(0, len(own), capacity))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            at = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]], ["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


def pack(cut: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length`` of at most ``capacity``."""
    spark = cut.sparkSession
    cut = settle(cut)
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    runs = spark.createDataFrame(plan(counts, capacity), "length long, low long, many long, first long, offset long")
    total = sum(counts.values())
    # A salt has about 1 / SALTS of all pieces, of whatever length. These tables' sizes are bounded by SALTS and the capacity.
    salts = spark.createDataFrame([(n, -(-c * SALTS // total)) for n, c in counts.items()], "length long, salts long")
    place = F.xxhash64(F.monotonically_increasing_id())  # of settled rows, so the same whenever a task is run again
    salted = cut.withColumn("place", place).join(F.broadcast(salts), "length").withColumn("salt", F.pmod("place", F.col("salts")))
    base, ends = [], defaultdict(int)
    for r in sorted(salted.groupBy("length", "salt").count().collect()):
        base.append((r["length"], r["salt"], ends[r["length"]]))
        ends[r["length"]] += r["count"]
    base = spark.createDataFrame(base, "length long, salt long, base long")
    within = salted.withColumn("within", F.expr(f"row_number() over (partition by length, salt order by `{id_col}`, piece) - 1"))
    ranked = within.join(F.broadcast(base), ["length", "salt"]).withColumn("rank", F.col("base") + F.col("within"))
    r, p = F.broadcast(runs).alias("r"), ranked.alias("p")
    placed = p.join(r, (F.col("p.length") == F.col("r.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("many")))
    columns = [F.col(f"p.{c}") for c in (id_col, "piece", "start", "length", "ids_crc32")]
    return placed.select(*columns, (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), F.col("r.offset"))
