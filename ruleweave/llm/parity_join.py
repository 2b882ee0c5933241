"""Exact Jaccard join of word shingle sets by parity sketches.

A set's sketch is a very long bit vector in which each shingle flips one bit, so the Hamming distance of two sketches is
at most the symmetric difference of the sets. A pair with Jaccard J >= t has a symmetric difference of at most
(1 - t) / (1 + t) of its joint size; in a band of sizes that is a bound k, and of k + ``AGREE`` blocks of the sketch at
least ``AGREE`` are equal (pigeonhole). A block's bits are kept as the XOR of the hashes of its shingles, and equal blocks
are found by one shuffle of 5-byte block keys. In detail:

* Bands grow by 1 / t, so partners are in the same band or adjoining ones; a set sends keys for its own band and as the
  larger partner for the band below.
* Shingles that many documents share would make hot blocks. Those met most often, at most ``HEAVY``, are left out. A set
  with k + ``AGREE`` non-empty blocks of other shingles sends just the first k + ``AGREE`` of those: of two such sets that
  link, the one whose sent blocks end first has ``AGREE`` equal ones among them, and the other one sends these too. A set
  with fewer (a member of a large family, mostly) sends all of these, and the blocks of its whole set; where empty blocks
  could hide equal ones, the empty ones too.
* A key that up to ``PAIRS_UP_TO`` sets share gives all their pairs, and pairs that meet in fewer than ``AGREE`` keys are
  dropped: two texts with a common phrase mostly share one key, and the number of such pairs grows with the square of the
  input. One that more share gives a star, so that whoever meets in it is compared whatever the number of keys; the
  connected families of these are compared within memory, in chunks of bounded size, by sketches of a few thousand bits
  and exactly where the sketches allow a link; a pair already in one component is skipped. So no large group is ever
  expanded into its pairs, and no link between different components is lost.
* Before sets are gathered, all candidates are tried by short sketches, which each class has had from the first pass.

All candidates are verified on whole sets. Sets are known by a 64-bit hash of their members, so exact copies are one
class. Cases: null and empty texts have an empty set, linked with nothing; a null id never names a component and gets
its component's id (null if there is none); rows that share an id are one document for the choice of the component's id
and give a row each; equal sizes need no tie-break; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import drop_shuffles, settle, small
from ruleweave.llm.textbatch import Words, mix, parts, shingles
from ruleweave.operators.graph import components

HEAVY, LEAST = 1_000_000, 24
PAIRS_UP_TO = 16
AGREE = 3
KEYS_PER_TASK = 1_500_000
CHUNK_SETS, CHUNK_BYTES = 4096, 64 << 20
_U = np.uint64


class Bands:
    """Size bands for a threshold of ``percent``: bounds, blocks of each band, and the bounds on the symmetric difference."""

    def __init__(self, percent: int, largest: int):
        self.percent = percent
        self.bounds = [1]
        while self.bounds[-1] <= largest:
            self.bounds.append(self.bounds[-1] * 100 // percent + 1)
        self.bounds.append(self.bounds[-1] * 100 // percent + 1)

    def most(self, joint):
        """Largest symmetric difference of a linked pair with this joint size."""
        return joint * (100 - self.percent) // (100 + self.percent)

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.bounds, size, side="right")) - 1

    def roles(self, size: int) -> list[tuple[int, int]]:
        """(band, k): in its own band, with partners up to 1 / t larger; and below, with partners of that band."""
        own = self.of(size)
        out = [(own, self.most(size + size * 100 // self.percent))]
        if own and self.bounds[own] - 1 >= -(-size * self.percent // 100):
            out.append((own - 1, self.most(size + self.bounds[own] - 1)))
        return [(band, k) for band, k in out if k]

    def blocks(self, band: int) -> tuple[int, int]:
        """Blocks for the sets without heavy shingles, and for whole sets; these at least any k of the band + ``AGREE``."""
        top = self.bounds[band + 1]
        return ceil(0.6 * top) + 8, ceil(1.3 * (self.most(top + top * 100 // self.percent) + 1)) + 2


def _blocks(s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and contents of the non-empty ones of ``m`` blocks of a sorted set."""
    if not len(s):
        return np.zeros(0, np.int64), s
    block = ((s >> _U(32)) * _U(m)) >> _U(32)
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    return block[first].astype(np.int64), np.bitwise_xor.reduceat(s, first)


def _keys(block: np.ndarray, content: np.ndarray, band: int, kind: int) -> np.ndarray:
    return mix(content ^ mix(block.astype(_U) + _U((band << 40) + (kind << 56))))


def block_keys(s: np.ndarray, heavy: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys that the sorted set ``s`` sends."""
    out = []
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
        rare = s[heavy[at] != s]
    else:
        rare = s
    for band, k in bands.roles(len(s)):
        m, whole = bands.blocks(band)
        block, content = _blocks(rare, m)
        if len(block) >= k + AGREE:
            out.append(_keys(block[: k + AGREE], content[: k + AGREE], band, 0))
            continue
        out.append(_keys(block, content, band, 0))
        block, content = _blocks(s, whole)
        out.append(_keys(block, content, band, 1))
        if len(block) < k + AGREE:
            empty = np.setdiff1d(np.arange(whole), block)
            out.append(_keys(empty, np.zeros(len(empty), _U), band, 2))
    return np.concatenate(out) if out else np.zeros(0, _U)


def sketch(s: np.ndarray, most: int) -> np.ndarray:
    """Parity bits of a set, in words of 64: four times as many bits as the bound on the difference, or more."""
    bits = 1 << max(7, min(16, (4 * most).bit_length()))
    odd = np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(_U)


def hamming(x: np.ndarray, y: np.ndarray) -> int:
    """Distance of two sketches; a longer one is first folded, which keeps the parities."""
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _sets(texts, width: int):
    """(sorted distinct shingles, class hash) for each text of an Arrow array; an empty set has class None."""
    flat, starts = shingles(Words(texts, lower=True), width)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if a == b:
            yield flat[:0], None
            continue
        s = np.unique(flat[a:b])
        weight = mix(np.arange(1, len(s) + 1, dtype=_U))
        yield s, int(mix(np.array([np.bitwise_xor.reduce(mix(s + weight)) + _U(len(s))], _U)).view(np.int64)[0])


def class_rows(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Settled rows (id, n_shingles, cls, sk, t), and rows (heavy, times) of shingles met twice or more in one batch of texts.

    The sketch ``sk`` and the text's hash ``t`` are given with the first row of a class in a batch.
    """
    bands = Bands(percent, 1)

    def run(batches):
        for batch in parts(batches, 1, size=8 << 20):
            n, cls, sk, first, new = [], [], [], [], {}
            for s, c in _sets(batch.column(1), width):
                n.append(len(s))
                cls.append(c)
                first.append(c is not None and c not in new)
                sk.append(sketch(s, bands.most(2 * len(s))).tobytes() if first[-1] else None)
                if c is not None:
                    new[c] = s
            names = ["id", "n_shingles", "cls", "sk", "t", "heavy", "times"]
            none = pa.nulls(batch.num_rows, pa.int64())
            t = pc.if_else(pa.array(first, pa.bool_()), batch.column(2), pa.scalar(None, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sk, pa.binary()), t, none, none], names)
            if new:
                h, times = np.unique(np.concatenate(list(new.values())), return_counts=True)
                h, times = h[times > 1], times[times > 1]
                none = pa.nulls(len(h), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(h), batch.column(0).type), none, none, pa.nulls(len(h), pa.binary()), none, pa.array(h.view(np.int64)), pa.array(times.astype(np.int64))], names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    return settle(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_shingles long, cls long, sk binary, t long, heavy long, times long"))


def _send(docs: DataFrame, text_col: str, width: int, heavy, bands: Bands, tasks: int) -> DataFrame:
    """Rows (part, data): the block keys of many sets, dealt over ``tasks``."""

    def flush(ids, keys):
        many = np.array([len(k) for k in keys])
        key, at = np.concatenate(keys), np.repeat(np.arange(len(ids), dtype=np.uint16), many)
        part = (((key & _U(0xFFFFFF)) * _U(tasks)) >> _U(24)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        key, at, part = key[order], at[order], part[order]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ids, blobs = np.array(ids, np.int64), []
        for a, b in zip(first, [*first[1:], len(part)], strict=True):
            used, own = np.unique(at[a:b], return_inverse=True)
            short = np.ascontiguousarray((key[a:b] >> _U(24)).view(np.uint8).reshape(-1, 8)[:, :5])
            blobs.append(np.uint32(len(used)).tobytes() + ids[used].tobytes() + own.astype(np.uint16).tobytes() + short.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int64()), pa.array(blobs, pa.binary())], ["part", "data"])

    def run(batches):
        ids, keys, seen, total = [], [], set(), 0
        for batch in parts(batches):
            for s, c in _sets(batch.column(0), width):
                if c is not None and c not in seen and len(own := block_keys(s, heavy.value, bands)):
                    seen.add(c)
                    ids.append(c)
                    keys.append(own)
                    total += len(own)
                    if len(ids) >= 8000 or total >= 4_000_000:
                        yield flush(ids, keys)
                        ids, keys, seen, total = [], [], set(), 0
        if ids:
            yield flush(ids, keys)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "part long, data binary")


def _collisions(part: list[bytes]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, a, b, keys in common) from all data of one part: kind 0 are pairs of small groups, kind 1 the stars of large ones."""
    ids, keys = [], []
    for data in part:
        n = int(np.frombuffer(data, np.uint32, 1)[0])
        own = np.frombuffer(data, np.int64, n, 4)
        many = (len(data) - 4 - 8 * n) // 7
        ids.append(own[np.frombuffer(data, np.uint16, many, 4 + 8 * n)])
        wide = np.zeros((many, 8), np.uint8)
        wide[:, :5] = np.frombuffer(data, np.uint8, 5 * many, 4 + 8 * n + 2 * many).reshape(-1, 5)
        keys.append(wide.view(np.int64).ravel())
    ids, keys = np.concatenate(ids), np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    ids, keys = ids[order], keys[order]
    same = keys[1:] == keys[:-1]
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    ids, keys = ids[shared], keys[shared]
    order = np.lexsort((ids, keys))
    ids, keys = ids[order], keys[order]
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])  # copies of one class from several tasks
    ids, keys = ids[fresh], keys[fresh]
    if not len(ids):
        return []
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.concatenate([first, [len(keys)]]))
    out = []
    for n in range(2, PAIRS_UP_TO + 1):
        if len(at := first[size == n]):
            rows = ids[at[:, None] + np.arange(n)]
            i, j = np.triu_indices(n, 1)
            out.append((0, rows[:, i].ravel(), rows[:, j].ravel()))
    large = size > PAIRS_UP_TO
    member = np.repeat(large, size)
    star = np.repeat(ids[first], size)
    keep = member & (star != ids)
    out.append((1, star[keep], ids[keep]))
    distinct = []
    for kind in (0, 1):
        a, b = (np.concatenate([x[k] for x in out if x[0] == kind] or [np.zeros(0, np.int64)]) for k in (1, 2))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        times = np.diff(np.concatenate([np.flatnonzero(new), [len(a)]]))
        distinct.append((kind, a[new], b[new], times))
    return distinct


def candidates(docs: DataFrame, text_col: str, width: int, heavy, bands: Bands, total: int) -> DataFrame:
    """Settled distinct rows (kind, a, b) of class hashes; of kind 0, those with ``AGREE`` keys in common."""
    tasks = max(1, min(1 << 24, ceil(0.65 * total / KEYS_PER_TASK)))

    def run(batches):
        by: dict[int, list[bytes]] = {}
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(p, []).append(data)
        for p in list(by):
            for kind, a, b, times in _collisions(by.pop(p)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(times)], ["kind", "a", "b", "times"])

    sent = _send(docs, text_col, width, heavy, bands, tasks).repartitionById(tasks, F.col("part").cast("int"))
    met = sent.mapInArrow(run, "kind int, a long, b long, times long").groupBy("kind", "a", "b").agg(F.sum("times").alias("times"))
    return settle(met.where((F.col("kind") == 1) | (F.col("times") >= AGREE)).select("kind", "a", "b"))


def set_rows(docs: DataFrame, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """Settled rows (cls, data): the sorted sets of the classes in ``wanted`` (cls, t), once each.

    ``t`` is the hash of one text of the class, so only these texts are read by Python; a further text of equal hash does
    no harm, since classes are computed from the texts again.
    """

    def run(batches):
        for batch in parts(batches):
            found = {c: s.tobytes() for s, c in _sets(batch.column(0), width) if c is not None}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["cls", "data"])

    # Beyond the broadcast limit this is a shuffled join, whose hot texts adaptive execution splits.
    texts = docs.select(F.col(text_col).alias("text")).join(small(wanted.select("t").distinct()), F.xxhash64("text") == F.col("t"), "left_semi")
    return settle(texts.mapInArrow(run, "cls long, data binary").dropDuplicates(["cls"]))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def possible(pairs: DataFrame, sketches: DataFrame, bands: Bands) -> DataFrame:
    """Settled pairs whose sketches are near enough for a link."""

    def run(batches):
        for batch in batches:
            a, b, m, n, x, y = (c.to_pylist() for c in batch.columns)
            ok = [hamming(np.frombuffer(x[k], _U), np.frombuffer(y[k], _U)) <= bands.most(m[k] + n[k]) for k in range(len(a))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = sketches.select(F.col("cls").alias("a"), F.col("n").alias("m"), F.col("sk").alias("x"))
    right = sketches.select(F.col("cls").alias("b"), "n", F.col("sk").alias("y"))
    return settle(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a long, b long"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [linked(np.frombuffer(p, _U), np.frombuffer(q, _U), percent) for p, q in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("cls").alias("a"), F.col("data").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("data").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _near(sketches: list[np.ndarray], sizes: np.ndarray, side: np.ndarray, bands: Bands):
    """(k, places after k that may link with k) for sets in order of size; across sides only, if there are two."""
    across = len(np.unique(side)) > 1

    def folded(x, words):
        while len(x) > words:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        return x

    k = 0
    while k < len(sketches):
        # Sets of the same sketch length, and the larger ones that can link with them, at that length.
        words, end = len(sketches[k]), k
        while end < len(sketches) and len(sketches[end]) <= words:
            end += 1
        last = int(np.searchsorted(sizes, sizes[end - 1] * 100 // bands.percent, side="right"))
        block = np.stack([folded(x, words) for x in sketches[k:last]])
        for i in range(k, end):
            stop = int(np.searchsorted(sizes, sizes[i] * 100 // bands.percent, side="right"))
            if stop <= i + 1:
                continue
            far = np.bitwise_count(block[i + 1 - k : stop - k] ^ block[i - k]).sum(axis=1, dtype=np.int64)
            ok = far <= bands.most(sizes[i + 1 : stop] + sizes[i])
            if across:
                ok &= side[i + 1 : stop] != side[i]
            yield i, np.flatnonzero(ok) + i + 1
        k = end


def spanning_links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, bands: Bands) -> list[tuple[int, int]]:
    """Links that join all that is linked among ``sets``; where ``side`` has two values, only pairs across them count."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    ids, side, sets = ids[order], side[order], [sets[k] for k in order]
    sizes = np.array([len(s) for s in sets])
    label, out = np.arange(len(sets)), []
    for k, todo in _near([sketch(s, bands.most(2 * len(s))) for s in sets], sizes, side, bands):
        todo = todo[label[todo] != label[k]]
        while len(todo):
            j = todo[0]
            if linked(sets[k], sets[j], bands.percent):
                out.append((int(ids[k]), int(ids[j])))
                label[label == label[j]] = label[k]
                todo = todo[label[todo] != label[k]]
            else:
                todo = todo[1:]
    return out


def _dealt(members: DataFrame, size: str) -> DataFrame:
    """Rows (family, cls, chunk, i, j) of members with bytes ``size``: chunk c takes part in the comparisons (i, j), i <= j, with i = c or j = c."""
    chunks = members.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / CHUNK_SETS), F.ceil(F.sum(size) / CHUNK_BYTES)).cast("int").alias("chunks"))
    rows = members.join(chunks, "family").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    return rows.withColumn("other", other).select("family", "cls", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))


def families(stars: DataFrame, sketches: DataFrame, bands: Bands) -> DataFrame:
    """Settled rows (family, cls): the members of connected families whose sketches allow a link with another member."""
    found = components(stars).select(F.col("node").alias("cls"), F.col("component").alias("family"))
    members = settle(found.join(sketches.select("cls", F.octet_length("sk").alias("bytes")), "cls"))
    dealt = _dealt(members, "bytes").join(sketches, "cls")

    def run(table: pa.Table) -> pa.Table:
        n, cls, chunk = (table.column(c).to_numpy() for c in ("n", "cls", "chunk"))
        alive = np.zeros(len(n), bool)
        if table.column("i")[0].as_py() == table.column("j")[0].as_py() or len(np.unique(chunk)) > 1:
            order = np.argsort(n, kind="stable")
            sk = [np.frombuffer(x, _U) for x in table.column("sk").to_pylist()]
            for k, near in _near([sk[o] for o in order], n[order], chunk[order], bands):
                if len(near):
                    alive[order[k]] = True
                    alive[order[near]] = True
        return pa.table({"family": table.column("family").filter(pa.array(alive)), "cls": pa.array(cls[alive])})

    return settle(dealt.groupBy("family", "i", "j").applyInArrow(run, "family long, cls long").distinct())


def family_links(members: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """Links within families, compared chunk by chunk on whole sets."""
    dealt = _dealt(members.join(sets.select("cls", F.octet_length("data").alias("bytes")), "cls"), "bytes").join(sets, "cls")

    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk").to_numpy()
        found = []
        if table.column("i")[0].as_py() == table.column("j")[0].as_py() or len(np.unique(chunk)) > 1:
            found = spanning_links(table.column("cls").to_numpy(), [np.frombuffer(x, _U) for x in table.column("data").to_pylist()], chunk, bands)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return dealt.groupBy("family", "i", "j").applyInArrow(run, "a long, b long")


def _frequent(every: DataFrame) -> np.ndarray:
    """The shingles met most often, sorted: as many levels of their counts (four an octave) as give at most ``HEAVY``."""
    met = every.where("heavy is not null").groupBy("heavy").agg(F.sum("times").alias("n")).where(F.col("n") >= LEAST)
    met = settle(met.select("heavy", F.floor(4 * F.log2("n")).cast("int").alias("level")))
    least, many = 1 << 30, 0
    for level, n in sorted(map(tuple, met.groupBy("level").count().collect()), reverse=True):
        if (many := many + n) > HEAVY:
            break
        least = level
    found = met.where(F.col("level") >= least).select("heavy").toArrow().column(0).to_numpy()
    return np.sort(found.astype(np.int64).view(_U))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links of ``percent`` Jaccard)."""
    spark = docs.sparkSession
    every = class_rows(docs, id_col, text_col, width, percent)
    rows = every.where("n_shingles is not null").select("id", "n_shingles", "cls")
    total, largest = rows.agg(F.sum("n_shingles"), F.max("n_shingles")).first()
    total, largest = total or 0, largest or 0
    bands = Bands(percent, largest)
    found = candidates(docs, text_col, width, spark.sparkContext.broadcast(_frequent(every)), bands, total)
    drop_shuffles(spark)  # that of the keys is the largest by far
    met = found.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    sketches = settle(every.where("sk is not null").select("cls", F.col("n_shingles").alias("n"), "sk", "t").dropDuplicates(["cls"]).join(met, "cls", "left_semi"))
    pairs = possible(found.where("kind = 0"), sketches, bands)
    members = families(found.where("kind = 1"), sketches, bands)
    wanted = settle(pairs.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(members.select("cls")).distinct().join(sketches.select("cls", "t"), "cls"))
    sets = set_rows(docs, text_col, width, wanted)
    drop_shuffles(spark)
    links = settle(verified(pairs, sets, percent).unionByName(family_links(members, sets, bands)))
    drop_shuffles(spark)
    classes = components(links).select(F.col("node").alias("cls"), "component")
    # Ids by class first, so that a class with very many copies is one row in what follows.
    named = rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("least")).join(classes, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = settle(named)
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = named.join(names, "component").select("cls", "component_id")
    out = rows.join(small(by_class, rows=None), "cls", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
