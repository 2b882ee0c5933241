"""Resharding by minimum-cost flow: from old shard sizes to new capacities with the fewest bytes moved.

Documents belong to blocks, cut by the hash of the text, so equal texts are in one block; units are parts of a block that
one task can number. Only sizes of units reach the driver, at most about 8 x ``BLOCKS`` of them. A block of over a
sixteenth of a shard's share stays where it is, or goes where most room is; one that fits nowhere as a whole (a text
whose copies fill more than a shard) is dealt out by units. For all others the flow network has an arc from each old
shard to each new one, free of cost for staying and with a cost per byte else; its solution says how many bytes go from
where to where, and the blocks that best fill each transfer move. Only shards that gain or lose blocks are rewritten.

Cases: a null text has size 1 and crc 0, as an empty one; null ids and repeated rows are placed and written as often as
they come; ties are broken by block number; an empty table gives an empty result; other columns are ignored by the
placement and carried along by ``rewrite``, where names that start with ``_rs_`` are reserved and a ``shard`` of the
input is replaced. With ``old_col``, equal texts of different old shards are different groups.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import settle, small

#: Blocks before any is cut, and about how many there are in the end.
PARTS, BLOCKS = 1024, 1 << 18


def even_flow(supply: list[int], demand: list[int]) -> dict[tuple[int, int], int]:
    """Flow of least cost where staying is free and all moves cost alike: what can stay stays, the rest moves anyhow."""
    flow = {(k, k): min(s, demand[k]) for k, s in enumerate(supply[: len(demand)]) if min(s, demand[k])}
    more = [(k, s - flow.get((k, k), 0)) for k, s in enumerate(supply)]
    less = [(k, d - flow.get((k, k), 0)) for k, d in enumerate(demand)]
    more, less = [x for x in more if x[1]], [x for x in less if x[1]]
    while more:
        (i, s), (j, d) = more.pop(), less.pop()
        flow[i, j] = min(s, d)
        if s > d:
            more.append((i, s - d))
        elif d > s:
            less.append((j, d - s))
    return flow


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow from sources to sinks with equal totals, of least total cost, by successive shortest paths with potentials."""
    n, m = len(supply), len(demand)
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    flow = [[0] * m for _ in range(n)]
    left, want = list(supply), list(demand)
    while any(left):
        # Bellman-Ford over sources (0..n-1) and sinks (n..n+m-1): forward arcs always open, backward ones where flow is.
        dist, via = [0 if x else float("inf") for x in left] + [float("inf")] * m, [None] * (n + m)
        for _ in range(n + m):
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist[i] + cost[i][j] < dist[n + j]:
                        dist[n + j], via[n + j], changed = dist[i] + cost[i][j], i, True
                    if flow[i][j] and dist[n + j] - cost[i][j] < dist[i]:
                        dist[i], via[i], changed = dist[n + j] - cost[i][j], n + j, True
            if not changed:
                break
        end = min((j for j in range(m) if want[j]), key=lambda j: dist[n + j])
        path, x = [n + end], n + end
        while via[x] is not None:
            x = via[x]
            path.append(x)
        path.reverse()
        room = min(left[path[0]], want[end], *[flow[b][a - n] for a, b in zip(path, path[1:], strict=False) if a >= n])
        for a, b in zip(path, path[1:], strict=False):
            if a < n:
                flow[a][b - n] += room
            else:
                flow[b][a - n] -= room
        left[path[0]] -= room
        want[end] -= room
    return flow


def assign_blocks(sizes: dict, old: dict, capacities: list[int], move_cost: list[list[int]] | None = None) -> dict:
    """New shard of each block: transfers by minimum-cost flow, filled with blocks from the largest down.

    ``sizes`` and ``old`` are by block; capacities must sum to the total size. A block moves while it fits into what is
    left of its shard's transfers; what integral blocks leave over is at most the smallest movable block a transfer.
    """
    shards = len(capacities)
    held = [0] * max([shards, *(s + 1 for s in old.values())]) if old else [0] * shards
    for b, s in old.items():
        held[s] += sizes[b]
    if move_cost is None:
        flow = even_flow(held, capacities)
    else:
        flow = {(i, j): x for i, row in enumerate(min_cost_flow(held, capacities, move_cost)) for j, x in enumerate(row) if x}
    leaving: dict[int, dict[int, int]] = defaultdict(dict)
    for (i, j), x in flow.items():
        if i != j:
            leaving[i][j] = x
    new, by = dict(old), defaultdict(list)
    for b in sorted(old, key=lambda b: (-sizes[b], b)):
        by[old[b]].append(b)
    for i, blocks in by.items():
        left = leaving[i]
        gone = set()
        for b in blocks:
            if not left:
                break
            j = max(left, key=lambda j: (left[j], -j))
            if sizes[b] <= left[j]:
                new[b], left[j] = j, left[j] - sizes[b]
                gone.add(b)
                if not left[j]:
                    del left[j]
        if i >= shards:  # a shard that closes: its last blocks go where most is wanted
            for b in blocks:
                if b not in gone:
                    j = max(left, key=lambda j: (left[j], -j)) if left else min(range(shards))
                    new[b] = j
                    left[j] = left.get(j, 0) - sizes[b]
    return new


def assign_units(units: dict[tuple[int, int, int], int], capacities: list[int], move_cost: list[list[int]] | None = None) -> dict[tuple[int, int, int], int]:
    """New shard of each unit, by (block, old shard, unit) with sizes; blocks stay whole where they fit into a shard."""
    sizes: dict[tuple, int] = defaultdict(int)
    members: dict[tuple, list] = defaultdict(list)
    for (block, old, unit), size in units.items():
        sizes[block, old] += size
        members[block, old].append((block, old, unit))
    room, new = list(capacities), {}
    least = min(capacities) // 16
    for b in sorted((b for b in sizes if sizes[b] > least), key=lambda b: (-sizes[b], b)):
        size = sizes.pop(b)
        at = b[1] if b[1] < len(room) and room[b[1]] >= size else max(range(len(room)), key=lambda j: (room[j], -j))
        if room[at] >= size:
            room[at] -= size
            new |= dict.fromkeys(members[b], at)
        else:
            sizes |= {u: units[u] for u in members[b]}
    for item, shard in assign_blocks(dict(sizes), {b: b[1] for b in sizes}, room, move_cost).items():
        new |= dict.fromkeys([item] if len(item) == 3 else members[item], shard)
    return new


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


@dataclass
class Layout:
    """Where rows go: ``cuts`` (column, its hash, bits, table of cut values) and ``places`` (unit, old_shard, shard, base)."""

    id_col: str
    text_col: str
    old_col: str | None
    old_shards: int
    cuts: list[tuple[str, str, int, DataFrame]]
    places: DataFrame | None = None
    changed: tuple[int, ...] = ()

    def measured(self, docs: DataFrame) -> DataFrame:
        """``docs`` with _rs_size, _rs_crc, _rs_text, _rs_id (hashes) and _rs_given."""
        text = F.coalesce(F.col(self.text_col), F.lit(""))
        old = F.col(self.old_col).cast("int") if self.old_col else F.lit(None).cast("int")
        return docs.withColumns({"_rs_size": (F.octet_length(text) + 1).cast("long"), "_rs_crc": F.crc32(text.cast("binary")), "_rs_text": F.xxhash64(text), "_rs_id": F.xxhash64(F.col(self.id_col), text), "_rs_given": old})

    def blocked(self, rows: DataFrame) -> DataFrame:
        """Add _rs_block, _rs_unit and _rs_old to measured rows, without a shuffle."""
        rows = rows.withColumn("_rs_block", F.pmod("_rs_text", F.lit(PARTS)).cast("long"))
        for column, by, shift, marked in self.cuts:
            if column == "_rs_unit" and "_rs_unit" not in rows.columns:
                rows = rows.withColumn("_rs_unit", F.col("_rs_block"))
            rows = _recut(rows, column, by, shift, marked)
        if "_rs_unit" not in rows.columns:
            rows = rows.withColumn("_rs_unit", F.col("_rs_block"))
        return rows.withColumn("_rs_old", F.coalesce("_rs_given", F.pmod(F.xxhash64("_rs_block"), F.lit(self.old_shards)).cast("int")))

    def placed(self, rows: DataFrame) -> DataFrame:
        """Add ``shard`` and _rs_base to blocked rows; every row has one place."""
        return rows.join(self.places, ["_rs_unit", "_rs_old"])

    def rewrite(self, docs: DataFrame, path: str, only: list[int] | None = None, extra: dict[str, Column] | None = None, rebalance: bool = False) -> list[int]:
        """Write all rows of the shards in ``only`` (default: those that changed) into ``path``/shard=k; returns them.

        Files of other shards are left as they are, and those of shards that got empty are removed. Rows go straight
        from their input to the files of their shard; with ``rebalance`` they are shuffled into files of even sizes.
        """
        shards = sorted(self.changed if only is None else only)
        rows = self.placed(self.blocked(self.measured(docs)).drop("shard")).where(F.col("shard").isin(shards))
        rows = rows.select(*[c for c in docs.columns if c.lower() != "shard"], *[c.alias(name) for name, c in (extra or {}).items()], "shard")
        if rebalance:
            rows = rows.hint("rebalance", "shard")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
        filled = {r["shard"] for r in self.places.select("shard").distinct().collect()}
        spark = docs.sparkSession
        for k in shards:
            if k not in filled:
                folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={k}")
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        return shards


def _recut(rows: DataFrame, column: str, by: str, shift: int, marked: DataFrame) -> DataFrame:
    finer = F.xxhash64(F.lit(shift), column, F.pmod(F.shiftright(F.col(by), shift), F.col("_rs_parts")))
    return rows.join(F.broadcast(marked), column, "left").withColumn(column, F.when(F.col("_rs_parts").isNotNull(), finer).otherwise(F.col(column))).drop("_rs_parts")


def _cut(rows: DataFrame, column: str, by: str, shift: int, bound: int, cuts: list) -> DataFrame:
    """Cut the values of ``column`` whose rows have over ``bound`` bytes, by bits of the hash ``by``; noted in ``cuts``.

    A value of s bytes is cut into about 4 s / bound parts, so all cuts together add at most 4 x total / bound values,
    and the driver sees no more than total / bound of them.
    """
    sums = rows.groupBy(column).agg(F.sum("_rs_size").alias("s"), F.count("*").alias("n"))
    large = [(r[column], -(-4 * r["s"] // bound)) for r in sums.where((F.col("s") > bound) & (F.col("n") > 1)).collect()]
    if not large:
        return rows
    cuts.append((column, by, shift, rows.sparkSession.createDataFrame(large, f"{column} long, _rs_parts long")))
    return _recut(rows, *cuts[-1])


def layout(docs: DataFrame, shards: int = 8, old_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", old_col: str | None = None, move_cost: list[list[int]] | None = None) -> tuple[Layout, DataFrame]:
    """The new layout of ``docs``, and their settled measured rows (without the text).

    The old layout is what ``old_col`` says; where that is null or not given, a hash of the block over ``old_shards``.
    """
    out = Layout(id_col, text_col, old_col, old_shards, [])
    rows = settle(out.measured(docs.select(*dict.fromkeys([id_col, text_col, *([old_col] if old_col else [])]))).select(F.col(id_col), "_rs_size", "_rs_crc", "_rs_text", "_rs_id", "_rs_given"))
    total = rows.agg(F.sum("_rs_size")).first()[0] or 0
    # Blocks and units are cut to this; with many shards they are fewer a shard, so that the driver's tables stay bounded.
    bound = max(1, total // shards // max(16, min(512, BLOCKS // shards)))
    cut = rows.withColumn("_rs_block", F.pmod("_rs_text", F.lit(PARTS)).cast("long"))
    cut = _cut(cut, "_rs_block", "_rs_text", 16, bound, out.cuts)
    cut = _cut(cut, "_rs_block", "_rs_text", 36, bound, out.cuts)
    _cut(cut.withColumn("_rs_unit", F.col("_rs_block")), "_rs_unit", "_rs_id", 20, bound, out.cuts)
    units = out.blocked(rows).groupBy("_rs_block", "_rs_old", "_rs_unit").agg(F.sum("_rs_size").alias("s"), F.count("*").alias("n")).collect()
    sizes = {(r["_rs_block"], r["_rs_old"], r["_rs_unit"]): r["s"] for r in units}
    new = assign_units(sizes, even_capacities(total, shards), move_cost) if sizes else {}
    base, at, changed = [], [0] * shards, set()
    for r in sorted(units, key=lambda r: (r["_rs_block"], r["_rs_old"], r["_rs_unit"])):
        key = r["_rs_block"], r["_rs_old"], r["_rs_unit"]
        base.append((key[2], key[1], new[key], at[new[key]]))
        at[new[key]] += r["n"]
        if new[key] != key[1]:
            changed |= {new[key], key[1]}
    spark = docs.sparkSession
    out.places = small(spark.createDataFrame(base, "_rs_unit long, _rs_old int, shard int, _rs_base long"), len(base))
    out.changed = tuple(sorted(changed))
    return out, rows


def reshard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, size, text_crc32, old_shard, shard, slot (gapless from 0 within the shard)."""
    found, rows = layout(docs, shards, id_col=id_col, **options)
    return with_slots(found.placed(found.blocked(rows)), id_col)


def with_slots(placed: DataFrame, id_col: str) -> DataFrame:
    slot = F.expr(f"_rs_base + row_number() over (partition by _rs_unit, _rs_old order by `{id_col}`, _rs_crc) - 1").cast("long")
    return placed.select(F.col(id_col), F.col("_rs_size").alias("size"), F.col("_rs_crc").alias("text_crc32"), F.col("_rs_old").alias("old_shard"), "shard", slot.alias("slot"))


def reshard_files(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", **options) -> DataFrame:
    """As ``reshard``, with the affected shards' files written into ``path``, and their rows read from there."""
    found, rows = layout(docs, shards, id_col=id_col, **options)
    kept = ["_rs_size", "_rs_crc", "_rs_old", "_rs_unit", "_rs_base"]
    written = found.rewrite(docs, path, extra={c: F.col(c) for c in kept})
    placed = found.placed(found.blocked(rows)).select(id_col, *kept, "shard").where(~F.col("shard").isin(written))
    if written:
        files = docs.sparkSession.read.parquet(path)
        placed = placed.unionByName(files.select(id_col, *kept, F.col("shard").cast("int")))
    return with_slots(placed, id_col)
