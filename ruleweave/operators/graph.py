"""Control-flow graph operators: reduction, depths, path enumeration, components, projections."""

from __future__ import annotations

import tempfile
from itertools import count

import pandas as pd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEPT = ("startEvent", "endEvent", "exclusiveGateway")


def cut(df: DataFrame) -> DataFrame:
    """Settle ``df`` in the shared checkpoint folder (a temporary one only where none is configured)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


REDUCED = "file string, src string, dst string, guard string, tasks array<string>, via_flows array<string>, ord int, loop boolean"


def reduce_graph(nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """Edges between kept nodes of each file, with the tasks on the way; a row with ``loop`` true warns of a dropped loop.

    One group is one diagram, whose size a person's drawing bounds. Files without exactly one start or without an end
    raise an error.
    """

    def walk(nodes: pd.DataFrame, flows: pd.DataFrame) -> pd.DataFrame:
        file = (nodes if len(nodes) else flows)["file"].iloc[0]
        kind = dict(zip(nodes["id"], nodes["type"], strict=True))
        outgoing: dict[str, list] = {}
        for f in flows.sort_values("seq").itertuples():
            outgoing.setdefault(f.src, []).append(f)
        kept = [n for n in nodes.sort_values("seq")["id"] if kind[n] in KEPT]
        if sum(kind[n] == "startEvent" for n in kept) != 1 or not any(kind[n] == "endEvent" for n in kept):
            raise ValueError(f"{file}: a diagram needs exactly one start and at least one end")
        task = lambda n: [n] if n in kind and kind[n] not in KEPT else []
        edges, loops = {}, []
        for src in kept:
            for first in outgoing.get(src, []):
                guard = first.name if kind[src] == "exclusiveGateway" and first.name else None
                seen, stack = set(), [(first.dst, tuple(task(first.dst)), (first.id,), (src,))]
                while stack:
                    node, tasks, via, way = stack.pop()
                    if node in way:
                        loops.append((file, src, node, guard, list(tasks), list(via)))
                        continue
                    if (node, via[-1]) in seen:
                        continue
                    seen.add((node, via[-1]))
                    if kind.get(node) in KEPT:
                        edges[src, node, guard or "", tasks, via] = (file, src, node, guard, list(tasks), list(via))
                        continue
                    stack += [(f.dst, (*tasks, *task(f.dst)), (*via, f.id), (*way, node)) for f in reversed(outgoing.get(node, []))]
        rows = [(*edges[k], i, False) for i, k in enumerate(sorted(edges))] + [(*x, -1, True) for x in loops]
        return pd.DataFrame(rows, columns=["file", "src", "dst", "guard", "tasks", "via_flows", "ord", "loop"])

    return nodes.groupBy("file").cogroup(flows.groupBy("file")).applyInPandas(walk, REDUCED)


def min_depths(edges: DataFrame, starts: DataFrame, limit: int | None = None) -> DataFrame:
    """(file, node, depth): least number of edges from a start of the file. One join a level, to the deepest level.

    More than ``limit`` levels raise an error.
    """
    frontier = starts.select("file", F.col("node"), F.lit(0).alias("depth")).distinct()
    known = cut(frontier)
    frontier = known
    for level in count(1):
        step = frontier.join(edges.select("file", F.col("src").alias("node"), "dst"), ["file", "node"]).select("file", F.col("dst").alias("node"), F.lit(level).alias("depth")).distinct()
        frontier = cut(step.join(known.select("file", "node"), ["file", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        if limit is not None and level > limit:
            raise ValueError(f"more than {limit} levels")
        known = cut(known.unionByName(frontier))
    return known


def simple_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, limit: int | None = None) -> DataFrame:
    """All simple paths (file, nodes, edge_ids, rank) from starts to ends; ``rank`` orders them as a depth-first search.

    ``edges`` has file, edge_id, src, dst, rank (place among the source's edges). A path stops at its first end.
    Paths that are unfinished after ``limit`` edges raise an error.
    """
    targets = ends.select("file", F.col("node").alias("last"), F.lit(True).alias("end"))
    empty = F.array().cast("array<string>")
    going = starts.select("file", F.col("node").alias("last"), F.array("node").alias("nodes"), empty.alias("edge_ids"), F.array().cast("array<int>").alias("rank"))
    done = None
    step = edges.select("file", F.col("src").alias("last"), F.col("dst"), F.col("edge_id").cast("string"), F.col("rank").cast("int").alias("r"))
    for length in count(1):
        grown = going.join(step, ["file", "last"]).where(~F.array_contains("nodes", F.col("dst")))
        grown = grown.select("file", F.col("dst").alias("last"), F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("edge_ids", F.col("edge_id")).alias("edge_ids"), F.array_append("rank", F.col("r")).alias("rank"))
        grown = cut(grown.join(targets, ["file", "last"], "left"))
        finished = grown.where("end").drop("end", "last")
        done = finished if done is None else done.unionByName(finished)
        going = grown.where("end is null").drop("end")
        if going.isEmpty():
            break
        if limit is not None and length >= limit:
            raise ValueError(f"paths are unfinished after {limit} edges")
    return done


def superiority(rules: DataFrame) -> DataFrame:
    """(file, over, under): each rule stands over the next accepted one of its file."""
    before = F.lag("rid").over(Window.partitionBy("file").orderBy("n"))
    return rules.withColumn("over", before).where("over is not null").select("file", "over", F.col("rid").alias("under"))


def _with_least(rows: DataFrame, salts: int = 64) -> DataFrame:
    """``rows`` (u, v) with the least v of each u as m; a hub's rows are dealt over ``salts`` parts.

    The least v of each part is found first; it is these rows, at most ``salts`` of a hub, that meet by hub alone.
    """
    rows = rows.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(salts)))
    least = rows.groupBy("u", "s").agg(F.min("v").alias("m")).withColumn("m", F.min("m").over(Window.partitionBy("u")))
    return rows.join(least, ["u", "s"])


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): least node reachable over undirected (a, b); ``nodes`` (node) adds isolated ones.

    Alternating large-star and small-star rounds; each halves the depth of the trees, no row leaves the executors, and no
    hub's neighbours meet in one task. Null ends and self loops are ignored; an empty input gives an empty result.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u <> v").distinct())
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Settled, since three parts of the next plan read it.
        large = cut(_with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct())
        stars = _with_least(large).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("v"))
        edges = cut(stars.unionByName(low).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
    if nodes is None:
        return out
    alone = nodes.select("node").where("node is not null").distinct().join(out.select("node"), "node", "left_anti")
    return out.unionByName(alone.select("node", F.col("node").alias("component")))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges (source, target, label) with both ends among ``nodes`` (node)."""
    keep = nodes.select("node").distinct()
    return edges.join(keep.withColumnRenamed("node", "source"), "source", "left_semi").join(keep.withColumnRenamed("node", "target"), "target", "left_semi").select("source", "target", "label").distinct()


def first_values(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row for each key with the first non-null value of each column by ``order``."""
    return rows.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])
