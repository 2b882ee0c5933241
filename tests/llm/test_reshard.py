"""Sharding: flow against exhaustive search, equal texts, and the files that rewriting leaves."""

import itertools
import random
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ruleweave.llm import reshard

SCHEMA = "doc_id long, text string, shard int, size string, n long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(k, "x" * rng.randint(0, 200) + str(k), rng.choice([0, 1, 2, 3, 6, None]), "s", k) for k in range(300)]
    rows += [(None, "no id", 2, "s", 1), (None, None, None, "s", 2), (5, "", 1, "s", 3), rows[7], rows[7], rows[9]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def cheapest(supply, demand, cost):
    """Least cost over all ways to send ``supply`` to ``demand``, by exhaustive search."""
    if not supply:
        return 0
    best = float("inf")
    for split in itertools.product(*[range(min(supply[0], d) + 1) for d in demand]):
        if sum(split) == supply[0]:
            rest = cheapest(supply[1:], [d - x for d, x in zip(demand, split)], cost[1:])
            best = min(best, rest + sum(x * c for x, c in zip(split, cost[0])))
    return best


def test_flows_are_of_least_cost():
    rng = random.Random(1)
    for _ in range(40):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        supply = [rng.randint(0, 5) for _ in range(n)]
        cuts = sorted(rng.randint(0, sum(supply)) for _ in range(m - 1))
        demand = [b - a for a, b in zip([0, *cuts], [*cuts, sum(supply)])]
        cost = [[rng.randint(0, 4) for _ in range(m)] for _ in range(n)]
        flow = reshard.min_cost_flow(supply, demand, cost)
        assert [sum(x) for x in flow] == supply and [sum(x) for x in zip(*flow)] == demand
        assert sum(flow[i][j] * cost[i][j] for i in range(n) for j in range(m)) == cheapest(supply, demand, cost)
        even, moves = reshard.even_flow(supply, demand), [[int(i != j) for j in range(m)] for i in range(n)]
        assert [sum(x for (i, _), x in even.items() if i == k) for k in range(n)] == supply
        assert [sum(x for (_, j), x in even.items() if j == k) for k in range(m)] == demand
        assert sum(x * moves[i][j] for (i, j), x in even.items()) == cheapest(supply, demand, moves)


def checked(docs, rows):
    """Every row is placed once, slots have no gaps; sizes by shard."""
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.size) for r in rows) == sorted(((r.doc_id is None, r.doc_id or 0), len((r.text or "").encode()) + 1) for r in docs.collect())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_rows_are_placed_once_and_evenly(spark, docs):
    for old_col in (None, "shard"):
        sizes = checked(docs, reshard.reshard(docs, shards=4, old_col=old_col).collect())
        assert set(sizes) == {0, 1, 2, 3} and max(sizes.values()) - min(sizes.values()) < 0.1 * sum(sizes.values()) / 4
    assert reshard.reshard(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("share", [0.5, 0.9, 3.0])
def test_copies_stay_together_where_a_shard_holds_them(spark, share):
    """A text with ``share`` of a shard's bytes is in one shard, and dealt out only if no shard can hold it."""
    rest = [(k, f"{k:050d}") for k in range(2000)]
    hot = "hot " * 12 + "ab"
    copies = int(share * 2000 / (8 - share))
    docs = spark.createDataFrame(rest + [(9000 + k, hot) for k in range(copies)], "doc_id long, text string").repartition(4)
    rows = reshard.reshard(docs).collect()
    sizes = checked(docs, rows)
    homes = {r.shard for r in rows if r.doc_id >= 9000}
    assert len(homes) == 1 if share <= 1 else len(homes) > 1
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 8


def files(path):
    return {str(f): f.read_bytes() for f in sorted(Path(path).rglob("*.parquet"))}


def test_rewriting_writes_each_row_once(spark, docs, tmp_path):
    same = [c for c in docs.columns if c != "shard"]
    for old_col in (None, "shard"):
        found, _ = reshard.layout(docs, shards=4, old_col=old_col)
        out = str(tmp_path / str(old_col))
        assert found.rewrite(docs, out, only=[0, 1, 2, 3]) == [0, 1, 2, 3]
        written = spark.read.parquet(out)
        assert written.count() == docs.count() and written.select(same).exceptAll(docs.select(same)).isEmpty()
        placed = reshard.reshard(docs, shards=4, old_col=old_col)
        assert written.groupBy("shard").count().exceptAll(placed.groupBy("shard").count()).isEmpty()


def test_only_affected_files_change_and_emptied_shards_go(spark, tmp_path):
    rows = spark.createDataFrame([(k, "a" * 99, k % 4) for k in range(400)] + [(k, "b" * 99, 4) for k in range(400, 450)], "doc_id long, text string, shard int")
    path = str(tmp_path / "shards")
    rows.write.partitionBy("shard").parquet(path)
    before = files(path)
    found, _ = reshard.layout(rows, shards=5, old_col="shard", old_shards=5)
    changed = found.rewrite(rows, path)
    after = files(path)
    assert 4 in changed and {f for f in before if after.get(f) != before[f]} == {f for f in before if int(f.split("shard=")[1].split("/")[0]) in changed}
    assert sorted(r.doc_id for r in spark.read.parquet(path).collect()) == list(range(450))
    stored = spark.read.parquet(path).withColumn("at", F.col("shard").cast("int"))
    closing, _ = reshard.layout(stored, shards=1, old_col="at")
    assert closing.changed == (0, 1, 2, 3, 4)
    kept = spark.createDataFrame(stored.collect(), stored.schema)
    closing.rewrite(kept, path)
    assert sorted(r.doc_id for r in spark.read.parquet(path).collect()) == list(range(450))
    assert not any(list(Path(path, f"shard={k}").glob("*.parquet")) for k in (1, 2, 3, 4))


def test_file_query_equals_the_placement(spark, docs, tmp_path):
    by_rows = reshard.reshard(docs, shards=4).select("doc_id", "size", "text_crc32", "old_shard", "shard")
    by_files = reshard.reshard_files(docs, str(tmp_path / "files"), shards=4)
    checked(docs, by_files.collect())
    assert by_files.select(by_rows.columns).exceptAll(by_rows).isEmpty()
