"""Batched rule evaluation as relational division."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rules and heads with at most this many rows are sent to every executor; more are joined by shuffling.
BROADCAST_RULES = 200_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_RULES else df


def matched(facts: DataFrame, scenarios: DataFrame, rules: DataFrame, body: DataFrame) -> DataFrame:
    """(scenario_id, rid) of every rule all of whose body atoms hold.

    ``facts`` (scenario_id, pred, value), ``scenarios`` (scenario_id), ``rules`` (rid, ...), ``body`` (rid, pred, value).
    A missing fact equals neither truth value. A rule with an empty body matches every scenario. Facts are aggregated
    only after the join with the few body atoms, and partially before the shuffle.
    """
    atoms = body.select("rid", "pred", "value").distinct()
    needed = atoms.groupBy("rid").agg(F.count("*").alias("n_body"))
    # Rules are few beside facts; the planner sends them to every executor where their size allows it.
    hits = facts.join(atoms, ["pred", "value"]).groupBy("scenario_id", "rid").agg(F.count_distinct("pred", "value").alias("n"))
    full = hits.join(needed, "rid").where("n = n_body").select("scenario_id", "rid")
    vacuous = rules.select("rid").join(needed, "rid", "left_anti")
    every = scenarios.select("scenario_id").distinct()
    # Beyond the broadcast limit Spark pairs the partitions of both sides.
    return full.unionByName(every.crossJoin(_small(vacuous)))


def outcomes(matches: DataFrame, head: DataFrame) -> DataFrame:
    """(scenario_id, event, norm) in order of rule and place, once each: ``head`` is (rid, rule_ord, pos, event, norm)."""
    rows = matches.join(head, "rid").groupBy("scenario_id", "event", "norm").agg(F.min(F.struct("rule_ord", "pos")).alias("first"))
    order = F.row_number().over(Window.partitionBy("scenario_id").orderBy("first", "event", "norm"))
    return rows.select("scenario_id", order.alias("ord"), "event", "norm")


def expectation_gaps(got: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows (scenario_id, norm, problem) where outcomes and expectations differ as sets."""
    a, b = got.select("scenario_id", "norm").distinct(), expected.select("scenario_id", "norm").distinct()
    return a.exceptAll(b).withColumn("problem", F.lit("unexpected")).unionByName(b.exceptAll(a).withColumn("problem", F.lit("missing")))
