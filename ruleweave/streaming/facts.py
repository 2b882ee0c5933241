"""Facts as a stream: the latest facts of each scenario as state, and rules over the scenarios that a micro-batch touches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ruleweave.operators.evaluate import matched

STATE = "pred array<string>, value array<boolean>, ts array<long>"


def latest(facts: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Streaming facts (scenario_id, pred, value, ts) once for each event within the watermark."""
    return facts.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["scenario_id", "pred", "value", "ts"])


def current(facts: DataFrame) -> DataFrame:
    """All latest facts (scenario_id, pred, value) of each scenario that a micro-batch touches.

    The state holds one fact for each predicate of a scenario, the last by time (of equal times, the one that came last).
    """

    def update(key, batches, state):
        known: dict[str, tuple[bool, int]] = {}
        if state.exists:
            preds, values, times = state.get
            known = dict(zip(preds, zip(values, times, strict=True), strict=True))
        for pdf in batches:
            for row in pdf.sort_values("ts", kind="stable").itertuples():
                if row.pred not in known or row.ts >= known[row.pred][1]:
                    known[row.pred] = (bool(row.value), int(row.ts))
        state.update((list(known), [v for v, _ in known.values()], [t for _, t in known.values()]))
        yield pd.DataFrame({"scenario_id": [key[0]] * len(known), "pred": list(known), "value": [v for v, _ in known.values()]})

    rows = facts.where("scenario_id is not null and pred is not null and value is not null").select("scenario_id", "pred", "value", F.unix_micros("ts").alias("ts"))
    kind = facts.schema["scenario_id"].dataType.simpleString()
    return rows.groupBy("scenario_id").applyInPandasWithState(update, f"scenario_id {kind}, pred string, value boolean", STATE, "update", GroupStateTimeout.NoTimeout)


def evaluate_stream(facts: DataFrame, rules: DataFrame, body: DataFrame, sink: Callable[[DataFrame, int], None]):
    """A stream writer that gives ``sink`` the matches (scenario_id, rid) of the scenarios that each micro-batch touches.

    A rule matches by all facts that its scenario has had so far, in whichever batches they came.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        sink(matched(rows, rows.select("scenario_id"), rules, body), epoch)

    return current(facts).writeStream.outputMode("update").foreachBatch(batch)
