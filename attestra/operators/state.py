"""Keyed state: the status of each case folded from its events. The stream in streaming/audit.py folds with the same function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold_status(events: DataFrame) -> DataFrame:
    """STM-02, DED-05: per loan the last event type, the history without immediate repeats and the distinct errors.

    events: loan_id, event_ts, audit_id, type, error. Folded in order of (event_ts, audit_id); repeated events count once; events
    without a loan or type are left out. A busy loan's events are sorted day by day, in tasks of their own, and only its changes of
    type come together.
    """
    known = events.where(F.col("loan_id").isNotNull() & F.col("type").isNotNull()).select("loan_id", "event_ts", "audit_id", "type", "error").distinct()
    day = W.partitionBy("loan_id", F.to_date("event_ts")).orderBy("event_ts", "audit_id", "error")
    at = F.struct("event_ts", "audit_id", "type")
    moved = F.when(~F.col("type").eqNullSafe(F.lag("type").over(day)), at)
    marked = known.select("loan_id", "error", at.alias("at"), moved.alias("moved"))
    # The fold of a day is combined before the shuffle; nulls are no changes and are not collected.
    whole = marked.groupBy("loan_id").agg(
        F.array_sort(F.collect_list("moved")).alias("changes"), F.array_sort(F.collect_set("error")).alias("errors"), F.count(F.lit(1)).alias("events"), F.max("at")["type"].alias("current")
    )
    runs = _runs(F.transform("changes", lambda x: x["type"]))
    return whole.select("loan_id", "current", F.array_join(runs, ">").alias("history"), F.array_join("errors", "|").alias("errors"), "events")


def _runs(types: Column) -> Column:
    """An array without immediate repeats."""
    return F.filter(types, lambda x, i: (i == 0) | (x != F.try_element_at(types, i)))


def newest_first(states: DataFrame) -> DataFrame:
    """The last state of each loan among those of all micro-batches: that of the latest batch."""
    return states.groupBy("loan_id").agg(F.max_by(F.struct("current", "history", "errors", "events"), "batch").alias("x")).select("loan_id", "x.*")
