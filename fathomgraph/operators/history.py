"""Scan history: order, latest, deltas, windows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STABLE = 1e-6


def latest_completed(runs: DataFrame) -> DataFrame:
    """(project_id, id, started_at): each project's completed run that started last; ties go to the greater id."""
    done = runs.filter("lower(trim(status)) = 'completed' and project_id is not null")
    return done.groupBy("project_id").agg(F.max(F.struct("started_at", "id")).alias("r")).select("project_id", "r.id", "r.started_at")


def run_deltas(metrics: DataFrame, by: str, order: list[str], values: list[str]) -> DataFrame:
    """metrics with `<value>_delta` and `<value>_trend` (Improved, Worsened, Stable; lower is better) against the row before in the same `by`."""
    window = Window.partitionBy(by).orderBy(*order)
    out = metrics
    for v in values:
        delta = F.col(v) - F.lag(v).over(window)
        out = out.withColumn(f"{v}_delta", delta).withColumn(f"{v}_trend", trend(F.col(f"{v}_delta")))
    return out


def with_percent(deltas: DataFrame, values: list[str]) -> DataFrame:
    """deltas with `<value>_percent`: the delta in percent of the value before; null where that is 0 or there is none."""
    for v in values:
        before = F.col(v) - F.col(f"{v}_delta")
        deltas = deltas.withColumn(f"{v}_percent", F.when(before != 0, F.col(f"{v}_delta") / F.abs(before) * 100))
    return deltas


def trend(delta: Column) -> Column:
    return F.when(F.abs(delta) < STABLE, "Stable").when(delta < 0, "Improved").when(delta > 0, "Worsened")


def window_start(expression: str, now: Column) -> Column:
    """The start of a window written as 30d, 12w, 6m or 1y before now."""
    m = re.fullmatch(r"\s*(\d+)\s*([dwmy])\s*", expression.lower())
    if not m:
        raise ValueError(f"no window: {expression}")
    n, unit = int(m[1]), m[2]
    months, days = {"d": (0, n), "w": (0, 7 * n), "m": (n, 0), "y": (12 * n, 0)}[unit]
    return now - F.make_interval(F.lit(0), F.lit(months), F.lit(0), F.lit(days))


def series(runs: DataFrame, last: int = 5) -> DataFrame:
    """(project_id, id, started_at, place): the last runs of each project, oldest first from place 1 on."""
    down = Window.partitionBy("project_id").orderBy(F.col("started_at").desc(), F.col("id").desc())
    up = Window.partitionBy("project_id").orderBy("started_at", "id")
    kept = runs.withColumn("back", F.row_number().over(down)).filter(F.col("back") <= last)
    return kept.select("project_id", "id", "started_at", F.row_number().over(up).alias("place"))


def durations(runs: DataFrame) -> DataFrame:
    """(project_id, runs, completed, failed, cancelled, avg_seconds): of each project; runs that did not end have no duration."""
    one = runs.dropDuplicates(["id"])
    seconds = F.unix_seconds(F.col("completed_at").cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))
    status = F.lower(F.trim("status"))
    return one.groupBy("project_id").agg(F.count(F.lit(1)).alias("runs"), *[F.count_if(status == s).alias(s) for s in ("completed", "failed", "cancelled")], F.avg(seconds).alias("avg_seconds"))
