"""Findings and scores: numbering, capping, risk, priority, percentile ranks, and what changed between two reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomgraph.operators.skew import running_sums
from fathomgraph.plans.shared import kept

#: Ranks of severities, and factors of the priority.
SEVERITY_RANK = {"Critical": 4, "High": 3, "Warning": 2, "Info": 1}
CONFIDENCE_FACTOR = {"High": 1.0, "Medium": 0.7, "Low": 0.4}
TEMPORAL_FACTOR, WORSENING_FACTOR = 1.5, 1.3
#: Weights of the health score; the last is shared out where there is no history.
WEIGHTS = {
    "cycle_severity": 0.20, "coupling_health": 0.18, "hotspot_concentration": 0.15, "dead_code_ratio": 0.10, "depth_complexity": 0.10, "complexity": 0.10,
    "cohesion": 0.07, "distance": 0.05, "temporal_coupling": 0.05,
}


def _mapped(c: Column, table: dict, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(default))


def severity_rank(c: Column | str) -> Column:
    return _mapped(F.col(c) if isinstance(c, str) else c, SEVERITY_RANK, 0)


def capped(findings: DataFrame, limit: int = 10) -> DataFrame:
    """(type, id, severity, overflow): per type the gravest `limit` findings, ties by id, and one row with the number of the others.

    The cap is the feature of a report; the overflow row keeps its count whole. Each task sheds all but its own first rows of a type, and the others are counted apart.
    """
    by = Window.partitionBy("type").orderBy(severity_rank("severity").desc(), "id")
    shown = findings.select("type", "id", "severity", F.row_number().over(by).alias("place")).filter(F.col("place") <= limit).select("type", "id", "severity", F.lit(0).cast("bigint").alias("overflow"))
    counts = findings.groupBy("type").agg((F.count(F.lit(1)) - limit).alias("overflow")).filter("overflow > 0")
    return shown.unionByName(counts.select("type", F.concat("type", F.lit("-overflow")).alias("id"), F.lit("Info").alias("severity"), "overflow"))


def filtered(findings: DataFrame, severity: str | None = None, type_name: str | None = None, type_part: str | None = None, suppressed: DataFrame | None = None) -> DataFrame:
    """findings of a severity, of a type (spaces stand for underscores) or with a part of its name, all without letter case, and without those of suppressed(id)."""
    if severity is not None:
        findings = findings.filter(F.lower("severity") == severity.lower())
    if type_name is not None:
        plain = lambda c: F.regexp_replace(F.lower(c), "[ _]", "")
        findings = findings.filter(plain(F.col("type")) == plain(F.lit(type_name)))
    if type_part is not None:
        findings = findings.filter(F.contains(F.lower("type"), F.lit(type_part.lower())))
    return findings if suppressed is None else findings.join(suppressed.select("id"), "id", "left_anti").select(*findings.columns)


def node_risk(findings: DataFrame) -> DataFrame:
    """(node, risk) from findings(node_ids, severity): Critical, High, Warning, Info by how many of each severity name the node."""
    each = findings.select(F.explode(F.array_distinct("node_ids")).alias("node"), "severity")
    n = each.groupBy("node").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK])
    c, h, w, i = (F.col(s) for s in SEVERITY_RANK)
    return n.select("node", F.when(c + h >= 2, "Critical").when((c > 0) | (h + w >= 2), "High").when((h > 0) | (w > 0), "Warning").when(i > 0, "Info").alias("risk"))


def priorities(findings: DataFrame, limit: int = 10) -> DataFrame:
    """(place, id, score) of findings(id, severity, blast, temporal, confidence, worsening): the highest priority first; ties by severity, then id."""
    rank = severity_rank("severity")
    score = rank * (1 + F.log2(F.col("blast") + 1)) * F.when(F.col("temporal"), TEMPORAL_FACTOR).otherwise(1.0) * _mapped(F.col("confidence"), CONFIDENCE_FACTOR, 1.0) * F.when(F.col("worsening"), WORSENING_FACTOR).otherwise(1.0)
    top = findings.select("id", rank.alias("rank"), score.alias("score")).orderBy(F.col("score").desc(), F.col("rank").desc(), "id").limit(limit)
    place = F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("rank").desc(), "id"))
    return top.select(place.alias("place"), "id", "score")


def finding_key() -> Column:
    return F.concat_ws(":", "type", F.array_join(F.array_sort("node_ids"), "|"))


def finding_changes(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(finding, change): new, resolved or worsened between two lists of findings(type, node_ids, severity), matched by type and nodes."""
    side = lambda df, n: df.groupBy(finding_key().alias("finding")).agg(F.max(severity_rank("severity")).alias(n))
    both = side(baseline, "before").join(side(current, "after"), "finding", "full_outer")
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "resolved").when(F.col("after") > F.col("before"), "worsened")
    return both.select("finding", change.alias("change")).filter("change is not null")


def percentile_rank(population: DataFrame, column: str, value: Column, higher_is_better: bool = False) -> Column:
    """Aggregate over a population: the share that value beats, ties by half, in whole percent; 50 for an empty one."""
    c = F.col(column)
    known = c.isNotNull() & ~F.isnan(c)
    worse = F.count_if(known & ((c < value - 1e-12) if higher_is_better else (c > value + 1e-12)))
    equal = F.count_if(known & (F.abs(c - value) <= 1e-12))
    n = F.count_if(known)
    return F.when(n > 0, F.round((worse + equal / 2) / n * 100)).otherwise(50.0)


def population_scores(population: DataFrame, probes: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(probe, language, metric, percentile) for each row of probes(probe, language, metrics...): its rank in its language's population.

    Equal values of the population are counted first; each probe then meets the distinct values of its language as running counts, so
    a popular language costs its distinct values, and ties are exact. Lower values are better. A value counts as equal only if it is the same.
    """
    melt = lambda df, *own: df.select(*own, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select(*own, "x.*").filter("value is not null and not isnan(value)")
    counts = kept(melt(population, "language").groupBy("language", "metric", "value").agg(F.count(F.lit(1)).alias("n")))
    probed = melt(probes, "probe", "language")
    marks = probed.select("language", "metric", "value").distinct().withColumn("n", F.lit(0))
    both = counts.unionByName(marks).groupBy("language", "metric", "value").agg(F.sum("n").alias("n"))
    run = running_sums(both, ["language", "metric"], ["value"], "n", "through")
    total = counts.groupBy("language", "metric").agg(F.sum("n").alias("total"))
    met = probed.join(run, ["language", "metric", "value"]).join(total, ["language", "metric"], "left").na.fill(0, ["total"])
    worse = F.col("total") - F.col("through")
    return met.select("probe", "language", "metric", F.when(F.col("total") > 0, F.round((worse + F.col("n") / 2) / F.col("total") * 100)).otherwise(50.0).alias("percentile"))
