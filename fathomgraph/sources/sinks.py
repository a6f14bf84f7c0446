"""Results written as reports and tables, and the life of a scan."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "id string, project_id string, status string, started_at timestamp, completed_at timestamp, primary_language string, error string, at timestamp"


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object a row, as text files."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_health_report(sections: dict[str, DataFrame], path: str) -> None:
    """A report as one folder a section, each with one JSON object a row, so that no section needs to fit anywhere whole."""
    for name, df in sections.items():
        write_report(df, f"{path}/{name}")


def read_health_report(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


def write_segments(df: DataFrame, path: str) -> None:
    """A segment cache, one folder for each segment_id; only the segments that df holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment_id").parquet(path)


def begin_scan(spark: SparkSession, path: str, project: str, at) -> str:
    """Appends a running scan to the log of runs; its id is returned."""
    run = uuid.uuid4().hex
    spark.createDataFrame([(run, project, "running", at, None, None, None, at)], RUN).write.mode("append").parquet(path)
    return run


def end_scan(spark: SparkSession, path: str, run: str, at, status: str = "completed", language: str | None = None, error: str | None = None) -> None:
    """Appends the end of a scan: completed, failed or cancelled. Nothing is rewritten; the last row of a run counts."""
    if status not in ("completed", "failed", "cancelled"):
        raise ValueError(f"no status: {status}")
    spark.createDataFrame([(run, None, status, None, at, language, error, at)], RUN).write.mode("append").parquet(path)


def scans(spark: SparkSession, path: str) -> DataFrame:
    """One row a run of the log: each column's last value that is not null."""
    columns = [c.split()[0] for c in RUN.split(", ")][1:-1]
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct("at", c)))[c].alias(c) for c in columns]
    return spark.read.schema(RUN).parquet(path).groupBy("id").agg(*last)


def append_metrics(metrics: DataFrame, run: str, path: str) -> None:
    """Appends rows (metric, value) of a report to the series of all scans, as (scan_run_id, metric, value)."""
    metrics.select(F.lit(run).alias("scan_run_id"), "metric", "value").write.mode("append").parquet(path)


#: Columns of a population, and those that older ones lack.
POPULATION = {"cycle_ratio": "double", "avg_coupling": "double", "dead_ratio": "double", "hotspot_concentration": "double", "max_depth": "int", "tangle_index": "double"}
LATER = {"avg_cyclomatic": "double", "avg_cohesion": "double", "avg_distance": "double", "temporal_coupling_score": "double"}


def population_row(metrics: DataFrame, id_: str, analyzed_at: str, language: str | None, source: str = "local") -> DataFrame:
    """One row for the population from rows (metric, value)."""
    names = POPULATION | LATER
    wide = metrics.agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).cast(t).alias(n) for n, t in names.items()])
    return wide.select(F.lit(id_).alias("id"), F.lit(analyzed_at).alias("analyzed_at"), F.lit(language).cast("string").alias("language"), F.lit(source).alias("source"), *names)


def load_population(spark: SparkSession, path: str) -> DataFrame:
    """A population with null columns for the later metrics that it lacks."""
    from fathomgraph.sources.graph import with_columns

    return with_columns(spark.read.option("mergeSchema", True).parquet(path), **LATER)


def with_project_language(nodes: DataFrame, language: str) -> DataFrame:
    """nodes whose Project nodes say the language in their properties (a JSON object, kept otherwise)."""
    known = F.from_json("properties", "map<string,string>")
    said = F.to_json(F.map_concat(F.map_filter(F.coalesce(known, F.create_map().cast("map<string,string>")), lambda k, v: k != "language"), F.create_map(F.lit("language"), F.lit(language))))
    return nodes.withColumn("properties", F.when(F.col("kind") == "Project", said).otherwise(F.col("properties")))


def emit(events: DataFrame, path: str) -> None:
    """Progress events as JSON lines, which streaming.progress reads."""
    events.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def report_json(section: DataFrame, limit: int = 1000) -> str:
    """A small section as one JSON text; refused beyond limit."""
    rows = [r.asDict(True) for r in section.limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    return json.dumps(rows, default=str)
