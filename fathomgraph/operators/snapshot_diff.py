"""What changed between consecutive full snapshots: a sorted merge per key range.

All snapshots of a table are range-partitioned and sorted by key together, so one linear pass per range
meets each key's records in the order of the snapshots. Two neighbouring records of a key play the two
pointers: a step of one snapshot compares their columns, a gap means removed and, later, added again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomgraph.functions.text_ids import clean_id, edge_kind, evidence, stripped
from fathomgraph.plans.shared import kept


def run_order(scan_runs: DataFrame) -> DataFrame:
    """(scan_run_id, project_id, nth, next_run): completed runs of each project, counted by started_at.

    Repeated rows of a run count once; equal times of start are ordered by id; runs without a project or
    an id are left out, runs without a start come first.
    """
    runs = (
        scan_runs.filter((F.lower(stripped("status")) == "completed") & F.col("project_id").isNotNull() & F.col("id").isNotNull())
        .groupBy("project_id", F.col("id").alias("scan_run_id"))
        .agg(F.min("started_at").alias("started_at"))
    )
    by = Window.partitionBy("project_id").orderBy(F.col("started_at").asc_nulls_first(), "scan_run_id")
    return runs.select("scan_run_id", "project_id", F.row_number().over(by).alias("nth"), F.lead("scan_run_id").over(by).alias("next_run"))


def snapshot_changes(snapshots: DataFrame, runs: DataFrame, key: Column, compared: Column, delivered: Column) -> DataFrame:
    """(scan_run_id, record_key, change_type) between each run and the one before it in its project.

    A record that a snapshot holds several times counts as delivered last; at equal times the greatest
    compared value counts. Null compared values equal each other. Records with a null key, and of runs
    that runs does not hold, are left out. A run without any record empties the table.
    """
    rows = snapshots.select("scan_run_id", key.alias("record_key"), compared.alias("value"), delivered.alias("delivered")).filter("record_key is not null")
    # Written once, as the ranges are sampled ahead of the exchange: texts are parsed once, and both passes read the parsed columns.
    placed = kept(rows.join(runs, "scan_run_id").select("project_id", "record_key", "nth", "scan_run_id", "next_run", "delivered", "value"))
    ranged = placed.repartitionByRange(F.col("project_id"), F.col("record_key"))
    delivery = Window.partitionBy("project_id", "record_key", "nth").orderBy(F.col("delivered").desc_nulls_last(), F.col("value").desc_nulls_last())
    last = ranged.withColumn("again", F.row_number().over(delivery)).filter("again = 1").drop("again", "delivered")
    of_key = Window.partitionBy("project_id", "record_key").orderBy("nth")
    met = last.select(
        "*",
        F.lag("nth").over(of_key).alias("before_nth"),
        F.lag("value").over(of_key).alias("before"),
        F.lead("nth").over(of_key).alias("after_nth"),
    )
    change = lambda run, kind: F.struct(run.alias("scan_run_id"), F.lit(kind).alias("change_type"))
    held = F.coalesce(F.col("before_nth") == F.col("nth") - 1, F.lit(False))
    gone = F.col("next_run").isNotNull() & ~F.coalesce(F.col("after_nth") == F.col("nth") + 1, F.lit(False))
    changes = F.array(
        F.when((F.col("nth") > 1) & ~held, change(F.col("scan_run_id"), "added")),
        F.when(held & ~F.col("value").eqNullSafe(F.col("before")), change(F.col("scan_run_id"), "changed")),
        F.when(gone, change(F.col("next_run"), "removed")),
    )
    return met.select("record_key", F.explode(F.filter(changes, lambda x: x.isNotNull())).alias("c")).select("c.scan_run_id", "record_key", "c.change_type")


def graph_changes(node_snapshots: DataFrame, edge_snapshots: DataFrame, segment_cache: DataFrame, scan_runs: DataFrame) -> DataFrame:
    """(table_name, scan_run_id, record_key, change_type) over the three tables that each run delivers.

    Nodes are keyed by fqn and compare id and kind; edges are keyed by from_id|to_id|kind and compare source
    and confidence; segments are keyed by segment_id and compare graph_fingerprint. Ids, fingerprints
    and kinds compare trimmed and lower-cased. Edges of unknown kinds are keyed by their kind's own text;
    a missing endpoint leaves its place in the key empty.
    """
    runs = kept(run_order(scan_runs))
    blank = lambda c: F.coalesce(c, F.lit(""))
    nodes = snapshot_changes(node_snapshots, runs, F.col("fqn"), F.struct(clean_id("id").alias("a"), F.lower(stripped("kind")).alias("b")), F.col("delivered_at"))
    edges = snapshot_changes(
        edge_snapshots,
        runs,
        F.concat_ws("|", blank(clean_id("from_id")), blank(clean_id("to_id")), F.coalesce(edge_kind("kind"), stripped("kind"), F.lit(""))),
        evidence("provenance"),
        F.col("delivered_at"),
    )
    cache = snapshot_changes(segment_cache, runs, F.col("segment_id"), F.struct(clean_id("graph_fingerprint").alias("a")), F.col("updated_at"))
    out = [df.select(F.lit(name).alias("table_name"), "scan_run_id", "record_key", "change_type") for name, df in (("nodes", nodes), ("edges", edges), ("analysis_segment_cache", cache))]
    return out[0].unionByName(out[1]).unionByName(out[2])
