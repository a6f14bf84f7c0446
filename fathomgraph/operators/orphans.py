"""References to records that do not exist: a sorted merge of references with their parents' validity.

References and parents are co-partitioned by key and sorted by time; one linear pass over each key's
merged stream keeps the latest end of validity, and whether a removal has passed, so each reference
is judged when it comes by. Keys with very many references are split over slots, to which the few rows
of their parents are copied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomgraph.functions.text_ids import clean_id
from fathomgraph.operators.skew import hot_slots

FOREVER = "timestamp_ntz'9999-12-31 23:59:59'"


def orphans(refs: DataFrame, parents: DataFrame, parts: int | None = None) -> DataFrame:
    """The references whose parent did not exist at their time, with the reason.

    refs: id, at, and any other columns, which are handed through (names starting with `__` are taken).
    parents: id, valid_from, valid_to (null: still valid), one row per life of a parent.
    Adds `reason`: 'deleted' if some life of the id had ended by then; else 'late' if the id has any
    life; else 'missing'. A reference without a time finds no parent, and is 'late' or 'missing'. Null
    ids are no references and no parents. A life without valid_from never covers anything.
    """
    spark = refs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    refs, parents = refs.filter("id is not null"), parents.filter("id is not null")
    hot = F.broadcast(hot_slots(refs.select("id"), parts))  # at most 4 * parts rows
    carried = [c for c in refs.columns if c not in ("id", "at")]
    nothing = F.lit(None).cast("timestamp_ntz")

    left = refs.join(hot, "id", "left").select(
        "id",
        F.when(F.col("slots").isNull(), 0).otherwise(F.pmod(F.xxhash64("at", *carried), F.col("slots")).cast("int")).alias("__slot"),
        F.col("at").cast("timestamp_ntz").alias("__at"),
        F.lit(2).alias("__rank"),
        nothing.alias("__end"),
        F.lit(False).alias("__gone"),
        F.struct(*[F.col(c) for c in ["at", *carried]]).alias("__ref"),
    )
    ref_type = left.schema["__ref"].dataType
    moment = lambda at, rank, end, gone: F.struct(at.alias("__at"), F.lit(rank).alias("__rank"), end.alias("__end"), F.lit(gone).alias("__gone"))
    start, end = F.col("valid_from").cast("timestamp_ntz"), F.col("valid_to").cast("timestamp_ntz")
    right = (
        parents.join(hot, "id", "left")
        .select(
            "id",
            F.explode(F.sequence(F.lit(0), F.coalesce(F.col("slots"), F.lit(1)) - 1)).alias("__slot"),
            F.filter(
                F.array(
                    moment(nothing, 0, nothing, False),
                    F.when(start.isNotNull(), moment(start, 1, F.coalesce(end, F.expr(FOREVER)), False)),
                    F.when(end.isNotNull(), moment(end, 1, nothing, True)),
                ),
                lambda x: x.isNotNull(),
            ).alias("__moments"),
        )
        .select("id", "__slot", F.explode("__moments").alias("m"))
        .select("id", "__slot", "m.*", F.lit(None).cast(ref_type).alias("__ref"))
    )
    merged = Window.partitionBy("id", "__slot").orderBy(F.col("__rank") != 0, F.col("__at").asc_nulls_last(), "__rank")
    so_far = merged.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = left.unionByName(right).select(
        "id",
        "__at",
        "__ref",
        F.max("__end").over(so_far).alias("__valid_to"),
        F.max("__gone").over(so_far).alias("__had_end"),
        F.min("__rank").over(so_far).alias("__known"),
    )
    reason = F.when(F.col("__had_end") & F.col("__at").isNotNull(), "deleted").when(F.col("__known") < 2, "late").otherwise("missing")
    lost = seen.filter(F.col("__ref").isNotNull() & ~F.coalesce(F.col("__valid_to") > F.col("__at"), F.lit(False)))
    return lost.select("id", "__ref.*", reason.alias("reason"))


def edge_orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_id, endpoint, reason, edge_month), one row per distinct edge_id and endpoint without a node."""
    refs = edges.select(
        "edge_id",
        F.col("recorded_at").alias("at"),
        F.explode(
            F.array(
                F.struct(F.lit("from").alias("endpoint"), clean_id("from_id").alias("id")),
                F.struct(F.lit("to").alias("endpoint"), clean_id("to_id").alias("id")),
            )
        ).alias("e"),
    ).select("edge_id", "at", "e.endpoint", "e.id")
    parents = nodes.select(clean_id("id").alias("id"), F.col("recorded_at").alias("valid_from"), F.col("removed_at").alias("valid_to"))
    # Only orphans are made distinct; the repeated rows of sound references never get that far.
    return (
        orphans(refs, parents)
        .groupBy("edge_id", "endpoint")
        .agg(F.min(F.struct("at", "reason")).alias("first"))
        .select("edge_id", "endpoint", "first.reason", F.date_format("first.at", "yyyy-MM").alias("edge_month"))
    )


def orphans_by_month(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(table_name, endpoint, edge_month, reason, n): orphan references of edges per month."""
    return (
        edge_orphans(edges, nodes)
        .groupBy(F.lit("edges").alias("table_name"), "endpoint", "edge_month", "reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )
