"""Per-key results where a few keys hold most rows: eager aggregation through joins.

Both inputs of a join are reduced to one compact state per join key before they meet. A key with a
third of all rows becomes one row per map task ahead of the shuffle, so no task gets more than a share
of the distinct keys, whatever the counts behind them. The joined states are combined algebraically
(counts multiply, sums scale by the other side's count) and rolled up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgraph.functions.text_ids import clean_id, node_kind

LEFT_N, RIGHT_N = "__left_n", "__right_n"


def states(df: DataFrame, key: Column, by: Sequence[str], sums: Sequence[str], n: str) -> DataFrame:
    """(__key, by, n, __sum_...): one row per key and group, by partial counts and sums ahead of the shuffle. Null keys have none."""
    return (
        df.select(key.alias("__key"), *by, *sums).filter(F.col("__key").isNotNull())
        .groupBy("__key", *by)
        .agg(F.count(F.lit(1)).alias(n), *[F.sum(c).alias(f"__sum_{c}") for c in sums])
    )


def eager_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_by: Sequence[str] = (),
    right_by: Sequence[str] = (),
    left_sums: Sequence[str] = (),
    right_sums: Sequence[str] = (),
) -> DataFrame:
    """What `left JOIN right ON key GROUP BY left_by, right_by` gives as `n` and sums, without the join's rows.

    Columns: left_by, right_by, `n`, and `sum_<column>` for every summed column. Null keys meet nothing,
    as in SQL; null summands are left out, and a sum without any is null; an empty side gives no rows.
    left_by and right_by must not share a name. Other columns of the inputs are ignored.
    """
    if set(left_by) & set(right_by) or set(left_sums) & set(right_sums):
        raise ValueError("left and right must use different column names")
    met = states(left, F.col(key), left_by, left_sums, LEFT_N).join(states(right, F.col(key), right_by, right_sums, RIGHT_N), "__key")
    out = [F.sum(F.col(LEFT_N) * F.col(RIGHT_N)).alias("n")]
    out += [F.sum(F.col(f"__sum_{c}") * F.col(RIGHT_N)).alias(f"sum_{c}") for c in left_sums]
    out += [F.sum(F.col(f"__sum_{c}") * F.col(LEFT_N)).alias(f"sum_{c}") for c in right_sums]
    rolled = met.groupBy(*left_by, *right_by).agg(*out)
    return rolled.filter("n is not null")


def joined_ends(edges: DataFrame) -> DataFrame:
    """(id, in_rows, out_rows, paths_through) of every non-blank id: the eager form of joining edges to itself on to_id = from_id.

    Both inputs are edges, reduced to a count per id ahead of the join: by to_id on the left, by from_id on the right. The
    join is full, so that ids of one side alone stay, with 0 on the other. paths_through multiplies the counts: the rows of the join.
    """
    met = states(edges, clean_id("to_id"), (), (), LEFT_N).join(states(edges, clean_id("from_id"), (), (), RIGHT_N), "__key", "full_outer").na.fill(0, [LEFT_N, RIGHT_N])
    return met.select(F.col("__key").alias("id"), F.col(LEFT_N).alias("in_rows"), F.col(RIGHT_N).alias("out_rows"), (F.col(LEFT_N) * F.col(RIGHT_N)).alias("paths_through"))


def hot_ids(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """(side, hot_id) of the ids that hold at least `share` of the rows with a non-blank id on that side.

    The joined states of both sides are rolled up to the sides' totals, which each id's counts then meet. Empty edges give no rows.
    """
    ends = joined_ends(edges)
    sides = F.array(F.struct(F.lit("to_id").alias("side"), F.col("in_rows").alias("n")), F.struct(F.lit("from_id").alias("side"), F.col("out_rows").alias("n")))
    counts = ends.select(F.col("id").alias("hot_id"), F.explode(sides).alias("s")).select("hot_id", "s.*")
    totals = ends.agg(F.sum("in_rows").alias("to_id"), F.sum("out_rows").alias("from_id"))
    met = counts.join(F.broadcast(totals))  # one row
    least = F.when(F.col("side") == "to_id", F.col("to_id")).otherwise(F.col("from_id")) * F.lit(share)
    return met.filter((F.col("n") > 0) & (F.col("n") >= least)).select("side", "hot_id")


def fan(edges: DataFrame) -> DataFrame:
    """Fan-in and fan-out of every non-blank id, and the two-edge paths through it.

    (id, in_rows, in_partners, out_rows, out_partners, paths_through). Partners are distinct non-blank
    ids at the other end. paths_through is in_rows * out_rows: what the self-join of edges on
    to_id = from_id would count. Sides that an id does not appear on are 0.
    """
    pairs = edges.groupBy(clean_id("from_id").alias("f"), clean_id("to_id").alias("t")).agg(F.count(F.lit(1)).alias("n"))

    def side(own: str, other: str, name: str) -> DataFrame:
        return (
            pairs.filter(F.col(own).isNotNull())
            .groupBy(F.col(own).alias("id"))
            .agg(F.sum("n").alias(f"{name}_rows"), F.count(other).alias(f"{name}_partners"))
        )

    both = side("t", "f", "in").join(side("f", "t", "out"), "id", "full_outer").na.fill(0)
    return both.select("id", "in_rows", "in_partners", "out_rows", "out_partners", (F.col("in_rows") * F.col("out_rows")).alias("paths_through"))


def rows_by_node_kind(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(side, node_kind, n): rows of edges joined to rows of nodes by that side's id, per kind of node.

    Unknown kinds of nodes count as null. An id with several node rows counts once for each.
    """
    def one(side: str) -> DataFrame:
        left = edges.select(clean_id(side).alias("id"))
        right = nodes.select(clean_id("id").alias("id"), node_kind("kind").alias("node_kind"))
        return eager_join(left, right, "id", right_by=["node_kind"]).select(F.lit(side).alias("side"), "node_kind", "n")

    return one("to_id").unionByName(one("from_id"))
