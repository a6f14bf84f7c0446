"""Joins and running sums whose tasks stay small whatever the keys: checked broadcasts, hot keys dealt to slots, ranges with offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomgraph.plans.shared import kept

MAX_ROWS, MAX_BYTES = 200_000, 32_000_000
TASK_ROWS, TASK_BYTES = 500_000, 64_000_000


def fits_a_task(df: DataFrame) -> bool:
    """Whether an iterative algorithm may hold all of df in one task instead of joining it round by round. Reads df, like is_small."""
    return is_small(df, TASK_ROWS, TASK_BYTES)


def is_small(df: DataFrame, rows: int | None = None, size_limit: int | None = None) -> bool:
    """Whether df has few enough rows and bytes of text to be broadcast. Reads df: pass it kept or stored."""
    rows, size_limit = MAX_ROWS if rows is None else rows, MAX_BYTES if size_limit is None else size_limit
    texts = [F.octet_length(c) for c, t in df.dtypes if t == "string"]
    width = sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(8 * len(df.columns)))
    n, size = df.select(width.alias("w")).agg(F.count("w"), F.sum("w")).first()
    return n <= rows and (size or 0) <= size_limit


def hot_slots(keys: DataFrame, parts: int) -> DataFrame:
    """(id, slots) of the ids with more rows than a fair share of `parts` tasks: at most 4 * parts rows.

    keys: one column id, nulls left out. Partial counts come before the shuffle.
    """
    counts = keys.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return (
        counts.join(F.broadcast(total), F.col("n") * 4 * parts > F.col("total"))  # one row
        .filter("n > 1000")
        .select("id", F.ceil(F.col("n") * 4 * parts / F.col("total")).cast("int").alias("slots"))
    )


class Spread:
    """df with the rows of its hot keys dealt to slots, for joins on key with tables of few rows a key, which are copied to the slots.

    keys: rows that cost less than df and hold its keys about as often, where they are to be counted instead. Results do not depend on it.
    """

    def __init__(self, df: DataFrame, key: str, keys: DataFrame | None = None):
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.key = key
        self.hot = kept(hot_slots((df if keys is None else keys).select(F.col(key).alias("id")), parts).select(F.col("id").alias(key), F.col("slots").alias("__slots")))
        slot = F.when(F.col("__slots").isNull(), 0).otherwise(F.pmod(F.xxhash64(*df.columns), F.col("__slots")).cast("int"))
        self.df = df.join(F.broadcast(self.hot), key, "left").withColumn("__slot", slot).drop("__slots")  # at most 4 * parts rows

    def join(self, other: DataFrame, how: str = "inner") -> DataFrame:
        copies = other.join(F.broadcast(self.hot), self.key, "left").withColumn("__slot", F.explode(F.sequence(F.lit(0), F.coalesce("__slots", F.lit(1)) - 1))).drop("__slots")
        return self.df.join(copies.hint("shuffle_hash"), [self.key, "__slot"], how).drop("__slot")  # few rows a key: nothing is sorted


def sized_join(df: DataFrame, other: DataFrame, key: str, how: str = "inner", keys: DataFrame | None = None) -> DataFrame:
    """df.join(other, key, how) for inner, left, left_semi and left_anti: other is broadcast if it is small, else df's hot keys are spread.

    other is read twice: pass it kept or stored. df is read twice where other is not small, unless its hot keys are found in keys (see Spread).
    """
    return df.join(F.broadcast(other), key, how) if is_small(other) else Spread(df, key, keys).join(other, how)


def without(df: DataFrame, ids: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df without the rows one of whose columns is in ids(id)."""
    ids = kept(ids.distinct())
    small = is_small(ids)
    for c in columns:
        other = ids.select(F.col("id").alias(c))
        df = df.join(F.broadcast(other), c, "left_anti") if small else Spread(df, c).join(other, "left_anti")
    return df


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """df with `name`: the sum of value over the rows of the same `by` up to and with this one in `order`, which tells the rows of a group apart.

    Ranges of (by, order) are summed apart, and each starts from the sum of those before it, so a group may hold any share of all rows. Nulls sum as 0.
    """
    ranged = kept(df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "__range").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*[F.col(b) for b in by]).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("__range").alias("__r"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))  # a row for each range
    same = F.col("__range") == F.col("__r")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
    inner = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("__inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return summed.join(offsets, same).select(*df.columns, (F.col("__inner") + F.col("__offset")).alias(name))


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """df with `name`: 1, 2, ... in the order of the columns, which tell its rows apart."""
    keys = [f"__k{i}" for i in range(len(order))]
    marked = df.select("*", *[c.alias(k) for c, k in zip(order, keys)], F.lit(1).alias("__one"))
    return running_sums(marked, [], keys, "__one", name).select(*df.columns, name)


def let(value: Column, use) -> Column:
    """use(value), with value computed once a row however often use names it, and however far filters move."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
