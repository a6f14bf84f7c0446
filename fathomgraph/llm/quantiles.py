"""Percentiles of very large numeric columns by radix selection.

A double maps to a 64-bit integer of the same order. A pass histograms one digit of these integers; the next
pass looks only at values that share the digits followed so far, one prefix per target rank. Each pass shuffles
partial histograms (at most 2 ** DIGIT rows per group and followed prefix), never the values. All 64 bits give
the exact value; the histogram of the first bits alone is a state that sums over partitions or days and answers
with a relative error below 2 ** (12 - bits).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from fathomgraph.functions.text_ids import stripped
from fathomgraph.plans.shared import kept, shared_folder

DIGIT = 16
MAX_BROADCAST_TARGETS = 100_000
PERMILLES = (50, 250, 500, 750, 900, 950, 990)


LOW_BITS = np.int64(0x7FFFFFFFFFFFFFFF)


@F.arrow_udf(LongType())
def _keys(values: pa.Array) -> pa.Array:
    """A view of a batch of doubles as integers, with the lower bits of negative ones turned over."""
    v = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0.0 becomes 0.0, null becomes NaN
    bits = v.view(np.int64)
    return pa.array(np.where(bits < 0, bits ^ LOW_BITS, bits), mask=np.isnan(v))


@F.arrow_udf(DoubleType())
def _values(keys: pa.Array) -> pa.Array:
    k = keys.to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.array(np.where(k < 0, k ^ LOW_BITS, k).view(np.float64))


def order_key(value: Column) -> Column:
    """A bigint that orders as the double does; -0.0 counts as 0.0. Null and NaN give null."""
    return _keys(value.cast("double"))


def key_value(key: Column) -> Column:
    """The double of an order_key that is not null."""
    return _values(key)


def _followed(histogram: DataFrame, by: Sequence[str], targets: DataFrame) -> DataFrame:
    """Of each target (by, permille, n, rank) in its group `by`, the prefix in which it lies and its rank there."""
    up_to = Window.partitionBy(*by).orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = histogram.withColumn("through", F.sum("rows").over(up_to)).withColumn("before", F.col("through") - F.col("rows"))
    hit = targets.join(steps, list(by))
    return hit.filter((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("through"))).withColumn("rank", F.col("rank") - F.col("before")).drop("before", "through", "rows")


def _targets(histogram: DataFrame, groups: Sequence[str], permilles: Sequence[int]) -> DataFrame:
    n = histogram.groupBy(*groups).agg(F.sum("rows").alias("n"))
    each = n.withColumn("permille", F.explode(F.array(*[F.lit(p) for p in permilles])))
    return each.withColumn("rank", F.greatest(F.lit(1), F.floor((F.col("n") * F.col("permille") + 999) / 1000)).cast("bigint"))


def radix_percentiles(keys: DataFrame, groups: Sequence[str], permilles: Sequence[int] = PERMILLES) -> DataFrame:
    """(groups, permille, n, value): the exact value of rank max(1, ceil(n * permille / 1000)) of each group.

    keys: groups (not null) and `key`, an order_key; null keys are left out, and groups without any key give no
    rows. Ties and repeated keys count as often as they stand. permilles run from 0 to 1000. keys is read 64 / DIGIT times: pass
    it kept or stored.
    """
    groups = list(groups)
    keys = keys.filter("key is not null")
    prefix = lambda k: F.shiftright("key", 64 - DIGIT * k)
    first = kept(keys.groupBy(*groups, prefix(1).alias("prefix")).agg(F.count(F.lit(1)).alias("rows")))
    follow = kept(_followed(first, groups, _targets(first, groups, permilles)))
    for k in range(2, 64 // DIGIT + 1):
        wanted = follow.select(*groups, F.col("prefix").alias("parent")).distinct()
        if follow.count() <= MAX_BROADCAST_TARGETS:
            wanted = F.broadcast(wanted)
        inside = keys.withColumn("parent", prefix(k - 1)).join(wanted, [*groups, "parent"], "left_semi")
        histogram = inside.groupBy(*groups, "parent", prefix(k).alias("prefix")).agg(F.count(F.lit(1)).alias("rows"))
        follow = kept(_followed(histogram, [*groups, "parent"], follow.withColumnRenamed("prefix", "parent")).drop("parent"))
    return follow.select(*groups, "permille", "n", key_value(F.col("prefix")).alias("value"))


def radix_state(keys: DataFrame, groups: Sequence[str], bits: int = 24) -> DataFrame:
    """(groups, prefix, rows): the histogram of the keys' first bits, to be stored per partition or day."""
    return keys.filter("key is not null").groupBy(*groups, F.shiftright("key", 64 - bits).alias("prefix")).agg(F.count(F.lit(1)).alias("rows"))


def store_days(states: DataFrame, folder: str) -> None:
    """Writes states(day, groups, prefix, rows) by month of the day. Only the months that states hold are replaced, so late rows mean their months' states anew."""
    month = F.coalesce(F.date_format("day", "yyyy-MM"), F.lit("none"))
    states.withColumn("month", month).repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(folder)


def stored_days(spark: SparkSession, folder: str) -> DataFrame:
    """The states of store_days: what percentiles of any days are made from, without the values."""
    return spark.read.parquet(folder)


def merged_percentiles(states: DataFrame, groups: Sequence[str], bits: int = 24, permilles: Sequence[int] = PERMILLES) -> DataFrame:
    """(groups, permille, n, value) of the sum of states: the lower edge (towards zero) of the prefix that holds the rank.

    The exact value lies in the same prefix: it is larger in size by less than one part in 2 ** (bits - 12).
    """
    groups = list(groups)
    total = kept(states.groupBy(*groups, "prefix").agg(F.sum("rows").alias("rows")))
    hit = _followed(total, groups, _targets(total, groups, permilles))
    low = F.shiftleft("prefix", 64 - bits)
    edge = F.when(F.col("prefix") < 0, low.bitwiseOR(F.lit((1 << (64 - bits)) - 1))).otherwise(low)
    return hit.select(*groups, "permille", "n", key_value(edge).alias("value"))


METRICS = ("cycle_ratio", "tangle_index", "dead_ratio")


def population_keys(population: DataFrame) -> DataFrame:
    """(day, language, metric, key) of each distinct id: its day of analysis in UTC, its language trimmed and lower-cased ('' for none).

    Rows without an id are left out; should rows of one id differ, the least counts. Kept, as it is read more than once.
    """
    language = F.coalesce(F.lower(stripped("language")), F.lit(""))
    day = F.date_from_unix_date(F.floor(F.unix_seconds(F.try_to_timestamp("analyzed_at")) / 86400).cast("int"))
    row = F.struct(language.alias("language"), day.alias("day"), *[F.col(m).cast("double").alias(m) for m in METRICS])
    one = population.filter("id is not null").groupBy("id").agg(F.min(row).alias("r"))
    wide = kept(one.select("r.language", "r.day", *[order_key(F.col(f"r.{m}")).alias(m) for m in METRICS]))
    return wide.select("day", "language", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("key")) for m in METRICS])).alias("x")).select("day", "language", "x.*")


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("language", F.when(F.col("language") != "", F.col("language")))


def population_percentiles(population: DataFrame) -> DataFrame:
    """(language, metric, permille, n, value): exact percentiles per language, null for rows without one."""
    return _named(radix_percentiles(population_keys(population), ["language", "metric"]))


def population_percentiles_of_days(population: DataFrame) -> DataFrame:
    """The same from one stored 24-bit state per day, summed: relative error below 2 ** -12. The values are read for the states alone."""
    folder = f"{shared_folder(population.sparkSession)}/population-days-{uuid.uuid4().hex[:8]}"
    store_days(radix_state(population_keys(population), ["day", "language", "metric"]), folder)
    return _named(merged_percentiles(stored_days(population.sparkSession, folder), ["language", "metric"]))
