import math
import struct

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomgraph.llm.quantiles import key_value, merged_percentiles, order_key, population_percentiles, radix_percentiles, radix_state, store_days, stored_days


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, v double").withColumn("key", order_key(F.col("v")))


def want(values, permille):
    ordered = sorted(values)
    return ordered[max(1, -(-len(ordered) * permille // 1000)) - 1]


def test_keys_order_as_doubles_and_come_back(spark):
    values = [-math.inf, -1e300, -2.5, -1e-320, -0.0, 0.0, 5e-324, 1e-9, 1.0, 1.0000000000000002, 9e99, math.inf]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", order_key(F.col("v")).alias("k")).withColumn("back", key_value(F.col("k"))).collect()
    assert [r.back for r in rows] == values
    assert [r.v for r in sorted(rows, key=lambda r: (r.k, rows.index(r)))] == values


def test_nulls_and_nan_are_no_values(spark):
    assert frame(spark, [("a", None), ("a", math.nan)]).filter("key is not null").count() == 0
    assert radix_percentiles(frame(spark, [("a", None), ("a", math.nan)]), ["g"]).count() == 0


def test_exact_against_sorting(spark):
    data = {"a": [0.0] * 50 + [i / 7 for i in range(100)], "b": [-3.0, -2.0, 1e300, 1e-300], "c": [5.0], "d": [-(i**3) / 3 for i in range(64)]}
    df = frame(spark, [(g, v) for g, vs in data.items() for v in vs] + [("a", None), ("e", math.nan)])
    permilles = (0, 1, 250, 500, 999, 1000)
    got = {(r.g, r.permille): (r.n, r.value) for r in radix_percentiles(df, ["g"], permilles).collect()}
    assert got == {(g, p): (len(vs), want(vs, p)) for g, vs in data.items() for p in permilles}


def test_states_add_up_and_are_bounded(spark):
    data = [i * 1.37 - 40 for i in range(200)]
    days = spark.createDataFrame([(str(i % 3), "a", v) for i, v in enumerate(data)], "day string, g string, v double").withColumn("key", order_key(F.col("v")))
    got = {r.permille: r.value for r in merged_percentiles(radix_state(days, ["day", "g"]), ["g"]).collect()}
    for p, v in got.items():
        exact = want(data, p)
        assert abs(exact) * (1 - 2**-12) <= abs(v) <= abs(exact)


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "id string, analyzed_at string, language string, cycle_ratio double, tangle_index double, dead_ratio double, key int, prefix int, rows int")
    assert population_percentiles(empty).count() == 0
    rows = [("x", "2024-01-01T00:00:00Z", " Rust ", 0.5, None, math.nan, 1, 2, 3)] * 2 + [("y", None, None, 1.5, 2.0, None, 1, 2, 3), (None, None, "rust", 9.0, 9.0, 9.0, 1, 2, 3)]
    got = {(r.language, r.metric, r.n, r.value) for r in population_percentiles(spark.createDataFrame(rows, empty.schema)).collect()}
    assert got == {("rust", "cycle_ratio", 1, 0.5), (None, "cycle_ratio", 1, 1.5), (None, "tangle_index", 1, 2.0)}


@given(st.lists(st.floats(allow_nan=False), min_size=2))
def test_the_mapping_orders_any_doubles(values):
    def key(v):
        bits = struct.unpack(">q", struct.pack(">d", v + 0.0 if v else 0.0))[0]
        return bits ^ 0x7FFFFFFFFFFFFFFF if bits < 0 else bits

    assert sorted(values) == sorted(values, key=key)


def test_stored_days_combine_and_late_rows_replace_their_month(spark, tmp_path):
    folder = str(tmp_path / "days")
    rows = [(f"2024-0{1 + i % 3}-0{1 + i % 7}", "a", float(i)) for i in range(90)] + [(None, "a", 3.0)]
    frame_of = lambda some: spark.createDataFrame(some, "day string, g string, v double").select(F.col("day").cast("date").alias("day"), "g", order_key(F.col("v")).alias("key"))
    answer = lambda: {r.permille: (r.n, r.value) for r in merged_percentiles(stored_days(spark, folder), ["g"]).collect()}
    store_days(radix_state(frame_of(rows), ["day", "g"]), folder)
    first = answer()
    assert {n for n, _ in first.values()} == {91}
    late = [r for r in rows if r[0] and r[0][6] == "2"] + [("2024-02-03", "a", 500.0)] * 9
    store_days(radix_state(frame_of(late), ["day", "g"]), folder)
    assert {n for n, _ in answer().values()} == {100} and answer()[990][1] > first[990][1]
