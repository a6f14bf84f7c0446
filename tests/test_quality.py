from pyspark.sql import functions as F

from fathomgraph.operators import quality as Y


def test_bodies(spark):
    assert Y.normal_body("a = 1  # x\n\n\n  b = '#  y'  \n", "python") == "a = 1 b = '#  y'"
    assert Y.normal_body("f(/* a\n b */ 1, \"//  z\"); // end\n  g()", "rust") == 'f( 1, "//  z"); g()'
    assert Y.normal_body(None, "rust") is None and Y.normal_body("  ", None) == ""
    df = spark.createDataFrame([("x  //c", "go"), (None, "go")], "t string, l string")
    assert [r[0] for r in df.select(Y.normal_bodies("t", "l")).collect()] == ["x", None]


def test_downgrades(spark):
    dead = spark.createDataFrame([("a", "f", "no_callers", "High"), ("b", "g", "no_callers", "High"), ("c", None, "other", "High")], "id string, file string, reason string, confidence string")
    churn = spark.createDataFrame([("f", 3), ("g", 40)], "file string, last_touched_days int")
    assert {r.id: r.confidence for r in Y.downgraded_by_churn(dead, churn).collect()} == {"a": "Medium", "b": "High", "c": "High"}
    gaps = spark.createDataFrame([("f", []), ("g", ["x"]), ("g", [])], "file string, gaps array<string>")
    assert {r.id: r.confidence for r in Y.downgraded_by_gaps(dead, gaps).collect()} == {"a": "High", "b": "Low", "c": "High"}


def test_imports(spark):
    rows = [(["'vitest'"], "typescript"), (["@testing-library/react"], "javascript"), (["pytests"], "python"), (["unittest.mock"], "python"), (["pytest"], "rust"), (["\"org.junit.Foo\""], "Java"), (None, "python")]
    df = spark.createDataFrame(rows, "i array<string>, l string")
    assert [r[0] for r in df.select(Y.imports_test_framework(F.col("i"), F.col("l"))).collect()] == [True, True, False, True, False, True, False]


def test_budget(spark):
    df = spark.createDataFrame([("s", 1, "x" * 8), ("s", 2, None), ("s", 3, "y" * 5), ("s", 4, "z"), (None, 5, "a")], "source string, doc_id int, text string")
    assert sorted((r.doc_id, r.tokens) for r in Y.within_budget(df, "source", "doc_id", "text", 4).collect()) == [(1, 2), (2, 0), (3, 2), (5, 1)]
