"""Graphs beyond one task of names: solved as hashes, and joined without computing a side twice."""

import random
import re

import pytest
from test_graph import brute_components

from fathomgraph.functions import paths as P
from fathomgraph.operators import components as C
from fathomgraph.operators import metrics as M
from fathomgraph.operators import report as R
from fathomgraph.operators import skew


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def no_names(monkeypatch):
    """No task may hold links by name, and nothing goes round by round."""
    monkeypatch.setattr(skew, "TASK_ROWS", 0)

    def never(*_):
        raise AssertionError("goes round by round")

    monkeypatch.setattr(C, "Rounds", never)
    monkeypatch.setattr(C, "trimmed", never)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_by_hash(spark, no_names, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}") for _ in range(50)] + [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [(f"w{i}", f"w{i + 1}") for i in range(9)]
    _, want = brute_components(pairs)
    got = C.strong_components(spark.createDataFrame(pairs * 2, "src string, dst string")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert all(r["size"] == sum(c == r.component for c in want.values()) for r in got)
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)], "src string, dst string")
    assert C.strong_components(chain).count() == 0


def test_depth_by_hash(spark, no_names):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("y", "d"), ("d", "d"), ("a", "b")], "src string, dst string")
    cyclic = spark.createDataFrame([("x",), ("y",)], "node string")
    assert rows(C.longest_depth(links, cyclic)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("y", 0)]


def test_ends_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """The answer then comes from names, round by round."""
    monkeypatch.setattr(skew, "TASK_ROWS", 0)
    monkeypatch.setattr(C.F, "xxhash64", lambda *_: C.F.lit(7).cast("bigint"))
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert rows(C.strong_components(links)) == [(x, "a", 3) for x in "abc"]
    assert rows(C.longest_depth(links, C.strong_components(links))) == [("c", 0), ("d", 1)]


def test_hot_keys_are_found_ahead_of_joins(spark, monkeypatch):
    """Counting the keys of a second join must not compute the first."""
    monkeypatch.setattr(skew, "MAX_ROWS", 0)
    plans, found = [], skew.hot_slots
    monkeypatch.setattr(skew, "hot_slots", lambda keys, parts: plans.append(keys._jdf.queryExecution().optimizedPlan().toString()) or found(keys, parts))
    edges = spark.createDataFrame([("a", "b", "Call", "High"), ("b", "c", "Call", "Low"), ("c", "a", "Import", "High")], "from_id string, to_id string, kind string, confidence string")
    modules = spark.createDataFrame([("a", "m"), ("b", "n")], "id string, module string")
    assert [tuple(r) for r in M.module_edges(edges, modules).orderBy("from_id").collect()] == [("a", "b", "Call", "High", "m", "n"), ("b", "c", "Call", "Low", "n", None), ("c", "a", "Import", "High", None, "m")]
    depth = spark.createDataFrame([("a", 0), ("b", 1), ("c", 3)], "node string, depth int")
    none, fans, ids = spark.createDataFrame([], "node string"), spark.createDataFrame([("a", 0)], "id string, fan_in bigint"), spark.createDataFrame([("a",)], "id string")
    assert rows(C.layer_violations(edges, depth, none, fans, ids, spark.createDataFrame([(5,)], "threshold bigint"))) == [("b", "c", 1, 3, 2)]
    assert len(plans) >= 4 and not [p for p in plans if "Join" in p]


def test_hotspots_look_at_links_to_hot_functions_alone(spark, monkeypatch):
    met, join = [], skew.sized_join
    monkeypatch.setattr(R, "sized_join", lambda df, other, *rest: met.append(rows(other)) or join(df, other, *rest))
    hot = spark.createDataFrame([("a", 9, 3), ("b", 8, 3), ("t", 9, 3)], "id string, fan_in bigint, threshold bigint")
    links = spark.createDataFrame([("x", "a"), ("y", "a"), ("x", "t"), ("x", "z"), ("b", "b")], "src string, dst string")
    own = spark.createDataFrame([("a",), ("b",), ("z",)], "id string")
    assert rows(R.hotspot_findings(hot, own, links).select("primary_node", "severity")) == [("a", "High"), ("b", "Warning")]
    assert met == [[("a",), ("b",)]]


def test_non_production_paths_as_the_whole_pattern_says(spark):
    rng = random.Random(5)
    parts = ["test", "tests", "spec", "src", "__tests__", "a_test.py", "test_a.py", "x.config.js", ".eslintrc.js", "tsconfig.json", "docs", "latest", "contest.x", ".jest", ".jest.a", "e2e", "my-mock", "a.spec.ts", "perfume", ".yml", "B__mocks__", "", "a.TESTS.b"]
    paths = ["/".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(600)] + [a + s + b for a in parts for s in "-_.\\" for b in parts]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", P.is_non_production_path("p").alias("x"))
    want = {p: bool(re.search(P.NON_PRODUCTION_PATH, p.replace("\\", "/").lower())) for p in paths}
    assert {r.p: r.x for r in got.collect()} == want and len(set(want.values())) == 2
