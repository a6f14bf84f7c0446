"""The graph operators against brute force and by hand."""

import random
from datetime import datetime
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fathomgraph.functions import filters as X
from fathomgraph.functions import paths as P
from fathomgraph.operators import components as C
from fathomgraph.operators import interactive as I
from fathomgraph.operators import metrics as M
from fathomgraph.operators import resolution as R
from fathomgraph.operators import skew
from fathomgraph.operators import subsets as S
from fathomgraph.operators import template as T
from fathomgraph.operators.incremental import structure_fingerprint, trust_level
from fathomgraph.sources.graph import check_columns, graph_edges, graph_nodes, raw_edges

EDGE = "from_id string, to_id string, kind string, source string, confidence string, recorded_at int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def call_edges(spark, pairs, kind="Call"):
    return spark.createDataFrame([(a, b, kind, s, "High", 1) for a, b, *rest in pairs for s in [rest[0] if rest else "Lsp"]], EDGE)


@pytest.fixture(scope="module")
def small(spark):
    """Ten nodes: root -> mid -> leaf -> root, four callers of hot, an orphan."""
    names = ["fn_root", "fn_mid", "fn_leaf", "fn_caller_a", "fn_caller_b", "fn_hot", "fn_orphan"]
    nodes = spark.createDataFrame([(n, "Function", f"crate::{'b' if n == 'fn_hot' else 'a'}::{n[3:]}", "src/b.rs" if n == "fn_hot" else "src/a.rs") for n in names], "id string, kind string, fqn string, file string")
    pairs = [("fn_root", "fn_mid"), ("fn_mid", "fn_leaf", "TreeSitter"), ("fn_root", "fn_hot", "TreeSitter"), ("fn_mid", "fn_hot"), ("fn_caller_a", "fn_hot", "TreeSitter"), ("fn_caller_b", "fn_hot", "Heuristic"), ("fn_leaf", "fn_root", "?")]
    return nodes, call_edges(spark, pairs)


def test_interactive(spark, small):
    nodes, edges = small
    assert [(r.id, r.n) for r in I.top_fan(edges, nodes, limit=2).collect()] == [("fn_hot", 4), ("fn_leaf", 1)]
    assert {r.id for r in I.uncalled_functions(edges, nodes).collect()} == {"fn_caller_a", "fn_caller_b", "fn_orphan"}
    hot = I.seeds_of(spark, ["fn_hot"])
    assert {(r.id, r.tier) for r in I.neighbours(edges, nodes, hot, "in").collect()} == {("fn_root", "tier_0"), ("fn_mid", "tier_3"), ("fn_caller_a", "tier_0"), ("fn_caller_b", "tier_1")}
    assert rows(I.reach(edges, hot, "in", 2)) == sorted([("fn_root", 1, ["fn_hot"], "tier_0"), ("fn_mid", 1, ["fn_hot"], "tier_3"), ("fn_caller_a", 1, ["fn_hot"], "tier_0"), ("fn_caller_b", 1, ["fn_hot"], "tier_1"), ("fn_leaf", 2, ["fn_hot"], None)], key=repr)
    assert [r.id for r in I.shortest_path(edges, "fn_leaf", "fn_hot").orderBy("step").collect()] == ["fn_leaf", "fn_root", "fn_hot"]
    assert I.shortest_path(edges, "fn_hot", "fn_leaf").count() == 0 and I.shortest_path(edges, "x", "x").count() == 1
    assert rows(I.simple_cycles(edges, 4)) == [(["fn_leaf", "fn_root", "fn_mid"], 3)]
    assert [r.how for r in I.resolve_symbol(nodes, "crate::b::hot").collect()] == ["fqn"]
    assert [(r.id, r.how) for r in I.resolve_symbol(nodes, "caller_a").collect()] == [("fn_caller_a", "suffix")]
    assert I.resolve_symbol(nodes, "ca").count() == 0 and I.is_too_generic("parse") and not I.is_too_generic("a::b")
    assert I.top_fan(edges.limit(0), nodes).count() == I.reach(edges.limit(0), hot).count() == I.simple_cycles(edges.limit(0)).count() == 0


def brute_components(pairs):
    ahead = defaultdict(set)
    for a, b in pairs:
        ahead[a].add(b)

    def reach(s):
        seen, todo = set(), [s]
        while todo:
            for y in ahead[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    nodes = {x for p in pairs for x in p}
    far = {v: reach(v) for v in nodes}
    return far, {v: min([v, *[w for w in far[v] if v in far[w]]]) for v in nodes if any(w != v and v in far[w] for w in far[v])}


@pytest.fixture(params=["small", "large"])
def size(request, monkeypatch):
    """large: nothing counts as small, so nothing is broadcast or solved in one task."""
    if request.param == "large":
        monkeypatch.setattr(skew, "MAX_ROWS", 0)
        monkeypatch.setattr(skew, "TASK_ROWS", 0)
        monkeypatch.setattr(C, "NUMBERED_TASK_ROWS", 0)
    return request.param


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_reach(spark, seed, size):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}") for _ in range(40)] + [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("n01", "z1"), ("z1", "n01")]
    links = spark.createDataFrame(pairs, "src string, dst string")
    far, want = brute_components(pairs)
    got = C.strong_components(links).collect()
    assert {r.node: r.component for r in got} == want
    seeds = spark.createDataFrame([("n05",), ("r1",), ("lonely",)], "id string")
    back = {v: sum(v in far[w] for w in far if w != v) for v in far}
    assert {r.id: r.blast for r in C.blast_radius(links, seeds).collect()} == {"n05": back.get("n05", 0), "r1": 4, "lonely": 0}
    assert C.strong_components(links.limit(0)).count() == 0


def test_depth(spark, size):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("y", "d"), ("d", "d")], "src string, dst string")
    cyclic = spark.createDataFrame([("x",), ("y",)], "node string")
    assert {r.node: r.depth for r in C.longest_depth(links, cyclic).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "y": 0}


def test_cohesion(spark, size):
    edges = call_edges(spark, [("a", "b"), ("c", "out"), ("d", "out"), ("far", "e"), ("far", "f")])
    functions = spark.createDataFrame([(x,) for x in "abcdefg"], "id string")
    modules = spark.createDataFrame([(x, "m") for x in "abcdefg"] + [("out", "o"), ("far", "o")], "id string, module string")
    assert rows(C.cohesion(edges, functions, modules)) == [("m", 7, 4, 0.25)]


def test_only_tests_import(spark):
    imports = spark.createDataFrame([("t", "a"), ("a", "b"), ("p", "c"), ("t", "c"), ("t", "d")], "importer string, file string")
    tests, production = spark.createDataFrame([("t",)], "file string"), spark.createDataFrame([("d",)], "file string")
    assert {r.file for r in C.test_only_files(imports, tests, production).collect()} == {"t", "a", "b"}


def test_thresholds(spark):
    values = spark.createDataFrame([(i // 2,) for i in range(40)], "v int")
    ordered = sorted(i // 2 for i in range(40))
    assert M.percentile_floor(values, "v", 95, 3).first()[0] == ordered[37]
    assert M.percentile_floor(values.limit(0), "v", 95, 3).first()[0] == 3
    fans = values.select(F.col("v").alias("fan_in"), F.lit("f").alias("id"))
    functions = spark.createDataFrame([("f",)], "id string")
    assert M.layer_exclusion_threshold(fans.unionByName(fans.select((F.col("fan_in") + 99).alias("fan_in"), F.lit("file").alias("id"))), functions).first()[0] == sorted(x for x in ordered if x)[min(38 * 95 // 100, 37)]


def test_paths(spark):
    given = {"src/a.rs": None, "tests/x.py": "test", "src/contest/x.py": None, "a/b.spec.ts": "test", "docs/example/x.md": "docs", "bench/x.rs": "benchmark", ".eslintrc.js": "config", "x/jest.config.ts": "config", ".husky/pre": "config", "scripts/go.sh": "auxiliary", "A\\Test_util\\b.cs": "test", None: None}
    df = spark.createDataFrame([(k,) for k in given], "p string")
    assert {r.p: r.r for r in df.select("p", P.path_role("p").alias("r")).collect()} == given
    keys = spark.createDataFrame([("src/a/b/c.rs",), ("main.rs",), ("src",), ("",), ("/x//y/z",)], "p string")
    assert [r[0] for r in keys.select(P.folder_key("p", 2)).collect()] == ["src/a", ".", "src", None, "x/y"]
    build = spark.createDataFrame([("gson/src/main/java/com/X.java",), ("src/test/java/T.java",), ("lib/u.java",)], "p string")
    assert [r[0] for r in build.select(P.without_build_dirs("p")).collect()] == ["gson/com/X.java", "T.java", "lib/u.java"]
    names = spark.createDataFrame([("a::b::c",), ("one",), (None,)], "f string")
    assert [tuple(r) for r in names.select(P.last_name("f"), P.display_name("f")).collect()] == [("c", "b::c"), ("one", "one"), (None, None)]


def test_filters():
    f = X.parse_node_filter("kind in ['Method', \"trait\"] AND is_test == false and role == 'source' and path_repo_rel starts_with 'a and b'")
    assert (f.kinds, f.roles, f.flags, f.prefixes) == (["Function", "Interface"], ["source"], {"is_test": False}, ["a and b"])
    assert X.parse_edge_filter("rel in ['Calls', 'uses']") == ["Call", "Uses"]
    for bad in ("kind == 'Impl'", "kind == 'File' or is_test == true", "not is_test == true", "(kind == 'File')", "kind != 'File'", "kind in []", "kind == 'File' and", "size == '3'", "!x"):
        with pytest.raises(X.FilterError):
            X.parse_node_filter(bad)


def test_traversal(spark):
    nodes = spark.createDataFrame([(x, "Function", x, None, False) for x in "abcde"], "id string, kind string, fqn string, path_repo_rel string, is_test boolean")
    edges = call_edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")])
    seeds = T.resolve_seeds(nodes, ids=("A",))
    met, inside = T.traverse(nodes, edges, seeds, 2)
    assert rows(met) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)] and inside.count() == 4
    assert rows(T.traverse(nodes, edges, T.resolve_seeds(nodes, ids=("d",)), 1, "both")[0]) == [("b", 1), ("c", 1), ("d", 0), ("e", 1)]
    with pytest.raises(T.TooLarge):
        T.traverse(nodes, edges, seeds, 26)
    with pytest.raises(T.TooLarge):
        T.guarded(nodes, 4, "nodes")


def test_loading_dirty_nodes(spark, size):
    raw = spark.createDataFrame(
        [(" A", "function", "m::f", '{"file":"x.rs","start_line":1,"end_line":3}', '{"is_test":"true","cyclomatic_complexity":"3","language":"Rust","path_repo_rel":5}', 1), ("b", "Odd", "b", None, None, 1), (None, "File", "c", None, None, 1), ("d", "File", None, "oops", '{"x":', 9)],
        "id string, kind string, fqn string, location string, properties string, n int",
    )
    got = {r.id: r for r in graph_nodes(raw).collect()}
    assert set(got) == {"a", "d"}
    a = got["a"]
    assert (a.kind, a.name, a.is_test, a.cyclomatic_complexity, a.language, a.path_repo_rel, a.file, a.end_line) == ("Function", "f", False, None, "rust", None, "x.rs", 3)
    with pytest.raises(ValueError):
        check_columns(raw.drop("fqn"), "nodes")
    edges = spark.createDataFrame([("a", "D ", "CALL"), ("a", "gone", "Call"), ("a", "d", "what"), (None, "d", "Call")], "from_id string, to_id string, kind string")
    assert rows(graph_edges(edges, graph_nodes(raw)).select("from_id", "to_id", "kind")) == [("a", "d", "Call")]


def test_nearest_ancestor(spark):
    values = spark.createDataFrame([("r", "R"), ("a", None), ("b", None), ("c", "C"), ("d", None), ("x", None), ("y", None)] + [(f"k{i}", None) for i in range(20)], "node string, value string")
    parents = spark.createDataFrame([("a", "r"), ("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("k0", "d")] + [(f"k{i}", f"k{i - 1}") for i in range(1, 20)], "node string, parent string")
    got = {r.node: r.value for r in S.nearest_ancestor(values, parents).collect()}
    assert got == {"r": "R", "a": "R", "b": "R", "c": "C", "d": "C", "x": None, "y": None} | {f"k{i}": "C" for i in range(20)}


def test_resolution(spark):
    symbols = spark.createDataFrame([("s1", "m::a::f"), ("s2", "m::b::f"), ("s3", "m::a::g")], "symbol string, fqn string")
    sites = spark.createDataFrame([("1", "m::a::f", None), ("2", "f", "m::b"), ("3", "a::g", None), ("4", "f", None), ("5", "zz", None)], "site string, name string, module string")
    assert rows(R.cascade(sites, symbols)) == [("1", "s1", "High"), ("2", "s2", "High"), ("3", "s3", "Medium"), ("4", "s1", "Low"), ("4", "s2", "Low")]
    functions = spark.createDataFrame([("s1", "m::f", "src/a.rs"), ("s2", "t::f", "tests/a.rs"), ("s3", "m::g", "src/a.rs"), ("s4", "n::g", "src/b.rs")], "symbol string, fqn string, path string")
    calls = spark.createDataFrame([("1", "c", "f", "src/x.rs", False), ("2", "c", "g", "src/x.rs", False), ("3", "c", "g", "src/x.rs", True), ("4", "s1", "f", "src/x.rs", True)], "site string, caller string, name string, path string, is_method boolean")
    assert rows(R.fallback_calls(calls, functions)) == [("c", "s1", "Low"), ("c", "s3", "Low"), ("c", "s4", "Low")]
    nodes, links = R.containment_from_paths(spark.createDataFrame([("a/b/c.rs",), ("./a/d.rs",), ("",), (None,)], "path string"), "root")
    assert {(r.key, r.kind) for r in nodes.collect()} == {("a", "Folder"), ("a/b", "Folder"), ("a/b/c.rs", "File"), ("a/d.rs", "File")}
    assert rows(links) == [("a", "a/b"), ("a", "a/d.rs"), ("a/b", "a/b/c.rs"), ("root", "a")]


def test_fingerprint_ignores_order_and_body(spark):
    nodes = spark.createDataFrame([("1", "f", "rust"), ("2", "g", "rust")], "id string, fqn string, language string")
    moved = spark.createDataFrame([("9", "f", "rust"), ("8", "g", "rust")], "id string, fqn string, language string")
    one = structure_fingerprint(nodes, call_edges(spark, [("1", "2"), ("2", "1")])).first()
    two = structure_fingerprint(moved, call_edges(spark, [("8", "9"), ("9", "8"), ("9", "8")])).first()
    assert one.fingerprint == two.fingerprint != structure_fingerprint(nodes, call_edges(spark, [("1", "2")])).first().fingerprint
    assert [trust_level(0, 9, False), trust_level(6, 999, False), trust_level(1, 999, False), trust_level(1, 999, True)] == ["L0", "L1", "L2", "L3"]


def test_sized_and_spread_joins(spark, size):
    left = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("none", 3)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got, want = skew.sized_join(left, right, "k", how), left.join(right, "k", how)
        assert got.columns == want.columns and rows(got) == rows(want)
    assert rows(skew.without(left, right.select(F.col("k").alias("id")), ["k"])) == rows(left.join(right, "k", "left_anti").select("k", "id"))


def test_running_sums(spark):
    data = [("a", i, i % 5) for i in range(500)] + [("b", 1, 7), (None, 2, 4), (None, 3, None)]
    got = skew.running_sums(spark.createDataFrame(data, "g string, o int, v int"), ["g"], ["o"], "v", "s")
    total, want = {}, []
    for g, o, v in sorted(data, key=lambda r: (r[0] or "", r[1])):
        total[g] = total.get(g, 0) + (v or 0)
        want.append((g, o, v, total[g]))
    assert rows(got) == sorted(want, key=repr)


def test_last_edge_and_evidence(spark, size):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    e = spark.createDataFrame(
        [("a", "b", "Call", '{"source":"Lsp","confidence":"Low"}', at(1)), ("A", "b ", '{"kind":"call"}', '{"source":"Heuristic","confidence":"High"}', at(2)), ("b", "a", "Call", None, None), ("b", "a", "call", '{"source":"TreeSitter","confidence":"Medium"}', None)],
        "from_id string, to_id string, kind string, provenance string, recorded_at timestamp_ntz",
    )
    assert rows(raw_edges(e)) == sorted([("a", "b", "Call", "Heuristic", "High", at(2)), ("b", "a", "Call", "Unknown", "Unknown", None)], key=repr)
    assert raw_edges(e.limit(0)).count() == 0


def test_capped_blast_radius(spark, small):
    nodes, edges = small
    near, more = I.blast_radius_of(edges, nodes, "fn_hot", 2, cap=2)
    assert [r.id for r in near.collect()] == ["fn_caller_a", "fn_caller_b"] and more
    assert not I.blast_radius_of(edges, nodes, "fn_hot", 2)[1]
    with pytest.raises(I.NotAFunction):
        I.blast_radius_of(edges, nodes, "nobody")
    assert {r.id for r in I.file_blast_radius(edges, nodes, "src/b.rs", 1).collect()} == {"fn_root", "fn_mid", "fn_caller_a", "fn_caller_b"}
