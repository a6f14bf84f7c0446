"""Small fixtures for the general problems: nulls, blanks, ties, repeats, empty tables, clashing columns."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fathomgraph.functions.text_ids import clean_id, edge_confidence, edge_kind, edge_source, node_kind
from fathomgraph.operators import hierarchy as h
from fathomgraph.operators.hot_keys import eager_join, fan, hot_ids, rows_by_node_kind
from fathomgraph.operators import skew
from fathomgraph.operators.orphans import edge_orphans, orphans, orphans_by_month
from fathomgraph.operators.skew import hot_slots
from fathomgraph.operators.snapshot_diff import graph_changes, run_order, snapshot_changes

EDGES = "edge_id bigint, from_id string, to_id string, kind string, provenance string, recorded_at timestamp_ntz, id string, n int, side string, slot int"
NODES = "id string, kind string, recorded_at timestamp_ntz, removed_at timestamp_ntz, endpoint string, n int, slots int"


def at(day):
    return None if day is None else datetime(2024, 1, day)


def edges(spark, rows):
    return spark.createDataFrame([(i, f, t, k, None, at(d), "x", 1, "y", 2) for i, f, t, k, d in rows], EDGES)


def nodes(spark, rows):
    return spark.createDataFrame([(i, k, at(a), at(b), "x", 1, 2) for i, k, a, b in rows], NODES)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_kinds(spark):
    given = ['{"kind":"Call"}', " CALL ", '{"sub":null,"kind":"call"}', '{"kind":"framework","sub":"visualforcepage"}', "Framework", '{"kind":"Dispatches"}', "{broken", "", None, '{"kind":"Call","sub":"x"}']
    df = spark.createDataFrame([(k,) for k in given], "kind string")
    assert [r[0] for r in df.select(edge_kind("kind")).collect()] == ["Call", "Call", "Call", "Framework:VisualforcePage", None, None, None, None, None, None]
    prov = spark.createDataFrame([('{"source":"lsp", "confidence":"High"}',), ("{}",), (None,), ("oops",)], "p string")
    assert [tuple(r) for r in prov.select(edge_source("p"), edge_confidence("p")).collect()] == [("Lsp", "High")] + [("Unknown", "Unknown")] * 3
    ids = spark.createDataFrame([(" AB ",), ("",), ("  ",), (None,)], "i string")
    assert [r[0] for r in ids.select(clean_id("i")).collect()] == ["ab", None, None, None]
    assert spark.range(1).select(node_kind(F.lit("file"))).first()[0] == "File"


def test_hot_keys(spark):
    e = edges(spark, [(1, "A", "h", None, 1)] * 3 + [(2, "b", " H ", None, 1), (3, "c", "", None, 1), (4, None, "z", None, 1)])
    assert rows(hot_ids(e, 0.5)) == [("from_id", "a"), ("to_id", "h")]
    assert rows(fan(e)) == [("a", 0, 0, 3, 1, 0), ("b", 0, 0, 1, 1, 0), ("c", 0, 0, 1, 0, 0), ("h", 4, 2, 0, 0, 0), ("z", 1, 0, 0, 0, 0)]
    empty = e.limit(0)
    assert hot_ids(empty).count() == fan(empty).count() == rows_by_node_kind(empty, nodes(spark, [])).count() == 0
    n = nodes(spark, [("h", "file", 1, 2), ("H", "File", 2, 3), ("a", "odd", 1, None), (None, "File", 1, None)])
    assert rows(rows_by_node_kind(e, n)) == [("from_id", None, 3), ("to_id", "File", 8)]


def test_eager_join_equals_the_join(spark):
    left = spark.createDataFrame([(i % 3 or None, i % 2, float(i)) for i in range(40)], "k int, l int, x double")
    right = spark.createDataFrame([(i % 4 or None, i % 5, i if i % 7 else None) for i in range(50)], "k int, r int, y int")
    want = left.join(right, "k").groupBy("l", "r").agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))
    assert rows(eager_join(left, right, "k", ["l"], ["r"], ["x"], ["y"])) == rows(want)
    assert eager_join(left, right.limit(0), "k").count() == 0
    with pytest.raises(ValueError):
        eager_join(left, right, "k", ["l"], ["l"])


def test_orphans(spark):
    n = nodes(spark, [("a", "File", 5, 10), ("A ", "File", 12, None), ("b", "File", 20, None), ("c", "File", 1, 3), ("d", "File", 4, 4), ("o", "File", 1, 9), ("o", "File", 5, None), ("z", "File", None, 2), (None, "File", 1, None)])
    e = edges(spark, [(1, "a", "b", None, 7), (1, "a", "b", None, 7), (2, "A", None, None, 10), (3, "a", "q", None, 12), (4, "c", " ", None, 3), (5, "d", "d", None, 4), (6, "o", "a", None, 9), (7, "b", "q", None, None), (8, "z", "z", None, 1)])
    assert rows(edge_orphans(e, n)) == sorted(
        [(1, "to", "late", "2024-01"), (2, "from", "deleted", "2024-01"), (3, "to", "missing", "2024-01"), (4, "from", "deleted", "2024-01"), (5, "from", "deleted", "2024-01"), (5, "to", "deleted", "2024-01"),
         (7, "from", "late", None), (7, "to", "missing", None), (8, "from", "late", "2024-01"), (8, "to", "late", "2024-01")], key=repr)
    assert sum(r.n for r in orphans_by_month(e, n).collect()) == 10
    assert edge_orphans(e.limit(0), n).count() == 0
    assert {r.reason for r in edge_orphans(e, n.limit(0)).collect()} == {"missing"}


def test_hot_references_are_split_and_none_is_lost(spark):
    refs = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("id"), F.expr("timestamp_ntz'2024-01-05' + make_interval(0,0,0,id % 9)").alias("at"), F.col("id").alias("ref"))
    assert [r.id for r in hot_slots(refs.select("id"), 4).collect()] == ["hot"]
    parents = spark.createDataFrame([("hot", at(1), at(9)), ("k1", at(20), None)], "id string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    got = {(r.id == "hot", r.reason): r["count"] for r in orphans(refs, parents, 4).groupBy("id", "reason").count().groupBy("id", "reason").agg(F.sum("count").alias("count")).collect() if r.id == "hot"}
    assert got == {(True, "deleted"): refs.filter("id = 'hot' and at >= timestamp_ntz'2024-01-09'").count()}


def walk(links):
    """Brute force over {node: parent}."""
    out = {}
    for node in links:
        path, x = [node], links[node]
        while x is not None and x not in path:
            path.append(x)
            x = links[x]
        if x is None:
            out[node] = (path[-1], len(path) - 1)
        else:
            out[node] = ("", -1 if x == node else -2)
    return out


@pytest.mark.parametrize("large", [False, True])
def test_hierarchy_against_brute_force(spark, large, monkeypatch):
    if large:  # nothing counts as small: levels go on by partitioned joins
        monkeypatch.setattr(skew, "MAX_ROWS", 0)
    links = {"r": None, "s": None, **{f"c{i}": f"c{i - 1}" for i in range(1, 40)}, "c0": "r", "x": "x", "y": "z", "z": "y", "w": "z", "v": "w", "u": "x"}
    links |= {f"b{i}": "s" for i in range(50)} | {f"q{i}": f"q{(i + 1) % 5}" for i in range(5)} | {f"t{i}": f"t{i - 1}" for i in range(1, 9)} | {"t0": "q3"}
    df = spark.createDataFrame(list(links.items()), "node string, parent string")
    got = h.hierarchy(df).collect()
    assert {r.node: (r.root, r.depth) for r in got} == walk(links) and len(got) == len(links)
    for r in got:
        assert r.path is None if r.depth < 0 else r.path[0] == r.root and r.path[-1] == r.node and len(r.path) == r.depth + 1
        assert not r.path or all(links[b] == a for a, b in zip(r.path, r.path[1:]))


def test_containment(spark):
    e = edges(
        spark,
        [(1, "a", "b", "Contains", 1), (2, "r", "b", '{"kind":"contains"}', 2), (2, "r", "b", '{"kind":"contains"}', 2), (3, "b", "C ", "CONTAINS", 1), (4, "c", "d", "Call", 9), (5, "", "c", "Contains", 9), (6, None, "c", "Contains", 9), (7, "s", "s", "Contains", 1), (8, "s", "t", "Contains", 1)],
    )
    assert rows(h.containment(e)) == [("a", "a", 0), ("b", "r", 1), ("c", "r", 2), ("r", "r", 0), ("s", "", -1), ("t", "", -2)]
    assert rows(h.descendants(e)) == [("b", "c", 1), ("r", "b", 1), ("r", "c", 2)]
    assert {r.node_id: r.path for r in h.containment(e, paths=True).collect()}["c"] == "r/b/c"
    assert h.containment(e.limit(0)).count() == 0


@pytest.mark.parametrize("large", [False, True])
def test_hot_parent_is_split(spark, large, monkeypatch):
    if large:
        monkeypatch.setattr(skew, "MAX_ROWS", 0)
    links = spark.range(20_000).select(F.concat(F.lit("n"), "id").alias("node"), F.when(F.col("id") > 0, F.lit("n0")).alias("parent"))
    got = h.hierarchy(links, paths=False).groupBy("root", "depth").count().collect()
    assert {tuple(r) for r in got} == {("n0", 0, 1), ("n0", 1, 19_999)}


def test_snapshot_changes(spark):
    runs = spark.createDataFrame(
        [("r1", "p", at(1), "completed"), ("r2", "p", at(3), "Completed "), ("rx", "p", at(2), "failed"), ("r3", "p", at(5), "completed"), ("r3", "p", at(5), "completed"), ("r4", "p", at(6), "completed"), ("o1", "q", at(1), "completed"), (None, "q", at(1), "completed")],
        "id string, project_id string, started_at timestamp_ntz, status string",
    )
    assert [(r.scan_run_id, r.nth) for r in run_order(runs).orderBy("project_id", "nth").collect()] == [("r1", 1), ("r2", 2), ("r3", 3), ("r4", 4), ("o1", 1)]
    data = [("r1", "k", "1", 1), ("r1", "gone", "1", 1), ("r1", "gone", "1", 1), ("r2", "k", "1", 1), ("r2", "k", "2", 2), ("r2", "new", None, None), ("r3", "new", None, 1), ("r3", "k", "2", 1), ("r3", None, "2", 1), ("rx", "no", "1", 1), ("o1", "k", "1", 1)]
    snaps = spark.createDataFrame([(r, k, v, at(d), 7) for r, k, v, d in data], "scan_run_id string, key string, v string, delivered_at timestamp_ntz, nth int")
    got = snapshot_changes(snaps, run_order(runs), F.col("key"), F.struct("v"), F.col("delivered_at"))
    assert rows(got) == [("r2", "gone", "removed"), ("r2", "k", "changed"), ("r2", "new", "added"), ("r4", "k", "removed"), ("r4", "new", "removed")]


def test_graph_changes_ignore_spelling(spark):
    runs = spark.createDataFrame([("r1", "p", at(1), "completed"), ("r2", "p", at(3), "completed")], "id string, project_id string, started_at timestamp_ntz, status string")
    n = spark.createDataFrame([("r1", "A", "File", "x"), ("r2", " a", "file", "x")], "scan_run_id string, id string, kind string, fqn string").withColumn("delivered_at", F.lit(at(1)))
    e = spark.createDataFrame([("r1", "A", "b", "Call", '{"source":"Lsp","confidence":"High"}'), ("r2", "a", "B ", '{"kind":"call"}', '{"confidence":"High","source":"Lsp"}'), ("r2", "a", None, "odd", None)], "scan_run_id string, from_id string, to_id string, kind string, provenance string").withColumn("delivered_at", F.lit(at(1)))
    c = spark.createDataFrame([("r1", "s", "FF"), ("r2", "s", "ff ")], "scan_run_id string, segment_id string, graph_fingerprint string").withColumn("updated_at", F.lit(at(1)))
    assert rows(graph_changes(n, e, c, runs)) == [("edges", "r2", "a||odd", "added")]
    assert graph_changes(n.limit(0), e.limit(0), c.limit(0), runs.limit(0)).count() == 0
