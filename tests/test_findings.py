"""Findings, and what each question about them leaves alone."""

import pytest

from fathomgraph.operators import components as C
from fathomgraph.operators import report as R
from fathomgraph.operators.findings import SEVERITY_RANK, capped
from fathomgraph.plans.code_graph import Graph
from fathomgraph.plans.report_queries import Report
from fathomgraph.sources.tables import table


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def report(spark, sf):
    """A report of its own, which starts with nothing computed."""
    return Report(Graph(spark, table(spark, sf, "nodes"), table(spark, sf, "edges")))


def without(monkeypatch, *names):
    def never(*_):
        raise AssertionError("not needed for the answer")

    for name in names:
        monkeypatch.setattr(C, name, never)


def test_findings_of_a_type_leave_alone_what_other_types_rest_on(report, monkeypatch):
    with monkeypatch.context() as m:
        without(m, "strong_components", "longest_depth", "layer_violations", "blast_radius")
        hubs, zones = rows(report.findings_of("hUb")), rows(report.findings_of("ZoneOf"))
    assert hubs and hubs == rows(report.findings.filter("type = 'HubNode'"))
    assert zones and zones == rows(report.findings.filter("type like 'ZoneOf%'"))
    assert rows(report.findings_of("hUb")) == hubs


def test_findings_count_no_blast_radius(report, spark, sf, monkeypatch):
    with monkeypatch.context() as m:
        without(m, "blast_radius")
        fresh = Report(report.g)
        hot = {r.primary_node: r.severity for r in fresh.findings.filter("type = 'BlastRadiusHotspot'").collect()}
    blast = {r.id: r.blast for r in fresh.blast.collect()}
    assert hot and hot == {i: "High" if blast[i] > 0 else "Warning" for i in hot}


def test_hotspots_that_others_reach_are_high(spark):
    hot = spark.createDataFrame([("a", 9, 3), ("b", 8, 3), ("c", 7, 3), ("d", 0, 0), ("t", 9, 3)], "id string, fan_in bigint, threshold bigint")
    links = spark.createDataFrame([("x", "a"), ("y", "x"), ("b", "x"), ("c", "c"), ("x", "d"), ("x", "t"), ("y", "a")], "src string, dst string")
    own = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    got = rows(R.hotspot_findings(hot, own, links).select("id", "primary_node", "severity", "value"))
    assert got == [("hotspot-1", "a", "High", 9.0), ("hotspot-2", "b", "Warning", 8.0), ("hotspot-3", "c", "Warning", 7.0), ("hotspot-4", "d", "Warning", 0.0)]
    blast = {r.id: r.blast for r in C.blast_radius(links.filter("src != dst"), own).collect()}
    assert {i: n > 0 for i, n in blast.items()} == {"a": True, "b": False, "c": False, "d": True}


def test_risks_and_capped_findings_count_no_blast_radius(report, monkeypatch):
    without(monkeypatch, "blast_radius")
    fresh = Report(report.g)
    named = rows(fresh.named)
    per_node = {}
    for _, _, severity, node in named:
        per_node.setdefault(node, []).append(severity)
    risks = dict(rows(R.node_risks(fresh.named)))
    level = lambda s: "Critical" if s.count("Critical") + s.count("High") >= 2 else "High" if "Critical" in s or s.count("High") + s.count("Warning") >= 2 else "Warning" if "High" in s or "Warning" in s else "Info"
    assert risks == {node: level(s) for node, s in per_node.items()} and len(risks) > 0
    worst = {node: min(s, key=list(SEVERITY_RANK).index) for node, s in per_node.items()}
    assert {r.module: r.risk for r in fresh.module_risks.collect()} == {r.module: worst.get(r.module, "Healthy") for r in report.g.modules.select("module").distinct().collect()}
    n = {r.type: r["count"] for r in fresh.findings.groupBy("type").count().collect()}
    got = {}
    for r in capped(fresh.findings).collect():
        got[r.type] = got.get(r.type, 0) + (r.overflow or 1)
    assert got == n
