"""Queries of the health report, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgraph.operators import components as C
from fathomgraph.operators import dead_code as D
from fathomgraph.operators import findings as N
from fathomgraph.operators import metrics as M
from fathomgraph.operators import report as R
from fathomgraph.operators import subsets as S
from fathomgraph.plans.code_graph import Graph
from fathomgraph.plans.graph_queries import _DEAD, _ENTRY, _dead
from fathomgraph.plans.graph_sql import graph
from fathomgraph.plans.shared import kept
from fathomgraph.sources.graph import is_call_like

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Report:
    """What the report's queries share, on top of a graph."""

    _of: dict[int, Report] = {}

    @classmethod
    def of(cls, g: Graph) -> Report:
        held = cls._of.get(id(g))
        if held is None or held.g is not g:
            cls._of[id(g)] = held = cls(g)
        return held

    def __init__(self, g: Graph):
        self.g = g

    @cached_property
    def blast(self) -> DataFrame:
        return kept(C.blast_radius(self.g.links, self.g.functions.select("id")))

    @cached_property
    def violations(self) -> DataFrame:
        g = self.g
        return kept(C.layer_violations(S.clean_edges(g.edges, g.nodes).filter(is_call_like()), g.depth, g.strong, g.fans, g.functions, M.layer_exclusion_threshold(g.fans, g.functions)))

    @cached_property
    def coupled(self) -> DataFrame:
        return kept(M.coupling(self.g.between, self.g.modules))

    @cached_property
    def cycles(self) -> DataFrame:
        return kept(R.cycles(self.g.strong, self.g.production))

    @cached_property
    def placed(self) -> DataFrame:
        return kept(M.main_sequence(M.instability(self.g.between, self.g.modules), M.abstractness(self.g.nodes, self.g.modules)))

    @cached_property
    def cohesion(self) -> DataFrame:
        return kept(C.cohesion(self.g.edges, self.g.functions, self.g.modules))

    @cached_property
    def layers(self) -> DataFrame:
        return kept(R.layer_findings(self.violations))

    def _found(self, type_part: str = "") -> DataFrame:
        """All findings of the types with type_part in their name, without letter case. What other types rest on is not computed."""
        g, own = self.g, self.g.production_functions
        every = {
            ("CircularDependency",): lambda: R.cycle_findings(self.cycles),
            ("HighCoupling",): lambda: R.coupling_findings(self.coupled),
            ("BlastRadiusHotspot",): lambda: R.hotspot_findings(M.hotspots(g.fans, g.functions), own, g.links),
            ("ExcessiveComplexity",): lambda: R.complexity_findings(own),
            ("InformationFlowBottleneck",): lambda: R.flow_findings(M.information_flow(g.fans, g.functions), own),
            ("HubNode",): lambda: R.hub_findings(R.bridges(g.between, g.functions), own),
            ("ZoneOfPain", "ZoneOfUselessness"): lambda: R.zone_findings(self.placed),
            ("LayerViolation",): lambda: self.layers.drop("callee"),
        }
        asked = [f() for types, f in every.items() if any(type_part.lower() in t.lower() for t in types)]
        out = asked[0]
        for some in asked[1:]:
            out = out.unionByName(some)
        return N.filtered(R.with_confidence(out, g.edges), type_part=type_part)

    @cached_property
    def findings(self) -> DataFrame:
        return kept(self._found())

    def findings_of(self, type_part: str) -> DataFrame:
        """The rows of findings of the types with type_part in their name, which some type has; taken from findings if they are there."""
        return N.filtered(self.findings, type_part=type_part) if "findings" in vars(self) else self._found(type_part)

    @cached_property
    def named(self) -> DataFrame:
        return kept(R.finding_nodes(self.findings, self.layers, self.cycles, self.g.strong))

    @cached_property
    def module_risks(self) -> DataFrame:
        return kept(R.module_risks(self.g.modules, self.named))

    def _values(self, high: bool) -> DataFrame:
        """What changes with the edges: over all of them, or over those of high confidence."""
        g = self.g
        sure = (lambda df: df.filter("confidence = 'High'")) if high else (lambda df: df)
        production = sure(g.production)
        strong = C.strong_components(g._links(production)) if high else g.strong
        depth = C.longest_depth(g._links(production.filter(is_call_like())), strong) if high else g.depth
        fans = kept(M.fan(sure(g.edges), g.nodes)) if high else g.fans
        coupled = kept(M.coupling(sure(g.between), g.modules)) if high else self.coupled
        dead = D.dead_code(g.functions, g.nodes, g.classes, fans, g.outside).filter("bucket = 'production'")
        one = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
        over = lambda name, part, whole: R.metric(one(part).select(F.col("n").alias("a")).join(one(whole).select(F.col("n").alias("b"))), name, F.max(R.ratio(F.col("a"), F.col("b"))))  # noqa: E731  # one row each
        hot = M.hotspots(fans, g.functions).agg(F.sum("fan_in").alias("a")).join(fans.join(g.functions.select("id"), "id", "left_semi").agg(F.sum("fan_in").alias("b")))  # one row each
        inside = R.cycles(strong, production).agg(F.sum("edges").alias("a")).join(one(g.edges.filter("kind != 'Contains'")).select(F.col("n").alias("b")))
        return (
            over("cycle_ratio", strong, g.nodes)
            .unionByName(over("dead_ratio", dead, g.functions))
            .unionByName(R.metric(hot, "hotspot_concentration", F.max(R.ratio(F.col("a"), F.col("b")))))
            .unionByName(R.metric(depth, "max_depth", F.max("depth")))
            .unionByName(R.metric(inside, "tangle_index", F.max(R.ratio(F.col("a"), F.col("b")))))
            .unionByName(R.coupling_average(coupled, R.non_production_modules(g.modules, g.outside)))
        )

    @cached_property
    def metrics(self) -> DataFrame:
        whole = self._values(False)
        more = [
            R.metric(self.g.production_functions, "avg_cyclomatic", F.avg("cyclomatic_complexity")),
            R.metric(self.cohesion, "avg_cohesion", F.coalesce(F.avg("cohesion"), F.lit(1.0))),
            R.metric(self.placed, "avg_distance", F.avg("distance")),
        ]
        for m in more:
            whole = whole.unionByName(m)
        return kept(whole)

    @cached_property
    def sure_metrics(self) -> DataFrame:
        return kept(self._values(True))


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Report], DataFrame]):
        QUERIES[name] = lambda s, d: f(Report.of(Graph.of(s, d)))
        if sql:
            SQL[name] = sql
        return f

    return add


query("cycles", graph("cyc", "SELECT * FROM cyc"))(lambda r: r.cycles)
query("findings", graph("fnd", "SELECT type, id, severity, primary_node, value, confidence FROM fnd"))(lambda r: r.findings)
query("findings_of_type", graph("fnd", "SELECT type, id, severity, primary_node FROM fnd WHERE contains(lower(type), 'hub') AND lower(severity) = 'high'"))(
    lambda r: N.filtered(r.findings_of("Hub"), severity="HIGH").select("type", "id", "severity", "primary_node")
)
query("finding_nodes", graph("named", "SELECT * FROM named"))(lambda r: r.named)
_CAPPED = "SELECT *, row_number() OVER (PARTITION BY type ORDER BY CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Warning' THEN 2 ELSE 1 END DESC, id) AS k FROM fnd"
query("report_findings", graph("fnd", f"SELECT type, id, severity, 0::BIGINT AS overflow FROM ({_CAPPED}) WHERE k <= 10 UNION ALL SELECT type, type || '-overflow', 'Info', count(*) FROM ({_CAPPED}) WHERE k > 10 GROUP BY type"))(lambda r: N.capped(r.findings))
query("node_risks", graph("named", """SELECT node, CASE WHEN c + h >= 2 THEN 'Critical' WHEN c > 0 OR h + w >= 2 THEN 'High' WHEN h > 0 OR w > 0 THEN 'Warning' ELSE 'Info' END AS risk
FROM (SELECT node, count(*) FILTER (severity = 'Critical') AS c, count(*) FILTER (severity = 'High') AS h, count(*) FILTER (severity = 'Warning') AS w FROM named GROUP BY 1)"""))(lambda r: R.node_risks(r.named))  # fmt: skip
query("module_risks", graph("modrisk", "SELECT * FROM modrisk"))(lambda r: r.module_risks)
query(
    "fix_first",
    graph("fnd named modrisk viol mods blasts", """SELECT row_number() OVER (ORDER BY score DESC, rank DESC, id)::INTEGER AS place, id, score FROM (SELECT f.id, rank,
 rank * (1 + log2(CASE WHEN f.type = 'BlastRadiusHotspot' THEN coalesce(b.blast, 0) ELSE 0 END + 1)) * CASE f.confidence WHEN 'Medium' THEN 0.7 WHEN 'Low' THEN 0.4 ELSE 1 END * CASE WHEN f.id IN (SELECT n.id FROM named n, (SELECT module FROM modrisk WHERE risk IN ('Critical', 'High') UNION SELECT module FROM viol JOIN mods ON from_id = mods.id) w WHERE starts_with(n.node, w.module)) THEN 1.3 ELSE 1 END AS score
 FROM (SELECT *, CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Warning' THEN 2 ELSE 1 END AS rank FROM fnd) f LEFT JOIN blasts b ON b.id = f.primary_node) QUALIFY place <= 10"""),  # fmt: skip
)(lambda r: R.ranked(r.findings, r.blast, R.touched(r.named, R.worsening_modules(r.module_risks, r.violations, r.g.modules))))
query("cohesion", graph("lcom", "SELECT * FROM lcom"))(lambda r: r.cohesion)


def _metrics_sql(h: str) -> str:
    fans, dead = f"{h}fans", _DEAD.replace("fans", f"{h}fans").replace("dead AS", f"{h}dead AS") if h else _DEAD
    tests = "(SELECT module, avg(in_test_file::INTEGER) AS t FROM mods LEFT JOIN (SELECT id, in_test_file FROM outside WHERE class_path IS NOT NULL) USING (id) GROUP BY 1)"
    return dead, f"""SELECT 'cycle_ratio' AS metric, (SELECT count(*) FROM {h}scc) / (SELECT count(*) FROM gn) AS value
UNION ALL SELECT 'dead_ratio', (SELECT count(*) FROM {h}dead WHERE bucket = 'production') / (SELECT count(*) FROM fn)
UNION ALL SELECT 'hotspot_concentration', coalesce((SELECT sum(fan_in) FROM {h}hotspots), 0) / (SELECT sum(fan_in) FROM {fans} JOIN fn USING (id))
UNION ALL SELECT 'max_depth', (SELECT max(depth) FROM {h}depths)
UNION ALL SELECT 'tangle_index', (SELECT count(*) FROM {h}prod JOIN {h}scc a ON from_id = a.node JOIN {h}scc b ON to_id = b.node WHERE a.component = b.component) / (SELECT count(*) FROM struct)
UNION ALL SELECT 'avg_coupling', (SELECT avg(score) FROM {h}coupled c JOIN {tests} USING (module) WHERE NOT ({outside_module}) AND coalesce(t, 0) <= 0.5)"""


from fathomgraph.plans.graph_sql import outside_path  # noqa: E402

outside_module = outside_path("c.module")
_DEAD_SQL, _ALL = _metrics_sql("")
_HDEAD_SQL, _HIGH = _metrics_sql("h")
_NAMES = "scc gn prod struct hotspots depths coupled mods outside fn fans lcom zones prod_fn"
_MORE = " UNION ALL SELECT 'avg_cyclomatic', (SELECT avg(cyclomatic_complexity) FROM prod_fn) UNION ALL SELECT 'avg_cohesion', (SELECT avg(cohesion) FROM lcom) UNION ALL SELECT 'avg_distance', (SELECT avg(distance) FROM zones)"


def _with(names: str, more: str, body: str) -> str:
    return graph(names, "").rstrip() + ",\n" + more + "\n" + body


query("health_metrics", _with(_NAMES, _ENTRY + ",\n" + _DEAD_SQL, _ALL + _MORE))(lambda r: r.metrics)
query(
    "fidelity_gaps",
    _with(_NAMES + " hscc hprod hhotspots hdepths hcoupled hfans", _ENTRY + ",\n" + _DEAD_SQL + ",\n" + _HDEAD_SQL, f"SELECT *, value - high_only AS absolute_gap, CASE WHEN value <> 0 THEN greatest(-1, least(1, (value - high_only) / abs(value))) END AS relative_gap FROM ({_ALL}) a JOIN (SELECT metric, value AS high_only FROM ({_HIGH})) b USING (metric)"),
)(lambda r: R.fidelity(r.metrics, r.sure_metrics))
_PARTS = f"""scored AS (SELECT part, floor(greatest(0, s) + 0.5)::INTEGER AS score, w / 0.95 AS weight FROM (SELECT part, w, CASE part WHEN 'cycle_severity' THEN 100 - least(v * 500, 100) WHEN 'dead_code_ratio' THEN 100 - least(v * 300, 100)
 WHEN 'coupling_health' THEN 100 * (1 - greatest(0, v - 0.35) / 0.65) WHEN 'depth_complexity' THEN 100 * (1 - least(v / 30, 1)) WHEN 'complexity' THEN 100 * (1 - least(v / 25, 1)) WHEN 'cohesion' THEN 100 * v ELSE 100 * (1 - least(v, 1)) END AS s
 FROM (SELECT metric, value AS v FROM ({_ALL}{_MORE})) JOIN (VALUES ('cycle_severity', 'cycle_ratio', 0.2), ('coupling_health', 'avg_coupling', 0.18), ('hotspot_concentration', 'hotspot_concentration', 0.15), ('dead_code_ratio', 'dead_ratio', 0.1), ('depth_complexity', 'max_depth', 0.1),
  ('complexity', 'avg_cyclomatic', 0.1), ('cohesion', 'avg_cohesion', 0.07), ('distance', 'avg_distance', 0.05)) t(part, metric, w) USING (metric)))"""
query("score_parts", _with(_NAMES, _ENTRY + ",\n" + _DEAD_SQL + ",\n" + _PARTS, "SELECT * FROM scored"))(lambda r: R.score_parts(r.metrics, False))
query("health_score", _with(_NAMES, _ENTRY + ",\n" + _DEAD_SQL + ",\n" + _PARTS, "SELECT floor(sum(score * weight) + 0.5)::INTEGER AS score FROM scored"))(lambda r: R.health_score(R.score_parts(r.metrics, False)))
query("layer_labels", graph("depths", "SELECT node, CASE WHEN depth = 0 OR m = 0 THEN 'entry' WHEN depth / m <= 0.25 THEN 'controller' WHEN depth / m <= 0.6 THEN 'service' ELSE 'infrastructure' END AS label FROM depths, (SELECT max(depth) AS m FROM depths)"))(
    lambda r: r.g.depth.join(F.broadcast(r.g.depth.agg(F.max("depth").alias("deepest")))).select("node", R.layer_label(F.col("depth"), F.col("deepest")).alias("label"))  # one row
)
query("metric_confidence", graph("prod coupled", "SELECT 'depth' AS metric, CASE WHEN n < 5 THEN 'Low' WHEN n < 20 THEN 'Medium' ELSE 'High' END AS level FROM (SELECT count(*) AS n FROM prod) UNION ALL SELECT 'blast_radius', CASE WHEN n < 5 THEN 'Low' ELSE 'High' END FROM (SELECT count(*) AS n FROM prod) UNION ALL SELECT 'coupling', CASE WHEN count(*) < 3 THEN 'Low' ELSE 'High' END FROM coupled"))(
    lambda r: R.metric_confidence(r.g.production, r.coupled)
)
query("coupling_hotspots", graph("coupled", "SELECT module, score FROM coupled WHERE score > 0.5"))(lambda r: r.coupled.filter("score > 0.5").select("module", "score"))
query("summary", graph("gn ge fn mods cyc scc hotspots fans depths", """SELECT (SELECT count(*) FROM gn) AS nodes, (SELECT count(*) FROM ge) AS edges, (SELECT count(*) FROM fn) AS functions, (SELECT count(DISTINCT module) FROM mods) AS modules, (SELECT count(*) FROM cyc) AS cycles, (SELECT count(*) FROM scc) AS cycle_nodes,
(SELECT count(*) FROM hotspots) AS hotspots, (SELECT max(depth) FROM depths) AS max_depth, (SELECT avg(fan_in) FROM fans JOIN fn USING (id)) AS avg_fan_in, (SELECT avg(fan_out) FROM fans JOIN fn USING (id)) AS avg_fan_out"""))(lambda r: _summary(r))  # fmt: skip


def _summary(r: Report) -> DataFrame:
    g, n = r.g, F.count(F.lit(1))
    fans = g.fans.join(g.functions.select("id"), "id", "left_semi")
    rows = [
        g.nodes.agg(n.alias("nodes")), g.edges.agg(n.alias("edges")), g.functions.agg(n.alias("functions")), g.modules.agg(F.count_distinct("module").alias("modules")), r.cycles.agg(n.alias("cycles"), F.coalesce(F.sum("size"), F.lit(0)).alias("cycle_nodes")),
        M.hotspots(g.fans, g.functions).agg(n.alias("hotspots")), g.depth.agg(F.max("depth").alias("max_depth")), fans.agg(F.avg("fan_in").alias("avg_fan_in"), F.avg("fan_out").alias("avg_fan_out")),
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.join(row)  # one row each
    return out
