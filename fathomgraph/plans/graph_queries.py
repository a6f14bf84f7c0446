"""Queries over the graph tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgraph.functions import paths as P
from fathomgraph.functions.filters import parse_node_filter
from fathomgraph.operators import components as C
from fathomgraph.operators import dead_code as D
from fathomgraph.operators import interactive as I
from fathomgraph.operators import metrics as M
from fathomgraph.operators import overrides as V
from fathomgraph.operators import quality as Y
from fathomgraph.operators import subsets as S
from fathomgraph.operators import template as T
from fathomgraph.operators.incremental import structure_fingerprint
from fathomgraph.operators.skew import sized_join
from fathomgraph.plans.code_graph import Graph
from fathomgraph.plans.graph_sql import graph, outside_path, path_role
from fathomgraph.plans.shared import kept
from fathomgraph.plans.sql_parts import sql_edge_kind
from fathomgraph.sources.graph import is_call_like, unknown_edge_kinds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Graph], DataFrame]):
        QUERIES[name] = lambda s, d: f(Graph.of(s, d))
        if sql:
            SQL[name] = sql
        return f

    return add


# Loading and subsets

query("load_nodes", graph("gn", "SELECT id, kind, fqn, name, file, start_line, end_line, source, confidence, path_repo_rel, visibility, language, cyclomatic_complexity, is_test, synthetic, is_trait_impl FROM gn"))(
    lambda g: g.nodes.select("id", "kind", "fqn", "name", "file", "start_line", "end_line", "source", "confidence", "path_repo_rel", "visibility", "language", "cyclomatic_complexity", "is_test", "synthetic", "is_trait_impl")
)
query("load_edges", graph("ge", "SELECT from_id, to_id, kind, source, confidence FROM ge"))(lambda g: g.edges.select("from_id", "to_id", "kind", "source", "confidence"))
query("unknown_edge_kinds", graph("ge", "SELECT kind AS kind_text, count(*) AS n FROM edges WHERE {} IS NULL GROUP BY 1").replace("{}", sql_edge_kind("kind")))(lambda g: unknown_edge_kinds(g.raw_edges))
query("containment_parent", graph("par", "SELECT * FROM par"))(lambda g: g.parents)
query("node_paths", graph("paths", "SELECT id, path FROM paths"))(lambda g: g.paths)
query("analysis_modules", graph("mods", "SELECT * FROM mods"))(lambda g: g.modules)
query("classification_of", graph("cls", "SELECT * FROM cls"))(lambda g: g.classes)
query("non_production", graph("outside", "SELECT id, is_non_production, in_test_file FROM outside"))(lambda g: g.outside.select("id", "is_non_production", "in_test_file"))
query("production_edges", graph("prod", "SELECT from_id, to_id, kind, confidence FROM prod"))(lambda g: g.production.select("from_id", "to_id", "kind", "confidence"))
query("high_confidence_edges", graph("prod", "SELECT from_id, to_id, kind FROM prod WHERE confidence = 'High'"))(lambda g: g.production.filter("confidence = 'High'").select("from_id", "to_id", "kind"))
query("validate_edges", graph("gn", "SELECT coalesce(k, 'unknown') AS kind, count(*) AS n FROM (SELECT DISTINCT nullif(lower(trim(from_id)), '') AS f, nullif(lower(trim(to_id)), '') AS t, {} AS k FROM edges) WHERE f IS NOT NULL AND t IS NOT NULL AND (f NOT IN (SELECT id FROM gn) OR t NOT IN (SELECT id FROM gn)) GROUP BY 1").replace("{}", sql_edge_kind("kind")))(
    lambda g: _dangling(g)
)


def _dangling(g: Graph) -> DataFrame:
    """(kind, n): distinct edges with an end that no node has."""
    from fathomgraph.sources.graph import raw_edges

    e = kept(raw_edges(g.raw_edges))
    bad = kept(e.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct().join(g.nodes.select("id"), "id", "left_anti"))
    marked = sized_join(sized_join(e, bad.select(F.col("id").alias("from_id"), F.lit(True).alias("a")), "from_id", "left"), bad.select(F.col("id").alias("to_id"), F.lit(True).alias("b")), "to_id", "left")
    return marked.filter("a or b").groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# Interactive questions

_TOP = "SELECT id, fqn, n FROM gn JOIN (SELECT {side} AS id, count(*) AS n FROM calls GROUP BY 1) USING (id) WHERE kind = 'Function' {having} ORDER BY n DESC, fqn, id LIMIT {limit}"
query("top_fan_in", graph("gn calls", _TOP.format(side="to_id", having="", limit=20)))(lambda g: I.top_fan(g.calls_in, g.nodes))
query("top_fan_out", graph("gn calls", _TOP.format(side="from_id", having="", limit=20)))(lambda g: I.top_fan(g.calls_out, g.nodes, "from_id"))
query("call_hotspots", graph("gn calls", _TOP.format(side="to_id", having="AND n >= 10", limit=1_000_000)))(lambda g: I.top_fan(g.calls_in, g.nodes, at_least=10, limit=1_000_000))
_HOT = "hot AS (" + _TOP.format(side="to_id", having="", limit=5).replace("SELECT id, fqn, n", "SELECT id") + ")"
_HOT_OUT = _HOT.replace("SELECT to_id AS id, count(*)", "SELECT from_id AS id, count(*)")
_TIER = "CASE {c} WHEN 'TreeSitter' THEN 'tier_0' WHEN 'Heuristic' THEN 'tier_1' WHEN 'Lsp' THEN 'tier_3' END"


def _with(names: str, more: str, body: str) -> str:
    return graph(names, "").rstrip() + ",\n" + more + "\n" + body


query("callers", _with("gn calls", _HOT, f"SELECT to_id AS seed, from_id AS id, n.fqn, n.kind, {_TIER.format(c='c.source')} AS tier FROM calls c JOIN hot ON c.to_id = hot.id JOIN gn n ON c.from_id = n.id"))(lambda g: I.neighbours(g.calls_in, g.nodes, g.hot(5), "in"))
query("callees", _with("gn calls", _HOT_OUT, f"SELECT from_id AS seed, to_id AS id, n.fqn, n.kind, {_TIER.format(c='c.source')} AS tier FROM calls c JOIN hot ON c.from_id = hot.id JOIN gn n ON c.to_id = n.id"))(lambda g: I.neighbours(g.calls_out, g.nodes, g.hot(5, "from_id"), "out"))
query("uncalled_functions", graph("gn calls", "SELECT id, fqn FROM gn WHERE kind = 'Function' AND NOT EXISTS (SELECT 1 FROM calls WHERE to_id = id)"))(lambda g: I.uncalled_functions(g.calls_in, g.nodes))
query(
    "module_pairs",
    graph("calls ge", "SELECT a.from_id AS from_module, b.from_id AS to_module, count(*)::BIGINT AS n FROM calls c JOIN ge a ON a.to_id = c.from_id AND a.kind = 'Contains' JOIN ge b ON b.to_id = c.to_id AND b.kind = 'Contains' WHERE a.from_id <> b.from_id GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20"),
)(lambda g: I.module_pairs(g.edges))


def _reach_sql(near: str, far: str, depth: int) -> str:
    return f"""steps AS (SELECT {near} AS node, {far} AS next, max(CASE source WHEN 'Lsp' THEN 3 WHEN 'TreeSitter' THEN 2 WHEN 'Heuristic' THEN 1 ELSE 0 END) AS rank FROM calls GROUP BY 1, 2),
walk AS (SELECT id AS seed, id AS node, 0 AS depth FROM hot UNION SELECT w.seed, s.next, w.depth + 1 FROM walk w JOIN steps s ON w.node = s.node WHERE w.depth < {depth}),
first AS (SELECT seed, node, min(depth) AS depth FROM walk GROUP BY 1, 2),
met AS (SELECT f.seed, f.node, f.depth, max(s.rank) AS rank FROM first f JOIN first b ON b.seed = f.seed AND b.depth = f.depth - 1 JOIN steps s ON s.node = b.node AND s.next = f.node GROUP BY 1, 2, 3)"""


_REACHED = "SELECT node AS id, min(depth) AS depth, list_sort(list(DISTINCT seed)) AS via_seeds, CASE max(rank) WHEN 3 THEN 'tier_3' WHEN 2 THEN 'tier_0' WHEN 1 THEN 'tier_1' END AS tier FROM met WHERE node NOT IN (SELECT id FROM hot) GROUP BY 1"
query("reach_callers", _with("gn calls", _HOT + ",\n" + _reach_sql("to_id", "from_id", 3), _REACHED))(lambda g: I.reach(g.calls_in, g.hot(5), "in", 3))
query("reach_callees", _with("gn calls", _HOT_OUT + ",\n" + _reach_sql("from_id", "to_id", 3), _REACHED))(lambda g: I.reach(g.calls_out, g.hot(5, "from_id"), "out", 3))
_BOTH = _reach_sql("to_id", "from_id", 2), _reach_sql("from_id", "to_id", 2)
for _old in ("steps", "walk", "first", "met"):
    _BOTH = _BOTH[0], _BOTH[1].replace(f"{_old} ", f"{_old}2 ").replace(f"{_old}2 AS next", f"{_old} AS next")
query(
    "slice_both",
    _with("gn calls", _HOT.replace("LIMIT 5", "LIMIT 2") + ",\n" + ",\n".join(_BOTH), "SELECT *, 'in' AS direction FROM (" + _REACHED + ") UNION ALL SELECT *, 'out' FROM (" + _REACHED.replace("FROM met ", "FROM met2 ") + ")"),
)(lambda g: I.slice_around(g.edges, g.hot(2), 2))
_CORE = ",\n".join(["s0 AS MATERIALIZED (SELECT DISTINCT from_id AS a, to_id AS b FROM calls WHERE from_id <> to_id)", *[f"s{k + 1} AS MATERIALIZED (SELECT * FROM s{k} WHERE a IN (SELECT b FROM s{k}) AND b IN (SELECT a FROM s{k}))" for k in range(8)]])
query(
    "call_cycles",
    _with("calls", _CORE, """cw AS (SELECT [a, b] AS p FROM s8 WHERE a < b UNION ALL SELECT list_append(p, b) FROM cw JOIN s8 ON p[-1] = a WHERE b > p[1] AND NOT list_contains(p, b) AND len(p) < 8)
SELECT p AS cycle, len(p)::INTEGER AS length FROM cw JOIN s8 ON p[-1] = a AND b = p[1]""").replace(")\ncw AS", "),\ncw AS"),
)(lambda g: I.simple_cycles(g.calls_out, 8))
_RINGS = _CORE.replace("calls", "prod")
query(
    "link_cycles",
    _with("prod", _RINGS, """cw AS (SELECT [a, b] AS p FROM s8 WHERE a < b UNION ALL SELECT list_append(p, b) FROM cw JOIN s8 ON p[-1] = a WHERE b > p[1] AND NOT list_contains(p, b) AND len(p) < 4)
SELECT p AS cycle, len(p)::INTEGER AS length FROM cw JOIN s8 ON p[-1] = a AND b = p[1]""").replace(")\ncw AS", "),\ncw AS"),
)(lambda g: I.simple_cycles(g.production, 4, calls_only=False))
_BUSY = "busy AS (SELECT file FROM gn WHERE kind = 'Function' AND file IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, file LIMIT 1), hot AS (SELECT id FROM gn WHERE kind = 'Function' AND file = (SELECT file FROM busy))"
query("file_blast_radius", _with("gn calls", _BUSY + ",\n" + _reach_sql("to_id", "from_id", 3), _REACHED))(lambda g: _file_blast(g))


def _file_blast(g: Graph) -> DataFrame:
    """Of the file with most functions."""
    top = g.nodes.filter("kind = 'Function' and file is not null").groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "file").first()
    return I.file_blast_radius(g.calls_in, g.nodes, top.file if top else "")


query(
    "resolve_symbol",
    graph("gn", """SELECT id, fqn, kind, ['fqn', 'id', 'suffix', 'part'][rule + 1] AS how FROM (SELECT *, min(rule) OVER () AS best FROM (SELECT id, fqn, kind, CASE WHEN fqn = 'decode' THEN 0 WHEN id = 'decode' THEN 1
  WHEN kind IN ('Function', 'Module', 'File') AND fqn ILIKE '%::decode' THEN 2 WHEN kind IN ('Function', 'Module', 'File') AND fqn ILIKE '%decode%' THEN 3 END AS rule FROM gn) WHERE rule IS NOT NULL) WHERE rule = best ORDER BY length(fqn), fqn, id LIMIT 25"""),  # fmt: skip
)(lambda g: I.resolve_symbol(g.nodes, "decode"))
_PATH = _reach_sql("to_id", "from_id", 3).replace("FROM hot ", "FROM target ")
query(
    "shortest_call_path",
    _with("gn calls", "target AS (" + _TOP.format(side="to_id", having="", limit=1).replace("SELECT id, fqn, n", "SELECT id") + "),\n" + _PATH + """,
far AS (SELECT node FROM met WHERE node NOT IN (SELECT id FROM target) ORDER BY depth DESC, node LIMIT 1),
ways AS (SELECT node, [node] AS p FROM far UNION ALL SELECT to_id, list_append(p, to_id) FROM ways JOIN (SELECT DISTINCT from_id, to_id FROM calls) ON node = from_id WHERE len(p) < 4)""", """SELECT (k - 1)::INTEGER AS step, p[k] AS id FROM (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT p FROM ways WHERE node IN (SELECT id FROM target) ORDER BY len(p), p LIMIT 1))"""),
)(lambda g: _longest_pair(g))


def _longest_pair(g: Graph) -> DataFrame:
    """The shortest path to the most-called function from the least id among its callers at the greatest distance up to 3."""
    target = g.hot(1).first()
    if target is None:
        return g.spark.createDataFrame([], "step int, id string")
    far = I.reach(g.calls_in, I.seeds_of(g.spark, [target.seed]), "in", 3).orderBy(F.col("depth").desc(), "id").first()
    return I.shortest_path(g.calls_out, far.id if far else target.seed, target.seed)


# Metrics

query("fan_metrics", graph("fans", "SELECT * FROM fans"))(lambda g: g.fans)
query(
    "hotspots",
    graph(
        "fans fn",
        """SELECT id, fan_in, t.threshold FROM fans JOIN fn USING (id), (SELECT CASE WHEN count(*) < 20 THEN 8 ELSE (list_sort(list(fan_in)))[least(ceil(count(*) * 95 / 100), count(*) - 1)::BIGINT + 1] END AS threshold FROM fans JOIN fn USING (id)) t
WHERE fan_in >= t.threshold AND t.threshold > 0""",
    ),
)(lambda g: M.hotspots(g.fans, g.functions))
query("module_coupling", graph("medges mods", """SELECT m.module, m.members, x.internal_edges, x.external_edges, x.external_edges / (x.internal_edges + x.external_edges) AS score
FROM (SELECT module, count(*) AS members FROM mods GROUP BY 1) m JOIN (SELECT module, sum(i)::BIGINT AS internal_edges, sum(x)::BIGINT AS external_edges FROM (
  SELECT from_module AS module, 1 AS i, 0 AS x FROM medges WHERE from_module = to_module UNION ALL SELECT from_module, 0, 1 FROM medges WHERE from_module IS DISTINCT FROM to_module UNION ALL SELECT to_module, 0, 1 FROM medges WHERE from_module IS DISTINCT FROM to_module)
 WHERE module IS NOT NULL GROUP BY 1) x USING (module) WHERE m.members >= 3"""))(lambda g: M.coupling(g.between, g.modules))  # fmt: skip
_UNSTABLE = """unstable AS (SELECT module, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) > 0 THEN coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)) ELSE 0 END AS instability
 FROM (SELECT DISTINCT module FROM mods) LEFT JOIN (SELECT to_module AS module, count(DISTINCT from_module) AS ca FROM medges WHERE from_module <> to_module GROUP BY 1) USING (module)
 LEFT JOIN (SELECT from_module AS module, count(DISTINCT to_module) AS ce FROM medges WHERE from_module <> to_module GROUP BY 1) USING (module))"""
_ABSTRACT = """abstract AS (SELECT module, abstract_types, types, CASE WHEN types > 0 THEN abstract_types / types ELSE 0 END AS abstractness
 FROM (SELECT module, count(*) FILTER (kind = 'Interface') AS abstract_types, count(*) FILTER (kind IN ('Interface', 'Struct', 'Enum', 'Type')) AS types FROM mods JOIN gn USING (id) GROUP BY 1))"""
query("instability", _with("medges mods", _UNSTABLE, "SELECT * FROM unstable"))(lambda g: M.instability(g.between, g.modules))
query("abstractness", _with("gn mods", _ABSTRACT, "SELECT * FROM abstract"))(lambda g: M.abstractness(g.nodes, g.modules))
query(
    "main_sequence",
    _with("medges mods gn", _UNSTABLE + ",\n" + _ABSTRACT, """SELECT module, instability, abstractness, d AS distance, CASE WHEN d < 0.15 THEN 'main_sequence' WHEN abstractness < 0.3 AND instability < 0.3 THEN 'pain' WHEN abstractness > 0.7 AND instability > 0.7 THEN 'uselessness' ELSE 'balanced' END AS zone
FROM (SELECT *, abs(abstractness + instability - 1) AS d FROM unstable JOIN abstract USING (module))"""),  # fmt: skip
)(lambda g: M.main_sequence(M.instability(g.between, g.modules), M.abstractness(g.nodes, g.modules)))
query("api_surface", graph("medges mods fn", """SELECT module, count(*) AS functions, count(e.to_id) AS exposed, count(e.to_id) / count(*) AS api_surface FROM mods JOIN fn USING (id)
LEFT JOIN (SELECT DISTINCT to_id FROM medges WHERE to_module IS NOT NULL AND from_module IS DISTINCT FROM to_module) e ON e.to_id = mods.id GROUP BY 1"""))(lambda g: M.api_surface(g.between, g.functions, g.modules))  # fmt: skip
query("hub_scores", graph("medges mods fn", """SELECT id, s.n AS source_modules, t.n AS target_modules, s.n * t.n / (SELECT count(DISTINCT module) * count(DISTINCT module) FROM mods) AS hub_score FROM fn
JOIN (SELECT to_id AS id, count(DISTINCT from_module) AS n FROM medges WHERE from_module <> to_module GROUP BY 1) s USING (id) JOIN (SELECT from_id AS id, count(DISTINCT to_module) AS n FROM medges WHERE from_module <> to_module GROUP BY 1) t USING (id)"""))(lambda g: M.hub_scores(g.between, g.functions, g.modules))  # fmt: skip
query("information_flow", graph("fans fn", "SELECT id, (fan_in * fan_out) * (fan_in * fan_out) AS information_flow FROM fans JOIN fn USING (id)"))(lambda g: M.information_flow(g.fans, g.functions))
query("information_flow_threshold", graph("fans fn", "SELECT greatest(coalesce((list_sort(list(v)))[greatest(ceil(count(*) * 95 / 100) - 1, 0)::BIGINT + 1], 100), 100) AS threshold FROM (SELECT (fan_in * fan_out) * (fan_in * fan_out) AS v FROM fans JOIN fn USING (id))"))(
    lambda g: M.percentile_floor(M.information_flow(g.fans, g.functions), "information_flow", 95, 100)
)
query("layer_exclusion_threshold", graph("fans fn", "SELECT (list_sort(list(fan_in)))[least(count(*) * 95 // 100, count(*) - 1) + 1] AS threshold FROM fans JOIN fn USING (id) WHERE fan_in > 0"))(lambda g: M.layer_exclusion_threshold(g.fans, g.functions))
_LOC = "CASE WHEN end_line >= start_line THEN end_line - start_line + 1 ELSE 0 END"
query("lines_of_code", graph("fn mods", f"SELECT module, count(*) AS functions, sum({_LOC})::BIGINT AS loc FROM fn JOIN mods USING (id) GROUP BY 1"))(lambda g: M.lines_of_code(g.functions, g.modules))
query("tangle_index", graph("scc struct prod", "SELECT (SELECT count(*) FROM prod JOIN scc a ON from_id = a.node JOIN scc b ON to_id = b.node WHERE a.component = b.component) / (SELECT count(*) FROM struct) AS tangle_index"))(lambda g: _tangle(g))
query("complexity", graph("prod_fn", "SELECT language, count(*) AS functions, avg(cyclomatic_complexity) AS avg_cyclomatic, max(cyclomatic_complexity) AS max_cyclomatic, count(*) FILTER (cyclomatic_complexity > 10 OR cognitive_complexity > 12) AS findings FROM prod_fn WHERE cyclomatic_complexity IS NOT NULL GROUP BY 1"))(lambda g: M.complexity(g.production_functions))
query("god_functions", graph("prod_fn fans", f"""SELECT id, cyclomatic_complexity, fan_out, loc, CASE WHEN cyclomatic_complexity >= 20 AND fan_out >= 15 AND loc >= 80 THEN 'Critical' WHEN cyclomatic_complexity >= 15 OR fan_out >= 15 OR loc >= 80 THEN 'High' ELSE 'Warning' END AS severity
FROM (SELECT id, cyclomatic_complexity, fan_out, {_LOC} AS loc FROM prod_fn JOIN fans USING (id)) WHERE cyclomatic_complexity >= 5 AND fan_out >= 3 AND loc >= 20"""))(
    lambda g: M.god_functions(g.production_functions, g.fans, M.Thresholds(god_cyclomatic=(5, 20), god_fan_out=(3, 15), god_loc=(20, 80)))
)
query("confidence_histogram", graph("ge", """SELECT *, high / (high + medium + low + unknown) AS high_ratio, CASE WHEN high / (high + medium + low + unknown) >= 0.8 THEN 'high' WHEN high / (high + medium + low + unknown) >= 0.4 THEN 'medium' ELSE 'low' END AS fidelity
FROM (SELECT subset, count(*) FILTER (confidence = 'High') AS high, count(*) FILTER (confidence = 'Medium') AS medium, count(*) FILTER (confidence = 'Low') AS low, count(*) FILTER (confidence = 'Unknown') AS unknown FROM
 (SELECT 'all' AS subset, confidence FROM ge UNION ALL SELECT 'call_like', confidence FROM ge WHERE kind IN ('Call', 'Framework:VisualforcePage', 'Declarative:Flow')) GROUP BY 1)"""))(lambda g: M.confidence_histogram(g.edges))  # fmt: skip
query("languages", graph("gn", "SELECT language, count(*) AS files, count(*) / sum(count(*)) OVER () AS share FROM gn WHERE kind = 'File' AND language IS NOT NULL GROUP BY 1"))(lambda g: M.languages(g.nodes))
query("module_boundaries", graph("gn mods", "SELECT module, files, members, CASE WHEN files >= 60 THEN 'very_large' ELSE 'large' END AS issue FROM (SELECT module, count(*) FILTER (kind = 'File') AS files, count(*) AS members FROM mods JOIN gn USING (id) GROUP BY 1) WHERE files >= 20"))(lambda g: M.module_boundaries(g.nodes, g.modules, 20, 60))


def _tangle(g: Graph) -> DataFrame:
    """Production edges within strongly connected parts, parallel kinds each, over all structural edges."""
    parts = g.strong.select("node", "component")
    a, b = parts.select(F.col("node").alias("from_id"), F.col("component").alias("x")), parts.select(F.col("node").alias("to_id"), F.col("component").alias("y"))
    inside = sized_join(sized_join(g.production, a, "from_id"), b, "to_id").filter("x = y").agg(F.count(F.lit(1)).alias("inside"))
    every = g.edges.filter("kind != 'Contains'").agg(F.count(F.lit(1)).alias("every"))
    return inside.join(F.broadcast(every)).select((F.col("inside") / F.col("every")).alias("tangle_index"))  # one row each


query(
    "resolution_quality",
    graph("ge", """SELECT *, CASE WHEN rate >= 0.5 THEN 'Critical' WHEN rate >= 0.25 THEN 'High' WHEN rate >= 0.1 THEN 'Warning' END AS level FROM
(SELECT kind, count(*) FILTER (source = 'Lsp') AS language_server, count(*) FILTER (source = 'Heuristic') AS heuristic, count(*) FILTER (source = 'Heuristic') / nullif(count(*) FILTER (source IN ('Lsp', 'Heuristic')), 0) AS rate FROM ge GROUP BY 1)"""),  # fmt: skip
)(lambda g: Y.resolution_quality(g.edges))
query(
    "metric_status",
    graph("prod mods", """SELECT *, CASE WHEN edges < 50 THEN 'InsufficientEdges' ELSE 'Ok' END AS cycle_status, CASE WHEN calls < 20 THEN 'InsufficientEdges' ELSE 'Ok' END AS depth_status, CASE WHEN modules < 3 THEN 'NotApplicable' ELSE 'Ok' END AS module_status
FROM (SELECT (SELECT count(*) FROM prod) AS edges, (SELECT count(*) FROM prod WHERE kind IN ('Call', 'Framework:VisualforcePage', 'Declarative:Flow')) AS calls, (SELECT count(DISTINCT module) FROM mods) AS modules)"""),  # fmt: skip
)(lambda g: Y.metric_status(g.production, g.modules))


# Iterative

query("strong_components", graph("scc", "SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM scc"))(lambda g: g.strong)
_DEPTH = """dag AS (SELECT src, dst FROM clinks WHERE NOT (src IN (SELECT node FROM scc) AND dst IN (SELECT node FROM scc))),
dn AS (SELECT src AS node FROM dag UNION SELECT dst FROM dag),
dw AS (SELECT node, 0 AS depth FROM dn WHERE node NOT IN (SELECT dst FROM dag) UNION SELECT dag.dst, dw.depth + 1 FROM dw JOIN dag ON dw.node = dag.src),
depths AS (SELECT node, max(depth) AS depth FROM dw GROUP BY 1)"""
query("call_depth", _with("scc clinks", _DEPTH, "SELECT * FROM depths"))(lambda g: g.depth)
query(
    "layer_violations",
    _with("scc clinks clean fans fn", _DEPTH, """SELECT from_id, to_id, a.depth AS from_depth, b.depth AS to_depth, b.depth - a.depth AS gap FROM (SELECT DISTINCT from_id, to_id FROM clean WHERE kind IN ('Call', 'Framework:VisualforcePage', 'Declarative:Flow')) e
JOIN depths a ON a.node = from_id JOIN depths b ON b.node = to_id JOIN fans ON fans.id = to_id
WHERE b.depth - a.depth >= 2 AND from_id NOT IN (SELECT node FROM scc) AND to_id NOT IN (SELECT node FROM scc) AND (to_id NOT IN (SELECT id FROM fn) OR fan_in <= (SELECT (list_sort(list(fan_in)))[least(count(*) * 95 // 100, count(*) - 1) + 1] FROM fans JOIN fn USING (id) WHERE fan_in > 0))"""),  # fmt: skip
)(lambda g: _layers(g))
query(
    "blast_radius",
    _with("plinks fn", "br AS (SELECT id AS seed, id AS node FROM fn UNION SELECT br.seed, src FROM br JOIN plinks ON dst = br.node)", "SELECT seed AS id, count(*) - 1 AS blast FROM br GROUP BY 1"),
)(lambda g: C.blast_radius(g.links, g.functions.select("id")))
query("test_only_files", graph("marked8", "SELECT file FROM marked8"))(lambda g: _test_only(g))


def _layers(g: Graph) -> DataFrame:
    return C.layer_violations(S.clean_edges(g.edges, g.nodes).filter(is_call_like()), g.depth, g.strong, g.fans, g.functions, M.layer_exclusion_threshold(g.fans, g.functions))


def _test_only(g: Graph) -> DataFrame:
    """Both ends of an import count as their containing files. Only paths that are known not to be production, and files without a path, may become test files."""
    files = g.nodes.filter("kind = 'File'")
    own = g.nodes.select(F.col("id").alias("node"), F.when(F.col("kind") == "File", F.col("id")).alias("value"))
    holder = kept(S.nearest_ancestor(own, g.parents).filter("value is not null").select(F.col("node").alias("id"), F.col("value").alias("file")))
    ends = g.edges.filter("kind = 'Import'").select("from_id", "to_id")
    imports = sized_join(sized_join(ends, holder.select(F.col("id").alias("from_id"), F.col("file").alias("importer")), "from_id"), holder.withColumnRenamed("id", "to_id"), "to_id").select("importer", "file")
    whole = g.nodes.filter("kind = 'Function'").select("id", "is_test").join(holder, "id").groupBy("file").agg(F.every("is_test").alias("all_test")).filter("all_test").select("file")
    tests = files.filter("is_test").select(F.col("id").alias("file")).unionByName(whole)
    paths = g.paths.filter(~F.coalesce(P.is_non_production_path("path"), F.lit(False)) & (F.col("path") != ""))
    return C.test_only_files(imports, tests, paths.select(F.col("id").alias("file")))


# Dead code

_EN = lambda words: "('" + "', '".join(words) + "')"
_RULES = f"""CASE WHEN in_test_file THEN 'parent_file_is_test' WHEN class_vendor THEN 'parent_file_is_vendor' WHEN class_build THEN 'parent_file_is_build_output' WHEN class_generated THEN 'parent_file_is_generated'
WHEN base IN {_EN(D.BARREL_FILES)} THEN 'barrel_file' WHEN class_path IS NOT NULL AND (base IN {_EN(D.ENTRYPOINT_FILES)} OR name = 'main') THEN 'entrypoint_file'
WHEN regexp_matches(lower(name), '({"|".join(D.HANDLER_SUFFIXES)})$') OR regexp_matches(lower(fqn), '({"|".join(D.HANDLER_SUFFIXES)})$') OR regexp_matches(lower(name), '^({"|".join(D.HANDLER_PREFIXES)})') THEN 'framework_handler_convention'
WHEN name IN {_EN(D.LIFECYCLE_NAMES)} THEN 'lifecycle_method'
WHEN regexp_matches(name, '^[A-Z][A-Za-z]') THEN 'jsx_component' WHEN name IN {_EN(D.JSX_RUNTIME_NAMES)} THEN 'jsx_runtime'
WHEN (name IN {_EN(D.ACCESSOR_NAMES)} OR length(name) <= 20 AND regexp_matches(lower(name), '(path|routes|router)$')) AND contains(fqn, '::') THEN 'property_accessor'
WHEN regexp_matches(lower(name), '^(mock|stub|fake)') THEN 'mock_function' WHEN is_attribute_invoked THEN 'attribute_invoked' WHEN is_callback_target THEN 'callback_target'
WHEN visibility IN ('public', 'exported', 'pub_crate') THEN 'exported_symbol' END"""
_ENTRY = f"entry AS (SELECT *, {_RULES} AS entry_reason FROM (SELECT fn.*, o.* EXCLUDE (id), split_part(coalesce(class_path, ''), '/', -1) AS base FROM fn JOIN outside o USING (id)))"
query("entry_points", _with("fn outside", _ENTRY, "SELECT id, entry_reason AS reason FROM entry WHERE entry_reason IS NOT NULL"))(lambda g: D.entry_points(g.functions, g.nodes, g.classes))
_DEAD = """dead AS (SELECT e.id, CASE WHEN NOT is_non_production THEN 'production' WHEN in_test_file THEN 'test' ELSE 'vendor' END AS bucket,
 CASE WHEN is_attribute_invoked THEN 'framework_annotation_unresolved' WHEN is_callback_target THEN 'callback_target_not_tracked' WHEN in_test_file THEN 'test_only_reference'
  WHEN language = 'python' AND lower(base) = 'tasks.py' AND (class_path LIKE '%/tasks.py' OR class_path LIKE '%/tasks/%') OR language = 'python' AND lower(base) IN ('celery.py', 'celery_app.py') AND class_path LIKE '%/tasks/%' OR regexp_matches(lower(base), '^(jest|vitest)\\.(setup|config)\\.(js|ts|mjs|cjs)$') THEN 'framework_annotation_unresolved'
  WHEN language = 'python' AND lower(base) IN ('views.py', 'urls.py', 'models.py', 'admin.py', 'forms.py', 'apps.py', 'settings.py', 'middleware.py') AND (class_path LIKE '%/management/commands/%' AND name IN ('handle', 'add_arguments') OR class_path LIKE '%/views.py' OR class_path LIKE '%/views/%' OR class_path LIKE '%urls.py') THEN 'declarative_wiring_unparsed'
  WHEN visibility IN ('private', 'fileprivate', 'module_private') THEN 'visibility_private_unused' ELSE 'no_callers' END AS reason
 FROM entry e JOIN fans USING (id) WHERE fan_in = 0 AND entry_reason IS NULL)"""
query("dead_code", _with("fn outside fans", _ENTRY + ",\n" + _DEAD, "SELECT * FROM dead"))(lambda g: _dead(g))
query("dead_code_reasons", _with("fn outside fans", _ENTRY + ",\n" + _DEAD, f"""SELECT b.bucket, r.reason, count(dead.id) AS n FROM (SELECT unnest(['production', 'test', 'vendor']) AS bucket) b, (SELECT unnest(['no_callers', 'framework_annotation_unresolved', 'declarative_wiring_unparsed', 'dynamic_dispatch_target', 'callback_target_not_tracked', 'test_only_reference', 'visibility_private_unused', 'unclassified']) AS reason) r LEFT JOIN dead ON dead.bucket = b.bucket AND dead.reason = r.reason GROUP BY 1, 2"""))(lambda g: D.reason_breakdown(_dead(g)))


def _dead(g: Graph) -> DataFrame:
    return D.dead_code(g.functions, g.nodes, g.classes, g.fans, g.outside)


# Scalars

_NAMES = "SELECT id, name, array_to_string(string_split(fqn, '::')[-2:], '::') AS display_name FROM gn"
query("display_names", graph("gn", _NAMES))(lambda g: g.nodes.select("id", "name", P.display_name("fqn").alias("display_name")))
query("path_flags", graph("gn", f"SELECT id, {outside_path('path_repo_rel')} AS outside FROM gn"))(lambda g: g.nodes.select("id", F.coalesce(P.is_non_production_path("path_repo_rel"), F.lit(False)).alias("outside")))
query("path_roles", graph("gn", f"SELECT id, {path_role('path_repo_rel')} AS role FROM gn"))(lambda g: g.nodes.select("id", P.path_role("path_repo_rel").alias("role")))
_PART = "sum(('0x' || sha256('{}|' || e)[1:10])::BIGINT)"
query(
    "structure_fingerprint",
    graph("gn ge", f"""SELECT language, nodes, coalesce(edges, 0) AS edges, fingerprint FROM (SELECT language, count(*) AS nodes FROM gn GROUP BY 1) LEFT JOIN (SELECT language, count(*) AS edges, sha256({_PART.format(1)}::VARCHAR || '|' || {_PART.format(2)}::VARCHAR) AS fingerprint
FROM (SELECT DISTINCT a.language, concat_ws('|', ge.kind, a.fqn, b.fqn) AS e FROM ge JOIN gn a ON from_id = a.id JOIN gn b ON to_id = b.id WHERE ge.kind IN ('Call', 'Import', 'Uses', 'Type', 'Extends', 'Implements')) GROUP BY 1) USING (language)"""),  # fmt: skip
)(lambda g: structure_fingerprint(g.nodes, g.edges))

# Templates

_FILTER = "kind in ['Function', 'Method', 'File'] and is_test == false and path_repo_rel starts_with 'src/'"
_CHOSEN = "chosen AS (SELECT id FROM gn WHERE kind IN ('Function', 'File') AND NOT is_test AND path_repo_rel ILIKE 'src/%')"
query("template_nodes", _with("gn", _CHOSEN, "SELECT id FROM chosen"))(lambda g: T.filtered_dump(g.nodes, g.edges, _FILTER)[0].select("id"))
query("template_edges", _with("gn ge", _CHOSEN, "SELECT from_id, to_id, kind FROM ge WHERE kind IN ('Call', 'Import') AND from_id IN (SELECT id FROM chosen) AND to_id IN (SELECT id FROM chosen)"))(
    lambda g: T.filtered_dump(g.nodes, g.edges, _FILTER, "rel in ['Calls', 'Import']")[1].select("from_id", "to_id", "kind")
)
query("template_stubs", _with("gn ge", _CHOSEN, "SELECT DISTINCT id, true AS is_stub FROM (SELECT unnest([from_id, to_id]) AS id FROM ge WHERE kind = 'Extends' AND (from_id IN (SELECT id FROM chosen) OR to_id IN (SELECT id FROM chosen))) WHERE id NOT IN (SELECT id FROM chosen)"))(
    lambda g: T.filtered_dump(g.nodes, g.edges, _FILTER, "rel == 'Extends'", closed=False)[0].filter("is_stub").select("id", "is_stub")
)
_SEEDS = "hotseeds AS (SELECT id FROM gn WHERE fqn ILIKE '%hub0' OR (kind IN ('File', 'Folder') AND path_repo_rel = 'src/layer0'))"
_WALK = "tw AS (SELECT id, 0 AS depth FROM hotseeds UNION SELECT CASE WHEN e.from_id = tw.id THEN e.to_id ELSE e.from_id END, tw.depth + 1 FROM tw JOIN ge e ON (e.from_id = tw.id OR e.to_id = tw.id) AND e.kind IN ('Contains', 'Extends') WHERE tw.depth < 2), tn AS (SELECT id, min(depth) AS depth FROM tw GROUP BY 1)"


def _traversed(g: Graph) -> tuple[DataFrame, DataFrame]:
    seeds = T.resolve_seeds(g.nodes, paths=("src/layer0",), fqn_like=("%hub0",))
    return T.traverse(g.nodes, g.edges, seeds, 2, "both", ["Contains", "Extends"])


query("template_traversal", _with("gn ge", _SEEDS + ",\n" + _WALK, "SELECT id, depth FROM tn"))(lambda g: _traversed(g)[0])
query("template_traversal_edges", _with("gn ge", _SEEDS + ",\n" + _WALK, "SELECT from_id, to_id, kind FROM ge WHERE kind IN ('Contains', 'Extends') AND from_id IN (SELECT id FROM tn) AND to_id IN (SELECT id FROM tn)"))(lambda g: _traversed(g)[1].select("from_id", "to_id", "kind"))
query("node_filter", graph("gn", "SELECT id FROM gn WHERE kind IN ('Interface') AND NOT is_vendor"))(lambda g: g.nodes.filter(parse_node_filter("kind == 'Trait' AND is_vendor == false").column()).select("id"))

_TOML = """[graph]
mode = "traversal"
depth = 2
direction = "both"
edge_filter = "rel in ['Contains', 'Extends']"
node_filter = "kind in ['Function', 'File'] and path_repo_rel starts_with 'src/'"

[[graph.seed.roots]]
by_path_repo_rel = "src/layer0"

[[graph.seed.roots]]
by_fqn_like = "%hub0"
"""
query("template_file", _with("gn ge", _SEEDS + ",\n" + _WALK, "SELECT id, depth, kind FROM tn JOIN gn USING (id) WHERE kind IN ('Function', 'File') AND starts_with(path_repo_rel, 'src/')"))(
    lambda g: T.run_template(g.nodes, g.edges, T.Template.parse(_TOML))[0].select("id", "depth", "kind")
)
_OVERRIDES = V.Overrides.parse('{"file_overrides": [{"path": "shared/prelude.rs", "classification": "test"}, {"path": "shared/types.ts", "classification": "generated"}], "entry_point_patterns": [{"pattern": "^flush", "action": "mark_as_entry_point"}]}')
_FLAGS = "coalesce('{p}' IN (path_repo_rel, file, fqn), false)"
query(
    "overridden_files",
    graph("gn", f"SELECT id, is_test OR {_FLAGS.format(p='shared/prelude.rs')} AS is_test, is_vendor AND NOT {_FLAGS.format(p='shared/prelude.rs')} AS is_vendor, is_generated AND NOT {_FLAGS.format(p='shared/prelude.rs')} OR {_FLAGS.format(p='shared/types.ts')} AS is_generated FROM gn WHERE kind = 'File'"),
)(lambda g: V.with_file_overrides(g.nodes, _OVERRIDES).filter("kind = 'File'").select("id", "is_test", "is_vendor", "is_generated"))
query("dead_code_overridden", _with("fn outside fans", _ENTRY + ",\n" + _DEAD, "SELECT dead.* FROM dead JOIN fn USING (id) WHERE NOT (regexp_matches(name, '(?i)^flush') OR regexp_matches(fqn, '(?i)^flush'))"))(
    lambda g: V.without_exempt(D.dead_code(g.functions, g.nodes, g.classes, g.fans, g.outside, _OVERRIDES.entry_rules()), _OVERRIDES)
)
_PY = "language = 'python' AND string_split(lower(path_repo_rel), '/')[-1] IN "
query(
    "frameworks",
    graph("gn", f"""SELECT id, CASE WHEN {_PY}('tasks.py', 'celery.py', 'celery_app.py') THEN ['celery'] WHEN {_PY}('views.py', 'urls.py', 'models.py', 'admin.py', 'forms.py', 'apps.py', 'settings.py', 'middleware.py') THEN ['django']
WHEN regexp_matches(lower(path_repo_rel), '(^|/)jest[.](setup|config)[.](js|ts|mjs|cjs)$') THEN ['jest'] WHEN regexp_matches(lower(path_repo_rel), '(^|/)vitest[.](setup|config)[.](js|ts|mjs|cjs)$') THEN ['vitest'] ELSE ['plain'] END AS frameworks FROM gn WHERE kind = 'File'"""),  # fmt: skip
)(lambda g: g.nodes.filter("kind = 'File'").select("id", P.frameworks_of("path_repo_rel", "language").alias("frameworks")))
