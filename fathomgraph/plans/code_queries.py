"""Queries about the resolution of names, test files, languages and paths, and about results between scans, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgraph.functions.paths import path_role
from fathomgraph.operators import findings as N
from fathomgraph.operators import git_signals as G
from fathomgraph.operators import history as H
from fathomgraph.operators import incremental as U
from fathomgraph.operators import quality as Y
from fathomgraph.operators import resolution as R
from fathomgraph.operators.metrics import Thresholds
from fathomgraph.operators.snapshot_diff import run_order
from fathomgraph.plans.code_graph import Graph
from fathomgraph.plans.graph_queries import _DEAD, _ENTRY, _dead
from fathomgraph.plans.graph_sql import auxiliary_path, graph, outside_path, path_role as sql_path_role, test_path
from fathomgraph.plans.table_queries import _COMMITS, NOW, _findings, _sizes, commits
from fathomgraph.sources.history import SOURCE_ENDINGS
from fathomgraph.sources.tables import table
from fathomgraph.functions.text_ids import clean_id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: bool = False):
    def add(f):
        QUERIES[name] = (lambda s, d: f(lambda t: table(s, d, t))) if tables else (lambda s, d: f(Graph.of(s, d)))
        if sql:
            SQL[name] = sql
        return f

    return add


def _with(names: str, more: str, body: str) -> str:
    return graph(names, "").rstrip() + ",\n" + more + "\n" + body


# Names to symbols. Every function is a site that names itself: by its whole name, its last two parts, or its last, as the length of its name says.

_SITES = "sites AS (SELECT id AS site, CASE length(fqn) % 3 WHEN 0 THEN fqn WHEN 1 THEN array_to_string(string_split(fqn, '::')[-2:], '::') ELSE name END AS name, CASE WHEN contains(fqn, '::') THEN regexp_replace(fqn, '::[^:]*$', '') END AS module FROM fn WHERE fqn IS NOT NULL)"


def _sites(g: Graph) -> DataFrame:
    parts = F.split("fqn", "::")
    short = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, -2, 2), "::")).otherwise(F.col("fqn"))
    name = F.when(F.length("fqn") % 3 == 0, F.col("fqn")).when(F.length("fqn") % 3 == 1, short).otherwise(F.col("name"))
    return g.functions.filter("fqn is not null").select(F.col("id").alias("site"), name.alias("name"), F.when(F.col("fqn").contains("::"), F.regexp_replace("fqn", "::[^:]*$", "")).alias("module"))


query(
    "resolved_names",
    _with("fn", _SITES + """,
offers AS (SELECT DISTINCT id AS symbol, rule, key FROM (SELECT id, fqn, unnest([0, 2, 3]) AS rule, unnest([fqn, array_to_string(string_split(fqn, '::')[-2:], '::'), name]) AS key FROM fn WHERE fqn IS NOT NULL) WHERE rule <> 2 OR contains(key, '::')),
asks AS (SELECT site, unnest([0, 1, 2, 3]) AS asked, unnest([0, 0, 2, 3]) AS rule, unnest([name, concat_ws('::', module, name), name, string_split(name, '::')[-1]]) AS key FROM sites),
met AS (SELECT DISTINCT site, symbol, asked FROM asks JOIN offers USING (rule, key))""", "SELECT site, symbol, CASE WHEN asked <= 1 THEN 'High' WHEN asked = 2 THEN 'Medium' ELSE 'Low' END AS confidence FROM met QUALIFY asked = min(asked) OVER (PARTITION BY site)"),
)(lambda g: R.cascade(_sites(g), g.functions.filter("fqn is not null").select(F.col("id").alias("symbol"), "fqn")))

# Unresolved calls: every function calls its own last name, half of them as methods.

_CALLS = f"k AS (SELECT fn.id, string_split(fqn, '::')[-1] AS last, length(fqn) % 2 = 0 AS m, coalesce({test_path('path')} OR {auxiliary_path('path')}, false) AS o FROM fn LEFT JOIN paths USING (id) WHERE fqn IS NOT NULL)"
_MET = "x AS (SELECT a.id AS from_id, b.id AS to_id, a.m, count(*) OVER (PARTITION BY a.id) AS n FROM k a JOIN k b ON a.last = b.last AND (a.o OR NOT b.o))"


def _calls(g: Graph) -> tuple[DataFrame, DataFrame]:
    own = g.functions.filter("fqn is not null").join(g.paths, "id", "left")
    return own.select(F.col("id").alias("site"), F.col("id").alias("caller"), F.col("fqn").alias("name"), "path", (F.length("fqn") % 2 == 0).alias("is_method")), own.select(F.col("id").alias("symbol"), "fqn", "path")


query("fallback_calls", _with("fn paths", _CALLS + ",\n" + _MET, "SELECT DISTINCT from_id, to_id, 'Low' AS confidence FROM x WHERE (n = 1 OR m) AND from_id <> to_id"))(lambda g: R.fallback_calls(*_calls(g)))
query(
    "resolution_with_drops",
    _with("ge fn", """d AS (SELECT 'Call' AS kind, count(*) AS dropped FROM (SELECT string_split(fqn, '::')[-1] AS last, length(fqn) % 2 = 0 AS m, count(*) OVER (PARTITION BY string_split(fqn, '::')[-1]) AS n FROM fn WHERE fqn IS NOT NULL) WHERE n > 1 AND NOT m),
e AS (SELECT kind, language_server, heuristic, coalesce(dropped, 0) AS dropped FROM (SELECT kind, count(*) FILTER (source = 'Lsp') AS language_server, count(*) FILTER (source = 'Heuristic') AS heuristic FROM ge GROUP BY 1) LEFT JOIN d USING (kind))""",
          "SELECT *, CASE WHEN rate >= 0.5 THEN 'Critical' WHEN rate >= 0.25 THEN 'High' WHEN rate >= 0.1 THEN 'Warning' END AS level FROM (SELECT *, (heuristic + dropped) / nullif(language_server + heuristic + dropped, 0) AS rate FROM e)"),
)(lambda g: Y.resolution_quality(g.edges, drops=R.ambiguous_drops(*_calls(g)).agg(F.count(F.lit(1)).alias("dropped")).select(F.lit("Call").alias("kind"), "dropped")))
_TYPES = "ty AS (SELECT id, name, file FROM gn WHERE kind IN ('Struct', 'Enum', 'Type', 'Interface') AND name IS NOT NULL), us AS (SELECT DISTINCT id, string_split(fqn, '::')[-2] AS name, file, ['Extends', 'Implements', 'Uses'][length(fqn) % 3 + 1] AS kind FROM gn WHERE kind = 'Function' AND contains(fqn, '::'))"
query(
    "fallback_types",
    _with("gn", _TYPES, """SELECT DISTINCT u.id AS from_id, CASE WHEN a.n = 1 THEN a.one WHEN h.n = 1 THEN h.one END AS to_id, u.kind, 'Medium' AS confidence FROM us u JOIN (SELECT name, count(*) AS n, min(id) AS one FROM ty GROUP BY 1) a USING (name)
LEFT JOIN (SELECT name, file, count(*) AS n, min(id) AS one FROM ty GROUP BY 1, 2) h ON h.name = u.name AND h.file = u.file WHERE CASE WHEN a.n = 1 THEN a.one WHEN h.n = 1 THEN h.one END <> u.id"""),  # fmt: skip
)(lambda g: R.fallback_types(
    g.nodes.filter("kind = 'Function' and contains(fqn, '::')").select(F.col("id").alias("user"), F.element_at(F.split("fqn", "::"), -2).alias("name"), "file", F.element_at(F.array(*[F.lit(k) for k in ("Extends", "Implements", "Uses")]), (F.length("fqn") % 3).cast("int") + 1).alias("how")),
    g.nodes.filter("kind in ('Struct', 'Enum', 'Type', 'Interface') and name is not null").select(F.col("id").alias("symbol"), "name", "file"),
))
query(
    "fallback_variables",
    _with("gn par", "va AS (SELECT id, name, file FROM gn WHERE kind = 'Variable' AND name IS NOT NULL), us AS (SELECT DISTINCT parent AS id, name, CASE WHEN length(name) % 2 = 0 THEN file END AS file FROM va JOIN par ON par.node = va.id)", """SELECT DISTINCT u.id AS from_id, CASE WHEN h.n = 1 THEN h.one WHEN a.n = 1 THEN a.one END AS to_id, 'Uses' AS kind, 'Low' AS confidence
FROM us u JOIN (SELECT name, count(*) AS n, min(id) AS one FROM va GROUP BY 1) a USING (name) LEFT JOIN (SELECT name, file, count(*) AS n, min(id) AS one FROM va GROUP BY 1, 2) h ON h.name = u.name AND h.file = u.file WHERE CASE WHEN h.n = 1 THEN h.one WHEN a.n = 1 THEN a.one END <> u.id"""),  # fmt: skip
)(lambda g: R.fallback_variables(g.nodes.filter("kind = 'Variable' and name is not null").join(g.parents.withColumnRenamed("node", "id"), "id").select(F.col("parent").alias("user"), "name", F.when(F.length("name") % 2 == 0, F.col("file")).alias("file")), g.nodes.filter("kind = 'Variable' and name is not null").select(F.col("id").alias("symbol"), "name", "file")))

# Test files and modules

query(
    "module_kinds",
    graph("mods gn", f"SELECT module, CASE WHEN starts_with(module, 'src/layer') THEN 'production' WHEN {outside_path('module')} OR s > 0.5 THEN 'non_production' ELSE 'production' END AS kind, CASE WHEN starts_with(module, 'src/layer') THEN 'override' WHEN {outside_path('module')} THEN 'path' WHEN s > 0.5 THEN 'tests' ELSE 'default' END AS reason FROM (SELECT module, avg(is_test::INTEGER) AS s FROM mods JOIN gn USING (id) GROUP BY 1)"),
)(lambda g: Y.module_kinds(g.modules.join(g.nodes.select("id", "is_test"), "id").select("module", "is_test"), ("src/layer",)))
query("majority_language", graph("gn", "SELECT language, files, files / n AS share, files / n >= 0.6 AS is_majority FROM (SELECT language, count(*) AS files, sum(count(*)) OVER () AS n FROM gn WHERE kind = 'File' AND language IS NOT NULL GROUP BY 1) ORDER BY files DESC, language LIMIT 1"))(lambda g: Y.majority_language(g.nodes.filter("kind = 'File'")))
query("file_roles", graph("gn", f"SELECT coalesce({sql_path_role('path_repo_rel')}, 'source') AS role, count(*) AS files, count(*) FILTER (path_repo_rel IS NULL) AS uncertain FROM gn WHERE kind = 'File' GROUP BY 1"))(
    lambda g: g.nodes.filter("kind = 'File'").groupBy(F.coalesce(path_role("path_repo_rel"), F.lit("source")).alias("role")).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("path_repo_rel").isNull()).alias("uncertain"))
)
query("node_annotation", graph("gn fans outside", "SELECT id, fqn, kind, fan_in, fan_out, is_non_production FROM gn JOIN fans USING (id) JOIN outside USING (id) WHERE fqn = (SELECT min(fqn) FROM gn WHERE kind = 'Function') OR array_to_string(string_split(fqn, '::')[-2:], '::') = (SELECT min(fqn) FROM gn WHERE kind = 'Function')"))(
    lambda g: _annotation(g, g.nodes.filter("kind = 'Function'").agg(F.min("fqn")).first()[0])
)
query("endings_of_files", graph("gn", f"SELECT lower(string_split(path_repo_rel, '.')[-1]) AS ending, count(*) AS files FROM gn WHERE kind = 'File' AND lower(string_split(path_repo_rel, '.')[-1]) IN ({', '.join(repr(e) for e in SOURCE_ENDINGS)}) GROUP BY 1"))(
    lambda g: g.nodes.filter("kind = 'File'").groupBy(F.lower(F.element_at(F.split("path_repo_rel", r"\."), -1)).alias("ending")).agg(F.count(F.lit(1)).alias("files")).filter(F.col("ending").isin(*SOURCE_ENDINGS))
)


def _annotation(g: Graph, needle: str | None) -> DataFrame:
    """The node that needle names by id, fqn or display name, with what is known about it."""
    from fathomgraph.functions.paths import display_name

    hit = (F.col("id") == needle) | (F.col("fqn") == needle) | (display_name("fqn") == needle)
    return g.nodes.filter(hit).select("id", "fqn", "kind").join(g.fans, "id").join(g.outside.select("id", "is_non_production"), "id")


# Dead code and how sure it is: files recorded lately count as touched, files without properties as read with gaps.

_SURE = f"""churn AS (SELECT file, date_diff('day', max(recorded_at)::DATE, DATE '2025-06-30') AS days FROM gn GROUP BY 1), gaps AS (SELECT DISTINCT json_extract_string(try_cast(location AS JSON), '$.file') AS file FROM nodes WHERE properties IS NULL OR trim(properties) = ''),
d AS (SELECT dead.id, gn.file, dead.reason, CASE WHEN days < 30 THEN 'Medium' ELSE 'High' END AS c FROM dead JOIN gn USING (id) LEFT JOIN churn ON churn.file = gn.file)"""
query("dead_code_confidence", _with("fn outside fans gn", _ENTRY + ",\n" + _DEAD + ",\n" + _SURE, "SELECT id, file, reason, CASE WHEN reason = 'no_callers' AND file IN (SELECT file FROM gaps WHERE file IS NOT NULL) THEN 'Low' ELSE c END AS confidence FROM d"))(lambda g: _sure(g))
query("no_callers_split", _with("fn outside fans gn", _ENTRY + ",\n" + _DEAD + ",\n" + _SURE, "SELECT count(*) AS total, count(*) FILTER (c = 'High' AND NOT coalesce(file IN (SELECT file FROM gaps WHERE file IS NOT NULL), false)) AS high FROM d WHERE reason = 'no_callers'"))(
    lambda g: _sure(g).filter("reason = 'no_callers'").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("confidence") == "High").alias("high"))
)


def _sure(g: Graph) -> DataFrame:
    dead = _dead(g).join(g.nodes.select("id", "file"), "id").select("id", "file", "reason", F.lit("High").alias("confidence"))
    churn = g.nodes.groupBy("file").agg(F.datediff(F.lit("2025-06-30").cast("date"), F.max("recorded_at").cast("date")).alias("last_touched_days"))
    empty = g.raw_nodes.filter("properties is null or trim(properties) = ''").select(F.get_json_object("location", "$.file").alias("file"), F.array(F.lit("properties")).alias("gaps"))
    return Y.downgraded_by_gaps(Y.downgraded_by_churn(dead, churn), empty)


# Removal of files with what hangs on them

_GONE = "gone AS (SELECT id FROM gn WHERE length(file) % 7 = 0)"
query("pruned_edges", _with("gn ge", _GONE, "SELECT from_id, to_id, kind FROM ge WHERE from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone)"))(
    lambda g: U.prune(g.nodes, g.edges, g.nodes.select("file").filter("length(file) % 7 = 0").distinct())[1].select("from_id", "to_id", "kind")
)
query("upserted_edges", graph("ge", "SELECT from_id, to_id, kind, source, confidence FROM ge"))(
    lambda g: U.upsert(g.edges.filter("length(from_id) % 2 = 0 or confidence = 'High'"), g.edges, ["from_id", "to_id", "kind"], "recorded_at").select("from_id", "to_id", "kind", "source", "confidence")
)

# Between scans

query(
    "finding_changes",
    """WITH u AS (SELECT DISTINCT id, project_id, started_at FROM scan_runs WHERE lower(trim(status)) = 'completed'), r AS (SELECT id, project_id, row_number() OVER (PARTITION BY project_id ORDER BY started_at, id) AS nth, count(*) OVER (PARTITION BY project_id) AS n FROM u),
f AS (SELECT scan_run_id, segment_id, max(4 - ('0x' || g[1:4])::INTEGER % 4) AS rank FROM (SELECT *, lower(trim(graph_fingerprint)) AS g FROM analysis_segment_cache) WHERE g <> '' AND segment_id IS NOT NULL GROUP BY 1, 2),
a AS (SELECT segment_id || ':' || project_id AS finding, rank FROM f JOIN r ON r.id = scan_run_id AND nth = 1), b AS (SELECT segment_id || ':' || project_id AS finding, rank FROM f JOIN r ON r.id = scan_run_id AND nth = n)
SELECT finding, CASE WHEN a.rank IS NULL THEN 'new' WHEN b.rank IS NULL THEN 'resolved' ELSE 'worsened' END AS change FROM a FULL JOIN b USING (finding) WHERE a.rank IS NULL OR b.rank IS NULL OR b.rank > a.rank""",
    True,
)(lambda t: _finding_changes(t))


def _finding_changes(t) -> DataFrame:
    """Between the first and the last completed run of each project, whose segments stand for findings about the project."""
    runs = run_order(t("scan_runs"))
    own = _findings(t).select("type", "severity", F.col("node_ids")[0].alias("scan_run_id")).join(runs, "scan_run_id").select("type", "severity", F.array("project_id").alias("node_ids"), "nth", "next_run")
    return N.finding_changes(own.filter("nth = 1"), own.filter("next_run is null"))


query("scan_percent", "WITH n AS (SELECT scan_run_id, count(DISTINCT fqn) AS nodes FROM node_snapshots GROUP BY 1), m AS (SELECT DISTINCT project_id, id, started_at, nodes FROM scan_runs JOIN n ON n.scan_run_id = id), d AS (SELECT *, lag(nodes) OVER (PARTITION BY project_id ORDER BY started_at, id) AS b FROM m) SELECT id, (nodes - b) / nullif(b, 0) * 100 AS nodes_percent FROM d", True)(
    lambda t: H.with_percent(H.run_deltas(_sizes(t), "project_id", ["started_at", "id"], ["nodes"]), ["nodes"]).select("id", "nodes_percent")
)
query(
    "history_window",
    _COMMITS + f", w AS (SELECT CASE WHEN count(DISTINCT commit) FILTER (committed_at::DATE >= DATE '{NOW}' - INTERVAL 6 MONTH) >= 30 THEN 6 WHEN count(DISTINCT commit) FILTER (committed_at::DATE >= DATE '{NOW}' - INTERVAL 12 MONTH) >= 30 THEN 12 ELSE 24 END AS m FROM commits) SELECT DISTINCT commit FROM commits, w WHERE committed_at::DATE >= DATE '{NOW}' - to_months(m::INTEGER)",
    True,
)(lambda t: G.history_window(commits(t), (6, 12, 24), NOW).select("commit").distinct())
query("known_file_commits", _COMMITS + ", known AS (SELECT 'src/s' || (s_suppkey % 10) || '/f' || s_suppkey || '.rs' AS file FROM supplier WHERE s_acctbal > 0) SELECT file, count(*) AS n FROM commits WHERE file IN (SELECT file FROM known) GROUP BY 1", True)(
    lambda t: G.known_files(commits(t), t("supplier").filter("s_acctbal > 0").select(F.concat(F.lit("src/s"), F.pmod("s_suppkey", F.lit(10)), F.lit("/f"), "s_suppkey", F.lit(".rs")).alias("file"))).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
)
# Files are tied where the first two lines of a returned order name their suppliers.
_TIED = ", tied AS (SELECT DISTINCT least(a.f, b.f) AS file_a, greatest(a.f, b.f) AS file_b FROM (SELECT l_orderkey, 'src/s' || (l_suppkey % 10) || '/f' || l_suppkey || '.rs' AS f FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R') a JOIN (SELECT l_orderkey, 'src/s' || (l_suppkey % 10) || '/f' || l_suppkey || '.rs' AS f FROM lineitem WHERE l_linenumber = 2) b USING (l_orderkey) WHERE a.f <> b.f)"
query("hidden_coupling", _COMMITS + """, per AS (SELECT DISTINCT commit, file FROM commits), totals AS (SELECT file, count(*) AS n FROM per GROUP BY 1), pairs AS (SELECT a.file AS file_a, b.file AS file_b, count(*) AS n FROM per a JOIN per b ON a.commit = b.commit AND a.file < b.file GROUP BY 1, 2)""" + _TIED + """
SELECT file_a, file_b, pairs.n AS co_changes, pairs.n / greatest(a.n, b.n) AS score, (file_a, file_b) NOT IN (SELECT (file_a, file_b) FROM tied) AS hidden FROM pairs JOIN totals a ON file_a = a.file JOIN totals b ON file_b = b.file WHERE pairs.n >= 3 AND pairs.n / greatest(a.n, b.n) >= 0.03""", True)(lambda t: _hidden(t))  # fmt: skip


def _hidden(t) -> DataFrame:
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_suppkey").cast("string").alias("id"))
    one, two = lines.filter("l_linenumber = 1 and l_returnflag = 'R'").select("l_orderkey", F.col("id").alias("from_id")), lines.filter("l_linenumber = 2").select("l_orderkey", F.col("id").alias("to_id"))
    edges = one.join(two, "l_orderkey").select("from_id", "to_id", F.lit("Call").alias("kind"))
    paths = t("lineitem").select("l_suppkey").distinct().select(F.col("l_suppkey").cast("string").alias("id"), F.concat(F.lit("src/s"), F.pmod("l_suppkey", F.lit(10)), F.lit("/f"), "l_suppkey", F.lit(".rs")).alias("path"))
    return G.temporal_coupling(commits(t), G.file_links(edges, paths), Thresholds(temporal_min_score=0.03))


query("population_stats", "SELECT nullif(lower(trim(language)), '') AS language, count(tangle_index) AS n, avg(tangle_index) AS mean, stddev_samp(tangle_index) AS std FROM (SELECT DISTINCT id, language, tangle_index FROM population WHERE id IS NOT NULL AND NOT coalesce(isnan(tangle_index), false)) GROUP BY 1", True)(
    lambda t: t("population").filter("id is not null and not coalesce(isnan(tangle_index), false)").select("id", "language", "tangle_index").distinct().groupBy(clean_id("language").alias("language")).agg(F.count("tangle_index").alias("n"), F.avg("tangle_index").alias("mean"), F.stddev_samp("tangle_index").alias("std"))
)
