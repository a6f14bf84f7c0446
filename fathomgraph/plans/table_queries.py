"""Queries over the other tables: orders as commits, scan runs as history, documents as files, events as progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgraph.functions.paths import folder_key
from fathomgraph.functions.text_ids import clean_id
from fathomgraph.operators import findings as N
from fathomgraph.operators import git_signals as G
from fathomgraph.operators import history as H
from fathomgraph.operators import incremental as U
from fathomgraph.operators import quality as Y
from fathomgraph.operators import resolution as R
from fathomgraph.operators.metrics import Thresholds
from fathomgraph.streaming import progress as Q
from fathomgraph.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda s, d: f(lambda t: table(s, d, t))
        if sql:
            SQL[name] = sql
        return f

    return add


# Commit history: an order is a commit of the suppliers that its lines name.

def commits(t) -> DataFrame:
    lines = t("lineitem").select(F.col("l_orderkey").alias("commit"), F.concat(F.lit("src/s"), F.pmod("l_suppkey", F.lit(10)), F.lit("/f"), "l_suppkey", F.lit(".rs")).alias("file"))
    orders = t("orders").select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("committed_at"))
    return lines.join(orders, "commit")


NOW = "2001-08-31"
_COMMITS = "WITH commits AS (SELECT l_orderkey AS commit, o_custkey AS author, o_orderdate AS committed_at, 'src/s' || (l_suppkey % 10) || '/f' || l_suppkey || '.rs' AS file FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_PAIRS = """, per AS (SELECT DISTINCT commit, file FROM commits), small AS (SELECT commit FROM per GROUP BY 1 HAVING count(*) <= 50), p AS (SELECT per.* FROM per JOIN small USING (commit)),
totals AS (SELECT file, count(*) AS n FROM p GROUP BY 1), pairs AS (SELECT a.file AS file_a, b.file AS file_b, count(*) AS n FROM p a JOIN p b ON a.commit = b.commit AND a.file < b.file GROUP BY 1, 2),
coupled AS (SELECT file_a, file_b, pairs.n AS co_changes, pairs.n / greatest(a.n, b.n) AS score FROM pairs JOIN totals a ON file_a = a.file JOIN totals b ON file_b = b.file WHERE pairs.n >= 3 AND pairs.n / greatest(a.n, b.n) >= 0.03)"""
_LOOSE = Thresholds(temporal_min_score=0.03)
query("co_changes", _COMMITS + _PAIRS + " SELECT * FROM pairs")(lambda t: G.co_changes(commits(t)))
query("temporal_coupling", _COMMITS + _PAIRS + " SELECT *, true AS hidden FROM coupled")(lambda t: G.temporal_coupling(commits(t), None, _LOOSE))
query(
    "module_co_changes",
    _COMMITS + _PAIRS + """ SELECT least(a, b) AS module_a, greatest(a, b) AS module_b, sum(co_changes)::BIGINT AS co_changes, max(score) AS max_score, true AS hidden
FROM (SELECT *, regexp_extract(file_a, '^[^/]*/[^/]*') AS a, regexp_extract(file_b, '^[^/]*/[^/]*') AS b FROM coupled) WHERE a <> b GROUP BY 1, 2""",
)(lambda t: G.module_co_changes(G.temporal_coupling(commits(t), None, _LOOSE), lambda c: folder_key(c, 2)))
query(
    "file_churn",
    _COMMITS + f""", a AS (SELECT file, author, count(DISTINCT commit) AS n, max(committed_at) AS last FROM commits GROUP BY 1, 2),
f AS (SELECT file, sum(n)::BIGINT AS changes, count(author) AS authors, date_diff('day', max(last)::DATE, DATE '{NOW}') AS last_touched_days, 1 - sum(n * n) / (sum(n) * sum(n)) AS dispersion FROM a GROUP BY 1)
SELECT *, changes * ln(1 + changes) AS hotspot, last_touched_days <= 30 AS active_recent, changes >= 5 AS high_churn, authors >= 3 AND dispersion >= 0.5 AS shared_ownership FROM f""",
)(lambda t: G.churn(commits(t), NOW))
query(
    "change_clusters",
    _COMMITS + """, s AS (SELECT commit, list_sort(list(DISTINCT file)) AS files FROM commits GROUP BY 1 HAVING count(DISTINCT file) > 1), e AS (SELECT files, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 3),
q AS (SELECT files, unnest(files) AS a FROM s), pr AS (SELECT a, b, count(*) AS n FROM (SELECT a, unnest(files) AS b FROM q) WHERE a < b GROUP BY 1, 2 HAVING count(*) >= 3),
c AS (SELECT DISTINCT a, b FROM (SELECT a, unnest(files) AS b FROM (SELECT files, unnest(files) AS a FROM e)) WHERE a < b)
SELECT files, n FROM e UNION ALL SELECT [a, b], n FROM pr WHERE (a, b) NOT IN (SELECT (a, b) FROM c)""",
)(lambda t: G.clusters(commits(t)))
query("busiest_authors", _COMMITS + ", n AS (SELECT file, author, count(DISTINCT commit) AS n FROM commits GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, author) AS place FROM n QUALIFY place <= 3")(lambda t: G.author_rank(commits(t)))
query("newest_commits", _COMMITS + f", one AS (SELECT commit, max(committed_at) AS newest FROM commits GROUP BY 1 HAVING date_diff('day', max(committed_at)::DATE, DATE '{NOW}') <= 365 ORDER BY newest DESC, commit LIMIT 500) SELECT commit, author, file FROM commits WHERE commit IN (SELECT commit FROM one)")(
    lambda t: G.newest_commits(commits(t), 500, 365, NOW).select("commit", "author", "file")
)

# Scan history

_DONE = "FROM scan_runs WHERE lower(trim(status)) = 'completed'"
query("latest_scans", f"SELECT project_id, arg_max(id, (started_at, id)) AS id, max(started_at) AS started_at {_DONE} GROUP BY 1")(lambda t: H.latest_completed(t("scan_runs")))
query("scan_series", "SELECT project_id, id, started_at, row_number() OVER (PARTITION BY project_id ORDER BY started_at, id) AS place FROM (SELECT DISTINCT project_id, id, started_at FROM scan_runs QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, id DESC) <= 3)")(
    lambda t: H.series(t("scan_runs").select("project_id", "id", "started_at").distinct(), 3)
)
query("scan_outcomes", "SELECT project_id, count(*) AS runs, count(*) FILTER (lower(trim(status)) = 'completed') AS completed, count(*) FILTER (lower(trim(status)) = 'failed') AS failed, count(*) FILTER (lower(trim(status)) = 'cancelled') AS cancelled, avg(date_diff('second', started_at, completed_at)) AS avg_seconds FROM (SELECT DISTINCT * FROM scan_runs) GROUP BY 1")(lambda t: H.durations(t("scan_runs")))
_SIZES = "n AS (SELECT scan_run_id, count(DISTINCT fqn) AS nodes FROM node_snapshots GROUP BY 1), m AS (SELECT DISTINCT project_id, id, started_at, nodes FROM scan_runs JOIN n ON n.scan_run_id = id)"
query(
    "scan_deltas",
    f"""WITH {_SIZES} SELECT id, nodes, d AS nodes_delta, CASE WHEN d IS NULL THEN NULL WHEN d = 0 THEN 'Stable' WHEN d < 0 THEN 'Improved' ELSE 'Worsened' END AS nodes_trend
FROM (SELECT *, nodes - lag(nodes) OVER (PARTITION BY project_id ORDER BY started_at, id) AS d FROM m)""",
)(lambda t: H.run_deltas(_sizes(t), "project_id", ["started_at", "id"], ["nodes"]).select("id", "nodes", "nodes_delta", "nodes_trend"))
query("scans_of_window", "SELECT DISTINCT id FROM scan_runs WHERE started_at >= TIMESTAMP '2025-01-01' - INTERVAL 6 MONTH AND started_at < TIMESTAMP '2025-01-01'")(
    lambda t: t("scan_runs").filter((F.col("started_at") >= H.window_start("6m", F.expr("timestamp_ntz'2025-01-01'"))) & (F.col("started_at") < F.expr("timestamp_ntz'2025-01-01'"))).select("id").distinct()
)


def _sizes(t) -> DataFrame:
    n = t("node_snapshots").groupBy(F.col("scan_run_id").alias("id")).agg(F.count_distinct("fqn").alias("nodes"))
    return t("scan_runs").select("project_id", "id", "started_at").distinct().join(n, "id")


# Findings and scores: segments of a scan as findings, projects of the population as probes.

def _findings(t) -> DataFrame:
    fingerprint = clean_id("graph_fingerprint")
    number = F.pmod(F.conv(F.substring(fingerprint, 1, 4), 16, 10).cast("int"), F.lit(4))
    severity = F.element_at(F.array(*[F.lit(s) for s in N.SEVERITY_RANK]), number + 1)
    return t("analysis_segment_cache").filter(fingerprint.isNotNull() & F.col("segment_id").isNotNull()).select(F.col("segment_id").alias("type"), F.concat_ws("-", "segment_id", "scan_run_id", fingerprint).alias("id"), severity.alias("severity"), F.array("scan_run_id").alias("node_ids"), number.alias("number"))


_FINDINGS = """WITH f AS (SELECT segment_id AS type, segment_id || '-' || scan_run_id || '-' || g AS id, ['Critical', 'High', 'Warning', 'Info'][n + 1] AS severity, 4 - n AS rank, scan_run_id AS node, n AS number
FROM (SELECT *, ('0x' || g[1:4])::INTEGER % 4 AS n FROM (SELECT *, lower(trim(graph_fingerprint)) AS g FROM analysis_segment_cache) WHERE g <> '' AND segment_id IS NOT NULL))"""
query("capped_findings", _FINDINGS + ", r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY rank DESC, id) AS k FROM f) SELECT type, id, severity, 0::BIGINT AS overflow FROM r WHERE k <= 10 UNION ALL SELECT type, type || '-overflow', 'Info', count(*) FROM r WHERE k > 10 GROUP BY type")(lambda t: N.capped(_findings(t)))
query("node_risk", _FINDINGS + """ SELECT node, CASE WHEN c + h >= 2 THEN 'Critical' WHEN c > 0 OR h + w >= 2 THEN 'High' WHEN h > 0 OR w > 0 THEN 'Warning' WHEN i > 0 THEN 'Info' END AS risk
FROM (SELECT node, count(*) FILTER (rank = 4) AS c, count(*) FILTER (rank = 3) AS h, count(*) FILTER (rank = 2) AS w, count(*) FILTER (rank = 1) AS i FROM f GROUP BY 1)""")(lambda t: N.node_risk(_findings(t)))  # fmt: skip
query("priorities", _FINDINGS + " SELECT row_number() OVER (ORDER BY score DESC, rank DESC, id) AS place, id, score FROM (SELECT id, rank, rank * (1 + log2(number * 10 + 1)) * CASE WHEN number = 1 THEN 1.5 ELSE 1 END * CASE WHEN rank >= 3 THEN 1 ELSE 0.7 END * CASE WHEN type = 'Cycles' THEN 1.3 ELSE 1 END AS score FROM f) QUALIFY place <= 10")(
    lambda t: N.priorities(_findings(t).select("id", "severity", (F.col("number") * 10).alias("blast"), (F.col("number") == 1).alias("temporal"), F.when(N.severity_rank("severity") >= 3, "High").otherwise("Medium").alias("confidence"), (F.col("type") == "Cycles").alias("worsening")))
)
_METRICS = ("dead_ratio", "cycle_ratio", "hotspot_concentration")
query(
    "population_scores",
    f"""WITH o AS (SELECT DISTINCT id, coalesce(lower(trim(language)), '') AS language, {", ".join(_METRICS)} FROM population),
v AS ({" UNION ALL ".join(f"SELECT id, language, '{m}' AS metric, {m} AS value FROM o WHERE {m} IS NOT NULL AND NOT isnan({m})" for m in _METRICS)}),
r AS (SELECT *, rank() OVER w AS k, count(*) OVER (PARTITION BY language, metric, value) AS n, count(*) OVER (PARTITION BY language, metric) AS total FROM v WINDOW w AS (PARTITION BY language, metric ORDER BY value))
SELECT id AS probe, language, metric, round((total - (k - 1 + n) + n / 2) / total * 100) AS percentile FROM r""",
)(lambda t: _scored(t))


def _scored(t) -> DataFrame:
    own = t("population").select("id", F.coalesce(F.lower(F.trim("language")), F.lit("")).alias("language"), *_METRICS).distinct()
    return N.population_scores(own, own.withColumnRenamed("id", "probe"), _METRICS)


# Incremental work: documents as files, a scan before in which some differ.

def _files(t) -> DataFrame:
    return t("documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("text"), F.coalesce("lang", F.lit("")).alias("language"), F.col("doc_id"))


def _before(t) -> DataFrame:
    edited = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text"))
    return _files(t).filter("doc_id % 11 != 0").select("path", U.content_hash(edited).alias("hash"), "language")


query("incremental_plan", "SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN 'added' WHEN doc_id % 13 = 0 THEN 'removed' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM documents WHERE NOT (doc_id % 11 = 0 AND doc_id % 13 = 0)")(
    lambda t: U.plan(_before(t), _files(t).filter("doc_id % 13 != 0").select("path", U.content_hash("text").alias("hash"), "language"))
)
query("content_hashes", "SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents")(lambda t: t("documents").select("doc_id", U.content_hash("text").alias("hash")))
query("stable_ids", "SELECT DISTINCT fqn, sha256('fqn' || chr(0) || fqn) AS stable_id FROM nodes WHERE fqn IS NOT NULL")(lambda t: t("nodes").filter("fqn is not null").select("fqn").distinct().select("fqn", U.stable_id(F.col("fqn")).alias("stable_id")))
query("upsert_last_writer", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")(
    lambda t: U.upsert(t("events").filter("event_id % 2 = 0").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("v")), t("events").filter("event_id % 2 = 1").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("v")), ["user_id"], "v").select("user_id", "v.event_type", "v.ts")
)
query(
    "reusable_segments",
    """WITH u AS (SELECT DISTINCT id, project_id, started_at FROM scan_runs WHERE lower(trim(status)) = 'completed'), r AS (SELECT id AS scan_run_id, lag(id) OVER (PARTITION BY project_id ORDER BY started_at, id) AS previous FROM u),
h AS (SELECT scan_run_id, segment_id, arg_max(g, (updated_at, g)) AS g FROM (SELECT *, nullif(lower(trim(graph_fingerprint)), '') AS g FROM analysis_segment_cache) WHERE segment_id IS NOT NULL GROUP BY 1, 2)
SELECT r.scan_run_id, a.segment_id, a.g AS graph_fingerprint FROM r JOIN h a ON a.scan_run_id = r.scan_run_id JOIN h b ON b.scan_run_id = r.previous AND b.segment_id = a.segment_id AND b.g = a.g""",
)(lambda t: U.reusable_segments(t("analysis_segment_cache"), t("scan_runs")))

# Progress events

query("event_windows", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")(lambda t: Q.counts_by_window(t("events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))
query("event_states", "SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, arg_max(event_type, (ts, event_id)) AS last_type, max(ts) AS last_at FROM events GROUP BY 1")(lambda t: Q.latest_state(t("events")))

# From places to edges: a node's line is a site, the nodes of its file are the symbols.

_PLACED = "p AS (SELECT DISTINCT lower(trim(id)) AS symbol, json_extract_string(try_cast(location AS JSON), '$.file') AS file, json_extract_string(try_cast(location AS JSON), '$.start_line')::INTEGER AS start_line, json_extract_string(try_cast(location AS JSON), '$.end_line')::INTEGER AS end_line FROM nodes WHERE nullif(trim(id), '') IS NOT NULL AND lower(trim(kind)) IN ('function', 'struct', 'interface'))"


def _placed(t) -> DataFrame:
    from fathomgraph.functions.text_ids import stripped

    place = F.from_json("location", "struct<file:string,start_line:int,end_line:int>")
    return t("nodes").filter(F.lower(stripped("kind")).isin("function", "struct", "interface")).select(clean_id("id").alias("symbol"), place["file"].alias("file"), place["start_line"].alias("start_line"), place["end_line"].alias("end_line")).filter("symbol is not null").distinct()


query(
    "enclosing_symbols",
    f"""WITH {_PLACED} SELECT site, symbol FROM (SELECT a.site, b.symbol, row_number() OVER (PARTITION BY a.site ORDER BY b.end_line - b.start_line, b.start_line DESC, b.symbol) AS k
FROM (SELECT symbol AS site, file, min(start_line) + 1 AS line FROM p GROUP BY 1, 2) a JOIN p b ON a.file = b.file AND a.line BETWEEN b.start_line AND b.end_line) WHERE k = 1""",
)(lambda t: R.enclosing(_placed(t).groupBy(F.col("symbol").alias("site"), "file").agg((F.min("start_line") + 1).alias("line")), _placed(t)))
query("folders_of_paths", r"""WITH d AS (SELECT DISTINCT path FROM documents WHERE path IS NOT NULL), s AS (SELECT list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')) AS p FROM d),
i AS (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM s WHERE len(p) > 0) SELECT DISTINCT CASE WHEN k = 1 THEN 'root' ELSE array_to_string(p[1:k - 1], '/') END AS parent, array_to_string(p[1:k], '/') AS child FROM i""")(lambda t: R.containment_from_paths(t("documents").select("path").distinct(), "root")[1])  # fmt: skip
query(
    "within_token_budget",
    "SELECT source, doc_id, tokens FROM (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY doc_id) AS through FROM (SELECT source, doc_id, ceil(length(coalesce(text, '')) / 4)::BIGINT AS tokens FROM documents)) WHERE through <= 2000",
)(lambda t: Y.within_budget(t("documents"), "source", "doc_id", "text", 2000))
