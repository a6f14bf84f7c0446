"""The pN_ queries of the general problems, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathomgraph.operators.hierarchy import containment, descendants
from fathomgraph.operators.hot_keys import fan, hot_ids, rows_by_node_kind
from fathomgraph.operators.orphans import edge_orphans, orphans_by_month
from fathomgraph.operators.snapshot_diff import graph_changes
from fathomgraph.plans.sql_parts import sql_confidence, sql_edge_kind, sql_id, sql_node_kind, sql_source
from fathomgraph.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": lambda s, d: hot_ids(table(s, d, "edges")),
    "p1_fan": lambda s, d: fan(table(s, d, "edges")),
    "p1_rows_by_node_kind": lambda s, d: rows_by_node_kind(table(s, d, "edges"), table(s, d, "nodes")),
    "p3_found": lambda s, d: edge_orphans(table(s, d, "edges"), table(s, d, "nodes")),
    "p3_by_month": lambda s, d: orphans_by_month(table(s, d, "edges"), table(s, d, "nodes")),
    "p4_found": lambda s, d: containment(table(s, d, "edges")),
    "p4_paths": lambda s, d: containment(table(s, d, "edges"), paths=True),
    "p4_descendants": lambda s, d: descendants(table(s, d, "edges")),
    "p5_found": lambda s, d: graph_changes(table(s, d, "node_snapshots"), table(s, d, "edge_snapshots"), table(s, d, "analysis_segment_cache"), table(s, d, "scan_runs")),
}

_ENDS = f"ends AS (SELECT 'to_id' AS side, {sql_id('to_id')} AS id FROM edges UNION ALL SELECT 'from_id', {sql_id('from_id')} FROM edges)"
_ORPHANS = f"""
e AS (SELECT DISTINCT edge_id, recorded_at AS r, {sql_id('from_id')} AS f, {sql_id('to_id')} AS t FROM edges),
x AS (SELECT edge_id, r, 'from' AS endpoint, f AS id FROM e UNION ALL SELECT edge_id, r, 'to', t FROM e),
n AS (SELECT DISTINCT {sql_id('id')} AS id, recorded_at AS s, removed_at AS q FROM nodes),
y AS (SELECT edge_id, endpoint, r, bool_or(s <= r AND (q IS NULL OR q > r)) AS there, bool_or(q <= r) AS gone, count(n.id) AS lives
      FROM x LEFT JOIN n ON x.id = n.id WHERE x.id IS NOT NULL GROUP BY 1, 2, 3),
lost AS (SELECT edge_id, endpoint, CASE WHEN gone THEN 'deleted' WHEN lives > 0 THEN 'late' ELSE 'missing' END AS reason,
      strftime(r, '%Y-%m') AS edge_month FROM y WHERE NOT coalesce(there, false))"""
_LINKS = f"""
k AS (SELECT {sql_id('from_id')} AS parent, {sql_id('to_id')} AS child, recorded_at AS r FROM edges WHERE {sql_edge_kind('kind')} = 'Contains'),
c AS (SELECT * FROM k WHERE parent IS NOT NULL AND child IS NOT NULL),
up AS (SELECT child AS node, arg_max(parent, (r, parent)) AS parent FROM c GROUP BY child),
ids AS (SELECT parent AS node FROM c UNION SELECT child FROM c),
above AS (SELECT node, parent AS above FROM up UNION SELECT a.node, up.parent FROM above a JOIN up ON a.above = up.node),
ring AS (SELECT node FROM above WHERE node = above),
root AS (SELECT ids.node FROM ids LEFT JOIN up ON ids.node = up.node WHERE up.node IS NULL),
tree AS (SELECT ids.node AS node_id,
    CASE WHEN ids.node IN (SELECT node FROM ring) THEN '' WHEN root.node IS NOT NULL THEN ids.node ELSE coalesce(max(a.above) FILTER (a.above IN (SELECT node FROM root)), '') END AS root_id,
    CASE WHEN ids.node IN (SELECT node FROM ring) THEN -1 WHEN root.node IS NOT NULL THEN 0
         WHEN max(a.above) FILTER (a.above IN (SELECT node FROM root)) IS NULL THEN -2 ELSE count(a.above) END::INTEGER AS tree_depth
  FROM ids LEFT JOIN above a ON ids.node = a.node LEFT JOIN root ON ids.node = root.node GROUP BY ids.node, root.node)"""


def _changes(name: str, table: str, key: str, compared: str, delivered: str) -> str:
    return f"""
SELECT '{name}' AS table_name, scan_run_id, record_key, change_type FROM (
  WITH s AS (SELECT scan_run_id, {key} AS record_key, {compared} AS v, row_number() OVER (PARTITION BY scan_run_id, {key} ORDER BY {delivered} DESC NULLS LAST, {compared} DESC) AS k
             FROM {table} WHERE {key} IS NOT NULL),
  one AS (SELECT scan_run_id, record_key, v FROM s WHERE k = 1),
  new AS (SELECT r.scan_run_id, r.previous, record_key, v FROM r JOIN one USING (scan_run_id) WHERE previous IS NOT NULL),
  old AS (SELECT r.scan_run_id, record_key, v FROM r JOIN one ON one.scan_run_id = r.previous)
  SELECT coalesce(new.scan_run_id, old.scan_run_id) AS scan_run_id, coalesce(new.record_key, old.record_key) AS record_key,
    CASE WHEN old.record_key IS NULL THEN 'added' WHEN new.record_key IS NULL THEN 'removed' WHEN new.v IS DISTINCT FROM old.v THEN 'changed' END AS change_type
  FROM new FULL JOIN old ON new.scan_run_id = old.scan_run_id AND new.record_key = old.record_key)
WHERE change_type IS NOT NULL"""


_EDGE_KEY = f"concat_ws('|', coalesce({sql_id('from_id')}, ''), coalesce({sql_id('to_id')}, ''), coalesce({sql_edge_kind('kind')}, trim(kind), ''))"

SQL: dict[str, str] = {
    "p1_found": f"WITH {_ENDS}, n AS (SELECT side, id, count(*) AS n FROM ends WHERE id IS NOT NULL GROUP BY 1, 2) SELECT side, id AS hot_id FROM n QUALIFY n >= 0.01 * sum(n) OVER (PARTITION BY side)",
    "p1_fan": f"""WITH e AS (SELECT {sql_id('from_id')} AS f, {sql_id('to_id')} AS t FROM edges),
i AS (SELECT t AS id, count(*) AS n, count(DISTINCT f) AS p FROM e WHERE t IS NOT NULL GROUP BY 1), o AS (SELECT f AS id, count(*) AS n, count(DISTINCT t) AS p FROM e WHERE f IS NOT NULL GROUP BY 1)
SELECT coalesce(i.id, o.id) AS id, coalesce(i.n, 0) AS in_rows, coalesce(i.p, 0) AS in_partners, coalesce(o.n, 0) AS out_rows, coalesce(o.p, 0) AS out_partners, coalesce(i.n * o.n, 0) AS paths_through FROM i FULL JOIN o ON i.id = o.id""",
    "p1_rows_by_node_kind": f"WITH {_ENDS}, n AS (SELECT {sql_id('id')} AS id, {sql_node_kind('kind')} AS node_kind FROM nodes) SELECT side, node_kind, count(*) AS n FROM ends JOIN n USING (id) GROUP BY 1, 2",
    "p3_found": f"WITH {_ORPHANS} SELECT * FROM lost",
    "p3_by_month": f"WITH {_ORPHANS} SELECT 'edges' AS table_name, endpoint, edge_month, reason, count(*) AS n FROM lost GROUP BY ALL",
    "p4_found": f"WITH RECURSIVE {_LINKS} SELECT * FROM tree",
    "p4_paths": f"""WITH RECURSIVE {_LINKS}, walk AS (SELECT node, node AS path FROM root UNION ALL SELECT up.node, walk.path || '/' || up.node FROM walk JOIN up ON up.parent = walk.node)
SELECT tree.*, walk.path FROM tree LEFT JOIN walk ON tree.node_id = walk.node""",
    "p4_descendants": f"""WITH RECURSIVE {_LINKS} SELECT a.above AS ancestor_id, a.node AS node_id, (t.tree_depth - p.tree_depth)::INTEGER AS distance
FROM above a JOIN tree t ON a.node = t.node_id JOIN tree p ON a.above = p.node_id WHERE t.tree_depth > 0""",
    "p5_found": f"""WITH u AS (SELECT DISTINCT id, project_id, started_at FROM scan_runs WHERE lower(trim(status)) = 'completed'),
r AS (SELECT id AS scan_run_id, lag(id) OVER (PARTITION BY project_id ORDER BY started_at, id) AS previous FROM u)
{_changes('nodes', 'node_snapshots', 'fqn', f"({sql_id('id')}, lower(trim(kind)))", 'delivered_at')} UNION ALL
{_changes('edges', 'edge_snapshots', _EDGE_KEY, f"({sql_source('provenance')}, {sql_confidence('provenance')})", 'delivered_at')} UNION ALL
{_changes('analysis_segment_cache', 'analysis_segment_cache', 'segment_id', sql_id('graph_fingerprint'), 'updated_at')}""",
}
