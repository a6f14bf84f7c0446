"""The graph and its derived relations in DuckDB's SQL, written independently of the operators they are compared with.

`graph(names, body)` puts before body the common tables that the names need.
"""

from __future__ import annotations

import re

from fathomgraph.plans.sql_parts import sql_confidence, sql_edge_kind, sql_id, sql_json, sql_node_kind, sql_source
from fathomgraph.sources.graph import CALL_LIKE


def _text(name: str) -> str:
    return f"CASE WHEN json_type(p, '$.{name}') = 'VARCHAR' THEN json_extract_string(p, '$.{name}') END AS {name}"


def _flag(name: str) -> str:
    return f"coalesce(CASE WHEN json_type(p, '$.{name}') = 'BOOLEAN' THEN json_extract_string(p, '$.{name}') = 'true' END, false) AS {name}"


def _count(name: str) -> str:
    return f"CASE WHEN json_type(p, '$.{name}') IN ('UBIGINT', 'BIGINT') THEN json_extract_string(p, '$.{name}')::INTEGER END AS {name}"


# Paths by lists of their components and words; the operators use patterns instead.

#: As the words of paths are given.
_TESTS = "['test', 'tests', 'spec', 'specs']"
_AUXILIARY = "['example', 'examples', 'benchmark', 'benchmarks', 'bench', 'benches', 'fixture', 'fixtures', 'mock', 'mocks', 'stub', 'stubs', 'demo', 'demos', 'sample', 'samples', 'docs', 'doc', 'e2e', 'testdata', 'perf', 'performance', 'scripts']"
_TOOLING = "['vitest', 'jest', 'storybook', 'husky', 'cypress', 'playwright', 'nyc', 'coverage']"
_ROLES = {"example": "['example', 'examples']", "benchmark": "['bench', 'benches', 'benchmark', 'benchmarks']", "fixture": "['fixture', 'fixtures', 'mock', 'mocks', 'stub', 'stubs']", "docs": "['docs', 'doc']"}


def _low(c: str) -> str:
    return f"lower(replace({c}, '\\', '/'))"


def _last(c: str) -> str:
    return f"string_split({_low(c)}, '/')[-1]"


def _has_words(text: str, words: str) -> str:
    return f"list_has_any(regexp_split_to_array({text}, '[-_./]'), {words})"


def _is_tooling(component: str) -> str:
    return f"(starts_with({component}, '.') AND list_contains({_TOOLING}, string_split({component}, '.')[2]))"


def test_path(c: str) -> str:
    marks = " OR ".join([*[f"contains({_low(c)}, '{d}')" for d in ("__tests__", "__test__", "__mocks__")], *[f"contains({_last(c)}, '{m}')" for m in (".test.", ".spec.", "_test.", ".tests.")]])
    return f"coalesce({marks} OR starts_with({_last(c)}, 'test_') OR {_has_words(_low(c), _TESTS)}, false)"


def auxiliary_path(c: str) -> str:
    return f"coalesce({_has_words(_low(c), _AUXILIARY)} OR len(list_filter(string_split({_low(c)}, '/'), lambda x: {_is_tooling('x')})) > 0, false)"


def config_path(c: str) -> str:
    names = "['tsconfig.json', 'jsconfig.json', 'package.json', 'package-lock.json', 'gruntfile.js', 'gulpfile.js', 'rollup.config.js', 'webpack.config.js', 'babel.config.js', 'postcss.config.js', 'tailwind.config.js', 'karma.conf.js']"
    return f"coalesce(starts_with({_last(c)}, '.') AND string_split({_last(c)}, '.')[-1] IN ('js', 'ts', 'json', 'yaml', 'yml', 'toml') OR contains({_last(c)}, '.config.') OR list_contains({names}, {_last(c)}), false)"


def outside_path(c: str) -> str:
    return f"({test_path(c)} OR {auxiliary_path(c)} OR {config_path(c)})"


def path_role(c: str) -> str:
    cases = " ".join(f"WHEN {_has_words('x', words)} THEN '{name}'" for name, words in _ROLES.items())
    first = f"list_filter(list_transform(string_split({_low(c)}, '/'), lambda x: CASE {cases} WHEN {_is_tooling('x')} THEN 'config' END), lambda r: r IS NOT NULL)[1]"
    return f"CASE WHEN {test_path(c)} THEN 'test' WHEN {config_path(c)} THEN 'config' WHEN {auxiliary_path(c)} THEN coalesce({first}, 'auxiliary') END"


_ORDER = "recorded_at DESC NULLS LAST, kind DESC, fqn DESC NULLS LAST, location DESC NULLS LAST, provenance DESC NULLS LAST, properties DESC NULLS LAST, trait_metadata DESC NULLS LAST"
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "gn": (
        (),
        f"""SELECT id, kind, fqn, split_part(fqn, '::', -1) AS name, nullif(json_extract_string(l, '$.file'), '') AS file,
  json_extract_string(l, '$.start_line')::INTEGER AS start_line, json_extract_string(l, '$.end_line')::INTEGER AS end_line, {sql_source('provenance')} AS source, {sql_confidence('provenance')} AS confidence,
  {sql_json('trait_metadata', 'trait_name')} IS NOT NULL AS is_trait_impl, {_text('path_repo_rel')}, {_text('role')}, {_text('visibility')}, lower({_text('language').removesuffix(' AS language')}) AS language,
  {_count('cyclomatic_complexity')}, {_count('cognitive_complexity')}, {_flag('is_test')}, {_flag('is_vendor')}, {_flag('is_build_output')}, {_flag('is_generated')}, {_flag('is_attribute_invoked')}, {_flag('is_callback_target')},
  coalesce(json_extract_string(p, '$.synthetic') = 'true', false) OR coalesce(split_part(fqn, '::', -1) IN ('__file_scope__', '__file_module__'), false) AS synthetic, recorded_at
FROM (SELECT *, try_cast(properties AS JSON) AS p, try_cast(location AS JSON) AS l, row_number() OVER (PARTITION BY id ORDER BY {_ORDER}) AS k
  FROM (SELECT {sql_id('id')} AS id, {sql_node_kind('kind')} AS kind, fqn, location, provenance, properties, trait_metadata, recorded_at FROM nodes) WHERE id IS NOT NULL AND kind IS NOT NULL) WHERE k = 1""",
    ),
    "ge": (
        ("gn",),
        f"""SELECT from_id, to_id, kind, source, confidence, recorded_at FROM (SELECT *, row_number() OVER (PARTITION BY from_id, to_id, kind ORDER BY recorded_at DESC NULLS LAST, source DESC, confidence DESC) AS k
  FROM (SELECT {sql_id('from_id')} AS from_id, {sql_id('to_id')} AS to_id, {sql_edge_kind('kind')} AS kind, {sql_source('provenance')} AS source, {sql_confidence('provenance')} AS confidence, recorded_at FROM edges)
  WHERE kind IS NOT NULL) WHERE k = 1 AND from_id IN (SELECT id FROM gn) AND to_id IN (SELECT id FROM gn)""",
    ),
    "struct": (("ge",), "SELECT * FROM ge WHERE kind <> 'Contains'"),
    "calls": (("ge",), "SELECT * FROM ge WHERE kind = 'Call'"),
    "par": (("ge",), "SELECT to_id AS node, arg_max(from_id, (recorded_at, from_id)) AS parent FROM ge WHERE kind = 'Contains' GROUP BY 1"),
    "above": (("par",), "SELECT node, parent AS anc, 1 AS d FROM par UNION SELECT a.node, par.parent, a.d + 1 FROM above a JOIN par ON a.anc = par.node WHERE a.d < 90"),
    "here": (("gn", "above"), "SELECT id AS node, id AS anc, 0 AS d FROM gn UNION ALL SELECT node, anc, min(d) FROM above WHERE node <> anc GROUP BY 1, 2"),
    "files": (
        ("gn",),
        "SELECT key, min(id) AS file_id FROM (SELECT id, unnest([file, path_repo_rel, fqn]) AS key FROM gn WHERE kind = 'File') WHERE key IS NOT NULL AND key <> '' GROUP BY 1",
    ),
    "paths": (
        ("gn", "files", "here"),
        """SELECT n.id, coalesce(nullif(n.path_repo_rel, ''), f.path_repo_rel, (SELECT arg_min(nullif(x.path_repo_rel, ''), h.d) FILTER (nullif(x.path_repo_rel, '') IS NOT NULL) FROM here h JOIN gn x ON h.anc = x.id WHERE h.node = n.id)) AS path
  FROM gn n LEFT JOIN files ON n.file = files.key LEFT JOIN gn f ON files.file_id = f.id""",
    ),
    "parts": (("paths",), "SELECT id, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM paths WHERE path IS NOT NULL"),
    "mods": (
        ("parts",),
        "SELECT id, CASE WHEN k = '' THEN '.' ELSE k END AS module FROM (SELECT id, array_to_string((CASE WHEN contains(p[-1], '.') THEN p[:-2] ELSE p END)[:2], '/') AS k FROM parts WHERE len(p) > 0)",
    ),
    "tells": (("gn",), "SELECT id, kind FROM gn WHERE path_repo_rel IS NOT NULL OR is_test OR role IS NOT NULL"),
    "cls": (
        ("gn", "files", "here", "tells"),
        """SELECT n.id, coalesce((SELECT file_id FROM files JOIN tells ON file_id = tells.id WHERE files.key = n.file),
    (SELECT arg_min(h.anc, h.d) FROM here h JOIN tells ON h.anc = tells.id WHERE h.node = n.id AND tells.kind IN ('File', 'Folder'))) AS class_id FROM gn n""",
    ),
    "outside": (
        ("gn", "cls"),
        f"""SELECT n.id, n.is_test OR {outside_path('n.path_repo_rel')} OR {outside_path('n.id')} OR coalesce(c.is_test OR c.is_vendor OR c.is_build_output OR c.is_generated OR {outside_path('c.path_repo_rel')}, false) AS is_non_production,
    coalesce(c.is_test, false) AS in_test_file, c.id AS class_id, CASE WHEN c.id IS NOT NULL THEN coalesce(c.path_repo_rel, c.file, '') END AS class_path, c.is_vendor AS class_vendor, c.is_build_output AS class_build, c.is_generated AS class_generated
  FROM gn n JOIN cls USING (id) LEFT JOIN gn c ON cls.class_id = c.id""",
    ),
    "fn": (("gn",), "SELECT * FROM gn WHERE kind = 'Function' AND NOT synthetic"),
    "prod_fn": (("fn", "outside"), "SELECT fn.* FROM fn JOIN outside USING (id) WHERE NOT is_non_production"),
    "clean": (("struct", "gn"), "SELECT * FROM struct WHERE from_id NOT IN (SELECT id FROM gn WHERE synthetic) AND to_id NOT IN (SELECT id FROM gn WHERE synthetic)"),
    "prod": (("clean", "outside"), "SELECT * FROM clean WHERE from_id NOT IN (SELECT id FROM outside WHERE is_non_production) AND to_id NOT IN (SELECT id FROM outside WHERE is_non_production)"),
    "fans": (
        ("gn", "struct"),
        "SELECT gn.id, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM gn LEFT JOIN (SELECT to_id, count(*) AS n FROM struct GROUP BY 1) i ON gn.id = i.to_id LEFT JOIN (SELECT from_id, count(*) AS n FROM struct GROUP BY 1) o ON gn.id = o.from_id",
    ),
    "medges": (("struct", "mods"), "SELECT e.*, a.module AS from_module, b.module AS to_module FROM struct e LEFT JOIN mods a ON e.from_id = a.id LEFT JOIN mods b ON e.to_id = b.id"),
    "clinks": (("prod",), f"SELECT DISTINCT from_id AS src, to_id AS dst FROM prod WHERE from_id <> to_id AND kind IN ({', '.join(repr(k) for k in CALL_LIKE)})"),
    "plinks": (("prod",), "SELECT DISTINCT from_id AS src, to_id AS dst FROM prod WHERE from_id <> to_id"),
    "core0": (("plinks",), "SELECT * FROM plinks"),
    "core1": (("core0",), "SELECT * FROM core0 WHERE src IN (SELECT dst FROM core0) AND dst IN (SELECT src FROM core0)"),
    "core2": (("core1",), "SELECT * FROM core1 WHERE src IN (SELECT dst FROM core1) AND dst IN (SELECT src FROM core1)"),
    "core3": (("core2",), "SELECT * FROM core2 WHERE src IN (SELECT dst FROM core2) AND dst IN (SELECT src FROM core2)"),
    "core4": (("core3",), "SELECT * FROM core3 WHERE src IN (SELECT dst FROM core3) AND dst IN (SELECT src FROM core3)"),
    "core5": (("core4",), "SELECT * FROM core4 WHERE src IN (SELECT dst FROM core4) AND dst IN (SELECT src FROM core4)"),
    "core6": (("core5",), "SELECT * FROM core5 WHERE src IN (SELECT dst FROM core5) AND dst IN (SELECT src FROM core5)"),
    "preach": (("core6",), "SELECT src, dst FROM core6 UNION SELECT r.src, l.dst FROM preach r JOIN core6 l ON r.dst = l.src"),
    "scc": (
        ("preach",),
        "SELECT a.src AS node, least(a.src, min(a.dst)) AS component FROM preach a JOIN preach b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY 1",
    ),
}


_LOC = "CASE WHEN end_line >= start_line THEN end_line - start_line + 1 ELSE 0 END"
_CALLS = "('Call', 'Framework:VisualforcePage', 'Declarative:Flow')"


def _limit(v: str, percentile: int, floor: int) -> str:
    return f"greatest(coalesce((list_sort(list({v})))[greatest(ceil(count(*) * {percentile} / 100) - 1, 0)::BIGINT + 1], {floor}), {floor})"


def _coupled(name: str, edges: str) -> dict:
    sides = " UNION ALL ".join(f"SELECT {m} AS module, {i} AS i, {1 - i} AS x FROM {edges} WHERE {test}" for m, i, test in (("from_module", 1, "from_module = to_module"), ("from_module", 0, "from_module IS DISTINCT FROM to_module"), ("to_module", 0, "from_module IS DISTINCT FROM to_module")))
    return {name: ((edges, "mods"), f"SELECT module, m.members, internal_edges, external_edges, external_edges / (internal_edges + external_edges) AS score FROM (SELECT module, count(*) AS members FROM mods GROUP BY 1 HAVING count(*) >= 3) m JOIN (SELECT module, sum(i)::BIGINT AS internal_edges, sum(x)::BIGINT AS external_edges FROM ({sides}) WHERE module IS NOT NULL GROUP BY 1) USING (module)")}


def _hot(name: str, fans: str) -> dict:
    return {name: ((fans, "fn"), f"SELECT id, fan_in, t.threshold FROM {fans} JOIN fn USING (id), (SELECT CASE WHEN count(*) < 20 THEN 8 ELSE (list_sort(list(fan_in)))[least(ceil(count(*) * 95 / 100), count(*) - 1)::BIGINT + 1] END AS threshold FROM {fans} JOIN fn USING (id)) t WHERE fan_in >= t.threshold AND t.threshold > 0")}


TABLES |= {
    "dag": (("clinks", "scc"), "SELECT src, dst FROM clinks WHERE NOT (src IN (SELECT node FROM scc) AND dst IN (SELECT node FROM scc))"),
    "dn": (("dag",), "SELECT src AS node FROM dag UNION SELECT dst FROM dag"),
    "dw": (("dag", "dn"), "SELECT node, 0 AS depth FROM dn WHERE node NOT IN (SELECT dst FROM dag) UNION SELECT dag.dst, dw.depth + 1 FROM dw JOIN dag ON dw.node = dag.src"),
    "depths": (("dw",), "SELECT node, max(depth) AS depth FROM dw GROUP BY 1"),
    "viol": (
        ("scc", "clean", "fans", "fn", "depths"),
        f"""SELECT from_id, to_id, a.depth AS from_depth, b.depth AS to_depth, b.depth - a.depth AS gap FROM (SELECT DISTINCT from_id, to_id FROM clean WHERE kind IN {_CALLS}) e
JOIN depths a ON a.node = from_id JOIN depths b ON b.node = to_id JOIN fans ON fans.id = to_id
WHERE b.depth - a.depth >= 2 AND from_id NOT IN (SELECT node FROM scc) AND to_id NOT IN (SELECT node FROM scc)
AND (to_id NOT IN (SELECT id FROM fn) OR fan_in <= (SELECT (list_sort(list(fan_in)))[least(count(*) * 95 // 100, count(*) - 1) + 1] FROM fans JOIN fn USING (id) WHERE fan_in > 0))""",
    ),
    "br": (("plinks", "fn"), "SELECT id AS seed, id AS node FROM fn UNION SELECT br.seed, src FROM br JOIN plinks ON dst = br.node"),
    "blasts": (("br",), "SELECT seed AS id, count(*) - 1 AS blast FROM br GROUP BY 1"),
    "cyc": (
        ("scc", "prod"),
        """SELECT row_number() OVER (ORDER BY size DESC, component) AS cycle, component, size, edges FROM (SELECT component, count(*) AS size FROM scc GROUP BY 1)
JOIN (SELECT a.component, count(*) AS edges FROM prod JOIN scc a ON from_id = a.node JOIN scc b ON to_id = b.node WHERE a.component = b.component GROUP BY 1) USING (component)""",
    ),
    **_coupled("coupled", "medges"),
    **_hot("hotspots", "fans"),
    "unstable": (
        ("medges", "mods"),
        """SELECT module, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) > 0 THEN coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)) ELSE 0 END AS instability
 FROM (SELECT DISTINCT module FROM mods) LEFT JOIN (SELECT to_module AS module, count(DISTINCT from_module) AS ca FROM medges WHERE from_module <> to_module GROUP BY 1) USING (module)
 LEFT JOIN (SELECT from_module AS module, count(DISTINCT to_module) AS ce FROM medges WHERE from_module <> to_module GROUP BY 1) USING (module)""",
    ),
    "abstract": (
        ("mods", "gn"),
        """SELECT module, abstract_types, types, CASE WHEN types > 0 THEN abstract_types / types ELSE 0 END AS abstractness
 FROM (SELECT module, count(*) FILTER (kind = 'Interface') AS abstract_types, count(*) FILTER (kind IN ('Interface', 'Struct', 'Enum', 'Type')) AS types FROM mods JOIN gn USING (id) GROUP BY 1)""",
    ),
    "zones": (
        ("unstable", "abstract"),
        """SELECT module, instability, abstractness, d AS distance, CASE WHEN d < 0.15 THEN 'main_sequence' WHEN abstractness < 0.3 AND instability < 0.3 THEN 'pain' WHEN abstractness > 0.7 AND instability > 0.7 THEN 'uselessness' ELSE 'balanced' END AS zone
FROM (SELECT *, abs(abstractness + instability - 1) AS d FROM unstable JOIN abstract USING (module))""",
    ),
    "bridged": (
        ("medges", "fn"),
        """SELECT fn.id, coalesce(n, 0) AS bridges FROM fn LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT to_id AS id, '<' || from_module AS m FROM medges WHERE from_module <> to_module UNION SELECT from_id, '>' || to_module FROM medges WHERE from_module <> to_module) GROUP BY 1) b ON b.id = fn.id""",
    ),
    "flows": (("fans", "fn"), "SELECT id, (fan_in * fan_out) * (fan_in * fan_out) AS v FROM fans JOIN fn USING (id)"),
    "fnd": (
        ("cyc", "coupled", "hotspots", "blasts", "prod_fn", "flows", "bridged", "zones", "viol", "ge"),
        f"""SELECT *, CASE WHEN type IN ('HighCoupling', 'BlastRadiusHotspot', 'InformationFlowBottleneck', 'HubNode') THEN (SELECT CASE WHEN count(*) FILTER (kind = 'Import') = 0 THEN 'Low' WHEN count(*) FILTER (source = 'Lsp') > 0 THEN 'High' ELSE 'Medium' END FROM ge) END AS confidence FROM (
SELECT 'CircularDependency' AS type, 'cycle-' || cycle AS id, CASE WHEN size >= 4 THEN 'Critical' WHEN size >= 3 THEN 'High' ELSE 'Warning' END AS severity, component AS primary_node, size::DOUBLE AS value, NULL AS callee FROM cyc
UNION ALL SELECT 'HighCoupling', 'coupling-' || module, CASE WHEN score > 0.85 THEN 'Critical' WHEN score > 0.7 THEN 'High' WHEN score > 0.5 THEN 'Warning' ELSE 'Info' END, module, score, NULL FROM coupled WHERE score > 0.3 AND NOT {outside_path('module')}
UNION ALL SELECT 'BlastRadiusHotspot', 'hotspot-' || row_number() OVER (ORDER BY fan_in DESC, id), CASE WHEN coalesce(blast, 0) > 0 AND fan_in > 0 THEN 'High' ELSE 'Warning' END, id, fan_in, NULL FROM hotspots LEFT JOIN blasts USING (id) WHERE id IN (SELECT id FROM prod_fn)
UNION ALL SELECT 'ExcessiveComplexity', 'complexity-' || row_number() OVER (ORDER BY id), CASE WHEN c > 25 OR g > 30 THEN 'Critical' WHEN c > 15 OR g > 20 THEN 'High' ELSE 'Warning' END, id, c, NULL FROM (SELECT id, cyclomatic_complexity AS c, coalesce(cognitive_complexity, 0) AS g FROM prod_fn WHERE cyclomatic_complexity IS NOT NULL) WHERE c > 10 OR g > 12
UNION ALL SELECT 'InformationFlowBottleneck', 'ifc-' || row_number() OVER (ORDER BY v DESC, id), CASE WHEN v > c THEN 'Critical' WHEN v > b THEN 'High' ELSE 'Warning' END, id, v, NULL FROM flows, (SELECT {_limit('v', 95, 100)} AS a, {_limit('v', 97, 200)} AS b, {_limit('v', 99, 400)} AS c FROM flows) WHERE v > a AND id IN (SELECT id FROM prod_fn)
UNION ALL SELECT 'HubNode', 'hub-' || row_number() OVER (ORDER BY bridges DESC, id), CASE WHEN bridges > b THEN 'High' ELSE 'Warning' END, id, bridges, NULL FROM bridged, (SELECT {_limit('bridges', 95, 4)} AS a, {_limit('bridges', 99, 6)} AS b FROM bridged) WHERE bridges > a AND id IN (SELECT id FROM prod_fn)
UNION ALL SELECT CASE zone WHEN 'pain' THEN 'ZoneOfPain' ELSE 'ZoneOfUselessness' END, 'zone-' || row_number() OVER (ORDER BY module), CASE WHEN distance > 0.7 AND zone = 'pain' THEN 'High' WHEN distance > 0.5 THEN 'Warning' ELSE 'Info' END, module, distance, NULL FROM zones WHERE zone IN ('pain', 'uselessness') AND distance >= 0.3 AND NOT {outside_path('module')}
UNION ALL SELECT 'LayerViolation', 'layer-' || row_number() OVER (ORDER BY gap DESC, from_id, to_id), CASE WHEN gap >= 4 THEN 'Critical' WHEN gap >= 3 THEN 'High' ELSE 'Warning' END, from_id, gap, to_id FROM viol)""",
    ),
    "named": (
        ("fnd", "scc"),
        "SELECT type, id, severity, primary_node AS node FROM fnd WHERE type <> 'CircularDependency' UNION ALL SELECT type, id, severity, callee FROM fnd WHERE callee IS NOT NULL UNION ALL SELECT type, id, severity, node FROM fnd JOIN scc ON component = primary_node WHERE type = 'CircularDependency'",
    ),
    "modrisk": (("mods", "named"), "SELECT module, coalesce(['Info', 'Warning', 'High', 'Critical'][r], 'Healthy') AS risk FROM (SELECT DISTINCT module FROM mods) LEFT JOIN (SELECT node AS module, max(CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Warning' THEN 2 ELSE 1 END) AS r FROM named GROUP BY 1) USING (module)"),
    "cohere": (
        ("struct", "fn", "mods"),
        "SELECT module, id FROM mods JOIN fn USING (id) WHERE module IN (SELECT module FROM mods JOIN fn USING (id) GROUP BY 1 HAVING count(*) >= 3)",
    ),
    "tied": (
        ("cohere", "struct"),
        """SELECT c.module, id AS f, '>' || to_id AS o FROM cohere c JOIN struct ON from_id = id UNION SELECT c.module, id, '<' || from_id FROM cohere c JOIN struct ON to_id = id
UNION SELECT a.module, a.id, '=' || b.id FROM cohere a JOIN struct ON from_id = a.id JOIN cohere b ON to_id = b.id AND a.module = b.module UNION SELECT module, id, '=' || id FROM cohere""",
    ),
    "together": (("tied",), "SELECT module, f AS start, f AS node FROM tied UNION SELECT t.module, t.start, y.f FROM together t JOIN tied x ON t.module = x.module AND t.node = x.f JOIN tied y ON x.module = y.module AND x.o = y.o"),
    "lcom": (
        ("together",),
        "SELECT module, count(*) AS functions, count(DISTINCT low) AS components, 1 / count(DISTINCT low) AS cohesion FROM (SELECT module, start, min(node) AS low FROM together GROUP BY 1, 2) GROUP BY 1",
    ),
    "holder": (("gn", "here"), "SELECT h.node AS id, arg_min(h.anc, h.d) AS file FROM here h JOIN gn x ON h.anc = x.id WHERE x.kind = 'File' GROUP BY 1"),
    "blocked": (("paths",), f"SELECT id AS file FROM paths WHERE path <> '' AND NOT {outside_path('path')}"),
    "imports": (("ge", "holder", "blocked"), "SELECT DISTINCT a.file AS importer, b.file FROM ge JOIN holder a ON from_id = a.id JOIN holder b ON to_id = b.id WHERE kind = 'Import' AND a.file <> b.file AND b.file NOT IN (SELECT file FROM blocked)"),
    "marked0": (("gn", "holder"), "SELECT id AS file FROM gn WHERE kind = 'File' AND is_test UNION SELECT holder.file FROM gn JOIN holder USING (id) WHERE kind = 'Function' GROUP BY 1 HAVING bool_and(is_test)"),
    **{f"marked{k + 1}": ((f"marked{k}", "imports"), f"SELECT file FROM marked{k} UNION SELECT file FROM imports GROUP BY 1 HAVING bool_and(importer IN (SELECT file FROM marked{k}))") for k in range(8)},
    "hprod": (("prod",), "SELECT * FROM prod WHERE confidence = 'High'"),
    "hmedges": (("medges",), "SELECT * FROM medges WHERE confidence = 'High'"),
    "hfans": (
        ("gn", "struct"),
        "SELECT gn.id, coalesce(n, 0) AS fan_in FROM gn LEFT JOIN (SELECT to_id, count(*) AS n FROM struct WHERE confidence = 'High' GROUP BY 1) i ON gn.id = i.to_id",
    ),
    **_coupled("hcoupled", "hmedges"),
    **_hot("hhotspots", "hfans"),
}
_OVER_SURE = ("plinks", "clinks", *(f"core{k}" for k in range(7)), "preach", "scc", "dag", "dn", "dw", "depths")
_SURE = re.compile(rf"\b({'|'.join(('prod', *_OVER_SURE))})\b")
TABLES |= {"h" + n: (tuple("h" + x for x in TABLES[n][0]), _SURE.sub(r"h\1", TABLES[n][1])) for n in _OVER_SURE}
_RECURSIVE = ("above", "preach", "hpreach", "dw", "hdw", "br", "together")


def graph(names: str, body: str) -> str:
    needed: list[str] = []

    def need(name: str) -> None:
        for other in TABLES[name][0]:
            need(other)
        if name not in needed:
            needed.append(name)

    for name in names.split():
        need(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'' if n in _RECURSIVE else 'MATERIALIZED '}({TABLES[n][1]})" for n in needed) + "\n" + body
