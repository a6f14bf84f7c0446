"""Report, overrides, templates, sources and sinks by hand."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fathomgraph.functions import paths as P
from fathomgraph.operators import dead_code as D
from fathomgraph.operators import incremental as U
from fathomgraph.operators import overrides as V
from fathomgraph.operators import quality as Y
from fathomgraph.operators import report as R
from fathomgraph.operators import resolution as X
from fathomgraph.operators import template as T
from fathomgraph.operators.skew import numbered
from fathomgraph.sources import history as H
from fathomgraph.sources import sinks as K
from fathomgraph.sources import tables as B
from fathomgraph.streaming.progress import parsed


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def at(day):
    return datetime(2024, 1, day)


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(f"n{i}", i % 3) for i in range(50)], "id string, v int")
    got = {r.id: r.k for r in numbered(df, [-F.col("v"), F.col("id")], "k").collect()}
    assert got == {i: k + 1 for k, i in enumerate(sorted(got, key=lambda i: (-(int(i[1:]) % 3), i)))}
    assert numbered(df.limit(0), [F.col("id")], "k").count() == 0


def test_cycles_and_what_they_name(spark):
    strong = spark.createDataFrame([("a", "a"), ("b", "a"), ("x", "x"), ("y", "x"), ("z", "x")], "node string, component string")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("a", "x"), ("x", "y"), ("y", "z"), ("z", "x")], "from_id string, to_id string")
    found = R.cycles(strong, edges)
    assert rows(found) == [(1, "x", 3, 3), (2, "a", 2, 3)]
    findings = R.cycle_findings(found)
    assert rows(findings.select("id", "severity", "value")) == [("cycle-1", "High", 3.0), ("cycle-2", "Warning", 2.0)]
    layers = R.layer_findings(spark.createDataFrame([("a", "q", 4), ("b", "q", 2)], "from_id string, to_id string, gap int"))
    both = findings.unionByName(layers.drop("callee"))
    named = R.finding_nodes(both, layers, found, strong)
    assert {r.node for r in named.filter("id = 'cycle-1'").collect()} == {"x", "y", "z"} and {r.node for r in named.filter("id = 'layer-1'").collect()} == {"a", "q"}
    assert ("q", "Critical") not in rows(R.node_risks(named)) and dict(rows(R.node_risks(named)))["a"] == "High"


def test_worsening_modules_touch_what_begins_with_them(spark):
    named = spark.createDataFrame([("T", "f1", "High", "src/a"), ("T", "f2", "Info", "src/ab/c"), ("T", "f3", "Info", "other")], "type string, id string, severity string, node string")
    modules = spark.createDataFrame([("n", "src/a"), ("m", "lib"), ("o", "other")], "id string, module string")
    risks = R.module_risks(modules, named)
    assert rows(risks) == [("lib", "Healthy"), ("other", "Info"), ("src/a", "High")]
    worse = R.worsening_modules(risks, spark.createDataFrame([("m",)], "from_id string"), modules)
    assert rows(worse) == [("lib",), ("src/a",)] and rows(R.touched(named, worse)) == [("f1",), ("f2",)]


def test_gaps_and_deltas(spark):
    m = "metric string, value double"
    got = {r.metric: (r.absolute_gap, r.relative_gap) for r in R.fidelity(spark.createDataFrame([("a", 2.0), ("b", 0.0), ("c", 1.0)], m), spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 9.0)], m)).collect()}
    assert got == {"a": (1.0, 0.5), "b": (-1.0, None), "c": (-8.0, -1.0)}
    t = "module string, score double, violations int, in_cycle boolean"
    before, after = spark.createDataFrame([("a", 0.5, 1, False), ("b", 0.5, 1, True), ("c", 0.1, 0, False)], t), spark.createDataFrame([("a", 0.52, 1, True), ("b", 0.5, 1, True), ("c", 0.2, 0, False), ("d", None, 1, None)], t)
    assert [r[0] for r in rows(R.module_deltas(before, after))] == ["a", "c", "d"]
    labels = spark.createDataFrame([(0, 8), (2, 8), (4, 8), (8, 8), (0, 0)], "d int, m int").select(R.layer_label(F.col("d"), F.col("m")))
    assert [r[0] for r in labels.collect()] == ["entry", "controller", "service", "infrastructure", "entry"]


NODE = "id string, kind string, fqn string, file string, path_repo_rel string, is_test boolean, is_vendor boolean, is_generated boolean"


def test_overrides(spark, tmp_path):
    o = V.Overrides.parse('{"file_overrides": [{"path": "a.rs", "classification": "test"}, {"path": "b.rs", "classification": "vendor"}, {"path": "c.rs", "classification": "odd"}], "entry_point_overrides": [{"function_id": " F1", "action": "mark_as_entry_point"}, {"function_id": "f2", "action": "confirm_dead"}], "finding_triage": [{"finding_id": "x", "action": "wont_fix"}], "new_field": 1}')
    nodes = spark.createDataFrame([("1", "File", "q", "f.rs", "a.rs", False, True, True), ("2", "File", "b.rs", None, None, True, False, False), ("3", "Function", "a.rs", None, "a.rs", False, False, False), ("4", "File", "c.rs", None, None, False, False, False)], NODE)
    assert rows(V.with_file_overrides(nodes, o).select("id", "is_test", "is_vendor", "is_generated")) == [("1", True, False, False), ("2", True, True, False), ("3", False, False, False), ("4", False, False, False)]
    assert rows(V.without_exempt(spark.createDataFrame([("f1",), ("f2",)], "id string"), o)) == [("f2",)]
    path = str(tmp_path / "o.json")
    o.triaged("y", "acknowledged").save(path)
    again = V.Overrides.load(path)
    assert again.files == o.files and rows(V.suppressed(spark, again)) == [("x",)] and V.Overrides.load(path + "no") == V.Overrides()


def test_templates(spark):
    nodes = spark.createDataFrame([(x, "Function", f"m::{x}", None, f"Src/{x}", False, False, False) for x in "abc"], NODE).withColumn("role", F.lit(None).cast("string"))
    edges = spark.createDataFrame([("a", "b", "Call"), ("b", "c", "Call")], "from_id string, to_id string, kind string")
    dump = T.Template.parse("[graph]\nnode_filter = \"path_repo_rel starts_with 'src/_'\"\ndepth = 9")
    assert len(dump.warnings) == 2 and {r.id for r in T.run_template(nodes, edges, dump)[0].collect()} == {"a", "b", "c"}
    walk = '[graph]\nmode = "traversal"\ndepth = 1\n[[graph.seed.roots]]\nby_id = "{}"'
    met, inside = T.run_template(nodes, edges, T.Template.parse(walk.format("a")))
    assert {r.id for r in met.collect()} == {"a", "b"} and inside.count() == 1
    with pytest.raises(T.TooLarge):
        T.run_template(nodes, edges, dump, max_nodes=2)
    for bad in (walk.format("nobody"), "[graph]\nmode = 'x'", "x = 1", "[graph]\nmode = 'traversal'", "[graph]\ndirection = 'up'"):
        with pytest.raises(T.TemplateError):
            T.run_template(nodes, edges, T.Template.parse(bad))


def test_life_of_a_scan(spark, tmp_path):
    log, series = str(tmp_path / "runs"), str(tmp_path / "metrics")
    one, two = K.begin_scan(spark, log, "p", at(1)), K.begin_scan(spark, log, "p", at(2))
    K.end_scan(spark, log, one, at(3), language="rust")
    K.end_scan(spark, log, two, at(4), "failed", error="oops")
    got = {r.id: r for r in K.scans(spark, log).collect()}
    assert (got[one].status, got[one].project_id, got[one].started_at, got[one].completed_at, got[one].primary_language) == ("completed", "p", at(1), at(3), "rust")
    assert (got[two].status, got[two].error) == ("failed", "oops")
    with pytest.raises(ValueError):
        K.end_scan(spark, log, one, at(5), "odd")
    metrics = spark.createDataFrame([("dead_ratio", 0.5), ("max_depth", 7.0), ("avg_cohesion", 1.0)], "metric string, value double")
    K.append_metrics(metrics, one, series)
    assert spark.read.parquet(series).count() == 3
    K.population_row(metrics, "p1", "2024-01-01T00:00:00Z", "rust").write.parquet(str(tmp_path / "pop"))
    row = K.load_population(spark, str(tmp_path / "pop")).first()
    assert (row.dead_ratio, row.max_depth, row.avg_cohesion, row.cycle_ratio) == (0.5, 7, 1.0, None)
    spark.createDataFrame([("old", 0.1)], "id string, dead_ratio double").write.parquet(str(tmp_path / "old"))
    assert K.load_population(spark, str(tmp_path / "old")).first().avg_distance is None


def test_other_sinks_and_sources(spark, tmp_path):
    K.write_health_report({"findings": spark.range(3), "score": spark.range(1)}, str(tmp_path / "r"))
    assert K.read_health_report(spark, str(tmp_path / "r"), {"findings": "id bigint"})["findings"].count() == 3
    nodes = spark.createDataFrame([("Project", '{"a": "1", "language": "go"}'), ("Project", "broken"), ("File", "{}")], "kind string, properties string")
    assert [json.loads(r.properties).get("language") for r in K.with_project_language(nodes, "rust").collect()] == ["rust", "rust", None]
    K.emit(spark.createDataFrame([(1, at(1), 2, "start", 1.0)], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"), str(tmp_path / "e"))
    assert parsed(spark.read.text(str(tmp_path / "e"))).first().event.event_type == "start"
    with pytest.raises(ValueError):
        K.report_json(spark.range(5), 4)
    with pytest.raises(B.MissingTable):
        B.table(spark, str(tmp_path), "nodes")
    meta = spark.createDataFrame([("k", "1"), ("k", "2")], "key string, value string")
    assert (B.metadata_value(meta, "k"), B.metadata_value(meta, "x")) == ("2", None)
    payload = spark.createDataFrame([("a", "rust", '{"gaps":[{"kind":"macro","line":1}]}'), ("b", None, "broken"), ("c", None, None)], "file_path string, language string, payload_json string")
    assert rows(B.extraction_coverage(payload)) == [("a", "rust", ["macro"]), ("b", None, []), ("c", None, [])]
    for f in ("ok/.git/HEAD", "thin/.git/shallow", "bare/HEAD", "bare/objects/x", "bare/refs/x", "none/x", "src/a.rs", "src/node_modules/b.rs"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("x")
    assert [H.repo_shape(str(tmp_path / d)) for d in ("ok", "thin", "bare", "none")] == ["full", "shallow", "bare", "none"]
    assert H.source_files(spark, str(tmp_path / "src")).count() == 1
    commits = spark.createDataFrame([("src/a.rs",), ("tests/a.rs",), ("docs/a.rs",), ("a.md",)], "file string")
    assert rows(H.source_commits(commits)) == [("src/a.rs",)]


def test_kinds_of_files_and_modules(spark):
    files = spark.createDataFrame([("1", "t/a.py", ["pytest"]), ("2", "t/helper.py", ["a"]), ("3", "t/b_test.py", []), ("4", "src/c_test.py", []), ("5", "src/d.py", [])], "id string, path string, imports array<string>")
    one = files.filter(Y.imports_test_framework(F.col("imports"), F.lit("Python"))).select("id")
    assert rows(Y.classified_files(files, one, files.filter("id = '2'").select("id"))) == [("1", 1), ("2", 2), ("3", 4), ("4", 0), ("5", 0)]
    members = spark.createDataFrame([("src/a", True), ("src/a", True), ("src/b", False), ("tests", False), ("keep/tests", True)], "module string, is_test boolean")
    assert rows(Y.module_kinds(members, ("keep",))) == [("keep/tests", "production", "override"), ("src/a", "non_production", "tests"), ("src/b", "production", "default"), ("tests", "non_production", "path")]
    langs = spark.createDataFrame([("rust",)] * 3 + [("go",)] * 2 + [(None,)], "language string")
    assert rows(Y.majority_language(langs)) == [("rust", 3, 0.6, True)] and Y.majority_language(langs.limit(0)).count() == 0


def test_framework_reasons(spark):
    cases = [("x/tasks.py", "python", "f", []), ("x/views.py", "python", "f", []), ("jest.setup.ts", "typescript", "f", []), ("x/views.py", "go", "f", []), ("x/views/y.py", "python", "f", ["plain", "django"]), (None, None, "f", [])]
    df = spark.createDataFrame(cases, "class_path string, language string, name string, frameworks array<string>")
    assert [r[0] for r in df.select(D.framework_reason()).collect()] == ["framework_annotation_unresolved", "declarative_wiring_unparsed", "framework_annotation_unresolved", None, "declarative_wiring_unparsed", None]
    assert [r[0] for r in spark.createDataFrame([("a/celery_app.py", "Python"), ("vitest.config.mjs", None), (None, None)], "p string, l string").select(P.frameworks_of("p", "l")).collect()] == [["celery"], ["vitest"], ["plain"]]


def test_caches_and_dirty_files(spark):
    cache = spark.createDataFrame([("a", "rust"), ("b", "rust"), ("b", "go"), ("c", None)], "file string, language string")
    assert rows(U.prune_missing(cache, spark.createDataFrame([("a",)], "file string"), "rust")) == [("a", "rust"), ("b", "go"), ("c", None)]
    p = lambda *names: spark.createDataFrame([(n,) for n in names], "path string")
    assert rows(U.dirty_paths(p("a"), p("a", "b"), p(), spark.createDataFrame([("c", at(5)), ("d", at(1))], "path string, modified_at timestamp_ntz"), at(3))) == [("a",), ("b",), ("c",)]


def test_fallbacks_for_types_and_variables(spark):
    types = spark.createDataFrame([("t1", "A", "x"), ("t2", "B", "x"), ("t3", "B", "y"), ("t4", "C", "x"), ("t5", "C", "x")], "symbol string, name string, file string")
    uses = spark.createDataFrame([("u", "A", "z", "Extends"), ("u", "B", "y", "field"), ("u", "B", "z", "field"), ("u", "C", "x", "field"), ("t1", "A", "x", "field")], "user string, name string, file string, how string")
    assert rows(X.fallback_types(uses, types)) == [("u", "t1", "Extends", "Medium"), ("u", "t3", "Uses", "Medium")]
    assert rows(X.fallback_variables(uses.drop("how"), types)) == [("u", "t1", "Uses", "Low"), ("u", "t3", "Uses", "Low")]
    calls = spark.createDataFrame([("c", "m::f", False), ("c", "f", False), ("d", "f", True), ("c", "g", False)], "caller string, name string, is_method boolean")
    functions = spark.createDataFrame([("s1", "m::f"), ("s2", "n::f"), ("s3", "g")], "symbol string, fqn string")
    assert rows(X.ambiguous_drops(calls, functions)) == [("c", "f", 2)]
