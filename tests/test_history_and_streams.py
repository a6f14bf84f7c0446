"""Commit signals, findings, incremental plans, sources and streams on small fixtures."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fathomgraph.operators import findings as N
from fathomgraph.operators import report as R
from fathomgraph.operators import git_signals as G
from fathomgraph.operators import history as H
from fathomgraph.operators import incremental as U
from fathomgraph.operators.metrics import Thresholds
from fathomgraph.sources.history import git_log, json_lines, source_files
from fathomgraph.sources.python_code import complexity, items, python_items
from fathomgraph.sources.sinks import write_report, write_segments
from fathomgraph.streaming import progress as Q


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def commits(spark):
    data = [("c1", "ann", 1, "a"), ("c1", "ann", 1, "b"), ("c1", "ann", 1, "b"), ("c2", "bob", 2, "a"), ("c2", "bob", 2, "b"), ("c3", "ann", 3, "a"), ("c3", "ann", 3, "b"), ("c4", "cid", 4, "a"), ("c5", "cid", 5, None)]
    data += [("big", "ann", 6, f"f{i:03d}") for i in range(60)]
    return spark.createDataFrame([(c, a, datetime(2024, 1, d), f) for c, a, d, f in data], "commit string, author string, committed_at timestamp_ntz, file string")


def test_git_signals(spark, commits):
    assert rows(G.co_changes(commits)) == [("a", "b", 3)]
    assert [tuple(r) for r in G.temporal_coupling(commits).collect()] == [("a", "b", 3, 0.75, True)]
    linked = spark.createDataFrame([("a", "b")], "file_a string, file_b string")
    assert not G.temporal_coupling(commits, linked).first().hidden
    assert G.temporal_coupling(commits, None, Thresholds(temporal_min_score=0.8)).count() == 0
    a = G.churn(commits, "2024-02-05").filter("file = 'a'").first()
    assert (a.changes, a.authors, a.last_touched_days, round(a.dispersion, 3), a.high_churn, a.shared_ownership, a.active_recent) == (4, 3, 32, 0.625, False, True, False)
    assert rows(G.clusters(commits)) == [(["a", "b"], 3)]
    assert G.history_window(commits, (1, 6), "2024-05-01", enough=3).select("commit").distinct().count() == 6
    assert [r.commit for r in G.newest_commits(commits.filter("file is not null"), 2).select("commit").distinct().orderBy("commit").collect()] == ["big", "c4"]
    empty = commits.limit(0)
    assert G.co_changes(empty).count() == G.churn(empty, "2024-01-01").count() == G.clusters(empty).count() == 0


def test_findings(spark):
    f = spark.createDataFrame([("T", f"t{i:02d}", "High" if i == 7 else "Info", ["n1", "n1"]) for i in range(12)] + [("U", "u", "Critical", ["n2"]), ("U", "v", "Warning", ["n3", "n2"])], "type string, id string, severity string, node_ids array<string>")
    top = N.capped(f, 3).filter("type = 'T'").collect()
    assert [(r.id, r.overflow) for r in top] == [("t07", 0), ("t00", 0), ("t01", 0), ("T-overflow", 9)]
    assert rows(N.node_risk(f)) == [("n1", "Warning"), ("n2", "High"), ("n3", "Warning")]
    before, after = f.filter("id = 'u'"), f.filter("id = 'v'").unionByName(f.filter("id = 'u'").withColumn("severity", F.lit("Info")))
    assert rows(N.finding_changes(after, before)) == [("U:n2", "worsened"), ("U:n2|n3", "resolved")]
    p = spark.createDataFrame([("a", "High", 7, True, "High", False), ("b", "Critical", 0, False, "Low", True)], "id string, severity string, blast int, temporal boolean, confidence string, worsening boolean")
    assert [(r.place, r.id, round(r.score, 3)) for r in N.priorities(p).collect()] == [(1, "a", 18.0), (2, "b", 2.08)]


def test_percentile_ranks_and_scores(spark):
    pop = spark.createDataFrame([("r", 1.0), ("r", 2.0), ("r", 2.0), ("r", 4.0), ("r", float("nan")), ("g", None)], "language string, m double")
    probes = spark.createDataFrame([("p", "r", 2.0), ("q", "r", 3.0), ("s", "g", 1.0)], "probe string, language string, m double")
    assert rows(N.population_scores(pop, probes, ("m",))) == [("p", "r", "m", 50.0), ("q", "r", "m", 25.0), ("s", "g", "m", 50.0)]
    whole = pop.filter("language = 'r'").agg(N.percentile_rank(pop, "m", F.lit(2.0)).alias("x")).first().x
    assert whole == 50.0
    values = [("cycle_ratio", 0.1), ("avg_coupling", 0.35), ("hotspot_concentration", 0.25), ("dead_ratio", 0.0), ("max_depth", 15.0), ("avg_cyclomatic", 30.0), ("avg_cohesion", 0.5), ("avg_distance", 0.2), ("hidden_ratio", 0.0)]
    metrics = spark.createDataFrame(values, "metric string, value double")
    got = {r.part: r.score for r in R.score_parts(metrics).collect()}
    assert got == {"cycle_severity": 50, "coupling_health": 100, "hotspot_concentration": 75, "dead_code_ratio": 100, "depth_complexity": 50, "complexity": 0, "cohesion": 50, "distance": 80, "temporal_coupling": 100}
    assert R.health_score(R.score_parts(metrics)).first().score == round(sum(got[k] * w for k, w in N.WEIGHTS.items()))
    assert R.health_score(R.score_parts(metrics, False)).first().score == round(sum(got[k] * w for k, w in N.WEIGHTS.items() if k != "temporal_coupling") / 0.95)


def test_history(spark):
    runs = spark.createDataFrame([("p", "r1", datetime(2024, 1, 1), "completed"), ("p", "r2", datetime(2024, 1, 2), "failed"), ("p", "r3", datetime(2024, 1, 1), "Completed")], "project_id string, id string, started_at timestamp_ntz, status string")
    assert [r.id for r in H.latest_completed(runs).collect()] == ["r3"]
    m = spark.createDataFrame([("p", 1, 5.0), ("p", 2, 5.0), ("p", 3, 4.0), ("p", 4, 9.0)], "p string, k int, v double")
    assert [r.v_trend for r in H.run_deltas(m, "p", ["k"], ["v"]).orderBy("k").collect()] == [None, "Stable", "Improved", "Worsened"]
    start = lambda e: spark.range(1).select(H.window_start(e, F.expr("timestamp_ntz'2024-03-31'"))).first()[0]
    assert [start(e) for e in ("30d", "1w", "1m", "1y")] == [datetime(2024, 3, 1), datetime(2024, 3, 24), datetime(2024, 2, 29), datetime(2023, 3, 31)]
    with pytest.raises(ValueError):
        H.window_start("soon", F.lit(None))


def test_incremental(spark):
    f = lambda data: spark.createDataFrame(data, "path string, hash string, language string")
    assert rows(U.plan(f([("a", "1", "x"), ("b", "1", "x"), ("c", "1", None), ("d", "1", "x")]), f([("a", "1", "x"), ("b", "2", "x"), ("c", "1", None), ("e", "1", "x")]))) == [("a", "unchanged"), ("b", "changed"), ("c", "unchanged"), ("d", "removed"), ("e", "added")]
    v = lambda data: spark.createDataFrame(data, "k string, v int, x string")
    assert rows(U.upsert(v([("a", 2, "old"), ("b", 1, "old"), ("c", 1, "old")]), v([("a", 1, "new"), ("b", 1, "new")]), ["k"], "v")) == [("a", 2, "old"), ("b", 1, "new"), ("c", 1, "old")]
    nodes = spark.createDataFrame([("1", "x.rs"), ("2", "y.rs"), ("3", None)], "id string, file string")
    edges = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "9")], "from_id string, to_id string")
    left, ties = U.prune(nodes, edges, spark.createDataFrame([("x.rs",)], "file string"))
    assert {r.id for r in left.collect()} == {"2", "3"} and rows(ties) == [("2", "3"), ("3", "9")]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "log").write_text("commit aa\tAnn\t100\n\nsrc/a.py\nsrc/b.py\n\ncommit bb\tBob\t200\n\ncommit cc\tCid\t300\n\nsrc/a.py\n")
    got = git_log(spark, str(tmp_path / "log")).collect()
    assert [(r.commit, r.author, r.file) for r in got] == [("aa", "Ann", "src/a.py"), ("aa", "Ann", "src/b.py"), ("cc", "Cid", "src/a.py")]
    code = tmp_path / "code/deep"
    code.mkdir(parents=True)
    (code / "m.py").write_text("import os.path\nfrom . import x\n\nclass K:\n    def f(self, a):\n        if a and self.g(a):\n            for b in a:\n                print(b)\n        return [c for c in a if c]\n")
    (code / "bad.py").write_text("def (")
    (code / "skip.bin").write_bytes(b"\0")
    found = rows(python_items(source_files(spark, str(tmp_path / "code"))).select("item", "fqn", "target", "cyclomatic"))
    assert ("Function", "m::K::f", None, 5) in found and ("CallSite", "m::K::f", "self.g", None) in found and ("Import", "m", "os.path", None) in found and ("broken", "bad", None, None) in found
    assert items("e.py", None) == []
    import ast

    assert complexity(ast.parse("def f():\n    pass").body[0]) == (1, 0)
    write_report(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":1}']
    write_segments(spark.createDataFrame([("s", 1), ("t", 1)], "segment_id string, v int"), str(tmp_path / "seg"))
    write_segments(spark.createDataFrame([("s", 2)], "segment_id string, v int"), str(tmp_path / "seg"))
    assert rows(spark.read.parquet(str(tmp_path / "seg")).select("segment_id", "v")) == [("s", 2), ("t", 1)]
    (tmp_path / "lines").write_text('{"a": 1}\nnope\n')
    assert [(r.a, r._corrupt) for r in json_lines(spark, str(tmp_path / "lines"), "a int").collect()] == [(1, None), (None, "nope")]


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    own = events.filter("user_id < 5").orderBy("event_id").limit(300).toPandas()
    for k in range(3):
        part = own.iloc[k * 100 : (k + 1) * 100]
        lines = [json.dumps({"event_id": int(r.event_id), "ts": r.ts.isoformat(), "user_id": int(r.user_id), "event_type": r.event_type, "value": float(r.value)}) for r in part.itertuples()]
        (tmp_path / f"in/{k}.jsonl").write_text("\n".join([*lines, "not an event"]))
    parsed = Q.parsed(spark.read.text(str(tmp_path / "in")))
    assert parsed.filter("raw is not null").count() == 3
    batch = parsed.filter("event is not null").select("event.*")
    want = rows(Q.latest_state(batch).select("user_id", "events", "errors", "last_type"))

    stream = Q.parsed(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))).filter("event is not null").select("event.*")
    q = Q.counts_by_window(stream).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("windows").select("window_start", "event_type", "n")) == rows(Q.counts_by_window(batch).select("window_start", "event_type", "n"))

    q = Q.folded_state(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.table("states").groupBy("user_id").agg(F.max_by(F.struct("events", "errors", "last_type"), "events").alias("s")).select("user_id", "s.*")
    assert rows(last) == want

    q = Q.upsert_each_batch(stream, str(tmp_path / "table"), ["user_id"], "event_id", str(tmp_path / "c3"))
    q.awaitTermination(120)
    assert rows(Q.stored_upserts(spark, str(tmp_path / "table")).select("user_id", "event_id")) == rows(batch.groupBy("user_id").agg(F.max("event_id")))


def test_every_query_has_a_stable_schema(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "in_rows", "in_partners", "out_rows", "out_partners", "paths_through"]
    assert set(e.oracle_sql()) <= set(e.queries())
