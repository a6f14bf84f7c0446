"""Queries on small folders where an earlier cut left rows out."""

import json

NODE = "id string, kind string, fqn string, location string, properties string"
EDGE = "from_id string, to_id string, kind string"


def graph_folder(spark, path, nodes, edges):
    """nodes: (id, kind, properties); edges: (from_id, to_id, kind)."""
    spark.createDataFrame([(i, k, i, None, json.dumps(p)) for i, k, p in nodes], NODE).write.parquet(str(path / "nodes.parquet"))
    spark.createDataFrame(edges, EDGE).write.parquet(str(path / "edges.parquet"))
    return str(path)


def run(spark, name, folder):
    import __spark_entry__ as e

    return sorted(tuple(r) for r in e.queries()[name](spark, folder).collect())


def test_only_files_counts_imports_of_inner_symbols(spark, tmp_path):
    file = lambda i, path, **more: (i, "File", {"path_repo_rel": path} | more)
    nodes = [file("t", "tests/t.rs", is_test=True), file("u", "tests/u.rs"), file("help", "tests/help.rs"), file("shared", "tests/shared.rs"), file("lib", "lib/a.rs"), file("prod", "src/p.rs"), file("mixed", "src/m.rs")]
    inner = {"u_f": ("u", True), "help_f": ("help", False), "shared_f": ("shared", False), "prod_f": ("prod", False), "mixed_t": ("mixed", True), "mixed_f": ("mixed", False)}
    nodes += [(f, "Function", {"is_test": t}) for f, (_, t) in inner.items()]
    edges = [(file_, f, "Contains") for f, (file_, _) in inner.items()]
    edges += [("u_f", "help_f", "Import"), ("t", "shared", "Import"), ("prod_f", "shared_f", "Import"), ("t", "lib", "Import")]
    # u: all of its functions are tests; help: only u's function imports its function; shared: production imports an inner symbol; lib: not a test path.
    assert run(spark, "test_only_files", graph_folder(spark, tmp_path, nodes, edges)) == [("help",), ("t",), ("u",)]


def test_blast_radius_has_a_row_for_every_function(spark, tmp_path):
    chain = [f"f{i:02d}" for i in range(25)]
    ring = ["r0", "r1", "r2"]
    nodes = [(i, "Function", {"path_repo_rel": "src/a.rs"}) for i in [*chain, *ring, "alone"]]
    pairs = [*zip(chain, chain[1:]), *zip(ring, ring[1:] + ring[:1]), ("r0", "f00")]
    want = {f: i + 3 for i, f in enumerate(chain)} | dict.fromkeys(ring, 2) | {"alone": 0}
    assert run(spark, "blast_radius", graph_folder(spark, tmp_path, nodes, [(a, b, "Call") for a, b in pairs])) == sorted(want.items())


def test_call_cycles_up_to_eight(spark, tmp_path):
    rings = [[f"{n}{i}" for i in range(n)] for n in range(2, 10)]
    edges = [(a, b, "Call") for r in rings for a, b in zip(r, r[1:] + r[:1])] + [("80", "83", "Call")]
    nodes = [(i, "Function", {}) for r in rings for i in r]
    want = [(r, len(r)) for r in rings if len(r) <= 8] + [(["80", *rings[6][3:]], 6)]
    assert run(spark, "call_cycles", graph_folder(spark, tmp_path, nodes, edges)) == sorted(want)


def cache(spark, path, rows):
    from datetime import datetime

    data = [(run_, segment, fingerprint, datetime(2024, 1, day)) for run_, segment, fingerprint, day in rows]
    spark.createDataFrame(data, "scan_run_id string, segment_id string, graph_fingerprint string, updated_at timestamp_ntz").write.parquet(str(path / "analysis_segment_cache.parquet"))
    return str(path)


def test_findings_of_fingerprints_with_blanks(spark, tmp_path):
    folder = cache(spark, tmp_path, [("r1", "Cycles", " 0000AB", 1), ("r1", "DeadCode", "0001cd ", 1), ("r2", "Cycles", "\t0003ef", 1), ("r3", "Cycles", "  ", 1)])
    assert run(spark, "capped_findings", folder) == [("Cycles", "Cycles-r1-0000ab", "Critical", 0), ("Cycles", "Cycles-r2-0003ef", "Info", 0), ("DeadCode", "DeadCode-r1-0001cd", "High", 0)]
    assert run(spark, "node_risk", folder) == [("r1", "Critical"), ("r2", "Info")]
    assert len(run(spark, "priorities", folder)) == 3


def test_reusable_segments_of_consecutive_runs(spark, tmp_path):
    from datetime import datetime

    runs = [(r, "p", datetime(2024, 1, day), status) for r, day, status in [("r1", 1, "completed"), ("rx", 2, "failed"), ("r2", 3, " Completed"), ("r3", 4, "completed")]]
    spark.createDataFrame(runs, "id string, project_id string, started_at timestamp_ntz, status string").write.parquet(str(tmp_path / "scan_runs.parquet"))
    rows = [("r1", "Cycles", "aa", 1), ("r1", "DeadCode", " BB", 1), ("rx", "Cycles", "cc", 2), ("r2", "Cycles", "AA ", 3), ("r2", "DeadCode", "bb", 3), ("r3", "Cycles", "cc", 4), ("r3", "DeadCode", "zz", 4), ("r3", "DeadCode", "bb", 5)]
    want = [("r2", "Cycles", "aa"), ("r2", "DeadCode", "bb"), ("r3", "DeadCode", "bb")]
    assert run(spark, "reusable_segments", cache(spark, tmp_path, rows)) == want


def test_clusters_of_commits_of_more_than_fifty_files(spark):
    from fathomgraph.operators import git_signals as G

    names = [f"f{i:02d}" for i in range(51)]
    data = [(c, f) for c in ("c1", "c2", "c3") for f in names] + [("d", f) for f in [*names[:50], "other"]]
    assert [(r.files, r.n) for r in G.clusters(spark.createDataFrame(data, "commit string, file string")).collect() if len(r.files) > 2] == [(names, 3)]
