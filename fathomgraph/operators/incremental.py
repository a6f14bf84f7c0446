"""Incremental work: what changed by content, upserts that keep the last writer, cascading removal, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomgraph.functions.text_ids import clean_id
from fathomgraph.operators.skew import sized_join, without
from fathomgraph.operators.snapshot_diff import run_order
from fathomgraph.plans.shared import kept


def content_hash(c: Column | str) -> Column:
    return F.sha2(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), 256)


def stable_id(fqn: Column, body: Column | None = None) -> Column:
    """SHA-256 of 'fqn', NUL, the name, and, if there is one, NUL, 'body', NUL, the body without comments and with single blanks."""
    nul = F.lit("\0")
    parts = [F.lit("fqn"), nul, fqn]
    if body is not None:
        parts += [F.when(body.isNotNull(), F.concat(nul, F.lit("body"), nul, body)).otherwise("")]
    return F.sha2(F.concat(*parts), 256)


def plan(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, state): unchanged, changed, added or removed, by hash and language; both are (path, hash, language)."""
    a, b = before.select("path", F.col("hash").alias("h0"), F.col("language").alias("l0"), F.lit(1).alias("was")), now.select("path", F.col("hash").alias("h1"), F.col("language").alias("l1"), F.lit(1).alias("is"))
    both = a.join(b, "path", "full_outer")
    same = F.col("h0").eqNullSafe(F.col("h1")) & F.col("l0").eqNullSafe(F.col("l1"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return both.select("path", state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """The rows of both, one per key: the greatest version; at equal versions the new row."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    by = Window.partitionBy(*key).orderBy(F.col(version).desc_nulls_last(), F.col("__new").desc())
    return both.withColumn("__k", F.row_number().over(by)).filter("__k = 1").drop("__k", "__new")


def prune(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes without those of files(file), and edges without those that touch a node removed."""
    gone = nodes.join(files, "file", "left_semi").select("id")
    left = nodes.join(files, "file", "left_anti").select(*nodes.columns)
    return left, without(edges, gone, ["from_id", "to_id"]).select(*edges.columns)


def prune_missing(cache: DataFrame, present: DataFrame, language: str) -> DataFrame:
    """cache without the rows of that language whose file is not in present(file); other languages stay."""
    mine = F.col("language") == language
    return cache.filter(~mine | F.col("language").isNull()).unionByName(cache.filter(mine).join(present.select("file").distinct(), "file", "left_semi").select(*cache.columns))


def dirty_paths(unstaged: DataFrame, staged: DataFrame, untracked: DataFrame, files: DataFrame, since) -> DataFrame:
    """(path): changed in any of the three lists, or modified after `since` by files(path, modified_at); each once."""
    return unstaged.select("path").unionByName(staged.select("path")).unionByName(untracked.select("path")).unionByName(files.filter(F.col("modified_at") > F.lit(since)).select("path")).distinct()


TOPOLOGY = ("Call", "Import", "Uses", "Type", "Extends", "Implements")


def structure_fingerprint(nodes: DataFrame, edges: DataFrame, by: str = "language") -> DataFrame:
    """(by, nodes, edges, fingerprint) of each group of nodes: equal where the same named nodes are tied the same way.

    The fingerprint adds up forty bits of two SHA-256 hashes of each distinct kind|from|to of names, so it is one partial sum per task and
    needs no sorted list of all edges. Much-used ends are spread.
    """
    a = kept(nodes.select(F.col("id").alias("from_id"), F.col("fqn").alias("from_fqn"), F.col(by)))
    b = kept(nodes.select(F.col("id").alias("to_id"), F.col("fqn").alias("to_fqn")))
    met = sized_join(sized_join(edges.filter(F.col("kind").isin(*TOPOLOGY)).select("kind", "from_id", "to_id"), a, "from_id"), b, "to_id")
    named = met.select(by, F.concat_ws("|", "kind", "from_fqn", "to_fqn").alias("e")).distinct()
    part = lambda salt: F.sum(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}|"), "e"), 256), 1, 10), 16, 10).cast("decimal(20, 0)"))
    ties = named.groupBy(by).agg(F.count(F.lit(1)).alias("edges"), F.sha2(F.concat_ws("|", part(1).cast("string"), part(2).cast("string")), 256).alias("fingerprint"))
    return nodes.groupBy(by).agg(F.count(F.lit(1)).alias("nodes")).join(ties, by, "left").select(by, "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), "fingerprint")


def trust_level(changed: int, total: int, structure_changed: bool, forced: bool = False) -> str:
    """L0 nothing changed, L1 much changed or forced, L2 the structure stayed, L3 it changed."""
    if changed == 0 and not forced:
        return "L0"
    if forced or changed > 5 or total and changed / total > 0.02:
        return "L1"
    return "L3" if structure_changed else "L2"


def reusable_segments(cache: DataFrame, scan_runs: DataFrame) -> DataFrame:
    """(scan_run_id, segment_id, graph_fingerprint): segments of completed runs whose fingerprint is that of the completed run before: what need not be computed again.

    Fingerprints compare trimmed and lower-cased; of a segment that a run holds several times, the row updated last counts.
    """
    newest = F.max(F.struct("updated_at", clean_id("graph_fingerprint").alias("f")))["f"]
    held = cache.filter("segment_id is not null").groupBy("scan_run_id", "segment_id").agg(newest.alias("graph_fingerprint")).filter("graph_fingerprint is not null")
    before = run_order(scan_runs).filter("next_run is not null").select("scan_run_id", "next_run")
    old = held.join(before, "scan_run_id").select(F.col("next_run").alias("scan_run_id"), "segment_id", "graph_fingerprint")
    return held.join(old, ["scan_run_id", "segment_id", "graph_fingerprint"], "left_semi")
