"""Interactive questions about the graph: who calls what, how far a change reaches, which modules are tied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgraph.functions.paths import evidence_tier, ranked_tier, tier_rank
from fathomgraph.operators.skew import sized_join
from fathomgraph.plans.shared import kept

#: Names too common to search for as part of a name.
GENERIC_NAMES = (
    "as_str", "build", "clone", "create", "default", "delete", "drop", "format", "from", "get", "init", "into", "is_empty", "iter", "len", "load",
    "new", "next", "parse", "run", "save", "set", "start", "stop", "to_string", "update",
)


def calls(edges: DataFrame) -> DataFrame:
    return edges.filter("kind = 'Call'")


def top_fan(edges: DataFrame, nodes: DataFrame, side: str = "to_id", limit: int = 20, at_least: int = 1) -> DataFrame:
    """(id, fqn, n): the functions with most Call edges on that side; ties go by fqn, then id."""
    n = calls(edges).groupBy(F.col(side).alias("id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least)
    return nodes.filter("kind = 'Function'").select("id", "fqn").join(n, "id").orderBy(F.col("n").desc(), "fqn", "id").limit(limit)


FEW = 500


def calls_at(edges: DataFrame, own: str, ids: DataFrame) -> DataFrame:
    """The calls whose end `own` is among the distinct ids(id). Few ids become a filter that reaches the scan; a small table of them is broadcast;
    otherwise much-used ends are spread."""
    ids = kept(ids.select("id").distinct())
    few = [r.id for r in ids.limit(FEW + 1).collect()]
    if len(few) <= FEW:
        return calls(edges).filter(F.col(own).isin(*few))
    return sized_join(calls(edges), ids.select(F.col("id").alias(own)), own)


def neighbours(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, direction: str) -> DataFrame:
    """(seed, id, fqn, kind, tier): callers ('in') or callees ('out') of each row of seeds(seed), in one join for all of them."""
    own, other = ("to_id", "from_id") if direction == "in" else ("from_id", "to_id")
    met = calls_at(edges, own, seeds.select(F.col("seed").alias("id"))).select(F.col(own).alias("seed"), F.col(other).alias("id"), evidence_tier("source").alias("tier"))
    return met.join(nodes.select("id", "fqn", "kind"), "id").select("seed", "id", "fqn", "kind", "tier")


def uncalled_functions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, fqn): functions that no Call edge reaches."""
    return nodes.filter("kind = 'Function'").select("id", "fqn").join(calls(edges).select(F.col("to_id").alias("id")), "id", "left_anti")


def module_pairs(edges: DataFrame, limit: int = 20) -> DataFrame:
    """(from_module, to_module, n): calls between different containers, most first.

    Calls are first counted per pair of functions' containers' keys on one side, so a much-called function
    meets its containers once per calling container and not once per call. Nodes with several parents count for each.
    """
    holds = kept(edges.filter("kind = 'Contains'").select(F.col("to_id").alias("member"), F.col("from_id").alias("module")))
    outer = sized_join(calls(edges).select("from_id", "to_id"), holds.select(F.col("member").alias("from_id"), F.col("module").alias("from_module")), "from_id")
    counted = outer.groupBy("from_module", "to_id").agg(F.count(F.lit(1)).alias("n"))
    inner = sized_join(counted, holds.select(F.col("member").alias("to_id"), F.col("module").alias("to_module")), "to_id").filter("from_module != to_module")
    return inner.groupBy("from_module", "to_module").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "from_module", "to_module").limit(limit)


def reach(edges: DataFrame, seeds: DataFrame, direction: str = "in", max_depth: int = 3) -> DataFrame:
    """(id, depth, via_seeds, tier): nodes that a multi-source breadth-first search over calls meets within max_depth.

    depth is the least over all seeds, via_seeds the sorted seeds that reach the node at any depth, tier the best evidence of
    an edge that first reached it from some seed. Seeds themselves are left out. Each level joins the frontier's distinct
    (seed, node) pairs and drops pairs met before.
    """
    near, far = ("to_id", "from_id") if direction == "in" else ("from_id", "to_id")
    frontier = kept(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.lit(0).alias("rank")))
    visited = [frontier]
    for depth in range(1, max_depth + 1):
        steps = calls_at(edges, near, frontier.select(F.col("node").alias("id"))).select(F.col(near).alias("node"), F.col(far).alias("next"), tier_rank(evidence_tier("source")).alias("rank"))
        met = sized_join(steps, frontier.select("seed", "node"), "node").groupBy("seed", F.col("next").alias("node")).agg(F.max("rank").alias("rank"))
        seen = visited[0].select("seed", "node")
        for v in visited[1:]:
            seen = seen.unionByName(v.select("seed", "node"))
        frontier = kept(met.join(seen, ["seed", "node"], "left_anti").select("seed", "node", F.lit(depth).alias("depth"), "rank"))
        if frontier.isEmpty():
            break
        visited.append(frontier)
    found = visited[0]
    for v in visited[1:]:
        found = found.unionByName(v)
    found = found.join(seeds.select(F.col("seed").alias("node")), "node", "left_anti")
    out = found.groupBy(F.col("node").alias("id")).agg(F.min("depth").alias("depth"), F.array_sort(F.collect_set("seed")).alias("via_seeds"), F.max("rank").alias("rank"))
    return out.select("id", "depth", "via_seeds", ranked_tier("rank").alias("tier"))


def slice_around(edges: DataFrame, seeds: DataFrame, max_depth: int = 2) -> DataFrame:
    """Both directions of reach, told apart by `direction`; a node may come in both."""
    return reach(edges, seeds, "in", max_depth).withColumn("direction", F.lit("in")).unionByName(reach(edges, seeds, "out", max_depth).withColumn("direction", F.lit("out")))


def shortest_path(edges: DataFrame, source: str, target: str, max_depth: int = 10) -> DataFrame:
    """(step, id) of the shortest directed call path, the least by ids among equally short ones; no rows if there is none within max_depth."""
    spark = edges.sparkSession
    if source == target:
        return spark.createDataFrame([(0, source)], "step int, id string")
    frontier = spark.createDataFrame([(source, [source])], "node string, path array<string>")
    visited = frontier.select("node")
    for _ in range(max_depth):
        steps = calls_at(edges, "from_id", frontier.select(F.col("node").alias("id"))).select(F.col("from_id").alias("node"), F.col("to_id").alias("next")).distinct()
        met = frontier.join(steps, "node").groupBy(F.col("next").alias("node")).agg(F.min(F.concat("path", F.array("next"))).alias("path"))
        frontier = kept(met.join(visited, "node", "left_anti"))
        hit = frontier.filter(F.col("node") == target)
        if not hit.isEmpty():
            return hit.select(F.posexplode("path").alias("step", "id"))
        if frontier.isEmpty():
            break
        visited = kept(visited.unionByName(frontier.select("node")))
    return spark.createDataFrame([], "step int, id string")


def simple_cycles(edges: DataFrame, max_length: int = 4, limit: int | None = None, calls_only: bool = True) -> DataFrame:
    """(cycle, length): simple cycles of calls (or of all the edges given) up to max_length, written from their least id on, shortest first.

    Paths start at the cycle's least id and grow only by greater ids, so each cycle is found once. Before
    that, edges outside of strongly connected parts are shed: those whose ends have no way in or no way on.
    """
    steps = (calls(edges) if calls_only else edges).filter("from_id != to_id").select("from_id", "to_id").distinct()
    for _ in range(max_length):
        steps = steps.join(steps.select(F.col("to_id").alias("from_id")).distinct(), "from_id", "left_semi")
        steps = kept(steps.join(steps.select(F.col("from_id").alias("to_id")).distinct(), "to_id", "left_semi"))
    paths = steps.filter("to_id > from_id").select(F.array("from_id", "to_id").alias("path"))
    on = steps.select(F.col("from_id").alias("tail"), F.col("to_id").alias("next"))
    found = None
    for length in range(2, max_length + 1):
        grown = paths.withColumn("tail", F.element_at("path", -1)).join(on, "tail")
        closed = grown.filter(F.col("next") == F.col("path")[0]).select(F.col("path").alias("cycle"), F.lit(length).alias("length"))
        found = closed if found is None else found.unionByName(closed)
        paths = kept(grown.filter((F.col("next") > F.col("path")[0]) & ~F.array_contains("path", F.col("next"))).select(F.concat("path", F.array("next")).alias("path")))
        if paths.isEmpty():
            break
    found = found.orderBy("length", "cycle")
    return found if limit is None else found.limit(limit)


def is_too_generic(seed: str) -> bool:
    return not any(mark in seed for mark in ("::", ".", "(")) and (len(seed) < 6 or seed in GENERIC_NAMES)


def resolve_symbol(nodes: DataFrame, needle: str) -> DataFrame:
    """(id, fqn, kind, how): the node that needle names: by exact fqn, else id, else a unique fqn ending, else a unique part of an fqn.

    Endings and parts are compared without letter case, and name functions, modules and files alone; parts of generic names
    resolve to nothing. Where the first rule that meets anything meets several nodes, all of them come, as candidates.
    """
    low, searchable = F.lower("fqn"), F.col("kind").isin("Function", "Module", "File")
    part = F.lit(False) if is_too_generic(needle) else low.contains(needle.lower())
    rule = (
        F.when(F.col("fqn") == needle, 0)
        .when(F.col("id") == needle.strip().lower(), 1)
        .when(searchable & (low.endswith("::" + needle.lower())), 2)
        .when(searchable & part, 3)
    )
    hits = nodes.select("id", "fqn", "kind", rule.alias("rule")).filter("rule is not null")
    best = hits.agg(F.min("rule").alias("rule"))
    how = F.element_at(F.array(*[F.lit(x) for x in ("fqn", "id", "suffix", "part")]), F.col("rule") + 1)
    return hits.join(F.broadcast(best), "rule").select("id", "fqn", "kind", how.alias("how")).orderBy(F.length("fqn"), "fqn", "id").limit(25)


def seeds_of(spark: SparkSession, ids: list[str]) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "seed string")


def functions_of_file(nodes: DataFrame, path: Column | str) -> DataFrame:
    """(seed): the functions whose location is in the file."""
    return nodes.filter(F.col("kind") == "Function").filter(F.col("file") == path).select(F.col("id").alias("seed"))


def file_blast_radius(calls_in: DataFrame, nodes: DataFrame, path: str, max_depth: int = 3) -> DataFrame:
    """reach of all functions of the file, against the direction of calls."""
    return reach(calls_in, kept(functions_of_file(nodes, path)), "in", max_depth)


class NotAFunction(ValueError):
    pass


def blast_radius_of(calls_in: DataFrame, nodes: DataFrame, seed: str, max_depth: int = 3, cap: int = 500) -> tuple[DataFrame, bool]:
    """The callers of one function within max_depth, nearest first, ties by id, and whether there are more than cap of them. The cap is the question's own."""
    if nodes.filter((F.col("id") == seed) & (F.col("kind") == "Function")).isEmpty():
        raise NotAFunction(seed)
    found = kept(reach(calls_in, seeds_of(nodes.sparkSession, [seed]), "in", max_depth))
    return found.orderBy("depth", "id").limit(cap), found.count() > cap
