"""Parent-child links to full hierarchies: level-wise frontier joins from the roots.

Each level joins the frontier to the links by parent; the nodes it finds are the next frontier, with path and depth extended. LEVELS_A_PLAN
levels are one plan, after which the links of the nodes reached are left behind. While many links are left, both sides are partitioned by
parent, and a parent with very many children has its links split over slots, to which its one frontier row is copied. Once
the links left are few enough to be broadcast (their size is checked), a plan runs its levels in one stage without a shuffle, which suits
the long thin tail of deep trees.

The levels end when a frontier is empty. Nodes not reached by then are on or below cycles: their parents' pointers
double until their targets shrink to exactly the cycles' nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgraph.functions.text_ids import clean_id, edge_kind, maybe_kind
from fathomgraph.operators.skew import hot_slots, is_small
from fathomgraph.plans.shared import Rounds, kept

ON_CYCLE, BELOW_CYCLE = -1, -2
LEVELS_A_PLAN = 4
LEVELS_A_STAGE = 16


def parent_links(links: DataFrame, newest: Column) -> DataFrame:
    """(node, parent) of every id in links(parent, child): the parent of its newest row, null for a root.

    Rows with a null parent or child are left out. Rows equal in `newest` are told apart by the parent's id.
    """
    ends = links.filter("parent is not null and child is not null").select(
        F.explode(
            F.array(
                F.struct(F.col("child").alias("node"), F.struct(newest.alias("at"), F.col("parent")).alias("up")),
                F.struct(F.col("parent").alias("node"), F.lit(None).alias("up")),
            )
        ).alias("e")
    ).select("e.*")
    return ends.groupBy("node").agg(F.max("up").alias("up")).select("node", F.col("up.parent").alias("parent"))


def hierarchy(links: DataFrame, paths: bool = True) -> DataFrame:
    """(node, root, depth[, path]) for each row of links(node, parent), where node is unique and parent is null for roots.

    path is the array of nodes from the root to the node. Nodes on a cycle get root '' and depth -1, nodes
    below one '' and -2; their path is null. Every parent must itself be a node of links, as parent_links gives
    them. Empty links give no rows.
    """
    links = kept(links)
    begin = [F.array("node").alias("path")] if paths else []
    columns = ["node", "root", "depth", *(["path"] if paths else [])]
    last = kept(links.filter("parent is null").select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), *begin))
    rest, reached, depth, rounds, few = links.filter("parent is not null"), [last], 0, Rounds(), False
    while not last.isEmpty():
        few = few or is_small(rest)
        some, levels = (_few(last, rest, depth), LEVELS_A_STAGE) if few else (_many(last, rest), LEVELS_A_PLAN)
        some, depth = kept(some), depth + levels
        reached.append(some.select(*columns))
        last = some.filter(F.col("depth") == depth).select(*columns)
        if not few:
            rest = rounds.kept(rest.join(some.select("node"), "node", "left_anti"))
    found = reached[0].select("node")
    for some in reached[1:]:
        found = found.unionByName(some.select("node"))
    rest = kept(rest.join(found, "node", "left_anti"))
    if not rest.isEmpty():
        around = _around(rest)
        reached.append(around.withColumn("path", F.lit(None).cast("array<string>")) if paths else around)
    out = reached[0]
    for some in reached[1:]:
        out = out.unionByName(some)
    return out


def _extended(last: DataFrame, child: str) -> list[Column]:
    path = [F.concat("path", F.array(child)).alias("path")] if "path" in last.columns else []
    return [F.col(child).alias("node"), F.col("root"), (F.col("depth") + 1).alias("depth"), *path]


def _many(last: DataFrame, rest: DataFrame) -> DataFrame:
    """The nodes of the next LEVELS_A_PLAN levels below last, where links and frontier are partitioned by parent and slot."""
    parts = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = kept(hot_slots(rest.select(F.col("parent").alias("id")), parts))  # at most 4 * parts rows
    own = F.broadcast(hot.select(F.col("id").alias("child"), F.col("slots").alias("child_slots")))
    of_parent = F.broadcast(hot.select(F.col("id").alias("parent"), F.col("slots").alias("slots")))
    slot = F.when(F.col("slots").isNull(), 0).otherwise(F.pmod(F.xxhash64("child"), F.col("slots")).cast("int")).alias("slot")
    children = rest.withColumnRenamed("node", "child").join(of_parent, "parent", "left").join(own, "child", "left").select("parent", "child", slot, "child_slots").repartition("parent", "slot")

    def slotted(df: DataFrame) -> DataFrame:
        return df.withColumn("slot", F.explode(F.sequence(F.lit(0), F.coalesce("child_slots", F.lit(1)) - 1))).drop("child_slots").repartition("node", "slot")

    frontier = slotted(last.join(F.broadcast(hot.select(F.col("id").alias("node"), F.col("slots").alias("child_slots"))), "node", "left"))
    found = None
    for _ in range(LEVELS_A_PLAN):
        met = children.join(frontier.hint("shuffle_hash"), (children["parent"] == frontier["node"]) & (children["slot"] == frontier["slot"]))
        frontier = slotted(met.select(*_extended(last, "child"), "child_slots"))
        found = frontier if found is None else found.unionByName(frontier)
    return found.filter("slot = 0").drop("slot")


def _few(last: DataFrame, rest: DataFrame, depth: int) -> DataFrame:
    """The nodes of the next LEVELS_A_STAGE levels below last, where rest, the links left ahead of the first of these stages, is broadcast: its size was checked.

    A row of the frontier meets its children, and itself once more if it has any; a row that meets nothing stays as it is.
    """
    steps = F.broadcast(rest.select("parent", F.col("node").alias("child")).unionByName(rest.select("parent", F.lit(None).cast("string").alias("child")).distinct()))
    state = last.withColumn("open", F.col("node"))
    for _ in range(LEVELS_A_STAGE):
        met = state.join(steps, F.col("open") == F.col("parent"), "left")
        grown = F.col("child").isNotNull()
        path = [F.when(grown, F.concat("path", F.array("child"))).otherwise(F.col("path")).alias("path")] if "path" in last.columns else []
        state = met.select(F.coalesce("child", "node").alias("node"), "root", (F.col("depth") + grown.cast("int")).alias("depth"), *path, F.col("child").alias("open"))
    return state.filter(F.col("depth") > depth).drop("open")


def _around(rest: DataFrame) -> DataFrame:
    """(node, root '', depth -1 on a cycle and -2 below one) of links(node, parent) that no root reaches."""
    state, rounds, before = rest.select("node", F.col("parent").alias("target")), Rounds(), None
    while True:
        via = state.select(F.col("node").alias("target"), F.col("target").alias("next"))
        state = rounds.kept(state.join(via, "target").select("node", F.col("next").alias("target")))
        targets = state.select("target").distinct().count()
        if targets == before:  # the targets shrink round by round until they are the cycles' nodes
            break
        before = targets
    rings = state.select(F.col("target").alias("node")).distinct().withColumn("ring", F.lit(True))
    flat = state.join(rings, "node", "left")
    return kept(flat.select("node", F.lit("").alias("root"), F.when(F.col("ring"), ON_CYCLE).otherwise(BELOW_CYCLE).alias("depth")))


def containment_links(edges: DataFrame) -> DataFrame:
    """(node, parent) over the Contains edges whose endpoints are not blank; a child's newest parent counts."""
    contains = edges.filter(maybe_kind("kind", "contains")).filter(edge_kind("kind") == "Contains")
    links = contains.select(clean_id("from_id").alias("parent"), clean_id("to_id").alias("child"), "recorded_at")
    return parent_links(links, F.col("recorded_at"))


def containment(edges: DataFrame, paths: bool = False) -> DataFrame:
    """(node_id, root_id, tree_depth[, path]) of every node of the containment hierarchy; path is joined by '/'."""
    tree = hierarchy(containment_links(edges), paths=paths)
    out = tree.select(F.col("node").alias("node_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("tree_depth"), *(["path"] if paths else []))
    return out.withColumn("path", F.array_join("path", "/")) if paths else out


def descendants(edges: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance): every pair of a node and an ancestor, from the nodes' paths.

    As many rows as the sum of all depths. Nodes on or below cycles have no path and no pairs.
    """
    tree = hierarchy(containment_links(edges), paths=True).filter("depth > 0")
    pairs = tree.select("node", "depth", F.posexplode(F.slice("path", 1, F.col("depth"))).alias("at", "ancestor_id"))
    return pairs.select("ancestor_id", F.col("node").alias("node_id"), (F.col("depth") - F.col("at")).cast("int").alias("distance"))
