"""Relations derived from the graph: containment parents, paths, classification, and the edge subsets that metrics use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgraph.functions.paths import folder_key, is_non_production_path, without_build_dirs
from fathomgraph.sources.graph import is_structural
from fathomgraph.operators.skew import without
from fathomgraph.plans.shared import Rounds, kept


def containment_parents(edges: DataFrame) -> DataFrame:
    """(node, parent): the last recorded Contains edge of each node counts; equal times go to the greater parent id."""
    own = edges.filter("kind = 'Contains'")
    return own.groupBy(F.col("to_id").alias("node")).agg(F.max(F.struct("recorded_at", "from_id")).alias("up")).select("node", F.col("up.from_id").alias("parent"))


def nearest_ancestor(values: DataFrame, parents: DataFrame) -> DataFrame:
    """(node, value): of each node of values(node, value) the value of the nearest node at or above it that has one; null if there is none.

    parents(node, parent). Nodes with a value, or whose parent has one, are done in one join. The others point at each other alone: they
    follow their pointers in doubling steps, without the rest of the table. Distances met have no gaps, so a round in which none ends
    is the last; the nodes left then are on or below cycles without a value, and end with null.
    """
    own = values.filter("value is not null")
    above = values.select(F.col("node").alias("parent"), F.col("value").alias("found"), F.lit(True).alias("there"))
    linked = values.filter("value is null").select("node").join(parents, "node", "left")
    first = kept(linked.join(above, "parent", "left").select("node", F.col("found").alias("value"), F.when(F.col("found").isNull() & F.col("there"), F.col("parent")).alias("up")))
    ended = first.filter("up is null").select("node", "value")
    near = ended.select(F.col("node").alias("up"), F.col("value").alias("far"), F.lit(True).alias("met"))
    state = kept(first.filter("up is not null").join(near, "up", "left").select("node", F.col("far").alias("value"), F.when(F.col("met").isNull(), F.col("up")).alias("up")))
    rounds, open_ = Rounds(), "up is not null"
    left = state.filter(open_).count()
    while left:
        via = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("value").alias("far"))
        moved = state.filter(open_).join(via, "up").select("node", F.col("far").alias("value"), F.when(F.col("far").isNull(), F.col("next")).alias("up"))
        state = rounds.kept(state.filter("up is null").unionByName(moved))
        still = state.filter(open_).count()
        if still == left:
            break
        left = still
    return own.select("node", "value").unionByName(ended).unionByName(state.select("node", "value"))


def file_index(nodes: DataFrame) -> DataFrame:
    """(key, file_id): File nodes by file path, repository path and qualified name; the least id where several share a key."""
    files = nodes.filter("kind = 'File'")
    keys = files.select("id", F.explode(F.array_distinct(F.array("file", "path_repo_rel", "fqn"))).alias("key")).filter("key is not null and key != ''")
    return keys.groupBy("key").agg(F.min("id").alias("file_id"))


def node_paths(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, path): a node's own path, else its file's, else that of the nearest containing node with one."""
    own = F.nullif(F.col("path_repo_rel"), F.lit(""))
    files = nodes.select(F.col("id").alias("file_id"), F.col("path_repo_rel").alias("file_rel"))
    of_file = nodes.filter(own.isNull()).select("id", F.col("file").alias("key")).join(file_index(nodes), "key").join(files, "file_id").select("id", "file_rel")
    first = nodes.select("id", own.alias("own")).join(of_file, "id", "left").select(F.col("id").alias("node"), F.coalesce("own", "file_rel").alias("path"), "own")
    first = kept(first)
    above = nearest_ancestor(first.select("node", F.col("own").alias("value")), parents)
    return first.join(above, "node").select(F.col("node").alias("id"), F.coalesce("path", "value").alias("path"))


def modules_of(paths: DataFrame, depth: int = 2, strip_build: bool = False) -> DataFrame:
    """(id, module): the folder key of each row of paths(id, path); nodes without a path have no row."""
    path = F.col("path")
    return paths.select("id", folder_key(without_build_dirs(path) if strip_build else path, depth).alias("module")).filter("module is not null")


def analysis_modules(nodes: DataFrame, parents: DataFrame, depth: int = 2, strip_build: bool = False) -> DataFrame:
    """modules_of the nodes' own, file's or containers' paths."""
    return modules_of(node_paths(nodes, parents), depth, strip_build)


def classifying_files(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, class_id): the File by the node's file path if it tells anything, else the nearest File or Folder at or above the node that does."""
    tells = F.col("path_repo_rel").isNotNull() | F.col("is_test") | F.col("role").isNotNull()
    told = nodes.filter(tells).select(F.col("id").alias("file_id"), F.col("kind").alias("told_kind"))
    by_file = nodes.select("id", F.col("file").alias("key")).join(file_index(nodes), "key").join(told, "file_id", "left_semi").select("id", "file_id")
    own = F.when(F.col("kind").isin("File", "Folder") & tells, F.col("id"))
    above = nearest_ancestor(nodes.select(F.col("id").alias("node"), own.alias("value")), parents)
    return nodes.select("id").join(by_file.hint("shuffle_hash"), "id", "left").join(above.withColumnRenamed("node", "id").hint("shuffle_hash"), "id").select("id", F.coalesce("file_id", "value").alias("class_id"))


def non_production(nodes: DataFrame, parents: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(id, is_non_production, in_test_file, class_path): by the node's and its classifying file's flags and paths."""
    files = nodes.select(
        F.col("id").alias("class_id"),
        (F.col("is_test") | F.col("is_vendor") | F.col("is_build_output") | F.col("is_generated") | F.coalesce(is_non_production_path("path_repo_rel"), F.lit(False))).alias("class_not"),
        F.col("is_test").alias("class_test"),
        F.coalesce("path_repo_rel", "file").alias("class_path"),
    )
    own = F.col("is_test") | F.coalesce(is_non_production_path("path_repo_rel"), F.lit(False)) | is_non_production_path("id")
    classes = classifying_files(nodes, parents) if classes is None else classes
    marked = nodes.select("id", own.alias("own_not")).join(classes.hint("shuffle_hash"), "id").join(files.hint("shuffle_hash"), "class_id", "left")
    no = F.lit(False)
    return marked.select("id", (F.col("own_not") | F.coalesce("class_not", no)).alias("is_non_production"), F.coalesce("class_test", no).alias("in_test_file"), "class_path")


def clean_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Structural edges without a synthetic end."""
    return without(edges.filter(is_structural()), nodes.filter("synthetic").select("id"), ["from_id", "to_id"])


def production_edges(edges: DataFrame, nodes: DataFrame, high_only: bool = False, outside: DataFrame | None = None) -> DataFrame:
    """Clean edges between production nodes; high_only: of high confidence alone.

    Structural edges lose the ends that are left out, all at once: synthetic nodes, and those of outside (non_production's rows).
    """
    outside = non_production(nodes, containment_parents(edges)) if outside is None else outside
    gone = nodes.filter("synthetic").select("id").unionByName(outside.filter("is_non_production").select("id"))
    rows = without(edges.filter(is_structural()), gone, ["from_id", "to_id"])
    return rows.filter("confidence = 'High'") if high_only else rows


def functions(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'Function' and not synthetic")
