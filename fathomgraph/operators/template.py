"""Template queries: a filtered part of the graph, or what a bounded traversal meets, with its edges."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgraph.functions.filters import NodeFilter, parse_edge_filter, parse_node_filter
from fathomgraph.operators.skew import sized_join
from fathomgraph.plans.shared import kept

#: Limits of a template query's answer.
MAX_DEPTH, MAX_NODES, MAX_EDGES = 25, 50_000, 200_000


class TooLarge(ValueError):
    pass


def guarded(df: DataFrame, limit: int, what: str) -> DataFrame:
    """df, refused if it has more than limit rows: the answer is never cut."""
    df = kept(df)
    if df.limit(limit + 1).count() > limit:
        raise TooLarge(f"more than {limit} {what}")
    return df


def filtered_dump(nodes: DataFrame, edges: DataFrame, node_filter: str = "", edge_filter: str = "", closed: bool = True) -> tuple[DataFrame, DataFrame]:
    """The nodes that pass, and the edges of the kinds asked for among them (closed) or touching them.

    Where edges touch, ends beyond the chosen nodes come as stubs: is_stub, stub_reason 'external_endpoint'. Beginnings of paths are SQL patterns here.
    """
    wanted = parse_node_filter(node_filter).column(pattern=True) if node_filter.strip() else F.lit(True)
    chosen = nodes.filter(wanted)
    kinds = parse_edge_filter(edge_filter) if edge_filter.strip() else None
    some = edges if kinds is None else edges.filter(F.col("kind").isin(*kinds))
    ids = kept(chosen.select("id"))
    a, b = ids.select(F.col("id").alias("from_id")), ids.select(F.col("id").alias("to_id"))
    marked = chosen.withColumn("is_stub", F.lit(False)).withColumn("stub_reason", F.lit(None).cast("string"))
    if closed:
        return marked, sized_join(sized_join(some, a, "from_id", "left_semi"), b, "to_id", "left_semi")
    touching = sized_join(some, a, "from_id", "left_semi").unionByName(sized_join(some, b, "to_id", "left_semi")).distinct()
    ends = touching.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct().join(chosen.select("id"), "id", "left_anti")
    stubs = nodes.join(ends, "id", "left_semi").withColumn("is_stub", F.lit(True)).withColumn("stub_reason", F.lit("external_endpoint"))
    return marked.unionByName(stubs), touching


def resolve_seeds(nodes: DataFrame, ids: tuple[str, ...] = (), paths: tuple[str, ...] = (), fqn_like: tuple[str, ...] = ()) -> DataFrame:
    """(id): nodes by id, Files and Folders by repository path, and nodes by an SQL pattern of the fqn (without letter case); each once."""
    hit = F.col("id").isin(*[i.strip().lower() for i in ids]) | (F.col("kind").isin("File", "Folder") & F.coalesce(F.col("path_repo_rel").isin(*paths), F.lit(False)))
    for pattern in fqn_like:
        hit = hit | F.col("fqn").ilike(pattern)
    return nodes.filter(hit).select("id").distinct()


def traverse(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out", kinds: list[str] | None = None, emit: NodeFilter | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, depth) of the nodes within depth of seeds(id), and all edges of the kinds among them.

    direction is out, in or both; the kinds of edges gate the way. emit filters what comes out, not where the search goes. Each node is
    expanded once, at its least depth.
    """
    if not 0 <= depth <= MAX_DEPTH:
        raise TooLarge(f"depth beyond {MAX_DEPTH}")
    some = edges if kinds is None else edges.filter(F.col("kind").isin(*kinds))
    forward, back = some.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")), some.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"))
    steps = kept({"out": forward, "in": back, "both": forward.unionByName(back)}[direction].distinct())
    met = kept(seeds.join(nodes.select("id"), "id", "left_semi").select("id", F.lit(0).alias("depth")))
    frontier = met
    for d in range(1, depth + 1):
        found = frontier.select(F.col("id").alias("a")).join(steps, "a").select(F.col("b").alias("id")).distinct()
        frontier = kept(found.join(met.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        met = met.unionByName(frontier)
    ids = kept(met.select("id"))
    inside = sized_join(sized_join(some, ids.select(F.col("id").alias("from_id")), "from_id", "left_semi"), ids.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    if emit is not None:
        met = met.join(nodes.filter(emit.column()).select("id"), "id", "left_semi")
    return met, inside


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Template:
    """The [graph] section of a template file."""

    mode: str = "filtered_dump"
    depth: int = 3
    direction: str = "out"
    show_externals: bool = False
    node_filter: str = ""
    edge_filter: str = ""
    ids: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    fqn_like: tuple[str, ...] = ()
    warnings: tuple[str, ...] = field(default=())

    @classmethod
    def parse(cls, text: str) -> Template:
        doc = tomllib.loads(text).get("graph")
        if doc is None:
            raise TemplateError("no [graph] section")
        mode, said = str(doc.get("mode", "filtered_dump")).strip(), []
        if mode not in ("filtered_dump", "traversal"):
            raise TemplateError(f"no mode: {mode}")
        if "mode" not in doc:
            said.append("mode: filtered_dump")
        depth, direction = int(doc.get("depth", 3)), doc.get("direction", "out")
        if direction not in ("out", "in", "both"):
            raise TemplateError(f"no direction: {direction}")
        if mode == "filtered_dump" and (depth != 3 or direction != "out"):
            said.append("depth and direction are not used")
        seeds: dict[str, list[str]] = {"by_id": [], "by_path_repo_rel": [], "by_fqn_like": []}
        if mode == "traversal":
            for root in (doc.get("seed") or {}).get("roots") or []:
                name = next((k for k in seeds if k in root), None)
                if name is None:
                    raise TemplateError("a seed names none of " + ", ".join(seeds))
                seeds[name].append(root[name])
            if not any(seeds.values()):
                raise TemplateError("a traversal needs seed.roots")
        return cls(mode, depth, direction, bool(doc.get("show_externals", False)), doc.get("node_filter", ""), doc.get("edge_filter", ""), *map(tuple, seeds.values()), tuple(said))


def run_template(nodes: DataFrame, edges: DataFrame, template: Template, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> tuple[DataFrame, DataFrame]:
    """The template's nodes and edges; refused if they are more than the limits, or if no seed is met."""
    if template.mode == "filtered_dump":
        chosen, some = filtered_dump(nodes, edges, template.node_filter, template.edge_filter, not template.show_externals)
        return guarded(chosen, max_nodes, "nodes"), guarded(some, max_edges, "edges")
    seeds = kept(resolve_seeds(nodes, template.ids, template.paths, template.fqn_like))
    if seeds.isEmpty():
        raise TemplateError("no node is named by the seeds")
    kinds = parse_edge_filter(template.edge_filter) if template.edge_filter.strip() else None
    emit = parse_node_filter(template.node_filter) if template.node_filter.strip() else None
    met, inside = traverse(nodes, edges, seeds, template.depth, template.direction, kinds, emit)
    return guarded(met.join(nodes, "id"), max_nodes, "nodes"), guarded(inside, max_edges, "edges")
