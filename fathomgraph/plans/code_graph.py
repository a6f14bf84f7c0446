"""The graph of one data folder: typed rows and the relations that follow from them, each written once and read by every question."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgraph.operators import components as C
from fathomgraph.operators import interactive as I
from fathomgraph.operators import metrics as M
from fathomgraph.operators import subsets as S
from fathomgraph.plans.shared import kept
from fathomgraph.sources.graph import graph_edges, graph_nodes, is_call_like
from fathomgraph.sources.tables import table


class Graph:
    """Relations are computed when they are first asked for, and stay in the shared folder as tables until the driver ends.

    `of` hands out one graph for each session and set of input files: new files make a new graph.
    """

    _open: dict[tuple[str, str], tuple[tuple[str, ...], Graph]] = {}

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> Graph:
        nodes, edges = table(spark, folder, "nodes"), table(spark, folder, "edges")
        where, files = (spark.conf.get("spark.app.id"), folder), tuple(sorted([*nodes.inputFiles(), *edges.inputFiles()]))
        held = cls._open.get(where)
        if held is None or held[0] != files:
            cls._open[where] = held = files, cls(spark, nodes, edges)
        return held[1]

    def __init__(self, spark: SparkSession, raw_nodes: DataFrame, raw_edges: DataFrame):
        self.spark, self.raw_nodes, self.raw_edges = spark, raw_nodes, raw_edges

    def build(self) -> Graph:
        """The typed rows and what most metrics read, ahead of any question."""
        for name in ("nodes", "edges", "calls_in", "calls_out", "parents", "modules", "outside", "production", "between", "fans"):
            getattr(self, name)
        return self

    @cached_property
    def nodes(self) -> DataFrame:
        return kept(graph_nodes(self.raw_nodes))

    @cached_property
    def edges(self) -> DataFrame:
        return kept(graph_edges(self.raw_edges, self.nodes))

    def _calls(self, own: str, other: str) -> DataFrame:
        """Calls in ranges of one end, a much-used end over several of them, so that a question about few ids reads few row groups."""
        return kept(self.edges.filter("kind = 'Call'").repartitionByRange(own, other).sortWithinPartitions(own, other))

    @cached_property
    def calls_in(self) -> DataFrame:
        return self._calls("to_id", "from_id")

    @cached_property
    def calls_out(self) -> DataFrame:
        return self._calls("from_id", "to_id")

    @cached_property
    def parents(self) -> DataFrame:
        return kept(S.containment_parents(self.edges))

    @cached_property
    def paths(self) -> DataFrame:
        return kept(S.node_paths(self.nodes, self.parents))

    @cached_property
    def modules(self) -> DataFrame:
        return kept(S.modules_of(self.paths))

    @cached_property
    def classes(self) -> DataFrame:
        return kept(S.classifying_files(self.nodes, self.parents))

    @cached_property
    def outside(self) -> DataFrame:
        return kept(S.non_production(self.nodes, self.parents, self.classes))

    @property
    def functions(self) -> DataFrame:
        return S.functions(self.nodes)

    @cached_property
    def fans(self) -> DataFrame:
        return kept(M.fan(self.edges, self.nodes))

    @cached_property
    def between(self) -> DataFrame:
        return kept(M.module_edges(self.edges, self.modules))

    @cached_property
    def production(self) -> DataFrame:
        return kept(S.production_edges(self.edges, self.nodes, outside=self.outside))

    @cached_property
    def production_functions(self) -> DataFrame:
        return kept(self.functions.join(self.outside.filter("not is_non_production").select("id"), "id", "left_semi"))

    @cached_property
    def links(self) -> DataFrame:
        return self._links(self.production)

    @cached_property
    def call_links(self) -> DataFrame:
        return self._links(self.production.filter(is_call_like()))

    @staticmethod
    def _links(edges: DataFrame) -> DataFrame:
        return kept(edges.filter("from_id != to_id").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).distinct())

    @cached_property
    def strong(self) -> DataFrame:
        return C.strong_components(self.links)

    @cached_property
    def depth(self) -> DataFrame:
        return C.longest_depth(self.call_links, self.strong)

    def hot(self, n: int = 1, side: str = "to_id") -> DataFrame:
        """(seed): the functions with most calls on that side."""
        calls = self.calls_in if side == "to_id" else self.calls_out
        return kept(I.top_fan(calls, self.nodes, side, limit=n).select(F.col("id").alias("seed")))
