"""Metrics of functions and modules that need no iteration.

`functions`, `edges` and `modules` are rows of subsets.functions, graph.graph_edges (or one of its subsets), and
subsets.analysis_modules(id, module). Module metrics read module_edges (`between`), where each end has met its module once, and aggregate before any further join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgraph.operators.skew import running_sums, sized_join
from fathomgraph.plans.shared import kept
from fathomgraph.sources.graph import is_call_like, is_structural


@dataclass(frozen=True)
class Thresholds:
    """The defaults that decide findings and statuses."""

    coupling_high: float = 0.7
    module_min_members: int = 3
    hotspot_percentile: int = 95
    small_graph: int = 20
    small_graph_hotspot: int = 8
    layer_exclude_percentile: int = 95
    layer_min_gap: int = 2
    cyclomatic: tuple[int, int, int] = (10, 15, 25)
    cognitive: tuple[int, int, int] = (12, 20, 30)
    god_cyclomatic: tuple[int, int] = (10, 20)
    god_fan_out: tuple[int, int] = (8, 15)
    god_loc: tuple[int, int] = (40, 80)
    information_flow_percentile: int = 95
    information_flow_floor: int = 100
    hub_percentile: int = 95
    temporal_min_co_changes: int = 3
    temporal_min_score: float = 0.5
    temporal_max_files: int = 50
    cycle_lengths: tuple[int, int] = (3, 4)
    coupling_levels: tuple[float, float, float, float] = (0.3, 0.5, 0.7, 0.85)
    flow_limits: tuple[tuple[int, int], ...] = ((95, 100), (97, 200), (99, 400))
    hub_limits: tuple[tuple[int, int], ...] = ((95, 4), (99, 6))
    layer_gaps: tuple[int, int] = (3, 4)
    min_edges_for_cycles: int = 50
    min_calls_for_depth: int = 20


DEFAULTS = Thresholds()


def fan(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out) of every node over structural edges; parallel kinds count separately."""
    ends = edges.filter(is_structural()).select(F.explode(F.array(F.struct(F.col("to_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("from_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    counts = ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return nodes.select("id").join(counts, "id", "left").na.fill(0, ["fan_in", "fan_out"])


def ranked_value(values: DataFrame, column: str, index: Column) -> DataFrame:
    """One row (threshold): the value at a 0-based index, given as an expression of n, in ascending order; null if there are no values.

    Equal values are counted first; the distinct ones are summed range by range.
    """
    counted = kept(values.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c")))
    through = running_sums(counted, [], ["v"], "c", "through")
    n = counted.agg(F.sum("c").alias("n"))
    at = F.least(index, F.col("n") - 1)
    return through.join(F.broadcast(n)).filter((F.col("through") > at) & (F.col("through") - F.col("c") <= at)).agg(F.max("v").alias("threshold"))  # one row


def hotspots(fans: DataFrame, functions: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """(id, fan_in, threshold): functions whose fan-in reaches the hotspot threshold, where that is above 0.

    Below `small_graph` functions the threshold is fixed; else it is the fan-in at index ceil(n * percentile / 100), at most the last.
    """
    own = fans.join(functions.select("id"), "id", "left_semi")
    rank = ranked_value(own, "fan_in", F.ceil(F.col("n") * t.hotspot_percentile / 100))
    n = own.agg(F.count(F.lit(1)).alias("n"))
    limit = rank.join(n).select(F.when(F.col("n") < t.small_graph, F.lit(t.small_graph_hotspot)).otherwise(F.col("threshold")).cast("bigint").alias("threshold"))
    return own.join(F.broadcast(limit), (F.col("fan_in") >= F.col("threshold")) & (F.col("threshold") > 0)).select("id", "fan_in", "threshold")  # one row


def percentile_floor(values: DataFrame, column: str, percentile: int, floor: int) -> DataFrame:
    """One row (threshold): the value at index ceil(p * n / 100) - 1, at least floor."""
    at = F.greatest(F.lit(0), F.ceil(F.col("n") * percentile / 100) - 1)
    return ranked_value(values, column, at).select(F.greatest(F.coalesce("threshold", F.lit(floor)), F.lit(floor)).alias("threshold"))


def layer_exclusion_threshold(fans: DataFrame, functions: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """One row (threshold): over functions with callers, the fan-in at index floor(n * percentile / 100), at most the last."""
    return ranked_value(fans.filter("fan_in > 0").join(functions.select("id"), "id", "left_semi"), "fan_in", F.floor(F.col("n") * t.layer_exclude_percentile / 100))


def module_edges(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(from_id, to_id, kind, confidence, from_module, to_module) of structural edges; modules are null where unknown. Much-used ends are spread."""
    modules = kept(modules)
    a, b = modules.select(F.col("id").alias("from_id"), F.col("module").alias("from_module")), modules.select(F.col("id").alias("to_id"), F.col("module").alias("to_module"))
    own = edges.filter(is_structural())
    met = sized_join(own, a, "from_id", "left")
    return sized_join(met, b, "to_id", "left", own).select("from_id", "to_id", "kind", "confidence", "from_module", "to_module")


def coupling(between: DataFrame, modules: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """(module, members, internal_edges, external_edges, score): of modules with enough members and any edge. score is external over all."""
    between = between.groupBy("from_module", "to_module").agg(F.count(F.lit(1)).alias("n"))
    inside = F.coalesce(F.col("from_module") == F.col("to_module"), F.lit(False))
    sides = between.select(
        F.explode(F.when(inside, F.array(F.struct(F.col("from_module").alias("module"), F.col("n").alias("i"), F.lit(0).alias("x")))).otherwise(F.array(*[F.struct(F.col(m).alias("module"), F.lit(0).alias("i"), F.col("n").alias("x")) for m in ("from_module", "to_module")]))).alias("s")
    ).select("s.*")
    counts = sides.filter("module is not null").groupBy("module").agg(F.sum("i").alias("internal_edges"), F.sum("x").alias("external_edges"))
    members = modules.groupBy("module").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") >= t.module_min_members)
    return members.join(counts, "module").withColumn("score", F.col("external_edges") / (F.col("internal_edges") + F.col("external_edges")))


def instability(between: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, ca, ce, instability): distinct other modules that depend on it, and that it depends on; ce / (ca + ce), 0 without either."""
    pairs = between.filter("from_module != to_module").select("from_module", "to_module").distinct()
    ce = pairs.groupBy(F.col("from_module").alias("module")).agg(F.count(F.lit(1)).alias("ce"))
    ca = pairs.groupBy(F.col("to_module").alias("module")).agg(F.count(F.lit(1)).alias("ca"))
    every = modules.select("module").distinct().join(ca, "module", "left").join(ce, "module", "left").na.fill(0)
    return every.select("module", "ca", "ce", F.when(F.col("ca") + F.col("ce") > 0, F.col("ce") / (F.col("ca") + F.col("ce"))).otherwise(0.0).alias("instability"))


def abstractness(nodes: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, abstract_types, types, abstractness): interfaces over interfaces, structs, enums and types; 0 without any."""
    kinds = modules.join(nodes.select("id", "kind"), "id")
    counts = kinds.groupBy("module").agg(F.count_if(F.col("kind") == "Interface").alias("abstract_types"), F.count_if(F.col("kind").isin("Interface", "Struct", "Enum", "Type")).alias("types"))
    return counts.withColumn("abstractness", F.when(F.col("types") > 0, F.col("abstract_types") / F.col("types")).otherwise(0.0))


def main_sequence(unstable: DataFrame, abstract: DataFrame) -> DataFrame:
    """(module, instability, abstractness, distance, zone)."""
    a, i = F.col("abstractness"), F.col("instability")
    d = F.abs(a + i - 1)
    zone = F.when(d < 0.15, "main_sequence").when((a < 0.3) & (i < 0.3), "pain").when((a > 0.7) & (i > 0.7), "uselessness").otherwise("balanced")
    return unstable.select("module", "instability").join(abstract.select("module", "abstractness"), "module").select("module", "instability", "abstractness", d.alias("distance"), zone.alias("zone"))


def api_surface(between: DataFrame, functions: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, functions, exposed, api_surface): the share of a module's functions that a structural edge from another module reaches."""
    reached = between.filter("to_module is not null and not (from_module <=> to_module)").select(F.col("to_id").alias("id")).distinct().withColumn("exposed", F.lit(1))
    own = modules.join(functions.select("id"), "id", "left_semi").join(reached, "id", "left")
    return own.groupBy("module").agg(F.count(F.lit(1)).alias("functions"), F.count("exposed").alias("exposed")).withColumn("api_surface", F.col("exposed") / F.col("functions"))


def hub_scores(between: DataFrame, functions: DataFrame, modules: DataFrame) -> DataFrame:
    """(id, source_modules, target_modules, hub_score): distinct other modules that reach a function, times those it reaches, over the square of all modules."""
    met = between.filter("from_module != to_module")
    into = met.select(F.col("to_id").alias("id"), F.col("from_module").alias("m")).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("source_modules"))
    out = met.select(F.col("from_id").alias("id"), F.col("to_module").alias("m")).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("target_modules"))
    n = modules.select("module").distinct().agg(F.count(F.lit(1)).alias("modules"))
    both = into.join(out, "id").join(functions.select("id"), "id", "left_semi")
    return both.join(F.broadcast(n)).select("id", "source_modules", "target_modules", (F.col("source_modules") * F.col("target_modules") / (F.col("modules") * F.col("modules"))).alias("hub_score"))  # one row


def information_flow(fans: DataFrame, functions: DataFrame) -> DataFrame:
    return fans.join(functions.select("id"), "id", "left_semi").select("id", F.pow(F.col("fan_in") * F.col("fan_out"), 2).cast("bigint").alias("information_flow"))


def function_loc() -> Column:
    """Lines from start to end; 0 without a place, or where the end comes first."""
    return F.when(F.col("end_line") >= F.col("start_line"), F.col("end_line") - F.col("start_line") + 1).otherwise(0)


def lines_of_code(functions: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, functions, loc): lines from start to end of each function, summed; functions without a place count 0."""
    loc = function_loc()
    return functions.select("id", loc.alias("loc")).join(modules, "id").groupBy("module").agg(F.count(F.lit(1)).alias("functions"), F.sum("loc").alias("loc"))


def _level(value: Column, levels: tuple[int, int, int]) -> Column:
    low, mid, high = levels
    return F.when(value > high, 3).when(value > mid, 2).when(value > low, 1).otherwise(0)


def complexity_severity(t: Thresholds = DEFAULTS) -> Column:
    worst = F.greatest(_level(F.coalesce("cyclomatic_complexity", F.lit(0)), t.cyclomatic), _level(F.coalesce("cognitive_complexity", F.lit(0)), t.cognitive))
    return F.when(worst == 3, "Critical").when(worst == 2, "High").when(worst == 1, "Warning")


def complexity(production_functions: DataFrame) -> DataFrame:
    """(language, functions, avg_cyclomatic, max_cyclomatic, findings): over production functions with a cyclomatic complexity."""
    own = production_functions.filter("cyclomatic_complexity is not null")
    return own.groupBy("language").agg(F.count(F.lit(1)).alias("functions"), F.avg("cyclomatic_complexity").alias("avg_cyclomatic"), F.max("cyclomatic_complexity").alias("max_cyclomatic"), F.count(complexity_severity()).alias("findings"))


def god_functions(production_functions: DataFrame, fans: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """(id, cyclomatic_complexity, fan_out, loc, severity): functions that are complex, far-reaching and long at once."""
    loc = function_loc()
    own = production_functions.select("id", "cyclomatic_complexity", loc.alias("loc")).join(fans.select("id", "fan_out"), "id")
    c, f, n = F.col("cyclomatic_complexity"), F.col("fan_out"), F.col("loc")
    hit = own.filter((c >= t.god_cyclomatic[0]) & (f >= t.god_fan_out[0]) & (n >= t.god_loc[0]))
    critical = (c >= t.god_cyclomatic[1]) & (f >= t.god_fan_out[1]) & (n >= t.god_loc[1])
    high = (c >= t.cyclomatic[1]) | (f >= t.god_fan_out[1]) | (n >= t.god_loc[1])
    return hit.select("id", "cyclomatic_complexity", "fan_out", "loc", F.when(critical, "Critical").when(high, "High").otherwise("Warning").alias("severity"))


def confidence_histogram(edges: DataFrame) -> DataFrame:
    """(subset, high, medium, low, unknown, high_ratio, fidelity): of all edges, and of those like calls."""
    every = edges.select(F.explode(F.when(is_call_like(), F.array(F.lit("all"), F.lit("call_like"))).otherwise(F.array(F.lit("all")))).alias("subset"), "confidence")
    counts = every.groupBy("subset").agg(*[F.count_if(F.col("confidence") == c).alias(c.lower()) for c in ("High", "Medium", "Low", "Unknown")])
    ratio = F.col("high") / (F.col("high") + F.col("medium") + F.col("low") + F.col("unknown"))
    return counts.withColumn("high_ratio", ratio).withColumn("fidelity", F.when(ratio >= 0.8, "high").when(ratio >= 0.4, "medium").otherwise("low"))


def languages(nodes: DataFrame) -> DataFrame:
    """(language, files, share): of File nodes, most first by count, then name."""
    counts = nodes.filter("kind = 'File' and language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("files"))
    total = counts.agg(F.sum("files").alias("n"))
    return counts.join(F.broadcast(total)).select("language", "files", (F.col("files") / F.col("n")).alias("share"))  # one row


def module_boundaries(nodes: DataFrame, modules: DataFrame, large: int = 100, very_large: int = 200) -> DataFrame:
    """(module, files, members, issue): modules with many files."""
    own = modules.join(nodes.select("id", "kind"), "id").groupBy("module").agg(F.count_if(F.col("kind") == "File").alias("files"), F.count(F.lit(1)).alias("members"))
    return own.filter(F.col("files") >= large).withColumn("issue", F.when(F.col("files") >= very_large, "very_large").otherwise("large"))
