"""The health report as tables: findings of every kind, metrics over all and over sure edges alone, score, risks, priorities.

Findings are rows of (type, id, severity, primary_node, value); the nodes that a finding names are rows of their own, so a cycle may have any
number of them. Metrics are rows of (metric, value), so that they meet by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgraph.operators.findings import CONFIDENCE_FACTOR, SEVERITY_RANK, TEMPORAL_FACTOR, WEIGHTS, WORSENING_FACTOR, _mapped, severity_rank
from fathomgraph.operators.metrics import DEFAULTS, Thresholds, complexity_severity, percentile_floor
from fathomgraph.operators.skew import numbered, sized_join
from fathomgraph.functions.paths import is_non_production_path
from fathomgraph.plans.shared import kept

#: Types of findings whose confidence follows from how calls were resolved.
RESOLVED_TYPES = ("PotentiallyUnreachable", "HighCoupling", "BlastRadiusHotspot", "InformationFlowBottleneck", "HubNode")


def cycles(strong: DataFrame, production: DataFrame) -> DataFrame:
    """(cycle, component, size, edges): strongly connected parts, numbered from 1 by size, then least node; edges are the production edges inside, parallel kinds each."""
    part = strong.select("node", "component")
    a, b = part.select(F.col("node").alias("from_id"), F.col("component").alias("x")), part.select(F.col("node").alias("to_id"), F.col("component").alias("y"))
    inside = sized_join(sized_join(production.select("from_id", "to_id"), a, "from_id"), b, "to_id").filter("x = y").groupBy(F.col("x").alias("component")).agg(F.count(F.lit(1)).alias("edges"))
    sizes = strong.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return numbered(sizes.join(inside, "component"), [-F.col("size"), F.col("component")], "cycle").select("cycle", "component", "size", "edges")


def _finding(kind: str | Column, id_: Column, severity: Column, node: str, value: str | Column) -> list[Column]:
    return [(F.lit(kind) if isinstance(kind, str) else kind).alias("type"), id_.alias("id"), severity.alias("severity"), F.col(node).alias("primary_node"), (F.col(value) if isinstance(value, str) else value).cast("double").alias("value")]


def _called(prefix: str, number: str) -> Column:
    return F.concat(F.lit(prefix + "-"), F.col(number).cast("string"))


def cycle_findings(found: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    level = F.when(F.col("size") >= t.cycle_lengths[1], "Critical").when(F.col("size") >= t.cycle_lengths[0], "High").otherwise("Warning")
    return found.select(*_finding("CircularDependency", _called("cycle", "cycle"), level, "component", "size"))


def coupling_findings(coupled: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Of production modules, by their own path, whose coupling is beyond the least that is worth a word."""
    least, warning, high, critical = t.coupling_levels
    s = F.col("score")
    level = F.when(s > critical, "Critical").when(s > high, "High").when(s > warning, "Warning").otherwise("Info")
    return coupled.filter((s > least) & ~is_non_production_path("module")).select(*_finding("HighCoupling", F.concat(F.lit("coupling-"), "module"), level, "module", s))


def hotspot_findings(hot: DataFrame, production_functions: DataFrame, links: DataFrame) -> DataFrame:
    """High where other nodes reach the hotspot along links(src, dst). How many is not asked, and any that does comes in by a last link, so the ends of links tell."""
    own = kept(hot.join(production_functions.select("id"), "id", "left_semi"))
    reached = sized_join(links.filter("src != dst").select(F.col("dst").alias("id")), own.select("id"), "id", "left_semi").distinct().withColumn("reached", F.lit(True))
    placed = numbered(own.join(reached, "id", "left"), [-F.col("fan_in"), F.col("id")], "k")
    return placed.select(*_finding("BlastRadiusHotspot", _called("hotspot", "k"), F.when(F.col("reached") & (F.col("fan_in") > 0), "High").otherwise("Warning"), "id", "fan_in"))


def complexity_findings(production_functions: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    own = production_functions.filter("cyclomatic_complexity is not null").select("id", "cyclomatic_complexity", complexity_severity(t).alias("level")).filter("level is not null")
    return numbered(own, [F.col("id")], "k").select(*_finding("ExcessiveComplexity", _called("complexity", "k"), F.col("level"), "id", "cyclomatic_complexity"))


def _beyond(values: DataFrame, column: str, limits: tuple[tuple[int, int], ...], production_functions: DataFrame) -> DataFrame:
    """The production rows of values(id, column, ...) above the first of the percentiles with their floors; `p1`, `p2` ... are the others, ascending."""
    values = kept(values)
    limit = None
    for k, (percentile, floor) in enumerate(limits):
        one = percentile_floor(values, column, percentile, floor).withColumnRenamed("threshold", f"p{k}")
        limit = one if limit is None else limit.join(one)  # one row each
    return values.join(F.broadcast(limit)).filter(F.col(column) > F.col("p0")).join(production_functions.select("id"), "id", "left_semi")


def flow_findings(flow: DataFrame, production_functions: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    v = F.col("information_flow")
    own = _beyond(flow, "information_flow", t.flow_limits, production_functions)
    level = F.when(v > F.col("p2"), "Critical").when(v > F.col("p1"), "High").otherwise("Warning")
    return numbered(own, [-v, F.col("id")], "k").select(*_finding("InformationFlowBottleneck", _called("ifc", "k"), level, "id", v))


def bridges(between: DataFrame, functions: DataFrame) -> DataFrame:
    """(id, bridges): of every function the distinct other modules that reach it, and those that it reaches, added up."""
    met = between.filter("from_module != to_module")
    ends = met.select(F.explode(F.array(F.struct(F.col("to_id").alias("id"), F.concat(F.lit("<"), "from_module").alias("m")), F.struct(F.col("from_id").alias("id"), F.concat(F.lit(">"), "to_module").alias("m")))).alias("e")).select("e.*").distinct()
    return functions.select("id").join(ends.groupBy("id").agg(F.count(F.lit(1)).alias("bridges")), "id", "left").na.fill(0, ["bridges"])


def hub_findings(bridged: DataFrame, production_functions: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    own = _beyond(bridged, "bridges", t.hub_limits, production_functions)
    return numbered(own, [-F.col("bridges"), F.col("id")], "k").select(*_finding("HubNode", _called("hub", "k"), F.when(F.col("bridges") > F.col("p1"), "High").otherwise("Warning"), "id", "bridges"))


def zone_findings(placed: DataFrame) -> DataFrame:
    """Modules far from the main sequence, in its two corners."""
    own = placed.filter("zone in ('pain', 'uselessness') and distance >= 0.3").filter(~is_non_production_path("module"))
    kind = F.when(F.col("zone") == "pain", "ZoneOfPain").otherwise("ZoneOfUselessness")
    level = F.when((F.col("distance") > 0.7) & (F.col("zone") == "pain"), "High").when(F.col("distance") > 0.5, "Warning").otherwise("Info")
    return numbered(own, [F.col("module")], "k").select(*_finding(kind, _called("zone", "k"), level, "module", "distance"))


def layer_findings(violations: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """With `callee`, the other node that is named."""
    gap = F.col("gap")
    level = F.when(gap >= t.layer_gaps[1], "Critical").when(gap >= t.layer_gaps[0], "High").otherwise("Warning")
    return numbered(violations, [-gap, F.col("from_id"), F.col("to_id")], "k").select(*_finding("LayerViolation", _called("layer", "k"), level, "from_id", gap), F.col("to_id").alias("callee"))


def with_confidence(findings: DataFrame, edges: DataFrame) -> DataFrame:
    """findings with `confidence`: of types that rest on resolved calls Low if there are no imports, High if a language server took part, else Medium; null for other types."""
    tier = edges.agg(F.when(F.count_if(F.col("kind") == "Import") == 0, "Low").when(F.count_if(F.col("source") == "Lsp") > 0, "High").otherwise("Medium").alias("__tier"))
    return findings.join(F.broadcast(tier)).withColumn("confidence", F.when(F.col("type").isin(*RESOLVED_TYPES), F.col("__tier"))).drop("__tier")  # one row


def finding_nodes(findings: DataFrame, layers: DataFrame, found: DataFrame, strong: DataFrame) -> DataFrame:
    """(type, id, severity, node): every node that a finding names."""
    own = findings.filter("type != 'CircularDependency'").select("type", "id", "severity", F.col("primary_node").alias("node"))
    other = layers.select("type", "id", "severity", F.col("callee").alias("node"))
    of_cycles = findings.filter("type = 'CircularDependency'").select("type", "id", "severity", F.col("primary_node").alias("component")).join(strong.select("node", "component"), "component").select("type", "id", "severity", "node")
    return own.unionByName(other).unionByName(of_cycles)


def node_risks(named: DataFrame) -> DataFrame:
    """(node, risk) of finding_nodes: Critical, High, Warning, Info by how many findings of each severity name the node."""
    n = named.groupBy("node").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK])
    c, h, w, i = (F.col(s) for s in SEVERITY_RANK)
    return n.select("node", F.when(c + h >= 2, "Critical").when((c > 0) | (h + w >= 2), "High").when((h > 0) | (w > 0), "Warning").otherwise("Info").alias("risk"))


def module_risks(modules: DataFrame, named: DataFrame) -> DataFrame:
    """(module, risk): the gravest finding that names the module itself; Healthy without any."""
    worst = named.groupBy(F.col("node").alias("module")).agg(F.max(severity_rank("severity")).alias("rank"))
    by_rank = F.lit("Healthy")
    for name, rank in SEVERITY_RANK.items():
        by_rank = F.when(F.col("rank") == rank, name).otherwise(by_rank)
    return modules.select("module").distinct().join(worst, "module", "left").select("module", by_rank.alias("risk"))


def worsening_modules(risks: DataFrame, violations: DataFrame, modules: DataFrame) -> DataFrame:
    """(module): modules at high risk, or with a function whose call skips layers."""
    skipping = violations.select(F.col("from_id").alias("id")).distinct().join(modules, "id").select("module")
    return risks.filter("risk in ('Critical', 'High')").select("module").unionByName(skipping).distinct()


def touched(named: DataFrame, worsening: DataFrame) -> DataFrame:
    """(id): findings one of whose nodes starts with a worsening module's key. Nodes offer their beginnings, so that they meet modules by equality."""
    begins = named.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.length("node")), lambda k: F.substring("node", F.lit(1), k))).alias("module")).filter("module != ''")
    return begins.join(worsening, "module", "left_semi").select("id").distinct()


def ranked(findings: DataFrame, blast: DataFrame, worsening: DataFrame, limit: int = 10) -> DataFrame:
    """(place, id, score): the findings to be taken up first. Ties go to the graver one, then the id. The limit is the feature."""
    marked = findings.join(blast.withColumnRenamed("id", "primary_node"), "primary_node", "left").join(worsening.withColumn("worse", F.lit(True)), "id", "left")
    reach = F.when(F.col("type") == "BlastRadiusHotspot", F.coalesce("blast", F.lit(0))).otherwise(F.lit(0))
    score = severity_rank("severity") * (1 + F.log2(reach + 1)) * F.when(F.col("type") == "TemporalCoupling", TEMPORAL_FACTOR).otherwise(1.0) * F.coalesce(_mapped(F.col("confidence"), CONFIDENCE_FACTOR, 1.0), F.lit(1.0)) * F.when(F.col("worse"), WORSENING_FACTOR).otherwise(1.0)
    top = marked.select("id", severity_rank("severity").alias("rank"), score.alias("score")).orderBy(F.col("score").desc(), F.col("rank").desc(), "id").limit(limit)
    return numbered(top, [-F.col("score"), -F.col("rank"), F.col("id")], "place").select(F.col("place").cast("int").alias("place"), "id", "score")


# Metrics as rows

def metric(df: DataFrame, name: str, value: Column) -> DataFrame:
    """One row (metric, value) of an aggregate over df; 0 where it has none."""
    return df.agg(F.coalesce(value.cast("double"), F.lit(0.0)).alias("value")).select(F.lit(name).alias("metric"), "value")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def non_production_modules(modules: DataFrame, outside: DataFrame, share: float = 0.5) -> DataFrame:
    """(module): by its own path, or because more than share of its members with a classifying file lie in test files."""
    counted = modules.join(outside.filter("class_path is not null").select("id", "in_test_file"), "id", "left").groupBy("module").agg(F.avg(F.col("in_test_file").cast("int")).alias("tests"))
    return counted.filter(is_non_production_path("module") | F.coalesce(F.col("tests") > share, F.lit(False))).select("module")


def coupling_average(coupled: DataFrame, left_out: DataFrame) -> DataFrame:
    """One row: the average score of production modules; of all, if none is one."""
    marked = coupled.select("module", "score").join(left_out.withColumn("out", F.lit(True)), "module", "left")
    return metric(marked, "avg_coupling", F.coalesce(F.avg(F.when(F.col("out").isNull(), F.col("score"))), F.avg("score")))


def fidelity(every: DataFrame, sure: DataFrame) -> DataFrame:
    """(metric, value, high_only, absolute_gap, relative_gap): metrics over all edges beside those over edges of high confidence. The relative gap is null where the value is 0."""
    met = every.join(sure.withColumnRenamed("value", "high_only"), "metric")
    gap = F.col("value") - F.col("high_only")
    return met.select("metric", "value", "high_only", gap.alias("absolute_gap"), F.when(F.abs("value") > 2.220446049250313e-16, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), gap / F.abs("value")))).alias("relative_gap"))


#: The metric behind each part of the score.
PARTS = {
    "cycle_severity": "cycle_ratio", "coupling_health": "avg_coupling", "hotspot_concentration": "hotspot_concentration", "dead_code_ratio": "dead_ratio", "depth_complexity": "max_depth",
    "complexity": "avg_cyclomatic", "cohesion": "avg_cohesion", "distance": "avg_distance", "temporal_coupling": "hidden_ratio",
}


def curve(value: Column, baseline: float = 0.35) -> dict[str, Column]:
    """Each part's score from 0 to 100 of its metric, by fixed curves, whole numbers."""
    cut = lambda c, hi=1.0: F.greatest(F.lit(0.0), F.least(c, F.lit(hi)))
    down = lambda c: 100.0 * (1.0 - c)
    raw = {
        "cycle_severity": 100.0 - cut(value * 500.0, 100.0),
        "coupling_health": down(cut((cut(value) - baseline) / (1.0 - baseline))),
        "hotspot_concentration": down(cut(value)),
        "dead_code_ratio": 100.0 - cut(cut(value) * 300.0, 100.0),
        "depth_complexity": down(cut(value / 30.0)),
        "complexity": down(cut(value / 25.0)),
        "cohesion": cut(value) * 100.0,
        "distance": down(cut(value)),
        "temporal_coupling": down(cut(value)),
    }
    return {k: F.floor(F.greatest(F.lit(0.0), v) + 0.5).cast("int") for k, v in raw.items()}


def score_parts(metrics: DataFrame, with_history: bool = True) -> DataFrame:
    """(part, score, weight) of rows (metric, value). Without history its weight is shared out in proportion."""
    rest = 1 - WEIGHTS["temporal_coupling"]
    weights = WEIGHTS if with_history else {k: w / rest for k, w in WEIGHTS.items() if k != "temporal_coupling"}
    scores = curve(F.col("value"))
    rows = F.array(*[F.when(F.col("metric") == PARTS[k], F.struct(F.lit(k).alias("part"), scores[k].alias("score"), F.lit(w).alias("weight"))) for k, w in weights.items()])
    return metrics.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.*")


def health_score(parts: DataFrame) -> DataFrame:
    """One row (score): the weighted sum of the parts, a whole number."""
    return parts.agg(F.floor(F.sum(F.col("score") * F.col("weight")) + 0.5).cast("int").alias("score"))


def layer_label(depth: Column, deepest: Column) -> Column:
    """entry, controller, service or infrastructure, by depth in relation to the deepest."""
    share = depth / deepest
    return F.when((deepest == 0) | (depth == 0), "entry").when(share <= 0.25, "controller").when(share <= 0.60, "service").otherwise("infrastructure")


def metric_confidence(production: DataFrame, coupled: DataFrame) -> DataFrame:
    """(metric, level): how far depth, blast radius and coupling can be trusted, by how much they rest on."""
    e = production.agg(F.count(F.lit(1)).alias("n"))
    levels = [("depth", F.when(F.col("n") < 5, "Low").when(F.col("n") < 20, "Medium").otherwise("High")), ("blast_radius", F.when(F.col("n") < 5, "Low").otherwise("High"))]
    by_edges = e.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), c.alias("level")) for m, c in levels])).alias("r")).select("r.*")
    by_modules = coupled.agg(F.when(F.count(F.lit(1)) < 3, "Low").otherwise("High").alias("level")).select(F.lit("coupling").alias("metric"), "level")
    return by_edges.unionByName(by_modules)


def module_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(module, coupling_delta, new_violations, new_cycle): modules that got worse between two tables of (module, score, violations, in_cycle)."""
    old = before.select("module", F.col("score").alias("s0"), F.col("violations").alias("v0"), F.col("in_cycle").alias("c0"))
    met = after.join(old, "module", "left")
    out = met.select(
        "module", (F.coalesce("score", F.lit(0.0)) - F.coalesce("s0", F.lit(0.0))).alias("coupling_delta"), F.greatest(F.lit(0), F.coalesce("violations", F.lit(0)) - F.coalesce("v0", F.lit(0))).alias("new_violations"), (F.coalesce("in_cycle", F.lit(False)) & ~F.coalesce("c0", F.lit(False))).alias("new_cycle")
    )
    return out.filter("coupling_delta > 0.05 or new_violations > 0 or new_cycle")
