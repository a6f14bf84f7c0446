"""The code graph: typed nodes and edges from the raw tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgraph.functions.paths import last_name
from fathomgraph.functions.text_ids import CONFIDENCES, SOURCES, clean_id, edge_confidence, edge_kind, edge_source, evidence, json_field, node_kind
from fathomgraph.operators.skew import is_small, let, without
from fathomgraph.plans.shared import kept

REQUIRED = {"nodes": ("id", "kind", "fqn", "location"), "edges": ("from_id", "to_id", "kind")}
#: Names of nodes that stand for a file's own scope.
SYNTHETIC_NAMES = ("__file_scope__", "__file_module__")
FLAGS = ("is_test", "is_vendor", "is_build_output", "is_generated", "is_attribute_invoked", "is_callback_target", "synthetic")
TEXTS = ("path_repo_rel", "role", "visibility", "language")
COUNTS = ("cyclomatic_complexity", "cognitive_complexity")
LISTS = ("import_sources", "entry_points", "frameworks")


def check_columns(df: DataFrame, table: str) -> None:
    missing = [c for c in REQUIRED[table] if c not in df.columns]
    if missing:
        raise ValueError(f"{table} has no column {', '.join(missing)}")


def with_columns(df: DataFrame, **types: str) -> DataFrame:
    """df with null columns for those that it lacks."""
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in types.items() if c not in df.columns])


def _typed(doc: Column, name: str, type_: str, kinds: tuple[str, ...]) -> Column:
    """A field of a JSON document, null unless it has one of the kinds of value."""
    is_kind = F.schema_of_variant(F.try_variant_get(doc, f"$.{name}", "variant")).isin(*kinds)
    return F.when(is_kind, F.try_variant_get(doc, f"$.{name}", type_))


def graph_nodes(nodes: DataFrame) -> DataFrame:
    """One typed row per id: the one recorded last; rows of unknown kinds, and without an id, are left out.

    Properties that are broken or of another type than they should be are null, false or empty.
    """
    check_columns(nodes, "nodes")
    raw = with_columns(nodes, provenance="string", properties="string", trait_metadata="string", recorded_at="timestamp_ntz")
    rows = raw.select(clean_id("id").alias("id"), node_kind("kind").alias("kind"), "fqn", "location", "provenance", "properties", "trait_metadata", "recorded_at").filter("id is not null and kind is not null")
    fields = ("recorded_at", "kind", "fqn", "location", "provenance", "properties", "trait_metadata")
    last = rows.groupBy("id").agg(F.max(F.struct(*fields)).alias("r")).select("id", "r.*")
    doc = F.try_parse_json("properties")
    place = F.from_json("location", "struct<file:string,start_line:int,end_line:int>")
    name = last_name("fqn")
    typed = last.select(
        "id",
        "kind",
        "fqn",
        name.alias("name"),
        F.nullif(place["file"], F.lit("")).alias("file"),
        place["start_line"].alias("start_line"),
        place["end_line"].alias("end_line"),
        edge_source("provenance").alias("source"),
        edge_confidence("provenance").alias("confidence"),
        json_field("trait_metadata", "trait_name").isNotNull().alias("is_trait_impl"),
        *[_typed(doc, c, "string", ("STRING",)).alias(c) for c in TEXTS[:-1]],
        F.lower(_typed(doc, "language", "string", ("STRING",))).alias("language"),
        *[_typed(doc, c, "int", ("BIGINT",)).alias(c) for c in COUNTS],
        *[F.coalesce(_typed(doc, c, "boolean", ("BOOLEAN",)), F.lit(False)).alias(c) for c in FLAGS],
        *[F.coalesce(_typed(doc, c, "array<string>", ("ARRAY<STRING>",)), F.array().cast("array<string>")).alias(c) for c in LISTS],
        "recorded_at",
    )
    scope = F.col("name").isin(*SYNTHETIC_NAMES)
    return typed.withColumn("synthetic", F.col("synthetic") | F.coalesce(scope, F.lit(False)))


NO_TIME = -(1 << 58)
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _micros(df: DataFrame, column: str) -> Column:
    """Microseconds of a time, as it stands in its own zone; null times come before all others."""
    if dict(df.dtypes)[column] == "timestamp":
        return F.coalesce(F.unix_micros(column), F.lit(NO_TIME))
    seconds = F.expr(f"cast(cast(cast({column} as timestamp_ntz) - {EPOCH} as interval second) as decimal(18, 6))")
    return F.coalesce((seconds * 1_000_000).cast("bigint"), F.lit(NO_TIME))


def _ranked(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in sorted((*values, "Unknown"))])


def typed_kinds(edges: DataFrame) -> DataFrame:
    """edges with `edge_kind` (null if unknown) and `evidence` (four times the rank of the source, and the rank of the confidence, by name).

    Kinds and evidence come in few spellings, so each distinct spelling is parsed once and looked up by its text; where they are too many
    to be broadcast, each row is parsed.
    """
    by_rank = lambda c, values: F.array_position(_ranked(values), c) - 1
    number = let(evidence("provenance"), lambda e: (by_rank(e["source"], SOURCES) * 4 + by_rank(e["confidence"], CONFIDENCES)).cast("int"))
    spellings = kept(edges.select("kind", "provenance").distinct())
    parsed = [edge_kind("kind").alias("edge_kind"), number.alias("evidence")]
    if not is_small(spellings):
        return edges.select("*", *parsed)
    known = kept(spellings.select(F.col("kind").alias("__kind"), F.col("provenance").alias("__provenance"), *parsed))
    met = edges.join(F.broadcast(known), F.col("kind").eqNullSafe(F.col("__kind")) & F.col("provenance").eqNullSafe(F.col("__provenance")), "left")
    return met.drop("__kind", "__provenance")


def raw_edges(edges: DataFrame) -> DataFrame:
    """One row per (from_id, to_id, kind): the one recorded last; kind is null where it is unknown. Edges without an endpoint are left out.

    Time and evidence are one number, so that the last row is found by partial maxima without a sort. At equal times the greater evidence counts.
    """
    check_columns(edges, "edges")
    raw = with_columns(edges, provenance="string", recorded_at="timestamp_ntz").select("from_id", "to_id", F.col("kind").cast("string").alias("kind"), F.col("provenance").cast("string").alias("provenance"), "recorded_at")
    rows = typed_kinds(raw).select(
        clean_id("from_id").alias("from_id"),
        clean_id("to_id").alias("to_id"),
        F.col("edge_kind").alias("kind"),
        (_micros(raw, "recorded_at") * 16 + F.col("evidence")).alias("v"),
    ).filter("from_id is not null and to_id is not null")
    last = rows.groupBy("from_id", "to_id", "kind").agg(F.max("v").alias("v"))
    code, micros = F.col("v").bitwiseAND(F.lit(15)).cast("int"), F.shiftright("v", 4)
    at = F.expr(f"{EPOCH} + make_dt_interval(0, 0, 0, cast(shiftright(v, 4) * 0.000001BD as decimal(18, 6)))")
    return last.select(
        "from_id", "to_id", "kind", F.get(_ranked(SOURCES), F.shiftright(code, 2)).alias("source"), F.get(_ranked(CONFIDENCES), code.bitwiseAND(F.lit(3))).alias("confidence"), F.when(micros != NO_TIME, at).alias("recorded_at")
    )


def graph_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_id, to_id, kind, source, confidence, recorded_at) of known kinds whose two ends are rows of graph_nodes.

    The distinct ends without a node are found first; edges meet those alone, so that a much-used end is never moved as often as it is used.
    """
    known = kept(raw_edges(edges).filter("kind is not null"))
    ends = known.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    return without(known, ends.join(nodes.select("id"), "id", "left_anti"), ["from_id", "to_id"]).select("from_id", "to_id", "kind", "source", "confidence", "recorded_at")


def unknown_edge_kinds(edges: DataFrame) -> DataFrame:
    """(kind_text, n): rows of edges whose kind is unknown, by the kind's own text."""
    return edges.filter(edge_kind("kind").isNull()).groupBy(F.col("kind").alias("kind_text")).agg(F.count(F.lit(1)).alias("n"))


CALL_LIKE = ("Call", "Framework:VisualforcePage", "Declarative:Flow")
INHERITANCE = ("Extends", "Implements")
DEPENDENCY = ("Import", "Type", "Uses")


def is_structural(kind: Column | str = "kind") -> Column:
    return (F.col(kind) if isinstance(kind, str) else kind) != "Contains"


def is_call_like(kind: Column | str = "kind") -> Column:
    return (F.col(kind) if isinstance(kind, str) else kind).isin(*CALL_LIKE)
