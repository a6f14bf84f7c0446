"""Ids and the JSON columns of the graph tables, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The nine edge kinds, lower-cased with their sub, and how they are written.
EDGE_KINDS = {
    "call": "Call",
    "import": "Import",
    "uses": "Uses",
    "type": "Type",
    "extends": "Extends",
    "implements": "Implements",
    "contains": "Contains",
    "framework:visualforcepage": "Framework:VisualforcePage",
    "declarative:flow": "Declarative:Flow",
}
#: The twelve node kinds.
NODE_KINDS = ("Function", "Struct", "Module", "Interface", "Enum", "Variable", "Type", "Import", "Project", "Crate", "File", "Folder")
#: Spellings of where an edge comes from and how sure it is.
SOURCES = ("TreeSitter", "Lsp", "Heuristic")
CONFIDENCES = ("High", "Medium", "Low")

BLANKS = " \t\r\n\f\u000b "


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(BLANKS))


def clean_id(c: Column | str) -> Column:
    """Trimmed and lower-cased id; null where it is null or blank."""
    s = F.lower(stripped(c))
    return F.when(s != "", s)


def _one_of(lowered: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(table, lowered)


def json_field(c: Column | str, name: str) -> Column:
    """Text of a JSON object's field; null if the object is broken, or the field is missing or null."""
    return F.get_json_object(_col(c), f"$.{name}")


def edge_kind(c: Column | str) -> Column:
    """`Call`, `Framework:VisualforcePage`, ...; null for any kind that is unknown, broken or null."""
    c = _col(c)
    body = stripped(c)
    parsed = F.from_json(body, "struct<kind:string,sub:string>")
    spelled = F.when(
        body.startswith("{"),
        F.concat(F.lower(stripped(parsed["kind"])), F.coalesce(F.concat(F.lit(":"), F.lower(stripped(parsed["sub"]))), F.lit(""))),
    ).otherwise(F.lower(body))
    return _one_of(spelled, EDGE_KINDS)


def maybe_kind(c: Column | str, name: str) -> Column:
    """A cheap test that lets every spelling of the kind pass, before the JSON is parsed."""
    c = _col(c)
    return F.lower(c).contains(name.lower()) | c.contains("\\")


def node_kind(c: Column | str) -> Column:
    """Node kind as usually written, whatever its letter case; null if unknown."""
    return _one_of(F.lower(stripped(c)), {k.lower(): k for k in NODE_KINDS})


def edge_source(c: Column | str) -> Column:
    return F.coalesce(_one_of(F.lower(stripped(json_field(c, "source"))), {k.lower(): k for k in SOURCES}), F.lit("Unknown"))


def edge_confidence(c: Column | str) -> Column:
    return F.coalesce(_one_of(F.lower(stripped(json_field(c, "confidence"))), {k.lower(): k for k in CONFIDENCES}), F.lit("Unknown"))


def evidence(c: Column | str) -> Column:
    """Struct of edge_source and edge_confidence, by one parse of the JSON."""
    doc = F.from_json(_col(c), "struct<source:string,confidence:string>")
    known = lambda name, values: F.coalesce(_one_of(F.lower(stripped(doc[name])), {v.lower(): v for v in values}), F.lit("Unknown")).alias(name)
    return F.struct(known("source", SOURCES), known("confidence", CONFIDENCES))
