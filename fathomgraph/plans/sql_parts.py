"""Pieces of SQL that the oracle queries share."""

from __future__ import annotations

from fathomgraph.functions.text_ids import CONFIDENCES, EDGE_KINDS, NODE_KINDS, SOURCES


def sql_id(c: str) -> str:
    return f"nullif(lower(trim({c})), '')"


def _case(expr: str, names: dict[str, str], other: str = "NULL") -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {other} END"


def sql_json(c: str, field: str) -> str:
    return f"json_extract_string(try_cast({c} AS JSON), '$.{field}')"


def sql_edge_kind(c: str) -> str:
    spelled = f"CASE WHEN trim({c}) LIKE '{{%' THEN lower(trim({sql_json(c, 'kind')})) || coalesce(':' || lower(trim({sql_json(c, 'sub')})), '') ELSE lower(trim({c})) END"
    return _case(f"({spelled})", EDGE_KINDS)


def sql_node_kind(c: str) -> str:
    return _case(f"lower(trim({c}))", {k.lower(): k for k in NODE_KINDS})


def sql_source(c: str) -> str:
    return _case(f"lower(trim({sql_json(c, 'source')}))", {k.lower(): k for k in SOURCES}, "'Unknown'")


def sql_confidence(c: str) -> str:
    return _case(f"lower(trim({sql_json(c, 'confidence')}))", {k.lower(): k for k in CONFIDENCES}, "'Unknown'")
