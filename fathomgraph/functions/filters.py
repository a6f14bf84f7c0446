"""The filter language of template queries: clauses joined by `and`, as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomgraph.functions.text_ids import EDGE_KINDS, NODE_KINDS

FLAGS = ("is_vendor", "is_build_output", "is_generated", "is_test")
#: Other names by which kinds may be asked for.
NODE_ALIASES = {"method": "Function", "trait": "Interface"}
EDGE_ALIASES = {"calls": "Call", "imports": "Import", "types": "Type", "framework": "Framework:VisualforcePage", "declarative": "Declarative:Flow"}
_TOKEN = re.compile(r"\s*(?:(?P<text>'[^']*'|\"[^\"]*\")|(?P<sign>==|\[|\]|,)|(?P<word>[A-Za-z_][\w.]*))")
_FORBIDDEN = ("or", "not")


class FilterError(ValueError):
    pass


@dataclass
class NodeFilter:
    kinds: list[str] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    flags: dict[str, bool] = field(default_factory=dict)
    prefixes: list[str] = field(default_factory=list)

    def column(self, pattern: bool = False) -> Column:
        """Kinds and roles are alternatives each; everything else must hold. Missing flags count as false.

        pattern: beginnings of paths are SQL patterns without letter case, in which `_` and `%` stand for any sign and any signs; else they are literal.
        """
        out = F.lit(True)
        if self.kinds:
            out = out & F.col("kind").isin(*self.kinds)
        if self.roles:
            out = out & F.coalesce(F.col("role").isin(*self.roles), F.lit(False))
        for name, want in self.flags.items():
            out = out & (F.coalesce(F.col(name), F.lit(False)) == want)
        for prefix in self.prefixes:
            begins = F.col("path_repo_rel").ilike(prefix.replace("\\", "\\\\") + "%") if pattern else F.startswith("path_repo_rel", F.lit(prefix))
            out = out & F.coalesce(begins, F.lit(False))
        return out


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise FilterError(f"not understood: {text[at:].strip()[:20]}")
        kind = m.lastgroup
        value = m[kind]
        if kind == "word" and value.lower() in _FORBIDDEN:
            raise FilterError(f"{value} is not supported")
        out.append((kind, value[1:-1] if kind == "text" else value))
        at = m.end()
    return out


def _clauses(text: str) -> list[tuple[str, str, list[str]]]:
    """(field, operator, values) of each clause."""
    tokens, out = _tokens(text), []
    while tokens:
        if len(tokens) < 3 or tokens[0][0] != "word":
            raise FilterError("a clause needs a field, an operator and a value")
        name, op, rest = tokens[0][1], tokens[1][1].lower(), tokens[2:]
        if op == "in":
            end = next((i for i, t in enumerate(rest) if t == ("sign", "]")), None)
            if rest[0] != ("sign", "[") or end is None:
                raise FilterError("in needs a list in brackets")
            inside, rest = rest[1:end], rest[end + 1 :]
            values = [v for k, v in inside if k == "text"]
            if not values or len(values) * 2 - 1 != len(inside):
                raise FilterError("a list needs quoted values between commas")
        elif op in ("==", "starts_with"):
            values, rest = [rest[0][1]], rest[1:]
        else:
            raise FilterError(f"no operator: {op}")
        out.append((name, op, values))
        if rest:
            if rest[0][0] != "word" or rest[0][1].lower() != "and" or len(rest) == 1:
                raise FilterError("clauses are joined by and")
            rest = rest[1:]
        tokens = rest
    return out


def node_kind_named(text: str) -> str:
    low = text.strip().lower()
    names = {k.lower(): k for k in NODE_KINDS} | NODE_ALIASES
    if low not in names:
        raise FilterError(f"no kind of node: {text}")
    return names[low]


def edge_kind_named(text: str) -> str:
    low = text.strip().lower()
    names = EDGE_KINDS | EDGE_ALIASES
    if low not in names:
        raise FilterError(f"no kind of edge: {text}")
    return names[low]


def parse_node_filter(text: str) -> NodeFilter:
    out = NodeFilter()
    for name, op, values in _clauses(text):
        if name in ("kind", "label", "node_type") and op in ("==", "in"):
            out.kinds = sorted({*out.kinds, *map(node_kind_named, values)})
        elif name == "role" and op in ("==", "in"):
            out.roles = sorted({*out.roles, *values})
        elif name in FLAGS and op == "==" and values[0].lower() in ("true", "false"):
            out.flags[name] = values[0].lower() == "true"
        elif name == "path_repo_rel" and op == "starts_with":
            out.prefixes.append(values[0])
        else:
            raise FilterError(f"{name} {op} is not supported")
    return out


def parse_edge_filter(text: str) -> list[str]:
    """The kinds of edges asked for."""
    kinds: set[str] = set()
    for name, op, values in _clauses(text):
        if name not in ("rel", "kind") or op not in ("==", "in"):
            raise FilterError(f"{name} {op} is not supported")
        kinds.update(map(edge_kind_named, values))
    return sorted(kinds)
