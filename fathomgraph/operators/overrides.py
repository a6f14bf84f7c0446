"""What a user knows better: files, entry points, module depth and findings, from a JSON file beside a report."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgraph.operators.dead_code import EntryRules

#: What a file may be said to be, with the flags that follow (None: as they are).
FILE_FLAGS = {"test": (True, False, False), "non_production": (True, False, False), "production": (False, False, False), "vendor": (None, True, None), "generated": (None, None, True)}
ENTRY = "mark_as_entry_point"


@dataclass(frozen=True)
class Overrides:
    files: dict[str, str] = field(default_factory=dict)
    entry_ids: tuple[str, ...] = ()
    entry_patterns: tuple[str, ...] = ()
    module_depth: int | None = None
    repo_type: str | None = None
    triage: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Overrides:
        """From JSON; unknown fields are ignored, missing ones empty; of several entries for one file or finding the last counts."""
        doc = json.loads(text)
        entries = lambda name: doc.get(name) or []
        return cls(
            {x["path"]: x["classification"] for x in entries("file_overrides")},
            tuple(x["function_id"].strip().lower() for x in entries("entry_point_overrides") if x["action"] == ENTRY),
            tuple(x["pattern"] for x in entries("entry_point_patterns") if x["action"] == ENTRY),
            (doc.get("module_overrides") or {}).get("analysis_depth"),
            doc.get("repo_type_override"),
            {x["finding_id"]: x["action"] for x in entries("finding_triage")},
        )

    @classmethod
    def load(cls, path: str) -> Overrides:
        """Of a file that is not there, none."""
        return cls.parse(Path(path).read_text()) if Path(path).exists() else cls()

    def save(self, path: str) -> None:
        doc = {
            "file_overrides": [{"path": p, "classification": c} for p, c in sorted(self.files.items())],
            "entry_point_overrides": [{"function_id": i, "action": ENTRY} for i in self.entry_ids],
            "entry_point_patterns": [{"pattern": p, "action": ENTRY} for p in self.entry_patterns],
            "module_overrides": {"analysis_depth": self.module_depth},
            "repo_type_override": self.repo_type,
            "finding_triage": [{"finding_id": i, "action": a} for i, a in sorted(self.triage.items())],
        }
        Path(path).write_text(json.dumps(doc, indent=1))

    def triaged(self, finding: str, action: str) -> Overrides:
        return replace(self, triage={**self.triage, finding: action})

    def entry_rules(self, rules: EntryRules = EntryRules()) -> EntryRules:
        return replace(rules, extra_patterns=rules.extra_patterns + self.entry_patterns)


def with_file_overrides(nodes: DataFrame, overrides: Overrides) -> DataFrame:
    """nodes with the flags of the files that are named by repository path, file path or qualified name. The list is the user's own and small."""
    spark = nodes.sparkSession
    known = [(p, *FILE_FLAGS[c]) for p, c in overrides.files.items() if c in FILE_FLAGS]
    if not known:
        return nodes
    named = F.broadcast(spark.createDataFrame(known, "__path string, __test boolean, __vendor boolean, __generated boolean"))
    files = nodes.filter("kind = 'File'").select("id", F.explode(F.array_distinct(F.array_compact(F.array("path_repo_rel", "file", "fqn")))).alias("__path"))
    hit = files.join(named, "__path").groupBy("id").agg(*[F.max(c).alias(c) for c in ("__test", "__vendor", "__generated")])
    met = nodes.join(hit, "id", "left")
    for flag, c in (("is_test", "__test"), ("is_vendor", "__vendor"), ("is_generated", "__generated")):
        met = met.withColumn(flag, F.coalesce(c, flag))
    return met.select(*nodes.columns)


def without_exempt(dead: DataFrame, overrides: Overrides) -> DataFrame:
    """dead(id, ...) without the functions that the user calls entry points."""
    return dead.filter(~F.col("id").isin(*overrides.entry_ids)) if overrides.entry_ids else dead


def suppressed(spark: SparkSession, overrides: Overrides) -> DataFrame:
    """(id): findings that will not be fixed, or are none. Those only acknowledged stay."""
    return spark.createDataFrame([(i,) for i, a in overrides.triage.items() if a in ("wont_fix", "false_positive")], "id string")
