"""How far results can be trusted: degraded resolution, metric statuses, downgrades, budgets, normal bodies."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from fathomgraph.functions.paths import is_non_production_path, is_test_path
from fathomgraph.operators.skew import running_sums

#: Rates from which resolution counts as degraded, and edges and modules that metrics need at least.
DEGRADED = ((0.50, "Critical"), (0.25, "High"), (0.10, "Warning"))
MIN_EDGES, MIN_CALLS, MIN_MODULES = 50, 20, 3
#: Imports that mark a test file, by language: whole names, and beginnings of names.
_JS_EXACT = (
    "jest", "@jest/globals", "vitest", "mocha", "chai", "sinon", "cypress", "supertest", "nock", "msw", "jest-mock-extended", "expect", "node:test",
    "node:assert", "ava", "tap", "tape", "@playwright/test",
)
_JAVA_EXACT = ("org.junit.Test", "org.junit.Assert", "org.junit.jupiter.api.Test", "org.testng.annotations.Test")
_JS_PREFIXES = ("@testing-library/", "@jest/")
_JAVA_PREFIXES = ("org.junit.", "junit.", "org.testng.", "org.mockito.", "org.assertj.", "org.hamcrest.", "io.mockk.", "org.springframework.boot.test.", "org.springframework.test.")
TEST_IMPORTS = {
    "typescript": _JS_EXACT,
    "javascript": _JS_EXACT,
    "python": ("pytest", "unittest", "unittest.mock", "mock", "nose", "nose2", "hypothesis", "responses", "httpretty", "factory_boy", "faker", "freezegun", "pytest_mock"),
    "go": (
        "testing", "github.com/stretchr/testify", "github.com/stretchr/testify/assert", "github.com/stretchr/testify/require",
        "github.com/stretchr/testify/suite", "github.com/stretchr/testify/mock", "github.com/onsi/ginkgo", "github.com/onsi/gomega",
    ),
    "java": _JAVA_EXACT,
    "kotlin": _JAVA_EXACT,
    "csharp": ("Xunit", "Moq", "FluentAssertions", "NSubstitute", "Shouldly", "Microsoft.VisualStudio.TestTools.UnitTesting"),
    "ruby": ("rspec", "minitest", "test-unit"),
    "swift": ("XCTest",),
}
TEST_IMPORT_PREFIXES = {
    "typescript": _JS_PREFIXES, "javascript": _JS_PREFIXES, "python": ("pytest.", "unittest."), "java": _JAVA_PREFIXES, "kotlin": _JAVA_PREFIXES,
    "csharp": ("Xunit.", "NUnit."), "ruby": ("rspec/", "minitest/"),
}


def resolution_quality(edges: DataFrame, by: str = "kind", drops: DataFrame | None = None) -> DataFrame:
    """(by, language_server, heuristic[, dropped], rate, level): edges found by heuristics, and sites dropped as ambiguous, among all that asked for a target; null where there are none.

    drops(by, dropped), if given, are counts of sites that named several targets and got no edge.
    """
    n = edges.groupBy(by).agg(F.count_if(F.col("source") == "Lsp").alias("language_server"), F.count_if(F.col("source") == "Heuristic").alias("heuristic"))
    n = n.withColumn("dropped", F.lit(0).cast("bigint")) if drops is None else n.join(drops, by, "full_outer").na.fill(0, ["language_server", "heuristic", "dropped"])
    total = F.col("language_server") + F.col("heuristic") + F.col("dropped")
    rate = F.when(total > 0, (F.col("heuristic") + F.col("dropped")) / total)
    level = None
    for least, name in DEGRADED:
        level = F.when(rate >= least, name) if level is None else level.when(rate >= least, name)
    return n.select(by, "language_server", "heuristic", *(["dropped"] if drops is not None else []), rate.alias("rate"), level.alias("level"))


def metric_status(production: DataFrame, modules: DataFrame) -> DataFrame:
    """One row (edges, calls, modules, cycle_status, depth_status, module_status): Ok, or why a metric says little."""
    from fathomgraph.sources.graph import is_call_like

    e = production.agg(F.count(F.lit(1)).alias("edges"), F.count_if(is_call_like()).alias("calls"))
    m = modules.agg(F.count_distinct("module").alias("modules"))
    few = lambda c, n: F.when(F.col(c) < n, "InsufficientEdges").otherwise("Ok")
    return e.join(m).select("edges", "calls", "modules", few("edges", MIN_EDGES).alias("cycle_status"), few("calls", MIN_CALLS).alias("depth_status"), F.when(F.col("modules") < MIN_MODULES, "NotApplicable").otherwise("Ok").alias("module_status"))  # one row each


def downgraded_by_churn(dead: DataFrame, churn: DataFrame, days: int = 30) -> DataFrame:
    """dead(id, file, confidence) with High lowered to Medium where the file was touched within days."""
    recent = churn.select("file", (F.col("last_touched_days") < days).alias("__recent"))
    return dead.join(recent, "file", "left").withColumn("confidence", F.when(F.coalesce("__recent", F.lit(False)) & (F.col("confidence") == "High"), "Medium").otherwise(F.col("confidence"))).select(*dead.columns)


def downgraded_by_gaps(dead: DataFrame, coverage: DataFrame) -> DataFrame:
    """dead(id, file, reason, confidence) with no_callers lowered to Low where coverage(file, gaps) tells of gaps in the file's extraction."""
    gaps = coverage.groupBy("file").agg(F.max(F.size("gaps")).alias("__gaps"))
    low = (F.col("reason") == "no_callers") & (F.coalesce("__gaps", F.lit(0)) > 0)
    return dead.join(gaps, "file", "left").withColumn("confidence", F.when(low, "Low").otherwise(F.col("confidence"))).select(*dead.columns)


def within_budget(rows: DataFrame, by: str, order: str, text: str, budget: int) -> DataFrame:
    """(by, order, tokens): the first rows of each `by` that fit a budget of tokens, four characters each. The budget is the feature."""
    tokens = F.ceil(F.length(F.coalesce(F.col(text), F.lit(""))) / 4)
    return running_sums(rows.select(by, order, tokens.alias("tokens")), [by], [order], "tokens", "through").filter(F.col("through") <= budget).drop("through")


def imports_test_framework(imports: Column, language: Column) -> Column:
    """Whether any of an array of imports, quotes stripped, is a test framework of the language, or begins as one. Rust's tests need no import."""
    def any_of(whole: tuple[str, ...], begins: tuple[str, ...]) -> Column:
        plain = F.transform(imports, lambda i: F.btrim(F.btrim(i, F.lit('"')), F.lit("'")))
        hit = F.exists(plain, lambda i: i.isin(*whole))
        if begins:
            hit = hit | F.exists(plain, lambda i: i.rlike("^(" + "|".join(re.escape(p) for p in begins) + ")"))
        return F.coalesce(hit, F.lit(False))

    out = F.lit(False)
    for name, whole in TEST_IMPORTS.items():
        out = F.when(F.lower(language) == name, any_of(whole, TEST_IMPORT_PREFIXES.get(name, ()))).otherwise(out)
    return out


_STRINGS = r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`"
_HASH = re.compile(rf"(?s)(\"\"\".*?\"\"\"|'''.*?'''|{_STRINGS})|#[^\n]*|(\s+)")
_SLASH = re.compile(rf"(?s)({_STRINGS})|//[^\n]*|/\*.*?\*/|(\s+)")


def normal_body(text: str | None, language: str | None) -> str | None:
    """A body without comments, and with single blanks outside of string literals."""
    if text is None:
        return None
    parts, at, blank = [], 0, True  # blank: a blank would be one too many
    for m in (_HASH if language in ("python", "ruby", "shell") else _SLASH).finditer(text):
        code, string = text[at : m.start()], m.group(1)
        blank = blank and not code
        parts += [code, string] if string else [code, "" if blank else " "]
        blank, at = not string, m.end()
    return "".join([*parts, text[at:]]).strip()


@pandas_udf(StringType())
def normal_bodies(texts: pd.Series, languages: pd.Series) -> pd.Series:
    return pd.Series([normal_body(t, g) for t, g in zip(texts, languages)], dtype=object)


def test_framework_files(nodes: DataFrame) -> DataFrame:
    """(id): the files that import a test framework of their language."""
    return nodes.filter("kind = 'File'").filter(imports_test_framework(F.col("import_sources"), F.col("language"))).select("id")


def classified_files(files: DataFrame, by_import: DataFrame, by_importers: DataFrame) -> DataFrame:
    """(id, tier) of files(id, path, imports): 1 by imports of a test framework, 2 by importers that are all tests, 4 by a test path beside a file of tier 1, without imports; 0 for none.

    by_import(id) and by_importers(id) name the files of the first two.
    """
    folder = F.regexp_replace("path", "/[^/]*$", "")
    first = files.join(by_import.select("id").withColumn("one", F.lit(True)), "id", "left").join(by_importers.select("id").withColumn("two", F.lit(True)), "id", "left").withColumn("folder", folder)
    beside = first.filter("one").select("folder").distinct().withColumn("near", F.lit(True))
    met = first.join(beside, "folder", "left")
    tier = F.when(F.col("one"), 1).when(F.col("two"), 2).when(F.coalesce(is_test_path("path"), F.lit(False)) & F.col("near") & (F.size("imports") == 0), 4).otherwise(0)
    return met.select("id", tier.alias("tier"))


def module_kinds(members: DataFrame, production_paths: tuple[str, ...] = (), other_paths: tuple[str, ...] = ()) -> DataFrame:
    """(module, kind, reason) of members(module, is_test): by the user's path beginnings, else the module's own path, else if most of its members are tests, else production."""
    counted = members.groupBy("module").agg(F.avg(F.col("is_test").cast("int")).alias("share"))
    begins = lambda paths: F.lit(False) if not paths else F.col("module").rlike("^(" + "|".join(re.escape(p) for p in paths) + ")")
    chain = [(begins(production_paths), "production", "override"), (begins(other_paths), "non_production", "override"), (is_non_production_path("module"), "non_production", "path"), (F.col("share") > 0.5, "non_production", "tests")]
    kind, reason = F.lit("production"), F.lit("default")
    for test, k, r in reversed(chain):
        kind, reason = F.when(test, k).otherwise(kind), F.when(test, r).otherwise(reason)
    return counted.select("module", kind.alias("kind"), reason.alias("reason"))


def majority_language(files: DataFrame, least: float = 0.6) -> DataFrame:
    """One row (language, files, share, is_majority) of files(language): the most used language, ties by name; no rows without any."""
    counts = files.filter("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("files"))
    total = counts.agg(F.sum("files").alias("n"))
    top = counts.orderBy(F.col("files").desc(), "language").limit(1)
    return top.join(F.broadcast(total)).select("language", "files", (F.col("files") / F.col("n")).alias("share"), (F.col("files") / F.col("n") >= least).alias("is_majority"))  # one row
