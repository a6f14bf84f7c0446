"""Paths, qualified names and evidence, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What makes a path a test, auxiliary or configuration path.
TEST_DIRS = ("__tests__", "__test__", "__mocks__")
TEST_MARKS = (".test.", ".spec.", "_test.", ".tests.")
TEST_WORDS = ("test", "tests", "spec", "specs")
AUXILIARY_WORDS = (
    "example", "examples", "benchmark", "benchmarks", "bench", "benches", "fixture", "fixtures", "mock", "mocks", "stub", "stubs",
    "demo", "demos", "sample", "samples", "docs", "doc", "e2e", "testdata", "perf", "performance", "scripts",
)
TOOLING_PREFIXES = (".vitest", ".jest", ".storybook", ".husky", ".cypress", ".playwright", ".nyc", ".coverage")
CONFIG_ENDINGS = ("js", "ts", "json", "yaml", "yml", "toml")
CONFIG_FILES = (
    "tsconfig.json", "jsconfig.json", "package.json", "package-lock.json", "gruntfile.js", "gulpfile.js", "rollup.config.js", "webpack.config.js",
    "babel.config.js", "postcss.config.js", "tailwind.config.js", "karma.conf.js",
)
ROLE_WORDS = (("example", ("example", "examples")), ("benchmark", ("bench", "benches", "benchmark", "benchmarks")), ("fixture", ("fixture", "fixtures")), ("fixture", ("mock", "mocks", "stub", "stubs")), ("docs", ("docs", "doc")))
#: Source directories that builds prescribe, in the order in which they are tried.
BUILD_DIRS = ("src/main/java", "src/test/java", "src/main/kotlin", "src/test/kotlin", "src/main/resources", "src/test/resources", "src/main/scala", "src/test/scala")


def _any(words: tuple[str, ...]) -> str:
    return "(" + "|".join(w.replace(".", r"\.") for w in words) + ")"


def _delimited(words: tuple[str, ...]) -> str:
    """A word between ends of a path component, or `-`, `_`, `.`."""
    return rf"(^|[-_./]){_any(words)}($|[-_./])"


TEST_PATH = "|".join([_any(TEST_DIRS), rf"{_any(TEST_MARKS)}[^/]*$", r"(^|/)test_[^/]*$", _delimited(TEST_WORDS)])
AUXILIARY_PATH = "|".join([rf"(^|/){_any(TOOLING_PREFIXES)}(\.[^/]*)?($|/)", _delimited(AUXILIARY_WORDS)])
CONFIG_PATH = "|".join([rf"(^|/)\.([^/]*\.)?{_any(CONFIG_ENDINGS)}$", r"\.config\.[^/]*$", rf"(^|/){_any(CONFIG_FILES)}$"])
NON_PRODUCTION_PATH = "|".join([TEST_PATH, AUXILIARY_PATH, CONFIG_PATH])


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lowered(path: Column | str) -> Column:
    return F.lower(F.translate(_col(path), "\\", "/"))


def is_test_path(path: Column | str) -> Column:
    return lowered(path).rlike(TEST_PATH)


def is_auxiliary_path(path: Column | str) -> Column:
    return lowered(path).rlike(AUXILIARY_PATH)


def is_config_path(path: Column | str) -> Column:
    return lowered(path).rlike(CONFIG_PATH)


def is_non_production_path(path: Column | str) -> Column:
    """Every way to match begins at the path's start or at one of `-_./`, so no other place is tried."""
    return lowered(path).rlike(rf"(?:^|(?=[-_./]))(?:{NON_PRODUCTION_PATH})")


def path_role(path: Column | str) -> Column:
    """test, config, example, benchmark, fixture, docs, auxiliary, or null for production paths.

    Among auxiliary paths the first component that tells a role decides.
    """
    def role(component: Column) -> Column:
        tests = [(component.rlike(_delimited(words)), name) for name, words in ROLE_WORDS]
        tests.append((component.rlike(rf"^{_any(TOOLING_PREFIXES)}(\..*)?$"), "config"))
        out = F.when(tests[0][0], tests[0][1])
        for test, name in tests[1:]:
            out = out.when(test, name)
        return out

    roles = F.filter(F.transform(F.split(lowered(path), "/"), role), lambda r: r.isNotNull())
    return F.when(is_test_path(path), "test").when(is_config_path(path), "config").when(is_auxiliary_path(path), F.coalesce(F.get(roles, F.lit(0)), F.lit("auxiliary")))


def last_name(fqn: Column | str) -> Column:
    return F.element_at(F.split(_col(fqn), "::"), -1)


def display_name(fqn: Column | str) -> Column:
    """The last two segments of a qualified name."""
    parts = F.split(_col(fqn), "::")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, -2, 2), "::")).otherwise(_col(fqn))


def folder_key(path: Column | str, depth: int) -> Column:
    """The first `depth` folders of a path, without a last segment that holds a dot; '.' for a file of the root; null for an empty path."""
    parts = F.filter(F.split(_col(path), "/"), lambda p: p != "")
    folders = F.when(F.element_at(parts, -1).contains("."), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    kept = F.array_join(F.slice(folders, 1, depth), "/")
    return F.when(F.size(parts) == 0, F.lit(None)).when(kept == "", ".").otherwise(kept)


def without_build_dirs(path: Column | str) -> Column:
    """The path without the first of BUILD_DIRS, in their order, that it holds as whole components."""
    out = _col(path)
    chain = None
    for d in BUILD_DIRS:
        hit = _col(path).rlike(rf"(^|/){d}(/|$)")
        cut = F.regexp_replace(_col(path), rf"^(.*?)(^|/){d}(/|$)", "$1$2")
        chain = F.when(hit, cut) if chain is None else chain.when(hit, cut)
    return chain.otherwise(out)


def normal_path(path: Column | str) -> Column:
    return F.regexp_replace(F.translate(_col(path), "\\", "/"), r"^\./", "")


def evidence_tier(source: Column | str) -> Column:
    """tier_0 for syntax, tier_1 for heuristics, tier_3 for the language server; else null."""
    return F.when(_col(source) == "TreeSitter", "tier_0").when(_col(source) == "Heuristic", "tier_1").when(_col(source) == "Lsp", "tier_3")


def tier_rank(tier: Column | str) -> Column:
    """3 for tier_3, 2 for tier_0, 1 for tier_1, 0 for none: the order in which evidence is preferred."""
    t = _col(tier)
    return F.when(t == "tier_3", 3).when(t == "tier_0", 2).when(t == "tier_1", 1).otherwise(0)


def ranked_tier(rank: Column | str) -> Column:
    r = _col(rank)
    return F.when(r == 3, "tier_3").when(r == 2, "tier_0").when(r == 1, "tier_1")


#: Files by which frameworks are recognised.
DJANGO_FILES = ("views.py", "urls.py", "models.py", "admin.py", "forms.py", "apps.py", "settings.py", "middleware.py")
CELERY_FILES = ("tasks.py", "celery.py", "celery_app.py")


def frameworks_of(path: Column | str, language: Column | str) -> Column:
    """The sorted frameworks that a file's name tells, or plain."""
    name, python = F.element_at(F.split(lowered(path), "/"), -1), F.lower(_col(language)) == "python"
    harness = lambda runner: name.rlike(rf"^{runner}\.(setup|config)\.(js|ts|mjs|cjs)$")
    tests = [("celery", python & name.isin(*CELERY_FILES)), ("django", python & name.isin(*DJANGO_FILES)), ("jest", harness("jest")), ("vitest", harness("vitest"))]
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), tag) for tag, test in tests]))
    return F.when(F.size(found) == 0, F.array(F.lit("plain"))).otherwise(found)
