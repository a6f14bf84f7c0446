"""Commit history and other files as tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgraph.functions.paths import is_auxiliary_path, is_test_path

#: Endings of source files.
SOURCE_ENDINGS = ("rs", "py", "ts", "tsx", "js", "jsx", "java", "go", "cs", "cls", "trigger", "kt", "scala")


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(commit, author, committed_at, file) from files of `git log --name-only --format='commit %H%x09%an%x09%at'`.

    A record starts at each `commit ` line, so large logs split at records and not at files. Merges list no files and give no rows.
    """
    raw = spark.read.option("lineSep", "\ncommit ").text(path).select(F.regexp_replace("value", "^commit ", "").alias("r"))
    lines = raw.select(F.split("r", "\n").alias("l"))
    head = F.split(F.col("l")[0], "\t")
    rows = lines.select(F.trim(head[0]).alias("commit"), F.get(head, F.lit(1)).alias("author"), F.timestamp_seconds(F.get(head, F.lit(2)).cast("bigint")).alias("committed_at"), F.explode(F.slice("l", 2, 1 << 30)).alias("file"))
    return rows.filter("file != '' and commit != ''")


def source_commits(commits: DataFrame) -> DataFrame:
    """The rows of commits whose file is source and neither test nor auxiliary."""
    path = F.col("file")
    return commits.filter(F.lower(F.element_at(F.split(path, r"\."), -1)).isin(*SOURCE_ENDINGS) & ~is_test_path(path) & ~is_auxiliary_path(path))


def repo_shape(root: str) -> str:
    """full, shallow, bare or none: what kind of repository lies at root. A `.git` that is a file (a worktree) counts as full."""
    at = Path(root)
    if (at / ".git").exists():
        return "shallow" if (at / ".git" / "shallow").exists() else "full"
    return "bare" if (at / "HEAD").exists() and (at / "objects").is_dir() and (at / "refs").is_dir() else "none"


#: Folders that hold no source of the project's own.
EXCLUDED_FOLDERS = (
    "node_modules", ".git", ".hg", ".svn", "vendor", "third_party", "third-party", "dist", "build", "out", ".build", ".next", ".nuxt", ".output",
    ".cache", ".parcel-cache", ".wrangler", ".astro", "archive", "__pycache__", ".tox", ".venv", "venv", "env", ".env", "target", "Pods", "Carthage",
    ".gradle", ".idea", ".vs", ".vscode", "coverage", ".nyc_output", "bower_components",
)


def source_files(spark: SparkSession, root: str, endings: tuple[str, ...] = SOURCE_ENDINGS, excluded: tuple[str, ...] = EXCLUDED_FOLDERS) -> DataFrame:
    """(path, size, content) of the source files below root, outside of excluded folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inside = F.expr(f"substring_index(path, {json.dumps(root.rstrip('/'))}, -1)")
    files = files.filter(~F.arrays_overlap(F.split(inside, "/"), F.array(*[F.lit(x) for x in excluded])) if excluded else F.lit(True))
    return files.filter(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*endings)).select("path", F.col("length").alias("size"), F.decode("content", "utf-8").alias("content"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows of JSON lines, with the text of lines that are none in `_corrupt`."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
