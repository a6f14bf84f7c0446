"""Signals of commit history: what changes together, how often, and by whom.

commits has one row per commit and file: (commit, author, committed_at, file).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomgraph.operators.metrics import DEFAULTS, Thresholds
from fathomgraph.operators.skew import sized_join, without
from fathomgraph.plans.shared import kept


def small_commits(commits: DataFrame, max_files: int) -> DataFrame:
    """(commit, file), distinct, of the commits of at most max_files files. The others are few and go before anything is gathered by commit."""
    per = kept(commits.filter("file is not null").select("commit", "file").distinct())
    return without(per, per.groupBy(F.col("commit").alias("id")).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > max_files).select("id"), ["commit"])


def _pairs(files: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of each array."""
    first = files.select("files", F.posexplode("files").alias("at", "a"))
    return first.select("a", F.explode(F.slice("files", F.col("at") + 2, F.size("files"))).alias("b"))


def co_changes(commits: DataFrame, max_files: int = 50) -> DataFrame:
    """(file_a, file_b, n): commits that change both, file_a < file_b. Commits of more than max_files distinct files say nothing and are left out.

    That limit is the feature: it also bounds a commit's pairs.
    """
    files = small_commits(commits, max_files).groupBy("commit").agg(F.array_sort(F.collect_list("file")).alias("files")).filter(F.size("files") > 1)
    return _pairs(files).groupBy(F.col("a").alias("file_a"), F.col("b").alias("file_b")).agg(F.count(F.lit(1)).alias("n"))


def file_changes(commits: DataFrame, max_files: int = 50) -> DataFrame:
    """(file, n): commits of at most max_files files that change each file."""
    return small_commits(commits, max_files).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def temporal_coupling(commits: DataFrame, linked: DataFrame | None = None, t: Thresholds = DEFAULTS) -> DataFrame:
    """(file_a, file_b, co_changes, score, hidden): pairs that change together often, over the busier file's changes.

    hidden: the pair is not in linked(file_a, file_b), the pairs with a structural edge; all are hidden without it.
    """
    totals = file_changes(commits, t.temporal_max_files)
    pairs = co_changes(commits, t.temporal_max_files).filter(F.col("n") >= t.temporal_min_co_changes)
    met = pairs.join(totals.select(F.col("file").alias("file_a"), F.col("n").alias("of_a")), "file_a").join(totals.select(F.col("file").alias("file_b"), F.col("n").alias("of_b")), "file_b")
    scored = met.select("file_a", "file_b", F.col("n").alias("co_changes"), (F.col("n") / F.greatest("of_a", "of_b")).alias("score")).filter(F.col("score") >= t.temporal_min_score)
    if linked is None:
        return scored.withColumn("hidden", F.lit(True))
    known = linked.select("file_a", "file_b").distinct().withColumn("known", F.lit(True))
    return scored.join(known, ["file_a", "file_b"], "left").withColumn("hidden", F.col("known").isNull()).drop("known")


def file_links(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(file_a, file_b): files with a structural edge between their nodes, unordered and distinct; paths(id, path)."""
    paths = kept(paths.select("id", "path"))
    met = sized_join(edges.filter("kind != 'Contains'").select("from_id", "to_id"), paths.select(F.col("id").alias("from_id"), F.col("path").alias("a")), "from_id")
    both = sized_join(met, paths.select(F.col("id").alias("to_id"), F.col("path").alias("b")), "to_id").filter("a != b")
    return both.select(F.least("a", "b").alias("file_a"), F.greatest("a", "b").alias("file_b")).distinct()


def known_files(commits: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of commits whose file is one of files(file): the others are gone from the repository."""
    return sized_join(commits, kept(files.select("file").distinct()), "file", "left_semi").select(*commits.columns)


def module_co_changes(pairs: DataFrame, depth_key) -> DataFrame:
    """(module_a, module_b, co_changes, max_score, hidden): temporal_coupling rolled up by depth_key(column) of each file; pairs within one module are left out."""
    a, b = depth_key(F.col("file_a")), depth_key(F.col("file_b"))
    rows = pairs.select(F.least(a, b).alias("module_a"), F.greatest(a, b).alias("module_b"), "co_changes", "score", "hidden").filter("module_a != module_b")
    return rows.groupBy("module_a", "module_b").agg(F.sum("co_changes").alias("co_changes"), F.max("score").alias("max_score"), F.bool_or("hidden").alias("hidden"))


def churn(commits: DataFrame, now: str) -> DataFrame:
    """(file, changes, authors, last_touched_days, hotspot, dispersion, active_recent, high_churn, shared_ownership).

    hotspot is changes * ln(1 + changes); dispersion 1 - sum of squared shares of authors.
    """
    by_author = commits.filter("file is not null").groupBy("file", "author").agg(F.count_distinct("commit").alias("n"), F.max("committed_at").alias("last"))
    per = by_author.groupBy("file").agg(F.sum("n").alias("changes"), F.count("author").alias("authors"), F.max("last").alias("last"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    spread = F.greatest(F.lit(0.0), 1 - F.col("squares") / (F.col("changes") * F.col("changes")))
    out = per.select(
        "file", "changes", "authors", F.datediff(F.to_date(F.lit(now)), F.to_date("last")).alias("last_touched_days"), (F.col("changes") * F.log1p("changes")).alias("hotspot"), spread.alias("dispersion")
    )
    return out.select("*", (F.col("last_touched_days") <= 30).alias("active_recent"), (F.col("changes") >= 5).alias("high_churn"), ((F.col("authors") >= 3) & (F.col("dispersion") >= 0.5)).alias("shared_ownership"))


def clusters(commits: DataFrame, least: int = 3) -> DataFrame:
    """(files, n): sets of files that exactly recur in commits, and pairs that recur outside of such a set. Commits count with all of their files.

    Sets compare by their size and two sums of hashes, and are spelled out for those alone that recur. Files that change less often than `least` are in no
    recurring pair and are left out before pairs are formed.
    """
    per = kept(commits.filter("file is not null").select("commit", "file").distinct())
    wide = lambda salt: F.sum(F.xxhash64(F.lit(salt), "file").cast("decimal(20, 0)")).alias(f"h{salt}")
    marks = per.groupBy("commit").agg(F.count(F.lit(1)).alias("k"), wide(1), wide(2)).filter("k > 1")
    sets = marks.groupBy("k", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("commit").alias("commit")).filter(F.col("n") >= least)
    exact = kept(per.join(sets.select("commit", "n"), "commit").groupBy("commit", "n").agg(F.array_sort(F.collect_list("file")).alias("files")).select("files", "n"))
    often = per.groupBy("file").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= least)
    gathered = sized_join(per, kept(often.select("file")), "file", "left_semi").groupBy("commit").agg(F.array_sort(F.collect_list("file")).alias("files")).filter(F.size("files") > 1)
    recurring = _pairs(gathered).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    rest = recurring.join(_pairs(exact).distinct(), ["a", "b"], "left_anti").select(F.array("a", "b").alias("files"), "n")
    return exact.unionByName(rest)


def history_window(commits: DataFrame, months: tuple[int, ...], now: str, enough: int = 30) -> DataFrame:
    """The commits of the shortest of the windows that holds `enough` of them; of the longest if none does."""
    start = lambda m: F.add_months(F.to_date(F.lit(now)), -m)
    counts = commits.select("commit", "committed_at").distinct().agg(*[F.count_if(F.to_date("committed_at") >= start(m)).alias(f"m{m}") for m in months]).first()
    chosen = next((m for m in months if counts[f"m{m}"] >= enough), months[-1])
    return commits.filter(F.to_date("committed_at") >= start(chosen))


def newest_commits(commits: DataFrame, limit: int = 500, days: int = 365, now: str | None = None) -> DataFrame:
    """The rows of the newest `limit` commits within `days`."""
    one = commits.groupBy("commit").agg(F.max("committed_at").alias("at"))
    if now is not None:
        one = one.filter(F.datediff(F.to_date(F.lit(now)), F.to_date("at")) <= days)
    return commits.join(one.orderBy(F.col("at").desc(), "commit").limit(limit).select("commit"), "commit", "left_semi")


def author_rank(commits: DataFrame, keep: int = 3) -> DataFrame:
    """(file, author, n, place): each file's busiest authors, ties by name."""
    n = commits.groupBy("file", "author").agg(F.count_distinct("commit").alias("n"))
    by = Window.partitionBy("file").orderBy(F.col("n").desc(), "author")
    return n.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= keep)
