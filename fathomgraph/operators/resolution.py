"""From sites in source files to edges: enclosing ranges, name cascades, fallbacks, containment from paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomgraph.functions.paths import is_auxiliary_path, is_test_path, last_name
from fathomgraph.plans.shared import kept

BLOCK_LINES = 256


def enclosing(sites: DataFrame, symbols: DataFrame, rank: Column | None = None) -> DataFrame:
    """(site, symbol): the smallest symbol of the same file whose lines hold the site's; by rank first, if given.

    sites(site, file, line), symbols(symbol, file, start_line, end_line, ...). An equi-join on file and block of
    BLOCK_LINES lines replaces the range condition on whole files; a symbol is copied to each block that it covers. Ties go to
    the symbol that starts last, then the least name.
    """
    blocks = F.sequence(F.floor(F.col("start_line") / BLOCK_LINES), F.floor(F.col("end_line") / BLOCK_LINES))
    held = symbols.filter("end_line >= start_line").withColumn("block", F.explode(blocks))
    met = sites.withColumn("block", F.floor(F.col("line") / BLOCK_LINES)).join(held, ["file", "block"]).filter("line between start_line and end_line")
    order = [F.col("end_line") - F.col("start_line"), F.col("start_line").desc(), "symbol"]
    by = Window.partitionBy("site").orderBy(*([rank] if rank is not None else []), *order)
    return met.withColumn("k", F.row_number().over(by)).filter("k = 1").select("site", "symbol")


def cascade(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """(site, symbol, confidence) by the first rule that meets any: full name, name within the site's module, ending of the name, last name.

    sites(site, name, module), symbols(symbol, fqn). Rules are equi-joins on (rule, key): a symbol offers its keys, a site asks for its
    own, best rule first. Where the best rule meets several symbols, all come. Confidence is High, High, Medium, Low.
    """
    fqn, parts = F.col("fqn"), F.split("fqn", "::")
    key = lambda rule, text: F.struct(F.lit(rule).alias("rule"), text.alias("key"))
    offers = symbols.select(
        "symbol", F.explode(F.array_distinct(F.array(key(0, fqn), key(2, F.array_join(F.slice(parts, -2, 2), "::")), key(3, last_name("fqn"))))).alias("o")
    ).select("symbol", F.col("o.rule").alias("rule"), F.col("o.key").alias("key")).filter("rule != 2 or key like '%::%'")
    full = F.concat_ws("::", "module", "name")
    asks = sites.select("site", F.explode(F.array(key(0, F.col("name")), key(1, full), key(2, F.col("name")), key(3, last_name("name")))).alias("a")).select("site", F.col("a.rule").alias("asked"), F.col("a.key").alias("key"), F.when(F.col("a.rule") == 1, 0).otherwise(F.col("a.rule")).alias("rule"))
    # Sites that ask alike are resolved once; a much-used name meets its symbols once for each question, not for each site.
    asks = kept(asks)
    questions = kept(asks.groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n")))
    known = kept(offers.join(questions, ["rule", "key"], "left_semi").distinct())
    answered = known.select("rule", "key").distinct()
    best = asks.join(answered, ["rule", "key"], "left_semi").groupBy("site").agg(F.min("asked").alias("asked"))
    confidence = F.when(F.col("asked") <= 1, "High").when(F.col("asked") == 2, "Medium").otherwise("Low")
    return asks.join(best, ["site", "asked"]).join(known, ["rule", "key"]).select("site", "symbol", confidence.alias("confidence")).distinct()


def fallback_calls(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """(from_id, to_id, confidence): calls of unresolved sites to functions of the same last name.

    sites(site, caller, name, path, is_method), functions(symbol, fqn, path). A single candidate gives its edge; several give
    all of them for method calls, else none. Production callers never resolve to tests or auxiliary code. Self calls are dropped, and edges come once.

    Each name becomes one row first, with the number of its functions and the only one, if it is; sites other than method calls meet no more than that. The
    distinct callers of a name by method calls meet its functions, as many rows as there are edges.
    """
    outside = lambda p: F.coalesce(is_test_path(p) | is_auxiliary_path(p), F.lit(False))
    known = kept(functions.select("symbol", last_name("fqn").alias("last"), outside("path").alias("to_outside")))
    inside = ~F.col("to_outside")
    names = known.groupBy("last").agg(F.count(F.lit(1)).alias("all_n"), F.min("symbol").alias("all_one"), F.count_if(inside).alias("in_n"), F.min(F.when(inside, F.col("symbol"))).alias("in_one"))
    asked = sites.select("caller", last_name("name").alias("last"), "is_method", outside("path").alias("from_outside")).distinct()
    met = kept(asked.join(names, "last").withColumn("n", F.when(F.col("from_outside"), F.col("all_n")).otherwise(F.col("in_n"))))
    single = met.filter("n = 1").select("caller", F.when(F.col("from_outside"), F.col("all_one")).otherwise(F.col("in_one")).alias("symbol"))
    several = met.filter("n > 1 and is_method").select("caller", "last", "from_outside").distinct().join(known, "last").filter("from_outside or not to_outside").select("caller", "symbol")
    return single.unionByName(several).filter("caller != symbol").select(F.col("caller").alias("from_id"), F.col("symbol").alias("to_id"), F.lit("Low").alias("confidence")).distinct()


def ambiguous_drops(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """(caller, last, n): names that sites other than method calls use and that several functions have: they give no edge."""
    counts = functions.groupBy(last_name("fqn").alias("last")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return sites.filter("not is_method").select("caller", last_name("name").alias("last")).distinct().join(counts, "last").select("caller", "last", "n")


def fallback_types(uses: DataFrame, types: DataFrame) -> DataFrame:
    """(from_id, to_id, kind, confidence): uses of a type's name become edges to the only type so named, else to the only one in the same file; never to itself.

    uses(user, name, file, how), where how is Extends, Implements or anything else, which counts as Uses; types(symbol, name, file).
    """
    everywhere = types.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("symbol").alias("only"))
    here = types.groupBy("name", "file").agg(F.count(F.lit(1)).alias("n_here"), F.min("symbol").alias("only_here"))
    asked = uses.select("user", "name", "file", F.when(F.col("how").isin("Extends", "Implements"), F.col("how")).otherwise("Uses").alias("kind")).distinct()
    met = asked.join(everywhere, "name").join(here, ["name", "file"], "left")
    target = F.when(F.col("n") == 1, F.col("only")).when(F.col("n_here") == 1, F.col("only_here"))
    return met.select(F.col("user").alias("from_id"), target.alias("to_id"), "kind", F.lit("Medium").alias("confidence")).filter("to_id is not null and from_id != to_id").distinct()


def fallback_variables(uses: DataFrame, variables: DataFrame) -> DataFrame:
    """(from_id, to_id, kind, confidence): uses(user, name, file) of identifiers become Uses edges to the only variable so named in the file, else anywhere."""
    everywhere = variables.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("symbol").alias("only"))
    here = variables.groupBy("name", "file").agg(F.count(F.lit(1)).alias("n_here"), F.min("symbol").alias("only_here"))
    met = uses.select("user", "name", "file").distinct().join(everywhere, "name").join(here, ["name", "file"], "left")
    target = F.when(F.col("n_here") == 1, F.col("only_here")).when(F.col("n") == 1, F.col("only"))
    return met.select(F.col("user").alias("from_id"), target.alias("to_id"), F.lit("Uses").alias("kind"), F.lit("Low").alias("confidence")).filter("to_id is not null and from_id != to_id").distinct()


def containment_from_paths(paths: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """Folders and files as nodes (key, kind, name), and (parent, child) of what holds what, from paths(path); the project holds the topmost.

    Each path gives its prefixes; nodes and links are the distinct ones.
    """
    parts = F.filter(F.split("path", "/"), lambda p: (p != "") & (p != "."))
    split = paths.select(parts.alias("parts")).filter(F.size("parts") > 0)
    prefixes = split.select("parts", F.posexplode("parts").alias("at", "name"))
    key = F.array_join(F.slice("parts", F.lit(1), F.col("at") + 1), "/")
    above = F.when(F.col("at") == 0, F.lit(project)).otherwise(F.array_join(F.slice("parts", F.lit(1), F.col("at")), "/"))
    kind = F.when(F.col("at") == F.size("parts") - 1, "File").otherwise("Folder")
    rows = prefixes.select(key.alias("key"), above.alias("parent"), kind.alias("kind"), "name")
    nodes = rows.groupBy("key").agg(F.max("kind").alias("kind"), F.first("name").alias("name"))
    return nodes, rows.select("parent", F.col("key").alias("child")).distinct()
