"""The pN_ queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathomgraph.llm.leaks import leaks
from fathomgraph.llm.pii import personal_data, redacted
from fathomgraph.llm.quantiles import METRICS, PERMILLES, population_percentiles, population_percentiles_of_days
from fathomgraph.llm.tokenizer import token_ids
from fathomgraph.sources.tables import table

def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """The table of texts; a table of fewer splits than there are cores is spread over them, as each text costs far more than its transport.

    Only the plan depends on that, not the rows; larger tables are read as they are.
    """
    texts = table(spark, folder, "documents")
    cores = spark.sparkContext.defaultParallelism
    return texts if texts.rdd.getNumPartitions() >= cores else texts.select("doc_id", "text").repartition(cores)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_percentiles": lambda s, d: population_percentiles(table(s, d, "population")),
    "p2_percentiles_of_days": lambda s, d: population_percentiles_of_days(table(s, d, "population")),
    "p6_ids": lambda s, d: token_ids(_documents(s, d)),
    "p7_found": lambda s, d: leaks(_documents(s, d), table(s, d, "eval_items")).select("doc_id", "item_id"),
    "p7_answers": lambda s, d: leaks(_documents(s, d), table(s, d, "eval_items")),
    "p8_found": lambda s, d: personal_data(_documents(s, d), table(s, d, "contributors")),
    "p8_redacted": lambda s, d: redacted(_documents(s, d), table(s, d, "contributors")),
}

_RANKED = f"""
o AS (SELECT DISTINCT id, nullif(lower(trim(language)), '') AS language, {", ".join(METRICS)} FROM population WHERE id IS NOT NULL),
v AS ({" UNION ALL ".join(f"SELECT language, '{m}' AS metric, {m} AS value FROM o" for m in METRICS)}),
r AS (SELECT *, row_number() OVER (PARTITION BY language, metric ORDER BY value) AS k, count(*) OVER (PARTITION BY language, metric) AS n
      FROM v WHERE value IS NOT NULL AND NOT isnan(value)),
q AS (SELECT unnest([{", ".join(map(str, PERMILLES))}])::INTEGER AS permille),
hit AS (SELECT language, metric, permille, n, value FROM r JOIN q ON k = greatest(1, (n * permille + 999) // 1000))"""

SQL: dict[str, str] = {
    "p2_percentiles": f"WITH {_RANKED} SELECT * FROM hit",
    "p2_percentiles_of_days": f"""WITH {_RANKED} SELECT language, metric, permille, n,
CASE WHEN value = 0 THEN 0 ELSE floor(value / pow(2, floor(log2(value)) - 12)) * pow(2, floor(log2(value)) - 12) END AS value FROM hit""",
}
