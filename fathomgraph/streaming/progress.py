"""Progress events as a stream: parsed lines, windowed counts with late data, and a state per run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgraph.plans.shared import kept

EVENT = "struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>"


def parsed(lines: DataFrame) -> DataFrame:
    """(event, raw): each row's JSON `value`; lines that are no events have a null event and keep their text."""
    event = F.from_json("value", EVENT)
    return lines.select(F.when(event["event_type"].isNotNull(), event).alias("event"), F.when(event["event_type"].isNull(), F.col("value")).alias("raw"))


def counts_by_window(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window_start, event_type, n, total) of tumbling windows; in a stream, events later than `late` are dropped, as the watermark says."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = timed.withWatermark("ts", late) if events.isStreaming else timed
    return marked.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def latest_state(events: DataFrame) -> DataFrame:
    """(user_id, events, errors, last_type, last_at): the batch form of the fold below; ties of time go to the greater event_id."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max(F.struct("ts", "event_id", "event_type")).alias("last")).select("user_id", "events", "errors", F.col("last.event_type").alias("last_type"), F.col("last.ts").alias("last_at"))


STATE = "ts timestamp, event_id bigint, event_type string, events bigint, errors bigint"
OUT = "user_id bigint, events bigint, errors bigint, last_type string, last_at timestamp"


def folded_state(events: DataFrame) -> DataFrame:
    """The same as a stream: one row per user and micro-batch with the state so far; independent of the order within a batch."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, number, kind, n, errors = state.get if state.exists else (None, -1, None, 0, 0)
        for df in batches:
            n += len(df)
            errors += int((df.event_type == "error").sum())
            top = df.sort_values(["ts", "event_id"]).iloc[-1]
            if at is None or (top.ts, top.event_id) > (at, number):
                at, number, kind = top.ts, int(top.event_id), top.event_type
        state.update((at, number, kind, n, errors))
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "errors": [errors], "last_type": [kind], "last_at": [at]})

    timed = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    return timed.groupBy("user_id").applyInPandasWithState(fold, OUT, STATE, "update", "NoTimeout")


BUCKETS = 64


def upsert_each_batch(stream: DataFrame, folder: str, key: list[str], version: str, checkpoint: str, buckets: int = BUCKETS):
    """Starts an upsert of every micro-batch into the parquet table at folder, by key and version.

    The table lies in folders by a hash of the key. A batch reads and rewrites those alone that it touches; the others stay as they are. The merged rows are
    written beside the table first, so the folders being replaced are no longer read; a batch that is run again gives the same rows.
    """
    from fathomgraph.operators.incremental import upsert

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = kept(batch.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most buckets rows
        try:
            old = spark.read.schema(new.schema).parquet(folder).filter(F.col("bucket").isin(touched))
        except AnalysisException:
            old = new.limit(0)
        merged = kept(upsert(old, new, key, version))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_upserts(spark, folder: str) -> DataFrame:
    """The table of upsert_each_batch."""
    return spark.read.parquet(folder).drop("bucket")
