"""Intermediate results, kept as tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:12]
_numbers = itertools.count()
_writes = itertools.count(1)
#: Results after which the driver collects its garbage: shuffle files and broadcasts of finished plans go only when it does.
WRITES_A_SWEEP = 4
_local: str | None = None


def _remove(path: str) -> None:
    if "://" not in path or path.startswith("file:"):
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def shared_folder(spark: SparkSession) -> str:
    """This run's own folder below spark.checkpoint.dir. Only a local session that names none (tests) gets a temporary one."""
    global _local
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        if _local is None:
            _local = tempfile.mkdtemp(prefix="fathomgraph-")
            atexit.register(_remove, _local)
        named = _local
    path = f"{named.rstrip('/')}/fathomgraph-{_RUN}"
    if path not in _seen:
        _seen.add(path)
        atexit.register(_remove, path)
    return path


_seen: set[str] = set()


def kept(df: DataFrame, place: str | None = None) -> DataFrame:
    """The rows of df, written once and read back as a plain table: without lineage, safe from lost executors, with sizes that the next plan knows.

    place names a folder to overwrite; without it each call has its own, which stays until the driver ends.
    """
    path = f"{shared_folder(df.sparkSession)}/{place or next(_numbers)}"
    df.write.mode("overwrite").parquet(path)
    if next(_writes) % WRITES_A_SWEEP == 0:
        df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The states of a loop, in two places in turn: while a round is written, the one before is read, and the one before that is overwritten.

    So a loop holds two states on disk, however many its rounds are. What outlives the loop is the last state alone.
    """

    def __init__(self) -> None:
        self.name, self.n = f"loop-{next(_numbers)}", 0

    def kept(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return kept(df, f"{self.name}-{self.n % 2}")
