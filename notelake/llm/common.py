"""Shared plumbing: where intermediate tables go, how rows get a key, how Python is shipped."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: A word of the contracts: a run without space, tab, newline, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_made: list[str] = []


class Workspace:
    """Tables that one call of an operator writes to the shared folder in order to cut lineage.

    They outlive executors, so a lost one costs only the tasks it was running. A table that is no longer
    read can be dropped before the operator ends; the rest stay as long as the operator's lazy result may be read.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/notelake-{name}-{uuid.uuid4().hex}"
        _made.append(self.path)
        ship(spark)

    @contextmanager
    def _freeing_shuffles(self):
        conf = self.spark.conf
        before = conf.get(_FREE_SHUFFLES, None)
        conf.set(_FREE_SHUFFLES, "true")  # what a written table was made from is not read again
        try:
            yield
        finally:
            conf.set(_FREE_SHUFFLES, before) if before is not None else conf.unset(_FREE_SHUFFLES)

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        at = f"{self.path}/{tag}-{uuid.uuid4().hex[:8]}"
        with self._freeing_shuffles():
            df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._notelake_path = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._notelake_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Large arrays go back to the system when freed, so that a worker keeps what it needs now, not what it once needed.
_WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": "16777216", "MALLOC_TRIM_THRESHOLD_": "33554432", "MALLOC_ARENA_MAX": "1"}
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def clean(spark: SparkSession) -> None:
    """Removes the tables of all operators that this driver has called; their lazy results must have been written by then."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Let Python workers on this host import the package from where the driver has it; elsewhere it is installed. Texts are
    long, so Spark's default of 10,000 rows a batch is lowered; a session's own setting stays."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    for k, v in _WORKER_ENV.items():
        env.setdefault(k, v)
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, "1000")


def column(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """A name that no column of the frame has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, id, text): k1 is the id (null: the least long), k2 a hash of the text, so that rows that share an id
    but not a text stay apart. Rows equal in both behave alike everywhere, so one key may stand for them."""
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    return df.select(
        F.coalesce(column(id_col).cast("long"), F.lit(-(2**63))).alias("k1"),
        F.xxhash64(text, F.octet_length(text)).alias("k2"),
        column(id_col).alias("id"),
        text.alias("text"),
    )


def n_words(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def parts_for(total: int, each: int, least: int = 1) -> int:
    """How many parts keep each near a size; grows with the input."""
    return max(least, -(-int(total) // each))
