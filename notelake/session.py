"""Session settings that the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

_own: list[str] = []
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or where that is unset and all runs in one process, a
    temporary one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="notelake-"))
        given = _own[0]
    return given.rstrip("/")


@contextmanager
def freeing_shuffles(spark: SparkSession):
    """What is written meanwhile leaves no shuffle files behind: what a written table was made from is not read again."""
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before) if before is not None else spark.conf.unset(_FREE_SHUFFLES)


def written(df, name: str, **options: str):
    """The frame as a table in the shared folder: its lineage and its shuffle files end there, and it outlives executors. options: of the writer."""
    at = f"{shared_folder(df.sparkSession)}/notelake-{name}-{uuid.uuid4().hex}"
    with freeing_shuffles(df.sparkSession):
        df.write.options(**{"compression": "zstd", **options}).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def build_session(app: str = "notelake", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling. Other settings come from the cluster."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
