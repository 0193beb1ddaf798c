"""The driver's tables read as the engine's entities; pure projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values of the recipes.
DOC_KINDS = ("bugfix", "decision", "policy", "architecture", "discovery", "pattern", "config", "preference", "session_summary")
VERBS = ("related", "compatible", "scoped", "conflicts_with", "supersedes", "not_conflict")
ENTITIES = ("session", "observation", "prompt", "relation")
START = "2024-01-01 00:00:00"


def _at(hours: Column, minutes: Column | None = None) -> Column:
    zero = F.lit(0)
    return F.to_timestamp(F.lit(START)) + F.make_interval(zero, zero, zero, zero, hours.cast("int"), (minutes if minutes is not None else zero).cast("int"), F.lit(0))


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"})


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as notes."""
    i = F.col("doc_id")
    # the first eight words, without folding the text behind them
    folded = T.one_line(F.regexp_extract(F.col("text"), r"(?U)^\s*(?:\S+\s+){0,7}\S*", 0))
    created = _at(i)
    kind = _pick(DOC_KINDS, i % 9)
    return table(spark, sf_dir, "documents").select(
        i.alias("id"),
        F.concat(F.lit("obs-"), i.cast("string")).alias("sync_id"),
        F.concat(F.lit("s"), (i % 20).cast("string")).alias("session_id"),
        kind.alias("type"),
        F.array_join(F.slice(F.split(folded, " ", 9), 1, 8), " ").alias("title"),
        F.col("text").alias("content"),
        F.lit(None).cast("string").alias("tool_name"),
        F.col("source").alias("project"),
        F.when(i % 10 == 0, "personal").otherwise("project").alias("scope"),
        F.when(i % 4 == 0, F.concat(F.lit("topic/"), (i % 50).cast("string"))).alias("topic_key"),
        T.body_hash(F.col("text")).alias("normalized_hash"),
        F.lit(1).cast("long").alias("revision_count"),
        F.lit(1).cast("long").alias("duplicate_count"),
        (i % 17 == 0).alias("pinned"),
        created.alias("created_at"),
        created.alias("updated_at"),
        F.when(i % 13 == 0, created + F.expr("INTERVAL 1 DAY")).alias("deleted_at"),
        T.review_after(kind, created).alias("review_after"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as notes in order of time."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        i.alias("id"),
        F.concat(F.lit("e-"), i.cast("string")).alias("sync_id"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_type").alias("type"),
        F.concat_ws(" ", "event_type", i.cast("string")).alias("title"),
        F.col("props").alias("content"),
        F.col("event_type").alias("project"),
        F.when(i % 10 == 0, "personal").otherwise("project").alias("scope"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
        F.when(i % 13 == 0, F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("deleted_at"),
        (i % 17 == 0).alias("pinned"),
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users said in conversations."""
    c, t = F.col("conv_id"), F.col("turn")
    return table(spark, sf_dir, "conversations").where("role = 'user'").select(
        (c * 1000 + t).alias("id"),
        F.concat(F.lit("prompt-"), (c * 1000 + t).cast("string")).alias("sync_id"),
        F.concat(F.lit("c"), c.cast("string")).alias("session_id"),
        F.col("text").alias("content"),
        F.concat(F.lit("src"), (c % 20).cast("string")).alias("project"),
        _at(c, t).alias("created_at"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the prompts."""
    p = prompts(spark, sf_dir)
    return p.groupBy(F.col("session_id").alias("id")).agg(F.min("project").alias("project"), F.min("created_at").alias("started_at"), F.count("*").alias("n")).select("id", "project", F.concat(F.lit("/repo/"), "project").alias("directory"), "started_at", F.lit(None).cast("timestamp").alias("ended_at"), F.when(F.col("n") > 1, F.concat(F.lit("summary of "), "id")).alias("summary"))


def log_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session for each user of the events, also for some who have none."""
    k = F.col("c_custkey")
    key = k.cast("string")
    return table(spark, sf_dir, "customer").select(key.alias("id"), F.concat(F.lit("team"), (k % 7).cast("string")).alias("project"), F.concat(F.lit("/work/"), (k % 5).cast("string")).alias("directory"), _at(k % 24).alias("started_at"), F.when(k % 3 == 0, F.concat(F.lit("## Goal\n\nreach "), key)).alias("summary"))


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a journal of changes."""
    i = F.col("event_id")
    entity = _pick(ENTITIES, i % 4)
    return table(spark, sf_dir, "events").select(
        i.alias("seq"),
        F.lit("cloud").alias("target_key"),
        entity.alias("entity"),
        F.col("user_id").cast("string").alias("entity_key"),
        F.when((F.col("event_type") == "error") & (entity != "relation"), "delete").otherwise("upsert").alias("op"),
        F.col("props").alias("payload"),
        F.when(i % 5 != 0, "local").otherwise("remote").alias("source"),
        F.col("event_type").alias("project"),
        F.col("ts").alias("occurred_at"),
        F.when(i % 3 == 0, F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("acked_at"),
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document relates to the next one, or to the next of its source."""
    i = F.col("doc_id")
    n = F.floor(i / 3).cast("long")
    return table(spark, sf_dir, "documents").where(i % 3 == 0).select(
        i.alias("id"),
        F.concat(F.lit("rel-"), i.cast("string")).alias("sync_id"),
        F.concat(F.lit("obs-"), i.cast("string")).alias("source_id"),
        F.concat(F.lit("obs-"), (i + F.when(n % 2 == 0, 20).otherwise(1)).cast("string")).alias("target_id"),
        _pick(VERBS, n % 6).alias("relation"),
        ((i % 11) / 10.0).cast("double").alias("confidence"),
        F.when(n % 4 == 0, "pending").otherwise("judged").alias("judgment_status"),
        _at(i).alias("created_at"),
    )
