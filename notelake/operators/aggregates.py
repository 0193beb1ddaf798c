"""Counts and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .listings import due, live


def session_list(sessions: DataFrame, rows: DataFrame, limit: int | None = 5) -> DataFrame:
    """Sessions with live notes or a summary, the last active first."""
    n = live(rows).groupBy("session_id").agg(F.count("*").alias("n"), F.max("created_at").alias("last"))
    j = sessions.join(n, sessions["id"] == n["session_id"], "left")
    out = j.select("id", "project", F.coalesce("n", F.lit(0)).alias("n_observations"), F.coalesce("last", "started_at").alias("last_at"), "summary")
    out = out.where((F.col("n_observations") > 0) | (F.trim(F.coalesce("summary", F.lit(""))) != "")).drop("summary").orderBy(F.desc("last_at"), F.desc("id"))
    return out.limit(limit) if limit else out


def project_stats(rows: DataFrame, sessions: DataFrame, prompts: DataFrame) -> DataFrame:
    """Counts by project and its directories; one union and one shuffle instead of two outer joins."""
    parts = [
        live(rows).select("project", F.lit("o").alias("k"), F.lit(None).cast("string").alias("directory")),
        sessions.select("project", F.lit("s").alias("k"), F.when(F.trim("directory") != "", F.col("directory")).alias("directory")),
        prompts.select("project", F.lit("p").alias("k"), F.lit(None).cast("string").alias("directory")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("project is not null and project <> ''")
    n = lambda k: F.sum(F.when(F.col("k") == k, 1).otherwise(0)).alias({"o": "n_observations", "s": "n_sessions", "p": "n_prompts"}[k])
    return every.groupBy("project").agg(n("o"), n("s"), n("p"), F.array_sort(F.collect_set("directory")).alias("directories"))


def prune_candidates(stats: DataFrame) -> DataFrame:
    return stats.where("n_observations = 0").select("project")


def project_names(rows: DataFrame) -> DataFrame:
    return live(rows).where("project is not null and project <> ''").select("project").distinct()


def projects_by_recency(rows: DataFrame) -> DataFrame:
    return live(rows).where("project is not null and project <> ''").groupBy("project").agg(F.max("created_at").alias("last_at")).orderBy(F.desc("last_at"), "project")


def store_stats(rows: DataFrame, sessions: DataFrame, prompts: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count("*").alias(name))
    names = project_names(rows).agg(F.count("*").alias("n_projects"))
    return n(sessions, "n_sessions").crossJoin(n(live(rows), "n_observations")).crossJoin(n(prompts, "n_prompts")).crossJoin(names)  # one row each


def relation_stats(relations: DataFrame) -> DataFrame:
    """(dimension, value, n): by verb and by status in one pass."""
    g = relations.groupingSets([("relation",), ("judgment_status",)], "relation", "judgment_status").agg(F.count("*").alias("n"), F.grouping("relation").alias("by_status"))
    verb = F.col("by_status") == 0
    return g.select(F.when(verb, "relation").otherwise("status").alias("dimension"), F.when(verb, F.col("relation")).otherwise(F.col("judgment_status")).alias("value"), "n")


def counts(rows: DataFrame, as_of: Column, project: str | None = None) -> DataFrame:
    some = rows if not project else rows.where(F.col("project") == project)
    return live(some).agg(F.count("*").alias("n_live"), F.count_if((F.col("review_after") <= as_of)).alias("n_due"))


def oldest_pending(mutations: DataFrame) -> DataFrame:
    return mutations.where("acked_at is null").agg(F.min("occurred_at").alias("oldest"), F.count("*").alias("n"))


def deferred_counts(deferred: DataFrame) -> DataFrame:
    return deferred.agg(F.count_if(F.col("apply_status") == "deferred").alias("n_deferred"), F.count_if(F.col("apply_status") == "dead").alias("n_dead"))


def session_counts(sessions: DataFrame, rows: DataFrame, prompts: DataFrame) -> DataFrame:
    o = live(rows).groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n_observations"))
    p = prompts.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n_prompts"))
    return sessions.select("id").join(o, "id", "left").join(p, "id", "left").na.fill(0, ["n_observations", "n_prompts"])


def shared_topic_keys(rows: DataFrame) -> DataFrame:
    return live(rows).where("topic_key is not null and topic_key <> ''").groupBy("topic_key", F.coalesce("project", F.lit("")).alias("project"), "scope").agg(F.count("*").alias("n")).where("n > 1")


def kind_histogram(rows: DataFrame, limit: int | None = 8) -> DataFrame:
    """Kinds outside the vocabulary."""
    out = live(rows).where(~F.col("type").isin(*T.KINDS, T.SESSION_SUMMARY)).groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")
    return out.limit(limit) if limit else out


def directories(sessions: DataFrame, project: str) -> DataFrame:
    return sessions.where(F.col("project") == project).select("directory").distinct()


def session_ids(rows: DataFrame, prompts: DataFrame) -> DataFrame:
    return rows.select("session_id").union(prompts.select("session_id")).distinct()


def project_exists(name: str, *tables: DataFrame) -> DataFrame:
    every = tables[0].select("project")
    for t in tables[1:]:
        every = every.unionByName(t.select("project"))
    return every.where(F.col("project") == name).limit(1).agg((F.count("*") > 0).alias("there"))


def retrieval_quality(ranks: DataFrame) -> DataFrame:
    """ranks: (qid, rank or null). Mean reciprocal rank and shares in the first 1, 3, 10."""
    hit = lambda k: F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")).alias(f"top{k}")
    return ranks.agg(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), hit(1), hit(3), hit(10))


def capture_tallies(items: DataFrame, rows: DataFrame, most: int = 80) -> DataFrame:
    """Items (n, content, project) of one capture: extracted, saved, duplicate of live notes or of an earlier item, dropped beyond `most`."""
    from pyspark.sql import Window

    h = T.body_hash(F.col("content"))
    kept = items.withColumn("h", h)
    first = F.row_number().over(Window.partitionBy("project", "h").orderBy("n"))
    known = live(rows).select(F.coalesce("project", F.lit("")).alias("project"), F.col("normalized_hash").alias("h")).distinct().withColumn("known", F.lit(True))
    j = kept.withColumn("first", first).join(known, ["project", "h"], "left")
    over = F.col("n") >= most
    dup = ~over & (F.coalesce("known", F.lit(False)) | (F.col("first") > 1))
    return j.agg(F.count("*").alias("extracted"), F.count_if(~over & ~dup).alias("saved"), F.count_if(dup).alias("duplicate"), F.count_if(over).alias("dropped"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["due"]
