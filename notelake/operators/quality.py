"""Checks of the stored data, repairs and backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written
from . import aggregates
from .index import Index
from .listings import live
from .projects import session_project


def missing_sessions(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    return rows.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_anti")


def missing_ends(relations: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, end) of relations that name a note which is not there."""
    e = relations.select("id", F.explode(F.array(F.struct(F.lit("source").alias("end"), F.col("source_id").alias("sync_id")), F.struct(F.lit("target").alias("end"), F.col("target_id").alias("sync_id")))).alias("e")).select("id", "e.*")
    return e.where("sync_id is not null").join(rows.select("sync_id"), "sync_id", "left_anti").select("id", "end")


def stale_hashes(rows: DataFrame) -> DataFrame:
    return live(rows).where(~F.col("normalized_hash").eqNullSafe(T.body_hash(F.col("content")))).select("id")


def rehashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("normalized_hash", F.when(F.col("deleted_at").isNull(), T.body_hash(F.col("content"))).otherwise(F.col("normalized_hash")))


def index_gap(index: Index, rows: DataFrame) -> DataFrame:
    """One row: documents of the index, rows of the table."""
    return index.docstats.agg(F.count("*").alias("n_indexed")).crossJoin(rows.agg(F.count("*").alias("n_rows")))  # one row each


def report(rows: DataFrame, sessions: DataFrame, prompts: DataFrame, relations: DataFrame, index: Index | None = None, code: str | None = None) -> DataFrame:
    """(code, ok, detail) of the checks, or of the one named."""
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("code"), (F.col("n") == 0).alias("ok"), F.col("n").cast("string").alias("detail"))
    checks = {
        "observation_sessions": lambda: missing_sessions(rows, sessions),
        "prompt_sessions": lambda: missing_sessions(prompts, sessions),
        "relation_ends": lambda: missing_ends(relations, rows),
        "stale_hashes": lambda: stale_hashes(rows),
        "shared_topic_keys": lambda: aggregates.shared_topic_keys(rows),
        "unsearchable_kinds": lambda: aggregates.kind_histogram(rows, None),
        "blank_titles": lambda: live(rows).where(F.trim("title") == ""),
        "duplicate_ids": lambda: rows.groupBy("id").count().where("count > 1"),
        "duplicate_sync_ids": lambda: rows.groupBy("sync_id").count().where("count > 1"),
        "unknown_verbs": lambda: relations.where(~F.col("relation").isin(*T.RELATION_VERBS)),
        "confidence_bounds": lambda: relations.where(F.col("confidence").isNotNull() & ~T.is_confidence(F.col("confidence"))),
        "unknown_scopes": lambda: rows.where(~F.col("scope").isin(*T.SCOPES)),
        "project_spelling": lambda: live(rows).where(F.col("project").isNotNull() & (F.col("project") != T.project(F.col("project")))),
        "deleted_before_created": lambda: rows.where("deleted_at < created_at"),
        "index_rows": lambda: index.docstats.join(rows.select(F.col("id").alias("doc_id")), "doc_id", "left_anti").select("doc_id").unionByName(rows.select(F.col("id").alias("doc_id")).join(index.docstats, "doc_id", "left_anti")),
    }
    if index is None:
        checks.pop("index_rows")
    if code is not None:
        if code not in checks:
            raise ValueError(f"unknown check {code}; known: {', '.join(sorted(checks))}")
        return count(checks[code](), code)
    out = None
    for name, make in checks.items():
        one = count(make(), name)
        out = one if out is None else out.unionByName(one)
    return out


def backfill(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Defaults of older layouts: project from the session, scope, counters, times, a name."""
    o = session_project(rows, sessions)
    out = o.withColumns({
        "project": F.nullif(F.col("owner"), F.lit("")),
        "scope": F.coalesce(F.nullif(F.trim("scope"), F.lit("")), F.lit("project")),
        "topic_key": F.nullif(F.trim("topic_key"), F.lit("")),
        "revision_count": F.greatest(F.coalesce("revision_count", F.lit(1)), F.lit(1)),
        "duplicate_count": F.greatest(F.coalesce("duplicate_count", F.lit(1)), F.lit(1)),
        "updated_at": F.coalesce("updated_at", "created_at"),
        "sync_id": F.coalesce(F.nullif(F.col("sync_id"), F.lit("")), T.sync_id("obs", F.col("id").cast("string"))),
    })
    return out.drop("owner").select(*rows.columns)


def review_backfill(rows: DataFrame) -> DataFrame:
    return rows.withColumn("review_after", F.coalesce("review_after", T.review_after(F.col("type"), F.col("created_at"))))


def renumbered(rows: DataFrame, order: Column) -> DataFrame:
    """The first row of an id keeps it; later ones and rows without an id get new ones above the largest."""
    w = Window.partitionBy("id").orderBy(order)
    first = rows.withColumn("_o", order).withColumn("_n", F.when(F.col("id").isNotNull(), F.row_number().over(w)))
    keep = F.coalesce(F.col("_n") == 1, F.lit(False))
    top = rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    # numbered in order by partitions of a range sort, with what the partitions before hold: no task sees all odd rows
    odd = written(first.where(~keep).repartitionByRange("_o").sortWithinPartitions("_o").withColumn("_k", F.monotonically_increasing_id()), "odd")
    part, inside = F.shiftright("_k", 33), F.col("_k").bitwiseAND((1 << 33) - 1)
    held = sorted((r["p"], r["n"]) for r in odd.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one row a partition
    before, total = {}, 0
    for p, n in held:
        before[p], total = total, total + n
    base = F.create_map(*[x for p, n in before.items() for x in (F.lit(p), F.lit(n))])[part] if before else F.lit(0)
    numbered = odd.crossJoin(F.broadcast(top)).withColumn("id", (F.col("_top") + 1 + base + inside).cast(rows.schema["id"].dataType))  # one row
    return first.where(keep).select(*rows.columns).unionByName(numbered.select(*rows.columns))


def unenrolled_journal(mutations: DataFrame, enrolled: DataFrame) -> DataFrame:
    """The journal without unacknowledged changes of projects that are not enrolled."""
    gone = mutations.where("acked_at is null").join(enrolled.select("project"), "project", "left_anti").select("seq")
    return mutations.join(gone, "seq", "left_anti")


def rekeyed_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("target_key", F.coalesce(F.nullif(F.trim("target_key"), F.lit("")), F.lit("local"))).dropDuplicates(["target_key", "chunk_id"])


def respelled(rows: DataFrame) -> DataFrame:
    """Projects by today's rule, worked out once a spelling."""
    m = rows.select("project").distinct().withColumn("_p", F.nullif(T.project(F.coalesce("project", F.lit(""))), F.lit("")))
    return rows.join(m, "project", "left").withColumn("project", F.col("_p")).select(*rows.columns)


def retitled_summaries(rows: DataFrame) -> DataFrame:
    from ..functions.markdown import headline_udf

    h = F.when(F.col("type") == T.SESSION_SUMMARY, headline_udf("content"))
    return rows.withColumn("title", F.coalesce(h, "title"))


def adopt(source: DataFrame, like: DataFrame) -> DataFrame:
    """A foreign table with the columns that both have, in our layout and with our types; text that is no value of a type is an error."""
    kinds = {f.name: f.dataType for f in like.schema}
    return like.limit(0).unionByName(source.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in like.columns if c in source.columns]), allowMissingColumns=True)
