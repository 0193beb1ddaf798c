"""Staged search: topic key, strict match in two indexes, widened, nearest; and its paged and prompt variants.

Ranking works on narrow frames of ids and scores; bodies are joined to the few rows that are returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import bm25
from .index import Index

DEFAULT_LIMIT, MAX_LIMIT, RRF_K = 10, 20, 60
WIDEN_TERMS = (2, 12)
SAMPLE, LEAST_SAMPLE = 24, 3
NEAR_MARGIN, RECENT_MARGIN, RECENT = 1.2, 1.6, 50
TOPIC_RANK = -1000.0
SUMMARY = T.SESSION_SUMMARY


@dataclass(frozen=True)
class Filters:
    """Blank means none; spelled as writes are."""

    kind: str | None = None
    project: str | None = None
    scope: str | None = None

    def where(self) -> Column:
        cond = F.col("deleted_at").isNull()
        if self.kind and self.kind.strip():
            cond = cond & (F.col("type") == T.kind(F.lit(self.kind)))
        if self.project and self.project.strip():
            cond = cond & (F.lower(F.coalesce("project", F.lit(""))) == T.project(F.lit(self.project)))
        if self.scope and self.scope.strip():
            cond = cond & (F.col("scope") == T.scope(F.lit(self.scope)))
        return cond


def within(index: Index, filters: Filters) -> DataFrame | None:
    """The documents of the filter's project as far as the index tells them, so that others are neither scored nor joined."""
    if not filters.project or not filters.project.strip():
        return None
    name = index.postings.sparkSession.range(1).select(T.project(F.lit(filters.project)).alias("p")).first()["p"]
    return bm25.in_project(index, name) if bm25.word_tokens(name) else None


def narrowed(hits: DataFrame, rows: DataFrame, filters: Filters) -> DataFrame:
    """(id, type, score): ranked ids joined to the columns that filters need."""
    keep = rows.where(filters.where()).select("id", "type")
    return hits.withColumnRenamed("doc_id", "id").join(keep, "id").select("id", "type", "score")


def topic_hits(rows: DataFrame, query: str, filters: Filters = Filters()) -> DataFrame:
    """Rows with exactly this topic key, newest first; none if the query has no slash once it is a key."""
    key = T.topic_key(F.lit(query))
    return rows.where(filters.where() & (F.col("topic_key") == key) & key.contains("/")).select("id", "type", F.lit(TOPIC_RANK).alias("score"), "updated_at").orderBy(F.desc("updated_at"), "id")


def fused(stemmed: DataFrame, exact: DataFrame, limit: int) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (id, score); the stemmed score is kept where there is one."""
    depth = max(3 * limit, 30)

    def placed(df: DataFrame, which: int) -> DataFrame:
        top = df.orderBy("score", "id").limit(depth)
        place = F.row_number().over(Window.orderBy("score", "id"))  # at most `depth` rows
        return top.select("id", "score", place.alias("place"), F.lit(which).alias("which"))

    both = placed(stemmed, 0).unionByName(placed(exact, 1))
    out = both.groupBy("id").agg(F.sum(1.0 / (RRF_K + F.col("place"))).alias("fused"), F.min_by("score", "which").alias("score"))
    return out.orderBy(F.desc("fused"), "score", "id").limit(limit)


def widened(index: Index, rows: DataFrame, query: str, limit: int, filters: Filters = Filters()) -> DataFrame:
    """All but one of two to twelve words, each left out once, in one plan; best rank of an id; no summaries."""
    terms = bm25.split_terms(query)
    spark = rows.sparkSession
    if not WIDEN_TERMS[0] <= len(terms) <= WIDEN_TERMS[1]:
        return spark.createDataFrame([], "id long, type string, score double")
    variants = {k: terms[:k] + terms[k + 1 :] for k in range(len(terms))}
    need = spark.createDataFrame(list(bm25.counts(bm25.phrases(variants)).items()), "qid long, need int")
    hits = bm25.asked(index, variants, within=within(index, filters)).join(F.broadcast(need), "qid").where("matched = need")
    there = hits.withColumnRenamed("doc_id", "id").join(rows.where(filters.where()).select("id", "type"), "id")
    top = there.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("score", "id"))).where(F.col("place") <= limit)
    return top.where(F.col("type") != SUMMARY).groupBy("id", "type").agg(F.min("score").alias("score")).orderBy("score", "id")


def upper_median(values: Column) -> Column:
    """The upper of the middle two of an even number."""
    s = F.sort_array(values)
    return F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))


def near(sample: DataFrame, margin: Column) -> DataFrame:
    """Of a sample of at most SAMPLE rows (id, type, score), those well below the median, if there are enough to tell."""
    middle = sample.agg(upper_median(F.collect_list("score")).alias("middle"), F.count("*").alias("n_sample"))
    return sample.crossJoin(F.broadcast(middle)).where((F.col("n_sample") >= LEAST_SAMPLE) & (F.col("score") <= F.col("middle") * margin)).select("id", "type", "score").orderBy("score", "id")


def nearest(index: Index, rows: DataFrame, query: str, filters: Filters = Filters()) -> DataFrame:
    hits = narrowed(bm25.match_any(index, query, within=within(index, filters)), rows, filters).where(F.col("type") != SUMMARY)
    return near(hits.orderBy("score", "id").limit(SAMPLE), F.lit(NEAR_MARGIN))


def search(exact: Index, stemmed: Index, rows: DataFrame, query: str, limit: int = DEFAULT_LIMIT, mode: str = "all", filters: Filters = Filters(), more: bool = False) -> DataFrame:
    """(id, title, score, stage, partial): the first stage that answers, after exact topic keys. Bodies are joined last.

    more: one row beyond the limit is returned if there is one, so that a caller can tell."""
    if not query.strip():
        raise ValueError("an empty query")
    limit = max(1, min(limit, MAX_LIMIT)) + bool(more)
    match = bm25.match_all if mode == "all" else bm25.match_any
    topics = staged(topic_hits(rows, query, filters), limit, 1, F.desc("updated_at"), "id")
    both = [narrowed(match(i, query, within=within(i, filters)), rows, filters).select("id", "score") for i in (stemmed, exact)]
    strict = fused(*both, limit)
    found = staged(strict, limit, 2, F.desc("fused"), "score", "id")
    # a query that any stage answers is not widened, be it by a topic key alone
    if mode == "all" and topics.unionByName(found).isEmpty():
        found = staged(widened(stemmed, rows, query, limit, filters), limit, 3, "score", "id")
        if found.isEmpty():
            found = staged(nearest(stemmed, rows, query, filters), limit, 4, "score", "id")
    every = topics.unionByName(found.join(topics.select("id"), "id", "left_anti"))
    top = every.orderBy("stage", "place").limit(limit)
    return top.join(rows.where("deleted_at is null").select("id", "title", "type", "project"), "id").orderBy("stage", "place").drop("place")


def staged(hits: DataFrame, limit: int, stage: int, *order) -> DataFrame:
    """(id, score, stage, partial, place): the first hits in the order that a stage gives them."""
    top = hits.orderBy(*order).limit(limit)
    place = F.row_number().over(Window.orderBy(*order))  # at most `limit` rows
    return top.select("id", "score", F.lit(stage).alias("stage"), F.lit(stage > 2).alias("partial"), place.alias("place"))


def elsewhere(exact: Index, rows: DataFrame, query: str, filters: Filters, cap: int = 100) -> int:
    """How many rows outside the project would have answered; counted up to a cap."""
    free = Filters(filters.kind, None, filters.scope)
    return narrowed(bm25.match_all(exact, query), rows, free).limit(cap).count()


def prompt_recall(index: Index, rows: DataFrame, prompt: str, project: str, limit: int = 3) -> DataFrame:
    """Notes of a project that a prompt recalls; the newest of it must stand out more than others."""
    import re

    words = list(dict.fromkeys(w for w in re.findall(r"\w+", prompt.lower()) if len(w) >= 3))[: bm25.MAX_ANY_TERMS]
    mine = rows.where(Filters(project=project).where() & (F.col("type") != SUMMARY) & (F.trim("title") != ""))
    hits = bm25.match_any(index, words, within=within(index, Filters(project=project))).withColumnRenamed("doc_id", "id").join(mine.select("id", "type"), "id")
    sample = hits.orderBy("score", "id").limit(SAMPLE)
    newest = rows.where(Filters(project=project).where()).orderBy(F.desc("created_at"), F.desc("id")).limit(RECENT).select("id", F.lit(True).alias("new"))
    middle = sample.agg(upper_median(F.collect_list("score")).alias("middle"), F.count("*").alias("n_sample"))
    told = sample.join(F.broadcast(newest), "id", "left").crossJoin(F.broadcast(middle))
    margin = F.when(F.coalesce("new", F.lit(False)), RECENT_MARGIN).otherwise(NEAR_MARGIN)
    return told.where((F.col("n_sample") >= LEAST_SAMPLE) & (F.col("score") <= F.col("middle") * margin)).select("id", "score").orderBy("score", "id").limit(limit)


def unshown(hits: DataFrame, shown: DataFrame, caveats: DataFrame) -> DataFrame:
    """Without the ids already shown, unless a caveat warns of them."""
    known = shown.select("id").join(caveats.select("id").distinct(), "id", "left_anti")
    return hits.join(known, "id", "left_anti")


SHOWN = 1200


def remembered(shown: DataFrame) -> DataFrame:
    """The ids shown last, as many as are remembered. shown: (id, shown_at)."""
    return shown.groupBy("id").agg(F.max("shown_at").alias("shown_at")).orderBy(F.desc("shown_at"), F.desc("id")).limit(SHOWN).select("id")


def page(index: Index, rows: DataFrame, query: str, offset: int, limit: int, filters: Filters = Filters(), weights: dict[str, float] = bm25.SEARCH_WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(rows of the page, one row of total): prefix search; newest first if the query is blank."""
    if not query.strip():
        live = rows.where(filters.where())
        return live.select("id", F.lit(0.0).alias("score"), "created_at").orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit).select("id", "score"), live.agg(F.count("*").alias("total"))
    hits = narrowed(bm25.match_prefix(index, query, weights, within(index, filters)), rows, filters)
    return hits.orderBy("score", "id").offset(offset).limit(limit).select("id", "score"), hits.agg(F.count("*").alias("total"))


def prompt_page(index: Index, prompts: DataFrame, query: str, offset: int, limit: int, project: str | None = None) -> DataFrame:
    """(id, score) of a page of prompts by prefix search, with a row to spare; newest first if the query is blank."""
    mine = prompts if not project or not project.strip() else prompts.where(F.lower(F.coalesce("project", F.lit(""))) == T.project(F.lit(project)))
    if not query.strip():
        return mine.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit + 1).select("id", F.lit(0.0).alias("score"))
    hits = bm25.match_prefix(index, query, {}, within(index, Filters(project=project))).withColumnRenamed("doc_id", "id").join(mine.select("id"), "id", "left_semi")
    return hits.orderBy("score", "id").offset(offset).limit(limit + 1)


def session_page(index: Index, rows: DataFrame, sessions: DataFrame, query: str, offset: int, limit: int) -> DataFrame:
    """Sessions by how many of their notes match."""
    hits = narrowed(bm25.match_prefix(index, query), rows, Filters()).select("id")
    n = rows.join(hits, "id", "left_semi").groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n_matches"))
    return n.join(sessions.select("id"), "id", "left_semi").orderBy(F.desc("n_matches"), "id").offset(offset).limit(limit)


def session_total(index: Index, rows: DataFrame, sessions: DataFrame, query: str) -> DataFrame:
    """One row: how many sessions hold a note that matches."""
    hits = narrowed(bm25.match_prefix(index, query), rows, Filters()).select("id")
    found = rows.join(hits, "id", "left_semi").select(F.col("session_id").alias("id")).join(sessions.select("id"), "id", "left_semi")
    return found.agg(F.countDistinct("id").alias("total"))


def hints(asked: int, got: int, partial: bool, more: bool) -> list[str]:
    """What a caller should know about an answer, from what came back."""
    out = []
    if asked > MAX_LIMIT:
        out.append("clamped")
    if more:
        out.append("more")
    if got == 0:
        out.append("nothing")
    elif partial:
        out.append("partial")
    return out
