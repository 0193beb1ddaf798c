"""Lists, pages and point lookups. Every order ends in the id, so ties never move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SUMMARY = T.SESSION_SUMMARY


def live(rows: DataFrame) -> DataFrame:
    return rows.where("deleted_at is null")


def narrow(rows: DataFrame, **equal) -> DataFrame:
    """Equality on the columns given; a filter that is None or blank is no clause at all."""
    for c, v in equal.items():
        if v is not None and str(v).strip() != "":
            rows = rows.where(F.col(c) == v)
    return rows


def in_projects(rows: DataFrame, names: list[str]) -> DataFrame:
    names = [n for n in names if n.strip()]
    return rows.where(F.col("project").isin(*names)) if names else rows


def same_project(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))


def within_minutes(at: Column, as_of: Column, minutes: int) -> Column:
    return at >= as_of - F.expr(f"INTERVAL {max(1, minutes)} MINUTES")


def by_id(rows: DataFrame, key, id_col: str = "id") -> DataFrame:
    return rows.where(F.col(id_col) == key)


def lookup(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, status, deleted_at) of each id asked for: found, deleted or missing."""
    there = rows.select("id", "deleted_at", F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "missing").when(F.col("deleted_at").isNotNull(), "deleted").otherwise("found")
    return wanted.join(there, "id", "left").select("id", status.alias("status"), "deleted_at")


def recent(rows: DataFrame, limit: int = 20, summaries: bool = True, **equal) -> DataFrame:
    out = narrow(live(rows), **equal)
    out = out if summaries else out.where(F.col("type") != SUMMARY)
    return out.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def context_memories(rows: DataFrame, limit: int, **equal) -> DataFrame:
    return recent(rows.where("not pinned"), limit, summaries=False, **equal)


def pinned(rows: DataFrame, limit: int, **equal) -> tuple[DataFrame, DataFrame]:
    """(the newest pinned, one row of how many were left out)."""
    all_ = narrow(live(rows).where("pinned"), **equal)
    return all_.orderBy(F.desc("created_at"), F.desc("id")).limit(limit), all_.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("omitted"))


def due(rows: DataFrame, as_of: Column) -> DataFrame:
    return live(rows).where(F.col("review_after").isNotNull() & (F.col("review_after") <= as_of))


def review_queue(rows: DataFrame, as_of: Column, limit: int, **equal) -> DataFrame:
    return narrow(due(rows, as_of), **equal).orderBy("review_after", "id").limit(limit)


def session_page(rows: DataFrame, session: str, offset: int, limit: int) -> DataFrame:
    return live(rows).where(F.col("session_id") == session).orderBy("created_at", "id").offset(offset).limit(limit)


def page(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    return live(rows).orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def with_more(rows: DataFrame, limit: int) -> DataFrame:
    """One row beyond the limit, if there is one."""
    return rows.limit(limit + 1)


def outside_count(rows: DataFrame, project: str, cap: int = 100) -> DataFrame:
    """How many notes lie outside the project, counted no further than the cap."""
    other = live(rows).where((F.col("type") != SUMMARY) & ~F.coalesce(F.col("project") == project, F.lit(False)))
    return other.select("id").limit(cap).agg(F.count("*").alias("n"))


def newest_summary(rows: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """The newest summary of each session (id column of sessions)."""
    s = live(rows).where(F.col("type") == SUMMARY)
    if sessions is not None:
        s = s.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    return s.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def session_goal(sessions: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, goal): the session's own summary, else the goal line of its newest summary note."""
    s = newest_summary(rows).select(F.col("session_id").alias("id"), F.col("content").alias("note"))
    own = F.when(F.trim(F.coalesce("summary", F.lit(""))) != "", F.col("summary"))
    return sessions.join(s, "id", "left").select("id", F.coalesce(own, T.goal_of(F.col("note"))).alias("goal"))


def timeline(rows: DataFrame, focus: DataFrame, before: int = 5, after: int = 5, most: int = 20) -> DataFrame:
    """Neighbours of focus rows (id) in their sessions by id: focus_id, id, offset, n_before, n_after. One window, no self-join on ranges; the focus may be the whole table."""
    before, after = min(before, most), min(after, most)
    w = Window.partitionBy("session_id").orderBy("id")
    placed = live(rows).select("id", "session_id", F.row_number().over(w).alias("place"), F.count("*").over(Window.partitionBy("session_id")).alias("n"))
    f = placed.join(focus.select("id"), "id", "left_semi").select(F.col("id").alias("focus_id"), "session_id", F.col("place").alias("at"))
    wanted = f.withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn("place", F.col("at") + F.col("offset"))
    near = placed.join(wanted, ["session_id", "place"])
    return near.select("focus_id", "id", "offset", (F.col("at") - 1).alias("n_before"), (F.col("n") - F.col("at")).alias("n_after"))


def timeline_in_project(rows: DataFrame, focus_id: int, project: str, **how) -> DataFrame:
    """Empty unless the focus is of the project."""
    focus = rows.where((F.col("id") == focus_id) & same_project(F.col("project"), F.lit(project))).select("id")
    return timeline(rows, focus, **how)


def prompt_behind(saves: DataFrame, prompts: DataFrame, minutes: int = 30) -> DataFrame:
    """(id, prompt_sync_id): the latest prompt of the save's session; where the session was not named, the latest of the
    project within some minutes before. saves: id, session_id, session_named, project, created_at."""
    last = prompts.groupBy("session_id").agg(F.max_by("sync_id", "id").alias("by_session"))
    # prompts and saves meet in stretches of time, of which a save looks into its own and the one before
    stretch = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / (60 * minutes))
    p = prompts.select("project", F.col("created_at").alias("asked_at"), "sync_id", F.col("id").alias("prompt_id"), stretch("created_at").alias("stretch"))
    mine = saves.where("not session_named").select("id", "project", "created_at", F.explode(F.array(stretch("created_at"), stretch("created_at") - 1)).alias("stretch"))
    open_ = mine.join(p, ["project", "stretch"]).where(F.col("asked_at").between(F.col("created_at") - F.expr(f"INTERVAL {minutes} MINUTES"), F.col("created_at")))
    near = open_.groupBy("id").agg(F.max_by("sync_id", "prompt_id").alias("by_project"))
    return saves.join(last, "session_id", "left").join(near, "id", "left").select("id", F.coalesce("by_session", "by_project").alias("prompt_sync_id"))


def distinct_prompts(prompts: DataFrame, limit: int = 10, over: int = 3, most: int = 120) -> DataFrame:
    """The newest prompts that differ: once by text, then by what is left without a command."""
    newest = prompts.where(F.trim("content") != "").groupBy("content").agg(F.max("id").alias("id")).orderBy(F.desc("id")).limit(min(limit * over, most))
    w = Window.partitionBy(T.prompt_core(F.col("content"))).orderBy(F.desc("id"))  # over at most `most` rows
    return newest.withColumn("place", F.row_number().over(w)).where("place = 1").select("id", "content").orderBy(F.desc("id")).limit(limit)


def recent_prompts(prompts: DataFrame, limit: int, **equal) -> DataFrame:
    return narrow(prompts, **equal).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def preview(rows: DataFrame, most: int = 400) -> DataFrame:
    """Bodies cut to `most` bytes and whether they were."""
    return rows.withColumn("content_truncated", F.octet_length("content") > most).withColumn("content", T.truncate_bytes_marked(F.col("content"), most))


def pending(mutations: DataFrame, allowed: list[str], limit: int = 100) -> DataFrame:
    """Local changes not acknowledged, of allowed projects; no allowed project, no changes."""
    names = [a for a in allowed if a.strip()]
    some = F.lit(True) if "*" in names else F.col("project").isin(*names) if names else F.lit(False)
    return mutations.where(F.col("acked_at").isNull() & (F.col("source") == "local") & some).orderBy("seq").limit(max(1, min(limit, 100)))


def since(mutations: DataFrame, cursor: int, limit: int) -> DataFrame:
    """A page of changes after a cursor with a row to spare."""
    return mutations.where(F.col("seq") > cursor).orderBy("seq").limit(limit + 1)


def since_page(mutations: DataFrame, cursor: int, limit: int) -> DataFrame:
    """A page of changes after a cursor; on each row whether more follow, and the latest seq of the journal."""
    top = mutations.agg(F.max("seq").alias("latest"))
    spare = since(mutations, cursor, limit)
    n = spare.agg((F.count("*") > limit).alias("has_more"))
    return spare.orderBy("seq").limit(limit).crossJoin(F.broadcast(n)).crossJoin(F.broadcast(top))  # one row each


def deferred_page(deferred: DataFrame, status: str, offset: int, limit: int) -> DataFrame:
    valid = F.get_json_object("payload", "$").isNotNull()
    return deferred.where(F.col("apply_status") == status).withColumn("payload_valid", valid).orderBy("first_seen_at", "sync_id").offset(offset).limit(limit)
