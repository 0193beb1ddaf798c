"""Projects: enrolment, merging, pruning, export and import, similar names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .listings import live


def session_project(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows with `owner`: their own project, else their session's, else blank."""
    s = sessions.select(F.col("id").alias("session_id"), F.col("project").alias("_sp"))
    return rows.join(s, "session_id", "left").withColumn("owner", F.coalesce(F.nullif(F.col("project"), F.lit("")), F.col("_sp"), F.lit(""))).drop("_sp")


def enrol_backlog(project: str, sessions: DataFrame, rows: DataFrame, prompts: DataFrame, relations: DataFrame) -> DataFrame:
    """(rank, entity, entity_key) to send when a project is enrolled: sessions, notes, prompts, relations, in this order."""
    o = session_project(live(rows), sessions).where(F.col("owner") == project)
    p = session_project(prompts, sessions).where(F.col("owner") == project)
    mine = o.select("sync_id")
    r = relations.join(mine.withColumnRenamed("sync_id", "source_id"), "source_id", "left_semi")
    used = o.select("session_id").union(p.select("session_id")).distinct().select(F.col("session_id").alias("id"))
    s = sessions.where(F.col("project") == project).select("id").union(used.join(sessions.select("id"), "id", "left_semi")).distinct()
    parts = [(0, "session", s, "id"), (1, "observation", o, "sync_id"), (2, "prompt", p, "sync_id"), (3, "relation", r, "sync_id")]
    out = None
    for rank, name, df, key in parts:
        one = df.select(F.lit(rank).alias("rank"), F.lit(name).alias("entity"), F.col(key).alias("entity_key"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy("rank", "entity_key")


def enqueue(mutations: DataFrame, sessions: DataFrame, enrolled: DataFrame) -> DataFrame:
    """Changes (seq, project, session_id, payload) with the project they belong to, of enrolled projects only."""
    s = sessions.select(F.col("id").alias("session_id"), F.col("project").alias("_sp"))
    j = mutations.join(s, "session_id", "left")
    owner = F.coalesce(F.nullif(F.col("project"), F.lit("")), F.nullif(F.get_json_object("payload", "$.project"), F.lit("")), F.col("_sp"))
    return j.withColumn("project", owner).drop("_sp").join(enrolled.select("project").distinct(), "project", "left_semi")


def variants(name: Column) -> Column:
    """Spellings of a name that differ in separators only, as one key."""
    return F.regexp_replace(F.lower(name), "[-_ .]+", "-")


def merge(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """mapping: (project, canonical)."""
    return rows.join(mapping, "project", "left").withColumn("project", F.coalesce("canonical", "project")).drop("canonical").select(*rows.columns)


def merge_collisions(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Topic keys that two notes of the merged projects would share."""
    m = merge(live(rows).where("topic_key is not null"), mapping).join(mapping.select(F.col("canonical").alias("project")).distinct(), "project", "left_semi")
    return m.groupBy("project", "topic_key", "scope").agg(F.count("*").alias("n")).where("n > 1")


def prunable(project: str, rows: DataFrame) -> DataFrame:
    """Whether a project may be pruned: not while it has a note, deleted ones included."""
    return rows.where(F.col("project") == project).limit(1).agg((F.count("*") == 0).alias("prunable"))


def delete_project(project: str, rows: DataFrame, sessions: DataFrame, prompts: DataFrame) -> DataFrame:
    """One row: notes and prompts that a hard delete removes, sessions it empties and removes, sessions it keeps."""
    o, p = rows.where(F.col("project") == project), prompts.where(F.col("project") == project)
    left_o, left_p = rows.where(~F.coalesce(F.col("project") == project, F.lit(False))), prompts.where(~F.coalesce(F.col("project") == project, F.lit(False)))
    mine = sessions.where(F.col("project") == project).select("id")
    empty = mine.join(left_o.select(F.col("session_id").alias("id")), "id", "left_anti").join(left_p.select(F.col("session_id").alias("id")), "id", "left_anti")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(o, "n_observations").crossJoin(n(p, "n_prompts")).crossJoin(n(empty, "n_emptied")).crossJoin(n(mine, "n_sessions"))  # one row each


def _of(project: str) -> Column:
    return F.coalesce("project", F.lit("")) == project


def deleted(project: str, rows: DataFrame, sessions: DataFrame, prompts: DataFrame, as_of: Column, hard: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, sessions, prompts) after a project is deleted: its notes marked, or removed for good; its prompts removed; of its
    sessions those that then hold nothing, which a soft delete leaves to those whose notes are elsewhere or never were."""
    mine = _of(project)
    if hard:
        left = rows.where(~mine)
    else:
        hit = mine & F.col("deleted_at").isNull()
        left = rows.withColumns({"updated_at": F.when(hit, as_of).otherwise(F.col("updated_at")), "deleted_at": F.when(hit, as_of).otherwise(F.col("deleted_at"))})
    kept = prompts.where(~mine)
    used = left.select(F.col("session_id").alias("id")).union(kept.select(F.col("session_id").alias("id"))).distinct()
    return left, sessions.where(~mine).unionByName(sessions.where(mine).join(used, "id", "left_semi")), kept


def pruned(project: str, rows: DataFrame, sessions: DataFrame, prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions, prompts) without those of a project that has no note; refused while it has one, deleted ones included."""
    if not rows.where(_of(project)).isEmpty():
        raise ValueError(f"project {project!r} still has notes")
    return sessions.where(~_of(project)), prompts.where(~_of(project))


def merged_enrolment(enrolled: DataFrame, mapping: DataFrame) -> DataFrame:
    """Enrolled projects after a merge: a canonical name is enrolled if one of its variants was."""
    return enrolled.join(mapping, "project", "left").select(F.coalesce("canonical", "project").alias("project")).distinct()


def created_by_merge(mapping: DataFrame, *tables: DataFrame) -> DataFrame:
    """(project, created): the canonical names, and whether none of the tables had it before."""
    names = mapping.select(F.col("canonical").alias("project")).distinct()
    held = tables[0].select("project")
    for t in tables[1:]:
        held = held.union(t.select("project"))
    return names.join(held.distinct().withColumn("held", F.lit(True)), "project", "left").select("project", F.col("held").isNull().alias("created"))


def same_name(names: DataFrame) -> DataFrame:
    """(project, canonical) of names that differ in separators only: the least of them is canonical."""
    n = names.select("project").where("project is not null and project <> ''").distinct().withColumn("like", variants(F.col("project")))
    least = n.groupBy("like").agg(F.min("project").alias("canonical"))
    return n.join(least, "like").where("project <> canonical").select("project", "canonical")


def renamed(sessions: DataFrame, detected: DataFrame) -> DataFrame:
    """(project, canonical) to merge: projects called after the directory they were recorded in, where the directory is now known to
    belong to another. detected: (directory, project)."""
    base = T.project(F.col("directory"))
    d = detected.select(T.directory_key(F.col("directory")).alias("at"), base.alias("base"), F.col("project").alias("canonical")).where("base <> '' and base <> canonical")
    there = sessions.select(T.directory_key(F.col("directory")).alias("at"), F.col("project").alias("base")).distinct()
    return d.join(there, ["at", "base"]).select(F.col("base").alias("project"), "canonical").distinct()


def enrolled_journal(mutations: DataFrame, project: str) -> DataFrame:
    """The journal without the unacknowledged changes of a project, which its enrolment sends anew."""
    return mutations.where(~(_of(project) & F.col("acked_at").isNull()))


def export(project: str | None, rows: DataFrame, sessions: DataFrame, prompts: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """The tables of an export; relations only if both ends are in it."""
    if project:
        rows, prompts = (session_project(t, sessions).where(F.col("owner") == project).drop("owner") for t in (rows, prompts))
        used = rows.select("session_id").union(prompts.select("session_id")).distinct().select(F.col("session_id").alias("id"))
        sessions = sessions.where(F.col("project") == project).unionByName(sessions.where(F.col("project") != project).join(used, "id", "left_semi"))
    ends = rows.select("sync_id")
    relations = relations.join(ends.withColumnRenamed("sync_id", "source_id"), "source_id", "left_semi").join(ends.withColumnRenamed("sync_id", "target_id"), "target_id", "left_semi")
    return {"sessions": sessions, "observations": rows, "prompts": prompts, "relations": relations}


def import_new(theirs: dict[str, DataFrame], ours: dict[str, DataFrame], tombstones: DataFrame) -> dict[str, DataFrame]:
    """What an import adds: rows not held; no prompt with a tombstone; relations whose ends are there afterwards."""
    s = theirs["sessions"].join(ours["sessions"].select("id"), "id", "left_anti").dropDuplicates(["id"])
    o = theirs["observations"].join(ours["observations"].select("sync_id"), "sync_id", "left_anti").dropDuplicates(["sync_id"])
    p = theirs["prompts"].join(ours["prompts"].select("sync_id"), "sync_id", "left_anti").join(tombstones.select("sync_id"), "sync_id", "left_anti").dropDuplicates(["sync_id"])
    ends = ours["observations"].select("sync_id").unionByName(o.select("sync_id"))
    r = theirs["relations"].join(ours["relations"].select("sync_id"), "sync_id", "left_anti").dropDuplicates(["sync_id"])
    r = r.join(ends.withColumnRenamed("sync_id", "source_id"), "source_id", "left_semi").join(ends.withColumnRenamed("sync_id", "target_id"), "target_id", "left_semi")
    return {"sessions": s, "observations": o, "prompts": p, "relations": r}


SHORT = 10


def similar_names(names: DataFrame, most: int = 3) -> DataFrame:
    """(a, b, why) of project names that look alike: in case, one in the other, or at most min(most, half the shorter) edits apart.

    Names meet on a shared pair of letters, which one that holds the other has, and which survives three edits in names of eight letters and
    more. Shorter ones can only be near names of at most SHORT letters, which meet as one group; single letters meet the names that hold them."""
    n = names.select(F.col("project").alias("name")).distinct()
    low = F.lower("name")
    pairs = F.when(F.length(low) > 1, F.transform(F.sequence(F.lit(1), F.length(low) - 1), lambda i: F.substring(low, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    short = F.when(F.length(low) <= SHORT, F.array(F.lit("short"))).otherwise(F.array().cast("array<string>"))
    g = n.select("name", F.explode(F.array_distinct(F.concat(pairs, short))).alias("gram"))
    met = g.withColumnRenamed("name", "a").join(g.withColumnRenamed("name", "b"), "gram").where("a < b").select("a", "b")
    one = n.where(F.length("name") == 1).select(F.col("name").alias("x"), low.alias("gram"))
    letters = n.where(F.length("name") > SHORT).select(F.col("name").alias("y"), F.explode(F.array_distinct(F.split(low, ""))).alias("gram"))
    met = met.unionByName(letters.join(one, "gram").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()
    la, lb = F.lower("a"), F.lower("b")
    bound = F.greatest(F.least(F.lit(most), F.floor(F.least(F.length("a"), F.length("b")) / 2)), F.lit(1))
    why = F.when(la == lb, "case").when(la.contains(lb) | lb.contains(la), "substring").when(F.levenshtein(la, lb) <= bound, "edits")
    return met.select("a", "b", why.alias("why")).where("why is not null")


def shared_directories(sessions: DataFrame) -> DataFrame:
    """Pairs of projects that alone share a directory."""
    d = sessions.where("trim(directory) <> ''").groupBy("directory").agg(F.array_sort(F.collect_set("project")).alias("p")).where("size(p) = 2")
    return d.select("directory", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))


def granted(grants: DataFrame, project: str) -> DataFrame:
    return grants.where(F.col("project").isin(project, "*")).select("principal").distinct()
