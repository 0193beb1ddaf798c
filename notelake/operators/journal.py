"""Changes captured from what a write did: rows before and after become ordered entries of the journal for the projects that are replicated.

Rows are compared by a hash of the fields that travel, so only keys are shuffled to find what changed, and bodies are joined to what
did. A pin or a review date stays at home and makes no entry. An entry belongs to the project of its row, else to that of its session; a project nobody
enrolled has none, the nameless one always does. A note that leaves a replicated project for one that is not is removed where it was watched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written

KEYS = {"session": "id", "observation": "sync_id", "prompt": "sync_id", "relation": "sync_id"}
#: What a peer receives of each entity.
FIELDS = {
    "session": ("id", "project", "directory", "started_at", "ended_at", "summary"),
    "observation": ("sync_id", "session_id", "type", "title", "content", "tool_name", "project", "scope", "topic_key", "prompt_sync_id", "revision_count", "duplicate_count", "last_seen_at", "created_at", "updated_at", "deleted_at"),
    "prompt": ("sync_id", "session_id", "content", "project", "created_at"),
    "relation": ("sync_id", "source_id", "target_id", "relation", "reason", "evidence", "confidence", "judgment_status", "marked_by_actor", "marked_by_kind", "marked_by_model", "session_id", "project", "created_at", "updated_at"),
}
RANK = {"session": 0, "observation": 1, "prompt": 2, "relation": 3}
_ENTRY = ("rank", "entity", "entity_key", "step", "op", "payload", "project", "session_id")


def differences(before: DataFrame, after: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, b, a): the rows that differ in a field, as structs before and after; null where there is none."""
    there = [c for c in fields if c in before.columns and c in after.columns]
    if key not in there:
        there.insert(0, key)
    marks = [F.col(c).isNull() for c in there]  # a hash skips nulls
    signed = lambda df: df.select(F.col(key).alias("key"), F.xxhash64(*there, *marks).alias("h"), F.xxhash64(F.lit(1), *there, *marks).alias("i"))
    old, new = signed(before), signed(after)
    keys = new.join(old, ["key", "h", "i"], "left_anti").select("key").unionByName(old.join(new.select("key"), "key", "left_anti").select("key")).distinct()
    packed = lambda df, name: df.select(F.col(key).alias("key"), F.struct(*there).alias(name))
    return keys.join(packed(before, "b"), "key", "left").join(packed(after, "a"), "key", "left")


def stamped(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _body(diff: DataFrame, which: str, but: tuple[str, ...] = ()) -> Column:
    """The fields of a row as JSON, times as text; what is null is left out."""
    fields = [f for f in diff.schema[which].dataType.fields if f.name not in but]
    cols = [stamped(F.col(which)[f.name]) if f.dataType.typeName() == "timestamp" else F.col(which)[f.name] for f in fields]
    return F.to_json(F.struct(*(c.alias(f.name) for c, f in zip(cols, fields))))


def _field(diff: DataFrame, which: str, name: str) -> Column:
    return F.col(which)[name] if name in diff.schema[which].dataType.names else F.lit(None).cast("string")


def _enrolled(df: DataFrame, enrolled: DataFrame, project: str, flag: str) -> DataFrame:
    e = enrolled.select(F.col("project").alias(project), F.lit(True).alias(flag)).distinct()
    return df.join(e, project, "left").withColumn(flag, F.coalesce(flag, F.col(project) == ""))


def entries(entity: str, before: DataFrame, after: DataFrame, sessions: DataFrame, enrolled: DataFrame, as_of: Column) -> DataFrame:
    """(rank, entity, entity_key, step, op, payload, project) for what changed between two states of an entity, of replicated projects only.
    before and after may be whole tables or just the rows a write touched."""
    d = differences(before, after, KEYS[entity], FIELDS[entity])
    name = lambda c: T.project(F.coalesce(c, F.lit("")))
    left, arrived = name(_field(d, "b", "project")), name(_field(d, "a", "project"))
    session = F.coalesce(_field(d, "a", "session_id"), _field(d, "b", "session_id")) if entity != "relation" else F.lit(None).cast("string")
    has = lambda which: F.col(which).isNotNull()
    tombstone = lambda own, project, at, hard: F.to_json(F.struct(F.col("key").alias(own), *([session.alias("session_id")] if own != "id" else []), project.alias("project"), F.lit(True).alias("deleted"), stamped(at).alias("deleted_at"), F.lit(hard).alias("hard_delete")))
    row = lambda step, op, payload, project: F.struct(F.lit(step).alias("step"), F.lit(op).alias("op"), payload.alias("payload"), project.alias("project"))
    rank = F.lit(RANK[entity])
    if entity == "observation":
        live_a, live_b = (has(w) & F.col(w)["deleted_at"].isNull() for w in ("a", "b"))
        body = [c for c in d.schema["a"].dataType.names if c not in ("deleted_at", "updated_at")]
        edited = ~F.struct(*(F.col("a")[c].alias(c) for c in body)).eqNullSafe(F.struct(*(F.col("b")[c].alias(c) for c in body)))
        died = live_b & has("a") & ~live_a
        made = F.array_compact(F.array(
            F.when(live_a | died & edited, row(0, "upsert", _body(d, "a", ("deleted_at",)), arrived)),
            F.when(live_b & has("a") & (left != arrived), row(1, "delete", tombstone("sync_id", left, as_of, False), left)),
            F.when(died, row(2, "delete", tombstone("sync_id", arrived, F.col("a")["deleted_at"], False), arrived)),
            F.when(~has("a"), row(2, "delete", tombstone("sync_id", left, as_of, True), left)),
        ))
    elif entity == "relation":
        # proposals stay at home until they are judged
        made = F.array_compact(F.array(F.when(has("a") & (F.col("a")["judgment_status"] == "judged"), row(0, "upsert", _body(d, "a"), arrived))))
    else:
        own = KEYS[entity]
        made = F.array(F.when(has("a"), row(0, "upsert", _body(d, "a"), arrived)).otherwise(row(0, "delete", tombstone(own, left, as_of, own != "id"), left)))
        rank = rank + F.when(~has("a"), 10 if own == "id" else 0).otherwise(0)  # a session goes last
    out = d.select(rank.alias("rank"), F.col("key").alias("entity_key"), session.alias("session_id"), arrived.alias("arrived"), F.explode(made).alias("e")).select("rank", "entity_key", "session_id", "arrived", "e.*")
    owner = sessions.select(F.col("id").alias("session_id"), T.project(F.coalesce("project", F.lit(""))).alias("_sp"))
    out = out.join(owner, "session_id", "left").withColumn("project", F.coalesce(F.nullif(F.col("project"), F.lit("")), "_sp", F.lit("")))
    out = _enrolled(_enrolled(out, enrolled, "project", "_sent"), enrolled, "arrived", "_there")
    # a removal from where a note was watched is told only if the note's new place does not carry it
    return out.where("_sent and (step <> 1 or not _there)").select("rank", F.lit(entity).alias("entity"), "entity_key", "step", "op", "payload", "project")


def watched_relations(relations: DataFrame, rows: DataFrame, enrolled: DataFrame) -> DataFrame:
    """Relations with the project of their source, of those whose source, or else target, is of an enrolled project."""
    p = rows.select("sync_id", F.nullif(F.coalesce("project", F.lit("")), F.lit("")).alias("project"))
    j = relations.join(p.select(F.col("sync_id").alias("source_id"), F.col("project").alias("_s")), "source_id", "left").join(p.select(F.col("sync_id").alias("target_id"), F.col("project").alias("_t")), "target_id", "left")
    j = j.withColumn("_w", F.coalesce("_s", "_t")).join(enrolled.select(F.col("project").alias("_w")).distinct(), "_w", "left_semi")
    return j.withColumn("project", F.col("_s")).drop("_s", "_t", "_w")


def numbered(found: DataFrame, after: int) -> DataFrame:
    """Entries with seq, from after + 1 in order of rank, key and step: numbered by partitions of a range sort, with what the partitions before hold."""
    by = ["rank", "entity", "entity_key", "step"]
    held = written(found.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_k", F.monotonically_increasing_id()), "entries")
    part, inside = F.shiftright("_k", 33), F.col("_k").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["p"], r["n"]) for r in held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one row a partition
    before, total = [], after + 1
    for p, n in sizes:
        before.append((p, total))
        total += n
    starts = held.sparkSession.createDataFrame(before, "_p long, _start long")
    return held.withColumn("_p", part).join(F.broadcast(starts), "_p").withColumn("seq", F.col("_start") + inside).drop("_k", "_p", "_start")


def appended(mutations: DataFrame, found: DataFrame, as_of: Column, target: str = "cloud") -> tuple[DataFrame, DataFrame]:
    """(the journal with new entries behind its last, the new entries)."""
    last = mutations.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    rows = numbered(found, last).select("seq", F.lit(target).alias("target_key"), "entity", "entity_key", "op", "payload", F.lit("local").alias("source"), "project", as_of.alias("occurred_at"), F.lit(None).cast("timestamp").alias("acked_at"))
    return mutations.unionByName(rows, allowMissingColumns=True), rows


def advanced(states: DataFrame, new: DataFrame, as_of: Column, target: str = "cloud") -> DataFrame:
    """The state of each target after new entries: pending, with the last number queued, for the whole store and for each project named."""
    every = F.array(F.lit(target), F.when(F.col("project") != "", F.concat(F.lit(f"{target}:"), "project")))
    last = new.select("seq", F.explode(F.array_compact(every)).alias("target_key")).groupBy("target_key").agg(F.max("seq").alias("_last"))
    j = states.join(last, "target_key", "full")
    hit = F.col("_last").isNotNull()
    cols = {"lifecycle": F.when(hit, "pending").otherwise(F.col("lifecycle")), "last_enqueued_seq": F.coalesce("_last", "last_enqueued_seq"), "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at"))}
    cols |= {c: F.coalesce(c, F.lit(0)) for c in ("last_acked_seq", "last_pulled_seq", "consecutive_failures") if c in states.columns}
    return j.withColumns({c: x for c, x in cols.items() if c in states.columns}).select(*states.columns)
