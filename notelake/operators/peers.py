"""A peer's changes applied to the stored tables, a whole page of the journal at once.

What a key ends as depends on the order of its changes alone, so each is worked out by aggregates over them: the last upsert counts for
the body, the last value given for what an upsert may leave out, and nothing counts that came before a removal for good.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written
from ..streaming import replication as R
from . import relations as G
from .writes import BODY_BYTES

_TEXTS = ("sync_id", "session_id", "type", "title", "content", "tool_name", "project", "scope", "topic_key", "prompt_sync_id", "created_at", "updated_at", "last_seen_at", "deleted_at")


def _some(x: Column) -> Column:
    """The text, or null if it is blank."""
    return F.when(F.trim(x) != "", x)


def _changes(mutations: DataFrame, entity: str, key: str) -> DataFrame:
    """(seq, key, deleted, hard, field texts) of an entity's changes; the key is the payload's, or else the change's own."""
    fields = (*_TEXTS, "id", "deleted", "hard_delete", "revision_count", "duplicate_count")
    read = F.from_json(R.payload(), ", ".join(f"{c} string" for c in fields))
    m = mutations.where(F.col("entity") == entity).select("seq", "entity_key", "op", read.alias("p"))
    says = lambda c: F.coalesce(F.col("p")[c].isin("true", "1"), F.lit(False))
    own = F.coalesce(_some(F.trim(F.col("p")[key])), F.trim("entity_key"))
    gone = (F.col("op") == "delete") | says("deleted") | says("hard_delete") | (F.trim(F.coalesce(F.col("p")["deleted_at"], F.lit(""))) != "")
    cols = [F.col("p")[c].alias(c) for c in _TEXTS if c != key]
    return m.select("seq", own.alias("key"), gone.alias("deleted"), says("hard_delete").alias("hard"), *cols, *(F.col("p")[c].cast("long").alias(c) for c in ("revision_count", "duplicate_count"))).where("key <> ''")


def named(mutations: DataFrame, entity: str, key: str) -> DataFrame:
    """The keys that an entity's changes name."""
    return _changes(mutations, entity, key).select(F.col("key").alias(key)).distinct()


def _last(c: Column | str, given: Column) -> Column:
    """The last value in order of seq, of the changes for which one is given."""
    return F.max_by(c, F.when(given, F.col("seq")))


def observations(rows: DataFrame, mutations: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes afterwards, keys removed for good, changes refused: seq, problem). An upsert keeps counters that it does not give, times that it
    leaves blank and the prompt behind the note; it brings a deleted note back. A removal of what is not there does nothing."""
    m = written(_changes(mutations, "observation", "sync_id"), "changes")
    blank = ~F.col("deleted") & (F.trim(F.coalesce("session_id", F.lit(""))) == "")
    refused = m.where(blank).select("seq", F.lit("observation_fields").alias("problem"))
    m = m.where(~blank)
    gone = m.where("deleted and hard").groupBy("key").agg(F.max("seq").alias("h"))
    m = m.join(gone, "key", "left").where("h is null or seq > h")
    # a removal counts if there is something to remove: a stored note, or an upsert before it
    begun = m.where("not deleted").groupBy("key").agg(F.min("seq").alias("begun"))
    m = m.join(begun, "key", "left").join(rows.select(F.col("sync_id").alias("key"), F.lit(True).alias("held")), "key", "left")
    m = m.where("not deleted or (held and h is null) or seq > begun")
    up, soft = ~F.col("deleted"), F.col("deleted")
    m = m.withColumns({
        "type": T.kind(F.coalesce("type", F.lit(""))), "title": T.title(F.coalesce("title", F.lit("")), BODY_BYTES), "content": T.truncate_bytes_marked(T.strip_private(F.coalesce("content", F.lit(""))), BODY_BYTES),
        "project": F.nullif(T.project(F.coalesce("project", F.lit(""))), F.lit("")), "scope": T.scope(F.col("scope")), "topic_key": T.topic_key(F.col("topic_key")),
        **{c: T.timestamp(F.trim(c)) for c in ("created_at", "updated_at", "last_seen_at", "deleted_at")},
    })
    body = ("session_id", "type", "title", "content", "tool_name", "project", "scope", "topic_key")
    given = {c: up & F.col(c).isNotNull() for c in ("created_at", "updated_at", "last_seen_at", "prompt_sync_id")}
    first = up & (F.col("seq") == F.col("begun")) & ~(F.coalesce("held", F.lit(False)) & F.col("h").isNull())  # the one that makes the note
    m = m.withColumn("updated_at", F.when(soft, F.coalesce("deleted_at", as_of)).when(first, F.coalesce("updated_at", "created_at", as_of)).otherwise(F.col("updated_at")))
    given["updated_at"] = F.col("updated_at").isNotNull()
    ends = m.groupBy("key").agg(
        _last(F.struct(*body), up).alias("u"), F.max(F.when(up, F.col("seq"))).alias("lu"), F.max(F.when(soft, F.col("seq"))).alias("ld"), _last(F.coalesce("deleted_at", as_of), soft).alias("d"),
        *(_last(c, up & (F.col(c) > 0)).alias(f"n_{c}") for c in ("revision_count", "duplicate_count")), *(_last(c, g).alias(f"n_{c}") for c, g in given.items()),
        F.min(F.when(up, F.col("type"))).alias("low"), F.max(F.when(up, F.col("type"))).alias("high"),
    )
    ends = written(ends.join(gone, "key", "full").withColumnRenamed("key", "sync_id"), "ends")
    j = rows.join(ends, "sync_id", "full").where("lu is not null or h is null")
    j = j.where("lu is not null or id is not null")
    base = F.col("id").isNotNull() & F.col("h").isNull()
    old = lambda c: F.when(base, F.col(c))
    hit, born = F.col("lu").isNotNull(), F.coalesce("n_created_at", old("created_at"), as_of)
    dead = F.col("ld") > F.coalesce("lu", F.lit(-1))
    same = (F.col("low") == old("type")) & (F.col("high") == old("type")) & old("review_after").isNotNull()
    fresh = T.review_after(F.col("u")["type"], born)
    kept = {c: F.when(hit, F.col("u")[c]).otherwise(F.col(c)) for c in body}
    kept |= {
        "normalized_hash": F.when(hit, T.body_hash(F.col("u")["content"])).otherwise(F.col("normalized_hash")),
        "revision_count": F.coalesce("n_revision_count", F.greatest(old("revision_count"), F.lit(1)), F.lit(1)), "duplicate_count": F.coalesce("n_duplicate_count", F.greatest(old("duplicate_count"), F.lit(1)), F.lit(1)),
        "created_at": F.when(hit, born).otherwise(F.col("created_at")), "updated_at": F.coalesce("n_updated_at", old("updated_at"), born),
        "deleted_at": F.when(dead, F.col("d")).when(~hit, F.col("deleted_at")), "review_after": F.when(hit, F.when(same & fresh.isNotNull(), old("review_after")).otherwise(fresh)).otherwise(F.col("review_after")),
        "pinned": F.coalesce(old("pinned"), F.lit(False)), "last_seen_at": F.coalesce("n_last_seen_at", old("last_seen_at")) if "last_seen_at" in rows.columns else F.lit(None),
        "prompt_sync_id": F.coalesce("n_prompt_sync_id", old("prompt_sync_id")) if "prompt_sync_id" in rows.columns else F.lit(None),
    }
    untouched = F.col("lu").isNull() & F.col("ld").isNull()
    cols = {c: F.when(untouched, F.col(c)).otherwise(x) for c, x in kept.items() if c in rows.columns}
    after = written(j.withColumn("new", ~base).withColumns(cols).select("new", *rows.columns), "applied")
    top = rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = after.where("new").drop("id").withColumn("id", F.monotonically_increasing_id()).crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + 1 + F.col("id"))  # one row
    removed = rows.select("sync_id").join(gone.select(F.col("key").alias("sync_id")), "sync_id", "left_semi")
    return after.where("not new").select(*rows.columns).unionByName(numbered.select(*rows.columns)), written(removed, "removed"), refused


def sessions(stored: DataFrame, mutations: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(sessions afterwards, ends: id and the seq of its last removal). Upserts are folded column by column after the last removal."""
    m = _changes(mutations, "session", "id")
    ends = m.where("deleted").groupBy(F.col("key").alias("id")).agg(F.max("seq").alias("ended"))
    live = mutations.join(m.where("not deleted").join(ends.withColumnRenamed("id", "key"), "key", "left").where("ended is null or seq > ended").select("seq", "key"), "seq").withColumn("entity_key", F.col("key")).withColumn("op", F.lit("upsert"))
    new = R.fold_sessions(live.where("entity = 'session'")).withColumns({"project": T.project(F.col("project")), **{c: T.timestamp(F.col(c)) for c in ("started_at", "ended_at")}})
    named = [c for c in ("project", "directory", "started_at", "ended_at", "summary") if c in stored.columns]
    kept = stored.join(ends, "id", "left_anti").join(new.select("id", *(F.col(c).alias(f"n_{c}") for c in named)), "id", "full")
    cols = {c: F.coalesce(f"n_{c}", c) for c in named}
    if "started_at" in named:
        cols["started_at"] = F.coalesce("n_started_at", "started_at", as_of)
    for c in ("project", "directory"):
        if c in named:
            cols[c] = F.coalesce(cols[c], F.lit(""))
    return kept.withColumns(cols).select(*stored.columns), ends


def prompts(stored: DataFrame, tombstones: DataFrame, mutations: DataFrame, ended: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prompts afterwards, tombstones afterwards, changes refused). A prompt no younger than its tombstone stays out; a younger one
    lifts it for all that follow. The prompts of a session go when it does."""
    m = written(_changes(mutations, "prompt", "sync_id"), "changes").withColumns({c: T.timestamp(F.trim(c)) for c in ("created_at", "deleted_at")})
    blank = ~F.col("deleted") & (F.trim(F.coalesce("session_id", F.lit(""))) == "")
    refused = m.where(blank).select("seq", F.lit("prompt_fields").alias("problem"))
    m = m.where(~blank)
    dels = m.where("deleted").groupBy("key").agg(F.max("seq").alias("ds"), F.max_by(F.struct(F.coalesce("deleted_at", as_of).alias("at"), "session_id", "project"), "seq").alias("dead"))
    held = tombstones.select(F.col("sync_id").alias("key"), F.col("deleted_at").alias("held"))
    ups = m.where("not deleted").join(dels, "key", "left").join(held, "key", "left").where("ds is null or seq > ds").withColumn("tomb", F.coalesce("dead.at", "held"))
    first = ups.where("tomb is null or created_at > tomb").groupBy("key").agg(F.min("seq").alias("first"))
    ups = ups.join(first, "key").where("seq >= first")
    new = ups.groupBy(F.col("key").alias("sync_id")).agg(F.max_by(F.struct("session_id", "content", "project"), "seq").alias("u"), _last("created_at", F.col("created_at").isNotNull()).alias("n_created"), F.max("seq").alias("lu"))
    new = written(new, "prompts")
    left = stored.join(dels.select(F.col("key").alias("sync_id")), "sync_id", "left_anti").join(new, "sync_id", "full")
    body = T.truncate_bytes_marked(T.strip_private(F.coalesce(F.col("u")["content"], F.lit(""))), BODY_BYTES)
    hit = F.col("lu").isNotNull()
    left = left.withColumns({"session_id": F.when(hit, F.col("u")["session_id"]).otherwise(F.col("session_id")), "content": F.when(hit, body).otherwise(F.col("content")), "project": F.when(hit, T.project(F.coalesce(F.col("u")["project"], F.lit("")))).otherwise(F.col("project")), "created_at": F.coalesce("n_created", "created_at", as_of)})
    left = left.join(ended.select(F.col("id").alias("session_id"), "ended"), "session_id", "left").where("ended is null or (lu is not null and lu > ended)")
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = written(left.where("id is null"), "fresh").withColumn("id", F.monotonically_increasing_id()).crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + 1 + F.col("id"))  # one row
    after = left.where("id is not null").select(*stored.columns).unionByName(fresh.select(*stored.columns))
    tombs = dels.select(F.col("key").alias("sync_id"), F.col("dead.session_id").alias("session_id"), F.coalesce("dead.project", F.lit("")).alias("project"), F.col("dead.at").alias("deleted_at"))
    every = tombstones.join(tombs.select("sync_id"), "sync_id", "left_anti").unionByName(tombs).join(new.select("sync_id"), "sync_id", "left_anti")
    return after, every, refused


def relations(stored: DataFrame, rows: DataFrame, removed: DataFrame, mutations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations afterwards, deferred ones: sync_id, payload). Those of removed notes are orphaned; new ones wait for both their ends."""
    get = lambda k: F.get_json_object(R.payload(), f"$.{k}")
    fields = ("source_id", "target_id", "relation", "judgment_status", "reason")
    m = mutations.where("entity = 'relation' and op = 'upsert'")
    m = m.select("seq", F.coalesce(_some(F.trim(get("sync_id"))), F.trim("entity_key")).alias("sync_id"), "payload", *(get(c).alias(c) for c in fields), get("confidence").cast("double").alias("confidence"))
    last = m.where("source_id is not null and target_id is not null").groupBy("sync_id").agg(F.max(F.struct("seq", "payload", *fields, "confidence")).alias("l")).select("sync_id", "l.*")
    there, waiting = R.apply_relations(last.drop("seq"), rows)
    cols = [c for c in (*fields, "confidence") if c in stored.columns]
    j = G.after_removal(stored, removed).join(there.select("sync_id", *(F.col(c).alias(f"n_{c}") for c in cols), F.lit(True).alias("hit")), "sync_id", "full")
    j = j.withColumns({c: F.when(F.col("hit"), F.col(f"n_{c}")).otherwise(F.col(c)) for c in cols})
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = written(j.where("id is null"), "edges").withColumn("id", F.monotonically_increasing_id()).crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + 1 + F.col("id"))  # one row
    return j.where("id is not null").select(*stored.columns).unionByName(fresh.select(*stored.columns)), waiting.select("sync_id", "payload")
