"""Replay of the change journal in batch; `keyed` follows it as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.numbering import numbered

MATRIX = {"session": ("upsert", "delete"), "observation": ("upsert", "delete"), "prompt": ("upsert", "delete"), "relation": ("upsert",)}
RETRIES, KEEP_DAYS = 5, 7


def payload(column: str = "payload") -> Column:
    """A payload as JSON text; one that was encoded twice is decoded once."""
    p = F.col(column)
    inner = F.from_json(F.concat(F.lit('{"v":'), p, F.lit("}")), "v string")["v"]
    return F.when(F.ltrim(p).startswith('"'), inner).otherwise(p)


def is_delete() -> Column:
    """A delete by its op, or an upsert that says so."""
    j = payload()
    flag = lambda k: F.get_json_object(j, f"$.{k}").isin("true", "1")
    when = F.trim(F.coalesce(F.get_json_object(j, "$.deleted_at"), F.lit(""))) != ""
    return (F.col("op") == "delete") | F.coalesce(flag("deleted"), F.lit(False)) | F.coalesce(flag("hard_delete"), F.lit(False)) | when


def new_changes(mutations: DataFrame, cursor: int) -> DataFrame:
    return mutations.where(F.col("seq") > cursor)


def replay(mutations: DataFrame, cursor: int = -1) -> DataFrame:
    """(entity, entity_key, seq, deleted, payload): where each key ends after all changes beyond the cursor. The last change by
    seq decides, so a change seen twice or late does no harm; one aggregate, combined before the shuffle."""
    m = new_changes(mutations, cursor).withColumn("deleted", is_delete())
    return m.groupBy("entity", "entity_key").agg(F.max(F.struct("seq", "deleted", "payload")).alias("last")).select("entity", "entity_key", "last.seq", "last.deleted", "last.payload")


def run_stream(spark: SparkSession, source: str, schema, state_dir: str, max_files: int = 10):
    """The replay as a stream of files, see `keyed.follow`; `state` reads where all keys end."""
    from . import keyed

    return keyed.follow(spark, source, schema, state_dir, max_files=max_files)


def state(spark: SparkSession, state_dir: str) -> DataFrame:
    from . import keyed

    return keyed.ends(spark, state_dir)


def fold_sessions(mutations: DataFrame) -> DataFrame:
    """Session upserts column by column: the last value that is not blank."""
    j = payload()
    get = lambda k: F.nullif(F.trim(F.get_json_object(j, f"$.{k}")), F.lit(""))
    cols = ("project", "directory", "started_at", "ended_at", "summary")
    m = mutations.where("entity = 'session' and op = 'upsert'").select(F.col("entity_key").alias("id"), "seq", *(get(c).alias(c) for c in cols))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return m.groupBy("id").agg(*(last(c) for c in cols))


def prompts_after_tombstones(prompts: DataFrame, tombstones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prompts accepted, tombstones left): a prompt no newer than its tombstone stays out, a newer one lifts it."""
    t = tombstones.select("sync_id", F.col("deleted_at").alias("_dead"))
    ok = prompts.join(t, "sync_id", "left").where("_dead is null or created_at > _dead").drop("_dead")
    return ok, tombstones.join(ok.select("sync_id"), "sync_id", "left_anti")


def apply_relations(relations: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applied, deferred): a relation waits until both its ends are there; a confidence out of bounds is null."""
    ids = rows.select("sync_id")
    c = relations.withColumn("confidence", F.when(T.is_confidence(F.col("confidence")), F.col("confidence")))
    there = c.join(ids.withColumnRenamed("sync_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("sync_id", "target_id"), "target_id", "left_semi")
    return there.select(*relations.columns), c.join(there.select("sync_id"), "sync_id", "left_anti").select(*relations.columns)


def replay_deferred(deferred: DataFrame, rows: DataFrame, batch: int | None = None) -> DataFrame:
    """Deferred changes (sync_id, source_id, target_id, retry_count) after a try: applied, deferred once more, or dead."""
    tried = deferred.orderBy("first_seen_at", "sync_id").limit(batch) if batch else deferred
    ids = rows.select("sync_id", F.lit(True).alias("there"))
    j = tried.join(ids.select(F.col("sync_id").alias("source_id"), F.col("there").alias("s")), "source_id", "left").join(ids.select(F.col("sync_id").alias("target_id"), F.col("there").alias("t")), "target_id", "left")
    ok = F.col("s").isNotNull() & F.col("t").isNotNull()
    n = F.col("retry_count") + F.when(ok, 0).otherwise(1)
    status = F.when(ok, "applied").when(n >= RETRIES, "dead").otherwise("deferred")
    return j.select("sync_id", "source_id", "target_id", n.alias("retry_count"), status.alias("apply_status"))


def acked(mutations: DataFrame, seqs: DataFrame, as_of: Column) -> DataFrame:
    """The journal after an acknowledgement; changes acknowledged longer ago than KEEP_DAYS go."""
    hit = seqs.select("seq", F.lit(True).alias("_hit"))
    now = mutations.join(hit, "seq", "left").withColumn("acked_at", F.when(F.col("_hit"), F.coalesce("acked_at", as_of)).otherwise(F.col("acked_at"))).drop("_hit")
    return now.where(F.col("acked_at").isNull() | (F.col("acked_at") >= as_of - F.expr(f"INTERVAL {KEEP_DAYS} DAYS"))).select(*mutations.columns)


def last_acked(mutations: DataFrame) -> DataFrame:
    return mutations.where("acked_at is not null").groupBy("target_key").agg(F.max("seq").alias("last_acked_seq"))


def sync_state(targets: DataFrame, states: DataFrame) -> DataFrame:
    """States of targets (target_key), with defaults where there is none."""
    return targets.join(states, "target_key", "left").select("target_key", F.coalesce("lifecycle", F.lit("idle")).alias("lifecycle"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("last_enqueued_seq", "last_acked_seq", "last_pulled_seq", "consecutive_failures")))


def leased(states: DataFrame, target: str, owner: str, as_of: Column, seconds: int) -> DataFrame:
    """States after an attempt to lease: granted if free, one's own, or expired."""
    mine = (F.col("target_key") == target) & (F.col("lease_owner").isNull() | (F.col("lease_owner") == owner) | (F.col("lease_until") <= as_of))
    return states.withColumns({"lease_until": F.when(mine, as_of + F.expr(f"INTERVAL {seconds} SECONDS")).otherwise(F.col("lease_until")), "lease_owner": F.when(mine, F.lit(owner)).otherwise(F.col("lease_owner"))})


def released(states: DataFrame, target: str, owner: str) -> DataFrame:
    mine = (F.col("target_key") == target) & (F.col("lease_owner") == owner)
    return states.withColumns({c: F.when(~F.coalesce(mine, F.lit(False)), F.col(c)) for c in ("lease_owner", "lease_until")})


def failed(states: DataFrame, target: str, as_of: Column, standing: bool = False) -> DataFrame:
    n = F.col("consecutive_failures") + 1
    wait = F.lit(300.0) if standing else T.backoff_seconds(n)
    hit = F.col("target_key") == target
    return states.withColumns({"backoff_until": F.when(hit, (as_of.cast("double") + wait).cast("timestamp")).otherwise(F.col("backoff_until")), "consecutive_failures": F.when(hit, n).otherwise(F.col("consecutive_failures"))})


def checked(mutations: DataFrame, sessions: DataFrame) -> DataFrame:
    """(seq, problem): what a peer refuses a change for, null if nothing: entity and op, its key, required fields, its session, which the batch itself may bring."""
    j = payload()
    pairs = F.lit(False)
    for entity, ops in MATRIX.items():
        pairs = pairs | ((F.col("entity") == entity) & F.col("op").isin(*ops))
    ref = F.nullif(F.trim(F.get_json_object(j, "$.session_id")), F.lit(""))
    own = mutations.where("entity = 'session' and op = 'upsert'").select(F.coalesce(F.nullif(F.trim(F.get_json_object(j, "$.id")), F.lit("")), F.col("entity_key")).alias("_ref"))
    known = sessions.select(F.col("id").alias("_ref")).union(own).distinct().withColumn("_known", F.lit(True))
    m = mutations.withColumn("_ref", F.when(F.col("entity").isin("observation", "prompt") & (F.col("op") == "upsert"), ref))
    # changes that name no session take no part in the join, where they would all meet in one task
    m = m.where("_ref is not null").join(known, "_ref", "left").unionByName(m.where("_ref is null").withColumn("_known", F.lit(None).cast("boolean")))
    key = F.get_json_object(j, "$.sync_id")
    blank = lambda k: F.trim(F.coalesce(F.get_json_object(j, f"$.{k}"), F.lit(""))) == ""
    why = (
        F.when(~pairs, "entity_op")
        .when(F.get_json_object(j, "$").isNull(), "payload")
        .when(F.trim("entity_key") == "", "key")
        .when(key.isNotNull() & (key != F.col("entity_key")), "key_mismatch")
        .when((F.col("entity") == "relation") & (blank("source_id") | blank("target_id") | blank("relation")), "relation_fields")
        .when(F.col("_ref").isNotNull() & F.col("_known").isNull(), "session")
    )
    return m.select("seq", why.alias("problem"))


def materialise_chunks(mutations: DataFrame, limit: int = 100) -> DataFrame:
    """(project, chunk, chunk_id, n, body): changes in chunks of at most `limit`, 1 to 100, by order of seq within a project. A project with all
    changes is numbered and packed by all tasks."""
    if not 1 <= limit <= 100:
        raise ValueError("a chunk holds 1 to 100 changes")
    c = numbered(mutations.select("project", "seq", "entity", "entity_key", "op", "payload"), ["project"], ["seq", "entity", "entity_key"])
    c = c.withColumn("chunk", F.floor((F.col("place") - 1) / limit).cast("long"))
    body = F.to_json(F.array_sort(F.collect_list(F.struct("seq", "entity", "entity_key", "op", "payload"))))
    return c.groupBy("project", "chunk").agg(F.count("*").alias("n"), body.alias("body")).withColumn("chunk_id", T.chunk_id(F.col("body")))


def nudge(sessions: DataFrame, rows: DataFrame, as_of: Column, minutes: int = 15, young: int = 5, nudged: DataFrame | None = None) -> DataFrame:
    """Sessions in which nothing has been saved for a while: id, idle_minutes. nudged: (id, nudged_at) of those told before, which
    are told again only once as many minutes have passed."""
    last = rows.groupBy("session_id").agg(F.max("created_at").alias("saved_at"))
    j = sessions.join(last, sessions["id"] == last["session_id"], "left")
    since = lambda c: F.floor((F.unix_seconds(as_of) - F.unix_seconds(c)) / 60)
    j = j.select("id", since(F.greatest("started_at", F.coalesce("saved_at", "started_at"))).alias("idle_minutes"), since("started_at").alias("age"))
    due = j.where((F.col("idle_minutes") >= minutes) & (F.col("age") >= young)).select("id", "idle_minutes")
    if nudged is not None:
        due = due.join(nudged.where(since("nudged_at") < minutes).select("id"), "id", "left_anti")
    return due


def delete_session(ids: DataFrame, sessions: DataFrame, prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions, prompts) after a peer's removals; a blank id removes nothing."""
    gone = ids.where(F.trim("id") != "").select("id")
    return sessions.join(gone, "id", "left_anti"), prompts.join(gone.select(F.col("id").alias("session_id")), "session_id", "left_anti")


def deduplicated_stream(stream: DataFrame, minutes: int = 15) -> DataFrame:
    """An approximation of the windowed dedupe for streams: a repeat within the watermark of the first one is dropped, also
    where the exact rule, which compares with the last kept row, would keep it."""
    return stream.withWatermark("created_at", f"{minutes} minutes").dropDuplicatesWithinWatermark(["normalized_hash", "project", "scope", "type", "title"])


def peer_stats(chunks: DataFrame, mutations: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: chunks, changes, sessions and projects that a peer holds."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(chunks, "n_chunks").crossJoin(n(mutations, "n_mutations")).crossJoin(n(sessions, "n_sessions")).crossJoin(n(mutations.select("project").distinct(), "n_projects"))  # one row each


def sync_enabled(projects: DataFrame, controls: DataFrame) -> DataFrame:
    """Projects with whether they are synchronised; one without a control is."""
    return projects.select("project").join(controls.select("project", "enabled"), "project", "left").select("project", F.coalesce("enabled", F.lit(True)).alias("enabled"))


def queued_relations(relations: DataFrame, rows: DataFrame, enrolled: DataFrame) -> DataFrame:
    """(sync_id, project, payload) of relations to send: of the source's project, else of the target's, if it is enrolled."""
    p = rows.select("sync_id", F.nullif(F.coalesce("project", F.lit("")), F.lit("")).alias("project"))
    j = relations.join(p.select(F.col("sync_id").alias("source_id"), F.col("project").alias("sp")), "source_id", "left").join(p.select(F.col("sync_id").alias("target_id"), F.col("project").alias("tp")), "target_id", "left")
    body = F.to_json(F.struct("sync_id", "source_id", "target_id", "relation", "judgment_status"))
    return j.select("sync_id", F.coalesce("sp", "tp").alias("project"), body.alias("payload")).join(enrolled.select("project").distinct(), "project", "left_semi")


def set_enabled(controls: DataFrame, changes: DataFrame) -> DataFrame:
    """Controls (project, enabled) after projects are paused or resumed; the last change by seq counts."""
    last = changes.groupBy("project").agg(F.max_by("enabled", "seq").alias("enabled"))
    return controls.select("project", "enabled").join(last.select("project"), "project", "left_anti").unionByName(last)


def changed_grants(grants: DataFrame, given: DataFrame, taken: DataFrame) -> DataFrame:
    """Grants (principal, project) after some are given and then some taken."""
    return grants.select("principal", "project").union(given.select("principal", "project")).distinct().join(taken.select("principal", "project"), ["principal", "project"], "left_anti")


def authenticated(tokens: DataFrame, principals: DataFrame) -> DataFrame:
    """(token_hash, principal, name) of tokens that are not revoked, of principals that are there."""
    t = tokens.where("revoked_at is null").select("token_hash", F.col("principal_id").alias("principal"))
    return t.join(principals.select(F.col("id").alias("principal"), "name"), "principal")
