"""What a batch of saves and edits does to the notes: new frames, no update in place."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written

DEDUPE_MINUTES, ECHO_SECONDS, BODY_BYTES = 15, 2, 50_000


def normalised(saves: DataFrame) -> DataFrame:
    """Fields as they are stored, and why a save is refused (null: it is not). Kinds outside the vocabulary are stored."""
    body = T.truncate_bytes_marked(T.strip_private(F.col("content")), BODY_BYTES)
    kind = T.kind(F.col("type"))
    out = saves.withColumns({"type": kind, "title": T.title(F.col("title"), BODY_BYTES), "content": body, "project": F.nullif(T.project(F.coalesce("project", F.lit(""))), F.lit("")), "scope": T.scope(F.col("scope")), "topic_key": T.topic_key(F.col("topic_key"))})
    why = F.when(F.coalesce("title", F.lit("")) == "", "empty_title").when(F.coalesce("content", F.lit("")) == "", "empty_content")
    return out.withColumns({"normalized_hash": T.body_hash(F.col("content")), "refused": why})


def topic_fold(saves: DataFrame) -> DataFrame:
    """Keyed saves folded in order: one row a (topic_key, project, scope) with the latest content, revisions and first time."""
    p = F.coalesce("project", F.lit(""))
    return saves.where("topic_key is not null").groupBy("topic_key", p.alias("project"), "scope").agg(F.max_by("id", F.struct("created_at", "id")).alias("latest_id"), F.count("*").alias("revision_count"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))


def _anchored(seconds: int):
    """Marks rows that lie within a span of the last kept row of their key; rows sorted by key and time, a key may span batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, anchor, kept_id = None, None, None
        for b in batches:
            outcome, onto = [], []
            for k, at, i in zip(b["key"], b["at"], b["id"]):
                if k != key or at - anchor > seconds:
                    key, anchor, kept_id = k, at, i
                    outcome.append("inserted"), onto.append(i)
                else:
                    outcome.append("deduplicated"), onto.append(kept_id)
            yield pd.DataFrame({"id": b["id"], "outcome": outcome, "onto": onto})

    return run


def anchored(rows: DataFrame, key: list[Column], seconds: int) -> DataFrame:
    """(id, outcome, onto): a row is a duplicate if the last kept row of its key is at most `seconds` older.

    The rule compares with what was kept, not with what came before, so neither a lag nor a session window gives it: a fold in
    order. Rows of a key stream through one task with constant memory.
    """
    at = F.unix_micros(F.col("created_at").cast("timestamp")) / 1_000_000
    sorted_ = rows.select(F.sha2(F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)]), {"ignoreNullFields": "false"}), 256).alias("key"), at.alias("at"), "id").repartition("key").sortWithinPartitions("key", "at", "id")
    return sorted_.mapInPandas(_anchored(seconds), "id long, outcome string, onto long")


def window_dedupe(saves: DataFrame, minutes: int = DEDUPE_MINUTES) -> DataFrame:
    return anchored(saves, [F.col("normalized_hash"), F.coalesce("project", F.lit("")), F.col("scope"), F.col("type"), F.col("title")], minutes * 60)


def prompt_echoes(prompts: DataFrame, seconds: int = ECHO_SECONDS) -> DataFrame:
    return anchored(prompts, [F.col("session_id"), F.col("content")], seconds)


def _keys(rows: DataFrame) -> DataFrame:
    """With `tkey`, the topic of a keyed note, and `hkey`, what two saves must share for one to be a repeat of the other."""
    where = (F.coalesce("project", F.lit("")), F.col("scope"))
    name = lambda *c: F.sha2(F.to_json(F.struct(*(x.alias(f"k{i}") for i, x in enumerate(c))), {"ignoreNullFields": "false"}), 256)
    tkey = F.when(F.col("topic_key").isNotNull(), name(F.lit("topic"), F.col("topic_key"), *where))
    return rows.withColumns({"tkey": tkey, "hkey": name(F.lit("hash"), F.col("normalized_hash"), *where, F.col("type"), F.col("title"))})


def _labels(events: DataFrame) -> DataFrame:
    """(key, label) of keys that saves tie together: a topic and the hashes saved under it, and topics that share a hash. Only
    hashes that stand under several topics, or with and without one, need it, so the rounds run over few keys."""
    ties = events.select("hkey", F.coalesce("tkey", "hkey").alias("tkey")).distinct()
    shared = ties.groupBy("hkey").agg(F.count("*").alias("n")).where("n > 1").select("hkey")
    ties = written(ties.join(shared, "hkey"), "ties")
    label = written(ties.select(F.col("hkey").alias("key")).union(ties.select("tkey")).distinct().withColumn("label", F.col("key")), "labels")
    while True:
        least = ties.join(label.select(F.col("key").alias("hkey"), F.col("label").alias("a")), "hkey").join(label.select(F.col("key").alias("tkey"), F.col("label").alias("b")), "tkey")
        low = least.select(F.explode(F.array("hkey", "tkey")).alias("key"), F.least("a", "b").alias("new")).groupBy("key").agg(F.min("new").alias("new"))
        new = written(label.join(low, "key").select("key", F.least("label", "new").alias("label"), (F.col("new") < F.col("label")).alias("moved")), "labels")
        label = new.drop("moved")
        if new.where("moved").isEmpty():
            return label


def _folded(seconds: int):
    """Outcomes of saves one after another. Rows come sorted by label, stored notes first, then by time; a label may span batches.
    What is kept of a label are its topics and the notes of the last `seconds`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label, topics, held, recent = None, {}, {}, {}
        for b in batches:
            ids, outcomes, ontos = [], [], []
            for lab, new, at, i, tkey, hkey in zip(b["label"], b["new"], b["at"], b["id"], b["tkey"], b["hkey"]):
                if lab != label:
                    label, topics, held, recent = lab, {}, {}, {}
                onto = topics.get(tkey) if new and tkey is not None else None
                outcome = "revised" if onto is not None else None
                if new and onto is None:
                    near = recent.get(hkey, {})
                    for old in [r for r, t in near.items() if at - t > seconds]:
                        del near[old]
                    if near:
                        onto, outcome = max((t, r) for r, t in near.items())[1], "deduplicated"
                if onto is None:
                    onto, outcome = i, "inserted"
                    if tkey is not None:
                        topics[tkey] = i
                    recent.setdefault(hkey, {})[i] = at
                    if tkey is not None:
                        held[i] = (hkey, at)
                elif outcome == "revised":  # the note goes on under what was saved last, as old as it was
                    was, born = held[onto]
                    if was in recent:
                        recent[was].pop(onto, None)
                        if not recent[was]:
                            del recent[was]
                    recent.setdefault(hkey, {})[onto] = born
                    held[onto] = (hkey, born)
                if new:
                    ids.append(i), outcomes.append(outcome), ontos.append(onto)
            yield pd.DataFrame({"id": ids, "outcome": outcomes, "onto": ontos}).astype({"id": "int64", "outcome": object, "onto": "int64"})

    return run


def classify(saves: DataFrame, rows: DataFrame | None = None, minutes: int = DEDUPE_MINUTES) -> DataFrame:
    """(id, outcome, onto) of a batch of saves, one after another in order of time, into stored notes.

    A save under a topic that a live note has revises that note. Any other is a repeat of the youngest live note with its hash, project,
    scope, kind and title, if that is at most `minutes` old, be they saved under a topic or not; else it is inserted. Saves that cannot
    touch each other are dealt apart by what ties them; those that can stream through one task in order."""
    saves = _keys(saves)
    at = F.unix_seconds(F.col("created_at").cast("timestamp"))
    events = saves.select("id", F.lit(True).alias("new"), at.alias("at"), at.alias("order"), "tkey", "hkey")
    if rows is not None:
        stored = _keys(rows.where("deleted_at is null"))
        wanted = saves.select(F.explode(F.array_compact(F.array("tkey", "hkey"))).alias("key")).distinct()
        near = stored.select("id", F.explode(F.array_compact(F.array("tkey", "hkey"))).alias("key")).join(wanted, "key", "left_semi").select("id").distinct()
        stored = stored.join(near, "id", "left_semi")
        events = events.unionByName(stored.select("id", F.lit(False).alias("new"), at.alias("at"), F.unix_micros(F.col("updated_at").cast("timestamp")).alias("order"), "tkey", "hkey"))
    own = F.coalesce("tkey", "hkey")
    labels = _labels(events)
    dealt = events.withColumn("key", own).join(labels, "key", "left").select(F.coalesce("label", "key").alias("label"), "new", "order", "at", "id", "tkey", "hkey")
    dealt = dealt.repartition("label").sortWithinPartitions("label", "new", "order", "at", "id")
    return dealt.mapInPandas(_folded(minutes * 60), "id long, outcome string, onto long")


def merged(rows: DataFrame, delta: DataFrame) -> DataFrame:
    """Rows with those of a write in place of their old selves."""
    return rows.join(delta.select("id"), "id", "left_anti").select(*rows.columns).unionByName(delta.select(*rows.columns))


def save(rows: DataFrame, saves: DataFrame, minutes: int = DEDUPE_MINUTES) -> tuple[DataFrame, DataFrame]:
    """(notes afterwards, what became of each save), see save_delta."""
    delta, outcomes = save_delta(rows, saves, minutes)
    return merged(rows, delta), outcomes


def save_delta(rows: DataFrame, saves: DataFrame, minutes: int = DEDUPE_MINUTES) -> tuple[DataFrame, DataFrame]:
    """(notes that were added or changed, as they are afterwards; what became of each save: id, outcome, onto; a refused one has its reason for
    outcome and no onto).

    saves: id (new and unique), session_id, type, title, content, created_at, and as they like tool_name, project, scope, topic_key."""
    for c in ("tool_name", "project", "scope", "topic_key"):
        if c not in saves.columns:
            saves = saves.withColumn(c, F.lit(None).cast("string"))
    n = written(normalised(saves), "saves")
    good = n.where("refused is null").drop("refused")
    done = written(classify(good, rows, minutes), "outcomes")
    hits = good.join(done, "id")
    order = F.struct("created_at", "id")
    fields = ("type", "title", "content", "tool_name", "topic_key", "normalized_hash")
    revised = F.col("outcome") == "revised"
    per = hits.where("outcome <> 'inserted'").groupBy(F.col("onto").alias("id")).agg(
        F.max_by(F.struct(*fields), F.when(revised, order)).alias("_last"), F.count_if(revised).alias("_revisions"), F.count_if(~revised).alias("_repeats"),
        F.min(F.when(revised, F.col("type"))).alias("_low"), F.max(F.when(revised, F.col("type"))).alias("_high"), F.max("created_at").alias("_seen"),
    )
    fresh = hits.where("outcome = 'inserted'").withColumns({
        "sync_id": T.sync_id("obs", F.col("id").cast("string"), F.col("created_at").cast("string"), F.col("normalized_hash")), "revision_count": F.lit(1).cast("long"), "duplicate_count": F.lit(1).cast("long"),
        "pinned": F.lit(False), "updated_at": F.col("created_at"), "last_seen_at": F.col("created_at"), "review_after": T.review_after(F.col("type"), F.col("created_at")),
    })
    touched = rows.join(per.select("id"), "id", "left_semi")
    every = touched.unionByName(fresh.select(*(c for c in rows.columns if c in fresh.columns)), allowMissingColumns=True)
    j = every.join(per, "id", "left")
    same = (F.col("_low") == F.col("type")) & (F.col("_high") == F.col("type"))
    new = {c: F.when(F.col("_revisions") > 0, F.col("_last")[c]).otherwise(F.col(c)) for c in fields}
    review = F.when(F.col("_revisions") > 0, F.when(same & F.col("review_after").isNotNull() & T.review_after(F.col("type"), F.col("created_at")).isNotNull(), F.col("review_after")).otherwise(T.review_after(F.col("_last")["type"], F.col("created_at")))).otherwise(F.col("review_after"))
    count = lambda c, more: F.col(c) + F.coalesce(more, F.lit(0))
    new |= {"review_after": review, "revision_count": count("revision_count", "_revisions"), "duplicate_count": count("duplicate_count", "_repeats"), "updated_at": F.coalesce("_seen", "updated_at")}
    if "last_seen_at" in rows.columns:
        new["last_seen_at"] = F.coalesce("_seen", "last_seen_at")
    after = written(j.withColumns({c: x for c, x in new.items() if c in rows.columns}).select(*rows.columns), "delta")
    refused = n.where("refused is not null").select("id", F.col("refused").alias("outcome"), F.lit(None).cast("long").alias("onto"))
    return after, done.unionByName(refused)


def save_prompts(prompts: DataFrame, new: DataFrame, seconds: int = ECHO_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(prompts afterwards, outcomes): a prompt that says within some seconds what its session said last is an echo of it."""
    known = prompts.join(new.select("session_id", "content").distinct(), ["session_id", "content"], "left_semi")
    cols = ["id", "session_id", "content", "created_at"]
    told = written(prompt_echoes(known.select(*cols).unionByName(new.select(*cols)), seconds).join(new.select("id"), "id", "left_semi"), "echoes")
    kept = new.join(told.where("outcome = 'inserted'").select("id"), "id", "left_semi")
    return prompts.unionByName(kept.select(*(c for c in prompts.columns if c in kept.columns)), allowMissingColumns=True), told


def passive_dedupe(items: DataFrame, rows: DataFrame) -> DataFrame:
    """Items whose body no live note of the project has, each once."""
    h = items.withColumn("normalized_hash", T.body_hash(F.col("content")))
    known = rows.where("deleted_at is null").select(F.coalesce("project", F.lit("")).alias("project"), "normalized_hash").distinct()
    new = h.withColumn("project", F.coalesce("project", F.lit(""))).join(known, ["project", "normalized_hash"], "left_anti")
    return new.groupBy("project", "normalized_hash").agg(F.min("id").alias("id"))


def review_clock(kind: Column, old_kind: Column, review: Column, created: Column) -> Column:
    """No window: none; unchanged kind with a date: kept; else counted from creation."""
    fresh = T.review_after(kind, created)
    return F.when(fresh.isNull(), F.lit(None).cast("timestamp")).when((kind == old_kind) & review.isNotNull(), review).otherwise(fresh)


def update(rows: DataFrame, patches: DataFrame, as_of: Column) -> DataFrame:
    """Rows after patches (id and any columns, null keeps). Fields are stored as a save stores them: private parts redacted, bodies bounded,
    names in their spelling."""
    stored = {
        "title": lambda c: F.nullif(T.title(c, BODY_BYTES), F.lit("")), "content": lambda c: F.nullif(T.truncate_bytes_marked(T.strip_private(c), BODY_BYTES), F.lit("")), "type": T.kind,
        "project": T.project, "scope": T.scope, "topic_key": T.topic_key,
    }
    cols = [c for c in patches.columns if c != "id"]
    spelled = [F.when(F.col(c).isNotNull(), stored[c](F.col(c))).alias(f"_new_{c}") if c in stored else F.col(c).alias(f"_new_{c}") for c in cols]
    j = rows.join(patches.select("id", *spelled, F.lit(True).alias("_hit")), "id", "left")
    new = {c: F.coalesce(f"_new_{c}", c) for c in cols if c in rows.columns}
    if "type" in new:
        new["review_after"] = F.when(F.col("_hit"), review_clock(new["type"], F.col("type"), F.col("review_after"), F.col("created_at"))).otherwise(F.col("review_after"))
    if "content" in new:
        new["normalized_hash"] = T.body_hash(new["content"])
    new["revision_count"] = F.col("revision_count") + F.when(F.col("_hit"), 1).otherwise(0)
    new["updated_at"] = F.when(F.col("_hit"), as_of).otherwise(F.col("updated_at"))
    return j.withColumns(new).select(*rows.columns)


def set_pinned(rows: DataFrame, ids: DataFrame, value: bool = True) -> DataFrame:
    hit = ids.select("id", F.lit(True).alias("_hit"))
    return rows.join(hit, "id", "left").withColumn("pinned", F.when(F.col("_hit"), F.lit(value)).otherwise(F.col("pinned"))).select(*rows.columns)


def mark_reviewed(rows: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    hit = ids.select("id", F.lit(True).alias("_hit"))
    return rows.join(hit, "id", "left").withColumn("review_after", F.when(F.col("_hit"), T.review_after(F.col("type"), as_of)).otherwise(F.col("review_after"))).select(*rows.columns)


def delete(rows: DataFrame, ids: DataFrame, as_of: Column, hard: bool = False) -> DataFrame:
    if hard:
        return rows.join(ids.select("id"), "id", "left_anti")
    hit = ids.select("id", F.lit(True).alias("_hit"))
    fresh = F.col("_hit") & F.col("deleted_at").isNull()
    return rows.join(hit, "id", "left").withColumns({"updated_at": F.when(fresh, as_of).otherwise(F.col("updated_at")), "deleted_at": F.when(fresh, as_of).otherwise(F.col("deleted_at"))}).select(*rows.columns)


def create_sessions(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or ignore."""
    return sessions.unionByName(new.join(sessions.select("id"), "id", "left_anti").dropDuplicates(["id"]), allowMissingColumns=True)


def end_session(sessions: DataFrame, ended: DataFrame) -> DataFrame:
    """ended: id, ended_at, summary (null keeps)."""
    e = ended.select("id", F.col("ended_at").alias("_e"), F.col("summary").alias("_s"))
    return sessions.join(e, "id", "left").withColumns({"ended_at": F.coalesce("_e", "ended_at"), "summary": F.coalesce("_s", "summary")}).select(*sessions.columns)


def deletable_sessions(sessions: DataFrame, rows: DataFrame, prompts: DataFrame) -> DataFrame:
    """Sessions that hold neither notes nor prompts."""
    return sessions.join(rows.select(F.col("session_id").alias("id")), "id", "left_anti").join(prompts.select(F.col("session_id").alias("id")), "id", "left_anti")


def cascade_session(gone: DataFrame, sessions: DataFrame, rows: DataFrame, prompts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = gone.select(F.col("id").alias("session_id"))
    return sessions.join(gone.select("id"), "id", "left_anti"), rows.join(s, "session_id", "left_anti"), prompts.join(s, "session_id", "left_anti")


def delete_prompts(prompts: DataFrame, tombstones: DataFrame, gone: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(prompts, tombstones) after removals by sync_id; a tombstone is written even if the prompt was never held."""
    ids = gone.select("sync_id").distinct()
    held = prompts.select("sync_id", "session_id", "project")
    new = ids.join(held, "sync_id", "left").withColumn("deleted_at", as_of)
    every = tombstones.unionByName(new)
    return prompts.join(ids, "sync_id", "left_anti"), every.groupBy("sync_id").agg(F.max_by("session_id", "deleted_at").alias("session_id"), F.max_by("project", "deleted_at").alias("project"), F.max("deleted_at").alias("deleted_at"))
