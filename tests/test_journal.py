"""Changes captured from writes: what is told to whom, and that a copy that applies it is the same store."""

import json

import pytest
from pyspark.sql import functions as F

from notelake.operators import journal, segments
from notelake.sources import schemas
from notelake.store import TABLES, NoteStore


def clock(text):
    return F.to_timestamp(F.lit(text))


def empty(spark, name):
    return spark.createDataFrame([], getattr(schemas, name))


def store(spark, enrolled=("alpha",), at="2024-05-01 10:00:00", indexed=None):
    tables = {t: empty(spark, t.upper()) for t in TABLES}
    held = tuple(segments.SegmentIndex.create(tables["observations"], f"{indexed}/{n}", stemmed=n == "s") for n in ("e", "s")) if indexed else None
    return NoteStore(**tables, as_of=clock(at), held=held, mutations=empty(spark, "MUTATIONS"), enrolled=spark.createDataFrame([(p,) for p in enrolled], "project string"), sync_state=empty(spark, "SYNC_STATE"))


def ids(spark, *which):
    return spark.createDataFrame([(i,) for i in which], "id long")


def told(s, entity="observation"):
    return [(r["op"], r["project"]) for r in s.mutations.where(F.col("entity") == entity).orderBy("seq").collect()]


def patch(spark, i, **fields):
    return spark.createDataFrame([(i, *fields.values())], "id long, " + ", ".join(f"{c} string" for c in fields))


def test_a_note_that_leaves_a_replicated_project_is_removed_at_the_peer(spark):
    s, _ = store(spark).save_note("s1", "decision", "A note that will move", "Some body.", "alpha")
    assert told(s) == [("upsert", "alpha")]
    s = s.update(patch(spark, 1, project="beta"))
    assert told(s)[1:] == [("delete", "alpha")]  # nobody replicates beta
    gone = json.loads(s.mutations.orderBy(F.desc("seq")).first()["payload"])
    assert (gone["deleted"], gone["hard_delete"], gone["project"], gone["deleted_at"]) == (True, False, "alpha", "2024-05-01 10:00:00")
    peer, _, odd = store(spark).apply(s.mutations.where("seq = 1"))
    assert peer.observations.where("deleted_at is null").count() == 1
    peer, _, odd = peer.apply(s.mutations.where("seq = 2"))
    assert peer.observations.where("deleted_at is null").count() == 0 and odd.count() == 0
    # outside nothing is told, and between two replicated projects the row itself is
    s = s.update(patch(spark, 1, title="Edited outside"))
    assert len(told(s)) == 2
    s = NoteStore(**{**s.__dict__, "enrolled": spark.createDataFrame([("alpha",), ("beta",)], "project string")}).update(patch(spark, 1, project="alpha"))
    assert told(s)[2:] == [("upsert", "alpha")]
    states = {r["target_key"]: (r["lifecycle"], r["last_enqueued_seq"]) for r in s.sync_state.collect()}
    assert states == {"cloud": ("pending", 3), "cloud:alpha": ("pending", 3)}


def test_what_stays_at_home(spark):
    s, _ = store(spark).save_note("s1", "decision", "Pinned", "Body", "alpha")
    s = s.pin(ids(spark, 1)).review(ids(spark, 1))
    assert told(s) == [("upsert", "alpha")]
    s, _ = s.save_note("s1", "decision", "Elsewhere", "Body two", "beta")
    assert told(s) == [("upsert", "alpha")]


def test_an_entry_belongs_to_the_project_of_its_session(spark):
    s = store(spark).session_start(spark.createDataFrame([("s1", "Alpha", "/a"), ("s2", "beta", "/b")], "id string, project string, directory string").withColumn("started_at", clock("2024-05-01 09:00:00")))
    assert told(s, "session") == [("upsert", "alpha")]
    s, _ = s.save_note("s1", "bugfix", "No project", "Body")
    s, _ = s.save_note("s2", "bugfix", "No project either", "Other")
    s, _ = s.save_note("nowhere", "bugfix", "Nameless", "Third")
    assert told(s) == [("upsert", "alpha"), ("upsert", "")]


def rows(df, *but):
    cols = [c for c in df.columns if c not in ("id", "pinned", "review_after", *but)]
    return sorted(repr(tuple(r)) for r in df.select(*cols).collect())


def test_a_copy_that_applies_the_journal_is_the_same_store(spark):
    s = store(spark, ("alpha", "beta"))
    s = s.session_start(spark.createDataFrame([("s1", "alpha", "/a"), ("s2", "beta", "/b")], "id string, project string, directory string").withColumn("started_at", clock("2024-05-01 09:00:00")))
    saves = [(i, "s1" if i % 2 else "s2", "decision" if i % 3 else "bugfix", f"Title {i}", f"Body {i % 7} <private>key</private>", "alpha" if i % 2 else "beta", f"topic/{i}" if i % 4 == 0 else None) for i in range(1, 13)]
    new = spark.createDataFrame(saves, "id long, session_id string, type string, title string, content string, project string, topic_key string").withColumn("created_at", clock("2024-05-01 09:30:00"))
    s, _ = s.save_notes(new)
    s, _ = s.save_prompts(spark.createDataFrame([(i, f"p{i}", "s1", f"ask {i}", "alpha") for i in (1, 2, 3)], "id long, sync_id string, session_id string, content string, project string").withColumn("created_at", clock("2024-05-01 09:10:00")))
    s = s.update(patch(spark, 3, title="Renamed", topic_key="K/New")).update(patch(spark, 4, project="alpha"))
    s = s.delete(ids(spark, 5)).delete(ids(spark, 6), hard=True)
    s = s.delete_prompts(spark.createDataFrame([("p2",)], "sync_id string"))
    s = s.session_end(spark.createDataFrame([("s1", "it went well")], "id string, summary string").withColumn("ended_at", clock("2024-05-01 09:50:00")))
    s = s.merge_projects(spark.createDataFrame([("beta", "gamma")], "project string, canonical string"))
    sync = {r["id"]: r["sync_id"] for r in s.observations.collect()}
    pending = [(9, "r9", sync[1], sync[3], "related", "pending")]
    s = NoteStore(**{**s.__dict__, "relations": empty(spark, "RELATIONS").unionByName(spark.createDataFrame(pending, "id long, sync_id string, source_id string, target_id string, relation string, judgment_status string").withColumns({"created_at": clock("2024-05-01 09:40:00"), "updated_at": clock("2024-05-01 09:40:00")}), allowMissingColumns=True)})
    s = s.judge(spark.createDataFrame([("r9", "supersedes", 0.9, "newer")], "sync_id string, relation string, confidence double, reason string"))
    peer, waiting, odd = store(spark).apply(s.mutations)
    assert waiting.count() == 0 and odd.count() == 0
    assert rows(peer.observations) == rows(s.observations) and s.observations.count() == 11
    assert rows(peer.sessions) == rows(s.sessions) and rows(peer.prompts) == rows(s.prompts)
    assert rows(peer.relations, "created_at", "updated_at") == rows(s.relations, "created_at", "updated_at")
    assert sorted({r["project"] for r in s.enrolled.collect()}) == ["alpha", "gamma"]
    seqs = [r["seq"] for r in s.mutations.orderBy("seq").collect()]
    assert seqs == list(range(1, len(seqs) + 1))


def test_the_index_follows_writes_and_is_saved(spark, tmp_path):
    saves = [(i, "s1", "decision", f"Title {i}", f"Body {i}", "alpha") for i in range(1, 7)]
    new = spark.createDataFrame(saves, "id long, session_id string, type string, title string, content string, project string").withColumn("created_at", clock("2024-05-01 09:30:00"))
    s, _ = store(spark, indexed=f"{tmp_path}").save_notes(new)
    s = s.update(patch(spark, 3, title="Renamed")).pin(ids(spark, 1)).delete(ids(spark, 6), hard=True)
    exact = s.indexes()[0]
    assert exact.live[0] == 5 and exact.segments[-1].seg == 3  # empty, saved, updated, removed; a pin writes none
    assert {r["id"] for r in s.search("renamed").collect()} == {3}
    s.save(f"{tmp_path}/kept")
    back = NoteStore.open(spark, f"{tmp_path}/kept", clock("2024-05-01 10:00:00"))
    assert back.mutations.count() == 8 and len(back.indexes()[0].segments) == 1
    assert {r["id"] for r in back.search("title", project="alpha").collect()} == {1, 2, 4, 5}


def test_a_moved_note_gives_up_pending_relations(spark):
    s, _ = store(spark).save_note("s", "decision", "One", "Body one", "alpha")
    s, _ = s.save_note("s", "decision", "Two", "Body two", "alpha")
    a, b = (r["sync_id"] for r in s.observations.orderBy("id").collect())
    edges = spark.createDataFrame([(1, "r1", a, b, "related", "pending"), (2, "r2", a, b, "related", "judged")], "id long, sync_id string, source_id string, target_id string, relation string, judgment_status string")
    s = NoteStore(**{**s.__dict__, "relations": empty(spark, "RELATIONS").unionByName(edges.withColumns({"created_at": s.as_of, "updated_at": s.as_of}), allowMissingColumns=True)})
    s = s.update(patch(spark, 1, project="beta"))
    assert {r["sync_id"]: r["judgment_status"] for r in s.relations.collect()} == {"r1": "orphaned", "r2": "judged"}


@pytest.mark.parametrize("parts", [1, 7])
def test_entries_are_numbered_in_order_without_one_task(spark, parts):
    found = spark.range(50).select(F.lit(1).alias("rank"), F.lit("observation").alias("entity"), F.format_string("k%03d", 49 - F.col("id")).alias("entity_key"), F.lit(0).alias("step")).repartition(parts)
    got = journal.numbered(found, 10).orderBy("seq").collect()
    assert [r["seq"] for r in got] == list(range(11, 61)) and [r["entity_key"] for r in got] == sorted(r["entity_key"] for r in got)


def test_only_keys_are_compared_before_bodies_are_read(spark):
    old = spark.createDataFrame([("a", "x", None), ("b", None, "x"), ("c", "y", "z")], "sync_id string, title string, content string")
    new = spark.createDataFrame([("a", None, "x"), ("b", None, "x"), ("d", "y", "z")], "sync_id string, title string, content string")
    got = {r["key"]: (r["b"] is not None, r["a"] is not None) for r in journal.differences(old, new, "sync_id", ("title", "content")).collect()}
    assert got == {"a": (True, True), "c": (True, False), "d": (False, True)}


def test_a_batch_that_edits_and_deletes_tells_both(spark):
    cols = "sync_id string, title string, project string, session_id string, deleted_at timestamp"
    old = spark.createDataFrame([("a", "x", "alpha", "s", None), ("b", "x", "alpha", "s", None), ("c", "x", "alpha", "s", None)], cols)
    new = spark.createDataFrame([("a", "y", "alpha", "s", None), ("b", "y", "alpha", "s", None), ("c", "x", "beta", "s", None)], cols)
    new = new.withColumn("deleted_at", F.when(F.col("sync_id") != "a", clock("2024-05-01 10:00:00")))
    got = journal.entries("observation", old, new, empty(spark, "SESSIONS"), spark.createDataFrame([("alpha",)], "project string"), clock("2024-05-01 11:00:00")).orderBy("entity_key", "step").collect()
    assert [(r["entity_key"], r["op"], r["project"]) for r in got] == [("a", "upsert", "alpha"), ("b", "upsert", "alpha"), ("b", "delete", "alpha"), ("c", "delete", "alpha")]
