"""A peer's changes in batch against the same changes one at a time."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from notelake.operators import peers
from notelake.sources import schemas
from notelake.store import TABLES, NoteStore

NOW = datetime(2024, 5, 1, 10)


def as_of():
    return F.to_timestamp(F.lit("2024-05-01 10:00:00"))

JOURNAL = "seq long, entity string, entity_key string, op string, payload string"


def stamp(minutes):
    return (datetime(2024, 1, 1) + timedelta(minutes=minutes)).strftime("%Y-%m-%d %H:%M:%S")


def journal(spark, rows):
    return spark.createDataFrame([(i, e, k, op, json.dumps(p)) for i, (e, k, op, p) in enumerate(rows)], JOURNAL)


def note(**over):
    base = {"session_id": "s", "type": "bugfix", "title": "t", "content": "c", "scope": "project"}
    return base | over


def one_at_a_time(changes, stored):
    rows, hard = {k: dict(v) for k, v in stored.items()}, set()
    for e, key, op, p in changes:
        if op == "delete" or p.get("deleted_at"):
            if key in rows and p.get("hard_delete"):
                del rows[key]
                hard.add(key)
            elif key in rows:
                rows[key] |= {"deleted_at": p.get("deleted_at") or str(NOW), "updated_at": p.get("deleted_at") or str(NOW)}
            continue
        old = rows.get(key, {})
        created = p.get("created_at") or old.get("created_at") or str(NOW)
        rows[key] = {
            "title": p["title"], "type": p["type"], "revision_count": p.get("revision_count") or old.get("revision_count", 1), "created_at": created,
            "updated_at": p.get("updated_at") or old.get("updated_at") or created, "deleted_at": None, "prompt_sync_id": p.get("prompt_sync_id") or old.get("prompt_sync_id"),
        }
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_notes_end_as_one_at_a_time(spark, seed):
    rng = random.Random(seed)
    stored = {f"n{k}": {"title": f"old{k}", "type": "bugfix", "revision_count": k + 2, "created_at": stamp(k), "updated_at": stamp(k + 1), "deleted_at": None, "prompt_sync_id": None} for k in range(6)}
    changes = []
    for i in range(120):
        key = f"n{rng.randrange(12)}"
        if rng.random() < 0.3:
            p = {"hard_delete": True} if rng.random() < 0.4 else {"deleted_at": rng.choice(["", stamp(500 + i)])}
            changes.append(("observation", key, "delete", p))
        else:
            p = note(title=f"t{i}", type=rng.choice(["bugfix", "decision"]), revision_count=rng.choice([0, i + 5]), created_at=rng.choice(["", stamp(300 + i)]), updated_at=rng.choice(["", stamp(400 + i)]))
            changes.append(("observation", key, "upsert", p | ({"prompt_sync_id": f"q{i}"} if rng.random() < 0.3 else {})))
    held = [(i, k, "s", v["type"], v["title"], "c", "project", v["revision_count"], 1, False, v["created_at"], v["updated_at"]) for i, (k, v) in enumerate(stored.items())]
    rows = spark.createDataFrame(held, "id long, sync_id string, session_id string, type string, title string, content string, scope string, revision_count long, duplicate_count long, pinned boolean, created_at string, updated_at string")
    rows = rows.withColumns({"created_at": F.to_timestamp("created_at"), "updated_at": F.to_timestamp("updated_at")})
    rows = spark.createDataFrame([], schemas.OBSERVATIONS).unionByName(rows, allowMissingColumns=True)
    after, _, _ = peers.observations(rows, journal(spark, changes), as_of())
    text = lambda x: None if x is None else str(x)
    got = {r["sync_id"]: {c: text(r[c]) for c in ("title", "type", "revision_count", "created_at", "updated_at", "deleted_at", "prompt_sync_id")} for r in after.collect()}
    assert got == {k: {c: text(x) for c, x in v.items()} for k, v in one_at_a_time(changes, stored).items()}
    assert after.select("id").distinct().count() == len(got)


def test_a_page_of_all_entities(spark):
    store = NoteStore(**{t: spark.createDataFrame([], getattr(schemas, t.upper())) for t in TABLES}, as_of=as_of())
    page = [
        ("session", "s", "upsert", {"id": "s", "project": "C:\\x\\Alpha", "directory": "/w", "started_at": stamp(0)}),
        ("observation", "a", "upsert", note(title="A <private>x</private>", project="Alpha", topic_key="K/A", created_at=stamp(1))),
        ("observation", "b", "upsert", note(title="B", created_at=stamp(2), type="decision")),
        ("observation", "x", "upsert", note(session_id=" ")),
        ("relation", "r1", "upsert", {"source_id": "a", "target_id": "b", "relation": "related", "confidence": 0.5, "judgment_status": "judged"}),
        ("relation", "r2", "upsert", {"source_id": "a", "target_id": "zz", "relation": "related", "confidence": 9, "judgment_status": "judged"}),
        ("prompt", "p1", "upsert", {"session_id": "s", "content": "go", "project": "Alpha", "created_at": stamp(3)}),
        ("prompt", "p2", "delete", {"session_id": "s", "deleted_at": stamp(50)}),
        ("prompt", "p2", "upsert", {"session_id": "s", "content": "late", "created_at": stamp(40)}),
        ("prompt", "p3", "delete", {"session_id": "s", "deleted_at": stamp(50)}),
        ("prompt", "p3", "upsert", {"session_id": "s", "content": "young", "created_at": stamp(60)}),
        ("observation", "gone", "delete", {"hard_delete": True}),
    ]
    store, waiting, refused = store.apply(journal(spark, page))
    a, b = store.observations.orderBy("sync_id").collect()
    assert (a["title"], a["project"], a["topic_key"], a["review_after"]) == ("A [REDACTED]", "alpha", "k/a", None) and str(b["review_after"]) == "2024-07-01 00:02:00"
    assert [(r["id"], r["project"], str(r["started_at"])) for r in store.sessions.collect()] == [("s", "alpha", stamp(0))]
    assert sorted((r["sync_id"], r["content"]) for r in store.prompts.collect()) == [("p1", "go"), ("p3", "young")] and [r["sync_id"] for r in store.prompt_deletions.collect()] == ["p2"]
    assert [r["sync_id"] for r in store.relations.collect()] == ["r1"] and [r["sync_id"] for r in waiting.collect()] == ["r2"]
    assert [(r["seq"], r["problem"]) for r in refused.collect()] == [(3, "observation_fields")]
    more = [("observation", "b", "delete", {"hard_delete": True}), ("session", "s", "delete", {}), ("prompt", "p9", "upsert", {"session_id": "s", "content": "after", "created_at": stamp(70)})]
    store, _, _ = store.apply(journal(spark, more))
    assert [r["sync_id"] for r in store.observations.collect()] == ["a"] and store.sessions.count() == 0
    assert [r["judgment_status"] for r in store.relations.collect()] == ["orphaned"] and [r["sync_id"] for r in store.prompts.collect()] == ["p9"]
