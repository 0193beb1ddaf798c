"""The journal as keyed state against its replay in batch, and relations that wait against the same rule a change at a time."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from notelake.streaming import keyed as K
from notelake.streaming import replication as R

JOURNAL = "seq long, entity string, entity_key string, op string, payload string, occurred_at timestamp"
START = datetime(2024, 1, 1)


def written(spark, at, pages):
    for p in pages:
        spark.createDataFrame(p, JOURNAL).coalesce(1).write.mode("append").parquet(at)


def changes(n, seed=5):
    rng = random.Random(seed)
    return [(i, rng.choice(["session", "observation", "prompt", "relation"]), f"k{rng.randrange(9)}", rng.choice(["upsert", "upsert", "delete"]), rng.choice([json.dumps({"v": i}), None, '{"deleted": true}']), START + timedelta(minutes=i)) for i in range(n)]


def told(df):
    return sorted((r["entity"], r["entity_key"], r["seq"], r["deleted"], r["payload"] or "") for r in df.collect())


def test_stream_ends_as_the_batch_does(spark, tmp_path):
    rows = changes(90)
    at = str(tmp_path / "in")
    # pages that overlap and come out of order
    written(spark, at, [rows[40:70], rows[:50], rows[60:], rows[10:20]])
    seen = []
    q = K.follow(spark, at, JOURNAL, str(tmp_path / "state"), lambda df, n: seen.append((n, df.count())), max_files=1, partitions=2)
    q.awaitTermination()
    assert told(K.ends(spark, str(tmp_path / "state"))) == told(R.replay(spark.createDataFrame(rows, JOURNAL)).select("entity", "entity_key", "seq", "deleted", "payload"))
    # a page of nothing new changes no key
    assert [n for b, n in seen if b == 3] in ([], [0])


def test_a_batch_that_fails_is_run_again(spark, tmp_path):
    rows = changes(60, seed=9)
    at, home = str(tmp_path / "in"), str(tmp_path / "state")
    written(spark, at, [rows[:20], rows[20:40], rows[40:]])

    def broken(df, number):
        if number == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception):
        K.follow(spark, at, JOURNAL, home, broken, max_files=1, partitions=2).awaitTermination()
    K.follow(spark, at, JOURNAL, home, None, max_files=1, partitions=2).awaitTermination()
    want = R.replay(spark.createDataFrame(rows, JOURNAL)).select("entity", "entity_key", "seq", "deleted", "payload")
    assert told(K.ends(spark, home)) == told(want)
    # the changes left behind end the same way
    left = spark.read.parquet(f"{home}/changes").groupBy("entity", "entity_key").agg(F.max(F.struct("seq", "deleted", "payload")).alias("l")).select("entity", "entity_key", "l.*")
    assert told(left) == told(want)


def test_a_batch_writes_its_own_keys_only(spark, tmp_path):
    at, home = str(tmp_path / "in"), str(tmp_path / "state")
    first = [(i, "prompt", f"p{i}", "upsert", "{}", START) for i in range(50)]
    written(spark, at, [first, [(99, "prompt", "p3", "delete", "{}", START)]])
    K.follow(spark, at, JOURNAL, home, max_files=1, partitions=2).awaitTermination()
    n = {r["batch"]: r["n"] for r in spark.read.parquet(f"{home}/changes").groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert n == {0: 50, 1: 1} and K.ends(spark, home).count() == 50


def one_at_a_time(rows, watermark):
    """What becomes of each relation: when each end is there, by walking the journal for each."""
    out = {}
    notes = [r for r in rows if r[1] == "observation" and (r[3] == "upsert" or json.loads(r[4]).get("hard_delete"))]
    for seq, entity, _, _, body, at in rows:
        if entity != "relation":
            continue
        until, ready = at + timedelta(hours=K.RETRY_HOURS * R.RETRIES), []
        for end in ("source_id", "target_id"):
            key = json.loads(body).get(end)
            there = [r[3] == "upsert" for r in notes if r[2] == key and r[0] < seq]
            later = [r[5] for r in notes if r[2] == key and r[0] > seq and r[3] == "upsert" and r[5] <= until]
            ready.append(at if there and there[-1] else min(later, default=None))
        if None not in ready:
            out[seq] = ("applied", int((max(ready) - at).total_seconds() // 3600))
        else:
            out[seq] = ("dead", R.RETRIES) if until <= watermark else ("deferred", 0)
    return out


def test_relations_wait_for_both_ends(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(160):
        at = START + timedelta(minutes=17 * i)
        if rng.random() < 0.5:
            # a third of the relations name one note; some name none
            ends = {"source_id": rng.choice(["hub", f"n{rng.randrange(40)}", None]), "target_id": f"n{rng.randrange(40)}"}
            rows.append((i, "relation", f"r{i}", "upsert", json.dumps(ends), at))
        else:
            key = rng.choice(["hub", *(f"n{k}" for k in range(40))])
            op = rng.choice(["upsert", "upsert", "upsert", "delete"])
            rows.append((i, "observation", key, op, json.dumps({"hard_delete": rng.random() < 0.7} if op == "delete" else {}), at))
    at, home = str(tmp_path / "in"), str(tmp_path / "state")
    written(spark, at, [rows[:50], rows[50:51], rows[51:120], rows[120:]])
    K.settle(spark, at, JOURNAL, home, delay="30 minutes", max_files=1, partitions=2).awaitTermination()
    got = {r["change"]: (r["apply_status"], r["retry_count"]) for r in K.outcomes(spark, home).collect()}
    got |= {r["change"]: ("deferred", 0) for r in K.waiting(spark, home).collect()}
    want = one_at_a_time(rows, rows[-1][5] - timedelta(minutes=30))
    assert got == want
    assert {s for s, _ in want.values()} == {"applied", "dead", "deferred"}


def test_keys_end_without_python(spark, tmp_path):
    at, home = str(tmp_path / "in"), str(tmp_path / "state")
    # of changes with equal seq, the first seen stays and the other is not told
    written(spark, at, [[(1, "prompt", "a", "upsert", "one", START)], [(1, "prompt", "a", "upsert", "two", START), (0, "prompt", "b", "upsert", None, START)]])
    q = K.follow(spark, at, JOURNAL, home, max_files=1, partitions=2)
    q.awaitTermination()
    assert [o["operatorName"] for o in q.lastProgress["stateOperators"]] == ["stateStoreSave"]
    assert told(K.ends(spark, home)) == [("prompt", "a", 1, False, "one"), ("prompt", "b", 0, False, "")]
    assert {(r["batch"], r["entity_key"]) for r in spark.read.parquet(f"{home}/changes").collect()} == {(0, "a"), (1, "b")}


def test_relations_settle_without_python_across_merged_notes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "MERGED", 2)
    note = lambda i, key, minutes, op="upsert": (i, "observation", key, op, '{"hard_delete": true}' if op == "delete" else "{}", START + timedelta(minutes=minutes))
    rel = lambda i, a, b, minutes: (i, "relation", f"r{i}", "upsert", json.dumps({"source_id": a, "target_id": b}), START + timedelta(minutes=minutes))
    pages = [[note(0, "a", 0)], [note(1, "b", 10)], [note(2, "b", 20, "delete")], [rel(3, "a", "b", 30)], [note(4, "b", 150)], [rel(5, "b", "a", 160), rel(6, "a", "gone", 161)]]
    at, home = str(tmp_path / "in"), str(tmp_path / "state")
    written(spark, at, pages)
    q = K.settle(spark, at, JOURNAL, home, delay="30 minutes", max_files=1, partitions=2)
    q.awaitTermination()
    assert q.lastProgress["stateOperators"] == []
    assert {(r["change"], r["apply_status"], r["retry_count"]) for r in K.outcomes(spark, home).collect()} == {(3, "applied", 2), (5, "applied", 0)}
    assert [r["change"] for r in K.waiting(spark, home).collect()] == [6]
