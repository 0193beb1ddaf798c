import random

import pytest
from pyspark.sql import functions as F

from notelake.operators import projects, quality, relations, writes
from notelake.sources import exchange
from notelake.streaming import replication as R


def at(minutes):
    z = F.lit(0)
    return F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_interval(z, z, z, z, z, z, (minutes * 60).cast("decimal(18,6)"))


def saves(spark, rows):
    return spark.createDataFrame(rows, "id long, minute double, normalized_hash string, project string, scope string, type string, title string, topic_key string").withColumn("created_at", at(F.col("minute")))


def test_window_compares_with_the_kept_row(spark):
    rows = [(i, float(m), "h", "p", "project", "bugfix", "t", None) for i, m in enumerate((0, 10, 20, 30, 15.0))]
    got = {r["id"]: (r["outcome"], r["onto"]) for r in writes.window_dedupe(saves(spark, rows)).collect()}
    assert got == {0: ("inserted", 0), 1: ("deduplicated", 0), 4: ("deduplicated", 0), 2: ("inserted", 2), 3: ("deduplicated", 2)}


def sequential(rows, stored=(), minutes=15):
    """The rule one save at a time: the topic's note, else a repeat of the youngest live note with the same hash, else a new note."""
    notes, out = {}, {}
    for i, m, h, p, s, k, t, key in sorted(stored, key=lambda r: (r[1], r[0])):
        notes[i] = {"born": m, "touched": m, "topic": (key, p or "", s) if key else None, "as": (h, p or "", s, k, t)}
    for i, m, h, p, s, k, t, key in sorted(rows, key=lambda r: (r[1], r[0])):
        topic, like = (key, p or "", s) if key else None, (h, p or "", s, k, t)
        under = [(n["touched"], n["born"], x) for x, n in notes.items() if topic and n["topic"] == topic]
        near = [(n["born"], x) for x, n in notes.items() if n["as"] == like and m - n["born"] <= minutes]
        if under:
            x = max(under)[2]
            notes[x] |= {"as": like, "touched": m}
            out[i] = ("revised", x)
        elif near:
            out[i] = ("deduplicated", max(near)[1])
        else:
            notes[i] = {"born": m, "touched": m, "topic": topic, "as": like}
            out[i] = ("inserted", i)
    return out


def random_saves(rng, ids, span=120):
    return [(i, float(rng.randint(0, span)), rng.choice("abc"), rng.choice(["p", "q", None]), "project", rng.choice(["bugfix", "decision"]), rng.choice("tu"), rng.choice([None, None, "k/1", "k/2"])) for i in ids]


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_batch_fold_equals_one_at_a_time(spark, seed):
    rows = random_saves(random.Random(seed), range(400))
    got = {r["id"]: (r["outcome"], r["onto"]) for r in writes.classify(saves(spark, rows)).collect()}
    assert got == sequential(rows)


@pytest.mark.parametrize("seed", [5, 6])
def test_batch_into_stored_notes_equals_one_at_a_time(spark, seed):
    rng = random.Random(seed)
    stored, rows = random_saves(rng, range(25), 10), [(i, m + 11, *x) for i, m, *x in random_saves(rng, range(1000, 1200), 40)]
    held = saves(spark, stored).withColumns({"updated_at": F.col("created_at"), "deleted_at": F.lit(None).cast("timestamp")})
    got = {r["id"]: (r["outcome"], r["onto"]) for r in writes.classify(saves(spark, rows), held).collect()}
    assert got == sequential(rows, stored)


def test_a_keyed_save_may_repeat_an_unkeyed_one(spark):
    rows = [(1, 0.0, "h", "p", "project", "bugfix", "t", None), (2, 5.0, "h", "p", "project", "bugfix", "t", "k/1"), (3, 6.0, "g", "p", "project", "bugfix", "t", "k/1"), (4, 7.0, "h", "p", "project", "bugfix", "t", "k/1"), (5, 30.0, "h", "p", "project", "bugfix", "t", None)]
    got = {r["id"]: (r["outcome"], r["onto"]) for r in writes.classify(saves(spark, rows)).collect()}
    assert got == {1: ("inserted", 1), 2: ("deduplicated", 1), 3: ("inserted", 3), 4: ("revised", 3), 5: ("inserted", 5)}


def test_the_store_saves(spark, tmp_path):
    from notelake.sources import schemas
    from notelake.store import TABLES, NoteStore

    empty = {t: spark.createDataFrame([], getattr(schemas, t.upper())) for t in TABLES}
    now = F.to_timestamp(F.lit("2024-05-01 10:00:00"))
    store, out = NoteStore(**empty, as_of=now).save_note("s1", "Decision", " Keep <private>x</private> it ", "a body of words", "C:\\Repo\\Alpha", topic_key="Rules/Keep")
    assert [tuple(r) for r in out.collect()] == [(1, "inserted", 1)]
    store, out = store.save_note("s1", "oddity", "Keep it", "another body", "alpha", topic_key="rules/keep")
    assert [tuple(r) for r in out.collect()] == [(2, "revised", 1)]
    row = store.observations.first()
    assert (row["title"], row["type"], row["content"], row["revision_count"], row["project"], row["review_after"]) == ("Keep it", "oddity", "another body", 2, "alpha", None)
    store, out = store.save_note("s1", "oddity", "Keep it", "Another  BODY", "alpha")
    assert [tuple(r)[1:] for r in out.collect()] == [("deduplicated", 1)] and store.observations.first()["duplicate_count"] == 2
    _, out = store.save_note("s1", "bugfix", " ", "x")
    assert out.first()["outcome"] == "empty_title"
    store.save(f"{tmp_path}/store")
    back = NoteStore.open(spark, f"{tmp_path}/store", now)
    assert [r["id"] for r in back.search("another body").collect()] == [1]
    prompts = spark.createDataFrame([(1, "q1", "s1", "go on", "alpha"), (2, "q2", "s1", "go on", "alpha")], "id long, sync_id string, session_id string, content string, project string").withColumn("created_at", now)
    back, told = back.save_prompts(prompts)
    assert sorted(r["outcome"] for r in told.collect()) == ["deduplicated", "inserted"] and back.prompts.count() == 1
    patched = back.update(spark.createDataFrame([(1, "see <private>this</private>", "Personal")], "id long, content string, scope string")).observations.first()
    assert (patched["content"], patched["scope"], patched["revision_count"]) == ("see [REDACTED]", "personal", 3)


def test_prompt_echoes(spark):
    p = spark.createDataFrame([(i, "s", "same", float(x)) for i, x in enumerate((0, 1, 2, 3))], "id long, session_id string, content string, sec double").withColumn("created_at", at(F.col("sec") / 60))
    assert [r["outcome"] for r in writes.prompt_echoes(p).orderBy("id").collect()] == ["inserted", "deduplicated", "deduplicated", "inserted"]


def test_normalised_saves_and_refusals(spark):
    s = spark.createDataFrame([("Fix", " A <private>x</private> ", "body", "C:\\Repo\\X", "Team", "A/B c"), ("odd", "t", "b", None, None, None), ("fix", " ", "b", None, None, None)], "type string, title string, content string, project string, scope string, topic_key string")
    a, b, c = writes.normalised(s).collect()
    assert (a["type"], a["title"], a["project"], a["scope"], a["topic_key"], a["refused"]) == ("bugfix", "A [REDACTED]", "x", "project", "a/b-c", None)
    assert b["refused"] is None and b["type"] == "odd" and c["refused"] == "empty_title"


def test_supersession_warns_the_target_and_conflict_both(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", None), (4, "d", "2024-01-01")], "id long, sync_id string, deleted_at string")
    rel = spark.createDataFrame([(1, "a", "b", "supersedes", "judged"), (2, "b", "c", "conflicts_with", "judged"), (3, "c", "b", "conflicts_with", "judged"), (4, "a", "d", "conflicts_with", "judged"), (5, "a", "c", "supersedes", "pending")], "id long, source_id string, target_id string, relation string, judgment_status string")
    got = {(r["id"], r["verb"], r["other"], r["relation_id"]) for r in relations.caveats(rel, rows).collect()}
    assert got == {(2, "superseded_by", 1, 1), (2, "conflicts_with", 3, 2), (3, "conflicts_with", 2, 2)}


def test_judging_refuses(spark):
    rows = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q")], "sync_id string, project string")
    rel = spark.createDataFrame([("r1", "a", "b"), ("r2", "a", "c"), ("r3", "a", "z")], "sync_id string, source_id string, target_id string")
    v = spark.createDataFrame([("r1", "related", 0.0), ("r1", "related", 1.0), ("r1", "related", 1.1), ("r1", "related", float("nan")), ("r1", "eats", 0.5), ("r2", "related", 0.5), ("r3", "related", 0.5), ("r9", "related", 0.5)], "sync_id string, relation string, confidence double").withColumn("reason", F.lit("<private>x</private>"))
    got = sorted(r["outcome"] for r in relations.judge(v, rel, rows).collect())
    assert got == sorted(["ok", "ok", "bad_confidence", "bad_confidence", "unknown_verb", "different_projects", "missing_end", "unknown_relation"])


def test_semantic_scan_runs_the_injected_judge(spark):
    pairs = spark.createDataFrame([(1, 2, "x", "y"), (3, 4, "x", "x")], "lo long, hi long, a string, b string")
    got = relations.semantic_scan(pairs, lambda a, b: '{"relation": "%s", "confidence": 0.5}' % ("related" if a == b else "not_conflict"))
    assert {(r["lo"], r["relation"]) for r in got.collect()} == {(1, "not_conflict"), (3, "related")}


def test_a_scan_by_meaning_skips_what_is_judged_and_keeps_what_it_learns(spark):
    from notelake.operators import index
    from notelake.sources import schemas

    now = F.to_timestamp(F.lit("2024-05-01 10:00:00"))
    notes = [(i, f"n{i}", f"word{i % 3} gamma{i % 3}", f"body {i}", "decision", "p", "project") for i in range(1, 10)] + [(50 + i, f"q{i}", f"other things {i}", "x", "bugfix", "elsewhere", "project") for i in range(40)]
    rows = spark.createDataFrame(notes, "id long, sync_id string, title string, content string, type string, project string, scope string").withColumns({"created_at": at(F.col("id").cast("double")), "deleted_at": F.lit(None).cast("timestamp")})
    edges = [(1, "r1", "n4", "n1", "supersedes", "judged"), (2, "r2", "n2", "n5", "related", "pending")]
    rel = spark.createDataFrame([], schemas.RELATIONS).unionByName(spark.createDataFrame(edges, "id long, sync_id string, source_id string, target_id string, relation string, judgment_status string").withColumns({"created_at": now, "updated_at": now}), allowMissingColumns=True)

    def judge(prompt):
        a, b = prompt.split("|")
        if {a, b} == {"n3", "n6"}:
            raise OSError("the judge is away")
        return "?" if {a, b} == {"n3", "n9"} else '{"relation": "%s", "confidence": 0.7, "reason": "<private>k</private> so"}' % ("not_conflict" if {a, b} == {"n1", "n7"} else "related")

    scan = lambda most: relations.scan_by_meaning(index.build(rows, stemmed=True), rows, rel, "P", "{a_id}|{b_id}", judge, now, max_pairs=most)
    after, summary = scan(100)
    assert tuple(summary.first()) == ("p", 9, 8, 5, 1, 1, 2, False)  # three groups of three notes: nine pairs, one of them judged before
    got = {tuple(sorted((r["source_id"], r["target_id"]))): (r["relation"], r["judgment_status"], r["reason"]) for r in after.collect()}
    assert got[("n1", "n4")] == ("supersedes", "judged", None) and got[("n2", "n5")] == ("related", "judged", "[REDACTED] so")
    assert set(got) == {("n1", "n4"), ("n2", "n5"), ("n4", "n7"), ("n2", "n8"), ("n5", "n8"), ("n6", "n9")}
    assert after.select("id").distinct().count() == after.count() == 6
    _, summary = scan(3)
    assert (summary.first()["pairs"], summary.first()["capped"], summary.first()["already_judged"]) == (3, True, 1)


def test_similar_names_find_all(spark):
    rng = random.Random(5)
    names = sorted({"".join(rng.choices("abc-", k=rng.randint(1, 14))) for _ in range(150)} | {"Api", "api", "my-api-server-long"})
    got = {(r["a"], r["b"]) for r in projects.similar_names(spark.createDataFrame([(n,) for n in names], "project string")).collect()}

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x):
            new = [i + 1]
            for j, e in enumerate(y):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (c != e)))
            row = new
        return row[-1]

    want = {(a, b) for a in names for b in names if a < b and (a.lower() in b.lower() or b.lower() in a.lower() or edits(a.lower(), b.lower()) <= max(1, min(3, min(len(a), len(b)) // 2)))}
    assert got == want


def journal(spark, rows):
    return spark.createDataFrame(rows, "seq long, entity string, entity_key string, op string, payload string, project string, source string")


def test_replay_is_idempotent_and_knows_deletes(spark):
    rows = [(1, "observation", "a", "upsert", "{}", "p", "local"), (2, "observation", "a", "upsert", '{"deleted": true}', "p", "local"), (3, "observation", "b", "delete", "{}", "p", "local"), (4, "observation", "b", "upsert", '"{\\"deleted_at\\": \\" \\"}"', "p", "local")]
    a = {(r["entity_key"], r["deleted"]) for r in R.replay(journal(spark, rows)).collect()}
    assert a == {("a", True), ("b", False)} == {(r["entity_key"], r["deleted"]) for r in R.replay(journal(spark, rows + rows)).collect()}


def test_tombstone_boundary(spark):
    p = spark.createDataFrame([("x", 0.0), ("y", 1.0), ("z", 2.0), ("w", 0.0)], "sync_id string, m double").withColumn("created_at", at(F.col("m")))
    t = spark.createDataFrame([("x", 1.0), ("y", 1.0), ("z", 1.0)], "sync_id string, m double").withColumn("deleted_at", at(F.col("m"))).drop("m")
    ok, left = R.prompts_after_tombstones(p, t)
    assert {r["sync_id"] for r in ok.collect()} == {"z", "w"} and {r["sync_id"] for r in left.collect()} == {"x", "y"}


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, rng.choice(["observation", "prompt"]), rng.choice("abcdef"), rng.choice(["upsert", "delete"]), "{}", "p", "local") for i in range(300)]
    whole = journal(spark, rows)
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    order = list(range(0, 300, 30))
    rng.shuffle(order)
    for a in order:
        journal(spark, rows[a : a + 30]).coalesce(1).write.mode("append").parquet(src)
    q = R.run_stream(spark, src, whole.schema, state, max_files=2)
    q.awaitTermination(120)
    got = {tuple(r) for r in R.state(spark, state).select("entity", "entity_key", "seq", "deleted").collect()}
    assert got == {tuple(r) for r in R.replay(whole).select("entity", "entity_key", "seq", "deleted").collect()}


def test_state_machine_of_leases_and_failures(spark):
    s = spark.sql("select 'cloud' target_key, cast(null as string) lease_owner, cast(null as timestamp) lease_until, 0L consecutive_failures, cast(null as timestamp) backoff_until")
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    a = R.leased(s, "cloud", "me", now, 60)
    assert a.first()["lease_owner"] == "me" and R.leased(a, "cloud", "you", now, 60).first()["lease_owner"] == "me"
    assert R.leased(a, "cloud", "you", now + F.expr("INTERVAL 2 MINUTES"), 60).first()["lease_owner"] == "you"
    assert R.released(a, "cloud", "me").first()["lease_owner"] is None
    f = R.failed(R.failed(R.failed(s, "cloud", now), "cloud", now), "cloud", now)
    assert f.first()["consecutive_failures"] == 3 and f.select(F.date_format("backoff_until", "ss")).first()[0] == "04"


def test_export_and_import_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("o1", "s1", "p", "t"), ("o2", "s2", "q", "t")], "sync_id string, session_id string, project string, title string")
    sessions = spark.createDataFrame([("s1", "p"), ("s2", "q")], "id string, project string")
    prompts = spark.createDataFrame([("m1", "s1", "p")], "sync_id string, session_id string, project string")
    rel = spark.createDataFrame([("r1", "o1", "o2"), ("r2", "o1", "o1")], "sync_id string, source_id string, target_id string")
    e = projects.export("p", rows, sessions, prompts, rel)
    assert {k: v.count() for k, v in e.items()} == {"sessions": 1, "observations": 1, "prompts": 1, "relations": 1}
    ours = {"sessions": sessions.limit(0), "observations": rows.limit(0), "prompts": prompts.limit(0), "relations": rel.limit(0)}
    new = projects.import_new(e, ours, prompts.select("sync_id"))
    assert {k: v.count() for k, v in new.items()} == {"sessions": 1, "observations": 1, "prompts": 0, "relations": 1}
    exchange.write_export(e, str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x/observations")).first()["sync_id"] == "o1"


def test_json_export_reader(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"version": "1", "sessions": [{"id": "s", "project": "p"}], "observations": null}')
    t = exchange.read_export(spark, str(tmp_path / "a.json"))
    assert t["sessions"].first()["id"] == "s" and t["observations"].count() == 0 == t["relations"].count()
    (tmp_path / "b.json").write_text('{"version": "9"}')
    with pytest.raises(ValueError):
        exchange.read_export(spark, str(tmp_path / "b.json"))


def test_chunks_and_adoption(spark, tmp_path):
    import sqlite3

    c = spark.createDataFrame([('{"sessions": [{"id": "s"}], "prompts": null}',)], "payload string")
    assert exchange.read_chunks(c)["sessions"].first()["id"] == "s" and exchange.read_chunks(c)["prompts"].count() == 0
    kept, odd = exchange.dedupe_chunks(spark.createDataFrame([("p", "1", "x"), ("p", "1", "x"), ("p", "2", "x"), ("p", "2", "y")], "project string, chunk_id string, payload string"))
    assert kept.count() == 1 and odd.first()["chunk_id"] == "2"
    db = sqlite3.connect(tmp_path / "s.db")
    db.execute("CREATE TABLE sessions (id TEXT, project TEXT, junk TEXT)")
    db.execute("INSERT INTO sessions VALUES ('s', 'p', 'j')")
    db.commit()
    like = spark.createDataFrame([], "id string, project string, directory string")
    tables, counts = exchange.adopt_tables(exchange.read_sqlite(spark, str(tmp_path / "s.db"), ("sessions", "prompts")), {"sessions": like, "prompts": like})
    assert tables["sessions"].first() == ("s", "p", None) and {tuple(r) for r in counts.collect()} == {("sessions", 1, 1), ("prompts", 0, 0)}


def test_doctor_names_one_check(spark):
    from notelake.sources import adapters as D

    sf = "/root/testdata/sf0.001"
    args = (D.observations(spark, sf), D.log_sessions(spark, sf), D.prompts(spark, sf), D.relations(spark, sf))
    assert quality.report(*args, code="stale_hashes").first()["ok"]
    with pytest.raises(ValueError):
        quality.report(*args, code="nope")


def test_vault_is_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s", "k/x", "2024-01-01", 'A "b"', "bugfix", "body", "P", None), (2, "s", "k/x", "2024-01-02", "C", "bugfix", "body", None, None)], "id long, session_id string, topic_key string, created_at string, title string, type string, content string, project string, deleted_at string")
    v = exchange.vault(rows, rows)
    assert {r["path"] for r in v.collect()} == {"p/a-b-1.md", "none/c-2.md", "sessions/s.md", "topics/k-x.md"}
    assert {r["written"] for r in exchange.write_vault(v, f"file://{tmp_path}").collect()} == {True}
    assert {r["written"] for r in exchange.write_vault(v, f"file://{tmp_path}").collect()} == {False}
    assert "a-b-1" in (tmp_path / "sessions/s.md").read_text()


def test_changes_without_a_session_do_not_meet(spark):
    """Changes that name no session stay where they are read; those that name one are judged as before."""
    at = F.col("id")
    m = spark.range(400, numPartitions=4).select(at.alias("seq"), F.lit("observation").alias("entity"), F.concat(F.lit("k"), at.cast("string")).alias("entity_key"), F.lit("upsert").alias("op"), F.when(at < 4, F.concat(F.lit('{"session_id": "s'), (at % 2).cast("string"), F.lit('"}'))).otherwise("{}").alias("payload"))
    got = R.checked(m, spark.createDataFrame([("s1",)], "id string")).withColumn("task", F.spark_partition_id()).collect()
    assert {r["seq"]: r["problem"] for r in got} == {k: "session" if k in (0, 2) else None for k in range(400)}
    assert max(sum(r["task"] == t for r in got) for t in {r["task"] for r in got}) <= 100
