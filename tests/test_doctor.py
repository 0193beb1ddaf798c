"""Health under its codes, repairs with counts, numbering inside a hot key."""

import pytest
from pyspark.sql import functions as F

from notelake.operators import doctor, index, numbering, quality
from notelake.operators.numbering import numbered
from notelake.session import written
from notelake.sources import adapters as D
from notelake.store import NoteStore
from notelake.streaming import replication as R

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark):
    s = NoteStore(D.observations(spark, SF), D.sessions(spark, SF), D.prompts(spark, SF), D.relations(spark, SF), spark.createDataFrame([], "sync_id string, session_id string, project string, deleted_at timestamp"), F.to_timestamp(F.lit("2024-06-01")))
    return s.rebuild_indexes()[0]


def answers(df):
    return {r["code"]: (r["ok"], r["detail"]) for r in df.collect()}


def test_each_code_alone_says_what_all_say(store):
    prompts = index.build(store.prompts, ("content", "project"))
    every = answers(store.health(prompt_index=prompts))
    assert tuple(every) == doctor.CODES
    for code in doctor.CODES:
        assert answers(store.health(code, prompts)) == {code: every[code]}
    assert answers(store.health("prompt_fts_sync")) == {"prompt_fts_sync": (False, "no index")}
    with pytest.raises(ValueError, match="known: foreign_keys, observation_fts_integrity"):
        store.health("journal_mode")


def scans(df, column):
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(line.lstrip(" :+-").startswith("Relation [") and column in line for line in text.splitlines())


def test_one_scan_a_table(store, spark, tmp_path):
    for t in ("observations", "sessions", "prompts"):
        getattr(store, t).write.parquet(f"{tmp_path}/{t}")
    rows, sessions, prompts = (spark.read.parquet(f"{tmp_path}/{t}") for t in ("observations", "sessions", "prompts"))
    for name, stemmed in (("exact", False), ("stemmed", True)):
        index.build(rows, stemmed=stemmed).save(f"{tmp_path}/{name}")
    held = {"observation_fts": index.Index.load(spark, f"{tmp_path}/stemmed", True), "observation_exact_fts": index.Index.load(spark, f"{tmp_path}/exact")}
    df = doctor.report(rows, sessions, prompts, held)
    assert scans(df, "normalized_hash") == 1
    one = doctor.report(rows, sessions, prompts, held, "observation_hash_sync")
    assert scans(one, "") == 1 and "Join" not in one._jdf.queryExecution().optimizedPlan().toString()
    assert answers(one) == {"observation_hash_sync": (True, "0")}


def test_damage_is_counted(spark):
    rows = spark.createDataFrame([(1, "s", "bugfix", "a b", "P", "t", "project", None), (2, "x", "odd", "c", "P", "t", "project", None), (3, None, "bugfix", "", None, "t", "project", None), (4, "s", "odd", "d", "P", "t", "project", "2024-01-01"), (5, "s", "bugfix", "e", "P", "", "project", None)], "id long, session_id string, type string, content string, project string, topic_key string, scope string, deleted_at string")
    rows = quality.rehashed(rows.withColumn("normalized_hash", F.lit("old")))
    sessions, prompts = spark.createDataFrame([("s",), ("s",)], "id string"), spark.createDataFrame([(1, "y")], "id long, session_id string")
    i = index.build(rows, ("content",))
    twice = index.Index(i.postings, i.docstats.unionByName(i.docstats.where("doc_id = 1")))
    lost = index.Index(i.postings, i.docstats.where("doc_id <> 2").unionByName(spark.createDataFrame([(9, 0)], "doc_id long, n_tokens long")))
    got = answers(doctor.report(rows, sessions, prompts, {"observation_fts": twice, "observation_exact_fts": lost}))
    assert {k: v[1] for k, v in got.items()} == {
        "foreign_keys": "3", "observation_fts_integrity": "1", "observation_exact_fts_integrity": "1", "prompt_fts_integrity": "no index", "observation_fts_sync": "0",
        "observation_exact_fts_sync": "2", "prompt_fts_sync": "no index", "observation_hash_sync": "0", "observation_type_searchable": "1", "topic_key_uniqueness": "1",
    }
    empty = answers(doctor.report(rows.limit(0), sessions, prompts.limit(0), {}))
    assert {v for k, v in empty.items() if "_fts_" not in k} == {(True, "0")}


def test_repairs_count_before_and_after(store):
    bad = store.changed(observations=store.observations.withColumn("normalized_hash", F.when(F.col("id") % 10 == 0, "old").otherwise(F.col("normalized_hash"))))
    n = int(answers(bad.health("observation_hash_sync"))["observation_hash_sync"][1])
    fixed, counts = bad.rehash()
    assert n > 0 and counts.collect() == [(n, 0)] and answers(fixed.health("observation_hash_sync")) == {"observation_hash_sync": (True, "0")}
    _, sizes = bad.rebuild_indexes()
    rows = store.observations.count()
    assert {tuple(r) for r in sizes.collect()} == {("observation_exact_fts", 0, rows), ("observation_fts", 0, rows)}


def test_a_hot_key_is_numbered_by_many_tasks(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(numbering, "written", lambda df, name: kept.append(written(df, name)) or kept[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        key = F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, F.concat(F.lit("k"), F.col("id") % 7))
        rows = spark.range(20000).select(key.alias("key"), (F.col("id") * 7919 % 20011).alias("seq"), "id")
        out = numbered(rows, ["key"], ["seq"])
        got = out.collect()
        assert len(got) == 20000
        parts = [r["n"] for r in kept[0].groupBy(F.shiftright("_k", 33)).agg(F.count_if(F.col("key") == "hot").alias("n")).collect()]
        assert sum(n > 0 for n in parts) > 2 and max(parts) < 10000
        by = {}
        for r in got:
            by.setdefault(r["key"], []).append((r["seq"], r["place"]))
        assert all([p for _, p in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values())
        m = spark.range(1000).select(F.lit("p").alias("project"), F.col("id").alias("seq"), F.lit("session").alias("entity"), F.lit("k").alias("entity_key"), F.lit("upsert").alias("op"), F.lit("{}").alias("payload"))
        assert sorted(tuple(r) for r in R.materialise_chunks(m, 30).select("chunk", "n").collect()) == [(i, 30 if i < 33 else 10) for i in range(34)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert numbered(rows.limit(0), ["key"], ["seq"]).collect() == []
    for limit in (0, 101):
        with pytest.raises(ValueError):
            R.materialise_chunks(m, limit)
