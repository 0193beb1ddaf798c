"""Documents as rows of weighed words against postings: the same parts, the same answers, and what is written on the way."""

import random

import pytest
from pyspark.sql import functions as F

from notelake.operators import blocks, bm25, frames, index, relations

WORDS = ["cache", "Búsqueda", "foo-bar", "foo", "bar", "a/b/c", "a", "b", "token", "x_y", "…", "b/c"]
NOTES = "id long, sync_id string, type string, title string, content string, project string, scope string, topic_key string, updated_at timestamp, deleted_at timestamp"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choices(WORDS, k=rng.randint(0, n)))
    notes = [(i, f"o{i}", rng.choice(["bugfix", "session_summary", "policy"]), text(6), text(25), rng.choice(["p", "q", None]), rng.choice(["project", "personal"]), rng.choice([None, "t/1", "t/2"]), rng.random() < 0.1) for i in range(240)]
    at = F.timestamp_seconds(F.col("id") % 50)
    made = spark.createDataFrame(notes, NOTES.replace("updated_at timestamp, deleted_at timestamp", "gone boolean"))
    return made.withColumns({"updated_at": at, "deleted_at": F.when(F.col("gone"), at)}).drop("gone").cache()


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(blocks, "DOCS", 40)
    monkeypatch.setattr(blocks, "TOKENS", 64)


def plain(i):
    """The same index, not as a plan over rows."""
    return index.Index(i.postings, i.docstats, i.stemmed)


@pytest.fixture
def tables(monkeypatch):
    out = {}
    for m in (blocks, relations, frames):
        real = m.written
        monkeypatch.setattr(m, "written", lambda df, name, real=real, **options: out.setdefault(name, []).append(real(df, name, **options)) or out[name][-1])
    return out


@pytest.mark.parametrize("bits", [23, 15])
def test_parts_are_those_of_the_postings(spark, rows, monkeypatch, bits):
    monkeypatch.setattr(blocks, "WORD_BITS", bits)
    i = index.build(rows)
    phrases = spark.createDataFrame([(x,) for x in ("cache", "busqueda", "foo bar", "foo", "a b c", "b c", "x y", "nothing", "p", "a a", "foo bar foo bar")], "phrase string")
    words = blocks.worded(phrases)
    docs, idf = blocks.documents(i, words, bm25.SEARCH_WEIGHTS)
    each = docs.select("doc_id", "norm", F.explode(F.arrays_zip("words", "f")).alias("w")).select("doc_id", "norm", F.col("w.words").alias("word"), F.col("w.f").alias("f"))
    part = F.col("idf") * F.col("f") * (bm25.K1 + 1) / (F.col("f") + F.col("norm"))
    got = sorted((r["phrase"], r["doc_id"], r["part"]) for r in each.join(idf, "word").join(words, "word").select("phrase", "doc_id", part.alias("part")).collect())
    known = blocks.named(phrases)
    want = sorted((r["phrase"], r["doc_id"], r["part"]) for r in blocks.parts(plain(i), known, bm25.SEARCH_WEIGHTS).join(known, "word").select("phrase", "doc_id", "part").collect())
    assert got == want and {"foo bar", "a b c", "x y", "p"} <= {g[0] for g in got}
    assert docs.count() == 240


def test_candidates_write_a_row_a_document(spark, rows, tables):
    i = index.build(rows)
    related = spark.createDataFrame([("o1", "o2"), ("o9", "o4")], "source_id string, target_id string")
    live = rows.where("deleted_at is null")
    answers = lambda of: sorted((r["source"], r["candidate"], round(r["score"], 9)) for r in relations.candidates(of, rows, live, related, floor=0.0).collect())
    got = answers(i)
    assert set(tables) == {"words", "documents", "idf", "blocks"}  # no index, no row for a word of a document
    assert tables["documents"][0].count() == 240
    assert got == answers(plain(i)) and len(got) > 200


def test_frames_answer_alike(spark, rows, tables):
    i = index.build(rows)
    texts = ["cache token", "foo-bar a/b/c", "cache zzqx", "foo bar zzqx zzqy", "t/1", "busqueda x_y", "a/b/c foo-bar FOO_BAR"]
    asked = spark.createDataFrame([(k, t, p, s) for k, (t, p, s) in enumerate((t, p, s) for t in texts for p in (None, "P", "none") for s in (None, "personal"))], "qid long, query string, project string, scope string")
    answers = lambda of: sorted(map(tuple, frames.search_all(of, of, rows, asked, 4).withColumn("score", F.round("score", 8)).collect()))
    got = answers(i)
    assert "parts" not in tables and "documents" in tables
    assert got == answers(plain(i)) and {r[6] for r in got} == {1, 2, 3, 4}


def test_queries_for_a_topic_meet_its_notes_once(spark, rows, tables):
    n = 300
    asked = frames._asked(spark.createDataFrame([(k, "t/1" if k % 2 else "T/2", "q" if k % 3 == 0 else None) for k in range(n)], "qid long, query string, project string"))
    got = {}
    for r in frames.topics(asked, rows, 5).orderBy("place").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    notes = sorted((r for r in rows.collect() if r["deleted_at"] is None), key=lambda r: (-r["updated_at"].timestamp(), r["id"]))
    for k in range(n):
        assert got[k] == [r["id"] for r in notes if r["topic_key"] == ("t/1" if k % 2 else "t/2") and (k % 3 or r["project"] == "q")][:5]
    assert tables["newest"][0].count() == 4 * 5  # two keys, with and without a project


@pytest.mark.parametrize("name", ["candidates", "scan_project", "searched_frame"])
def test_queries_make_no_index(spark, tables, monkeypatch, name):
    from notelake.plans import catalog, more  # noqa: F401

    monkeypatch.setattr(catalog, "saved_index", lambda *_: pytest.fail("an index was written"))
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert "documents" in tables and "parts" not in tables
