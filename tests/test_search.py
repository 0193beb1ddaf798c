import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from notelake.operators import bm25, index, search

COLUMNS = ("title", "content", "tool_name", "type", "project", "topic_key")


def notes(n=120, seed=3):
    rng = random.Random(seed)
    words = "migration migrating index search búsqueda token tokens panic crash error cache relation related relations store stored design foo-bar snake_case v1.2".split()
    rows = []
    for i in range(1, n + 1):
        rows.append((i, " ".join(rng.choices(words, k=rng.randint(2, 6))), " ".join(rng.choices(words, k=rng.randint(3, 40))), rng.choice(["bugfix", "decision", "session_summary"]), rng.choice(["alpha", "beta"]), f"topic/{i % 9}" if i % 3 == 0 else None, i % 13 == 0))
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(notes(), "id long, title string, content string, type string, project string, topic_key string, gone boolean")
    t = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.col("id").cast("int"), F.lit(0), F.lit(0))
    return df.select("*", F.lit(None).cast("string").alias("tool_name"), F.lit("project").alias("scope"), t.alias("created_at"), t.alias("updated_at"), F.when(F.col("gone"), t).alias("deleted_at")).drop("gone").cache()


@pytest.fixture(scope="module")
def fts():
    def make(tokenize):
        db = sqlite3.connect(":memory:")
        db.execute(f"CREATE VIRTUAL TABLE t USING fts5({', '.join(COLUMNS)}, tokenize='{tokenize}')")
        for i, title, content, kind, project, topic, _ in notes():
            db.execute("INSERT INTO t (rowid, title, content, type, project, topic_key) VALUES (?, ?, ?, ?, ?, ?)", (i, title, content, kind, project, topic))
        return db

    return {False: make("unicode61"), True: make("porter unicode61")}


@pytest.mark.parametrize("stemmed", [False, True])
@pytest.mark.parametrize("query", ["migration cache", "migrating", "foo-bar panic", "related store index", "busqueda", "unknownword cache"])
@pytest.mark.parametrize("any_", [False, True])
def test_scores_equal_fts5(rows, fts, stemmed, query, any_):
    i = index.build(rows, stemmed=stemmed)
    got = (bm25.match_any if any_ else bm25.match_all)(i, query).collect()
    terms = (" OR " if any_ else " ").join(f'"{t}"' for t in query.split())
    want = fts[stemmed].execute("SELECT rowid, bm25(t, 5.0, 0.5, 0.0, 0.0, 0.0, 3.0) FROM t WHERE t MATCH ?", (terms,)).fetchall()
    assert {r["doc_id"]: pytest.approx(r["score"], abs=1e-9) for r in got} == dict(want)


def test_prefix_equals_fts5(rows, fts):
    got = bm25.match_prefix(index.build(rows), "cache rela").select("doc_id").collect()
    want = fts[False].execute("""SELECT rowid FROM t WHERE t MATCH '"cache" "rela" *'""").fetchall()
    assert {r["doc_id"] for r in got} == {r[0] for r in want}


def test_topic_key_is_found_however_typed_and_first(rows):
    i = index.build(rows)
    hits = search.search(i, i, rows, "  Topic/3 ", 10).collect()
    assert hits[0]["stage"] == 1 and {h["id"] for h in hits if h["stage"] == 1} <= {3, 12, 21, 30, 39, 48, 57, 66, 75, 84, 93, 102, 111, 120}


def test_topics_come_newest_first_and_end_the_search(rows):
    i = index.build(rows)
    live = [k for k in range(117, 0, -9) if k % 13 and k % 3 == 0]
    newest = [k for k in (120, 111, 102, 93, 84, 75, 66, 57, 48, 39, 30, 21, 12, 3) if k % 13]
    hits = search.search(i, i, rows, "topic/3", 5).collect()
    assert [h["id"] for h in hits if h["stage"] == 1] == newest[:5] and len(hits) == 5
    assert live
    # a topic alone is an answer: nothing is widened, though no note holds all the words
    assert {h["stage"] for h in search.search(i, i, rows, "topic/3", 20).collect()} <= {1, 2}


def test_fused_order_is_kept(rows):
    e, s = index.build(rows), index.build(rows, stemmed=True)
    got = [h["id"] for h in search.search(e, s, rows, "migrations relation", 10).collect()]
    lists = [[r["id"] for r in search.narrowed(bm25.match_all(i, "migrations relation"), rows, search.Filters()).orderBy("score", "id").limit(30).collect()] for i in (s, e)]
    score = {}
    for which, ids in enumerate(lists):
        for place, x in enumerate(ids):
            score.setdefault(x, [0.0, which, place])[0] += 1 / (60 + place + 1)
    kept = {r["id"]: r["score"] for i in (e, s) for r in search.narrowed(bm25.match_all(i, "migrations relation"), rows, search.Filters()).collect()}
    assert got == sorted(score, key=lambda x: (-score[x][0], kept[x], x))[:10] and len(got) > 3


def test_a_project_narrows_inside_the_index(rows):
    i = index.build(rows)
    mine = search.Filters(project="H:\\x\\ALPHA")
    a = search.narrowed(bm25.match_any(i, "cache error", within=search.within(i, mine)), rows, mine).collect()
    assert sorted(a) == sorted(search.narrowed(bm25.match_any(i, "cache error"), rows, mine).collect()) and a


def test_words_reach_the_scan_of_a_saved_index(rows, tmp_path, spark):
    index.build(rows).save(str(tmp_path))
    plan = bm25.match_all(index.Index.load(spark, str(tmp_path)), "cache rela*")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,rela)" in plan and "EqualTo(term,cache)" in plan


def test_strict_hit_is_not_diluted(rows):
    i = index.build(rows)
    assert {h["stage"] for h in search.search(i, i, rows, "migration cache", 10).collect()} == {2}


def test_unknown_word_is_dropped_once(rows):
    i = index.build(rows)
    hits = search.search(i, i, rows, "migration cache zzzz", 10).collect()
    assert hits and all(h["stage"] == 3 and h["partial"] and h["type"] != "session_summary" for h in hits)


def test_nothing_for_foreign_words(rows):
    i = index.build(rows)
    assert search.search(i, i, rows, "zzzz yyyy", 10).count() == 0


def test_deleted_rows_count_in_statistics_but_are_not_found(rows):
    i = index.build(rows)
    assert i.totals().first()["n_docs"] == 120
    hits = search.search(i, i, rows, "cache", 20)
    assert hits.join(rows.where("deleted_at is not null"), "id").count() == 0


def test_empty_query_is_refused_and_blank_filters_are_none(rows):
    i = index.build(rows)
    with pytest.raises(ValueError):
        search.search(i, i, rows, "  ", 10)
    a = search.search(i, i, rows, "cache", 5, filters=search.Filters(" ", "", None)).collect()
    assert a == search.search(i, i, rows, "cache", 5).collect()


def test_filters_fold_as_writes_do(rows):
    i = index.build(rows)
    got = search.search(i, i, rows, "cache", 20, filters=search.Filters("Fix", "H:\\x\\ALPHA", None)).collect()
    assert got and {(r["type"], r["project"]) for r in got} == {("bugfix", "alpha")}


def test_refreshed_index_equals_a_new_one(rows):
    i = index.build(rows.where("id <= 100"))
    changed = rows.where("id > 90").withColumn("title", F.concat("title", F.lit(" extra")))
    new = rows.where("id <= 90 and id <> 7").unionByName(changed)
    got = i.refresh(changed, rows.where("id = 7"))
    want = index.build(new)
    for a, b in ((got.postings, want.postings), (got.docstats, want.docstats)):
        assert a.exceptAll(b.select(*a.columns)).count() == 0 and b.select(*a.columns).exceptAll(a).count() == 0


def test_saved_index_reads_back(rows, tmp_path, spark):
    i = index.build(rows)
    i.save(str(tmp_path))
    back = index.Index.load(spark, str(tmp_path))
    assert sorted(bm25.match_all(back, "cache").collect()) == sorted(bm25.match_all(i, "cache").collect())


def test_pages_and_hints(rows):
    i = index.build(rows)
    page, total = search.page(i, rows, "", 0, 5)
    assert [r["id"] for r in page.collect()] == [120, 119, 118, 116, 115] and total.first()["total"] == 111
    assert search.hints(50, 20, False, True) == ["clamped", "more"] and search.hints(5, 0, False, False) == ["nothing"] and search.hints(5, 2, True, False) == ["partial"]
    assert search.elsewhere(i, rows, "cache", search.Filters(project="none")) > 0
