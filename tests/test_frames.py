"""Staged search for a frame of queries against `search`, query by query."""

import pytest
from pyspark.sql import functions as F
from test_search import rows  # noqa: F401

from notelake.operators import frames, index, search

ASKED = [
    (1, "migration cache", None), (2, "topic/3", None), (3, "  Topic/3 ", "alpha"), (4, "migrating token zzqx", None), (5, "zzqx zzqy cache panic relation", None), (6, "zzqx", None),
    (7, "foo-bar Foo-Bar panic", "beta"), (8, " ", None), (9, "… !!", None), (10, "BÚSQUEDA index", " "), (11, None, None), (12, "cache … zzqx", None), (13, "relations stored", "nowhere"),
]


@pytest.fixture(scope="module")
def both(rows):  # noqa: F811
    return index.build(rows).__class__(*(x.cache() for x in (index.build(rows).postings, index.build(rows).docstats))), index.Index(index.build(rows, stemmed=True).postings.cache(), index.build(rows).docstats.cache(), True)


@pytest.mark.parametrize("mode", ["all", "any"])
def test_equals_search_a_query(spark, rows, both, mode):  # noqa: F811
    frame = spark.createDataFrame(ASKED, "qid long, query string, project string")
    got = {}
    for r in frames.search_all(*both, rows, frame, 5, mode).orderBy("qid", "place").collect():
        got.setdefault(r["qid"], []).append((r["id"], r["title"], r["stage"], r["partial"], pytest.approx(r["score"], abs=1e-8)))
    stages = set()
    for qid, text, project in ASKED if mode == "all" else ASKED[:3]:
        if not (text or "").strip():
            assert qid not in got
            continue
        want = [(r["id"], r["title"], r["stage"], r["partial"], r["score"]) for r in search.search(*both, rows, text, 5, mode, search.Filters(project=project)).collect()]
        assert want == got.get(qid, []), text
        stages |= {w[2] for w in want}
    assert stages == ({1, 2, 3, 4} if mode == "all" else {1, 2})


def test_words_are_those_of_one_query(spark):
    from notelake.operators import bm25

    texts = ["a B  b\tA", "foo-bar foo_bar x", " é É ñ", "", "… a", "x\0y z", "one\x1ctwo"]
    frame = spark.createDataFrame(list(enumerate(texts)), "qid long, query string")
    got = sorted(tuple(r) for r in bm25.phrase_frame(frame, bm25.split_column(F.col("query"))).collect())
    assert got == sorted(bm25.phrases({k: bm25.split_terms(t) for k, t in enumerate(texts)}))


def test_no_query_and_no_note(spark, rows, both):  # noqa: F811
    frame = spark.createDataFrame([], "qid long, query string")
    assert frames.search_all(*both, rows, frame).count() == 0
    none = rows.limit(0)
    empty = index.build(none)
    assert frames.search_all(empty, empty, none, spark.createDataFrame([(1, "cache")], "qid long, query string")).count() == 0


def test_jobs_do_not_grow_with_queries(spark, rows, both):  # noqa: F811
    def jobs(n):
        group = f"frame-{n}"
        spark.sparkContext.setJobGroup(group, group)
        frames.search_all(*both, rows, spark.createDataFrame([(k, f"migration {'zzqx ' * (k % 2)}cache") for k in range(n)], "qid long, query string")).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(200) <= jobs(2) + 4
