"""Steps that read no more than they need: paths of a vault, titles, headlines, the documents of an index."""

import pyarrow as pa
from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.functions.markdown import headline, headline_udf
from notelake.plans import catalog, more  # noqa: F401
from notelake.sources import adapters, exchange

ODD = ["", " ", None, "one", "  a\tb  c ", "a b c d e f g h", "a b c d e f g h ", "a\n\nb c d e f g h i j k", " x y z", "w" * 5000 + " v", "a b c d e f g h i"]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_titles_are_the_first_words(spark, tmp_path):
    rows = [(i, x, "en", "src", len(x or "")) for i, x in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    whole = F.array_join(F.slice(F.split(T.one_line(F.col("content")), " ", 9), 1, 8), " ")
    notes = adapters.observations(spark, str(tmp_path))
    assert notes.where(~whole.eqNullSafe(F.col("title"))).count() == 0
    assert "regexp_extract" in plan(notes.select("title"))


def test_paths_make_no_lists(spark):
    rows = spark.createDataFrame([(i, "s1", "t1" if i < 3 else "t2" if i == 3 else None, "p", f"title {i}", "k", "c", "2024-01-01") for i in range(5)], "id long, session_id string, topic_key string, project string, title string, type string, content string, created_at string").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    files = exchange.vault(rows, rows)
    assert "collect_list" not in plan(files.select("path")) and "collect_list" in plan(files)
    assert sorted(r["path"] for r in files.collect()) == [*(f"p/title-{i}-{i}.md" for i in range(5)), "sessions/s1.md", "topics/t1.md"]


def test_headlines_take_arrow_arrays(spark):
    texts = ["# Head\n\nA line of prose here.", None, "", "```\nthis is code and no line\n```\n- five words in an item"]
    assert headline_udf.func(pa.array(texts)).to_pylist() == [headline(x) for x in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r["h"] for r in df.orderBy("i").select(headline_udf("t").alias("h")).collect()] == [headline(x) for x in texts]


def test_the_report_writes_no_postings(spark, monkeypatch):
    monkeypatch.setattr(catalog, "_SAVED", {})
    catalog.QUERIES["doctor_report"](spark, "/root/testdata/sf0.001")
    assert [k[2] for k in catalog._SAVED] == ["listed"]
