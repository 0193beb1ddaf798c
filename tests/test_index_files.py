"""How a saved index is dealt to files."""

from pyspark.sql import functions as F

from notelake.functions.porter import stem
from notelake.operators import index


def test_a_frequent_word_is_no_single_file(spark, tmp_path):
    rows = spark.range(400).select("id", F.concat(F.lit("every w"), F.col("id").cast("string")).alias("content"))
    built = index.build(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else these few rows are one file
    try:
        built.save(str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = index.Index.load(spark, str(tmp_path))
    assert held.postings.exceptAll(built.postings).isEmpty() and built.postings.exceptAll(held.postings).isEmpty()
    n = held.postings.where("term = 'every'").groupBy(F.input_file_name().alias("f")).count().collect()
    assert max(r["count"] for r in n) < 400


def test_an_index_is_written_where_it_is_made(spark, tmp_path, monkeypatch):
    """Neither a plain nor a stemmed index shuffles its postings; runs are in order of term; postings that come from joins are put in order too."""
    monkeypatch.setattr(index, "RUN", 50)
    rows = spark.range(90).select("id", F.concat(F.lit("Every  wörds w"), F.col("id").cast("string")).alias("content"), F.when(F.col("id") % 3 == 0, "stored").alias("title"))
    for stemmed in (False, True):
        built = index.build(rows, stemmed=stemmed)
        assert "Exchange" not in built.postings._jdf.queryExecution().executedPlan().toString()
        word = stem if stemmed else str
        want = [(i, "content", k, word(w)) for i in range(90) for k, w in enumerate(("every", "words", f"w{i}"))] + [(i, "title", 0, word("stored")) for i in range(0, 90, 3)]
        assert sorted(map(tuple, built.postings.select("doc_id", "col", "pos", "term").collect())) == sorted(want)
    one = index.build(rows.coalesce(1)).postings.collect()
    assert len(one) == 300 and sum(a["term"] > b["term"] for a, b in zip(one, one[1:])) < 7  # as many runs
    again = index.build(rows).refresh(rows.where("id < 9"))
    again.save(str(tmp_path))
    assert sorted(map(tuple, index.Index.load(spark, str(tmp_path)).postings.select("doc_id", "term").collect())) == sorted((i, w) for i, _, _, w in [(i, "", 0, w) for i in range(90) for w in ("every", "words", f"w{i}")] + [(i, "", 0, "stored") for i in range(0, 90, 3)])
