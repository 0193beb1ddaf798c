"""Top scores by bounds against all scores; how many rows meet."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.operators import relations


def tables(spark, seed, n_docs=300, n_queries=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    parts = [("every", rng.choice("ab"), i, rng.random() * 1e-3) for i in range(n_docs)]
    group = {i: g for _, g, i, _ in parts}
    parts += [(w, group[i], i, rng.randint(1, 9) / 3) for i in range(n_docs) for w in rng.sample(words, rng.choice([1, 3, 9]))]
    asked = [(q, w, rng.choice("ab")) for q in range(n_queries) for w in ["every", *rng.choices(words, k=rng.randint(0, 6))]]
    one = {}
    asked = [(q, w, one.setdefault(q, g)) for q, w, g in asked]
    return spark.createDataFrame(asked, "qid long, phrase string, group string"), spark.createDataFrame(parts, "phrase string, group string, doc_id long, part double")


def best(scores, allowed, most):
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", 9), "doc_id"))
    return sorted((r["qid"], r["place"], r["doc_id"], round(r["score"], 6)) for r in allowed(scores).withColumn("place", place).where(F.col("place") <= most).collect())


@pytest.mark.parametrize(("seed", "most", "rare"), [(1, 5, 10), (2, 24, 60), (3, 1, 1), (4, 400, 5)])
def test_the_best_are_the_best_of_all_scores(spark, seed, most, rare):
    asked, parts = tables(spark, seed)
    allowed = lambda p: p.where("qid <> doc_id and (qid + doc_id) % 7 <> 0")
    every = asked.join(parts, ["phrase", "group"]).groupBy("qid", "doc_id").agg((F.lit(0.0) - F.sum("part")).alias("score"))
    got = relations.bounded_scores(asked, parts, allowed, most, rare)
    assert best(got, allowed, most) == best(every, allowed, most)


def test_a_word_of_every_title_joins_with_what_others_find(spark, monkeypatch):
    rng = random.Random(7)
    kept = {}
    real = relations.written
    monkeypatch.setattr(relations, "written", lambda df, name: kept.setdefault(name, real(df, name)))
    n = 600  # all notes say one word; each says a word that some forty share
    parts = [("every", "a", i, 1e-6) for i in range(n)] + [(f"some{i % 15}", "a", i, 1 + rng.random()) for i in range(n)]
    asked = [(i, w, "a") for i in range(n) for w in ("every", f"some{i % 15}")]
    got = relations.bounded_scores(spark.createDataFrame(asked, "qid long, phrase string, group string"), spark.createDataFrame(parts, "phrase string, group string, doc_id long, part double"), lambda p: p.where("qid <> doc_id"), 24, 30)
    assert got.count() == n * 40 and kept["found"].count() == n * 40  # of n * n
    assert kept["late"].where("idle").count() == n


def test_no_words_and_no_documents(spark):
    asked, parts = tables(spark, 1)
    assert relations.bounded_scores(asked.limit(0), parts, lambda p: p).count() == 0
    assert relations.bounded_scores(asked, parts.limit(0), lambda p: p).count() == 0
