"""Okapi BM25 with column weights on term frequency, over any number of queries at once.

score = -sum over phrases of idf * f * (k1 + 1) / (f + k1 * (1 - b + b * |d| / avgdl)), lower is better, where f is the weighted count of a
phrase and idf = ln((N - n + 0.5) / (n + 0.5)), or 1e-6 where that is not positive.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .index import Index

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
SEARCH_WEIGHTS = {"title": 5.0, "content": 0.5, "tool_name": 0.0, "type": 0.0, "project": 0.0, "topic_key": 3.0}
CANDIDATE_WEIGHTS = {"title": 1.0, "content": 1.0, "tool_name": 1.0, "type": 1.0, "project": 0.0, "topic_key": 1.0}
MAX_ANY_TERMS = 32
_FOLD = str.maketrans(*T.DIACRITICS)


def split_terms(query: str) -> list[str]:
    """Words of a query between white space, each once in any case, without NUL."""
    seen, out = set(), []
    for w in query.replace("\0", "").split():
        if w.lower() not in seen:
            seen.add(w.lower())
            out.append(w)
    return out


def word_tokens(word: str) -> list[str]:
    """What the index makes of a word: one token, a phrase of several, or none."""
    folded = word.lower().translate(_FOLD)
    return [t for t in re.split(r"[^\w]+|_+", "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in folded)) if t]


def phrases(queries: dict[int, list[str]]) -> list[tuple[int, int, int, int, str, bool]]:
    """(qid, phrase, offset, length, term, prefix) rows; words without a token are dropped, as the index never sees them."""
    out = []
    for qid, words in queries.items():
        n = 0
        for w in words:
            prefix = w.endswith("*") and len(w) > 1
            toks = word_tokens(w.rstrip("*") if prefix else w)
            for k, t in enumerate(toks):
                out.append((qid, n, k, len(toks), t, prefix and k == len(toks) - 1))
            n += bool(toks)
    return out


def query_frame(spark: SparkSession, queries: dict[int, list[str]]) -> DataFrame:
    return spark.createDataFrame(phrases(queries), "qid long, phrase int, off int, len int, term string, prefix boolean")


def postings_of(index: Index, rows: list[tuple]) -> DataFrame:
    """The postings of the words of some phrases: a filter on the term that reaches the scan of a saved index."""
    exact = sorted({index.word(t) for *_, t, prefix in rows if not prefix})
    here = F.col("term").isin(*exact) if exact else F.lit(False)
    for lead in sorted({index.word(t) for *_, t, prefix in rows if prefix}):
        here = here | F.col("term").startswith(lead)
    return index.postings.where(here)


def split_column(x: Column) -> Column:
    """The words of query texts, as `split_terms` makes them."""
    words = F.filter(F.split(F.regexp_replace(F.coalesce(x, F.lit("")), "\\x00", ""), r"(?U)[\s\x{1c}-\x{1f}]+"), lambda w: w != "")
    low = F.transform(words, F.lower)
    return F.filter(words, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)


def phrase_frame(queries: DataFrame, terms: Column) -> DataFrame:
    """(qid, phrase, off, len, term, prefix) of queries whose words are an array, as `phrases` makes them; no word is a beginning."""
    kept = F.filter(F.transform(terms, T.tokens), lambda t: F.size(t) > 0)
    each = queries.select("qid", F.posexplode(kept).alias("phrase", "toks"))
    return each.select("qid", "phrase", F.posexplode("toks").alias("off", "term"), F.size("toks").alias("len")).select("qid", "phrase", "off", "len", "term", F.lit(False).alias("prefix"))


def occurrences(index: Index, words: DataFrame, rows: list[tuple] | None = None) -> DataFrame:
    """(qid, phrase, doc_id, col, n): how often a phrase stands in a column. rows: the query frame as it is on the driver, if it is
    there; only such a frame is broadcast."""
    q = index.words(words)
    if rows is not None:
        q, p = F.broadcast(q), postings_of(index, rows)
        prefixed, long = any(r[5] for r in rows), any(r[3] > 1 for r in rows)
    else:
        p = index.postings
        prefixed, long = (not words.where(c).isEmpty() for c in ("prefix", "len > 1"))
    hits = p.join(q.where("not prefix"), "term").select("qid", "phrase", "off", "len", "doc_id", "col", "pos")
    if prefixed:
        begun = p.join(q.where("prefix").withColumnRenamed("term", "lead"), F.col("term").startswith(F.col("lead")))
        hits = hits.unionByName(begun.select("qid", "phrase", "off", "len", "doc_id", "col", "pos"))
    single = hits.where("len = 1").groupBy("qid", "phrase", "doc_id", "col").agg(F.count("*").alias("n"))
    if not long:
        return single
    runs = hits.where("len > 1").groupBy("qid", "phrase", "len", "doc_id", "col", (F.col("pos") - F.col("off")).alias("at")).agg(F.countDistinct("off").alias("m")).where("m = len")
    return single.unionByName(runs.groupBy("qid", "phrase", "doc_id", "col").agg(F.count("*").alias("n")))


def in_project(index: Index, project: str) -> DataFrame:
    """(doc_id) of documents whose project column holds the words of the name: a superset of its documents, from the index alone."""
    words = sorted({index.word(t) for t in word_tokens(project)})
    held = index.postings.where((F.col("col") == "project") & F.col("term").isin(*words))
    return held.groupBy("doc_id").agg(F.countDistinct("term").alias("m")).where(F.col("m") == len(words)).select("doc_id")


def scores(index: Index, words: DataFrame, weights: dict[str, float] = SEARCH_WEIGHTS, rows: list[tuple] | None = None, within: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, matched, score) of every document that holds any phrase; matched: how many different ones.

    rows: see occurrences. within: (doc_id) to which the result is narrowed once the phrases are counted in all documents."""
    w = F.lit(1.0)
    for c, x in weights.items():
        w = F.when(F.col("col") == c, F.lit(float(x))).otherwise(w)
    f = occurrences(index, words, rows).groupBy("qid", "phrase", "doc_id").agg(F.sum(F.col("n") * w).alias("f"))
    n = f.groupBy("qid", "phrase").agg(F.count("*").alias("n"))  # one row a phrase of the queries
    if within is not None:
        f = f.join(within, "doc_id", "left_semi")
    f = f.join(F.broadcast(n) if rows is not None else n, ["qid", "phrase"]).join(index.docstats, "doc_id").crossJoin(F.broadcast(index.totals()))  # one row of totals
    raw = F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n_tokens") / F.col("avgdl")))
    return f.groupBy("qid", "doc_id").agg(F.count("*").alias("matched"), (F.lit(0.0) - F.sum(part)).alias("score"))


def asked(index: Index, queries: dict[int, list[str]], weights: dict[str, float] = SEARCH_WEIGHTS, within: DataFrame | None = None) -> DataFrame:
    """The scores of queries that the driver holds."""
    return scores(index, query_frame(index.postings.sparkSession, queries), weights, phrases(queries), within)


def counts(words: list[tuple]) -> dict[int, int]:
    """Phrases of each query."""
    out: dict[int, int] = {}
    for qid, phrase, *_ in words:
        out[qid] = max(out.get(qid, 0), phrase + 1)
    return out


def match_all(index: Index, query: str | list[str], weights: dict[str, float] = SEARCH_WEIGHTS, within: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) of the documents that hold every phrase of the query."""
    terms = split_terms(query) if isinstance(query, str) else query
    k = counts(phrases({0: terms})).get(0, 0)
    return asked(index, {0: terms}, weights, within).where(F.col("matched") == k).select("doc_id", "score")


def match_any(index: Index, query: str | list[str], weights: dict[str, float] = SEARCH_WEIGHTS, most: int | None = MAX_ANY_TERMS, within: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) of the documents that hold any of the first `most` words."""
    terms = split_terms(query) if isinstance(query, str) else query
    return asked(index, {0: terms[:most] if most else terms}, weights, within).select("doc_id", "score")


def match_prefix(index: Index, query: str, weights: dict[str, float] = SEARCH_WEIGHTS, within: DataFrame | None = None) -> DataFrame:
    """All words, the last one as a beginning."""
    terms = split_terms(query)
    return match_all(index, [*terms[:-1], f"{terms[-1]}*"] if terms else [], weights, within)
