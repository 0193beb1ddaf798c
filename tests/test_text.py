import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notelake.functions import markdown, porter
from notelake.functions import text as T
from notelake.operators import bm25


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("column", "given_", "wanted"),
    [
        (T.project, "H:\\repo\\Name", "name"),
        (T.project, "a//b/", "b"),
        (T.project, "A--B__C", "a-b_c"),
        (T.project, " \n", ""),
        (T.project, "///", ""),
        (T.scope, " Personal ", "personal"),
        (T.scope, "team", "project"),
        (T.kind, " HotFix ", "bugfix"),
        (T.kind, "other", "other"),
        (T.topic_key, "Architecture/Búsqueda  Rápida v1.2!", "architecture/busqueda-rapida-v1.2"),
        (T.topic_key, "  ", None),
        (T.topic_key, "日本", None),
        (T.strip_private, " a <PRIVATE>x\ny</private> b\u0000 ", "a [REDACTED] b"),
        (T.strip_private, "<private>open", "<private>open"),
        (T.one_line, "a\u00a0\n b", "a b"),
        (T.prompt_core, " /cmd:x  Do IT", "do it"),
        (T.prompt_core, "/cmd", "/cmd"),
        (T.prompt_core, "$5 bills", "bills"),
        (T.clean_markdown, "**a** `b` *c*", "a b c"),
        (T.goal_of, "## Goal\n\n  win it\nmore", "win it"),
        (T.slug, "¡Hola, Señor!", "hola-senor"),
        (lambda c: T.truncate_words(c, 12), "alpha beta, gamma", "alpha..."),
        (lambda c: T.truncate_words(c, 3), "abcdef", "abc"),
    ],
)
def test_scalar(spark, column, given_, wanted):
    assert one(spark, column, given_) == wanted


@pytest.mark.parametrize("n", [399, 400, 401])
@pytest.mark.parametrize("tail", ["", "é", "日", "😀"])
def test_truncation_is_exact_in_bytes(spark, n, tail):
    x = "a" * (384 - 2) + tail + "b" * 300
    x = x[: max(1, n)]
    got = one(spark, lambda c: T.truncate_bytes_marked(c, 400), x)
    raw = x.encode()
    want = x if len(raw) <= 400 else raw[: 400 - len(T.MARKER)].decode(errors="ignore") + T.MARKER
    assert got == want


@pytest.mark.parametrize(("x", "wanted"), [("2024-01-02 03:04:05", "2024-01-02 03:04:05"), ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"), ("2024-01-02T03:04:05.123+02:00", "2024-01-02 01:04:05"), ("", None), ("yesterday", None)])
def test_timestamps(spark, x, wanted):
    assert one(spark, lambda c: F.date_format(T.timestamp(c), "yyyy-MM-dd HH:mm:ss"), x) == wanted


def test_review_date_is_clamped(spark):
    got = spark.sql("select timestamp'2024-08-31 10:00:00' t").select(F.date_format(T.review_after(F.lit("decision"), F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("y")).first()["y"]
    assert got == "2025-02-28 10:00:00"


@pytest.mark.parametrize(("kind", "title", "content", "key"), [("bugfix", "Fix the Crash", "", "bug/fix-the-crash"), ("manual", "It chose B", "", "decision/it-chose-b"), ("manual", "", "plain words here", "topic/plain-words-here"), ("decision", "Decision", "", "decision/general"), ("x", "a/b", "", "a/b"), ("decision", "decision-log", "", "decision/log")])
def test_suggested_keys(spark, kind, title, content, key):
    row = spark.createDataFrame([(kind, title, content)], "a string, b string, c string")
    assert row.select(T.suggest_topic_key(F.col("a"), F.col("b"), F.col("c")).alias("k")).first()["k"] == key


WORDS = ["búsqueda", "snake_case", "foo-bar", "C++", "v1.2", "straße", "ÀÉÎ", "Ωμέγα", "Ёлка", "señor", "ł", "æ"]


def test_tokens_agree_with_fts5_and_with_the_query_side(spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    for w in WORDS:
        db.execute("DELETE FROM t")
        db.execute("INSERT INTO t VALUES (?)", (w,))
        want = [r[0] for r in db.execute("SELECT term FROM v ORDER BY offset")]
        assert one(spark, T.tokens, w) == want, w
        assert bm25.word_tokens(w) == want, w


def test_stems_agree_with_fts5():
    vocabulary = "migrating migration relational conditional rational valenci digitizer operator feudalism decisiveness hopefulness formaliti sensibiliti triplicate formative electriciti hopeful goodness revival allowance inference airliner adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti effective bowdlerize probate rate cease controll roll caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky sesion busquedas sesiones generalization oscillators".split()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    db.execute("INSERT INTO t VALUES (?)", (" ".join(vocabulary),))
    want = [r[0] for r in db.execute("SELECT term FROM v ORDER BY offset")]
    assert [porter.stem(w) for w in vocabulary] == want


def test_learnings():
    text = "# T\n## Learnings\n- too short\n- this one is long enough to keep\n\n## Key learnings:\n```\n- in a fence this is not seen at all\n```\n1. **first** learning of the last section\n2) second learning of the last section\n## Next\n- not part of it, being elsewhere\n"
    assert markdown.learnings(text) == ["first learning of the last section", "second learning of the last section"]
    assert markdown.learnings("## Leçons apprises\n* une chose apprise aujourd'hui ici\n") == ["une chose apprise aujourd'hui ici"]
    assert markdown.learnings("nothing") == [] and markdown.learnings(None) == []


def test_headline():
    assert markdown.headline("# head\n---\n- short\n* a line of prose that is long\n") == "a line of prose that is long"
    assert markdown.headline("word " * 40, 30) == "word word word word word word…"
    assert markdown.headline("# only") is None


def test_verdicts_and_json():
    assert markdown.verdict('say ```json\n{"relation": "Supersedes", "confidence": 7}\n``` {"x": 1}') == {"relation": "supersedes", "confidence": 1.0, "reason": ""}
    assert markdown.verdict("none") is None and markdown.verdict('{"relation": "eats"}') is None
    assert markdown.canonical_json('{"b": {"z": 1, "a": [1, 2]}, "a": "é"}') == '{"a":"é","b":{"a":[1,2],"z":1}}'
    assert markdown.canonical_json('"{\\"k\\": 1}"') == '{"k":1}' and markdown.canonical_json("no") is None


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="aÁ b/_-\\.\n`*<>:é日", max_size=30), min_size=20, max_size=20))
def test_folding_twice_changes_nothing(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x string")
    for f in (T.project, T.scope, T.kind, T.topic_key, T.one_line, T.strip_private, lambda c: T.truncate_words(c, 10), lambda c: T.truncate_bytes_marked(c, 20)):
        once = df.select(f(F.col("x")).alias("x"))
        assert [r["x"] for r in once.collect()] == [r["y"] for r in once.select(f(F.col("x")).alias("y")).collect()]


def test_a_topic_key_works_out_its_text_once(spark):
    """The text of a note stands once in the expression, not once for each word that is looked for."""
    row = spark.createDataFrame([("manual", "Fix-bug in it", "CHOSE a Docker")], "a string, b string, c string")
    out = row.select(T.suggest_topic_key(F.col("a"), F.col("b"), F.col("c")).alias("k"))
    assert out._jdf.queryExecution().analyzed().toString().count("lower(concat_ws") == 1
    assert out.first()["k"] == "bug/fix-bug-in-it"
