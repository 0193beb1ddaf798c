"""Phrases against brute force over lists of words, suffix orders against sorting, scores against Python's integers."""

import collections
import random
import re

import numpy as np
import pytest

from notelake.llm import collocation as C

SCHEMA = "doc_id long, text string, lang string, phrase string, k int, `A` string"
SEP, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest, least, top):
    n, f = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        for piece in SEP.split((text or "").translate(LOWER)):
            ws = WORD.findall(piece)
            n[lang or "und"] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang or "und", tuple(ws[i : i + k])] += 1
    cand = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    inside = {((lang, w[i : i + m]), a) for (lang, w), a in cand.items() for m in range(2, len(w)) for i in range(len(w) - m + 1)}
    out = collections.defaultdict(list)
    for (lang, w), a in cand.items():
        if ((lang, w), a) in inside:
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:q]] * f[lang, w[q:]]), q, f[lang, w[:q]], f[lang, w[q:]]) for q in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, xs in out.items() for i, (s, a, p, left, right) in enumerate(sorted(xs)[:top])]


def texts(seed, n=120):
    rng = random.Random(seed)
    words = ["Ab", "ab", "c", "dé", "e'e", "f-g", " h", "DÉ", "zz", "y"]
    rows = []
    for i in range(n):
        out = []
        for _ in range(rng.randint(0, 60)):
            out.append(rng.choice(["New York City hall", "in the end", rng.choice(words), rng.choice(words), f"rare{rng.randrange(900)}"]))
            out.append(rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]))
        rows.append((i, "".join(out), rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows + [(None, None, "en"), (1, "", None), rows[0], rows[0], (2, " \t ", "xx"), (3, "new york city hall " * 3000, "en"), (4, "q" * 50_000, "de")]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], SCHEMA).repartition(5)
    got = C.collocations(df, **kw)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize(("longest", "least", "top", "shard"), [(5, 5, 2000, C.SHARD_BYTES), (5, 3, 40, 700), (2, 20, 5, 50), (3, 1, 2000, 4096)])
def test_phrases_equal_brute_force(spark, longest, least, top, shard):
    rows = texts(longest)
    assert run(spark, rows, longest=longest, least=least, top=top, shard_bytes=shard) == sorted(brute(rows, longest, least, top))


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    rows = texts(9, 60)
    monkeypatch.setattr(C, "_bitmap", lambda rows, index, size: b"\xff" * (1 << (size - 3)))
    assert run(spark, rows, least=4) == sorted(brute(rows, 5, 4, 2000))


def test_no_texts(spark):
    assert not run(spark, [])


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(4)
    for depth in (2, 3, 5, 8):
        ids = rng.integers(0, 3, 400)
        ends = np.unique(np.r_[rng.integers(0, 400, 60), 399])
        left = np.repeat(ends, np.diff(np.r_[-1, ends])) - np.arange(400) + 1
        order = C.suffix_order(ids, left, depth)
        said = [tuple(ids[i : i + min(depth, left[i])]) for i in order]
        assert said == sorted(said)
        common = C.common_prefixes(ids, left, order, depth)
        for j, n in enumerate(common):
            assert n == next((t for t, (x, y) in enumerate(zip(said[j], said[j + 1])) if x != y), min(len(said[j]), len(said[j + 1])))


def test_parts_overlap_by_the_words_that_a_phrase_reaches():
    text = ("ab cde, f " * 500).encode()
    got = list(C.parts(text, 97, 5))
    assert b"".join(t[:own] for t, own in got) == text and len(got) > 40
    assert list(C.parts(b"x" * 1000, 10, 5)) == [(b"x" * 1000, 1000)]


def test_scores_pass_64_bits(spark):
    rng = random.Random(3)
    rows = [(a, a * rng.randint(1, 10**4), a * rng.randint(1, 50), a * rng.randint(1, 50)) for a in (rng.randint(1, 10**12) for _ in range(200))]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select("a", "n", "l", "r", C.cut_score("a", "n", "l", "r").alias("s")).collect()
    assert all(x.s == 1000 * x.a * x.n // (x.l * x.r) for x in got)
