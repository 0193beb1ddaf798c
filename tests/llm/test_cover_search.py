"""Exact search against brute force with Python's integers; the tree's invariants."""

import collections
import math
import random

import numpy as np
import pytest

from notelake.llm import cover_search as S

SCHEMA = "vec_id long, embedding array<double>, label int, uid string, raw string, `dim` int"


def brute(rows, k, every):
    ok = [(i, v[0], [math.floor(1024 * x) for x in v[1]]) for i, v in enumerate(rows) if v[0] is not None and v[1] is not None and all(x is not None and math.isfinite(1024 * x) for x in v[1])]
    clamp = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = collections.Counter()
    for i, q, a in ok:
        if q % every == 0:
            scored = sorted((-clamp(sum(x * y for x, y in zip(a, b))), v) for j, v, b in ok if j != i and len(b) == len(a))
            out.update((q, n + 1, v, -s) for n, (s, v) in enumerate(scored[:k]))
    return out


def vectors(seed, n=700, d=8):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]) for i in range(n)]
    rows += [(n + i, rows[5][1]) for i in range(60)]  # one vector often, with and without queries among them
    rows += [(n + 60 + i, [rng.randint(-1, 1) / 1024 for _ in range(d)]) for i in range(150)]  # many ties
    rows += [(2000, None), (2100, []), (2105, []), (2200, [None] * d), (2300, [float("nan")] * d), (2400, [float("inf")] + [0.0] * (d - 1)), (None, rows[0][1]), (0, rows[3][1]), (0, rows[0][1]), rows[7], (-100, rows[9][1])]
    rows += [(2500, [0.0] * d), (2600, [1.0, 2.0]), (2601, [0.5, -3.0]), (2700, [1e12] * d), (2701, [-1e12] * d), (2702, [1e200] * d), (2800, [1e306] * d)]
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "clash", "clash", 9) for r in rows], SCHEMA).repartition(4)
    got = S.top_k(df, **kw)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return collections.Counter(map(tuple, got.collect()))


@pytest.mark.parametrize(("k", "every", "block"), [(10, 100, None), (3, 7, 40), (1, 1, 25)])
def test_search_equals_brute_force(spark, k, every, block):
    rows = vectors(k)
    assert run(spark, rows, k=k, every=every, block=block) == brute(rows, k, every)


def test_lengths_that_the_sample_lacks(spark, monkeypatch):
    monkeypatch.setattr(S, "SAMPLE", 1)
    rows = vectors(8, 120)
    assert run(spark, rows, every=10) == brute(rows, 10, 10)


def test_no_vectors(spark):
    assert not run(spark, [])
    assert not run(spark, [(100, [1.0, 2.0])])


def test_cover_tree_covers_separates_and_nests():
    x = np.floor(np.random.default_rng(2).standard_normal((3000, 5)) * 1024)
    t = S.Tree(x, fan=8, leaf=16)
    assert sorted(np.concatenate([t.members[i] for i in range(len(t.kids)) if not t.kids[i]]).tolist()) == list(range(3000))
    for i, kids in enumerate(t.kids):
        assert np.sqrt(((x[t.members[i]] - x[t.centre[i]]) ** 2).sum(1)).max() <= t.radius[i] + 1e-9
        if kids:
            centres = [t.centre[c] for c in kids]
            assert t.centre[i] in centres
            covered = max(t.radius[c] for c in kids)
            apart = min(np.sqrt(((x[a] - x[b]) ** 2).sum()) for a in centres for b in centres if a != b)
            assert apart >= covered - 1e-9


def test_pruning_leaves_pairs_out(monkeypatch):
    rng = np.random.default_rng(5)
    x = np.floor((rng.standard_normal((20, 16))[rng.integers(0, 20, 4000)] + rng.standard_normal((4000, 16)) * 0.02) * 1024)
    met = 0
    real = S.products

    def counted(q, y):
        nonlocal met
        met += len(q) * len(y)
        return real(q, y)

    monkeypatch.setattr(S, "products", counted)
    q = x[:200]
    score, ids, uids = S.search(S.Tree(x), np.arange(4000), np.arange(4000), q, np.arange(200), np.full(200, -np.inf), 10)
    want = q @ x.T
    want[np.arange(200), np.arange(200)] = -np.inf
    assert (np.sort(want, 1)[:, ::-1][:, :10] == score).all()
    assert met < 200 * 4000 / 2
