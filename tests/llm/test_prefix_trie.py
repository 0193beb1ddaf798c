"""The trie against brute force over dictionaries of prefixes."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from notelake.llm import prefix_trie
from notelake.llm.common import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, c string, pos int, dg string, `id` int"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sha(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def ordered(rows):
    """Turns of each conversation as (role, text)."""
    out = collections.defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            out[c].append((t is not None, t or 0, sha(role or "", text or ""), role or "", text or ""))
    return {c: [x[3:] for x in sorted(v)] for c, v in out.items()}


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 4, convs.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])
        out[c] = base[:h] + own[h:]
    return out


def brute(convs):
    if not convs:
        return collections.Counter()
    members, kids = collections.defaultdict(list), collections.defaultdict(set)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
            if d:
                kids[tuple(ts[: d - 1])].add(tuple(ts[:d]))
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids[p]
        leaves[p] = sum(leaves[x] for x in below) if below else 1
        saved[p] = (len(members[p]) - 1) * (len(WORD.findall(p[-1][1])) if p else 0) + sum(saved[x] for x in below)
    rows = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        rows.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return collections.Counter(rows)


def conversations(seed, n=130):
    rng = random.Random(seed)
    says = [f"says {i} " * rng.randint(1, 4) for i in range(5)]
    rows = []
    for c in range(n):
        if c % 23 == 7:
            continue
        kind = rng.random()
        length = rng.choice([1, 2, 3, 5, 9])
        for t in range(length):
            text = says[rng.randrange(2 if t < 3 else 5)] if kind < 0.7 else f"own {c} {t}"
            rows.append((c, t, rng.choice(["user", "assistant"]) if kind < 0.3 else "user", text))
    for c in range(200, 260):  # copies, and a common beginning of thirty turns that parts late
        rows += [(c, t, "user", f"common {t}") for t in range(30)] + [(c, 30 + t, "user", f"late {c % 3} {t}") for t in range(c % 2 * 3)]
    rows += [(300, None, "user", "first"), (300, 5, None, None), (300, 5, "user", "tied"), (300, 5, "user", "tied"), (301, 1, "user", ""), (None, 1, "user", "nobody"), (-41, 0, "user", says[0]), (-40, 0, "user", "x y"), (302, 0, "user", "w " * 100_000)]
    return [(*r, "clash", 7, "clash", 9) for r in rows]


def run(spark, rows, again=True, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    ws = Workspace(spark, "trie-test")
    turns = prefix_trie.turns(df, ws)
    got = prefix_trie.trie(prefix_trie.rebuilt(turns, ws) if again else turns, ws, **kw)
    assert got.columns == NAMES
    return collections.Counter(map(tuple, got.collect()))


@pytest.mark.parametrize("local", [1, 60, prefix_trie.LOCAL])
def test_trie_equals_brute_force(spark, local):
    rows = conversations(3)
    assert run(spark, rows, local=local) == brute(rebuild(ordered(rows)))


def test_trie_without_rebuilding_and_with_small_slices(spark, monkeypatch):
    rows = conversations(5, 40)
    monkeypatch.setattr(prefix_trie, "SLICE", 8)
    assert run(spark, rows, again=False, local=40) == brute(ordered(rows))


def test_no_conversations(spark):
    assert not run(spark, [])


def test_bucket_nodes_of_a_deep_path():
    s = {"d": 0, "plow": None, "ids": list(range(5000)), "ws": [1] * 5000, "n": 3, "low": 4, "tails": 1, "sha": None, "k1": 1, "k2": 2}
    nodes, leaves, saved = prefix_trie.bucket_nodes([s])
    assert (len(nodes), leaves, saved) == (5001, 1, 10_000)
