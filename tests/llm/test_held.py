"""A Python worker is used for many tasks, so what a step has sent on must not stay in it."""

import gc
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from notelake.llm import cover, kernel, packing, substring_dedup, suffix_dedup

SOME = [b"", b"ab", b"", "é c".encode(), b"defg", b""]


def views():
    gc.collect()
    return sum(type(o) is memoryview for o in gc.get_objects())


def test_binaries_are_the_runs():
    off = np.concatenate(([0], np.cumsum([len(x) for x in SOME])))
    assert kernel.binaries(np.frombuffer(b"".join(SOME), np.uint8), off).to_pylist() == SOME
    assert kernel.binaries(np.zeros(0, np.uint8), np.zeros(1, np.int64)).to_pylist() == []


@pytest.mark.parametrize("kind", [np.uint32, np.uint64])
def test_answers_hold_nothing(kind):
    rng = random.Random(3)
    doc = np.array([rng.randrange(300) for _ in range(2000)])
    values = np.array([rng.randrange(2**31) for _ in doc]).astype(kind)
    key = np.arange(300)
    before = views()
    got = cover._answers(doc, values, key, -key).to_pylist()
    assert views() == before
    assert [r["k1"] for r in got] == sorted(set(doc.tolist())) and all(r["k2"] == -r["k1"] for r in got)
    assert all(np.array_equal(np.frombuffer(r["found"], kind), values[doc == r["k1"]]) for r in got)


def pieces(texts, starts):
    cols = {"id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts), "role": pa.array([0] * len(texts), pa.int32())}
    return pa.RecordBatch.from_pydict(cols | {"starts": pa.array([[np.array(s, np.uint32).tobytes()] if s else [] for s in starts], pa.list_(pa.binary()))})


@pytest.mark.parametrize("words", [False, True])
def test_cut_texts_hold_nothing(words):
    rng = random.Random(4)
    texts, starts = ["", " \n", None], [[], [], []]
    for _ in range(200):
        texts.append(" ".join(rng.choices(["a", "bé", "c,d", "efg"], k=rng.randint(1, 40))))
        n = len(texts[-1].split(" ")) if words else len(texts[-1].encode())
        starts.append([i for i in range(n - 2) if rng.random() < 0.2])
    texts += ["x y z", "", "x y z"]
    starts += [[0], [], []]  # all is removed; nothing is
    units = cover.Units(3, 0, words=words, ranges=1)
    module, counts = (substring_dedup, ("n_words", "n_removed")) if words else (suffix_dedup, ("n_bytes", "n_removed", "n_spans"))
    schema = pa.schema([("id", pa.int64()), *((c, pa.int64()) for c in counts), ("kept", pa.binary()), *([] if words else [("spans", pa.list_(pa.list_(pa.int64())))])])
    batch, before = pieces(texts, starts), views()
    rows = [r for b in module._cut(iter([batch]), units, schema) for r in b.to_pylist()]
    assert views() == before
    for r, text, at in zip(rows, texts, starts, strict=True):
        all_units = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")] if words else [bytes([x]) for x in (text or "").encode()]
        stay = [x for i, x in enumerate(all_units) if not any(s <= i < s + 3 for s in at)]
        assert r["kept"] == (b" " if words else b"").join(stay) and r["n_removed"] == len(all_units) - len(stay)


def test_packed_pieces_hold_nothing(monkeypatch):
    class Tokenizer:
        """A code point a token."""

        def encode(self, texts, end):
            ids = [[*map(ord, t or ""), end] for t in texts.to_pylist()]
            return np.concatenate([np.array(x, np.int64) for x in ids]), np.concatenate(([0], np.cumsum([len(x) for x in ids])))

    class Task:
        partitionId = staticmethod(lambda: 1)

    monkeypatch.setattr(packing.WordTokenizer, "load", lambda path: Tokenizer())
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: Task)
    rng = random.Random(5)
    texts = ["", None, *("".join(rng.choices("aé語", k=rng.randint(1, 3000))) for _ in range(120))]
    kinds = [("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), *((c, pa.int64()) for c in ("doc_tokens", "sequence_id", "offset", "step_group"))]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    before = views()
    rows = [r for b in packing._pack(iter([batch]), "", 2, 4096, 256, 50_000, 1 << 19, pa.schema(kinds)) for r in b.to_pylist()]
    assert views() == before
    rows.sort(key=lambda r: (r["id"], r["start"]))
    for i, t in enumerate(texts):
        mine = [r for r in rows if r["id"] == i]
        assert all(len(r["ids"]) == 4 * r["length"] for r in mine)
        assert np.frombuffer(b"".join(r["ids"] for r in mine), "<u4").tolist() == [*map(ord, t or ""), 2]
