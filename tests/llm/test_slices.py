"""Texts are worked on in pieces small enough for six tasks on one machine's Python memory."""

import numpy as np
import pyarrow as pa

from notelake.llm import cover, quality


def batch(n=400, size=5000):
    texts = [("word%d " % i * size)[:size] for i in range(n)]
    return texts, {"text": pa.array(texts), "k1": pa.array(range(n), pa.int64()), "k2": pa.array(range(n), pa.int64())}


def test_counts_work_on_small_pieces(monkeypatch):
    texts, cols = batch()
    whole, sizes, real = quality.count(pa.array(texts)), [], quality.count
    monkeypatch.setattr(quality, "count", lambda t: sizes.append(pa.compute.sum(pa.compute.binary_length(t)).as_py()) or real(t))
    out = pa.Table.from_batches(quality._counted(iter([pa.RecordBatch.from_pydict({"row": cols["k1"], "text": cols["text"]})])))
    assert sum(sizes) == 400 * 5000 and max(sizes) <= 1 << 17
    for c in quality.COUNTS:
        assert np.array_equal(out.column(f"{quality.PREFIX}{c}").to_numpy(), whole[c])


def test_anchors_of_bytes_work_on_small_pieces(monkeypatch):
    _, cols = batch()
    sizes, real = [], cover.Units.read
    monkeypatch.setattr(cover.Units, "read", lambda self, t: sizes.append(pa.compute.sum(pa.compute.binary_length(t)).as_py()) or real(self, t))
    list(cover._send_anchors(iter([pa.RecordBatch.from_pydict(cols)]), cover.Units(400, 2, words=False, ranges=2), 4))
    assert sum(sizes) == 400 * 5000 and max(sizes) <= 1 << 18
