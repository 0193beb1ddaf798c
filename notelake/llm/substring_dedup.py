"""Removal of passages of words that repeat, by difference-cover anchors.

Only windows at cover positions modulo a period are hashed; two places of a long match are aligned on an anchor within one period,
from which the match is extended to the full window. See cover.py for the steps.

Rows: a null text has no words. Rows equal in id and text are different documents, so all of their long enough text goes. Documents
with fewer words than a window stay whole. A very long text is a slice of its own. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from . import cover
from . import kernel as K


def _cut(batches: Iterator[pa.RecordBatch], units: cover.Units, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for piece in K.slices(batches):
        data, rows = K.buffers(piece.column("text"))
        w = K.Words(data, rows)
        gone = cover.marks(units, w.off, piece.column("role").to_numpy(zero_copy_only=False), piece.column("starts").to_pylist())
        of = K.counts_to_rows(w.off)
        stay = np.flatnonzero(~gone)
        size = w.end[stay] - w.start[stay]
        # bytes of the kept words, each followed by a space; the last of a document is cut off below
        place = np.cumsum(size + 1) - (size + 1)
        out = np.full(int((size + 1).sum()), 32, np.uint8)
        spread = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(place, size) + spread] = data[np.repeat(w.start[stay], size) + spread]
        first = np.searchsorted(of[stay], np.arange(len(rows)))
        at = np.append(place, len(out))[first]
        some = np.diff(at) > 0
        kept = K.binaries(np.delete(out, at[1:][some] - 1), at - np.concatenate(([0], np.cumsum(some))))
        total = np.concatenate(([0], np.cumsum(gone, dtype=np.int64)))
        arrays = [piece.column("id"), pa.array(np.diff(w.off)), pa.array(total[w.off[1:]] - total[w.off[:-1]]), kept]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def remove_passages(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (binary: UTF-8 of the kept words joined by one space). The cover has
    period 13 and 4 members, so anchors are length - 12 words long and 4 of 13 windows are hashed."""
    units = cover.Units(length, 0, words=True, ranges=1)
    if units.anchor < 2:
        raise ValueError("windows must be longer than the period of the cover, 13 words")
    found = cover.repeated(docs, units, "passages", id_col, text_col)
    kind = found.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])
    return found.mapInArrow(lambda b: _cut(b, units, schema), f"id {kind.simpleString()}, n_words long, n_removed long, kept binary")
