"""Removal of repeated byte strings by difference-cover anchors and windows that are told apart by fingerprints.

It departs from a full sort of suffixes, see the README. The sample of suffixes at difference-cover positions is grouped by hashes of long prefixes:
two places with the same 400 bytes have sampled neighbours in one class at the same distance. Windows without such a neighbour
are alone and go no further; in ordinary text these are most. The others are dealt by a hash of what they begin with, one range of hashes at a time, so that the
keys of one range only are held at once, and those with equal 96-bit fingerprints of their 400 bytes, made from the same prefix
sums as the classes of the sample, begin a repeated string. Nothing is ranked and no order of suffixes is made. See cover.py for the steps.

Rows: a null text is empty: nothing is removed. Rows equal in id and text are different documents, so all of their long
enough text goes. Texts shorter than the length stay whole. A very long text is a slice of its own. Empty table: no rows.
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
        data, off = K.buffers(piece.column("text"))
        gone = cover.marks(units, off, piece.column("role").to_numpy(zero_copy_only=False), piece.column("starts").to_pylist())
        total = np.concatenate(([0], np.cumsum(gone, dtype=np.int64)))
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = off[(off > 0) & (off < len(data))]
        begins[inner] = gone[inner]
        n_begins = np.concatenate(([0], np.cumsum(begins, dtype=np.int64)))
        kept = K.binaries(data[~gone], off - total[off])
        first = np.flatnonzero(begins)
        ends = gone.copy()
        ends[:-1] &= ~gone[1:]
        ends[inner - 1] = gone[inner - 1]
        last = np.flatnonzero(ends) + 1
        b, e = n_begins[off[:-1]], n_begins[off[1:]]
        spans = [np.stack((first[x:y] - o, last[x:y] - o), 1).tolist() for x, y, o in zip(b.tolist(), e.tolist(), off[:-1].tolist())]
        arrays = [piece.column("id"), pa.array(np.diff(off)), pa.array(total[off[1:]] - total[off[:-1]]), pa.array(e - b), kept, pa.array(spans, pa.list_(pa.list_(pa.int64())))]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def remove_repeats(docs: DataFrame, length: int = 400, cover_order: int = 2, ranges: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept (binary: what is left), spans (removed runs, end exclusive).

    cover_order: order of the Colbourn-Ling cover, period 24r^2 + 36r + 13, which must be under `length`; ranges: how many
    ranges of windows are compared one after another.
    """
    units = cover.Units(length, cover_order, words=False, ranges=ranges)
    if units.anchor < 8:
        raise ValueError("the period of the cover must leave anchors of 8 bytes")
    found = cover.repeated(docs, units, "suffix", id_col, text_col)
    kind = found.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.list_(pa.int64())))])
    ddl = f"id {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<array<long>>"
    return found.mapInArrow(lambda b: _cut(b, units, schema), ddl)
