"""Difference covers and the search for repeated windows that rests on them.

A set D of residues modulo v is a difference cover if every difference modulo v is one of two of its members. For two
places i and j of equal text there is then a shift below v after which both lie on cover positions. So if a window of L units occurs
twice, the two occurrences hold an equal anchor: a window of L - v + 1 units that begins at cover positions of both.

The search works on documents of units (bytes or words) in four steps, each a bounded amount of memory a task:
 1. anchors: only windows at cover positions are hashed and dealt out by hash. Each part sorts its anchors; a document gets
    back those that occur twice or more anywhere. Documents that are equal as a whole are found the same way.
 2. the documents meet their anchors (one shuffle of the texts) and are written down with them.
 3. extension: every window of L units that holds a repeated anchor is fingerprinted (96 bits) and dealt out by fingerprint, a
    range of suffixes at a time; windows found twice are repeated. No other window can be, by the cover property.
 4. documents get their repeated windows back; covered units are marked.
A hash that is in a third of all documents meets in one part once a slice of texts, a few bytes each, not once a document pair: nothing
is paired, so work is linear in the input however large the groups of copies are. Of equal documents only the first is extended, as the
windows of one stand for those of all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import Workspace, keyed, parts_for

U = np.uint64


def colbourn_ling(r: int) -> tuple[int, np.ndarray]:
    """A difference cover of the period 24r^2 + 36r + 13 with 6r + 4 members, from its known pattern of gaps."""
    gaps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.concatenate(([0], np.cumsum(gaps)))


@dataclass(frozen=True)
class Units:
    """What a window is made of. codes: of each unit, from a hash base; rows: offsets of the documents in units."""

    length: int
    cover: int
    words: bool
    ranges: int

    @property
    def period(self) -> int:
        return colbourn_ling(self.cover)[0]

    @property
    def slice_bytes(self) -> int:
        """Text that is worked on at once: of bytes, each is a unit, with some hundred bytes of sums, hashes and places."""
        return K.SLICE_BYTES if self.words else K.SLICE_BYTES // 4

    @property
    def anchor(self) -> int:
        return self.length - self.period + 1

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Callable[[K.Base], np.ndarray]]:
        """Buffer, offsets of the documents in units, and the unit codes under a hash base."""
        data, rows = K.buffers(texts)
        if not self.words:
            return data, rows, lambda base: base.codes[data]
        w = K.Words(data, rows)
        return data, w.off, lambda base: w.hashes(data, base)


def _deal(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> U(40)) * U(parts) >> U(24)).astype(np.int64)


#: Kinds of what a slice sends: keys to compare, whole documents to compare, values and copies it is already sure of.
ASK, WHOLE, SURE, COPY, LEAD = range(5)
_SENT = "part int, kind int, h binary, g binary, at binary, doc binary, k1 binary, k2 binary"
_SENT_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("h", "g", "at", "doc", "k1", "k2"))])


def _packed(part: int, kind: int, h: np.ndarray, g: np.ndarray, at: np.ndarray, doc: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> dict:
    """Keys, second keys, places and documents as packed arrays, and the names of those documents."""
    there, local = np.unique(doc, return_inverse=True)
    return {"part": part, "kind": kind, "h": h.tobytes(), "g": g.tobytes(), "at": at.tobytes(), "doc": local.astype(np.uint16).tobytes(), "k1": k1[there].tobytes(), "k2": k2[there].tobytes()}


def _ask(kind: int, h: np.ndarray, g: np.ndarray, at: np.ndarray, doc: np.ndarray, k1: np.ndarray, k2: np.ndarray, parts: int) -> Iterator[dict]:
    """One row a part; sorted by h already."""
    part = _deal(h, parts)
    cut = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(h)]):
        yield _packed(int(part[a]), kind, h[a:b], g[a:b], at[a:b], doc[a:b], k1, k2)


def _tell(kind: int, values: np.ndarray, doc: np.ndarray, k1: np.ndarray, k2: np.ndarray, parts: int) -> dict:
    """What a slice is sure of goes to any part, which passes it on."""
    none = np.zeros(0, np.uint32)
    return _packed(int((int(k1[doc[0]]) ^ int(k2[doc[0]])) % parts), kind, values, none, none, doc, k1, k2)


def _twice(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order of the keys and, in that order, whether a key is the first of its kind and whether it has an equal."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    n = len(order)
    same = np.ones(max(n - 1, 0), bool)
    for k in keys:
        s = k[order]
        same &= s[1:] == s[:-1]
    first, twice = np.ones(n, bool), np.zeros(n, bool)
    first[1:] = ~same
    twice[1:] |= same
    twice[:-1] |= same
    return order, first, twice


def _keys(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return piece.column("k1").to_numpy(zero_copy_only=False), piece.column("k2").to_numpy(zero_copy_only=False)


def _anchors(units: Units, piece_codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, rows and hashes of the anchors of documents that hold a full window: laid out period by period, so that
    places off the cover cost nothing."""
    v, cover = colbourn_ling(units.cover)
    size = np.diff(off)
    limit = np.where(size >= units.length, size - units.anchor + 1, 0)
    periods = -(-limit // v)
    row = np.repeat(np.arange(len(size)), periods)
    begin = v * (np.arange(len(row)) - np.repeat(np.cumsum(periods) - periods, periods))
    inside = begin[:, None] + cover
    on = inside < limit[row][:, None]
    at = (inside + off[row][:, None])[on]
    row = np.repeat(row, on.sum(1))
    prefix = K.FIRST.prefix(piece_codes)
    return at, row, K.FIRST.spans(prefix, at, at + units.anchor)


def _send_anchors(batches: Iterator[pa.RecordBatch], units: Units, parts: int) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, np.uint32)
    for piece in K.slices(batches, limit=units.slice_bytes):
        k1, k2 = _keys(piece)
        _, off, codes = units.read(piece.column("text"))
        first = codes(K.FIRST)
        _, row, h = _anchors(units, first, off)
        out = []
        if len(h):  # a key goes out once a slice; if it is in it twice, that is known here
            order, new, twice = _twice(h)
            out += _ask(ASK, h[order[new]], none, none, row[order[new]], k1, k2, parts)
            if twice.any():
                out.append(_tell(SURE, h[order[twice]], row[order[twice]], k1, k2, parts))
        full = np.flatnonzero(np.diff(off) >= units.length)
        if len(full):
            full = full[np.lexsort((k2[full], k1[full]))]
            h, g = (b.spans(b.prefix(c), off[full], off[full + 1]) for b, c in ((K.FIRST, first), (K.SECOND, codes(K.SECOND))))
            order, new, twice = _twice(h, g)  # stable: of equals the least key is first
            out += _ask(WHOLE, h[order[new]], g[order[new]], none, full[order[new]], k1, k2, parts)
            for kind, which in ((LEAD, new & twice), (COPY, ~new)):
                if which.any():
                    at = order[which]
                    group = np.cumsum(new)[which]
                    lead = order[new][group - 1]
                    equal = (k1[full[at]] == k1[full[lead]]) & (k2[full[at]] == k2[full[lead]])  # repeated rows are one document
                    at = at if kind == LEAD else at[~equal]
                    if len(at):
                        out.append(_tell(kind, h[at], full[at], k1, k2, parts))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_SENT_ARROW)


class _Gathered:
    """The packed arrays of the rows of a part that are of one kind; doc numbers run through k1 and k2."""

    def __init__(self, rows: list[dict], kind: int, g: type, at: type = np.uint32):
        rows = [r for r in rows if r["kind"] == kind]
        cat = lambda c, t: np.frombuffer(b"".join(r[c] for r in rows), t)
        sizes = np.array([len(r["k1"]) // 8 for r in rows], np.int64)
        each = np.array([len(r["doc"]) // 2 for r in rows], np.int64)
        self.doc = cat("doc", np.uint16).astype(np.int64) + np.repeat(np.cumsum(sizes) - sizes, each)
        self.h, self.g, self.at, self.k1, self.k2 = cat("h", np.uint64), cat("g", g), cat("at", at), cat("k1", np.int64), cat("k2", np.int64)


_GOT = "k1 long, k2 long, role int, found binary"
_GOT_ARROW = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("role", pa.int32()), ("found", pa.binary())])


def _answers(doc: np.ndarray, values: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> pa.Table:
    """One row a document with its values packed. A document may get several rows; they are joined later."""
    order = np.argsort(doc, kind="stable")
    doc, values = doc[order], np.ascontiguousarray(values[order])
    cut = np.flatnonzero(np.diff(doc)) + 1
    begin = np.concatenate(([0], cut))
    found = K.binaries(values.view(np.uint8), np.append(begin, len(doc)) * values.itemsize)
    d = doc[begin]
    return pa.Table.from_arrays([pa.array(k1[d]), pa.array(k2[d]), pa.array(np.zeros(len(d), np.int32)), found], schema=_GOT_ARROW)


def _roles(a: np.ndarray, b: np.ndarray, role: np.ndarray) -> pa.Table:
    return pa.Table.from_arrays([pa.array(a), pa.array(b), pa.array(role.astype(np.int32)), pa.array([None] * len(a), pa.binary())], schema=_GOT_ARROW)


def _match_anchors(t: pa.Table) -> pa.Table:
    rows, out = t.to_pylist(), []
    x = _Gathered(rows, ASK, np.uint32)
    if len(x.h):
        order, _, twice = _twice(x.h)
        at = order[twice]
        if len(at):
            out.append(_answers(x.doc[at], x.h[at], x.k1, x.k2))
    x = _Gathered(rows, SURE, np.uint32)
    if len(x.h):
        out.append(_answers(x.doc, x.h, x.k1, x.k2))
    for kind, role in ((LEAD, 1), (COPY, 2)):
        x = _Gathered(rows, kind, np.uint32)
        if len(x.h):
            out.append(_roles(x.k1[x.doc], x.k2[x.doc], np.full(len(x.doc), role)))
    x = _Gathered(rows, WHOLE, np.uint64)
    if len(x.h):
        a, b = x.k1[x.doc], x.k2[x.doc]
        order = np.lexsort((b, a, x.g, x.h))
        h, g, a, b = x.h[order], x.g[order], a[order], b[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        group = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        leads = (a == a[begin][group]) & (b == b[begin][group])
        some = np.bincount(group)[group] > 1
        if some.any():
            out.append(_roles(a[some], b[some], np.where(leads, 1, 2)[some]))
    K.trim()
    return pa.concat_tables(out) if out else _GOT_ARROW.empty_table()


def _candidates(units: Units, codes: np.ndarray, off: np.ndarray, lists: list[list[bytes]]) -> np.ndarray:
    """Starts of the windows that hold a repeated anchor."""
    found = [b"".join(x) for x in lists]
    at, row, h = _anchors(units, codes, off)
    known = np.frombuffer(b"".join(found), np.uint64)
    if not len(known) or not len(at):
        return np.zeros(0, np.int64)
    per = np.array([len(x) // 8 for x in found])
    known_row = np.repeat(np.arange(len(found)), per)
    seen = np.isin(h ^ K.mix(row.astype(np.uint64)), known ^ K.mix(known_row.astype(np.uint64)))
    at = at[seen]
    n = int(off[-1])
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, np.maximum(at - (units.period - 1), off[row[seen]]), 1)
    np.add.at(d, at + 1, -1)
    near = np.cumsum(d[:-1]) > 0
    starts = K.window_starts(off, units.length)
    return starts[near[starts]]


def _send_windows(batches: Iterator[pa.RecordBatch], units: Units, parts: int, which: int) -> Iterator[pa.RecordBatch]:
    for piece in K.slices(batches, limit=units.slice_bytes):
        k1, k2 = _keys(piece)
        _, off, codes = units.read(piece.column("text"))
        first = codes(K.FIRST)
        starts = _candidates(units, first, off, piece.column("found").to_pylist())
        if not len(starts):
            continue
        prefix = K.FIRST.prefix(first)
        h = K.FIRST.spans(prefix, starts, starts + units.length)
        if units.ranges > 1:  # the range of suffixes by what they begin with
            head = K.FIRST.spans(prefix, starts, starts + 8)
            mine = _deal(head, units.ranges) == which
            starts, h = starts[mine], h[mine]
        if not len(starts):
            continue
        g = (K.SECOND.spans(K.SECOND.prefix(codes(K.SECOND)), starts, starts + units.length) >> U(32)).astype(np.uint32)
        row = np.searchsorted(off, starts, "right") - 1
        place = (starts - off[row]).astype(np.uint32)
        order, new, twice = _twice(h, g)
        at = order[new]
        out = list(_ask(ASK, h[at], g[at], place[at], row[at], k1, k2, parts))
        if twice.any():
            at = order[twice]
            out.append(_tell(SURE, place[at], row[at], k1, k2, parts))
        yield pa.RecordBatch.from_pylist(out, schema=_SENT_ARROW)


def _match_windows(t: pa.Table) -> pa.Table:
    rows, out = t.to_pylist(), []
    x = _Gathered(rows, ASK, np.uint32)
    if len(x.h):
        order, _, twice = _twice(x.h, x.g)
        at = order[twice]
        if len(at):
            out.append(_answers(x.doc[at], x.at[at], x.k1, x.k2))
    for r in rows:
        if r["kind"] == SURE:
            places, doc = np.frombuffer(r["h"], np.uint32), np.frombuffer(r["doc"], np.uint16).astype(np.int64)
            out.append(_answers(doc, places, np.frombuffer(r["k1"], np.int64), np.frombuffer(r["k2"], np.int64)))
    K.trim()
    return pa.concat_tables(out) if out else _GOT_ARROW.empty_table()


def repeated(docs: DataFrame, units: Units, name: str, id_col: str, text_col: str) -> DataFrame:
    """(id, text, role, starts): role 0: windows found twice begin at the packed uint32 unit places `starts`;
    role 1 or 2: an equal document exists and every unit of it is covered; null text comes as empty."""
    spark = docs.sparkSession
    ws = Workspace(spark, name)
    rows = keyed(docs, id_col, text_col)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    share = len(colbourn_ling(units.cover)[1]) / units.period / (6 if units.words else 1)
    parts = parts_for(int(total * share), 1 << 20, 48)
    sent = rows.select("k1", "k2", "text").mapInArrow(lambda b: _send_anchors(b, units, parts), _SENT)
    got = ws.table(sent.groupBy("part").applyInArrow(_match_anchors, _GOT), "anchors")
    mine = got.groupBy("k1", "k2").agg(F.max("role").alias("role"), F.collect_list("found").alias("found"))
    held = ws.table(rows.join(mine, ["k1", "k2"], "left"), "held")
    ws.drop(got)
    marked = held.where((F.size("found") > 0) & (F.col("role") < 2)).select("k1", "k2", "text", "found")
    windows = []
    more = parts_for(total // 6 // units.ranges // (6 if units.words else 1), 1 << 20, 48)
    for which in range(units.ranges):  # one range of suffixes at a time, so that only its keys are on disk
        sent = marked.mapInArrow(lambda b, w=which: _send_windows(b, units, more, w), _SENT)
        windows.append(ws.table(sent.groupBy("part").applyInArrow(_match_windows, _GOT).select("k1", "k2", "found"), f"windows{which}"))
    every = windows[0]
    for w in windows[1:]:
        every = every.unionByName(w)
    starts = ws.table(every.groupBy("k1", "k2").agg(F.collect_list("found").alias("starts")), "starts")
    ws.drop(*windows)
    clean = F.col("role").isNull() | (F.col("role") > 0)
    alone = held.where(clean).select("id", "text", F.coalesce("role", F.lit(0)).alias("role"), F.array().cast("array<binary>").alias("starts"))
    rest = held.where(~clean).join(starts, ["k1", "k2"], "left").select("id", "text", "role", F.coalesce("starts", F.array().cast("array<binary>")).alias("starts"))
    return alone.unionByName(rest)


def marks(units: Units, off: np.ndarray, role: np.ndarray, starts: list[list[bytes]]) -> np.ndarray:
    """Which units of a slice are covered."""
    n = int(off[-1])
    places = [np.frombuffer(b"".join(s), np.uint32).astype(np.int64) + off[i] for i, s in enumerate(starts) if s]
    out = K.covered(n, np.concatenate(places), units.length) if places else np.zeros(n, bool)
    return out | (role > 0)[K.counts_to_rows(off)] if n else out
