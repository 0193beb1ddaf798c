"""Near-duplicate embeddings by random-hyperplane sign hashing, exact cosines and connected components.

Equal vectors of a label are one class with a count; only one of each class goes on. A table key is the signs of a vector against
BITS random hyperplanes; two vectors at the threshold agree on one sign with probability 1 - arccos(threshold) / pi. BITS follows the logarithm
of the largest label, so that chance meetings stay few at any size, and the number of tables follows from BITS and the wanted chance
`miss` of missing a pair at the threshold. Keys that stand alone are dropped before vectors are shipped. A bucket is compared by a
matrix product in double precision. Large buckets are split into blocks whose pairs go to different tasks. A pair counts in the first table
in which it meets, so degrees add up without the pairs being listed; links leave a bucket as trees.

Rows: a vector that is null, empty, zero, or holds a null or a non-finite component, or whose label is null, has no links and is its own
component. Vectors of different lengths are not compared. Repeated rows are vectors of their own: they count as links of each other.
Null ids are one node. Empty table: no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import Workspace
from .components import components

BLOCK = 512
NULL_ID = -(2**63)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests, raws = [], []
        for v in b.column("vec").to_pylist():
            raw = digest = None
            if v and None not in v:
                x = np.array(v, np.float64) + 0.0  # no negative zero
                if np.isfinite(x).all() and x.any():
                    norm = float(np.sqrt((x * x).sum()))
                    if not 0 < norm < math.inf:  # squares out of range
                        x = x / np.abs(x).max()
                    raw = x.tobytes()
                    digest = hashlib.blake2b(raw, digest_size=16).digest()
            digests.append(digest), raws.append(raw)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(digests, pa.binary()), pa.array(raws, pa.binary())], ["id", "label", "digest", "vec"])


@functools.lru_cache(maxsize=4)
def planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def _keys(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    signs = (x @ planes(x.shape[1], bits, tables, seed) >= 0).reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(2).astype(np.uint32)


def _by_dim(vecs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    dims = np.array([len(v) // 8 for v in vecs])
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        yield at, np.frombuffer(b"".join(vecs[i] for i in at.tolist()), np.float64).reshape(len(at), d)


def _signed(batches: Iterator[pa.RecordBatch], bits: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        label = b.column("label").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        rep = b.column("rep").to_numpy(zero_copy_only=False)
        for at, x in _by_dim(b.column("vec").to_pylist()):
            sig = _keys(x, bits, tables, seed).astype(np.uint64)
            t = np.arange(tables, dtype=np.uint64)
            key = K.mix(K.mix(label[at][:, None] * np.uint64(31) + t) ^ K.mix(sig + np.uint64(x.shape[1] << 32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rep[at], tables)), pa.array(np.tile(t.astype(np.int32), len(at))), pa.array(key.ravel().view(np.int64))], ["rep", "t", "key"])


def _pairs(x: np.ndarray, y: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    nx, ny = (np.sqrt((v * v).sum(1)) for v in (x, y))
    i, j = np.nonzero((x @ y.T) / nx[:, None] / ny[None, :] >= threshold)
    if same:
        keep = i < j
        i, j = i[keep], j[keep]
    return i, j


def _compared(batches: Iterator[pa.RecordBatch], bits: int, tables: int, seed: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, lo, hi); out: kind 0 (vector, links), kind 1 a link of a tree."""
    from .components import forest

    kinds, us, vs, held = [], [], [], 0

    def work(rows: list[tuple]) -> None:
        nonlocal held
        if len(rows) < 2:
            return
        lo, hi = rows[0][1], rows[0][2]
        t = rows[0][4]
        left = [r for r in rows if r[3] == lo]
        right = left if lo == hi else [r for r in rows if r[3] == hi]
        if not left or not right:
            return
        x, y = (np.frombuffer(b"".join(r[7] for r in side), np.float64).reshape(len(side), -1) for side in (left, right))
        i, j = _pairs(x, y, lo == hi, threshold)
        if not len(i):
            return
        if t:  # met in an earlier table?
            sx = _keys(x, bits, tables, seed)[:, :t]
            sy = sx if lo == hi else _keys(y, bits, tables, seed)[:, :t]
            new = np.ones(len(i), bool)
            for a in range(0, len(i), 1 << 16):
                new[a : a + (1 << 16)] = ~(sx[i[a : a + (1 << 16)]] == sy[j[a : a + (1 << 16)]]).any(1)
            i, j = i[new], j[new]
            if not len(i):
                return
        idx, idy = (np.array([r[5] for r in side]) for side in (left, right))
        nx, ny = (np.array([r[6] for r in side], np.float64) for side in (left, right))
        for ids, own, other, size in ((idx, i, ny[j], len(left)), (idy, j, nx[i], len(right))):
            s = np.bincount(own, weights=other, minlength=size).astype(np.int64)
            at = np.flatnonzero(s)
            kinds.append(np.zeros(len(at), np.int32)), us.append(ids[at]), vs.append(s[at])
            held += len(at)
        u, v = forest(idx[i], idy[j])
        kinds.append(np.ones(len(u), np.int32)), us.append(u), vs.append(v)

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held
        if kinds:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (kinds, us, vs)], ["kind", "u", "v"])
            kinds.clear(), us.clear(), vs.clear()
            held = 0

    group, at = [], None
    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in ("key", "lo", "hi", "b", "t", "rep", "n", "vec"))):
            if r[:3] != at:
                work(group)
                group, at = [], r[:3]
            group.append(r)
        if held > 100_000:
            yield from flush()
    work(group)
    yield from flush()


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", miss: float = 1e-6, seed: int = 11) -> DataFrame:
    """One row per vector: id, n_links, component_id (least id reachable), kept (is it that one)."""
    ws = Workspace(vectors.sparkSession, "embeddings")
    kind = vectors.schema[id_col].dataType
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(F.col(label_col).cast("string")).alias("h"), F.col(label_col).alias("l"), F.col(vector_col).cast("array<double>").alias("vec"))
    rows = rows.select("id", F.when(F.col("l").isNotNull(), F.col("h")).alias("label"), "vec")
    every = ws.table(rows.mapInArrow(_parsed, "id long, label long, digest binary, vec binary"), "parsed")
    good = every.where(F.col("digest").isNotNull() & F.col("label").isNotNull())
    reps = ws.table(good.groupBy("label", "digest").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec")), "reps")
    largest = reps.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    bits = min(28, max(12, math.ceil(math.log2(max(2, largest))) + 3))
    agree = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    tables = max(1, math.ceil(math.log(miss) / math.log1p(-min(1 - 1e-12, agree**bits))))
    keys = ws.table(reps.mapInArrow(lambda b: _signed(b, bits, tables, seed), "rep long, t int, key long"), "keys")
    met = ws.table(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "met")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    there = keys.join(met, "key").select("key", "t", "rep", own.alias("b"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o"))
    there = ws.table(there.select("key", "t", "rep", "b", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi")), "there")
    full = there.join(reps.select("rep", "n", "vec"), "rep").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    got = ws.table(full.mapInArrow(lambda b: _compared(b, bits, tables, seed, threshold), "kind int, u long, v long"), "compared")
    ws.drop(keys, met, there)
    degree = got.where("kind = 0").groupBy(F.col("u").alias("rep")).agg(F.sum("v").alias("more"))
    comp = components(got.where("kind = 1").select("u", "v"), ws).withColumnRenamed("node", "rep")
    classes = ws.table(reps.select("label", "digest", "rep", "n").join(degree, "rep", "left").join(comp, "rep", "left"), "classes")
    out = every.select("id", "label", "digest").join(classes, ["label", "digest"], "left")
    linked = F.col("n").isNotNull()
    component = F.when(linked, F.coalesce("component", "rep")).otherwise(F.col("id"))
    name = lambda c: F.when(c != NULL_ID, c).cast(kind)
    return out.select(name(F.col("id")).alias("id"), F.when(linked, F.col("n") - 1 + F.coalesce("more", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), name(component).alias("component_id"), (F.col("id") == component).alias("kept"))
