"""Near-duplicate documents by MinHash with tensored banding, every link verified on full shingle sets.

Tensoring: two collections of `side` half keys, each half of HALF minhashes, are computed once; the table keys are all side * side pairs
of a half from each. So 2 * side * HALF minhashes serve side ** 2 tables of 2 * HALF minhashes, about a square root of what separate
tables need. Two documents of similarity s share a table with probability (1 - (1 - s**HALF)**side)**2; `side` follows from the threshold.

 1. One pass over the texts: the set of shingles, its size, a digest of the set, and the half keys. Documents with one digest have one set:
    they are one class, a node, and only nodes go on.
 2. A pair can only meet in a table if both its halves meet, so half keys that stand alone are dropped before tables are formed.
    Tables' buckets with the same members are one. Large buckets are dealt out at random into chunks of bounded size.
 3. In each chunk all pairs are compared by their minhashes, in the first table only in which the pair meets; a pair that agrees in far fewer than the
    threshold lets expect is no candidate. Each node proposes its nearest candidate and the nearest before it, if they agree as much as linked ones do; proposals are
    verified and links join nodes into components. So a group of near copies leaves this step as a few components, however large it is.
 4. What candidates are left between different components are verified in blocks: the sets of the nodes concerned meet in a task, which
    multiplies them as sparse 0/1 matrices and hands out a forest of links. A bucket of several chunks is searched in blocks of
    its minhashes first: all that is outside its largest component, against everything in it. Pairs are never rows.
    A pair within a component needs no check, as it would not change a component.

A pair at the threshold is missed with probability `miss` (1e-5) by the tables and as much again by step 3; a nearer one less. Sets
are sets of 64-bit hashes of shingles.

Rows: null text, or no words: an empty set, linked with nothing. A row is judged by its own text: rows that share an id (or have none) but not a
text may be in different components, named by the least id in each; rows that share both are alike. Ties of nearest
candidates go to the earlier node and change no result. Empty table: no rows. Extra columns, of whatever name, are not looked at. A very long text
is hashed in pieces of bounded size; its set of shingles is held whole in a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import Workspace, column, free_name
from .components import components, forest

HALF = 2
#: Nodes and shingles of a chunk of a bucket, up to which all its pairs are compared in one task.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
#: Groups up to this size are compared together with others, larger ones by matrices.
SMALL = 48
_U = np.uint64
NULL_ID = -(2**63)


def side_for(percent: int, miss: float = 1e-5) -> int:
    """Half keys of each collection, so that a pair at the threshold misses all tables with probability `miss` at most."""
    return max(1, math.ceil(math.log(miss / 2) / math.log1p(-min(0.999999, (percent / 100) ** HALF))))


def least_equal(percent: int, hashes: int, miss: float = 1e-5) -> int:
    """Equal minhashes of `hashes` that a pair at the threshold falls below with probability `miss` at most."""
    s, below = percent / 100, 0.0
    for k in range(hashes + 1):
        below += math.comb(hashes, k) * s**k * (1 - s) ** (hashes - k)
        if below > miss:
            return k
    return hashes


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of each text, repeats included, and offsets. Fewer words than the width make one shingle."""
    data, rows = K.buffers(texts)
    data = K.lower(data)
    w = K.Words(data, rows)
    prefix = K.FIRST.prefix(w.hashes(data))
    n = np.diff(w.off)
    many = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    off = np.concatenate(([0], np.cumsum(many)))
    start = np.arange(int(off[-1])) - np.repeat(off[:-1] - w.off[:-1], many)
    end = np.minimum(start + width, np.repeat(w.off[1:], many))
    return K.FIRST.spans(prefix, start, end) ^ K.mix((end - start).astype(np.uint64)), off


def _signed(batches: Iterator[pa.RecordBatch], width: int, side: int) -> Iterator[pa.RecordBatch]:
    """halves: 2 * side pairs of 32-bit minhashes, packed in longs."""
    rng = np.random.default_rng(20)
    a = rng.integers(1, 2**63, 2 * side * HALF, dtype=np.uint64) | _U(1)
    b = rng.integers(0, 2**63, 2 * side * HALF, dtype=np.uint64)
    for piece in K.slices(batches):
        h, off = shingles(piece.column("text"), width)
        n = piece.num_rows
        full = np.flatnonzero(np.diff(off) > 0)
        sizes, digests = np.zeros(n, np.int64), [b""] * n
        for i in full.tolist():
            s = np.unique(h[off[i] : off[i + 1]])
            sizes[i] = len(s)
            digests[i] = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
        mins = np.zeros((n, 2 * side * HALF), np.uint32)
        for k in range(len(a)) if len(full) else ():
            x = h * a[k]
            x += b[k]
            x ^= x >> _U(32)
            x *= a[-1 - k]
            mins[full, k] = np.minimum.reduceat(x, off[full]) >> _U(32)
        flat = pa.array(mins.view(np.int64).ravel())
        every = np.where(sizes > 0, 2 * side, 0)
        keys = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(every))).astype(np.int32)), flat.take(pa.array(np.flatnonzero(np.repeat(sizes > 0, 2 * side)))))
        yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("k2"), pa.array(sizes), pa.array(digests, pa.binary()), keys], ["id", "k2", "n", "digest", "halves"])


def _hashed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for piece in K.slices(batches):
        h, off = shingles(piece.column("text"), width)
        sets = [np.unique(h[x:y]).view(np.int64) for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
        at = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32))
        yield pa.RecordBatch.from_arrays([piece.column("node"), pa.ListArray.from_arrays(at, pa.array(np.concatenate(sets)))], ["node", "set"])


def _grouped(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows sorted by the columns, and where each group in it begins, the end included."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if len(held) > 1 and all(held[0].column(c)[0] == batch.column(c)[batch.num_rows - 1] for c in by):
            continue  # one group so far
        t = pa.Table.from_batches(held).combine_chunks()
        new = _begins(t, by)
        if new[-1]:
            yield t.slice(0, int(new[-1])), new
        held = t.slice(int(new[-1])).to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, np.append(_begins(t, by), t.num_rows)


def _begins(t: pa.Table, by: tuple[str, ...]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in by:
        x = t.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


class _Rows:
    """Nodes that stand in groups: what is compared of them."""

    def __init__(self, t: pa.Table, side: int, percent: int, least: int):
        self.node, self.n, self.t = (t.column(c).to_numpy() for c in ("node", "n", "t"))
        self.halves = _longs(t.column("halves")).reshape(-1, 2 * side)
        self.mins = self.halves.view(np.uint32)
        self.side, self.percent, self.least = side, percent, least

    def candidates(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the pairs that meet here first and agree enough, and how much they agree."""
        out = []
        for a in range(0, len(i), 1 << 14):
            x, y = i[a : a + (1 << 14)], j[a : a + (1 << 14)]
            ok = 100 * np.minimum(self.n[x], self.n[y]) >= self.percent * np.maximum(self.n[x], self.n[y])
            x, y = x[ok], y[ok]
            same = self.mins[x] == self.mins[y]
            equal = same.sum(1)
            ok = equal >= self.least
            x, y, equal = x[ok], y[ok], equal[ok]
            half = same[ok].reshape(len(x), 2 * self.side, HALF).all(2)
            first = half[:, : self.side].argmax(1) * self.side + half[:, self.side :].argmax(1)
            ok = first == self.t[x]
            out.append((x[ok], y[ok], equal[ok]))
        return tuple(np.concatenate(z) for z in zip(*out)) if out else (i, j, i)

    def first_met(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows from left and right that share no earlier half of either collection, so that no earlier table holds them."""
        one, two = divmod(int(self.t[left[0]]), self.side)
        met = np.zeros((len(left), len(right)), bool)
        for k in [*range(one), *range(self.side, self.side + two)]:
            met |= self.halves[left, k][:, None] == self.halves[right, k][None, :]
        i, j = np.nonzero(~met)
        return left[i], right[j]


def _longs(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _all_pairs(rows: _Rows, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates of all groups, each pair (i, j) with i before j."""
    size = np.diff(begin)
    group = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero((size > 1)[group] & (size <= SMALL)[group])
    last = begin[1:][group]
    for d in range(1, SMALL):
        at = at[at + d < last[at]]
        if not len(at):
            break
        yield rows.candidates(at, at + d)
    for g in np.flatnonzero(size > SMALL).tolist():
        own = np.arange(begin[g], begin[g + 1])
        i, j = rows.first_met(own, own)
        ok = i < j
        yield rows.candidates(i[ok], j[ok])


def _nearest(row: np.ndarray, other: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Indexes of the pairs that are the nearest of their row."""
    order = np.lexsort((other, -equal.astype(np.int64), row))
    first = np.ones(len(order), bool)
    first[1:] = row[order][1:] != row[order][:-1]
    return order[first]


def _proposed(batches: Iterator[pa.RecordBatch], side: int, percent: int, least: int, likely: int) -> Iterator[pa.RecordBatch]:
    """kind 0: pairs (u, v) to verify; kind 1: (bucket, node) for nodes of other candidate pairs in a bucket of one chunk."""
    for t, begin in _grouped(batches, ("key", "chunk")):
        rows = _Rows(t, side, percent, least)
        found = [x for x in _all_pairs(rows, begin) if len(x[0])]
        if not found:
            continue
        i, j, equal = (np.concatenate(x) for x in zip(*found))
        twice = np.concatenate((np.arange(len(i)), np.arange(len(i))))
        pick = np.unique(np.concatenate((twice[_nearest(np.concatenate((i, j)), np.concatenate((j, i)), np.concatenate((equal, equal)))], _nearest(j, i, equal))))
        pick = pick[equal[pick] >= likely]
        rest = np.ones(len(i), bool)
        rest[pick] = False
        rest &= t.column("alone").to_numpy()[i]
        open_ = np.unique(np.concatenate((i[rest], j[rest])))
        key = t.column("key").to_numpy()
        u, v = rows.node[i[pick]], rows.node[j[pick]]
        kind = np.repeat(np.array([0, 1], np.int32), [len(u), len(open_)])
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate((np.minimum(u, v), key[open_]))), pa.array(np.concatenate((np.maximum(u, v), rows.node[open_])))], ["kind", "u", "v"])


def _between(batches: Iterator[pa.RecordBatch], side: int, percent: int, least: int) -> Iterator[pa.RecordBatch]:
    """Nodes of candidate pairs of different components, of blocks (key, lo, hi) of large buckets: (block, node)."""
    for t, begin in _grouped(batches, ("block",)):
        rows = _Rows(t, side, percent, least)
        block, lo, hi, own, comp = (t.column(c).to_numpy() for c in ("block", "lo", "hi", "b", "c"))
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            left, right = (a + np.flatnonzero(own[a:b] == x[a]) for x in (lo, hi))
            if not len(left) or not len(right):
                continue
            i, j = rows.first_met(left, right)
            ok = comp[i] != comp[j]
            i, j, _ = rows.candidates(i[ok], j[ok])
            at = np.unique(np.concatenate((i, j)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(block[at]), pa.array(rows.node[at])], ["block", "node"])


def _intersections(sets: np.ndarray, off: np.ndarray, columns: int = 4096) -> np.ndarray:
    """How many values each two of the sets share: a product of 0/1 matrices, a slice of the values that several have at a time."""
    m = len(off) - 1
    order = np.argsort(sets, kind="stable")
    value, row = sets[order], np.repeat(np.arange(m), np.diff(off))[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    which = np.cumsum(new) - 1
    often = np.bincount(which) > 1
    keep = often[which]
    row, col = row[keep], (np.cumsum(often) - 1)[which[keep]]
    out = np.zeros((m, m), np.float32)
    for a in range(0, int(often.sum()), columns):
        x = np.zeros((m, columns), np.float32)
        b, e = np.searchsorted(col, [a, a + columns])
        x[row[b:e], col[b:e] - a] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """A forest of the links between different components in each block."""
    for t, begin in _grouped(batches, ("block",)):
        node, comp = t.column("node").to_numpy(), t.column("c").to_numpy()
        lists = t.column("set").combine_chunks()
        off = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy(zero_copy_only=False)
        us, vs = [], []
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            n = np.diff(off[a : b + 1])
            both = _intersections(values[off[a] : off[b]], off[a : b + 1] - off[a])
            i, j = np.nonzero(100 * both >= percent * (n[:, None] + n[None, :] - both))
            ok = (i < j) & (comp[a + i] != comp[a + j])
            if ok.any():
                u, v = forest(node[a + i[ok]], node[a + j[ok]])
                us.append(u), vs.append(v)
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])


class Search:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, block: int | None = None):
        self.ws = Workspace(docs.sparkSession, "minhash")
        self.width, self.percent, self.block = width, percent, block or BLOCK
        self.side = side_for(percent)
        self.least = least_equal(percent, 2 * self.side * HALF)
        self.likely = 2 * self.side * HALF * percent // 100 - 1
        self.rows = docs.select(*_named(id_col, text_col))

    def members(self, nodes: DataFrame) -> DataFrame:
        """(key, t, node, c, s): buckets of two nodes or more, c nodes with s shingles; of those with equal members the first table's."""
        ws, side = self.ws, self.side
        half = nodes.select("node", F.col("n").cast("int").alias("n"), F.posexplode("halves").alias("slot", "value"))
        half = ws.table(half.select("node", "n", "slot", F.xxhash64("slot", "value").alias("h")), "halves")
        shared = ws.table(half.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "shared")
        met = half.join(shared, "h")
        of = lambda one: F.collect_list(F.when((F.col("slot") < side) == F.lit(one), F.struct(F.pmod("slot", F.lit(side)).alias("k"), "h")))
        sides = met.groupBy("node", "n").agg(of(True).alias("a"), of(False).alias("b"))
        pairs = sides.select("node", "n", F.explode("a").alias("x"), "b").select("node", "n", "x", F.explode("b").alias("y"))
        tables = ws.table(pairs.select("node", "n", (F.col("x.k") * side + F.col("y.k")).cast("int").alias("t"), F.xxhash64("x.h", "y.h").alias("key")), "tables")
        ws.drop(half, shared)
        prints = tables.groupBy("key").agg(F.min("t").alias("t"), F.count("*").alias("c"), F.sum("n").alias("s"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("x2"))
        first = prints.where("c > 1").groupBy("c", "s", "lo", "hi", "x1", "x2").agg(F.min(F.struct("t", "key")).alias("f"))
        chosen = ws.table(first.select("f.key", "c", "s"), "chosen")
        out = ws.table(tables.drop("n").join(chosen, "key"), "members")
        ws.drop(chosen, tables)
        return out

    def sets(self, wanted: DataFrame, nodes: DataFrame) -> DataFrame:
        """(node, n, set) of the nodes wanted, each once."""
        names = wanted.join(nodes.select("node", F.col("row.id").alias("id"), F.col("row.k2").alias("k2")), "node")
        got = self.rows.join(names, ["id", "k2"]).select("node", "text").mapInArrow(lambda b, w=self.width: _hashed(b, w), "node long, set array<long>")
        return self.ws.table(got.groupBy("node").agg(F.first("set").alias("set")).select("node", F.size("set").alias("n"), "set"), "sets")

    def verify(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of the pairs (u, v) that are linked. Spark intersects the sets, whose memory for a join is bounded whatever their length."""
        left, right = (sets.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("set").alias(f"set{c}")) for c in "uv")
        full = pairs.join(right, "v").join(left, "u")
        both = F.size(F.array_intersect("setu", "setv"))
        return full.where(100 * both >= self.percent * (F.col("nu") + F.col("nv") - both)).select("u", "v")

    def chunks(self) -> Column:
        return F.ceil(F.greatest(F.col("c") / self.block, F.col("s") / BLOCK_SHINGLES)).cast("int")

    def between(self, members: DataFrame, comp: DataFrame, nodes: DataFrame) -> DataFrame:
        """(block, node) of candidate pairs across components in buckets of several chunks."""
        ws = self.ws
        several = self.chunks()
        now = members.where(several > 1).join(comp.withColumnRenamed("component", "c_"), "node", "left").select("key", "t", "node", F.coalesce("c_", "node").alias("m"), several.alias("k"), "c")
        now = ws.table(now, "now")
        counts = now.groupBy("key", "m").agg(F.count("*").alias("x"))
        main = counts.groupBy("key").agg(F.max_by("m", F.struct("x", "m")).alias("main"), F.max("x").alias("x"), F.count("*").alias("parts")).where("parts > 1").select("key", "main", "x")
        rows = now.join(main, "key")
        share = lambda x: F.greatest(F.lit(1), F.ceil(F.col("k") * x / F.col("c"))).cast("int")
        outer, inner = share(F.col("c") - F.col("x")), share(F.col("x"))
        rows = rows.select("key", "t", "node", F.col("m").alias("c"), (F.col("m") == F.col("main")).alias("inside"), outer.alias("o"), inner.alias("i"))
        lot = lambda n: F.pmod(F.xxhash64("key", "node"), n).cast("int")
        rows = rows.withColumn("b", F.when(F.col("inside"), F.col("o") + lot(F.col("i"))).otherwise(lot(F.col("o"))))
        # an outer chunk meets every chunk, an inner one the outer ones
        others = F.when(F.col("inside"), F.sequence(F.lit(0), F.col("o") - 1)).otherwise(F.sequence(F.lit(0), F.col("o") + F.col("i") - 1))
        rows = rows.select("key", "t", "node", "c", "b", F.explode(others).alias("y"))
        rows = rows.select("key", "t", "node", "c", "b", F.least("b", "y").alias("lo"), F.greatest("b", "y").alias("hi"))
        rows = rows.withColumn("block", F.xxhash64("key", "lo", "hi")).join(nodes.select("node", "n", "halves"), "node")
        rows = rows.repartition("block").sortWithinPartitions("block", "node")
        side, percent, least = self.side, self.percent, self.least
        return ws.table(rows.mapInArrow(lambda b: _between(b, side, percent, least), "block long, node long"), "between")

    def run(self) -> DataFrame:
        """(id, k2, n, component)."""
        ws, width, side, percent, least, likely = self.ws, self.width, self.side, self.percent, self.least, self.likely
        signed = ws.table(self.rows.mapInArrow(lambda b: _signed(b, width, side), "id long, k2 long, n long, digest binary, halves array<long>"), "signed")
        of_class = signed.where("n > 0").groupBy("digest").agg(F.min(F.struct("id", "k2")).alias("row"), F.first("n").alias("n"), F.first("halves").alias("halves"))
        nodes = ws.table(of_class.withColumn("node", F.monotonically_increasing_id()), "nodes")
        members = self.members(nodes)
        several = self.chunks()
        rows = members.select("key", "t", "node", F.pmod(F.xxhash64("key", "node"), several).cast("int").alias("chunk"), (several == 1).alias("alone"))
        rows = rows.join(nodes.select("node", "n", "halves"), "node").repartition("key", "chunk").sortWithinPartitions("key", "chunk", "node")
        got = ws.table(rows.mapInArrow(lambda b: _proposed(b, side, percent, least, likely), "kind int, u long, v long"), "proposed")
        pairs = ws.table(got.where("kind = 0").select("u", "v").distinct(), "pairs")
        concerned = got.select(F.explode(F.when(F.col("kind") == 0, F.array("u", "v")).otherwise(F.array("v"))).alias("node"))
        sets = self.sets(concerned.distinct(), nodes)
        links = ws.table(self.verify(pairs, sets), "links")
        comp = components(links, ws)
        done = [members, got, sets]
        more = got.where("kind = 1").select(F.col("u").alias("block"), F.col("v").alias("node")).unionByName(self.between(members, comp, nodes))
        more = more.join(comp, "node", "left").select("block", "node", F.coalesce("component", "node").alias("c"))
        more = ws.table(more, "more")
        still = more.groupBy("block").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("block")
        more = ws.table(more.join(still, "block"), "still")
        if not more.isEmpty():
            rest = more.join(sets.select("node"), "node", "left_anti").select("node").distinct()
            rest = ws.table(rest, "rest")
            if not rest.isEmpty():  # of buckets of several chunks
                also = self.sets(rest, nodes)
                done.append(also)
                sets = sets.unionByName(also)
            blocks = more.join(sets.select("node", "set"), "node").repartition("block").sortWithinPartitions("block", "node")
            late = ws.table(blocks.mapInArrow(lambda b: _linked(b, percent), "u long, v long"), "late")
            known = comp.select(F.col("node").alias("u"), F.col("component").alias("v"))  # as links to the least
            comp = components(late.unionByName(known), ws)
        named = nodes.select("digest", "node", "row.id").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = ws.table(named.select("digest", "id", "component"), "named")
        least_id = named.groupBy("component").agg(F.min("id").alias("least"))
        classes = ws.table(named.join(least_id, "component").select("digest", "least"), "classes")
        ws.drop(named, *done)
        return signed.join(classes, "digest", "left").select("id", "k2", "n", F.coalesce("least", "id").alias("component"))


def _named(id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """id, k2, text: k2, a hash of the text, keeps texts under one id apart."""
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    return F.coalesce(column(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text, F.octet_length(text)).alias("k2"), text.alias("text")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (least id reachable by links), kept (is it that one).

    width: words of a shingle; percent: documents are linked if 100 * |A and B| >= percent * |A or B|.
    """
    kind = docs.schema[id_col].dataType
    name = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).cast(kind)
    out = Search(docs, id_col, text_col, width, percent).run()
    return out.select(name("id").alias("id"), F.col("n").alias("n_shingles"), name("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without all but one of each group of near-duplicates; columns of the input. Documents that share
    id and text share their fate; where only the id is shared, each is judged by its own text."""
    out = Search(docs, id_col, text_col, width, percent).run()
    gone = out.where("id <> component").select("id", "k2").distinct()
    key = free_name(docs, "key")
    id_, k2, _ = _named(id_col, text_col)
    kept = docs.withColumn(key, F.struct(id_, k2)).join(gone.select(F.struct("id", "k2").alias(key)), key, "left_anti")
    return kept.select(*(column(c) for c in docs.columns))
