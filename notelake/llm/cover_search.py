"""Exact top-k search by inner product: cover trees over queries and data, searched together.

Vectors become whole numbers, floor(scale * x), and are dealt to cells by the nearest of at most CELLS pivots, found by a farthest-first traversal of a
sample of SAMPLE vectors; a cell is cut into blocks of bounded size. Every vector is indexed. Each block is one group of rows: its vectors
come first and become a cover tree, then the queries stream by in batches, each with a tree of its own. A pair of nodes is left out when

    <q, x> + rq |x| + rx |q| + rq rx  <  the worst k-th score of the queries below q

with centres q and x and covering radii rq and rx; otherwise the wider node is opened, the more promising half first. The k-th score begins
at the k-th best of the sample, and with the same bound a query is not sent to cells that cannot hold a better one. The best k of the blocks are merged by query.

A node's children are the centres of a farthest-first traversal: all members lie within the radius at which it stops and the centres lie at least that
far apart, so covering, separation and nesting hold at each level; the radii follow the data instead of halving.

Scores are exact: products of doubles where all partial sums stay below 2**53, whole numbers of Python beyond; what passes 64 bits counts as the end of
their range. Bounds leave a margin for rounding, so ties are never pruned. Only the k + 1 least ids of equal vectors are searched, as no query needs more.

The driver holds the sample (4,096 vectors) and one number; blocks have at most BLOCK vectors. A cell's statistics are at most one row for each pivot and length.

Rows: a vector that is null or holds a null or non-finite component takes no part, nor does one without an id, nor one whose scaled component is no
finite double. Vectors of different lengths have no inner product and do not meet. Rows that repeat an id or a vector are rows of their own: each is a query if its
id is divisible, and a candidate for the others. Ties go to the smaller id. Ids are whole numbers. Extra columns are ignored, whatever their names. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, column, parts_for

SAMPLE, CELLS, PER_CELL = 4096, 1024, 256
BLOCK, LEAST_BLOCK = 1 << 16, 512
BATCH, FAN, LEAF, TOGETHER = 1024, 16, 64, 512
_LOW, _HIGH = -(2**63), 2**63 - 1


def pack(x: np.ndarray) -> list[bytes]:
    """Whole numbers held in doubles, as bytes that are equal for equal vectors; two a component where all are small."""
    small = (np.abs(x) < 1 << 15).all(1)
    two = x.astype(np.int16, casting="unsafe")
    return [b"h" + two[i].tobytes() if small[i] else b"d" + x[i].tobytes() for i in range(len(x))]


def unpack(raw: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(raw), dim))
    for i, r in enumerate(raw):
        out[i] = np.frombuffer(r, np.int16 if r[:1] == b"h" else np.float64, offset=1)
    return out


def _parsed(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        vec = b.column("vec")
        flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        n = vec.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(n)
        with np.errstate(over="ignore", invalid="ignore"):
            flat = np.floor(flat * scale) + 0.0  # a null is NaN by now; no negative zero
        bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
        good = (bad[ends] == bad[ends - n]) & vec.is_valid().to_numpy(zero_copy_only=False)
        at, raw = [], []
        for d in np.unique(n[good]).tolist():
            rows = np.flatnonzero(good & (n == d))
            at.append(rows)
            raw += pack(flat[(ends[rows] - d)[:, None] + np.arange(d)])
        order = pa.array(np.concatenate(at) if at else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([b.column("vec_id").take(order), b.column("uid").take(order), pa.array(n[order.to_numpy()].astype(np.int32)), pa.array(raw, pa.binary())], ["vec_id", "uid", "dim", "raw"])


def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        d = x - c
        return np.sqrt((d * d).sum(1))


def spread(x: np.ndarray, most: int, first: int = 0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Farthest-first traversal: centres, the nearest centre of each row and its distance."""
    centres, dist = [first], _far(x, x[first])
    near = np.zeros(len(x), np.int64)
    while len(centres) < most:
        far = int(np.argmax(dist))
        if not dist[far] > 0:
            break
        d = _far(x, x[far])
        closer = d < dist
        near[closer], dist[closer] = len(centres), d[closer]
        centres.append(far)
    return centres, near, dist


class Tree:
    """A cover tree: of each node its centre, that centre's length, the radius that covers all below, its members and children."""

    def __init__(self, x: np.ndarray, fan: int = FAN, leaf: int = LEAF):
        self.x, self.centre, self.radius, self.members, self.kids = x, [], [], [], []
        with np.errstate(over="ignore"):
            self.norms = np.sqrt((x * x).sum(1))
        todo = [(np.arange(len(x)), 0, -1)]
        while todo:
            rows, c, parent = todo.pop()
            dist = _far(x[rows], x[c])
            me = len(self.centre)
            self.centre.append(c), self.radius.append(float(dist.max())), self.members.append(rows), self.kids.append([])
            if parent >= 0:
                self.kids[parent].append(me)
            if len(rows) <= leaf or not dist.max() > 0:
                continue
            centres, near, _ = spread(x[rows], fan, int(np.flatnonzero(rows == c)[0]))
            sizes = np.bincount(near, minlength=len(centres))
            if (sizes > 0).sum() > 1:
                todo += [(rows[near == j], int(rows[centres[j]]), me) for j in range(len(centres)) if sizes[j]]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)


def _bound(cos: np.ndarray, rq, nq, rx, nx) -> np.ndarray:
    """The most that an inner product below two nodes can be, with a margin for rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        return cos + rq * nx + rx * nq + rq * rx + 1e-9 * (nq + rq) * (nx + rx) + 1e-6


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as longs; beyond 64 bits the end of their range."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if top < 2**53:
        return (q @ x.T).astype(np.int64)
    a, b = (np.array([[int(v) for v in row] for row in m], dtype=object) for m in (q, x))
    return np.array([[min(_HIGH, max(_LOW, sum(s * t for s, t in zip(u, v)))) for v in b] for u in a], np.int64)


def _merged(best: tuple[np.ndarray, ...], at: np.ndarray, row: np.ndarray, found: tuple[np.ndarray, ...], k: int) -> None:
    """Puts what was found for rows `at` of the best (row: its place in `at`) where it belongs, by score, falling, then id, then row number."""
    held = np.repeat(np.arange(len(at)), k)
    row = np.concatenate((held, row))
    score, ids, uids = (np.concatenate((old[at].ravel(), new)) for old, new in zip(best, found))
    order = np.lexsort((uids, ids, ~score, row))  # ~s falls as s grows, without overflow
    begins = np.searchsorted(row[order], np.arange(len(at)))
    take = order[(begins[:, None] + np.arange(k)).ravel()]
    for old, new in zip(best, (score, ids, uids)):
        old[at] = new[take].reshape(len(at), k)


def search(tree: Tree, ids: np.ndarray, uids: np.ndarray, q: np.ndarray, quids: np.ndarray, seeds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, ids and row numbers of the best k for each query, its own row left out; row number -1 where there are fewer."""
    best = (np.full((len(q), k), _LOW), np.full((len(q), k), _HIGH), np.full((len(q), k), -1))
    kth = seeds.astype(np.float64).copy()
    mine = Tree(q, leaf=LEAF // 2)

    def open_to(a: int, nodes: list[int]) -> np.ndarray:
        """Those of the data's nodes that may matter to a node of queries, the least promising first."""
        ca, cs = mine.centre[a], tree.centre[nodes]
        with np.errstate(over="ignore", invalid="ignore"):
            met = tree.x[cs] @ q[ca]
        order = np.argsort(met)
        left = ~(_bound(met, mine.radius[a], mine.norms[ca], tree.radius[nodes], tree.norms[cs]) < kth[mine.members[a]].min())
        return np.array(nodes)[order[left[order]]]

    def compare(qs: np.ndarray, leaves: list[int]) -> None:
        cs = tree.centre[leaves]
        with np.errstate(over="ignore", invalid="ignore"):  # the same bound for each query of the leaf
            far = _bound(q[qs] @ tree.x[cs].T, 0.0, mine.norms[qs][:, None], tree.radius[leaves], tree.norms[cs]) < kth[qs][:, None]
        qs = qs[~far.all(1)]
        xs = np.concatenate([tree.members[b] for b, gone in zip(leaves, far.all(0)) if not gone] or [np.zeros(0, np.int64)])
        if not len(qs) or not len(xs):
            return
        s = products(q[qs], tree.x[xs])
        own = uids[xs] == quids[qs][:, None]
        s[own] = _LOW
        least = kth[qs]
        if len(xs) > k:
            least = np.maximum(least, np.partition(s, len(xs) - k, 1)[:, len(xs) - k])
        row, col = np.nonzero((s >= least[:, None]) & ~own)
        some, row_of = np.unique(row, return_inverse=True)
        if len(some):
            at = qs[some]
            _merged(best, at, row_of, (s[row, col], ids[xs[col]], uids[xs[col]]), k)
            kth[at] = np.maximum(kth[at], np.where(best[2][at, k - 1] >= 0, best[0][at, k - 1].astype(np.float64), -np.inf))

    todo = [(0, [0])]
    while todo:  # a node of queries with all the nodes of the data that may still matter to it
        a, nodes = todo.pop()
        nodes = open_to(a, nodes).tolist()
        ends = [b for b in nodes if not tree.kids[b]]
        if mine.kids[a]:
            wide = [b for b in nodes if tree.kids[b] and tree.radius[b] >= mine.radius[a]]
            if wide:
                todo.append((a, [b for b in nodes if b not in wide] + [c for b in wide for c in tree.kids[b]]))
            elif nodes:
                todo += [(c, nodes) for c in mine.kids[a]]
            continue
        part, size = [], 0
        for b in reversed(ends):  # the most promising first, some hundred vectors at a time
            part.append(b)
            size += len(tree.members[b])
            if size >= TOGETHER or b == ends[0]:
                compare(mine.members[a], part)
                part, size = [], 0
        deeper = [c for b in nodes for c in tree.kids[b]]
        if deeper:
            todo.append((a, deeper))
    return best


def _dealt(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Adds the cell (-1: no pivot has this length) and the distance from its pivot."""
    for b in batches:
        dims = b.column("dim").to_numpy(zero_copy_only=False)
        raw = b.column("raw").to_pylist()
        cell, dist = np.full(len(raw), -1, np.int32), np.full(len(raw), np.inf)
        for d in np.unique(dims).tolist():
            if d in pivots:
                at, p = np.flatnonzero(dims == d), pivots[d]
                x = unpack([raw[i] for i in at.tolist()], d)
                near = np.zeros(len(x), np.int32)
                for s in range(0, len(x), 1024):
                    with np.errstate(over="ignore", invalid="ignore"):
                        near[s : s + 1024] = np.argmin((p * p).sum(1) - 2 * (x[s : s + 1024] @ p.T), 1)
                cell[at], dist[at] = near, _far(x, p[near])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(dist)], [*b.schema.names, "cell", "dist"])


def _sent(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """Each query with the k-th best score that the sample gives, once for each block of the cells that may hold a better one."""
    for b in batches:
        dims, quids = (b.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "uid"))
        raw, cells = b.column("raw").to_pylist(), b.column("cells").to_pylist()
        seed, at, cell, sub = np.full(len(raw), -np.inf), [], [], []
        for d in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == d)
            q = unpack([raw[i] for i in rows.tolist()], d)
            if d in sample:
                x, uids = sample[d]
                s = np.where(uids == quids[rows][:, None], _LOW, products(q, x))
                if s.shape[1] > k:
                    seed[rows] = np.partition(s, s.shape[1] - k, 1)[:, s.shape[1] - k]
            with np.errstate(over="ignore", invalid="ignore"):
                nq = np.sqrt((q * q).sum(1))
            for c in cells[rows[0]]:  # the same of all vectors of a length
                some = rows
                if c["cell"] >= 0:
                    p = pivots[d][c["cell"]]
                    with np.errstate(over="ignore", invalid="ignore"):
                        some = rows[~(_bound(q @ p, 0.0, nq, c["radius"], np.sqrt((p * p).sum())) < seed[rows])]
                m = c["subs"]
                at.append(np.repeat(some, m)), cell.append(np.full(len(some) * m, c["cell"], np.int32)), sub.append(np.tile(np.arange(m, dtype=np.int32), len(some)))
        order = np.concatenate(at) if at else np.zeros(0, np.int64)
        if len(order):
            take = pa.array(order)
            yield pa.RecordBatch.from_arrays([b.column(c).take(take) for c in ("vec_id", "uid", "dim", "raw")] + [pa.array(np.concatenate(cell)), pa.array(np.concatenate(sub)), b.column("cell").take(take), pa.array(seed[order])], ["vec_id", "uid", "dim", "raw", "cell", "sub", "near", "seed"])


_OUT = ("query", "quid", "vec_id", "uid", "score")


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block, its vectors (side 0) before its queries (side 1), queries near each other together."""
    at, tree, own, rows, side = None, None, None, [], 0

    def split(group: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return unpack([r["raw"] for r in group], group[0]["dim"]), np.array([r["vec_id"] for r in group]), np.array([r["uid"] for r in group])

    def ask() -> Iterator[pa.RecordBatch]:
        if rows and tree is not None:
            q, ids, uids = split(rows)
            score, vec, uid = search(tree, *own, q, uids, np.array([r["seed"] for r in rows]), k)
            i, j = np.nonzero(uid >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[i], uids[i], vec[i, j], uid[i, j], score[i, j])], list(_OUT))

    for b in batches:
        for r in b.to_pylist():
            key = (r["dim"], r["cell"], r["sub"])
            if key != at or r["side"] != side or side and len(rows) >= BATCH:
                if side:
                    yield from ask()
                elif key == at:
                    x, *own = split(rows)
                    tree = Tree(x)
                if key != at:
                    tree = None
                at, side, rows = key, r["side"], []
            rows.append(r)
    if side:
        yield from ask()


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int | None = None) -> DataFrame:
    """For each row whose id is divisible by `every`, its k best other rows: query_id, rank (from 1), vec_id, score."""
    ws = Workspace(vectors.sparkSession, "search")
    rows = vectors.select(column(id_col).cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("uid"), column(vector_col).cast("array<double>").alias("vec")).where("vec_id is not null")
    parsed = ws.table(rows.mapInArrow(lambda b: _parsed(b, scale), "vec_id long, uid long, dim int, raw binary"), "parsed")
    same = Window.partitionBy("raw").orderBy("vec_id", "uid")
    reps = ws.table(parsed.withColumn("i", F.row_number().over(same)).where(F.col("i") <= k + 1).drop("i"), "classes")
    n = reps.count()
    block = block or min(BLOCK, max(LEAST_BLOCK, n // PER_CELL))
    cells = min(CELLS, parts_for(n, PER_CELL, 1))
    drawn = reps.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("uid", "dim", "raw").toPandas()
    sample, pivots = {}, {}
    for d, g in drawn.groupby("dim"):
        x = unpack(list(g["raw"]), d)
        sample[d] = (x, g["uid"].to_numpy())
        pivots[d] = x[spread(x, max(1, cells * len(g) // len(drawn)))[0]]
    fields = "vec_id long, uid long, dim int, raw binary"
    dealt = ws.table(reps.mapInArrow(lambda b: _dealt(b, pivots), fields + ", cell int, dist double"), "dealt")
    held = dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("subs"), F.max("dist").alias("radius"))
    held = ws.table(held, "cells")
    sub = F.pmod(F.xxhash64("uid"), F.col("subs")).cast("int")
    data = dealt.join(held.select("dim", "cell", "subs"), ["dim", "cell"]).select("vec_id", "uid", "dim", "raw", "cell", sub.alias("sub"), F.lit(-1).alias("near"), F.lit(0.0).alias("seed"), F.lit(0).alias("side"))
    of_dim = held.groupBy("dim").agg(F.collect_list(F.struct("cell", "subs", "radius")).alias("cells"))
    asked = parsed.where(F.col("vec_id") % every == 0).mapInArrow(lambda b: _dealt(b, pivots), fields + ", cell int, dist double")
    asked = asked.join(of_dim, "dim").select("vec_id", "uid", "dim", "raw", "cell", "cells").mapInArrow(lambda b: _sent(b, pivots, sample, k), fields + ", cell int, sub int, near int, seed double")
    both = data.unionByName(asked.withColumn("side", F.lit(1)))
    met = both.repartition("dim", "cell", "sub").sortWithinPartitions("dim", "cell", "sub", "side", "near", "uid")
    found = met.mapInArrow(lambda b: _searched(b, k), ", ".join(f"{c} long" for c in _OUT))
    best = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id", "uid")
    out = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
