"""The trie of conversation prefixes, by MSD radix partitioning over dictionary-encoded turns; multikey quicksort finishes small buckets.

Turns are told apart by 128 bits of a SHA-256 of (role, text); those met more than once get an id from a dictionary, and a turn without an id
ends what its conversation can share. What lies behind is a path of nodes with one member each, made a row at a time. Only the
shared prefixes, an array of ids a conversation, equal ones counted as one string, take part in the recursion:

* A bucket holds the strings that begin with one prefix. Its common prefix is what its least and its greatest string share; those nodes
  come out at once, and the bucket splits by the next id. A pass over all large buckets is one group-by and one join.
* A bucket of at most `local` ids goes to one task, where a multikey quicksort (three ways by the id at a depth, the equal part one deeper) makes
  a node at each step down. Sums over subtrees are taken there bottom up, and for the nodes above pass by pass, the last pass first.

The members that end at a node are joined to text by slices of a range sort and hashed slice by slice, so the largest group is read by many tasks and
only its slices meet in one. A large conversation is numbered by partitions of a range sort.

Memory: `local` ids in a task, or one string that is longer (8 bytes for each shared turn of one conversation); the driver holds no rows.
A pass splits each large bucket at a branch, so passes grow with the branches that lie one above the other on more than `local` ids.

Rows: those without a conversation id take no part, as they belong to none. Null roles and texts are empty. Turns are ordered by number, null first; equal
numbers by the SHA-256 of role and text, which is the same in every run; repeated rows are turns of their own. Extra columns
are ignored, whatever their names. Ids are whole numbers. Empty table: no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, column, n_words

LOCAL = 1 << 12
#: Most bytes of a slice of a list of members.
SLICE = 1 << 20
_NONE = hashlib.sha256(b"").hexdigest()


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and, from 1, the place of a row in its conversation there; rows come sorted by c."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for b in batches:
        c = b.column("c").to_numpy(zero_copy_only=False)
        if not len(c):
            continue
        fresh = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        place = np.arange(len(c)) - np.repeat(fresh, np.diff(np.r_[fresh, len(c)])) + 1
        if last == c[0]:
            place[: fresh[1] if len(fresh) > 1 else len(c)] += seen
        last, seen = int(c[-1]), int(place[-1])
        yield pa.RecordBatch.from_arrays([b.column("c"), b.column("dg"), b.column("w"), pa.array(np.full(len(c), part, np.int32)), pa.array(place.astype(np.int64))], ["c", "dg", "w", "part", "i"])


def turns(conversations: DataFrame, ws: Workspace, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, pos, dg, w): every turn with its place in its conversation, from 1; a written table."""
    role, text = (F.coalesce(column(x).cast("string"), F.lit("")) for x in (role_col, text_col))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = conversations.select(column(conv_col).cast("long").alias("c"), column(turn_col).alias("t"), digest.alias("dg"), n_words(text).alias("w")).where("c is not null")
    by = [F.col("c"), F.col("t").asc_nulls_first(), F.col("dg")]
    placed = ws.table(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_numbered, "c long, dg binary, w long, part int, i long"), "placed")
    spans = placed.groupBy("c", "part").agg(F.max("i").alias("n"))
    before = F.sum("n").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # only the first conversation of a partition can have begun in an earlier one: a row a partition at most
    carried = spans.withColumn("before", before).where("before > 0").select("c", "part", "before")
    out = placed.join(F.broadcast(carried), ["c", "part"], "left")
    return out.select("c", (F.col("i") + F.coalesce("before", F.lit(0))).alias("pos"), "dg", "w")


def rebuilt(placed: DataFrame, ws: Workspace, every: int = 20, most: int = 4) -> DataFrame:
    """(c, pos, dg, w) and turnless rows (pos null): each conversation begins with the first h turns of the one whose id is c - c % every, and
    goes on with its own after its first h; h = crc32(c) % most."""
    convs = placed.groupBy("c").agg(F.max("pos").alias("n"))
    convs = ws.table(convs.select("c", "n", (F.col("c") - F.col("c") % every).alias("base"), (F.crc32(F.col("c").cast("string")) % most).alias("h")), "convs")
    lent = F.least("h", F.coalesce("m", F.lit(0)))
    convs = ws.table(convs.join(convs.select(F.col("c").alias("base"), F.col("n").alias("m")), "base", "left").select("c", "n", "base", "h", lent.alias("b")), "lent")
    own = placed.join(convs.select("c", "h", "b"), "c").where("pos > h").select("c", (F.col("b") + F.col("pos") - F.col("h")).alias("pos"), "dg", "w")
    heads = placed.where(F.expr(f"c % {every} = 0") & (F.col("pos") < most)).withColumnRenamed("c", "base")
    given = heads.join(convs.where("b > 0").select("c", "base", "b"), "base").where("pos <= b").select("c", "pos", "dg", "w")
    bare = convs.where("b = 0 and n <= h").select("c", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("dg"), F.lit(0).cast("long").alias("w"))
    return own.unionByName(given).unionByName(bare)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (k1, k2, c); out: slices of the comma-joined list of each key."""
    key, first, got, size = None, 0, [], 0
    out: list[tuple] = []
    for b in batches:
        for k1, k2, c in zip(*(b.column(x).to_pylist() for x in ("k1", "k2", "c"))):
            if (k1, k2) != key or size > SLICE:
                if got:
                    out.append((*key, first, ",".join(got)))
                key, first, got, size = (k1, k2), c, [], 0
            got.append(str(c))
            size += len(got[-1]) + 1
        if len(out) > 1000 or sum(len(x[3]) for x in out[-8:]) > 4 * SLICE:
            yield _batch(out, ("k1", "k2", "first", "ids"))
            out = []
    if got:
        out.append((*key, first, ",".join(got)))
    if out:
        yield _batch(out, ("k1", "k2", "first", "ids"))


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], list(names))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices come sorted by (k1, k2, first); out: the hash of each whole list."""
    key, h, out = None, None, []
    for b in batches:
        for k1, k2, ids in zip(*(b.column(x).to_pylist() for x in ("k1", "k2", "ids"))):
            if (k1, k2) != key:
                if key:
                    out.append((*key, h.hexdigest()))
                key, h = (k1, k2), hashlib.sha256()
            else:
                h.update(b",")
            h.update(ids.encode())
        if len(out) > 10_000:
            yield _batch(out, ("k1", "k2", "sha"))
            out = []
    if key:
        out.append((*key, h.hexdigest()))
    if out:
        yield _batch(out, ("k1", "k2", "sha"))


_NODE = "kind int, b1 long, b2 long, p1 long, p2 long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, sha string, k1 long, k2 long"
_NODE_NAMES = [x.split()[0] for x in _NODE.split(", ")]


def bucket_nodes(strings: list[dict]) -> tuple[list[list], int, int]:
    """The nodes of one bucket as (depth, low, parent's low, n, children, leaves, saved, sha, k1, k2), its leaves and savings.
    strings: distinct, all with the same first d ids."""
    ids, d0 = [s["ids"] for s in strings], strings[0]["d"]
    nodes: list[list] = []
    up: list[int] = []
    # a step is (strings, depth, parent, whether they agree on the id before that depth)
    todo: list[tuple[list[int], int, int, bool]] = [(list(range(len(strings))), d0, -1, True)]
    while todo:
        rows, d, parent, one = todo.pop()
        if one:
            low = min(strings[r]["low"] for r in rows)
            end = next((r for r in rows if len(ids[r]) == d), None)
            s = strings[end] if end is not None else {"tails": 0, "sha": None, "k1": None, "k2": None}
            above = nodes[parent][1] if parent >= 0 else strings[rows[0]]["plow"]
            n = sum(strings[r]["n"] for r in rows)
            word = strings[rows[0]]["ws"][d - 1] if d else 0
            nodes.append([d, low, above, n, s["tails"], s["tails"], (n - 1) * word, s["sha"], s["k1"], s["k2"]])
            up.append(parent)
            parent = len(nodes) - 1
            rows = [r for r in rows if r != end]
            if not rows:
                continue
        pivot = ids[rows[len(rows) // 2]][d]
        less, same, more = [], [], []
        for r in rows:
            x = ids[r][d]
            (same if x == pivot else less if x < pivot else more).append(r)
        for part in (less, more):
            if part:
                todo.append((part, d, parent, False))
        todo.append((same, d + 1, parent, True))
    for i in range(len(nodes) - 1, -1, -1):  # parents come before their children
        x = nodes[i]
        if not x[4]:
            x[5] = 1
        if up[i] >= 0:
            p = nodes[up[i]]
            p[4] += 1
            p[5] += x[5]
            p[6] += x[6]
    return nodes, nodes[0][5], nodes[0][6]


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings come sorted by bucket; out: its nodes (kind 0) and its sums (kind 1)."""
    out: list[tuple] = []

    def work(group: list[dict]) -> None:
        nodes, leaves, saved = bucket_nodes(group)
        s = group[0]
        at = (s["b1"], s["b2"], s["p1"], s["p2"])
        out.extend((0, *at, *n) for n in nodes)
        out.append((1, *at, None, None, None, None, None, leaves, saved, None, None, None))

    def flush() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), _NODE_TYPES)], _NODE_NAMES)
        out.clear()
        return got

    group: list[dict] = []
    for b in batches:
        for s in b.to_pylist():
            if group and (s["b1"], s["b2"]) != (group[0]["b1"], group[0]["b2"]):
                work(group)
                group = []
                if len(out) > 10_000:
                    yield flush()
            group.append(s)
    if group:
        work(group)
    if out:
        yield flush()


_NODE_TYPES = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in _NODE.split(", ")]


def _key(of: Column) -> tuple[Column, Column]:
    return F.xxhash64(of), F.xxhash64(F.lit(1), of)


def _common(lo: str, hi: str) -> Column:
    """How many first elements two arrays share."""
    least = F.least(F.size(lo), F.size(hi))
    unlike = F.array_position(F.transform(F.slice(F.arrays_zip(lo, hi), 1, least), lambda x: x[lo] == x[hi]), False)
    return F.when(unlike == 0, least).otherwise((unlike - 1).cast("int"))


def trie(rows: DataFrame, ws: Workspace, local: int = LOCAL) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    rows: (c, pos, dg, w), places from 1 without gaps; a row without a place keeps a conversation without turns."""
    rows = ws.table(rows, "turns")
    met = rows.where("pos is not null").groupBy("dg").agg(F.count("*").alias("n")).where("n > 1")
    words = ws.table(met.select("dg", F.monotonically_increasing_id().alias("id")), "dictionary")
    coded = ws.table(rows.join(words, "dg", "left").select("c", "pos", "w", "id"), "coded")
    ws.drop(rows, words)
    convs = coded.groupBy("c").agg(F.coalesce(F.max("pos"), F.lit(0)).alias("depth"), F.min(F.when(F.col("id").isNull(), F.col("pos"))).alias("cut"))
    convs = ws.table(convs.select("c", "depth", F.coalesce(F.col("cut") - 1, "depth").alias("shared")), "convs-shared")
    pre = coded.where("id is not null").join(convs, "c").where("pos <= shared").groupBy("c").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "w"))).alias("x"))
    none = F.array().cast("array<long>")
    pre = convs.join(pre, "c", "left").select("c", "depth", "shared", F.coalesce("x.id", none).alias("ids"), F.coalesce("x.w", none).alias("ws"))
    k1, k2 = _key(F.col("ids"))
    pre = ws.table(pre.withColumns({"k1": k1, "k2": k2}), "prefixes")

    over = pre.where("depth = shared").select("k1", "k2", "c")
    slices = over.repartitionByRange("k1", "k2", "c").sortWithinPartitions("k1", "k2", "c").mapInArrow(_joined, "k1 long, k2 long, first long, ids string")
    slices = ws.table(slices, "members")
    shas = slices.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_hashed, "k1 long, k2 long, sha string")
    strings = pre.groupBy("k1", "k2", "ids").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.count_if(F.col("depth") > F.col("shared")).alias("tails"), F.first("ws").alias("ws"))
    strings = strings.join(shas, ["k1", "k2"], "left")
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    left = ws.table(strings.select("*", zero.alias("b1"), zero.alias("b2"), null.alias("p1"), null.alias("p2"), F.lit(0).alias("d"), null.alias("plow")), "strings")
    ws.drop(slices)

    small, passes = [], []
    at = ["b1", "b2"]
    while True:
        held = left.groupBy(*at).agg(F.sum(F.size("ids") - F.col("d") + 1).alias("weight"), F.min("ids").alias("lo"), F.max("ids").alias("hi"), F.sum("n").alias("all"), F.min("low").alias("least"))
        large = ws.table(held.where(F.col("weight") > local).select(*at, _common("lo", "hi").alias("lcp"), "all", "least"), "large")
        if not large.limit(1).count():
            small.append(left)
            break
        marked = ws.table(left.join(large, at, "left"), "marked")
        small.append(marked.where("lcp is null").select(*left.columns))
        here = marked.where("lcp is not null")
        ends = F.col("lcp") == F.size("ids")
        pick = lambda c: F.max(F.when(ends, F.col(c))).alias(c)  # noqa: E731  at most one string of a bucket ends there
        passes.append(here.groupBy(*at, "p1", "p2", "d", "plow", "lcp", "all", "least").agg(F.first(F.slice("ws", 1, F.col("lcp"))).alias("ws"), pick("tails"), pick("sha"), pick("k1"), pick("k2")))
        c1, c2 = _key(F.slice("ids", 1, F.col("lcp") + 1))
        deeper = here.where(~ends).select("k1", "k2", "ids", "n", "low", "tails", "ws", "sha", c1.alias("b1"), c2.alias("b2"), F.col("b1").alias("p1"), F.col("b2").alias("p2"), (F.col("lcp") + 1).alias("d"), F.col("least").alias("plow"))
        left = ws.table(deeper, "deeper")

    every = small[0]
    for s in small[1:]:
        every = every.unionByName(s)
    fields = ["b1", "b2", "p1", "p2", "d", "plow", "ids", "ws", "n", "low", "tails", "sha", "k1", "k2"]
    done = ws.table(every.select(*fields).repartition(*at).sortWithinPartitions(*at).mapInArrow(_finished, _NODE), "nodes")
    kept = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "sha", "k1", "k2"]
    out = done.where("kind = 0").select(*kept)
    sums = done.where("kind = 1").select(*at, "p1", "p2", "n_leaves", "saved_tokens")
    for top in reversed(passes):
        below = sums.groupBy(F.col("p1").alias("b1"), F.col("p2").alias("b2")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count("*").alias("buckets"))
        tails = F.coalesce("tails", F.lit(0))
        # the nodes of a common prefix, from its top (depth d) to its foot (depth lcp); the root has no word
        path = top.join(below, at, "left").fillna(0, ["leaves", "saved", "buckets"]).withColumn("j", F.explode(F.sequence("d", "lcp"))).withColumn("own", (F.col("all") - 1) * F.when(F.col("j") > 0, F.get("ws", F.col("j") - 1)).otherwise(0))
        up = Window.partitionBy(*at).orderBy(F.desc("j"))
        foot = F.col("j") == F.col("lcp")
        only = lambda c: F.when(foot, F.col(c)).alias(c)
        path = path.select(*at, "p1", "p2", "d", F.col("j").cast("long").alias("depth"), F.col("least").alias("conv_id"), F.when(F.col("j") == F.col("d"), F.col("plow")).otherwise(F.col("least")).alias("parent_conv_id"),
                           F.col("all").alias("n_convs"), F.when(foot, F.col("buckets") + tails).otherwise(1).alias("n_children"), F.when(F.col("buckets") + tails > 0, F.col("leaves") + tails).otherwise(1).alias("n_leaves"), (F.col("saved") + F.sum("own").over(up)).alias("saved_tokens"), only("sha"), only("k1"), only("k2"))
        path = ws.table(path, "path")
        out = out.unionByName(path.select(*kept))
        sums = sums.unionByName(path.where("depth = d").select(*sums.columns))

    lows = out.where("k1 is not null").select("k1", "k2", F.col("conv_id").alias("above"))
    ended = pre.where("depth > shared").select("c", "depth", "shared", "k1", "k2").join(lows, ["k1", "k2"])
    alone = coded.join(ended.select("c", "depth", "shared", "above"), "c").where("pos > shared")
    one, last = F.lit(1).cast("long"), F.col("pos") == F.col("depth")
    alone = alone.select("c", "pos", F.when(F.col("pos") == F.col("shared") + 1, F.col("above")).otherwise(F.col("c")), one, F.when(last, 0).otherwise(1).cast("long"), one, zero, F.when(last, F.sha2(F.col("c").cast("string").cast("binary"), 256)).otherwise(_NONE))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    shared = out.select(*names[:-1], F.coalesce("sha", F.lit(_NONE)).alias("ends_sha256"))
    return shared.unionByName(alone.toDF("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
