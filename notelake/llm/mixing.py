"""Mixing sources to target weights by pivotal dependent rounding of copies.

Every document of a source has the same copy number f = target / size of the source; it gets floor(f) copies and, with its
fraction, one more. The fractions are rounded dependently: two documents pass words between their fractions, at random but
without changing the expectation of either, until one fraction is 0 or 1. The sum of words stays as it was, so a source ends within
one document of its target, and that one is small: see copies. Documents meet in groups of bounded size, dealt by a hash of the row within the source; each group
leaves one open fraction, and those meet again in groups, level by level, up to one a source: a reduction tree, in which no task
ever holds a whole source. Random choices are keyed hashes of the two rows, so reruns agree. A row is known by its id, a hash of its text and source,
and a number among rows equal in both, so rows that share an id, or have none, are dealt like others.

Rows: a null text has size 0, takes nothing. Null sources are one source, ranked last. Repeated rows are rounded each for
itself; among equals the result does not depend on their order. Empty table: empty result. A source without words has target 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, column, free_name, n_words

GROUP = 256
SLICE = 4096
KEY = ("k1", "k2", "nth")
#: A document is large if it has more than one in LARGE of its source's words.
LARGE = 500
#: Rows of sources up to which the table of sources is broadcast; above, it is joined by a shuffle. A row is under 1 KB.
BROADCAST_ROWS = 1000


def targets(sizes: DataFrame, source: str, weights: tuple[float, ...], most: float, ws: Workspace) -> DataFrame:
    """(source, source_size, n, target). Sources are ranked in order of their code points by a range sort with per-partition
    offsets, so the table of sources may itself be large. The shares are capped in rounds; each needs one row of sums."""
    per = ws.table(sizes.groupBy(source).agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    ordered = per.repartitionByRange(F.col(source).asc_nulls_last()).sortWithinPartitions(F.col(source).asc_nulls_last())
    at = ws.table(ordered.withColumn("_m", F.monotonically_increasing_id()), "ranked")
    pid, inside = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    counts = at.groupBy(pid.alias("p")).count().collect()  # one row a partition
    base, total = {}, 0
    for r in sorted(counts, key=lambda r: r["p"]):
        base[r["p"]], total = total, total + r["count"]
    pairs = [x for k, v in base.items() for x in (F.lit(k), F.lit(v))]
    rank = inside + (F.create_map(*pairs)[pid] if pairs else F.lit(0))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    out = ws.table(at.withColumn("weight", w).drop("_m"), "weighted")
    cap = most * F.col("source_size")
    whole = out.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    level, below = None, None
    while True:  # each round caps at least one more source, or ends
        free = F.lit(True) if level is None else F.col("weight") * F.lit(level) <= cap
        r = out.agg(F.sum(F.when(free, F.col("weight"))).alias("w"), F.sum(F.when(~free, F.col("source_size"))).alias("capped"), F.count(F.when(free, 1)).alias("k")).first()
        if not r["k"] or r["k"] == below:
            break
        level, below = max(level or 0.0, (whole - most * (r["capped"] or 0)) / r["w"]), r["k"]
    target = F.least(F.col("weight") * F.lit(level or 0.0), cap).cast("double")
    return out.select(source, "source_size", "n", target.alias("target"))


def chance(seed: str, a: tuple, b: tuple) -> float:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{a}:{b}".encode(), digest_size=8).digest(), "big") / 2**64


def duel(rows: list[list], seed: str) -> None:
    """rows: [key, size, p, ...] with p changed in place so that at most one stays strictly between 0 and 1. Sum of size * p and
    every expectation of p are kept, but for rounding of floats."""
    held = None
    for row in rows:
        if not 0 < row[2] < 1:
            continue
        if held is None:
            held = row
            continue
        a, b = held, row
        up = min((1 - a[2]) * a[1], b[2] * b[1])  # words that can go from b to a
        down = min(a[2] * a[1], (1 - b[2]) * b[1])  # and from a to b
        if chance(seed, a[0], b[0]) * (up + down) < down:
            full, empty = (1 - a[2]) * a[1] <= b[2] * b[1], (1 - a[2]) * a[1] >= b[2] * b[1]
            a[2] = 1.0 if full else a[2] + up / a[1]
            b[2] = 0.0 if empty else b[2] - up / b[1]
        else:
            empty, full = a[2] * a[1] <= (1 - b[2]) * b[1], a[2] * a[1] >= (1 - b[2]) * b[1]
            a[2] = 0.0 if empty else a[2] - down / a[1]
            b[2] = 1.0 if full else b[2] + down / b[1]
        for x in (a, b):
            if x[2] < 1e-9 or x[2] > 1 - 1e-9:
                x[2] = float(round(x[2]))
        held = next((x for x in (a, b) if 0 < x[2] < 1), None)


def _level(batches: Iterator[pa.RecordBatch], seed: str) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; a group may go on in the next batch."""
    key, rows = None, []

    out: list = []
    for batch in batches:
        for g, s, i, size, whole, p, h, r in zip(*(batch.column(i).to_pylist() for i in range(8))):
            if (s, g) != key:
                out += _settled(rows, seed)
                key, rows = (s, g), []
            rows.append([(i, h, r), size, p, s, whole])
        if len(out) > 50_000:
            yield _batch(out)
            out = []
    out += _settled(rows, seed)
    if out:
        yield _batch(out)


def _settled(rows: list[list], seed: str) -> list[list]:
    rows.sort(key=lambda r: (-r[1], r[0]))  # large ones first: they meet their like
    duel(rows, seed)
    return rows


def _batch(rows: list[list]) -> pa.RecordBatch:
    key, size, p, s, whole = zip(*rows)
    ints = [pa.array(x, pa.int64()) for x in (s, *zip(*key), size, whole)]
    return pa.RecordBatch.from_arrays([*ints, pa.array(p, pa.float64())], ["s", *KEY, "size", "whole", "p"])


def rounded(rows: DataFrame, largest: int, seed: str, ws: Workspace) -> DataFrame:
    """(s, k1, k2, nth, size, copies) of rows (s, k1, k2, nth, size, f); largest: the most rows that a source has."""
    whole = F.floor("f").cast("long")
    open_rows = rows.select("s", *KEY, "size", whole.alias("whole"), (F.col("f") - whole).alias("p"))
    plain = (F.col("size") == 0) | (F.col("p") <= 1e-9) | (F.col("p") >= 1 - 1e-9)
    out = open_rows.where(plain).withColumn("p", F.when((F.col("size") > 0) & (F.col("p") > 0.5), F.lit(1.0)).otherwise(F.lit(0.0)))
    open_rows = open_rows.where(~plain)
    still = (F.col("p") > 0) & (F.col("p") < 1)
    groups, level = -(-largest // GROUP), 0
    while True:
        deal = F.pmod(F.xxhash64(F.lit(f"{seed}{level}"), *KEY), F.lit(max(1, groups)).cast("long"))
        dealt = open_rows.select(deal.alias("g"), "s", "k1", "size", "whole", "p", "k2", "nth").repartition("s", "g").sortWithinPartitions("s", "g")
        got = ws.table(dealt.mapInArrow(lambda b: _level(b, f"{seed}{level}"), "s long, k1 long, k2 long, nth long, size long, whole long, p double"), f"{seed}{level}")
        out, open_rows = out.unionByName(got.where(~still)), got.where(still)
        if groups <= 1:
            break
        groups, level = -(-groups // GROUP), level + 1
    alone = F.pmod(F.xxhash64(F.lit(f"{seed}last"), *KEY), F.lit(1 << 40)) / F.lit(float(1 << 40)) < F.col("p")
    out = out.unionByName(open_rows.withColumn("p", F.when(alone, F.lit(1.0)).otherwise(F.lit(0.0))))
    return out.select("s", *KEY, "size", (F.col("whole") + F.col("p").cast("long")).alias("copies"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: str = "mix") -> DataFrame:
    """One row per document: id, size, source_size, target, copies, taken (copies * size).

    Documents of over 1 / LARGE of their source, of which a source has fewer than LARGE, are rounded first; the others share
    what is then left of the target, so the error that a large document leaves open is made good by the small ones.
    """
    kind = docs.schema[id_col].dataType
    out = _drawn(docs, id_col, text_col, source_col, weights, most, seed)
    return out.select(F.when(F.col("k1") != -(2**63), F.col("k1")).cast(kind).alias("id"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _key(id_col: str, text_col: str, source_col: str) -> tuple[Column, Column]:
    """Rows equal in both are equal in id, text and source, but for a collision of 64 bits under one id."""
    return F.coalesce(column(id_col).cast("long"), F.lit(-(2**63))), F.xxhash64(column(text_col).cast("string"), column(source_col))


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows, equal ones with a number each: counted before the shuffle, then dealt out again in slices, so that no task holds all
    rows of an id."""
    m = rows.groupBy("k1", "k2", "source", "size").agg(F.count("*").alias("m"))
    slices = m.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(SLICE).cast("long"))))
    nth = F.sequence(F.col("_from"), F.least(F.col("_from") + SLICE, "m") - 1)
    return slices.select("k1", "k2", F.explode(nth).alias("nth"), "source", "size")


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], most: float, seed: str) -> DataFrame:
    """(k1, k2, nth, size, source_size, target, copies)."""
    ws = Workspace(docs.sparkSession, "mixing")
    k1, k2 = _key(id_col, text_col, source_col)
    sized = ws.table(_numbered(docs.select(k1.alias("k1"), k2.alias("k2"), column(source_col).alias("source"), n_words(column(text_col)).alias("size"))), "sizes")
    per = ws.table(targets(sized, "source", weights, most, ws).withColumn("s", F.monotonically_increasing_id()), "targets")
    n_sources, largest = per.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    small = lambda df: F.broadcast(df) if n_sources <= BROADCAST_ROWS else df
    side = small(per)
    rows = sized.join(side, sized["source"].eqNullSafe(side["source"])).select(*KEY, "size", "s", "source_size", "target")
    large = F.col("size") * LARGE > F.col("source_size")
    f = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    first = ws.table(rounded(rows.where(large).select("s", *KEY, "size", f.alias("f")), min(largest, LARGE), f"{seed}-large", ws), "large")
    gone = first.groupBy("s").agg(F.sum("size").alias("large_size"), F.sum(F.col("size") * F.col("copies")).alias("large_taken"))
    left = F.col("source_size") - F.coalesce("large_size", F.lit(0))
    rest = F.when(left > 0, (F.col("target") - F.coalesce("large_taken", F.lit(0))) / left).otherwise(F.lit(0.0))
    per2 = ws.table(per.join(small(gone), "s", "left").select("s", "source_size", "target", F.least(F.greatest(rest, F.lit(0.0)), F.lit(float(most))).alias("f")), "rest")
    others = rows.where(~large).select(*KEY, "size", "s").join(small(per2.select("s", "f")), "s").select("s", *KEY, "size", "f")
    drawn = first.unionByName(rounded(others, largest, seed, ws))
    return drawn.join(small(per.select("s", "source_size", "target")), "s")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: str = "mix") -> DataFrame:
    """The documents of the mix with the columns of the input, each as often as it is taken. Rows equal in id, text and source
    are one document here, whose copies are added up; where other columns differ, one of them stands for it."""
    ws = Workspace(docs.sparkSession, "mixed")
    drawn = _drawn(docs, id_col, text_col, source_col, weights, most, seed)
    key, taken = free_name(docs, "key"), free_name(docs, "taken")
    per = drawn.groupBy("k1", "k2").agg(F.sum("copies").alias("c"), F.count("*").alias("rows")).where("c > 0")
    per = ws.table(per, "copies")
    k1, k2 = _key(id_col, text_col, source_col)
    found = docs.withColumn(key, F.struct(k1.alias("k1"), k2.alias("k2"))).join(per.select(F.struct("k1", "k2").alias(key), F.struct("c", "rows").alias(taken)), key)
    if not per.where("rows > 1").isEmpty():
        one = F.col(taken)["rows"] == 1
        found = found.where(one).unionByName(found.where(~one).dropDuplicates([key]))
    copy = free_name(docs, "copy")
    return found.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(taken)["c"]))).select(*(column(c) for c in docs.columns))
