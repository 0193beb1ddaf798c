"""Phrase collocations: word-id suffix arrays by prefix doubling in each shard of texts, n-gram counts from their LCP intervals, merged by key.

A shard is some megabytes of text that a task holds at once. Its words become ids (an exact dictionary of the shard), its suffixes
are sorted by prefix doubling in numpy until ranks cover the longest phrase, and a run of suffixes that share k words is one phrase with its count.
Counts of all shards are summed by (lang, phrase text) in a shuffle, so merging is exact.

Three passes over the texts, as a phrase is no more frequent than any part of it: words; phrases of two frequent words; longer ones
whose neighbours are all frequent pairs. A shard learns what is frequent from two bitmaps of fixed size (2 and 8 MB), filled by hashes.
A bit that is set by chance costs a count that is dropped later, never a phrase: results do not depend on the bitmaps, and a corpus that
outgrows them only shuffles more.

Memory in a task: about 40 bytes a byte of `shard_bytes`. A longer text is cut between words into parts that overlap by the
words a phrase may still reach; a single word longer than that is held whole.

Rows: null texts are empty, a null language is `und` and joins rows that say so. Repeated rows count again. Ties at the end of a
language's list are settled by count, then by phrase in byte order, which is unique. Extra columns are ignored, whatever their names. Empty table: no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, column

SHARD_BYTES = 8 << 20
WORD_BITS, PAIR_BITS = 24, 26
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_GAP = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")
_SCHEMA = "lang string, phrase binary, k int, a long"


def parts(text: bytes, most: int, longest: int) -> Iterator[tuple[bytes, int]]:
    """(bytes, how many of them are the part's own): the rest repeats the words that follow, as far as a phrase reaches."""
    ahead = re.compile(rb"[\x20\x09]*(?:[^\x20\x09.,;:!?\x0A-\x0D]+[\x20\x09]*){0,%d}" % (longest - 1))
    at = 0
    while len(text) - at > most:
        gap = _GAP.search(text, at + most)
        if not gap:
            break
        own = gap.start() - at
        yield text[at : ahead.match(text, gap.start()).end()], own
        at += own
    yield text[at:], len(text) - at


class Shard:
    """The words of some texts of one language: `words` the dictionary, `ids` the tokens, `joined` whether the next token is in the same piece,
    `own` whether a phrase may begin there."""

    def __init__(self, texts: list[tuple[bytes, int]], lang: str):
        data = np.frombuffer(b"\n".join(t for t, _ in texts), np.uint8)
        data = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
        kind = _KIND[data]
        word = kind == 0
        edge = np.diff(np.r_[False, word, False].astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[word])]).dictionary_encode()
        self.lang, self.words = lang, coded.dictionary
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        piece = np.cumsum(kind == 2, dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
        self.joined = np.r_[piece[1:] == piece[:-1], False][: len(starts)]
        self.own = np.ones(len(starts), bool)
        if any(own < len(t) for t, own in texts):
            begins = np.cumsum([0, *(len(t) + 1 for t, _ in texts)])[:-1]
            of = np.searchsorted(begins, starts, side="right") - 1
            self.own = starts - begins[of] < np.array([own for _, own in texts])[of]
        at = zlib.crc32(f"{lang}|".encode())
        self.crc = np.fromiter((zlib.crc32(w, at) for w in self.words.to_pylist()), np.int64, len(self.words))

    def narrowed(self, bits: np.ndarray, pairs: np.ndarray | None) -> None:
        """Leaves the tokens that are frequent, and with pairs those of runs of frequent pairs; joins of the others are cut."""
        good = _set(bits, self.crc & ((1 << WORD_BITS) - 1))[self.ids]
        self.joined &= good & np.r_[good[1:], False]
        if pairs is not None:
            at = np.flatnonzero(self.joined)
            self.joined[at] &= _set(pairs, pair_index(self.crc[self.ids[at]], self.crc[self.ids[at + 1]]))
        keep = self.joined | np.r_[False, self.joined[:-1]]
        self.ids, self.joined, self.own = self.ids[keep], self.joined[keep], self.own[keep]

    def left(self) -> np.ndarray:
        """How many tokens there are from each to the end of its run."""
        ends = np.flatnonzero(~self.joined)
        return np.repeat(ends, np.diff(np.r_[-1, ends])) - np.arange(len(self.ids)) + 1

    def counts(self, shortest: int, longest: int) -> Iterator[pa.RecordBatch]:
        left = self.left()
        order = suffix_order(self.ids, left, longest)
        order = order[self.own[order] & (left[order] >= shortest)]
        common = common_prefixes(self.ids, left, order, longest)
        for k in range(shortest, longest + 1):
            first = np.r_[True, common < k]
            valid = left[order] >= k
            interval = np.cumsum(first) - 1
            n = np.bincount(interval[valid])
            at = order[first]
            at, n = at[: len(n)][n > 0], n[n > 0]
            for s in range(0, len(at), 1 << 17):
                words = [self.words.take(pa.array(self.ids[at[s : s + (1 << 17)] + j])) for j in range(k)]
                phrase = words[0] if k == 1 else pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.binary()))
                m = len(phrase)
                yield pa.RecordBatch.from_arrays([pa.array([self.lang] * m, pa.string()), phrase, pa.array(np.full(m, k, np.int32)), pa.array(n[s : s + m].astype(np.int64))], ["lang", "phrase", "k", "a"])


def suffix_order(ids: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of runs in order of their first `depth` ids at least, by prefix doubling; a run that ends comes first."""
    n, rank, h = len(ids), ids, 1
    order = np.argsort(rank, kind="stable")
    while h < depth and n:
        more = left > h
        key = rank * (n + 1)
        key[more] += rank[np.flatnonzero(more) + h] + 1
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, np.diff(key[order]) != 0])
        h *= 2
    return order


def common_prefixes(ids: np.ndarray, left: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """How many first ids neighbours in the order share, counted up to `most`."""
    a, b = order[:-1], order[1:]
    out, alive = np.zeros(len(a), np.int32), np.ones(len(a), bool)
    for t in range(most):
        alive &= (left[a] > t) & (left[b] > t)
        at = np.flatnonzero(alive)
        alive[at] = ids[a[at] + t] == ids[b[at] + t]
        out += alive
    return out


def pair_index(x, y):
    """The bit of a pair of words, from their CRC; the same in numpy and in Spark."""
    return (x * 31337 + y).bitwiseAND((1 << PAIR_BITS) - 1) if isinstance(x, Column) else (x * 31337 + y) & ((1 << PAIR_BITS) - 1)


def _set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _bitmap(rows: DataFrame, index: Column, size: int) -> bytes:
    """Bits of a fixed number, whatever the rows: at most 2**size / 8 bytes come to the driver."""
    v = rows.select((index + 1).alias("v"))
    held = v.groupBy(F.bitmap_bucket_number("v").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("m")).collect()
    out = bytearray(1 << (size - 3))
    for r in held:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = r["m"]
    return bytes(out)


def _counted(batches: Iterator[pa.RecordBatch], shard_bytes: int, shortest: int, longest: int, words, pairs) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[bytes, int]]] = {}
    size = 0
    bits = np.frombuffer(words.value, np.uint8) if words else None
    two = np.frombuffer(pairs.value, np.uint8) if pairs else None

    def work() -> Iterator[pa.RecordBatch]:
        for lang in list(held):
            shard = Shard(held.pop(lang), lang)
            if bits is not None:
                shard.narrowed(bits, two)
            if len(shard.ids):
                yield from shard.counts(shortest, longest)

    for b in batches:
        langs, texts = b.column("lang").to_pylist(), b.column("text")
        for i, lang in enumerate(langs):
            for part in parts(texts[i].as_py(), shard_bytes, longest):
                held.setdefault(lang, []).append(part)
                size += len(part[0])
                if size >= shard_bytes:
                    yield from work()
                    size = 0
    yield from work()


def cut_score(a: str, n: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)) of four columns of counts, in decimals of 38 digits: exact, as two counts of 63 bits and 1000 take 42 only
    where the corpus has over 10**17 words."""
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    return F.expr(f"cast(({wide(a)} * {wide(n)} * cast(1000 as decimal(4, 0))) div ({wide(l)} * {wide(r)}) as long)")


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The first `top` phrases of 2 to `longest` words of each language: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    ws = Workspace(spark, "phrases")
    rows = docs.select(F.coalesce(column(lang_col).cast("string"), F.lit("und")).alias("lang"), column(text_col).cast("string").cast("binary").alias("text")).where("text is not null")

    def frequent(lo: int, hi: int, tag: str, words=None, pairs=None) -> DataFrame:
        got = rows.mapInArrow(lambda b: _counted(b, shard_bytes, lo, hi, words, pairs), _SCHEMA)
        got = got.groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "k").agg(F.sum("a").alias("a"))
        return got if hi == 1 else ws.table(got.where(F.col("a") >= least), tag)

    every = ws.table(frequent(1, 1, "words").where(F.col("a") > 0), "words")
    totals = every.groupBy("lang").agg(F.sum("a").alias("n"))
    words = ws.table(every.where(F.col("a") >= least), "frequent-words")
    crc = lambda w: F.crc32(F.concat("lang", F.lit("|"), w))
    bits = spark.sparkContext.broadcast(_bitmap(words, crc(F.col("phrase")).bitwiseAND((1 << WORD_BITS) - 1), WORD_BITS))
    pairs = frequent(2, 2, "pairs", bits)
    found = words.unionByName(pairs)
    phrases = pairs
    if longest > 2:
        both = F.split("phrase", " ")
        two = spark.sparkContext.broadcast(_bitmap(pairs, pair_index(crc(both[0]), crc(both[1])), PAIR_BITS))
        more = frequent(3, longest, "longer", bits, two)
        found, phrases = found.unionByName(more), pairs.unionByName(more)

    # what a longer phrase of the same count holds says nothing of its own
    w = F.split("phrase", " ")
    inner = phrases.where("k > 2").select("lang", "a", F.explode(F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")).alias("phrase"))
    kept = phrases.join(inner.distinct(), ["lang", "phrase", "a"], "left_anti")
    cuts = kept.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("*", F.array_join(F.slice(w, 1, F.col("cut")), " ").alias("x"), F.array_join(F.slice(w, F.col("cut") + 1, F.col("k")), " ").alias("y"))
    count = lambda part, name: found.select("lang", F.col("phrase").alias(part), F.col("a").alias(name))
    cuts = cuts.join(count("x", "l"), ["lang", "x"]).join(count("y", "r"), ["lang", "y"]).join(totals, "lang")
    best = cuts.withColumn("score", cut_score("a", "n", "l", "r")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
