"""The inverted index: postings and the statistics that ranking needs.

Statistics cover every row of the table, deleted ones too; narrowing comes after ranking. The index is a plain DataFrame; `save` writes it
where it is made, in runs in order of term, so that nothing is shuffled and a query reads the pages of its words only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.porter import stem, stem_udf

COLUMNS = ("title", "content", "tool_name", "type", "project", "topic_key")
#: Postings that are put in order of term together, in memory.
RUN = 1 << 20


def _by_term(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    t = pa.Table.from_batches(batches).combine_chunks()
    words = t.column("term").combine_chunks().dictionary_encode()
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    place = np.empty(len(words.dictionary), np.int64)
    place[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(len(place))
    order = np.argsort(place[words.indices.to_numpy()], kind="stable")
    return t.take(pa.array(order)).to_batches(max_chunksize=1 << 16)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= RUN:
            yield from _by_term(held)
            held, n = [], 0
    if n:
        yield from _by_term(held)


def in_runs(postings: DataFrame) -> DataFrame:
    """The postings in order of term, run by run, each where it is: no shuffle, and no sort that spills."""
    return postings.mapInArrow(_runs, postings.schema)


def _posted(batches: Iterator[pa.RecordBatch], stemmed: bool) -> Iterator[pa.RecordBatch]:
    """The postings of (doc_id, col, terms); of a stemmed index, each different word of a batch is stemmed once."""
    for b in batches:
        lists = b.column("terms")
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(size)), size)
        pos = (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        words = lists.flatten()
        if stemmed:
            each = words.dictionary_encode()
            words = pa.array(map(stem, each.dictionary.to_pylist()), pa.string()).take(each.indices)
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("col").take(at), pa.array(pos), words], ["doc_id", "col", "pos", "term"])


@dataclass(frozen=True)
class Index:
    """postings(doc_id, col, pos, term) and docstats(doc_id, n_tokens). runs: the postings come in order of term, run by run, already.
    of: the rows, the columns and the id column that it is built from, where it is a plan over them and its terms are not stemmed."""

    postings: DataFrame
    docstats: DataFrame
    stemmed: bool = False
    runs: bool = field(default=False, kw_only=True)
    of: tuple[DataFrame, tuple[str, ...], str] | None = field(default=None, kw_only=True, compare=False, repr=False)

    def termstats(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.countDistinct("doc_id").alias("n_docs"))

    def totals(self) -> DataFrame:
        """One row: n_docs and the mean length."""
        return self.docstats.agg(F.count("*").alias("n_docs"), F.avg("n_tokens").alias("avgdl"))

    def words(self, terms: DataFrame) -> DataFrame:
        """Query words as the index spells them."""
        return terms.withColumn("term", stem_udf("term")) if self.stemmed else terms

    def word(self, term: str) -> str:
        """A query word as the index spells it."""
        return stem(term) if self.stemmed else term

    def save(self, path: str) -> None:
        """A file for each task that makes postings, so a document is in one file and a word in all; the pages of a file say which words are in them."""
        (self.postings if self.runs else in_runs(self.postings)).write.mode("overwrite").parquet(f"{path}/postings")
        self.docstats.write.mode("overwrite").parquet(f"{path}/docstats")

    @staticmethod
    def load(spark, path: str, stemmed: bool = False) -> "Index":
        return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docstats"), stemmed)

    def refresh(self, changed: DataFrame, removed: DataFrame | None = None, columns: tuple[str, ...] = COLUMNS, id_col: str = "id") -> "Index":
        """The index after rows were added or changed (as they are now) or removed (ids)."""
        gone = changed.select(F.col(id_col).alias("doc_id"))
        if removed is not None:
            gone = gone.unionByName(removed.select(F.col(id_col).alias("doc_id")))
        new = build(changed, columns, id_col, self.stemmed)
        return Index(self.postings.join(gone, "doc_id", "left_anti").unionByName(new.postings), self.docstats.join(gone, "doc_id", "left_anti").unionByName(new.docstats), self.stemmed)


def build(rows: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "id", stemmed: bool = False) -> Index:
    """Index of the columns that the rows have: one pass over the rows."""
    there = [c for c in columns if c in rows.columns]
    read = [F.struct(F.lit(c).alias("col"), T.tokens(F.col(c)).alias("terms")) for c in there]
    each = rows.select(F.col(id_col).alias("doc_id"), F.explode(F.array(*read)).alias("c")).select("doc_id", "c.col", "c.terms")
    schema = f"doc_id {each.schema['doc_id'].dataType.simpleString()}, col string, pos int, term string"
    postings = each.mapInArrow(lambda batches: _runs(_posted(batches, stemmed)), schema)
    n = sum((F.size(T.tokens(F.col(c))) for c in there), F.lit(0))
    return Index(postings, rows.select(F.col(id_col).alias("doc_id"), n.cast("long").alias("n_tokens")), stemmed, runs=True, of=None if stemmed else (rows, tuple(there), id_col))
