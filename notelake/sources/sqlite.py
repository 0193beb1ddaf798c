"""SQLite stores as a data source: a file or a folder of files, read by rowid ranges and written by tasks.

`spark.read.format("sqlite_store").option("table", t).load(path)` after `register(spark)`. A partition is a range of about `rows` rows of one file
(option, 100,000), cut by walking the rowids; tables without rowids and views are one partition a file. A schema given to the reader names the
columns that are read. Comparisons with numbers and strings, IN (not for doubles) and null tests given as the option `filters` run in SQLite; they are an option, as
Spark 4.1 keeps filters that it pushes to a Python source with the relation, and another read of the same frame then lacks rows. Writing makes one file a task under a
draft name, which the commit renames, so a task that is run again leaves nothing that readers see.

Columns have their declared types: integers long, BOOL boolean, floats double, BLOB binary, anything else string (times stay text, as SQLite has none).
A number in a string column is read as its text; a value that its column's type cannot hold is an error that names the column, never a null.
Files of a folder that lack the table give no rows, those that lack a column nulls; a column of different types in two files is a string. Bytes that are no UTF-8 become U+FFFD.
The path must be one that all tasks can open: a mounted folder.
"""

from __future__ import annotations

import json
import math
import os
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as t
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..session import shared_folder

NAME, ROWS = "sqlite_store", 100_000
BATCH_ROWS, BATCH_BYTES = 8192, 8 << 20
_ARROW = {t.LongType(): pa.int64(), t.DoubleType(): pa.float64(), t.BooleanType(): pa.bool_(), t.BinaryType(): pa.binary(), t.StringType(): pa.string()}
_OPS = {**{op: f"{op} ?" for op in ("=", ">", ">=", "<", "<=")}, "in": "IN", "null": "IS NULL", "not null": "IS NOT NULL"}
_FITS = {t.LongType(): (int,), t.DoubleType(): (int, float), t.StringType(): (str,)}


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(SqliteSource)


def local(path: str) -> str:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"SQLite cannot open {path!r}: the path must be a mounted folder")
    return path


def _open(path: str) -> sqlite3.Connection:
    db = sqlite3.connect(f"file:{_uri(path)}?mode=ro", uri=True)
    db.text_factory = lambda b: b.decode("utf-8", "replace")
    return db


def _uri(path: str) -> str:
    from urllib.parse import quote

    return quote(path)


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def _files(path: str) -> list[str]:
    path = local(path)
    if os.path.isdir(path):
        return sorted(os.path.join(path, x) for x in os.listdir(path) if x.endswith(".db") and not x.startswith("."))
    if not os.path.exists(path):
        raise ValueError(f"there is no SQLite file at {path!r}")
    return [path]


def _declared(kind: str) -> t.DataType:
    k = kind.upper()
    for parts, made in ((("BOOL",), t.BooleanType()), (("INT",), t.LongType()), (("CHAR", "CLOB", "TEXT"), t.StringType()), (("BLOB",), t.BinaryType()), (("REAL", "FLOA", "DOUB"), t.DoubleType())):
        if any(p in k for p in parts):
            return made
    return t.StringType()


def _columns(db: sqlite3.Connection, table: str) -> dict[str, t.DataType]:
    return {r[1]: _declared(r[2]) for r in db.execute(f"PRAGMA table_info({_name(table)})")}


@dataclass
class Range(InputPartition):
    """Rows of one file; low and high are rowids, high excluded; none: open, key none: the whole table."""

    file: str
    key: str | None = None
    low: int | None = None
    high: int | None = None


def ranges(file: str, table: str, rows: int) -> list[Range]:
    """The ranges of a table. The walk skips from bound to bound over the table's own tree and reads no column."""
    db = _open(file)
    try:
        kind = db.execute("SELECT type FROM sqlite_master WHERE name = ? AND type IN ('table', 'view')", (table,)).fetchone()
        if kind is None:
            return []
        taken = {c.lower() for c in _columns(db, table)}
        key = next((k for k in ("rowid", "_rowid_", "oid") if k not in taken), None)
        if kind[0] == "view" or key is None:
            return [Range(file)]
        try:
            at = db.execute(f"SELECT min({key}) FROM {_name(table)}").fetchone()[0]
        except sqlite3.OperationalError:  # WITHOUT ROWID
            return [Range(file)]
        if at is None:
            return []
        step, bounds = f"SELECT {key} FROM {_name(table)} WHERE {key} >= ? ORDER BY {key} LIMIT 1 OFFSET ?", [None]
        while (row := db.execute(step, (at, rows)).fetchone()) is not None:
            at = row[0]
            bounds.append(at)
        return [Range(file, key, lo, hi) for lo, hi in zip(bounds, [*bounds[1:], None])]
    finally:
        db.close()


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _table(self) -> str:
        if not self.options.get("table"):
            raise ValueError("the option 'table' names the table")
        return self.options["table"]

    def schema(self) -> t.StructType:
        out: dict[str, t.DataType] = {}
        for f in _files(self.options["path"]):
            db = _open(f)
            for c, k in _columns(db, self._table()).items():
                out[c] = k if out.get(c, k) == k else t.StringType()
            db.close()
        if not out:
            raise ValueError(f"no file has a table {self._table()!r}")
        return t.StructType([t.StructField(c, k) for c, k in out.items()])

    def reader(self, schema: t.StructType) -> "SqliteReader":
        return SqliteReader(self.options["path"], self._table(), int(self.options.get("rows", ROWS)), schema, json.loads(self.options.get("filters", "[]")))

    def writer(self, schema: t.StructType, overwrite: bool) -> "SqliteWriter":
        return SqliteWriter(local(self.options["path"]), self._table(), schema, overwrite)


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, rows: int, schema: t.StructType, filters: list[tuple] = ()):
        odd = [f.name for f in schema if f.dataType not in _ARROW]
        if odd or rows < 1:
            raise ValueError(f"SQLite holds long, double, boolean, string and binary: {odd}" if odd else "rows must be positive")
        self.path, self.table, self.rows, self.schema = path, table, rows, schema
        self.tests = [self._test(*f) for f in filters]

    def _test(self, column: str, op: str, value) -> tuple[str, str, list]:
        """A comparison in SQL with its values, if SQLite compares such a column as Spark does."""
        kind = next((f.dataType for f in self.schema if f.name == column), None)
        values = value if op == "in" else [] if op in ("null", "not null") else [value]
        fit = all(type(v) in _FITS.get(kind, ()) and not (isinstance(v, float) and not math.isfinite(v)) for v in values)
        if kind is None or op not in _OPS or not fit or op == "in" and kind == t.DoubleType():
            raise ValueError(f"SQLite cannot test {column!r} {op} {value!r}")
        if op == "in":  # one parameter whatever the number of values
            return column, "IN (SELECT value FROM json_each(?))", [json.dumps(values)]
        return column, _OPS[op], values

    def partitions(self) -> list[Range]:
        return [r for f in _files(self.path) for r in ranges(f, self.table, self.rows)] or [Range("")]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:  # no rows anywhere
            return
        db = _open(partition.file)
        there = _columns(db, self.table)

        def value(c: str) -> str:
            if c not in there:
                return "NULL"
            text = next(f.dataType for f in self.schema if f.name == c) == t.StringType()
            return f"CAST({_name(c)} AS TEXT) COLLATE BINARY" if text else _name(c)

        tests, args = [], []
        for c, test, values in self.tests:
            tests.append(f"{value(c)} {test}")
            args += values
        for op, bound in ((">=", partition.low), ("<", partition.high)):
            if bound is not None:
                tests.append(f"{partition.key} {op} ?")
                args.append(bound)
        columns = ", ".join(value(f.name) for f in self.schema) or "1"
        where = f" WHERE {' AND '.join(tests)}" if tests else ""
        held, size = [], 0
        for row in db.execute(f"SELECT {columns} FROM {_name(self.table)}{where}", args):
            held.append(row)
            size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
            if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)
        db.close()

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        made = []
        for f, values in zip(self.schema, zip(*rows)):
            if f.dataType == t.BooleanType() and all(v in (0, 1, None) for v in values):
                values = [None if v is None else v == 1 for v in values]
            try:
                made.append(pa.array(values, _ARROW[f.dataType], from_pandas=False))
            except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError) as e:
                raise ValueError(f"column {f.name!r} of {self.table!r} holds a value that is no {f.dataType.simpleString()}") from e
        return pa.RecordBatch.from_arrays(made, names=[f.name for f in self.schema])


@dataclass
class Written(WriterCommitMessage):
    draft: str
    rows: int


_KINDS = {t.LongType: "INTEGER", t.IntegerType: "INTEGER", t.ShortType: "INTEGER", t.ByteType: "INTEGER", t.BooleanType: "BOOLEAN", t.DoubleType: "REAL", t.FloatType: "REAL", t.StringType: "TEXT", t.BinaryType: "BLOB", t.TimestampType: "TIMESTAMP"}


class SqliteWriter(DataSourceWriter):
    """One file a task. Times are written as text in UTC; types that SQLite lacks are refused."""

    def __init__(self, folder: str, table: str, schema: t.StructType, overwrite: bool):
        odd = [f.name for f in schema if type(f.dataType) not in _KINDS]
        if odd:
            raise ValueError(f"SQLite cannot hold the columns {odd}")
        os.makedirs(folder, exist_ok=True)
        self.folder, self.table, self.columns, self.overwrite = folder, table, [(f.name, _KINDS[type(f.dataType)]) for f in schema], overwrite

    def write(self, iterator: Iterator) -> Written:
        from datetime import timezone

        times = [i for i, (_, k) in enumerate(self.columns) if k == "TIMESTAMP"]
        draft, n = os.path.join(self.folder, f".{uuid.uuid4().hex}.draft"), 0

        def rows() -> Iterator[tuple]:
            nonlocal n
            for r in iterator:
                row = list(r)
                for i in times:
                    if row[i] is not None:
                        # without a zone, the value is in the worker's own
                        row[i] = row[i].astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
                n += 1
                yield tuple(row)

        db = sqlite3.connect(draft, isolation_level=None)
        db.execute("PRAGMA journal_mode = OFF")
        db.execute("PRAGMA synchronous = OFF")
        db.execute(f"CREATE TABLE {_name(self.table)} ({', '.join(f'{_name(c)} {k}' for c, k in self.columns)})")
        db.execute("BEGIN")
        db.executemany(f"INSERT INTO {_name(self.table)} VALUES ({', '.join('?' * len(self.columns))})", rows())
        db.execute("COMMIT")
        db.close()
        return Written(draft, n)

    def commit(self, messages: list[Written | None]) -> None:
        old = _files(self.folder) if self.overwrite else []
        for m in messages:
            if m is not None:
                os.replace(m.draft, os.path.join(self.folder, f"{uuid.uuid4().hex}.db"))
        for f in old:
            os.remove(f)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.draft):
                os.remove(m.draft)


def snapshot(spark: SparkSession, path: str) -> str:
    """A copy of one SQLite file in the shared folder as it is at one moment, page by page, whatever others write meanwhile."""
    to = f"{local(shared_folder(spark))}/notelake-sqlite-{uuid.uuid4().hex}.db"
    os.makedirs(os.path.dirname(to), exist_ok=True)
    source, target = _open(local(path)), sqlite3.connect(to)
    source.backup(target)
    source.close()
    target.close()
    return to


def load(spark: SparkSession, path: str, table: str, rows: int = ROWS, filters: list[tuple] = ()) -> DataFrame:
    """A table, or its rows that pass all filters: (column, one of = > >= < <= in "null" "not null", value)."""
    register(spark)
    return spark.read.format(NAME).option("table", table).option("rows", rows).option("filters", json.dumps(list(filters))).load(path)


def read_tables(spark: SparkSession, path: str, tables: tuple[str, ...]) -> dict[str, DataFrame]:
    """The tables of one store that it has, all of one moment."""
    at = snapshot(spark, path)
    db = _open(at)
    there = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
    db.close()
    return {x: load(spark, at, x) for x in tables if x in there}
