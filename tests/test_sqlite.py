"""SQLite stores as a data source, against the rows that SQLite itself gives."""

import os
import sqlite3

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from notelake.operators import quality
from notelake.sources import adapters as D
from notelake.sources import exchange, sqlite


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    at = tmp_path_factory.mktemp("sqlite") / "s #1.db"
    db = sqlite3.connect(at)
    db.execute('CREATE TABLE notes (id INTEGER PRIMARY KEY, "a ""name" TEXT, score REAL, pinned BOOLEAN, raw BLOB, seen DATETIME)')
    row = lambda i: (i * (1 if i < 900 else 10**12), None if i % 7 == 0 else f"T{i % 5}", i / 4 if i % 3 else None, i % 2, bytes([i % 256]), f"2024-01-{i % 28 + 1:02d} 00:00:00")
    db.executemany("INSERT INTO notes VALUES (?, ?, ?, ?, ?, ?)", [row(i) for i in range(1, 1001)])
    db.execute("CREATE TABLE pairs (a TEXT PRIMARY KEY, b INT) WITHOUT ROWID")
    db.execute("INSERT INTO pairs VALUES ('x', 1), ('y', NULL)")
    db.execute("CREATE TABLE none (a TEXT)")
    db.execute("CREATE TABLE odd (a INT, b TEXT)")
    db.execute("INSERT INTO odd VALUES (1, 'a'), ('many', 7)")
    db.execute("CREATE VIEW v AS SELECT id FROM notes")
    db.commit()
    db.close()
    return str(at)


def plain(rows):
    return sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in rows)


def test_ranges_are_even_whatever_the_ids(store):
    cut = sqlite.ranges(store, "notes", 100)
    db = sqlite3.connect(store)
    sizes = [db.execute("SELECT count(*) FROM notes WHERE id >= coalesce(?, id) AND id < coalesce(?, id + 1)", (r.low, r.high)).fetchone()[0] for r in cut]
    assert sizes == [100] * 10
    assert [r.key for r in sqlite.ranges(store, "pairs", 1)] == [None] and [r.key for r in sqlite.ranges(store, "v", 1)] == [None]
    assert sqlite.ranges(store, "none", 1) == sqlite.ranges(store, "absent", 1) == []


def test_all_rows_with_declared_types(spark, store):
    df = sqlite.load(spark, store, "notes", rows=64)
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "double", "boolean", "binary", "string"]
    want = [(*r[:3], bool(r[3]), *r[4:]) for r in sqlite3.connect(store).execute("SELECT * FROM notes")]
    assert sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect()), key=lambda r: r[0]) == want
    assert df.rdd.getNumPartitions() == 16 and df.count() == 1000
    assert plain(sqlite.load(spark, store, "pairs").where("b is not null").collect()) == [("x", 1)]
    assert sqlite.load(spark, store, "none").count() == 0 and sqlite.load(spark, store, "v").count() == 1000


NAMED = 'a "name'
TESTS = {
    "id < 40": [("id", "<", 40)],
    "id in (3, 5, 77777)": [("id", "in", [3, 5, 77777])],
    "id in (null)": [("id", "in", [])],
    "score >= 20.5 and id <= 100": [("score", ">=", 20.5), ("id", "<=", 100)],
    "score is null": [("score", "null", None)],
    "`a \"name` = 'T3'": [(NAMED, "=", "T3")],
    "`a \"name` > 'T2' and id >= 17": [(NAMED, ">", "T2"), ("id", ">=", 17)],
    "`a \"name` is not null": [(NAMED, "not null", None)],
    "`a \"name` = 't3'": [(NAMED, "=", "t3")],
    "`a \"name` in ('T1', 'T4')": [(NAMED, "in", ["T1", "T4"])],
}


@pytest.mark.parametrize("test", TESTS)
def test_filters_keep_the_same_rows(spark, store, test):
    df = sqlite.load(spark, store, "notes", rows=200)
    got = sqlite.load(spark, store, "notes", rows=200, filters=TESTS[test])
    assert got.select("id").orderBy("id").collect() == df.where(test).select("id").orderBy("id").collect()
    assert df.count() == 1000


def test_filters_that_sqlite_cannot_test_are_refused(store):
    kinds = sqlite.SqliteSource({"path": store, "table": "notes"}).schema()
    reader = sqlite.SqliteReader(store, "notes", 10**6, kinds, [("id", ">", 5), ("id", "in", [6, 7])])
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2
    for odd in (("id", "=", "5"), ("score", "=", float("nan")), ("gone", "=", 1), ("id", "like", 1), ("raw", "=", "x")):
        with pytest.raises(ValueError):
            sqlite.SqliteReader(store, "notes", 10, kinds, [odd])


def test_a_schema_names_the_columns_that_are_read(spark, store):
    sqlite.register(spark)
    df = spark.read.format(sqlite.NAME).option("table", "notes").schema("id long, more string").load(store)
    assert df.where("id = 4").collect() == [(4, None)]


def test_values_of_other_types(spark, store):
    sqlite.register(spark)
    assert plain(spark.read.format(sqlite.NAME).option("table", "odd").schema("b string").load(store).collect()) == [("7",), ("a",)]
    with pytest.raises(PySparkException, match="column 'a' of 'odd' holds a value that is no bigint"):
        sqlite.load(spark, store, "odd").collect()
    with pytest.raises(PySparkException, match="no file has a table 'absent'"):
        sqlite.load(spark, store, "absent")


def test_tasks_write_files_and_a_folder_is_read(spark, tmp_path):
    to = str(tmp_path / "stores")
    rows = spark.range(1000).select("id", (F.col("id") / 3).alias("x"), (F.col("id") % 2 == 0).alias("even"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("né\n"), "id")).alias("s"), F.timestamp_seconds(F.col("id")).alias("at"))
    sqlite.register(spark)
    put = lambda df, mode: df.write.format(sqlite.NAME).option("table", "rows").mode(mode).save(to)
    put(rows.repartition(3), "append")
    assert len(os.listdir(to)) == 3
    back = sqlite.load(spark, to, "rows", rows=50)
    assert quality.adopt(back, rows).exceptAll(rows).isEmpty() and back.count() == 1000
    put(rows.limit(10), "overwrite")
    assert sqlite.load(spark, to, "rows").count() == 10
    db = sqlite3.connect(f"{to}/other.db")
    db.execute("CREATE TABLE rows (id INTEGER, x TEXT)")
    db.execute("INSERT INTO rows VALUES (-1, 'word')")
    db.commit()
    both = sqlite.load(spark, to, "rows")
    assert dict(both.dtypes)["x"] == "string" and both.where("id < 0").select("x", "s").collect() == [("word", None)] and both.count() == 11


def test_a_failed_write_leaves_no_rows(spark, tmp_path):
    to = str(tmp_path / "stores")
    sqlite.register(spark)
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception):
        bad.write.format(sqlite.NAME).option("table", "rows").mode("append").save(to)
    assert not [x for x in os.listdir(to) if x.endswith(".db")]
    with pytest.raises(PySparkException):
        spark.range(1).select(F.array("id").alias("a")).write.format(sqlite.NAME).option("table", "rows").mode("append").save(to)


def test_a_store_is_adopted_with_its_types(spark, tmp_path):
    ours = D.observations(spark, "/root/testdata/sf0.001").drop("embedding")
    sqlite.register(spark)
    ours.withColumn("shelf", F.lit(1)).coalesce(1).write.format(sqlite.NAME).option("table", "observations").mode("append").save(str(tmp_path))
    (file,) = [x for x in os.listdir(tmp_path) if x.endswith(".db")]
    tables, counts = exchange.adopt_tables(exchange.read_sqlite(spark, str(tmp_path / file), ("observations", "sessions")), {"observations": ours, "sessions": spark.createDataFrame([], "id string")})
    got = tables["observations"]
    assert got.dtypes == ours.dtypes and got.exceptAll(ours).isEmpty() and ours.exceptAll(got).isEmpty()
    assert {tuple(r) for r in counts.collect()} == {("observations", ours.count(), ours.count()), ("sessions", 0, 0)}
