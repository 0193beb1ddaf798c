"""Reading and writing what leaves the store: JSON exports, chunks, foreign tables, a vault of Markdown notes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.quality import adopt
from . import sqlite
from .schemas import CHUNK, EXPORT

VERSIONS = ("1",)
ENTITIES = ("sessions", "observations", "prompts", "relations")


def read_export(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of JSON exports; lists that are null are empty; other versions are refused."""
    doc = spark.read.schema(EXPORT).json(path, multiLine=True)
    odd = [r["version"] for r in doc.where(~F.coalesce("version", F.lit("?")).isin(*VERSIONS)).select("version").limit(1).collect()]
    if odd:
        raise ValueError(f"an export of version {odd[0]!r} cannot be read")
    return {e: doc.select(F.explode(e).alias("x")).select("x.*") for e in ENTITIES}


def write_export(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON file of lines per entity folder: an export of any size is written by all tasks."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def read_chunks(chunks: DataFrame, column: str = "payload") -> dict[str, DataFrame]:
    """The entities in chunk payloads; null lists are empty."""
    c = chunks.select(F.from_json(F.col(column), CHUNK).alias("c"))
    return {f.name: c.select(F.explode(F.col("c")[f.name]).alias("x")).select("x.*") for f in CHUNK.fields}


def dedupe_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, conflicting names): the first of equal chunks stays; one name with different bytes is a conflict."""
    g = chunks.groupBy("project", "chunk_id").agg(F.min("payload").alias("payload"), F.countDistinct("payload").alias("n"))
    return g.where("n = 1").drop("n"), g.where("n > 1").select("project", "chunk_id")


def manifest(chunks: DataFrame, project: str) -> DataFrame:
    when = F.coalesce("client_created_at", "created_at")
    return chunks.where(F.col("project") == project).select("chunk_id", when.alias("created_at")).orderBy("created_at", "chunk_id")


def adopt_tables(theirs: dict[str, DataFrame], ours: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables in our layout, one row of counts a table before and after); a table they lack counts 0."""
    out, counts = {}, None
    for name, like in ours.items():
        src = theirs.get(name)
        out[name] = adopt(src, like) if src is not None else like.limit(0)
        n = lambda df: df.agg(F.count("*").alias("n"))
        before = n(src) if src is not None else like.limit(0).agg(F.count("*").alias("n"))
        row = before.select(F.lit(name).alias("name"), F.col("n").alias("before")).crossJoin(n(out[name]).withColumnRenamed("n", "after"))  # one row each
        counts = row if counts is None else counts.unionByName(row)
    return out, counts


def read_sqlite(spark: SparkSession, path: str, tables: tuple[str, ...]) -> dict[str, DataFrame]:
    """Tables of a SQLite file of which the driver takes a snapshot; tasks read it by ranges, with the declared types."""
    return sqlite.read_tables(spark, path, tables)


def vault(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """(path, body) of Markdown notes: one a live note, a hub a session, a hub a topic family with two notes or more."""
    live = rows.where("deleted_at is null")
    name = F.concat_ws("-", T.slug(F.left("title", F.lit(60))), F.col("id").cast("string"))
    notes = live.select("session_id", "topic_key", "created_at", "id", F.concat_ws("/", F.coalesce(T.slug(F.col("project")), F.lit("none")), name).alias("stem"), "title", "type", "content")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    body = F.concat(F.lit("---\ntitle: "), quoted("title"), F.lit("\ntype: "), F.col("type"), F.lit("\n---\n\n"), F.col("content"), F.lit("\n"))
    files = notes.select(F.concat("stem", F.lit(".md")).alias("path"), body.alias("body"))

    def hub(key: str, folder: str, least: int) -> DataFrame:
        # links are listed in order by a sort within the key, which spills; no list of a hub is longer than its notes.
        # Hubs are chosen by a count, so that paths alone make no lists
        g = notes.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "stem"))).alias("n"), F.count("*").alias("many")).where(F.col("many") >= least)
        links = F.array_join(F.transform("n", lambda x: F.concat(F.lit("- [["), x["stem"], F.lit("]]"))), "\n")
        return g.select(F.concat(F.lit(f"{folder}/"), T.slug(F.col(key)), F.lit(".md")).alias("path"), F.concat(F.lit("# "), F.col(key), F.lit("\n\n"), links, F.lit("\n")).alias("body"))

    del sessions
    return files.unionByName(hub("session_id", "sessions", 1)).unionByName(hub("topic_key", "topics", 2))


def write_vault(files: DataFrame, folder: str) -> DataFrame:
    """Writes the files that changed, from the tasks, through any file system that Arrow knows. (path, written)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            wrote = []
            for path, body in zip(b["path"], b["body"]):
                at, data = f"{root}/{path}", body.encode()
                info = store.get_file_info(at)
                same = info.type == fs.FileType.File and info.size == len(data) and store.open_input_stream(at).read() == data
                if not same:
                    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    with store.open_output_stream(at) as out:
                        out.write(data)
                wrote.append(not same)
            yield pd.DataFrame({"path": b["path"], "written": wrote})

    return files.mapInPandas(run, "path string, written boolean")


def orphaned(on_disk: DataFrame, files: DataFrame) -> DataFrame:
    return on_disk.select("path").join(files.select("path"), "path", "left_anti")


def context_block(rows: DataFrame, sessions: DataFrame, prompts: DataFrame, n: int = 20, detailed: int = 5) -> DataFrame:
    """(section, place, id, text) of an opening context: sessions, prompts, pinned and recent notes, the first ones with a preview."""
    from ..operators import aggregates, listings

    s = aggregates.session_list(sessions, rows, 5)
    p = listings.distinct_prompts(prompts, 10)
    pin, _ = listings.pinned(rows, n)
    rec = listings.context_memories(rows, n)
    place = lambda *o: F.row_number().over(Window.orderBy(*o))  # noqa: E731  each section is limited to a few rows
    brief = F.when(F.col("place") <= detailed, F.concat_ws(": ", "title", T.truncate_words(F.col("content"), 200))).otherwise(F.col("title"))
    parts = [
        s.select(F.lit("sessions").alias("section"), place(F.desc("last_at"), F.desc("id")).alias("place"), F.col("id").cast("string").alias("id"), F.col("project").alias("text")),
        p.select(F.lit("prompts").alias("section"), place(F.desc("id")).alias("place"), F.col("id").cast("string").alias("id"), T.truncate_words(F.col("content"), 200).alias("text")),
        *(d.withColumn("place", place(F.desc("created_at"), F.desc("id"))).select(F.lit(k).alias("section"), "place", F.col("id").cast("string").alias("id"), brief.alias("text")) for k, d in (("pinned", pin), ("recent", rec))),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
