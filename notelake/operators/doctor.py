"""The store's health under the codes that callers ask for, all row checks of a table in one scan of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .index import Index

#: Codes by which callers name a check. Those that speak of the files and settings of an embedded database have no counterpart here.
CODES = (
    "foreign_keys",
    "observation_fts_integrity",
    "observation_exact_fts_integrity",
    "prompt_fts_integrity",
    "observation_fts_sync",
    "observation_exact_fts_sync",
    "prompt_fts_sync",
    "observation_hash_sync",
    "observation_type_searchable",
    "topic_key_uniqueness",
)
#: The index that each table's checks look at.
INDEXES = {"observation_fts": "observations", "observation_exact_fts": "observations", "prompt_fts": "prompts"}


def _documents(index: Index, name: str, counted: bool) -> DataFrame:
    """(name_id, name_listed, name_sound): the documents of an index; sound: as many postings as its statistics say, which are there once."""
    listed = index.docstats.groupBy("doc_id").agg(F.sum("n_tokens").alias("told"), F.count("*").alias("times"))
    if counted:
        listed = listed.join(index.postings.groupBy("doc_id").agg(F.count("*").alias("held")), "doc_id", "full_outer")
    sound = (F.col("times") == 1) & (F.col("told") == F.coalesce("held", F.lit(0))) if counted else F.lit(True)
    return listed.select(F.col("doc_id").alias(f"{name}_id"), F.col("times").isNotNull().alias(f"{name}_listed"), F.coalesce(sound, F.lit(False)).alias(f"{name}_sound"))


def _looked_at(rows: DataFrame, sessions: DataFrame, indexes: dict[str, Index], wanted: tuple[str, ...]) -> DataFrame:
    """Each row, or document of an index without one, once, with a column for each wanted check that is true where it fails."""
    x = rows.withColumn("here", F.lit(True))
    failed = {k: F.coalesce(F.col(k), F.lit(False)) for k in wanted if k in rows.columns}
    if "foreign_keys" in wanted:
        known = sessions.select(F.col("id").alias("session_id")).distinct().withColumn("known", F.lit(True))
        x = x.join(known, "session_id", "left")
        failed["foreign_keys"] = F.col("here").isNotNull() & F.col("known").isNull()
    for name, index in indexes.items():
        if not {f"{name}_sync", f"{name}_integrity"} & set(wanted):
            continue
        x = x.join(_documents(index, name, f"{name}_integrity" in wanted), F.col("id") == F.col(f"{name}_id"), "full_outer").withColumn("id", F.coalesce("id", f"{name}_id"))
        failed[f"{name}_sync"] = F.col("here").isNotNull() != F.coalesce(f"{name}_listed", F.lit(False))
        failed[f"{name}_integrity"] = F.col(f"{name}_sound").eqNullSafe(F.lit(False))
    return x.withColumns({k: v for k, v in failed.items() if k in wanted})


def report(rows: DataFrame, sessions: DataFrame, prompts: DataFrame, indexes: dict[str, Index], code: str | None = None) -> DataFrame:
    """(code, ok, detail) of all checks, or of the one named; detail is how many rows, documents or topics fail.

    indexes: by the names of INDEXES; a check of one that is not given fails with the detail `no index`. Rows without a session's id have
    no session. An unknown code is an error that lists the known ones.
    """
    if code is not None and code not in CODES:
        raise ValueError(f"unknown check {code}; known: {', '.join(CODES)}")
    absent = tuple(c for c in CODES for n in INDEXES if c in (f"{n}_sync", f"{n}_integrity") and n not in indexes)
    asked = tuple(c for c in CODES if code in (None, c))
    of = lambda table: {n: i for n, i in indexes.items() if INDEXES[n] == table}
    mine = {t: tuple(c for c in asked if c not in absent and (c == "foreign_keys" or c.startswith("prompt_") == (t == "prompts"))) for t in ("observations", "prompts")}
    found = None
    if mine["observations"]:
        living = F.col("deleted_at").isNull()
        narrow = rows.select(
            "id", "session_id",
            (living & ~F.col("normalized_hash").eqNullSafe(T.body_hash(F.col("content")))).alias("observation_hash_sync"),
            (living & ~F.col("type").isin(*T.KINDS, T.SESSION_SUMMARY)).alias("observation_type_searchable"),
            F.when(living & (F.col("topic_key") != ""), F.struct("topic_key", F.coalesce("project", F.lit("")).alias("project"), "scope")).alias("topic"),
        )
        seen = _looked_at(narrow, sessions, of("observations"), mine["observations"])
        sums = [c for c in mine["observations"] if c != "topic_key_uniqueness"]
        if "topic_key_uniqueness" in asked:
            # rows without a topic are one group, which each task sums up before the shuffle
            seen = seen.groupBy("topic").agg(*[F.count_if(c).alias(c) for c in sums], (F.col("topic").isNotNull() & (F.count("*") > 1)).cast("int").alias("topic_key_uniqueness"))
            found = seen.agg(*[F.sum(c).alias(c) for c in (*sums, "topic_key_uniqueness")])
        else:
            found = seen.agg(*[F.count_if(c).alias(c) for c in sums])
    if mine["prompts"]:
        theirs = _looked_at(prompts.select("id", "session_id"), sessions, of("prompts"), mine["prompts"])
        theirs = theirs.agg(*[F.count_if(c).alias("of_prompts" if c == "foreign_keys" else c) for c in mine["prompts"]])
        found = theirs if found is None else found.crossJoin(theirs)  # one row each
        if "foreign_keys" in asked:
            found = found.withColumn("foreign_keys", F.coalesce("foreign_keys", F.lit(0)) + F.col("of_prompts"))
    if found is None:
        found = rows.sparkSession.range(1)
    each = [F.struct(F.lit(c).alias("code"), (F.lit(None).cast("long") if c in absent else F.coalesce(F.col(c), F.lit(0)).cast("long")).alias("n")) for c in asked]
    return found.select(F.inline(F.array(*each))).select("code", F.coalesce(F.col("n") == 0, F.lit(False)).alias("ok"), F.coalesce(F.col("n").cast("string"), F.lit("no index")).alias("detail"))


def sizes(before: dict[str, Index], after: dict[str, Index]) -> DataFrame:
    """(name, before, after): documents of each index before and after it was built anew; one that was not there had none."""
    out = None
    for name, index in after.items():
        n = lambda i: i.docstats.agg(F.count("*").alias("n"))
        had = n(before[name]) if name in before else index.docstats.limit(0).agg(F.count("*").alias("n"))
        row = had.select(F.lit(name).alias("name"), F.col("n").alias("before")).crossJoin(n(index).withColumnRenamed("n", "after"))  # one row each
        out = row if out is None else out.unionByName(row)
    return out
