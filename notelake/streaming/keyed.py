"""The journal followed as a stream: where each key ends is a row of the state store, written for the keys of a micro-batch only.

A relation waits in a table of open relations, which each micro-batch reads and leaves anew; a time-out of the journal's own time keeps it short.
Both are Spark's own aggregates, windows and joins: no row goes to Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import replication as R

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RETRY_HOURS, SALTS = 1, 8
#: Every so many micro-batches, what is known of the notes is written as one table, from which later ones read on.
MERGED = 16
_ENDS = "entity string, entity_key string, seq long, deleted boolean, payload string"
_KNOWN = "note string, seq long, there boolean, batch long"
_RELATIONS = "change long, first_seen long, until long, source_note string, target_note string, source long, target long, apply_status string, retry_count int, at timestamp, batch long"


def _own_session(spark: SparkSession, partitions: int | None) -> SparkSession:
    """A session of the stream's own, so that its state store and its number of state partitions are nobody else's settings."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.shuffle.partitions", str(partitions or spark.conf.get("spark.sql.shuffle.partitions")))
    return own


def _files(own: SparkSession, source: str, schema, max_files: int) -> DataFrame:
    return own.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)


def follow(spark: SparkSession, source: str, schema, state_dir: str, on_batch: Callable[[DataFrame, int], None] | None = None, max_files: int = 10, partitions: int | None = None):
    """Follows a folder of journal files until it has read all. The end of each key is a row in the state store; a micro-batch reads and writes the
    rows of its own keys, and leaves the keys that it changed under `changes/batch=N`, the same again if it is run again: exactly once.

    The last change by seq counts, and of equal ones the first seen: its time of arrival is kept with it, so that changes seen twice or late change
    nothing and are not told again. partitions: of the state, fixed for the life of state_dir; by default as many as a shuffle has. Null payloads are
    ends like others; a journal without a row leaves no state. Returns the query; `ends(spark, state_dir)` reads where all keys end."""
    own = _own_session(spark, partitions)
    now = F.unix_micros(F.current_timestamp())  # one time a micro-batch, the same if it is run again
    m = _files(own, source, schema, max_files).select("entity", "entity_key", F.struct("seq", (-now).alias("arrived"), R.is_delete().alias("deleted"), "payload").alias("c"))
    last = m.groupBy("entity", "entity_key").agg(F.max("c").alias("last"))
    changed = last.where(F.col("last.arrived") == -now).select("entity", "entity_key", "last.seq", "last.deleted", "last.payload")

    def step(batch: DataFrame, number: int) -> None:
        at = f"{state_dir}/changes/batch={number}"
        batch.write.mode("overwrite").parquet(at)
        if on_batch:
            on_batch(batch.sparkSession.read.schema(_ENDS).parquet(at), number)

    return changed.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", f"{state_dir}/_checkpoint").trigger(availableNow=True).start()


def ends(spark: SparkSession, state_dir: str) -> DataFrame:
    """(entity, entity_key, seq, deleted, payload): where each key ends, from the state store, a task for each partition of the state."""
    held = spark.read.format("statestore").load(f"{state_dir}/_checkpoint")
    last = F.col("value")[held.schema["value"].dataType.names[0]]
    return held.select("key.entity", "key.entity_key", last["seq"].alias("seq"), last["deleted"].alias("deleted"), last["payload"].alias("payload"))


def _read(spark: SparkSession, state_dir: str, name: str, schema: str, first: int, before: int) -> DataFrame:
    """What the micro-batches from `first` on and before `before` left under a name; a failed one's own is not read when it is run again."""
    if max(first, 0) >= before:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{state_dir}/{name}").where(F.col("batch").between(first, before - 1))


def _settled(opened: DataFrame, notes: DataFrame, known: DataFrame) -> DataFrame:
    """The open relations with the time since which each end is there. opened: (change, first_seen, until, source_note, target_note, source, target,
    new); notes: (note, seq, ms, there), what a micro-batch tells; known: (note, seq, there), what was told before.

    A note and what names it meet in order of the journal, in SALTS parts by relation, each told of the note, so that one that a third of all
    relations name is no single task."""
    end = lambda which: F.struct(F.lit(which).alias("which"), F.col(f"{which}_note").alias("note"), F.col(which).alias("ready"))
    halves = opened.withColumn("e", F.explode(F.array(end("source"), end("target")))).select("change", "first_seen", "until", "new", "source_note", "target_note", "e.*")
    halves = halves.withColumn("salt", F.pmod(F.hash("change"), F.lit(SALTS)).cast("int"))
    named = halves.where("ready is null").select("note", "salt").distinct()
    nil = lambda kind, name: F.lit(None).cast(kind).alias(name)
    told = lambda df, place, ms: df.join(named, "note").select("note", "salt", F.lit(place).alias("place"), "seq", ms.alias("ms"), "there", nil("struct<change: bigint, first_seen: bigint, until: bigint, new: boolean, which: string, ready: bigint, source_note: string, target_note: string>", "half"))
    half = F.struct("change", "first_seen", "until", "new", "which", "ready", "source_note", "target_note").alias("half")
    asks = halves.select("note", "salt", F.when(F.col("new"), 2).otherwise(1).alias("place"), F.col("change").alias("seq"), F.col("first_seen").alias("ms"), nil("boolean", "there"), half)
    each = told(known, 0, F.lit(None).cast("long")).unionByName(told(notes, 2, F.col("ms"))).unionByName(asks)
    # what was known, then what waits, then the micro-batch by seq; a row sees those before it, or from the end, those after
    w = lambda *o: Window.partitionBy("note", "salt").orderBy(*o).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("was", F.last("there", ignorenulls=True).over(w("place", "seq")))
    each = each.withColumn("comes", F.last(F.when(F.col("there") & (F.col("place") == 2), F.col("ms")), ignorenulls=True).over(w(F.desc("place"), F.desc("seq"))))
    here = F.col("half.new") & F.coalesce("was", F.lit(False))
    ready = F.coalesce("half.ready", F.when(here, F.col("half.first_seen")).when(F.col("comes") <= F.col("half.until"), F.col("comes")))
    of = lambda which: F.max(F.when(F.col("which") == which, F.col("ready"))).alias(which)
    out = each.where("half is not null").select("half.change", "half.first_seen", "half.until", "half.which", "half.source_note", "half.target_note", ready.alias("ready"))
    return out.groupBy("change").agg(F.min("first_seen").alias("first_seen"), F.min("until").alias("until"), F.first("source_note").alias("source_note"), F.first("target_note").alias("target_note"), of("source"), of("target"))


def settle(spark: SparkSession, source: str, schema, state_dir: str, delay: str = "1 hour", retry_hours: int = RETRY_HOURS, retries: int = R.RETRIES, max_files: int = 10, partitions: int | None = None):
    """Follows a journal (seq, entity, entity_key, op, payload, occurred_at) and settles the changes of relations: `outcomes` reads (change, apply_status,
    retry_count, at).

    A relation is tried when it comes and every `retry_hours` of the journal's own time after; it is applied once both its ends are there and dead
    after `retries` tries in vain. Retries are counted by time and not run: a note wakes what waits for it, and what nothing woke ends when the
    watermark (the latest time of the journal less `delay`) has passed its last try. What still waits when the journal ends stays open (`waiting`).
    A note is there from its upsert to a removal for good; changes older than the watermark are refused. Blank or null ends never come, so such a
    relation ends dead.

    A micro-batch leaves the relations that were open (`relations/batch=N`: settled now, or open still), what it told of notes (`notes/batch=N`) and
    the latest time (`latest/batch=N`), the same again if it is run again. It reads the open ones of the micro-batch before it and what is known of
    notes. partitions: of its shuffles."""
    own = _own_session(spark, partitions)
    retry_ms = retry_hours * 3_600_000
    m = _files(own, source, schema, max_files)

    def step(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        get = lambda k: F.coalesce(F.get_json_object(R.payload(), f"$.{k}"), F.lit(""))
        ms = F.unix_millis("occurred_at")
        late = s.range(1).select(F.expr(f"cast(timestamp_millis(0) + interval {delay} as timestamp)").alias("t")).select(F.unix_millis("t")).first()[0]
        seen = _read(s, state_dir, "latest", "ms long, batch long", number - 1, number).agg(F.max("ms")).first()[0]  # one row
        latest = max((x for x in (seen, batch.agg(F.max(ms)).first()[0]) if x is not None), default=None)
        if latest is None:  # nothing was told so far
            latest = -(2**62)
        rows = batch if seen is None else batch.where(ms > seen - late)
        gone = (F.col("op") == "delete") | get("deleted").isin("true", "1")
        notes = rows.where(F.col("entity") == "observation").where(~(gone & ~get("hard_delete").isin("true", "1")))
        notes = notes.select(F.col("entity_key").alias("note"), "seq", ms.alias("ms"), (~gone).alias("there"))
        base = number - number % MERGED
        known = _read(s, state_dir, "notes", _KNOWN, max(base - 1, 0), number).groupBy("note").agg(F.max(F.struct("seq", "there")).alias("k")).select("note", "k.*")
        # older than what is known of the note: nothing new
        notes = notes.join(known.select("note", F.col("seq").alias("known_seq")), "note", "left").where("known_seq is null or seq > known_seq").drop("known_seq")
        ends_ = rows.where((F.col("entity") == "relation") & (F.col("op") == "upsert"))
        nil = F.lit(None).cast("long")
        new = ends_.select(F.col("seq").alias("change"), ms.alias("first_seen"), (ms + retries * retry_ms).alias("until"), get("source_id").alias("source_note"), get("target_id").alias("target_note"), nil.alias("source"), nil.alias("target"), F.lit(True).alias("new"))
        held = _read(s, state_dir, "relations", _RELATIONS, number - 1, number).where("apply_status is null").select(*new.columns[:-1], F.lit(False).alias("new"))
        x = _settled(held.unionByName(new), notes, known)
        both = F.greatest(F.when(F.col("target").isNotNull(), F.col("source")), F.when(F.col("source").isNotNull(), F.col("target")))
        dead = F.col("until") <= latest - late
        status = F.when(both.isNotNull(), "applied").when(dead, "dead")
        tries = F.when(both.isNotNull(), F.floor((both - F.col("first_seen")) / retry_ms)).when(dead, retries).cast("int")
        x = x.select("*", status.alias("apply_status"), tries.alias("retry_count"), F.timestamp_millis(F.when(both.isNotNull(), both).when(dead, F.col("until"))).alias("at"))
        x.write.mode("overwrite").parquet(f"{state_dir}/relations/batch={number}")
        now = notes.select("note", "seq", "there")
        if number % MERGED == MERGED - 1:
            now = now.unionByName(known)
        now.groupBy("note").agg(F.max(F.struct("seq", "there")).alias("k")).select("note", "k.*").write.mode("overwrite").parquet(f"{state_dir}/notes/batch={number}")
        s.range(1).select(F.lit(latest).cast("long").alias("ms")).write.mode("overwrite").parquet(f"{state_dir}/latest/batch={number}")

    return m.writeStream.foreachBatch(step).option("checkpointLocation", f"{state_dir}/_checkpoint").trigger(availableNow=True).start()


def _relations(spark: SparkSession, state_dir: str) -> DataFrame:
    return spark.read.schema(_RELATIONS).parquet(f"{state_dir}/relations")


def outcomes(spark: SparkSession, state_dir: str) -> DataFrame:
    return _relations(spark, state_dir).where("apply_status is not null").select("change", "apply_status", "retry_count", "at")


def waiting(spark: SparkSession, state_dir: str) -> DataFrame:
    """(change, first_seen, source, target): relations that wait for an end still, with the time since which each end is there."""
    last = spark.read.schema("ms long, batch long").parquet(f"{state_dir}/latest").agg(F.max("batch")).first()[0]
    opened = _relations(spark, state_dir).where((F.col("batch") == last) & F.col("apply_status").isNull())
    return opened.select("change", *(F.timestamp_millis(c).alias(c) for c in ("first_seen", "source", "target")))
