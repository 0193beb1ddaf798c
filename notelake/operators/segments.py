"""An inverted index in immutable segments: a write adds one, reads merge them, and small ones are merged by size.

A segment is a folder of Parquet: `postings` in runs in order of term, `docstats` in order of document, and `removed`, the documents whose rows in earlier
segments no longer count. A document that is indexed again lives in its newest segment only. The manifest lists the segments with their
sizes and the totals of the live documents, which a write adds to and takes from, so ranking never counts the table. It is published under a
new number by a rename that fails if the number is taken: two writers cannot both win, and readers of an older number keep its segments.

What a write of k documents reads is the statistics between their least and greatest id; what it writes is their postings. Merging takes
`fan` segments of one size class at a time, so a posting is rewritten once a class; if dead documents outnumber half of the live ones, all are merged.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import index

FAN, CLASS_POSTINGS = 8, 1 << 16
_POSTINGS = "doc_id long, col string, pos int, term string, seg int"
_DOCSTATS = "doc_id long, n_tokens long, seg int"
_REMOVED = "doc_id long, before int, n_tokens long"


@dataclass(frozen=True)
class Segment:
    seg: int
    path: str
    n_docs: int
    n_postings: int
    n_removed: int

    def size_class(self) -> int:
        return max(0, math.ceil(math.log(max(1, self.n_postings) / CLASS_POSTINGS, FAN)))


def _read(spark: SparkSession, schema: str, paths: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def folder_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


@dataclass(frozen=True)
class SegmentIndex(index.Index):
    """An Index whose frames read the segments. A value does not change: `add` gives the next one, `publish` makes it the one that `open` finds."""

    root: str = ""
    segments: tuple[Segment, ...] = ()
    live: tuple[int, int] = (0, 0)  # documents and their tokens
    generation: int = 0
    columns: tuple[str, ...] = field(default=index.COLUMNS)

    # reading

    @staticmethod
    def of(spark: SparkSession, root: str, segments: tuple[Segment, ...], live: tuple[int, int], generation: int, stemmed: bool, columns: tuple[str, ...]) -> "SegmentIndex":
        postings, docstats = (_read(spark, schema, [f"{s.path}/{what}" for s in segments if s.n_docs]) for what, schema in (("postings", _POSTINGS), ("docstats", _DOCSTATS)))
        gone = [s for s in segments if s.n_removed]
        if gone:
            dead = _read(spark, _REMOVED, [f"{s.path}/removed" for s in gone]).groupBy(F.col("doc_id").alias("gone")).agg(F.max("before").alias("before"))
            here = (F.col("doc_id") == F.col("gone")) & (F.col("seg") < F.col("before"))
            postings, docstats = (x.join(dead, here, "left_anti") for x in (postings, docstats))
        return SegmentIndex(postings, docstats, stemmed, root, segments, live, generation, columns)

    @staticmethod
    def open(spark: SparkSession, root: str, generation: int | None = None) -> "SegmentIndex":
        """The newest published index, or one of an older number."""
        fs, p = _fs(spark, f"{root}/manifest")
        known = sorted(int(x.getPath().getName()) for x in fs.listStatus(p) if x.getPath().getName().isdigit())
        if not known or generation is not None and generation not in known:
            raise ValueError(f"no published index {generation if generation is not None else ''} under {root}")
        at = known[-1] if generation is None else generation
        m = json.loads(spark.read.text(f"{root}/manifest/{at:08d}", wholetext=True).first()[0])
        return SegmentIndex.of(spark, root, tuple(Segment(**s) for s in m["segments"]), tuple(m["live"]), at, m["stemmed"], tuple(m["columns"]))

    def totals(self) -> DataFrame:
        """From the manifest: nothing is counted."""
        n, tokens = self.live
        return self.postings.sparkSession.range(1).select(F.lit(n).cast("long").alias("n_docs"), F.lit(tokens / n if n else None).cast("double").alias("avgdl"))

    # writing

    @staticmethod
    def create(rows: DataFrame, root: str, columns: tuple[str, ...] = index.COLUMNS, id_col: str = "id", stemmed: bool = False) -> "SegmentIndex":
        """The index of a whole table as one segment."""
        return SegmentIndex.of(rows.sparkSession, root, (), (0, 0), 0, stemmed, columns).add(rows, id_col=id_col)

    def _segment(self, seg: int, new: index.Index, removed: DataFrame | None) -> tuple[Segment, int, int, int]:
        """Writes a segment; what it holds and how many documents and tokens it takes from earlier ones."""
        spark, path = self.postings.sparkSession, f"{self.root}/{seg:06d}-{uuid.uuid4().hex[:12]}"
        numbered = lambda df: df.withColumn("seg", F.lit(seg))
        postings = new.postings.select("doc_id", "col", "pos", "term")
        (numbered(postings) if new.runs else index.in_runs(numbered(postings))).write.parquet(f"{path}/postings")
        numbered(new.docstats.select("doc_id", "n_tokens")).sortWithinPartitions("doc_id").write.parquet(f"{path}/docstats")
        if removed is not None:
            removed.select("doc_id", "before", "n_tokens").write.parquet(f"{path}/removed")
        size = lambda what, schema, tokens: _read(spark, schema, [f"{path}/{what}"]).agg(F.lit(what).alias("what"), F.count("*").alias("n"), F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("tokens"))
        sizes = size("postings", _POSTINGS, F.lit(0)).unionByName(size("docstats", _DOCSTATS, F.col("n_tokens")))
        if removed is not None:
            sizes = sizes.unionByName(size("removed", _REMOVED, F.col("n_tokens")))
        of = {r["what"]: (r["n"], r["tokens"]) for r in sizes.collect()}
        n_dead, dead_tokens = of.get("removed", (0, 0))
        return Segment(seg, path, of["docstats"][0], of["postings"][0], n_dead), of["docstats"][1], n_dead, dead_tokens

    def add(self, changed: DataFrame | None = None, removed: DataFrame | None = None, id_col: str = "id") -> "SegmentIndex":
        """The index after rows were added or changed (as they are now) or removed (ids). Only these rows are read, and the statistics of their ids."""
        spark = self.postings.sparkSession
        seg = max((s.seg for s in self.segments), default=-1) + 1
        ids = [df.select(F.col(id_col).alias("doc_id")) for df in (changed, removed) if df is not None]
        if not ids:
            return self
        new = index.build(changed, self.columns, id_col, self.stemmed) if changed is not None else index.Index(*(_read(spark, s, []) for s in (_POSTINGS, _DOCSTATS)))
        dead = None
        if self.segments:
            gone = ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])
            low, high = gone.agg(F.min("doc_id"), F.max("doc_id")).first()
            near = self.docstats.where(F.col("doc_id").between(low, high)) if low is not None else self.docstats.limit(0)
            dead = near.join(gone.distinct(), "doc_id", "left_semi").select("doc_id", F.lit(seg).alias("before"), "n_tokens")
        made, tokens, n_dead, dead_tokens = self._segment(seg, new, dead)
        live = (self.live[0] + made.n_docs - n_dead, self.live[1] + tokens - dead_tokens)
        out = SegmentIndex.of(spark, self.root, (*self.segments, made), live, self.generation, self.stemmed, self.columns)
        return out.compacted()

    def compacted(self) -> "SegmentIndex":
        """Merges a size class that is full, or everything if too much of it is dead."""
        out = self
        while True:
            held = sum(s.n_docs for s in out.segments)
            classes: dict[int, list[Segment]] = {}
            for s in out.segments:
                classes.setdefault(s.size_class(), []).append(s)
            full = next((c for _, c in sorted(classes.items()) if len(c) >= FAN), None)
            if len(out.segments) > 1 and held > 1.5 * max(1, out.live[0]):
                full = list(out.segments)
            if not full:
                return out
            out = out.merged(full)

    def merged(self, some: list[Segment]) -> "SegmentIndex":
        """The index with some segments made one. Their dead rows go; what they removed elsewhere stays removed while an older segment is left."""
        spark, numbers = self.postings.sparkSession, [s.seg for s in some]
        rest = tuple(s for s in self.segments if s.seg not in numbers)
        last = max(numbers)
        alive = index.Index(self.postings.where(F.col("seg").isin(numbers)), self.docstats.where(F.col("seg").isin(numbers)))
        still = None
        gone = [f"{s.path}/removed" for s in some if s.n_removed]
        if gone and rest:
            still = _read(spark, _REMOVED, gone).where(F.col("before") > min(s.seg for s in rest)).groupBy("doc_id").agg(F.max("before").alias("before"), F.max("n_tokens").alias("n_tokens"))
        made, *_ = self._segment(last, alive, still)
        return SegmentIndex.of(spark, self.root, tuple(sorted((*rest, made), key=lambda s: s.seg)), self.live, self.generation, self.stemmed, self.columns)

    def publish(self) -> "SegmentIndex":
        """Makes this the index that `open` finds. Fails if another was published since this one was opened."""
        spark, at = self.postings.sparkSession, self.generation + 1
        body = json.dumps({"segments": [s.__dict__ for s in self.segments], "live": list(self.live), "stemmed": self.stemmed, "columns": list(self.columns)})
        fs, draft = _fs(spark, f"{self.root}/manifest/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(body.encode())
        out.close()
        files = spark._jvm.org.apache.hadoop.fs
        how = spark.sparkContext._gateway.new_array(files.Options.Rename, 0)  # no overwriting
        context = files.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, files.Path(f"{self.root}/manifest/{at:08d}"), how)
        except Exception as e:
            fs.delete(draft, False)
            raise ValueError(f"index {at} of {self.root} is taken: another writer published it first") from e
        return SegmentIndex.of(spark, self.root, self.segments, self.live, at, self.stemmed, self.columns)

    def vacuum(self) -> int:
        """Removes the folders of segments that this index does not read, and older manifests; how many folders went."""
        spark = self.postings.sparkSession
        fs, root = _fs(spark, self.root)
        used = {s.path.rsplit("/", 1)[1] for s in self.segments}
        gone = [x.getPath() for x in fs.listStatus(root) if x.isDirectory() and x.getPath().getName() not in used and x.getPath().getName() != "manifest"]
        for p in gone:
            fs.delete(p, True)
        for x in fs.listStatus(_fs(spark, f"{self.root}/manifest")[1]):
            if x.getPath().getName().isdigit() and int(x.getPath().getName()) < self.generation:
                fs.delete(x.getPath(), False)
        return len(gone)

    def refresh(self, changed: DataFrame, removed: DataFrame | None = None, columns: tuple[str, ...] = index.COLUMNS, id_col: str = "id") -> "SegmentIndex":
        return self.add(changed, removed, id_col)
