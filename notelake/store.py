"""The surface that callers see: one store over DataFrames, with a method for each thing that can be asked or done.

Reads return DataFrames. Writes return the store as it is afterwards; nothing is changed in place, and `save` commits.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import aggregates, doctor, frames, index, journal, listings, peers, projects, quality, relations, search, segments, writes
from .session import written
from .sources import exchange

TABLES = ("observations", "sessions", "prompts", "relations", "prompt_deletions")
#: Of a store that is replicated: its journal, the projects it replicates, the state of each target.
REPLICATION = ("mutations", "enrolled", "sync_state")
INDEXES = (("index_exact", False), ("index_stemmed", True))
LIMIT = search.DEFAULT_LIMIT


@dataclass(frozen=True)
class NoteStore:
    observations: DataFrame
    sessions: DataFrame
    prompts: DataFrame
    relations: DataFrame
    prompt_deletions: DataFrame
    as_of: Column
    held: tuple[index.Index, index.Index] | None = None
    mutations: DataFrame | None = None
    enrolled: DataFrame | None = None
    sync_state: DataFrame | None = None

    @staticmethod
    def open(spark: SparkSession, path: str, as_of: Column) -> "NoteStore":
        tables = (spark.read.parquet(f"{path}/{t}") for t in TABLES)
        held = tuple(segments.SegmentIndex.open(spark, f"{path}/{name}") for name, _ in INDEXES)
        more = {t: spark.read.parquet(f"{path}/{t}") for t in REPLICATION if segments.folder_exists(spark, f"{path}/{t}")}
        return NoteStore(*tables, as_of, held, **more)

    def save(self, path: str) -> None:
        """Writes a new copy with its indexes, each as one segment; a store is never overwritten while it is read."""
        for t in (*TABLES, *(t for t in REPLICATION if getattr(self, t) is not None)):
            getattr(self, t).write.mode("errorifexists").parquet(f"{path}/{t}")
        rows = self.observations.sparkSession.read.parquet(f"{path}/observations")
        for name, stemmed in INDEXES:
            segments.SegmentIndex.create(rows, f"{path}/{name}", stemmed=stemmed).publish()

    def indexes(self) -> tuple[index.Index, index.Index]:
        """(exact, stemmed): as saved, or built anew after changes."""
        return self.held or (index.build(self.observations), index.build(self.observations, stemmed=True))

    def changed(self, **tables: DataFrame) -> "NoteStore":
        """The store with other tables; the indexes stay if the notes do. Writes whose rows are known use `_put` instead."""
        return replace(self, **tables, held=None if "observations" in tables else self.held)

    # how a write is carried through

    def _indexed(self, changed: DataFrame | None = None, gone: DataFrame | None = None) -> tuple[index.Index, index.Index] | None:
        """The indexes after some notes were changed (as they are now) or removed (ids); none if none are held."""
        if self.held is None:
            return None
        rows = changed if changed is not None else self.observations.limit(0)
        return tuple(i.refresh(rows, gone) for i in self.held)

    def _told(self, **states: tuple[DataFrame, DataFrame]) -> "NoteStore":
        """The store with its journal and target states after entities went from one state to another; untouched if it keeps no journal."""
        if self.mutations is None:
            return self
        enrolled = self.enrolled if self.enrolled is not None else self.mutations.limit(0).select("project")
        found = [journal.entries(e, b, a, self.sessions, enrolled, self.as_of) for e, (b, a) in states.items()]
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        mutations, new = journal.appended(self.mutations, every, self.as_of)
        return replace(self, mutations=mutations, sync_state=journal.advanced(self.sync_state, new, self.as_of) if self.sync_state is not None else None)

    def _put(self, before: DataFrame, delta: DataFrame, text: bool = True, **tables: DataFrame) -> "NoteStore":
        """The store with some notes added or replaced: as they were, as they are now; text: whether what is indexed may have changed."""
        held = self._indexed(delta) if text else self.held
        return replace(self, observations=writes.merged(self.observations, delta), held=held, **tables)._told(observation=(before, delta))

    def _hit(self, ids: DataFrame) -> DataFrame:
        return self.observations.join(ids.select("id").distinct(), "id", "left_semi")

    # what can be asked

    def search(self, query: str, limit: int = LIMIT, mode: str = "all", kind: str | None = None, project: str | None = None, scope: str | None = None, indexes: tuple[index.Index, index.Index] | None = None) -> DataFrame:
        exact, stemmed = indexes or self.indexes()
        return search.search(exact, stemmed, self.observations, query, limit, mode, search.Filters(kind, project, scope))

    def search_all(self, queries: DataFrame, limit: int = LIMIT, mode: str = "all") -> DataFrame:
        """The answers to a frame of queries: (qid, query) and, if wanted, kind, project and scope."""
        return frames.search_all(*self.indexes(), self.observations, queries, limit, mode)

    def get(self, id_: int) -> DataFrame:
        return listings.by_id(self.observations, id_)

    def context(self, n: int = 20) -> DataFrame:
        return exchange.context_block(self.observations, self.sessions, self.prompts, n)

    def timeline(self, id_: int, before: int = 5, after: int = 5) -> DataFrame:
        return listings.timeline(self.observations, self.get(id_), before, after)

    def review_queue(self, limit: int = 20) -> DataFrame:
        return listings.review_queue(self.observations, self.as_of, limit)

    def recall(self, prompt: str, project: str, limit: int = 3) -> DataFrame:
        return search.prompt_recall(self.indexes()[1], self.observations, prompt, project, limit)

    def stats(self) -> DataFrame:
        return aggregates.store_stats(self.observations, self.sessions, self.prompts)

    def project_stats(self) -> DataFrame:
        return aggregates.project_stats(self.observations, self.sessions, self.prompts)

    def doctor(self, code: str | None = None) -> DataFrame:
        return quality.report(self.observations, self.sessions, self.prompts, self.relations, self.indexes()[0], code)

    def health(self, code: str | None = None, prompt_index: index.Index | None = None) -> DataFrame:
        """(code, ok, detail) under the codes of doctor.CODES, one scan a table; prompts have no stored index, so theirs is given."""
        exact, stemmed = self.indexes()
        held = {"observation_fts": stemmed, "observation_exact_fts": exact} | ({"prompt_fts": prompt_index} if prompt_index is not None else {})
        return doctor.report(self.observations, self.sessions, self.prompts, held, code)

    def suggest_topic_key(self, kind: str, title: str, content: str) -> DataFrame:
        row = self.observations.sparkSession.createDataFrame([(kind, title, content)], "kind string, title string, content string")
        return row.select(T.suggest_topic_key(F.col("kind"), F.col("title"), F.col("content")).alias("topic_key"))

    def caveats(self, ids: DataFrame | None = None) -> DataFrame:
        return relations.caveats(self.relations, self.observations, ids)

    def compare(self, limit: int = 10) -> DataFrame:
        return relations.judgeable(self.relations, self.observations, limit)

    def candidates(self, saved: DataFrame) -> DataFrame:
        return relations.candidates(self.indexes()[1], self.observations, saved, self.relations)

    def export(self, project: str | None = None) -> dict[str, DataFrame]:
        return projects.export(project, self.observations, self.sessions, self.prompts, self.relations)

    # what can be done

    def save_notes(self, saves: DataFrame) -> tuple["NoteStore", DataFrame]:
        """The store after a batch of saves, and what became of each: inserted, revised, deduplicated or why it was refused."""
        delta, outcomes = writes.save_delta(self.observations, saves)
        return self._put(self._hit(delta), delta), outcomes

    def save_note(self, session_id: str, kind: str, title: str, content: str, project: str | None = None, scope: str | None = None, topic_key: str | None = None) -> tuple["NoteStore", DataFrame]:
        top = self.observations.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        row = [(top + 1, session_id, kind, title, content, project, scope, topic_key)]
        one = self.observations.sparkSession.createDataFrame(row, "id long, session_id string, type string, title string, content string, project string, scope string, topic_key string")
        return self.save_notes(one.withColumn("created_at", self.as_of))

    def save_prompts(self, new: DataFrame) -> tuple["NoteStore", DataFrame]:
        prompts, outcomes = writes.save_prompts(self.prompts, new)
        kept = prompts.join(outcomes.where("outcome = 'inserted'").select("id"), "id", "left_semi")
        return replace(self, prompts=prompts)._told(prompt=(self.prompts.limit(0), kept)), outcomes

    def update(self, patches: DataFrame) -> "NoteStore":
        """Live notes after patches. The pending relations of a note that moves to another project are given up if their other end is elsewhere, and a peer
        that watches the project it left is told that it is gone."""
        before = self._hit(patches).where("deleted_at is null")
        delta = written(writes.update(before, patches, self.as_of), "delta")
        was = before.select("id", F.coalesce("project", F.lit("")).alias("_was"))
        moved = delta.join(was, "id").where(F.coalesce("project", F.lit("")) != F.col("_was"))
        rel = relations.after_move(self.relations, moved, writes.merged(self.observations, delta)).select(*self.relations.columns)
        return self._put(before, delta, relations=rel)

    def review(self, ids: DataFrame) -> "NoteStore":
        return self._put(before := self._hit(ids), written(writes.mark_reviewed(before, ids, self.as_of), "delta"), text=False)

    def pin(self, ids: DataFrame) -> "NoteStore":
        return self._put(before := self._hit(ids), written(writes.set_pinned(before, ids, True), "delta"), text=False)

    def unpin(self, ids: DataFrame) -> "NoteStore":
        return self._put(before := self._hit(ids), written(writes.set_pinned(before, ids, False), "delta"), text=False)

    def rebuild_indexes(self) -> tuple["NoteStore", DataFrame]:
        """(the store with both indexes built anew, documents of each before and after)."""
        names = ("observation_exact_fts", "observation_fts")
        made = (index.build(self.observations), index.build(self.observations, stemmed=True))
        return replace(self, held=made), doctor.sizes(dict(zip(names, self.held or ())), dict(zip(names, made)))

    def rehash(self) -> tuple["NoteStore", DataFrame]:
        """(the store with the hashes of live notes worked out anew, one row: stale ones before and after). Only notes whose hash was stale are written."""
        before = written(self._hit(quality.stale_hashes(self.observations)), "stale")
        after = written(quality.rehashed(before), "delta")
        n = lambda df, name: quality.stale_hashes(df).agg(F.count("*").alias(name))
        return self._put(before, after, text=False), n(before, "before").crossJoin(n(after, "after"))  # one row each

    def delete(self, ids: DataFrame, hard: bool = False) -> "NoteStore":
        """Notes marked as deleted, or removed for good with their words; their relations are orphaned then. Peers are told either way."""
        if not hard:
            before = self._hit(ids).where("deleted_at is null")
            return self._put(before, written(writes.delete(before, ids, self.as_of), "delta"), text=False)
        gone = written(self._hit(ids), "gone")
        rel = relations.after_removal(self.relations, gone.select("sync_id"))
        out = replace(self, observations=writes.delete(self.observations, gone, self.as_of, True), relations=rel, held=self._indexed(gone=gone.select("id")))
        return out._told(observation=(gone, gone.limit(0)))

    def session_start(self, new: DataFrame) -> "NoteStore":
        after = writes.create_sessions(self.sessions, new)
        born = after.join(new.select("id").distinct(), "id", "left_semi").join(self.sessions.select("id"), "id", "left_anti")
        return replace(self, sessions=after)._told(session=(self.sessions.limit(0), written(born, "born")))

    def session_end(self, ended: DataFrame) -> "NoteStore":
        before = self.sessions.join(ended.select("id").distinct(), "id", "left_semi")
        after = written(writes.end_session(before, ended), "ended")
        every = self.sessions.join(after.select("id"), "id", "left_anti").unionByName(after)
        return replace(self, sessions=every)._told(session=(before, after))

    def merge_projects(self, mapping: DataFrame) -> "NoteStore":
        """Notes, sessions and prompts under the canonical names, which take over the enrolment of what they replace."""
        of = lambda df: df.join(mapping.select("project").distinct(), "project", "left_semi").select(*df.columns)
        before = {t: of(getattr(self, t)) for t in ("observations", "sessions", "prompts")}
        after = {t: written(projects.merge(b, mapping), "merged") for t, b in before.items()}
        tables = {t: writes.merged(getattr(self, t), a) for t, a in after.items()}
        enrolled = projects.merged_enrolment(self.enrolled, mapping) if self.enrolled is not None else None
        out = replace(self, **tables, held=self._indexed(after["observations"]), enrolled=enrolled)
        return out._told(session=(before["sessions"], after["sessions"]), observation=(before["observations"], after["observations"]), prompt=(before["prompts"], after["prompts"]))

    def judge(self, verdicts: DataFrame) -> "NoteStore":
        good = relations.judge(verdicts, self.relations, self.observations).where("outcome = 'ok'").select("sync_id", F.col("relation").alias("_r"), F.col("confidence").alias("_c"))
        now = self.relations.join(good, "sync_id", "left")
        cols = {"relation": F.coalesce("_r", "relation"), "confidence": F.coalesce("_c", "confidence"), "judgment_status": F.when(F.col("_r").isNotNull(), "judged").otherwise(F.col("judgment_status"))}
        after = now.withColumns(cols).select(*self.relations.columns)
        out = replace(self, relations=after)
        if self.mutations is None or self.enrolled is None:
            return out
        seen = lambda df: journal.watched_relations(df.join(good.select("sync_id"), "sync_id", "left_semi"), self.observations, self.enrolled)
        return out._told(relation=(seen(self.relations), seen(after)))

    def scan_by_meaning(self, project: str, template: str, compare, limit: int = 10, max_pairs: int = 100, batch: int = 5) -> tuple["NoteStore", DataFrame]:
        """(the store with a judge's verdicts on candidate pairs of a project, a summary of one row), see relations.scan_by_meaning."""
        after, summary = relations.scan_by_meaning(self.indexes()[1], self.observations, self.relations, project, template, compare, self.as_of, limit, max_pairs, batch)
        out = replace(self, relations=after)
        if self.mutations is None or self.enrolled is None:
            return out, summary
        seen = lambda df: journal.watched_relations(df, self.observations, self.enrolled)
        return out._told(relation=(seen(self.relations), seen(after))), summary

    def delete_prompts(self, gone: DataFrame) -> "NoteStore":
        p, t = writes.delete_prompts(self.prompts, self.prompt_deletions, gone, self.as_of)
        before = self.prompts.join(gone.select("sync_id").distinct(), "sync_id", "left_semi")
        return replace(self, prompts=p, prompt_deletions=t)._told(prompt=(before, before.limit(0)))

    def import_(self, theirs: dict[str, DataFrame]) -> "NoteStore":
        ours = {t: getattr(self, t) for t in ("sessions", "observations", "prompts", "relations")}
        new = projects.import_new(theirs, ours, self.prompt_deletions)
        added = {t: ours[t].limit(0).unionByName(new[t].select(*[c for c in ours[t].columns if c in new[t].columns]), allowMissingColumns=True) for t in ours}
        added["observations"] = written(added["observations"], "imported")
        return replace(self, **{t: ours[t].unionByName(added[t]) for t in ours}, held=self._indexed(added["observations"]))

    def apply(self, mutations: DataFrame) -> tuple["NoteStore", DataFrame, DataFrame]:
        """(the store after a page of a peer's changes, relations that wait for an end, changes refused)."""
        rows, removed, odd = peers.observations(self.observations, mutations, self.as_of)
        sessions, ended = peers.sessions(self.sessions, mutations, self.as_of)
        prompts, tombs, odd2 = peers.prompts(self.prompts, self.prompt_deletions, mutations, ended, self.as_of)
        edges, waiting = peers.relations(self.relations, rows, removed, mutations)
        keys = mutations.where("entity = 'observation'")
        touched = written(rows.join(peers.named(keys, "observation", "sync_id"), "sync_id", "left_semi"), "touched") if self.held is not None else None
        held = self._indexed(touched, self.observations.join(removed, "sync_id", "left_semi").select("id"))
        return replace(self, observations=rows, sessions=sessions, prompts=prompts, prompt_deletions=tombs, relations=edges, held=held), waiting, odd.unionByName(odd2)
