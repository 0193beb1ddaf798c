"""The graph of judged relations between notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written
from . import blocks, bm25
from .index import Index
from .search import SAMPLE, upper_median

CANDIDATE_LIMIT, CANDIDATE_FLOOR, CANDIDATE_MARGIN = 3, -2.0, 1.25
#: So many documents of the rarest words give a query its first bound.
RARE = 8 * SAMPLE


def pair(a: Column, b: Column) -> list[Column]:
    """Both ends in a fixed order: an unordered pair as a key for a plain equality join."""
    return [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]


def titled(relations: DataFrame, rows: DataFrame) -> DataFrame:
    """Relations with the titles and projects of their live ends."""
    live = rows.where("deleted_at is null")
    s = live.select(F.col("sync_id").alias("source_id"), F.col("title").alias("source_title"), F.col("project").alias("source_project"))
    t = live.select(F.col("sync_id").alias("target_id"), F.col("title").alias("target_title"), F.col("project").alias("target_project"))
    return relations.join(s, "source_id", "left").join(t, "target_id", "left")


def listed(relations: DataFrame, rows: DataFrame, project: str | None = None, status: str | None = None, since=None, offset: int = 0, limit: int | None = 50) -> DataFrame:
    out = titled(relations, rows)
    if project:
        out = out.where((F.col("source_project") == project) | (F.col("target_project") == project))
    if status:
        out = out.where(F.col("judgment_status") == status)
    if since is not None:
        out = out.where(F.col("created_at") >= F.lit(since))
    out = out.orderBy(F.desc("created_at"), F.desc("id"))
    return out.offset(offset).limit(limit) if limit else out


def judgeable(relations: DataFrame, rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Pending pairs whose ends both exist and are not of two named projects; a deleted end shows no title."""
    def end(name: str) -> DataFrame:
        return rows.select(F.col("sync_id").alias(f"{name}_id"), F.when(F.col("deleted_at").isNull(), F.col("title")).alias(f"{name}_title"), F.coalesce("project", F.lit("")).alias(f"{name}_project"))

    j = relations.where("judgment_status = 'pending'").join(end("source"), "source_id").join(end("target"), "target_id")
    ok = (F.col("source_project") == "") | (F.col("target_project") == "") | (F.col("source_project") == F.col("target_project"))
    out = j.where(ok).select("id", "sync_id", "source_id", "target_id", "source_title", "target_title", "created_at").orderBy("created_at", "id")
    return out.limit(limit) if limit else out


def caveats(relations: DataFrame, rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, verb, other, relation_id): who is superseded is warned of it; who is in conflict is warned on both ends. One row of each, the first."""
    live = rows.where("deleted_at is null")
    ends = live.select(F.col("sync_id").alias("source_id"), F.col("id").alias("s")), live.select(F.col("sync_id").alias("target_id"), F.col("id").alias("t"))
    j = relations.where("judgment_status = 'judged' and relation in ('supersedes', 'conflicts_with')").join(ends[0], "source_id").join(ends[1], "target_id")
    warn = F.when(F.col("relation") == "supersedes", F.array(F.struct(F.col("t").alias("id"), F.lit("superseded_by").alias("verb"), F.col("s").alias("other")))).otherwise(
        F.array(F.struct(F.col("s").alias("id"), F.lit("conflicts_with").alias("verb"), F.col("t").alias("other")), F.struct(F.col("t").alias("id"), F.lit("conflicts_with").alias("verb"), F.col("s").alias("other")))
    )
    out = j.select(F.col("id").alias("relation_id"), F.explode(warn).alias("w")).select("relation_id", "w.*")
    if ids is not None:
        out = out.join(ids.select("id"), "id", "left_semi")
    return out.groupBy("id", "verb", "other").agg(F.min("relation_id").alias("relation_id"))


def pair_is_judged(relations: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with whether a judged relation joins them in either order."""
    known = relations.where("judgment_status = 'judged'").select(*pair(F.col("source_id"), F.col("target_id"))).distinct().withColumn("judged", F.lit(True))
    return pairs.select("a", "b", *pair(F.col("a"), F.col("b"))).join(known, ["lo", "hi"], "left").select("a", "b", F.coalesce("judged", F.lit(False)).alias("judged"))


def bounded_scores(asked: DataFrame, parts: DataFrame, allowed, most: int = SAMPLE, rare: int | None = None) -> DataFrame:
    """(qid, doc_id, score), score being minus the sum of the parts: every query's `most` best allowed documents with their whole scores, and others.

    asked: (qid, phrase, group), once for each time a word is said; parts: (phrase, group, doc_id, part), part > 0; allowed: a function that takes
    pairs (qid, doc_id, ...) and leaves out those that may not be answers. What the words of a query can add is bounded by their largest
    part in the group. The rarest words, up to `rare` documents, come first; the `most`-th best of what they find is a bound that an answer must reach.
    Words that cannot reach it together, the weakest first, bring no documents of their own: their parts are looked up for documents that others have found.
    So a word that stands everywhere joins with as many documents as are found, not with all. A query that finds fewer uses all its words."""
    rare = RARE if rare is None else rare
    key = ["phrase", "group"]
    bound = parts.groupBy(*key).agg(F.count("*").alias("n"), F.max("part").alias("top"))
    words = asked.groupBy("qid", *key).agg(F.count("*").alias("times")).join(bound, key).withColumn("bound", F.col("times") * F.col("top"))
    before = F.sum("n").over(Window.partitionBy("qid").orderBy("n", "phrase").rowsBetween(Window.unboundedPreceding, -1))
    words = written(words.withColumn("early", F.coalesce(before, F.lit(0)) < rare), "words")
    meet = lambda w: w.join(parts, key).select("qid", "doc_id", (F.col("times") * F.col("part")).alias("part"))
    first = written(meet(words.where("early")).groupBy("qid", "doc_id").agg(F.sum("part").alias("part")), "first")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("part"), "doc_id"))
    least = allowed(first).withColumn("place", place).where(F.col("place") <= most).groupBy("qid").agg(F.min("part").alias("least"), F.count("*").alias("k")).where(F.col("k") == most).select("qid", "least")
    reach = F.sum("bound").over(Window.partitionBy("qid").orderBy("bound", "phrase").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    late = words.where("not early").withColumn("reach", reach).join(least, "qid", "left")
    late = written(late.withColumn("idle", F.coalesce(F.col("reach") < F.col("least") * (1 - 1e-9), F.lit(False))), "late")
    found = written(first.unionByName(meet(late.where("not idle"))).groupBy("qid", "doc_id").agg(F.sum("part").alias("part")), "found")
    looked = found.select("qid", "doc_id").join(late.where("idle").select("qid", *key, "times"), "qid").join(parts, [*key, "doc_id"]).select("qid", "doc_id", (F.col("times") * F.col("part")).alias("part"))
    return found.unionByName(looked).groupBy("qid", "doc_id").agg((F.lit(0.0) - F.sum("part")).alias("score"))


def candidates(index: Index, rows: DataFrame, saved: DataFrame, relations: DataFrame | None = None, limit: int = CANDIDATE_LIMIT, floor: float = CANDIDATE_FLOOR) -> DataFrame:
    """(source, candidate, score): for each saved note, notes of its project and scope whose text its title matches.

    All saved notes at once. What a word adds to the score of a note is worked out once for each different word of the titles; titles and
    notes of a project and scope then meet by blocks (`blocks.best`), and only the best of a block are kept. An index that is a plan over these
    rows is not made: the rows are read once (`blocks.documents`). A word of a title counts as
    often as it stands there. A full sample keeps only what is well below its median.
    """
    group = F.struct(F.coalesce("project", F.lit("")).alias("project"), "scope").alias("group")
    words = saved.select(F.col("id").alias("qid"), group, F.explode(F.split(T.one_line(F.col("title")), " ")).alias("word")).select("qid", "group", F.array_join(T.tokens(F.col("word")), " ").alias("phrase")).where("phrase <> ''")
    may = f"deleted_at is null and type <> '{T.SESSION_SUMMARY}'"
    if index.of is not None and index.of[0] is rows:
        words = written(blocks.worded(words).drop("phrase"), "words")
        docs, idf = blocks.documents(index, words, bm25.CANDIDATE_WEIGHTS, group=group, may=F.expr(may))
        parts = docs.where("may").drop("may")
        asked = words.select("qid", "group", "word").join(idf, "word", "left")
    else:
        known = blocks.named(words)
        parts = written(blocks.parts(index, known, bm25.CANDIDATE_WEIGHTS).join(rows.where(may).select(F.col("id").alias("doc_id"), group), "doc_id"), "parts")
        asked = words.join(known, "phrase").select("qid", "group", "word")
    skip = None
    if relations is not None:
        ends = relations.select("source_id", "target_id").unionByName(relations.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))).distinct()
        skip = ends.join(saved.select(F.col("id").alias("qid"), F.col("sync_id").alias("source_id")), "source_id").join(rows.select(F.col("id").alias("doc_id"), F.col("sync_id").alias("target_id")), "target_id").select("qid", "doc_id")
    fit = blocks.best(asked, parts, SAMPLE, skip)
    place = F.row_number().over(Window.partitionBy("qid").orderBy("score", "doc_id"))
    top = fit.select("qid", "doc_id", "score", place.alias("place")).where(F.col("place") <= SAMPLE)
    whole = Window.partitionBy("qid")
    top = top.withColumn("n", F.count("*").over(whole)).withColumn("middle", upper_median(F.collect_list("score").over(whole)))
    keep = (F.col("score") <= floor) & ((F.col("n") < SAMPLE) | (F.col("score") <= F.col("middle") * CANDIDATE_MARGIN))
    return top.where(keep & (F.col("place") <= SAMPLE)).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("score", "doc_id"))).where(F.col("place") <= limit).select(F.col("qid").alias("source"), F.col("doc_id").alias("candidate"), "score")


def scan_project(index: Index, rows: DataFrame, project: str, relations: DataFrame, limit: int = 10, cap: int = 100) -> DataFrame:
    """Unordered pairs (lo, hi, score) over all live notes of a project, related ones skipped, in order of the first note."""
    mine = rows.where((F.col("project") == project) & F.col("deleted_at").isNull())
    found = candidates(index, rows, mine, relations, limit)
    best = found.select(F.least("source", "candidate").alias("lo"), F.greatest("source", "candidate").alias("hi"), "source", "score").groupBy("lo", "hi").agg(F.min(F.struct("source", "score")).alias("f"))
    return best.select("lo", "hi", "f.source", "f.score").orderBy("source", "score", "lo", "hi").limit(cap)


def pending_edges(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Candidates as pending relations with deterministic names."""
    ids = rows.select("id", "sync_id")
    s = found.join(ids.withColumnRenamed("id", "source").withColumnRenamed("sync_id", "source_id"), "source").join(ids.withColumnRenamed("id", "candidate").withColumnRenamed("sync_id", "target_id"), "candidate")
    return s.select(T.sync_id("rel", F.col("source_id"), F.col("target_id")).alias("sync_id"), "source_id", "target_id", F.lit("related").alias("relation"), F.lit("pending").alias("judgment_status"))


def judge(verdicts: DataFrame, relations: DataFrame, rows: DataFrame) -> DataFrame:
    """verdicts (sync_id, relation, confidence, reason) with what became of them: ok or why they were refused."""
    ends = rows.select("sync_id", F.coalesce("project", F.lit("")).alias("project"))
    j = verdicts.join(relations.select("sync_id", "source_id", "target_id", F.lit(True).alias("known")), "sync_id", "left")
    j = j.join(ends.select(F.col("sync_id").alias("source_id"), F.col("project").alias("sp")), "source_id", "left").join(ends.select(F.col("sync_id").alias("target_id"), F.col("project").alias("tp")), "target_id", "left")
    why = (
        F.when(~F.col("relation").isin(*T.RELATION_VERBS), "unknown_verb")
        .when(~T.is_confidence(F.col("confidence")), "bad_confidence")
        .when(F.col("known").isNull(), "unknown_relation")
        .when(F.col("sp").isNull() | F.col("tp").isNull(), "missing_end")
        .when((F.col("sp") != F.col("tp")) & (F.col("sp") != "") & (F.col("tp") != ""), "different_projects")
        .otherwise("ok")
    )
    return j.select("sync_id", "relation", "confidence", T.strip_private(F.col("reason")).alias("reason"), why.alias("outcome"))


def judge_by_meaning(verdicts: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations after verdicts (source_id, target_id, relation, confidence) on unordered pairs: no conflict changes nothing, a
    known pair keeps its least id and takes the verdict, a new one is added without an id."""
    v = verdicts.where("relation <> 'not_conflict'").select("*", *pair(F.col("source_id"), F.col("target_id")))
    first = relations.select("*", *pair(F.col("source_id"), F.col("target_id"))).groupBy("lo", "hi").agg(F.min("id").alias("id"))
    j = v.join(first, ["lo", "hi"], "left").select("id", "source_id", "target_id", F.col("relation").alias("new_relation"), F.col("confidence").alias("new_confidence"))
    known = relations.join(j.where("id is not null").select("id", "new_relation", "new_confidence"), "id", "left")
    kept = known.select("id", "source_id", "target_id", F.coalesce("new_relation", "relation").alias("relation"), F.coalesce("new_confidence", "confidence").alias("confidence"), F.when(F.col("new_relation").isNotNull(), "judged").otherwise(F.col("judgment_status")).alias("judgment_status"))
    new = j.where("id is null").select("id", "source_id", "target_id", F.col("new_relation").alias("relation"), F.col("new_confidence").alias("confidence"), F.lit("judged").alias("judgment_status"))
    return kept.unionByName(new)


def after_removal(relations: DataFrame, gone: DataFrame) -> DataFrame:
    """Relations with an end among removed notes (sync_id) are orphaned, whatever their status."""
    ends = relations.select("id", F.explode(F.array("source_id", "target_id")).alias("sync_id")).join(gone.select("sync_id"), "sync_id", "left_semi").select("id").distinct().withColumn("gone", F.lit(True))
    return relations.join(ends, "id", "left").withColumn("judgment_status", F.when(F.col("gone"), "orphaned").otherwise(F.col("judgment_status"))).drop("gone")


def after_move(relations: DataFrame, moved: DataFrame, rows: DataFrame) -> DataFrame:
    """Pending relations of moved notes are orphaned if the other end is of a different named project: nobody can judge them any more."""
    p = rows.select("sync_id", F.coalesce("project", F.lit("")).alias("project"))
    j = relations.join(p.select(F.col("sync_id").alias("source_id"), F.col("project").alias("sp")), "source_id", "left").join(p.select(F.col("sync_id").alias("target_id"), F.col("project").alias("tp")), "target_id", "left")
    m = moved.select("sync_id").distinct()
    j = j.join(m.select(F.col("sync_id").alias("source_id"), F.lit(True).alias("ms")), "source_id", "left").join(m.select(F.col("sync_id").alias("target_id"), F.lit(True).alias("mt")), "target_id", "left")
    strand = (F.col("judgment_status") == "pending") & (F.coalesce("ms", F.lit(False)) | F.coalesce("mt", F.lit(False))) & (F.col("sp") != F.col("tp")) & (F.col("sp") != "") & (F.col("tp") != "")
    return j.withColumn("judgment_status", F.when(strand, "orphaned").otherwise(F.col("judgment_status"))).drop("sp", "tp", "ms", "mt")


def semantic_scan(pairs: DataFrame, compare, max_pairs: int = 100, batch: int = 5) -> DataFrame:
    """Pairs (lo, hi, a, b) with the verdict of an injected judge, `compare(a, b) -> text`, run in bounded batches on the executors."""
    from ..functions.markdown import verdict

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        import pandas as pd

        with ThreadPoolExecutor(batch) as pool:
            for b in batches:
                got = [verdict(x) or {} for x in pool.map(compare, b["a"], b["b"])]
                yield pd.DataFrame({"lo": b["lo"], "hi": b["hi"], "relation": [g.get("relation") for g in got], "confidence": [g.get("confidence") for g in got]})

    return pairs.limit(max_pairs).mapInPandas(run, "lo long, hi long, relation string, confidence double")


def save_verdicts(verdicts: DataFrame, relations: DataFrame, as_of: Column) -> DataFrame:
    """Relations after verdicts (source_id, target_id, relation, confidence, reason), at most one for an unordered pair: no conflict changes nothing, a known pair
    takes the verdict on its oldest relation, a new pair gets a relation of its own with the next ids."""
    v = verdicts.where("relation <> 'not_conflict'").select(*pair(F.col("source_id"), F.col("target_id")), *(F.col(c).alias(f"_{c}") for c in ("source_id", "target_id", "relation", "confidence", "reason")))
    v = v.withColumn("_reason", T.strip_private(F.col("_reason")))
    first = relations.select("id", *pair(F.col("source_id"), F.col("target_id"))).groupBy("lo", "hi").agg(F.min("id").alias("id"))
    j = written(v.join(first, ["lo", "hi"], "left").drop("lo", "hi"), "verdicts")
    given = {"relation": F.col("_relation"), "confidence": F.col("_confidence"), "reason": F.col("_reason"), "judgment_status": F.lit("judged"), "updated_at": as_of}
    given = {c: x for c, x in given.items() if c in relations.columns}
    known = j.where("id is not null").drop("_source_id", "_target_id").withColumn("_hit", F.lit(True))
    kept = relations.join(known, "id", "left").withColumns({c: F.when(F.col("_hit"), x).otherwise(F.col(c)) for c, x in given.items()}).select(*relations.columns)
    top = relations.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = written(j.where("id is null").drop("id").repartitionByRange("_source_id", "_target_id").sortWithinPartitions("_source_id", "_target_id").withColumn("id", F.monotonically_increasing_id()), "new-verdicts")
    new = new.crossJoin(F.broadcast(top)).withColumns({"id": F.col("top") + 1 + F.col("id"), "source_id": F.col("_source_id"), "target_id": F.col("_target_id"), "sync_id": T.sync_id("rel", F.col("_source_id"), F.col("_target_id")), "created_at": as_of, **given, "updated_at": as_of})  # one row
    return kept.unionByName(new.select(*(c for c in relations.columns if c in new.columns)), allowMissingColumns=True)


def scan_by_meaning(index: Index, rows: DataFrame, relations: DataFrame, project: str, template: str, compare, as_of: Column, limit: int = 10, max_pairs: int = 100, batch: int = 5) -> tuple[DataFrame, DataFrame]:
    """(relations afterwards, a summary of one row) of a judge's look at a project: `compare(prompt) -> text` on the executors, `batch` at a time.

    Pairs are the candidates of all live notes of the project, each unordered pair once, under the youngest note that has it. Pairs that were judged before are
    counted and not asked, so they take nothing of `max_pairs`, which bounds the calls to the judge. Answers are written as a table before they are stored;
    an answer that cannot be read, or a judge that fails, counts as an error and changes nothing. template: a prompt with {a_id} {a_title} {a_content} {b_id} {b_title} {b_content}."""
    from ..functions.markdown import verdict

    mine = rows.where((F.col("project") == T.project(F.lit(project))) & F.col("deleted_at").isNull())
    found = candidates(index, rows, mine, None, limit)
    a = mine.select(F.col("id").alias("source"), F.col("sync_id").alias("a"), F.col("created_at").alias("at"))
    both = found.join(a, "source").join(rows.select(F.col("id").alias("candidate"), F.col("sync_id").alias("b")), "candidate")
    pairs = both.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.max_by(F.struct("source", "candidate", "a", "b", "at", "score"), F.struct("at", "source")).alias("p")).select("p.*")
    pairs = written(pair_is_judged(relations, pairs.select("a", "b")).join(pairs, ["a", "b"]), "pairs")
    asked = written(pairs.where("not judged").orderBy(F.desc("at"), F.desc("source"), "score", "candidate").limit(max_pairs), "asked")
    text = lambda which: rows.select(F.col("sync_id").alias(which), F.col("title").alias(f"{which}_title"), F.col("content").alias(f"{which}_content"))
    full = asked.join(text("a"), "a").join(text("b"), "b")
    full = full.select("a", "b", T.filled(template, a_id=F.col("a"), a_title=F.col("a_title"), a_content=F.col("a_content"), b_id=F.col("b"), b_title=F.col("b_title"), b_content=F.col("b_content")).alias("prompt"))

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        import pandas as pd

        def one(prompt):
            try:
                return verdict(compare(prompt)) or {}
            except Exception:  # noqa: BLE001  a judge that fails for one pair must not lose the others
                return {}

        with ThreadPoolExecutor(batch) as pool:
            for b in batches:
                got = list(pool.map(one, b["prompt"]))
                yield pd.DataFrame({"source_id": b["a"], "target_id": b["b"], **{c: [g.get(c) for g in got] for c in ("relation", "confidence", "reason")}})

    answers = written(full.mapInPandas(run, "source_id string, target_id string, relation string, confidence double, reason string"), "answers")
    n = answers.agg(F.count("*").alias("pairs"), F.count_if(F.col("relation") != "not_conflict").alias("judged"), F.count_if(F.col("relation") == "not_conflict").alias("skipped"), F.count_if(F.col("relation").isNull()).alias("errors"))
    summary = n.crossJoin(pairs.agg(F.count_if(F.col("judged")).alias("already_judged"))).crossJoin(mine.agg(F.count("*").alias("inspected")))  # one row each
    summary = summary.select(T.project(F.lit(project)).alias("project"), "inspected", "pairs", "judged", "skipped", "already_judged", "errors", (F.col("pairs") >= max_pairs).alias("capped"))
    return save_verdicts(answers.where("relation is not null"), relations, as_of), summary
