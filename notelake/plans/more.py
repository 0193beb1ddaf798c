"""More queries of the catalogue: lists, sinks, sources and checks that stand for themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.markdown import canonical_json_udf, verdict_udf
from ..operators import aggregates as A
from ..operators import listings as L
from ..operators import bm25, doctor, index, journal, peers, projects, quality, relations, search, segments, writes
from ..session import shared_folder
from ..sources import adapters as D
from ..sources import exchange, schemas, sqlite
from ..streaming import keyed
from ..streaming import replication as R
from . import oracle as O
from .catalog import _CAND, AS_OF, PREFIX, as_of, at, listed_index, obs_index, query, saved_index, text_index
from .oracle import LIVE, LOG, LOG_SESSIONS, MUTATIONS, OBS, PROMPTS, RELATIONS, stamp, with_

# deferred changes

_DEFERRED = "deferred AS (SELECT 'd-' || event_id AS sync_id, ['applied', 'deferred', 'dead'][event_id % 3 + 1] AS apply_status, CASE WHEN event_id % 4 = 0 THEN 'x' || props ELSE props END AS payload, ts AS first_seen_at FROM events)"


def deferred(s, d):
    i = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, ("applied", "deferred", "dead"))), (i % 3 + 1).cast("int"))
    payload = F.when(i % 4 == 0, F.concat(F.lit("x"), "props")).otherwise(F.col("props"))
    return D.table(s, d, "events").select(F.concat(F.lit("d-"), i.cast("string")).alias("sync_id"), status.alias("apply_status"), payload.alias("payload"), F.col("ts").alias("first_seen_at"))


@query("deferred_page", with_(_DEFERRED, body="SELECT sync_id, NOT starts_with(payload, 'x') AS payload_valid FROM deferred WHERE apply_status = 'dead' ORDER BY first_seen_at, sync_id LIMIT 20 OFFSET 10"))
def deferred_page(s, d):
    return L.deferred_page(deferred(s, d), "dead", 10, 20).select("sync_id", "payload_valid")


@query("deferred_counts", with_(_DEFERRED, body="SELECT count(*) FILTER (apply_status = 'deferred') AS n_deferred, count(*) FILTER (apply_status = 'dead') AS n_dead FROM deferred"))
def deferred_counts(s, d):
    return A.deferred_counts(deferred(s, d))


# what a peer holds, sends and asks


@query("peer_stats", with_(MUTATIONS, LOG_SESSIONS, body="SELECT (SELECT count(*) FROM mutations WHERE source = 'remote') AS n_chunks, (SELECT count(*) FROM mutations) AS n_mutations, (SELECT count(*) FROM lsessions) AS n_sessions, (SELECT count(DISTINCT project) FROM mutations) AS n_projects"))
def peer_stats(s, d):
    m = D.mutations(s, d)
    return R.peer_stats(m.where("source = 'remote'"), m, D.log_sessions(s, d))


@query("granted", "SELECT DISTINCT 'p' || (c_custkey % 40) AS principal FROM customer WHERE CASE WHEN c_custkey % 11 = 0 THEN '*' ELSE 'src' || (c_custkey % 20) END IN ('src3', '*')")
def granted(s, d):
    k = F.col("c_custkey")
    g = D.table(s, d, "customer").select(F.concat(F.lit("p"), (k % 40).cast("string")).alias("principal"), F.when(k % 11 == 0, "*").otherwise(F.concat(F.lit("src"), (k % 20).cast("string"))).alias("project"))
    return projects.granted(g, "src3")


_STATES = "states AS (SELECT 'cloud:' || c_custkey AS target_key, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'me' ELSE 'other' END AS lease_owner, CASE WHEN c_custkey % 3 > 0 THEN TIMESTAMP '2024-06-01 00:00:00' + to_minutes(c_custkey % 20 - 10) END AS lease_until FROM customer)"


def states(s, d):
    k, z = F.col("c_custkey"), F.lit(0)
    until = as_of() + F.make_interval(z, z, z, z, z, (k % 20 - 10).cast("int"), z)
    return D.table(s, d, "customer").select(F.concat(F.lit("cloud:"), k.cast("string")).alias("target_key"), F.when(k % 3 == 1, "me").when(k % 3 == 2, "other").alias("lease_owner"), F.when(k % 3 > 0, until).alias("lease_until"))


@query("leases", with_(_STATES, "g AS (SELECT *, target_key IN ('cloud:3', 'cloud:4', 'cloud:5', 'cloud:17') AND (lease_owner IS NULL OR lease_owner = 'me' OR lease_until <= TIMESTAMP '2024-06-01 00:00:00') AS mine FROM states)", body=f"SELECT target_key, CASE WHEN mine THEN 'me' ELSE lease_owner END AS lease_owner, CASE WHEN mine THEN '2024-06-01 00:01:00' ELSE {stamp('lease_until')} END AS lease_until FROM g"))
def leases(s, d):
    out = states(s, d)
    for k in (3, 4, 5, 17):
        out = R.leased(out, f"cloud:{k}", "me", as_of(), 60)
    return out.select("target_key", "lease_owner", at("lease_until"))


@query("journal_stream", with_(MUTATIONS, body="SELECT entity, entity_key, max(seq) AS seq, arg_max(op, seq) = 'delete' AS deleted FROM mutations GROUP BY entity, entity_key"))
def journal_stream(s, d):
    """The journal followed as a stream of files, with the end of each key as a row of state."""
    at_ = f"{shared_folder(s)}/notelake-journal-{uuid.uuid4().hex}"
    journal = D.mutations(s, d)
    journal.repartition(6, "seq").write.parquet(f"{at_}/in")
    keyed.follow(s, f"{at_}/in", journal.schema, f"{at_}/state", max_files=2, partitions=s.sparkContext.defaultParallelism).awaitTermination()
    return keyed.ends(s, f"{at_}/state").select("entity", "entity_key", "seq", "deleted")


_LATE = f"""notes AS (SELECT DISTINCT id, sync_id, created_at FROM obs),
 rels AS (SELECT DISTINCT doc_id, 'obs-' || doc_id AS source_id, 'obs-' || (doc_id + CASE WHEN (doc_id // 3) % 2 = 0 THEN 20 ELSE 1 END) AS target_id, TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id - doc_id % 9) + INTERVAL 10 MINUTE AS seen FROM documents WHERE doc_id % 3 = 0),
 w AS (SELECT greatest((SELECT max(created_at) FROM notes), (SELECT max(seen) FROM rels)) - INTERVAL 30 MINUTE AS watermark),
 ends AS (SELECT r.doc_id, r.seen, greatest(a.created_at, b.created_at, r.seen) AS ready, a.id IS NOT NULL AND b.id IS NOT NULL AS met FROM rels r LEFT JOIN notes a ON a.sync_id = r.source_id LEFT JOIN notes b ON b.sync_id = r.target_id)"""


@query("settled_relations", with_(OBS, _LATE, body="SELECT doc_id, CASE WHEN met AND ready <= seen + INTERVAL 5 HOUR THEN 'applied' WHEN seen + INTERVAL 5 HOUR <= watermark THEN 'dead' ELSE 'deferred' END AS apply_status, CASE WHEN met AND ready <= seen + INTERVAL 5 HOUR THEN CAST(floor(epoch(ready - seen) / 3600) AS INTEGER) WHEN seen + INTERVAL 5 HOUR <= watermark THEN 5 ELSE 0 END AS retry_count FROM ends, w"))
def settled_relations(s, d):
    """Relations that come up to eight hours before the note they start from, in three pages of a journal: applied, dead after five hours, or waiting."""
    home = f"{shared_folder(s)}/notelake-settled-{uuid.uuid4().hex}"
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    z = F.lit(0)
    later = lambda hours, minutes: start + F.make_interval(z, z, z, z, hours.cast("int"), F.lit(minutes))
    i = F.col("doc_id")
    docs = D.table(s, d, "documents").select("doc_id")
    row = lambda entity, key, body, hours, minutes: docs.select(
        ((hours * 60 + minutes) * 1000 + i % 1000).alias("seq"), F.lit(entity).alias("entity"), key.alias("entity_key"), F.lit("upsert").alias("op"), body.alias("payload"), later(hours, minutes).alias("occurred_at"), i.alias("doc_id"))
    obs = lambda k: F.concat(F.lit("obs-"), k.cast("string"))
    ends = F.to_json(F.struct(obs(i).alias("source_id"), obs(i + F.when(F.floor(i / 3) % 2 == 0, 20).otherwise(1)).alias("target_id")))
    rels = row("relation", F.concat(F.lit("rel-"), i.cast("string")), ends, i - i % 9, 10).where("doc_id % 3 = 0")
    journal = row("observation", obs(i), F.lit("{}"), i, 0).unionByName(rels)
    span = docs.agg(F.floor(F.coalesce(F.max("doc_id"), F.lit(0)) / 3).alias("third")).first()["third"] + 1
    for k in range(3):
        page = journal.where(F.least(F.floor((F.unix_seconds("occurred_at") - F.unix_seconds(start)) / 3600 / span), F.lit(2)) == k)
        page.drop("doc_id").write.mode("append").parquet(f"{home}/in")
        keyed.settle(s, f"{home}/in", page.drop("doc_id").schema, f"{home}/state", delay="30 minutes", max_files=100_000, partitions=s.sparkContext.defaultParallelism).awaitTermination()
    told = keyed.outcomes(s, f"{home}/state").select("change", "apply_status", "retry_count")
    told = told.unionByName(keyed.waiting(s, f"{home}/state").select("change", F.lit("deferred").alias("apply_status"), F.lit(0).alias("retry_count")))
    return told.join(rels.select(F.col("seq").alias("change"), "doc_id").distinct(), "change").select("doc_id", "apply_status", "retry_count")


@query("peer_session_removals", with_(LOG_SESSIONS, PROMPTS, "gone AS (SELECT id FROM lsessions WHERE CAST(id AS BIGINT) % 3 = 0 UNION ALL SELECT 'c' || k FROM range(0, 100, 2) t(k) UNION ALL SELECT ' ')", body="SELECT 'session' AS entity, count(*) AS n FROM lsessions WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'prompt', count(*) FROM prompts WHERE session_id NOT IN (SELECT id FROM gone)"))
def peer_session_removals(s, d):
    k = s.range(0, 100, 2).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"))
    gone = D.log_sessions(s, d).where("cast(id as bigint) % 3 = 0").select("id").unionByName(k).unionByName(s.createDataFrame([(" ",)], "id string"))
    left = R.delete_session(gone, D.log_sessions(s, d), D.prompts(s, d))
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n")
    return n(left[0], "session").unionByName(n(left[1], "prompt"))


# chunks and foreign tables

_CHUNKS = "chunks AS (SELECT event_type AS project, 'c' || (event_id // 2 % 500) AS chunk_id, CASE WHEN event_id % 7 = 0 THEN props ELSE 'same' END AS payload, ts AS created_at, CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 1 DAY END AS client_created_at FROM events)"


def chunks(s, d):
    i = F.col("event_id")
    name = F.concat(F.lit("c"), (F.floor(i / 2) % 500).cast("string"))
    return D.table(s, d, "events").select(F.col("event_type").alias("project"), name.alias("chunk_id"), F.when(i % 7 == 0, F.col("props")).otherwise("same").alias("payload"), F.col("ts").alias("created_at"), F.when(i % 3 == 0, F.col("ts") - F.expr("INTERVAL 1 DAY")).alias("client_created_at"))


@query("dedupe_chunks", with_(_CHUNKS, "g AS (SELECT project, chunk_id, count(DISTINCT payload) AS n FROM chunks GROUP BY project, chunk_id)", body="SELECT project, chunk_id, n > 1 AS conflict FROM g"))
def dedupe_chunks(s, d):
    kept, odd = exchange.dedupe_chunks(chunks(s, d))
    return kept.select("project", "chunk_id", F.lit(False).alias("conflict")).unionByName(odd.select("project", "chunk_id", F.lit(True).alias("conflict")))


@query("manifest", with_(_CHUNKS, body=f"SELECT chunk_id, {stamp('coalesce(client_created_at, created_at)')} AS created_at FROM chunks WHERE project = 'click'"))
def manifest(s, d):
    return exchange.manifest(chunks(s, d), "click").select("chunk_id", at("created_at"))


@query("read_chunks", "SELECT CAST(c_custkey AS VARCHAR) AS id, 'team' || (c_custkey % 7) AS project FROM customer WHERE c_custkey % 5 <> 0")
def read_chunks(s, d):
    session = F.struct("id", "project", "directory", "started_at")
    whole = D.log_sessions(s, d).select(F.when(F.col("id").cast("long") % 5 != 0, F.to_json(F.struct(F.array(session).alias("sessions")))).otherwise('{"sessions": null, "observations": []}').alias("payload"))
    return exchange.read_chunks(whole)["sessions"].select("id", "project")


@query("foreign_stores", with_(OBS, body=f"SELECT id, sync_id, session_id, type, title, content, project, scope, topic_key, {stamp('created_at')} AS created_at, {stamp('deleted_at')} AS deleted_at FROM obs WHERE type IN ('bugfix', 'decision', 'policy')"))
def foreign_stores(s, d):
    """The notes as SQLite stores, one a task, and what an adoption of some kinds reads of them."""
    ours = D.observations(s, d).drop("embedding")
    folder = f"{shared_folder(s)}/notelake-stores-{uuid.uuid4().hex}"
    sqlite.register(s)
    ours.withColumn("shelf", F.lit("x")).write.format(sqlite.NAME).option("table", "observations").mode("append").save(folder)
    theirs = sqlite.load(s, folder, "observations", filters=[("type", "in", ["bugfix", "decision", "policy"])])
    return quality.adopt(theirs, ours).select("id", "sync_id", "session_id", "type", "title", "content", "project", "scope", "topic_key", at("created_at"), at("deleted_at"))


@query("adopted_tables", with_(LOG, body="SELECT 'observations' AS name, count(*) AS before, count(*) AS after FROM log UNION ALL SELECT 'sessions', 0, 0"))
def adopted_tables(s, d):
    foreign = D.log(s, d).withColumn("shelf", F.lit(1)).drop("pinned")
    return exchange.adopt_tables({"observations": foreign}, {"observations": D.log(s, d), "sessions": D.log_sessions(s, d)})[1]


@query("export_files", with_(OBS, LOG_SESSIONS, PROMPTS, RELATIONS, body="SELECT 'observations' AS entity, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM obs UNION ALL SELECT 'prompts', count(*), CAST(sum(id) AS BIGINT) FROM prompts UNION ALL SELECT 'relations', count(*), CAST(sum(id) AS BIGINT) FROM relations r WHERE r.target_id IN (SELECT sync_id FROM obs)"))
def export_files(s, d):
    """An export of all projects as JSON lines, read back."""
    folder = f"{shared_folder(s)}/notelake-export-{uuid.uuid4().hex}"
    tables = projects.export(None, D.observations(s, d), D.log_sessions(s, d), D.prompts(s, d), D.relations(s, d))
    exchange.write_export(tables, folder)
    out = None
    for name in ("observations", "prompts", "relations"):
        one = s.read.schema("id long").json(f"{folder}/{name}").agg(F.lit(name).alias("entity"), F.count("*").alias("n"), F.sum("id").alias("ids"))
        out = one if out is None else out.unionByName(one)
    return out


_SLUG = "regexp_replace(regexp_replace(translate(lower({x}), '" + O.ACCENTED + "', '" + O.UNACCENTED + "'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def _slug(x: str) -> str:
    return f"(CASE WHEN {_SLUG.format(x=x)} = '' THEN 'untitled' ELSE {_SLUG.format(x=x)} END)"


_QUOTED = "'\"' || replace(replace(title, '\\', '\\\\'), '\"', '\\\"') || '\"'"
VAULT = with_(
    OBS,
    f"n AS (SELECT session_id, topic_key, {_slug('project')} || '/' || {_slug('title[1:60]')} || '-' || id AS stem, '---' || chr(10) || 'title: ' || {_QUOTED} || chr(10) || 'type: ' || type || chr(10) || '---' || chr(10) || chr(10) || content || chr(10) AS body FROM obs WHERE {LIVE})",
    body="SELECT stem || '.md' AS path, length(body) AS n_chars FROM n "
    + f"UNION ALL SELECT 'sessions/' || {_slug('session_id')} || '.md', length(session_id) + 5 + sum(length(stem) + 7)::BIGINT - 1 FROM n GROUP BY session_id "
    + f"UNION ALL SELECT 'topics/' || {_slug('topic_key')} || '.md', length(topic_key) + 5 + sum(length(stem) + 7)::BIGINT - 1 FROM n WHERE topic_key IS NOT NULL GROUP BY topic_key HAVING count(*) >= 2",
)


@query("vault_files", VAULT)
def vault_files(s, d):
    return exchange.vault(D.observations(s, d), D.log_sessions(s, d)).select("path", F.length("body").cast("long").alias("n_chars"))


@query("orphaned_files", with_(OBS, body=f"SELECT {_slug('project')} || '/' || {_slug('title[1:60]')} || '-' || id || '.md' AS path FROM obs WHERE {LIVE} AND id % 4 = 0"))
def orphaned_files(s, d):
    rows = D.observations(s, d)
    files = exchange.vault(rows.where("id % 4 <> 0"), D.log_sessions(s, d))
    mine = exchange.vault(rows, D.log_sessions(s, d)).where("path not like 'sessions/%' and path not like 'topics/%'")
    return exchange.orphaned(mine, files)


# saves


@query("prompt_echoes", "WITH RECURSIVE p AS (SELECT conv_id, turn, conv_id % 10 AS k, row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id // 10, conv_id * 1000 + turn) AS n, conv_id // 10 AS sec, conv_id * 1000 + turn AS id FROM conversations WHERE role = 'user'), f AS (SELECT id, k, n, sec AS anchor, id AS onto, 'inserted' AS outcome FROM p WHERE n = 1 UNION ALL SELECT p.id, p.k, p.n, CASE WHEN p.sec - f.anchor > 2 THEN p.sec ELSE f.anchor END, CASE WHEN p.sec - f.anchor > 2 THEN p.id ELSE f.onto END, CASE WHEN p.sec - f.anchor > 2 THEN 'inserted' ELSE 'deduplicated' END FROM f JOIN p ON p.k = f.k AND p.n = f.n + 1) SELECT id, outcome, onto FROM f")
def prompt_echoes(s, d):
    """Prompts of ten sessions that all say the same, one a second or more."""
    c = D.table(s, d, "conversations").where("role = 'user'")
    k = F.col("conv_id")
    p = c.select((k * 1000 + F.col("turn")).alias("id"), (k % 10).cast("string").alias("session_id"), F.lit("again").alias("content"), (F.to_timestamp(F.lit(D.START)).cast("double") + F.floor(k / 10)).cast("timestamp").alias("created_at"))
    return writes.prompt_echoes(p)


@query("deleted_prompts", with_(PROMPTS, body="SELECT 'prompt' AS what, sync_id FROM prompts WHERE id % 7 <> 0 UNION ALL SELECT 'tombstone', sync_id FROM prompts WHERE id % 7 = 0 UNION ALL SELECT 'tombstone', 'old-' || k FROM range(3) t(k)"))
def deleted_prompts(s, d):
    p = D.prompts(s, d)
    old = s.range(3).select(F.concat(F.lit("old-"), F.col("id").cast("string")).alias("sync_id"), F.lit("c1").alias("session_id"), F.lit("src1").alias("project"), as_of("2023-01-01 00:00:00").alias("deleted_at"))
    left, tombs = writes.delete_prompts(p, old, p.where("id % 7 = 0").select("sync_id"), as_of())
    return left.select(F.lit("prompt").alias("what"), "sync_id").unionByName(tombs.select(F.lit("tombstone").alias("what"), "sync_id"))


@query("passive_dedupe", with_(OBS, "items AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'new ' || (doc_id % 30) END AS content, source AS project FROM documents), k AS (SELECT *, sha256(lower(" + O.fold("content") + f")) AS h FROM items)", body=f"SELECT project, h AS normalized_hash, min(id) AS id FROM k WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.{LIVE} AND coalesce(o.project, '') = coalesce(k.project, '') AND o.normalized_hash = k.h) GROUP BY project, h"))
def passive_dedupe(s, d):
    i = F.col("doc_id")
    items = D.table(s, d, "documents").select(i.alias("id"), F.when(i % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("new "), (i % 30).cast("string"))).alias("content"), F.col("source").alias("project"))
    return writes.passive_dedupe(items, D.observations(s, d))


@query(
    "saved_notes",
    "WITH RECURSIVE s AS (SELECT doc_id AS id, doc_id % 3 = 0 AS keyed, doc_id % 5 AS t, doc_id % 2 AS p FROM documents), k AS (SELECT min(id) AS id, count(*) AS revision_count, 1 AS duplicate_count, 'body ' || max(id) AS content FROM s WHERE keyed GROUP BY t, p),"
    " r AS (SELECT id, p, row_number() OVER (PARTITION BY p ORDER BY id) AS n FROM s WHERE NOT keyed),"
    " f AS (SELECT id, p, n, id AS anchor FROM r WHERE n = 1 UNION ALL SELECT r.id, r.p, r.n, CASE WHEN r.id - f.anchor > 15 THEN r.id ELSE f.anchor END FROM f JOIN r ON r.p = f.p AND r.n = f.n + 1)"
    " SELECT id, revision_count, duplicate_count, content FROM k UNION ALL SELECT anchor, 1, count(*), 'again' FROM f GROUP BY anchor, p",
)
def saved_notes(s, d):
    """One save a minute into the stored notes: a third under topics, the others all alike."""
    rows = D.observations(s, d)
    i, z = F.col("id"), F.lit(0)
    keyed = i % 3 == 0
    when = F.to_timestamp(F.lit("2030-01-01 00:00:00")) + F.make_interval(z, z, z, z, z, i.cast("int"), z)
    number = lambda n: (i % n).cast("string")
    saves = rows.select(
        (i + 10_000_000).alias("id"), "session_id", F.lit("Fix").alias("type"), F.when(keyed, F.concat(F.lit(" t"), number(5))).otherwise("u").alias("title"), F.when(keyed, F.concat(F.lit("body "), i.cast("string"))).otherwise("again").alias("content"),
        F.concat(F.lit("new"), number(2)).alias("project"), F.when(keyed, F.concat(F.lit("K/"), number(5))).alias("topic_key"), when.alias("created_at"),
    )
    after, _ = writes.save(rows, saves)
    return after.where("id >= 10000000").select((i - 10_000_000).alias("id"), "revision_count", "duplicate_count", "content")


# search and relations


@query("elsewhere", with_(OBS, *O.index(), *O.scored({0: ["attion", "erble"]}), body=f"SELECT count(*) AS n FROM (SELECT o.id FROM scores JOIN obs o ON o.id = doc_id WHERE matched = 2 AND {LIVE} AND scope = 'project' LIMIT 100)"))
def elsewhere(s, d):
    rows, i = obs_index(s, d)
    return s.range(1).select(F.lit(search.elsewhere(i, rows, "attion erble", search.Filters(project="src3", scope="project"))).cast("long").alias("n"))


@query("project_search", with_(OBS, *O.index(), *O.scored({0: ["attion", "erble"]}), body=f"SELECT o.id, round(score, 6) + 0.0 AS score FROM scores JOIN obs o ON o.id = doc_id WHERE matched = 2 AND {LIVE} AND project = 'src3'"))
def project_search(s, d):
    """Narrowed to a project inside the index, once the words are counted in all of it."""
    rows, i = obs_index(s, d)
    mine = search.Filters(project=" SRC3 ")
    hits = search.bm25.match_all(i, "attion erble", within=search.within(i, mine))
    return search.narrowed(hits, rows, mine).select("id", (F.round("score", 6) + 0.0).alias("score"))


@query("prompt_page", with_(PROMPTS, *O.index("prompts", ("content", "project")), *O.scored({0: ["attion", "erb*"]}, {}), body="SELECT doc_id AS id, round(score, 6) + 0.0 AS score FROM scores WHERE matched = 2 ORDER BY scores.score, doc_id LIMIT 11 OFFSET 3"))
def prompt_page(s, d):
    i = saved_index(s, d, "prompts", ("content", "project"))
    return search.prompt_page(i, D.prompts(s, d), PREFIX, 3, 10).select("id", (F.round("score", 6) + 0.0).alias("score"))


_CAVEAT_IDS = f"warned AS (SELECT DISTINCT b.id FROM relations r JOIN obs a ON a.sync_id = r.source_id AND a.{LIVE} JOIN obs b ON b.sync_id = r.target_id AND b.{LIVE} WHERE r.judgment_status = 'judged' AND r.relation IN ('supersedes', 'conflicts_with') UNION SELECT a.id FROM relations r JOIN obs a ON a.sync_id = r.source_id AND a.{LIVE} JOIN obs b ON b.sync_id = r.target_id AND b.{LIVE} WHERE r.judgment_status = 'judged' AND r.relation = 'conflicts_with')"


@query("unshown", with_(OBS, RELATIONS, _CAVEAT_IDS, body="SELECT id FROM obs WHERE id % 2 = 0 AND (id % 3 <> 0 OR id IN (SELECT id FROM warned))"))
def unshown(s, d):
    rows = D.observations(s, d)
    ids = rows.select("id")
    return search.unshown(ids.where("id % 2 = 0"), ids.where("id % 3 = 0"), relations.caveats(D.relations(s, d), rows))


@query("same_project", "SELECT doc_id AS id, coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END, '') = coalesce(CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END, '') AS same FROM documents")
def same_project(s, d):
    i = F.col("doc_id")
    same = L.same_project(F.when(i % 3 != 0, F.col("source")), F.when(i % 2 == 0, F.lit("")).otherwise(F.col("source")))
    return D.table(s, d, "documents").select(i.alias("id"), same.alias("same"))


_SCAN = [x.replace("id % 20 = 0 AND deleted_at IS NULL", "project = 'src3' AND deleted_at IS NULL") for x in _CAND]


@query("scan_project", with_(OBS, RELATIONS, *O.index(), *_SCAN, "found AS (SELECT qid AS source, doc_id AS candidate, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, doc_id) AS p FROM top JOIN med USING (qid) WHERE score <= -2.0 AND (n < 24 OR score <= middle * 1.25)) WHERE p <= 10)", "best AS (SELECT least(source, candidate) AS lo, greatest(source, candidate) AS hi, min(source) AS source, arg_min(score, source) AS score FROM found GROUP BY ALL)", body="SELECT lo, hi, round(score, 6) + 0.0 AS score FROM best ORDER BY source, best.score, lo, hi LIMIT 100").replace("min(source) AS source, arg_min(score, source) AS score FROM found GROUP BY ALL", "min(source) AS source, arg_min(score, source) AS score FROM found GROUP BY 1, 2"))
def scan_project(s, d):
    rows, i = text_index(s, d)
    return relations.scan_project(i, rows, "src3", D.relations(s, d)).select("lo", "hi", (F.round("score", 6) + 0.0).alias("score"))


def _judge(a: str, b: str) -> str:
    """Stands for a model: whatever two notes agree in the length of their names is related."""
    return f'They are {{"relation": "related", "confidence": {len(a) / 10}}}.' if len(a) == len(b) else "no answer"


@query("semantic_scan", with_(RELATIONS, body="SELECT id AS lo, id + 1 AS hi, CASE WHEN length(source_id) = length(target_id) THEN 'related' END AS relation, CASE WHEN length(source_id) = length(target_id) THEN length(source_id) / 10 END AS confidence FROM relations"))
def semantic_scan(s, d):
    pairs = D.relations(s, d).select(F.col("id").alias("lo"), (F.col("id") + 1).alias("hi"), F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    return relations.semantic_scan(pairs, _judge, max_pairs=1 << 30)


@query("parsed_verdicts", with_(RELATIONS, body="SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE relation END AS relation, CASE WHEN id % 4 = 0 THEN NULL ELSE least(1.0, confidence * 2) END AS confidence FROM relations"))
def parsed_verdicts(s, d):
    r = D.relations(s, d)
    said = F.concat(F.lit("I think: ```{\"relation\": \" "), F.when(F.col("id") % 4 == 0, "eats").otherwise(F.upper("relation")), F.lit('", "confidence": "'), (F.col("confidence") * 2).cast("string"), F.lit('"}``` and {"relation": "related"}'))
    return r.select("id", verdict_udf(said).alias("v")).select("id", "v.relation", "v.confidence")


# functions


@query("scopes", "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'personal' ELSE 'project' END AS scope FROM events")
def scopes(s, d):
    i = F.col("event_id") % 4
    return D.table(s, d, "events").select(F.col("event_id").alias("id"), T.scope(F.when(i == 0, " Personal ").when(i == 1, "project").when(i == 2, "team")).alias("scope"))


_CUT = ", ".join(f"try(decode(unhex(substr(hex(encode(x)), 1, {2 * n}))))" for n in range(49_985, 49_981, -1))


@query("titles", with_(rf"t AS (SELECT doc_id AS id, trim({O.fold('text')} || CASE WHEN doc_id % 2 = 0 THEN ' [REDACTED] end' ELSE '' END) AS x FROM documents)", body=f"SELECT id, sha256(CASE WHEN octet_length(encode(x)) <= 50000 THEN x ELSE coalesce({_CUT}) || '... [truncated]' END) AS h FROM t"))
def titles(s, d):
    """Whole texts as titles: folded to a line, private parts redacted, the longest cut between characters."""
    body = F.concat("text", F.when(F.col("doc_id") % 2 == 0, "\n<private>no\none</PRIVATE>  end ").otherwise(""))
    return D.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.sha2(T.title(body), 256).alias("h"))


@query("truncated_bytes", "SELECT doc_id AS id, sha256(CASE WHEN octet_length(encode(text)) <= 200 THEN text ELSE coalesce(try(decode(unhex(substr(hex(encode(text)), 1, 370)))), try(decode(unhex(substr(hex(encode(text)), 1, 368)))), try(decode(unhex(substr(hex(encode(text)), 1, 366)))), try(decode(unhex(substr(hex(encode(text)), 1, 364))))) || '... [truncated]' END) AS h FROM documents")
def truncated_bytes(s, d):
    return D.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.sha2(T.truncate_bytes_marked(F.col("text"), 200), 256).alias("h"))


@query("sync_ids", with_(RELATIONS, body="SELECT id, 'rel-' || left(sha256(source_id || '|' || target_id), 16) AS sync_id FROM relations"))
def sync_ids(s, d):
    return D.relations(s, d).select("id", T.sync_id("rel", F.col("source_id"), F.col("target_id")).alias("sync_id"))


@query("canonical_payloads", "SELECT event_id AS id, '{\"a\":[1,{\"b\":null,\"c\":\"é\"}],\"k\":' || json_extract_string(props, '$.k') || '}' AS payload FROM events")
def canonical_payloads(s, d):
    raw = F.concat(F.lit('{"k" : '), F.get_json_object("props", "$.k"), F.lit(', "a": [1, {"c": "\\u00e9", "b": null}]}'))
    return D.table(s, d, "events").select(F.col("event_id").alias("id"), canonical_json_udf(raw).alias("payload"))


@query("sample_words", with_(PROMPTS, r"w AS (SELECT id, unnest(regexp_extract_all(lower(content), '[\pL\pN_]+')) AS t, unnest(range(len(regexp_extract_all(lower(content), '[\pL\pN_]+')))) AS k FROM prompts), u AS (SELECT id, t, min(k) AS k FROM w WHERE length(t) >= 3 GROUP BY id, t), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS p FROM u)", body="SELECT id, string_agg(t, ' ' ORDER BY k) AS words FROM r WHERE p BETWEEN 3 AND 6 GROUP BY id"))
def sample_words(s, d):
    return D.prompts(s, d).select("id", T.sample_words(F.col("content"), 4, 2).alias("words")).where("words <> ''")


# checks and repairs


@query("index_gap", with_(OBS, body="SELECT count(*) AS n_indexed, count(*) FILTER (id % 3 <> 0) AS n_rows FROM obs"))
def index_gap(s, d):
    return quality.index_gap(listed_index(s, d), D.observations(s, d).where("id % 3 <> 0"))


@query("rehashed", with_(OBS, body="SELECT id, CASE WHEN deleted_at IS NULL THEN normalized_hash ELSE 'old' END AS normalized_hash FROM obs"))
def rehashed(s, d):
    return quality.rehashed(D.observations(s, d).withColumn("normalized_hash", F.lit("old"))).select("id", "normalized_hash")


@query("review_backfill", with_(OBS, body=f"SELECT id, CASE WHEN id % 2 = 0 THEN '{AS_OF}' ELSE {stamp('review_after')} END AS review_after FROM obs"))
def review_backfill(s, d):
    held = F.when(F.col("id") % 2 == 0, as_of())
    return quality.review_backfill(D.observations(s, d).withColumn("review_after", held)).select("id", at("review_after"))


_CHECKS = {
    "observation_sessions": "SELECT count(*) FROM obs WHERE session_id NOT IN (SELECT id FROM lsessions)",
    "prompt_sessions": "SELECT count(*) FROM prompts WHERE session_id NOT IN (SELECT id FROM lsessions)",
    "relation_ends": "SELECT count(*) FROM (SELECT source_id AS e FROM relations UNION ALL SELECT target_id FROM relations) WHERE e NOT IN (SELECT sync_id FROM obs)",
    "stale_hashes": "SELECT 0",
    "shared_topic_keys": f"SELECT count(*) FROM (SELECT 1 FROM obs WHERE {LIVE} AND topic_key IS NOT NULL GROUP BY topic_key, project, scope HAVING count(*) > 1)",
    "unsearchable_kinds": f"SELECT count(DISTINCT type) FROM obs WHERE {LIVE} AND type NOT IN ({', '.join(repr(k) for k in (*T.KINDS, T.SESSION_SUMMARY))})",
    "blank_titles": f"SELECT count(*) FROM obs WHERE {LIVE} AND trim(title) = ''",
    "duplicate_ids": "SELECT 0",
    "duplicate_sync_ids": "SELECT 0",
    "unknown_verbs": f"SELECT count(*) FROM relations WHERE relation NOT IN ({', '.join(repr(v) for v in T.RELATION_VERBS)})",
    "confidence_bounds": "SELECT count(*) FROM relations WHERE confidence > 1",
    "unknown_scopes": "SELECT 0",
    "project_spelling": "SELECT 0",
    "deleted_before_created": "SELECT 0",
    "index_rows": "SELECT 0",
}


@query("doctor_report", with_(OBS, LOG_SESSIONS, PROMPTS, RELATIONS, body=" UNION ALL ".join(f"SELECT '{k}' AS code, n = 0 AS ok, CAST(n AS VARCHAR) AS detail FROM ({q}) t(n)" for k, q in _CHECKS.items())))
def doctor_report(s, d):
    return quality.report(D.observations(s, d), D.log_sessions(s, d), D.prompts(s, d), D.relations(s, d), listed_index(s, d))


_HEALTH = {
    "foreign_keys": "SELECT (SELECT count(*) FROM obs WHERE session_id <> 's3') + (SELECT count(*) FROM prompts)",
    "observation_fts_integrity": "SELECT count(*) FROM obs WHERE id % 8 = 0",
    "observation_exact_fts_integrity": "SELECT 0",
    "prompt_fts_integrity": "SELECT 0",
    "observation_fts_sync": "SELECT 0",
    "observation_exact_fts_sync": "SELECT count(*) FROM obs WHERE id % 9 = 0",
    "prompt_fts_sync": "SELECT count(*) FROM prompts WHERE id % 5 = 0",
    "observation_hash_sync": f"SELECT count(*) FROM obs WHERE {LIVE} AND id % 10 = 0",
    "observation_type_searchable": f"SELECT count(*) FROM obs WHERE {LIVE} AND id % 6 = 0",
    "topic_key_uniqueness": f"SELECT count(*) FROM (SELECT 1 FROM obs WHERE {LIVE} AND topic_key IS NOT NULL GROUP BY topic_key, project, scope HAVING count(*) > 1)",
}


@query("health", with_(OBS, PROMPTS, body=" UNION ALL ".join(f"SELECT '{k}' AS code, n = 0 AS ok, CAST(n AS VARCHAR) AS detail FROM ({q}) t(n)" for k, q in _HEALTH.items())))
def health(s, d):
    """All codes over a store that is damaged in known ways: hashes, kinds and sessions of rows, documents of the indexes."""
    rows, i = obs_index(s, d)
    rows = rows.withColumns({"normalized_hash": F.when(F.col("id") % 10 == 0, "old").otherwise(F.col("normalized_hash")), "type": F.when(F.col("id") % 6 == 0, "odd").otherwise(F.col("type"))})
    stemmed, exact = saved_index(s, d, stemmed=True), index.Index(*(x.where("doc_id % 9 <> 0") for x in (i.postings, i.docstats)))
    longer = F.when(F.col("doc_id") % 8 == 0, F.col("n_tokens") + 1).otherwise(F.col("n_tokens")).alias("n_tokens")
    stemmed = index.Index(stemmed.postings, stemmed.docstats.select("doc_id", longer), True)
    asked = saved_index(s, d, "prompts", ("content", "project"))
    p = D.prompts(s, d)
    known = rows.where("session_id = 's3'").select(F.col("session_id").alias("id")).distinct()
    return doctor.report(rows, known, p, {"observation_fts": stemmed, "observation_exact_fts": exact, "prompt_fts": index.Index(*(x.where("doc_id % 5 <> 0") for x in (asked.postings, asked.docstats)))})


@query("rebuilt_indexes", with_(OBS, body="SELECT 'observation_exact_fts' AS name, count(*) FILTER (id % 9 <> 0) AS before, count(*) AS after FROM obs UNION ALL SELECT 'observation_fts', 0, count(*) FROM obs"))
def rebuilt_indexes(s, d):
    rows, i = obs_index(s, d)
    part = index.Index(i.postings.where("doc_id % 9 <> 0"), i.docstats.where("doc_id % 9 <> 0"))
    return doctor.sizes({"observation_exact_fts": part}, {"observation_exact_fts": index.build(rows), "observation_fts": index.build(rows, stemmed=True)})


# a peer's changes, projects and grants

_APPLIED = """c AS (SELECT event_id AS seq, 'obs-' || (event_id % 1300) AS k, event_id % 7 = 0 AS del, event_id % 21 = 0 AS hard FROM events),
h AS (SELECT k, max(seq) AS h FROM c WHERE hard GROUP BY k), a AS (SELECT c.*, h FROM c LEFT JOIN h USING (k) WHERE h IS NULL OR seq > h),
b AS (SELECT k, min(seq) FILTER (NOT del) AS begun FROM a GROUP BY k),
e AS (SELECT k, any_value(a.h) AS h, max(seq) FILTER (NOT del) AS lu, max(seq) FILTER (del AND (seq > begun OR (o.id IS NOT NULL AND a.h IS NULL))) AS ld, max(seq) FILTER (NOT del AND seq % 3 > 0) AS lr FROM a JOIN b USING (k) LEFT JOIN obs o ON o.sync_id = k GROUP BY k),
ends AS (SELECT coalesce(e.k, h.k) AS k, coalesce(e.h, h.h) AS h, lu, ld, lr FROM e FULL JOIN h ON h.k = e.k)"""


@query("applied_changes", with_(OBS, _APPLIED, body="SELECT coalesce(o.sync_id, k) AS sync_id, CASE WHEN lu IS NOT NULL THEN 't' || lu ELSE title END AS title, CASE WHEN ld > coalesce(lu, -1) THEN true WHEN lu IS NOT NULL THEN false ELSE deleted_at IS NOT NULL END AS deleted, CASE WHEN lr IS NOT NULL THEN lr % 3 ELSE 1 END AS revision_count FROM obs o FULL JOIN ends ON k = o.sync_id WHERE lu IS NOT NULL OR (o.id IS NOT NULL AND h IS NULL)"))
def applied_changes(s, d):
    """A journal of upserts and removals applied to the notes."""
    i = F.col("event_id")
    text = lambda c: c.cast("string")
    body = F.concat(F.lit('{"session_id": "s1", "type": "bugfix", "title": "t'), text(i), F.lit('", "content": "c", "scope": "project", "revision_count": '), text(i % 3), F.lit(', "hard_delete": '), text(i % 21 == 0), F.lit("}"))
    j = D.table(s, d, "events").select(i.alias("seq"), F.lit("observation").alias("entity"), F.concat(F.lit("obs-"), text(i % 1300)).alias("entity_key"), F.when(i % 7 == 0, "delete").otherwise("upsert").alias("op"), body.alias("payload"))
    after, _, _ = peers.observations(D.observations(s, d), j, as_of())
    return after.select("sync_id", "title", F.col("deleted_at").isNotNull().alias("deleted"), "revision_count")


# an index kept up by writes, and changes captured from them

#: A third of the notes comes later, a seventh gets another title, an eleventh is removed.
_REVISED = "revised AS (SELECT * REPLACE (CASE WHEN id % 7 = 0 THEN 'attion and erble' ELSE title END AS title) FROM obs WHERE id % 11 <> 0)"


def written_index(s, d):
    """An index of segments after a build and three writes; published and opened again."""
    rows, root = D.observations(s, d), f"{shared_folder(s)}/notelake-segments-{uuid.uuid4().hex}"
    later = F.col("id") % 3 == 0
    i = segments.SegmentIndex.create(rows.where(~later), root).add(rows.where(later))
    i = i.add(rows.where("id % 7 = 0").withColumn("title", F.lit("attion and erble")))
    i.add(removed=rows.where("id % 11 = 0").select("id")).publish()
    return segments.SegmentIndex.open(s, root)


@query("segment_search", with_(OBS, _REVISED, *O.index("revised"), *O.scored({0: ["attion", "erble"]}), body="SELECT doc_id AS id, round(score, 6) + 0.0 AS score FROM scores WHERE matched = 2"))
def segment_search(s, d):
    return bm25.match_all(written_index(s, d), "attion erble").select(F.col("doc_id").alias("id"), (F.round("score", 6) + 0.0).alias("score"))


@query("segment_totals", with_(OBS, _REVISED, *O.index("revised"), body="SELECT n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM post) AS n_postings FROM totals"))
def segment_totals(s, d):
    i = written_index(s, d)
    n = i.postings.agg(F.count("*").alias("n_postings"))
    return i.totals().select("n_docs", F.round("avgdl", 6).alias("avgdl")).crossJoin(n)  # one row each


#: Some live notes are renamed, move or are deleted, or two of these at once; some notes are removed for good.
_WRITTEN = f"""after AS (SELECT * REPLACE (CASE WHEN deleted_at IS NULL AND id % 6 = 0 THEN 'renamed ' || id ELSE title END AS title, CASE WHEN deleted_at IS NULL AND id % 5 = 0 THEN 'elsewhere' ELSE project END AS project, CASE WHEN deleted_at IS NULL AND id % 7 = 0 THEN TIMESTAMP '{AS_OF}' ELSE deleted_at END AS deleted_at) FROM obs WHERE id % 11 <> 0),
w AS (SELECT *, lived AND NOT gone AND NOT lives AS died, NOT gone AND edited AS up FROM (SELECT o.id, o.sync_id, a.title, coalesce(o.project, '') AS old, coalesce(a.project, '') AS new, o.deleted_at IS NULL AS lived, a.id IS NULL AS gone, a.deleted_at IS NULL AS lives, a.title <> o.title OR coalesce(a.project, '') <> coalesce(o.project, '') AS edited FROM obs o LEFT JOIN after a ON a.id = o.id))"""


def rewritten(s, d):
    """(notes before, notes after) a batch of writes."""
    rows, i, live = D.observations(s, d), F.col("id"), F.col("deleted_at").isNull()
    after = rows.where(i % 11 != 0).withColumns({
        "title": F.when(live & (i % 6 == 0), F.concat(F.lit("renamed "), i.cast("string"))).otherwise(F.col("title")), "project": F.when(live & (i % 5 == 0), "elsewhere").otherwise(F.col("project")),
        "deleted_at": F.when(live & (i % 7 == 0), as_of()).otherwise(F.col("deleted_at")),
    })
    return rows, after


@query(
    "captured_changes",
    with_(OBS, _WRITTEN, "watched AS (SELECT DISTINCT project FROM obs WHERE project <> 'src3')", "e AS (SELECT *, old = '' OR old IN (FROM watched) AS seen, new = '' OR new IN (FROM watched) AS sees FROM w)",
          body="SELECT sync_id, 'delete' AS op, old AS project, NULL AS title, true AS hard FROM e WHERE gone AND seen UNION ALL SELECT sync_id, 'delete', new, NULL, false FROM e WHERE died AND sees UNION ALL SELECT sync_id, 'upsert', new, title, NULL FROM e WHERE up AND sees UNION ALL SELECT sync_id, 'delete', old, NULL, false FROM e WHERE lived AND NOT gone AND old <> new AND seen AND NOT sees"),
)
def captured_changes(s, d):
    """What a batch of writes tells the peers that watch all projects but one and the one that notes move to."""
    before, after = rewritten(s, d)
    watched = before.where("project <> 'src3'").select("project").distinct()
    e = journal.entries("observation", before, after, D.sessions(s, d), watched, as_of())
    return e.select(F.col("entity_key").alias("sync_id"), "op", "project", F.get_json_object("payload", "$.title").alias("title"), F.get_json_object("payload", "$.hard_delete").cast("boolean").alias("hard"))


def _kept(x: str, line: bool = False) -> str:
    """What a peer keeps of a text that came with an upsert: without private blocks and outer white space, a title on one line, and of more
    than 50,000 bytes what fits before the marker, cut between characters."""
    bare = f"regexp_replace(regexp_replace({x}, '<private>.*?</private>', '[REDACTED]', 'gis'), '^\\s+|\\s+$', '', 'g')"
    fits = ", ".join(f"try(decode(unhex(substr(hex(encode(c)), 1, {2 * n}))))" for n in (49985, 49984, 49983, 49982))
    return f"(SELECT CASE WHEN strlen(c) > 50000 THEN coalesce({fits}) || '... [truncated]' ELSE c END FROM (SELECT {O.fold(bare) if line else bare} AS c))"


@query("replicated_notes", with_(OBS, _WRITTEN, body=f"SELECT sync_id, CASE WHEN up THEN {_kept('a.title', True)} ELSE a.title END AS title, coalesce(project, '') AS project, sha256(CASE WHEN up THEN {_kept('content')} ELSE content END) AS body, type, scope, topic_key, revision_count, deleted_at IS NOT NULL AS deleted FROM (SELECT *, 1 AS revision_count FROM after) a JOIN (SELECT sync_id, up FROM w) USING (sync_id)"))
def replicated_notes(s, d):
    """The copy of a peer that applied the journal of those writes, all projects being watched."""
    before, after = rewritten(s, d)
    watched = before.where("project is not null").select("project").union(s.range(1).select(F.lit("elsewhere"))).distinct()
    e = journal.numbered(journal.entries("observation", before, after, D.sessions(s, d), watched, as_of()), 0)
    copy, _, _ = peers.observations(before, e, as_of())
    return copy.select("sync_id", "title", F.coalesce("project", F.lit("")).alias("project"), F.sha2("content", 256).alias("body"), "type", "scope", "topic_key", "revision_count", F.col("deleted_at").isNotNull().alias("deleted"))


@query("target_states", with_(OBS, _WRITTEN, body="SELECT 'cloud' AS target_key, 'pending' AS lifecycle, (SELECT sum(gone::INT + died::INT + coalesce(up, false)::INT)::BIGINT FROM w) AS last_enqueued_seq"))
def target_states(s, d):
    """The whole store's target after those writes, all projects being watched."""
    before, after = rewritten(s, d)
    watched = before.where("project is not null").select("project").union(s.range(1).select(F.lit("elsewhere"))).distinct()
    e = journal.numbered(journal.entries("observation", before, after, D.sessions(s, d), watched, as_of()), 0)
    none = s.createDataFrame([], schemas.SYNC_STATE)
    return journal.advanced(none, e, as_of()).where("target_key = 'cloud'").select("target_key", "lifecycle", "last_enqueued_seq")


_EVERY = [x.replace("id % 20 = 0 AND deleted_at IS NULL", "deleted_at IS NULL") for x in _CAND]


@query("all_candidates", with_(OBS, RELATIONS, *O.index(), *_EVERY, body="SELECT qid AS source, doc_id AS candidate, round(score, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, doc_id) AS p FROM top JOIN med USING (qid) WHERE score <= -2.0 AND (n < 24 OR score <= middle * 1.25)) WHERE p <= 3"))
def all_candidates(s, d):
    """Candidates of every live note, not of each twentieth."""
    rows, i = text_index(s, d)
    c = relations.candidates(i, rows, rows.where("deleted_at is null"), D.relations(s, d))
    return c.select("source", "candidate", (F.round("score", 6) + 0.0).alias("score"))


@query(
    "saved_verdicts",
    with_(OBS, RELATIONS, "v AS (SELECT target_id AS s, source_id AS t, CASE WHEN id % 2 = 0 THEN 'supersedes' ELSE 'not_conflict' END AS relation FROM relations UNION ALL SELECT 'obs-' || id, 'obs-' || (id + 7000000), 'related' FROM obs WHERE type = 'policy')",
          "k AS (SELECT * FROM v WHERE relation <> 'not_conflict')", "n AS (SELECT k.* FROM k ANTI JOIN relations r ON least(r.source_id, r.target_id) = least(k.s, k.t) AND greatest(r.source_id, r.target_id) = greatest(k.s, k.t))",
          body="SELECT r.sync_id, r.source_id, r.target_id, coalesce(k.relation, r.relation) AS relation, CASE WHEN k.s IS NULL THEN round(r.confidence, 6) ELSE 0.9 END AS confidence, CASE WHEN k.s IS NULL THEN r.judgment_status ELSE 'judged' END AS judgment_status FROM relations r LEFT JOIN k ON k.s = r.target_id AND k.t = r.source_id UNION ALL SELECT 'rel-' || sha256(s || '|' || t)[1:16], s, t, relation, 0.9, 'judged' FROM n"),
)
def saved_verdicts(s, d):
    """Verdicts on all related pairs, asked the other way round, and on pairs that nothing relates yet."""
    r, rows = D.relations(s, d), D.observations(s, d)
    v = r.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.when(F.col("id") % 2 == 0, "supersedes").otherwise("not_conflict").alias("relation"))
    new = rows.where("type = 'policy'").select(F.col("sync_id").alias("source_id"), F.concat(F.lit("obs-"), (F.col("id") + 7_000_000).cast("string")).alias("target_id"), F.lit("related").alias("relation"))
    after = relations.save_verdicts(v.unionByName(new).withColumns({"confidence": F.lit(0.9), "reason": F.lit("why")}), r, as_of())
    return after.select("sync_id", "source_id", "target_id", "relation", F.round("confidence", 6).alias("confidence"), "judgment_status")


@query("since_page", with_(MUTATIONS, body="SELECT seq, true AS has_more, (SELECT max(seq) FROM mutations) AS latest FROM mutations WHERE seq > 500 ORDER BY seq LIMIT 50"))
def since_page(s, d):
    return L.since_page(D.mutations(s, d), 500, 50).select("seq", "has_more", "latest")


@query("deleted_project", with_(LOG, LOG_SESSIONS, PROMPTS, "p AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'click' ELSE project END AS owner FROM prompts), ss AS (SELECT id, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'click' ELSE project END AS project FROM lsessions), lo AS (SELECT * FROM log WHERE project <> 'click')", body="SELECT 'notes' AS what, count(*) AS n FROM lo UNION ALL SELECT 'sessions', count(*) FROM ss WHERE project <> 'click' OR id IN (SELECT session_id FROM lo) OR id IN (SELECT session_id FROM p WHERE owner <> 'click') UNION ALL SELECT 'prompts', count(*) FROM p WHERE owner <> 'click'"))
def deleted_project(s, d):
    p = D.prompts(s, d).withColumn("project", F.when(F.col("id") % 2 == 0, "click").otherwise(F.col("project")))
    z = D.log_sessions(s, d).withColumn("project", F.when(F.col("id").cast("long") % 2 == 0, "click").otherwise(F.col("project")))
    left = projects.deleted("click", D.log(s, d), z, p, as_of(), hard=True)
    out = None
    for what, df in zip(("notes", "sessions", "prompts"), left):
        one = df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("merged_enrolment", "WITH n AS (SELECT DISTINCT source AS project FROM documents), m AS (SELECT CASE WHEN CAST(substr(project, 4) AS INT) % 3 = 0 THEN 'src1' ELSE project END AS project FROM n WHERE CAST(substr(project, 4) AS INT) % 2 = 0) SELECT DISTINCT project FROM m")
def merged_enrolment(s, d):
    n = D.table(s, d, "documents").select(F.col("source").alias("project")).distinct()
    k = F.substring("project", 4, 9).cast("int")
    return projects.merged_enrolment(n.where(k % 2 == 0), n.where(k % 3 == 0).select("project", F.lit("src1").alias("canonical")))


@query("created_by_merge", with_(OBS, PROMPTS, "m AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN 'brand-' || (c_custkey % 50) ELSE 'src' || (c_custkey % 40) END AS project FROM customer)", "h AS (SELECT project FROM obs UNION SELECT project FROM prompts)", body="SELECT m.project, h.project IS NULL AS created FROM m LEFT JOIN h ON h.project = m.project"))
def created_by_merge(s, d):
    """Customers' names of projects merged under new names and under some that are there."""
    k = F.col("c_custkey")
    to = F.when(k % 3 == 0, F.concat(F.lit("brand-"), (k % 50).cast("string"))).otherwise(F.concat(F.lit("src"), (k % 40).cast("string")))
    m = D.table(s, d, "customer").select(F.concat(F.lit("was-"), k.cast("string")).alias("project"), to.alias("canonical"))
    return projects.created_by_merge(m, D.observations(s, d), D.prompts(s, d))


@query("same_names", "WITH n AS (SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN replace(p_brand, '#', '-') ELSE replace(p_brand, '#', '_') END AS project FROM part), k AS (SELECT project, regexp_replace(lower(project), '[-_ .]+', '-', 'g') AS l FROM n), c AS (SELECT l, min(project) AS canonical FROM k GROUP BY l) SELECT project, canonical FROM k JOIN c USING (l) WHERE project <> canonical")
def same_names(s, d):
    b = F.col("p_brand")
    n = D.table(s, d, "part").select(F.when(F.col("p_size") % 3 == 0, b).when(F.col("p_size") % 3 == 1, F.replace(b, F.lit("#"), F.lit("-"))).otherwise(F.replace(b, F.lit("#"), F.lit("_"))).alias("project"))
    return projects.same_name(n)


@query("renamed_directories", with_(LOG_SESSIONS, body="SELECT DISTINCT project, 'moved-' || project AS canonical FROM lsessions WHERE CAST(id AS BIGINT) % 3 = 0"))
def renamed_directories(s, d):
    """A third of the sessions is recorded in a directory called as their project, which now belongs to another."""
    z = D.log_sessions(s, d).withColumn("directory", F.when(F.col("id").cast("long") % 3 == 0, F.concat(F.lit("/Home/"), "project")).otherwise("/home/else"))
    names = D.log_sessions(s, d).select("project").distinct()
    return projects.renamed(z, names.select(F.concat(F.lit("\\home\\"), "project", F.lit("/")).alias("directory"), F.concat(F.lit("moved-"), "project").alias("project")))


@query("enrolled_journal", with_(MUTATIONS, body="SELECT seq FROM mutations WHERE project <> 'click' OR acked_at IS NOT NULL"))
def enrolled_journal(s, d):
    return projects.enrolled_journal(D.mutations(s, d), "click").select("seq")


@query("paused_projects", "WITH c AS (SELECT 'src' || (event_id % 20) AS project, max(event_id) AS seq FROM events WHERE event_id % 3 = 0 GROUP BY 1) SELECT project, seq % 2 = 0 AS enabled FROM c UNION ALL SELECT 'src' || k, true FROM range(30) t(k) WHERE 'src' || k NOT IN (SELECT project FROM c)")
def paused_projects(s, d):
    i = F.col("event_id")
    changes = D.table(s, d, "events").where(i % 3 == 0).select(i.alias("seq"), F.concat(F.lit("src"), (i % 20).cast("string")).alias("project"), (i % 2 == 0).alias("enabled"))
    return R.set_enabled(s.range(30).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("project"), F.lit(True).alias("enabled")), changes)


@query("changed_grants", "SELECT DISTINCT 'p' || (c_custkey % 40) AS principal, 'src' || (c_custkey % 9) AS project FROM customer WHERE NOT (c_custkey % 40 = 7)")
def changed_grants(s, d):
    k = F.col("c_custkey")
    g = D.table(s, d, "customer").select(k, F.concat(F.lit("p"), (k % 40).cast("string")).alias("principal"), F.concat(F.lit("src"), (k % 9).cast("string")).alias("project"))
    return R.changed_grants(g.where(k % 2 == 0), g.where(k % 2 == 1), g.where(k % 40 == 7))


@query("authenticated", "SELECT 'h' || o_orderkey AS token_hash, o_custkey AS principal, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'F' AND c_custkey % 5 > 0")
def authenticated(s, d):
    tokens = D.table(s, d, "orders").select(F.concat(F.lit("h"), F.col("o_orderkey").cast("string")).alias("token_hash"), F.col("o_custkey").alias("principal_id"), F.when(F.col("o_orderstatus") == "F", as_of()).alias("revoked_at"))
    people = D.table(s, d, "customer").where("c_custkey % 5 > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return R.authenticated(tokens, people)


@query("save_nudges", with_(LOG_SESSIONS, LOG, "j AS (SELECT s.id, started_at, max(o.created_at) AS saved FROM lsessions s LEFT JOIN log o ON o.session_id = s.id GROUP BY s.id, started_at), k AS (SELECT id, (epoch(TIMESTAMP '2024-01-20 00:00:00')::BIGINT - floor(epoch(greatest(started_at, coalesce(saved, started_at))))::BIGINT) // 60 AS idle FROM j)", body="SELECT id, idle AS idle_minutes FROM k WHERE idle >= 15 AND CAST(id AS BIGINT) % 2 = 1"))
def save_nudges(s, d):
    """Sessions with an even number were told ten minutes ago, others twenty."""
    z = D.log_sessions(s, d)
    told = z.select("id", F.when(F.col("id").cast("long") % 2 == 0, as_of("2024-01-19 23:50:00")).otherwise(as_of("2024-01-19 23:40:00")).alias("nudged_at"))
    return R.nudge(z, D.log(s, d), as_of("2024-01-20 00:00:00"), nudged=told)


@query("remembered", "SELECT id FROM (SELECT event_id % 2000 AS id, max(ts) AS last_ts FROM events GROUP BY 1) ORDER BY last_ts DESC, id DESC LIMIT 1200")
def remembered(s, d):
    return search.remembered(D.table(s, d, "events").select((F.col("event_id") % 2000).alias("id"), F.col("ts").alias("shown_at")))


@query("session_total", with_(OBS, *O.index(), *O.scored({0: ["attion", "erb*"]}), body=f"SELECT count(DISTINCT session_id) AS total FROM scores JOIN obs o ON o.id = doc_id WHERE matched = 2 AND {LIVE}"))
def session_total(s, d):
    rows, i = obs_index(s, d)
    return search.session_total(i, rows, rows.select(F.col("session_id").alias("id")).distinct(), PREFIX)


@query("nonempty", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'now' ELSE event_type END AS t FROM events")
def nonempty(s, d):
    i = F.col("event_id")
    return D.table(s, d, "events").select(i.alias("id"), T.nonempty_or(F.when(i % 3 > 0, F.col("event_type")).when(i % 6 == 0, " "), F.lit("now")).alias("t"))
