"""The catalogue's queries as DuckDB SQL, written independently of the Spark plans."""

from __future__ import annotations

from ..functions.text import ACCENTED, DIACRITICS, KIND_FOLDS, UNACCENTED
from ..operators import bm25
from ..sources.adapters import DOC_KINDS, ENTITIES, VERBS


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


FOLD = r"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def fold(x: str) -> str:
    return FOLD.format(x=x)


def tok(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace(translate(lower(coalesce({x}, '')), '{DIACRITICS[0]}', '{DIACRITICS[1]}'), '[^\pL\pN]+', ' ', 'g'), ' '), lambda t: t <> '')"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


CREATED = "TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id)"
KIND = f"{_list(DOC_KINDS)}[doc_id % 9 + 1]"
OBS = rf"""obs AS (SELECT *, CASE type WHEN 'decision' THEN created_at + INTERVAL 6 MONTH WHEN 'policy' THEN created_at + INTERVAL 12 MONTH WHEN 'preference' THEN created_at + INTERVAL 3 MONTH END AS review_after
 FROM (SELECT doc_id AS id, 'obs-' || doc_id AS sync_id, 's' || (doc_id % 20) AS session_id, {KIND} AS type, array_to_string(string_split({fold('text')}, ' ')[1:8], ' ') AS title, text AS content,
 source AS project, CASE WHEN doc_id % 10 = 0 THEN 'personal' ELSE 'project' END AS scope, CASE WHEN doc_id % 4 = 0 THEN 'topic/' || (doc_id % 50) END AS topic_key, sha256(lower({fold('text')})) AS normalized_hash,
 doc_id % 17 = 0 AS pinned, {CREATED} AS created_at, {CREATED} AS updated_at, CASE WHEN doc_id % 13 = 0 THEN {CREATED} + INTERVAL 1 DAY END AS deleted_at FROM documents))"""
LOG = """log AS (SELECT event_id AS id, 'e-' || event_id AS sync_id, CAST(user_id AS VARCHAR) AS session_id, event_type AS type, event_type || ' ' || event_id AS title, props AS content, event_type AS project,
 CASE WHEN event_id % 10 = 0 THEN 'personal' ELSE 'project' END AS scope, ts AS created_at, CASE WHEN event_id % 13 = 0 THEN ts + INTERVAL 1 HOUR END AS deleted_at, event_id % 17 = 0 AS pinned FROM events)"""
PROMPTS = """prompts AS (SELECT conv_id * 1000 + turn AS id, 'prompt-' || (conv_id * 1000 + turn) AS sync_id, 'c' || conv_id AS session_id, text AS content, 'src' || (conv_id % 20) AS project,
 TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS created_at FROM conversations WHERE role = 'user')"""
SESSIONS = "sessions AS (SELECT session_id AS id, min(project) AS project, '/repo/' || min(project) AS directory, min(created_at) AS started_at, CASE WHEN count(*) > 1 THEN 'summary of ' || session_id END AS summary FROM prompts GROUP BY session_id)"
LOG_SESSIONS = r"""lsessions AS (SELECT CAST(c_custkey AS VARCHAR) AS id, 'team' || (c_custkey % 7) AS project, '/work/' || (c_custkey % 5) AS directory, TIMESTAMP '2024-01-01 00:00:00' + to_hours(c_custkey % 24) AS started_at,
 CASE WHEN c_custkey % 3 = 0 THEN '## Goal' || chr(10) || chr(10) || 'reach ' || c_custkey END AS summary FROM customer)"""
MUTATIONS = f"""mutations AS (SELECT event_id AS seq, {_list(ENTITIES)}[event_id % 4 + 1] AS entity, CAST(user_id AS VARCHAR) AS entity_key, CASE WHEN event_type = 'error' AND event_id % 4 <> 3 THEN 'delete' ELSE 'upsert' END AS op,
 props AS payload, CASE WHEN event_id % 5 <> 0 THEN 'local' ELSE 'remote' END AS source, event_type AS project, ts AS occurred_at, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 HOUR END AS acked_at FROM events)"""
RELATIONS = f"""relations AS (SELECT doc_id AS id, 'rel-' || doc_id AS sync_id, 'obs-' || doc_id AS source_id, 'obs-' || (doc_id + CASE WHEN (doc_id // 3) % 2 = 0 THEN 20 ELSE 1 END) AS target_id, {_list(VERBS)}[(doc_id // 3) % 6 + 1] AS relation,
 (doc_id % 11) / 10.0 AS confidence, CASE WHEN (doc_id // 3) % 4 = 0 THEN 'pending' ELSE 'judged' END AS judgment_status, {CREATED} AS created_at FROM documents WHERE doc_id % 3 = 0)"""


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def index(of: str = "obs", columns: tuple[str, ...] = ("title", "content", "type", "project", "topic_key")) -> list[str]:
    toks = ", ".join(f"{tok(c)} AS t_{c}" for c in columns)
    post = " UNION ALL ".join(f"SELECT id AS doc_id, '{c}' AS col, unnest(t_{c}) AS term, unnest(range(len(t_{c}))) AS pos FROM toks" for c in columns)
    size = " + ".join(f"len(t_{c})" for c in columns)
    return [f"toks AS MATERIALIZED (SELECT id, {toks} FROM {of})", f"post AS ({post})", f"docstats AS (SELECT id AS doc_id, {size} AS n_tokens FROM toks)", "totals AS (SELECT count(*) AS n_docs, avg(n_tokens) AS avgdl FROM docstats)"]


_PART = "CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_docs - n + 0.5) / (n + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n_tokens / avgdl))"


def scored(queries: dict[int, list[str]], weights: dict[str, float] = bm25.SEARCH_WEIGHTS) -> list[str]:
    rows = ", ".join(f"({q}, {p}, {o}, {n}, '{t}', {str(x).lower()})" for q, p, o, n, t, x in bm25.phrases(queries))
    w = " ".join(f"WHEN col = '{c}' THEN {x}" for c, x in weights.items()) or "WHEN false THEN 0.0"
    return [
        f"q(qid, phrase, off, len, term, prefix) AS (VALUES {rows})",
        "hits AS (SELECT qid, phrase, len, doc_id, col, pos - off AS at FROM post JOIN q ON post.term = q.term OR (q.prefix AND starts_with(post.term, q.term)) GROUP BY qid, phrase, len, doc_id, col, pos - off HAVING count(DISTINCT off) = len)",
        f"f AS (SELECT qid, phrase, doc_id, sum(CASE {w} ELSE 1.0 END) AS f FROM hits GROUP BY qid, phrase, doc_id)",
        "n AS (SELECT qid, phrase, count(*) AS n FROM f GROUP BY qid, phrase)",
        f"scores AS (SELECT qid, doc_id, count(*) AS matched, 0.0 - sum({_PART}) AS score FROM f JOIN n USING (qid, phrase) JOIN docstats USING (doc_id) CROSS JOIN totals GROUP BY qid, doc_id)",
    ]


LIVE = "deleted_at IS NULL"
TOPIC = f"""regexp_replace(translate(lower(trim({{x}})), '{ACCENTED}', '{UNACCENTED}'), '[^a-z0-9./]+', ' ', 'g')"""


def kind_fold(x: str) -> str:
    cases = " ".join(f"WHEN v IN ({', '.join(repr(s) for s in spellings)}) THEN '{k}'" for k, spellings in KIND_FOLDS.items())
    return f"(SELECT CASE {cases} ELSE v END FROM (SELECT lower(trim({x})) AS v))"
