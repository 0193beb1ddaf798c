"""Schemas of the entities."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, LongType, StringType, StructField, StructType, TimestampType


def _s(*fields: tuple) -> StructType:
    return StructType([StructField(n, t, len(rest) == 0) for n, t, *rest in fields])


L, S, T, B, D = LongType(), StringType(), TimestampType(), BooleanType(), DoubleType()
NOT_NULL = True

OBSERVATIONS = _s(
    ("id", L, NOT_NULL), ("sync_id", S, NOT_NULL), ("session_id", S, NOT_NULL), ("type", S, NOT_NULL), ("title", S, NOT_NULL), ("content", S, NOT_NULL),
    ("tool_name", S), ("project", S), ("scope", S, NOT_NULL), ("topic_key", S), ("normalized_hash", S), ("revision_count", L, NOT_NULL),
    ("duplicate_count", L, NOT_NULL), ("last_seen_at", T), ("pinned", B, NOT_NULL), ("created_at", T, NOT_NULL), ("updated_at", T, NOT_NULL),
    ("deleted_at", T), ("review_after", T), ("expires_at", T), ("embedding", ArrayType(FloatType())), ("embedding_model", S), ("embedding_created_at", T), ("prompt_sync_id", S),
)
SESSIONS = _s(("id", S, NOT_NULL), ("project", S, NOT_NULL), ("directory", S, NOT_NULL), ("started_at", T, NOT_NULL), ("ended_at", T), ("summary", S))
PROMPTS = _s(("id", L, NOT_NULL), ("sync_id", S, NOT_NULL), ("session_id", S, NOT_NULL), ("content", S, NOT_NULL), ("project", S, NOT_NULL), ("created_at", T, NOT_NULL))
PROMPT_DELETIONS = _s(("sync_id", S, NOT_NULL), ("session_id", S), ("project", S), ("deleted_at", T, NOT_NULL))
RELATIONS = _s(
    ("id", L, NOT_NULL), ("sync_id", S, NOT_NULL), ("source_id", S), ("target_id", S), ("relation", S, NOT_NULL), ("reason", S), ("evidence", S), ("confidence", D),
    ("judgment_status", S, NOT_NULL), ("marked_by_actor", S), ("marked_by_kind", S), ("marked_by_model", S), ("session_id", S), ("superseded_at", T),
    ("superseded_by_relation_id", L), ("created_at", T, NOT_NULL), ("updated_at", T, NOT_NULL),
)
MUTATIONS = _s(
    ("seq", L, NOT_NULL), ("target_key", S, NOT_NULL), ("entity", S, NOT_NULL), ("entity_key", S, NOT_NULL), ("op", S, NOT_NULL), ("payload", S, NOT_NULL),
    ("source", S, NOT_NULL), ("project", S, NOT_NULL), ("occurred_at", T, NOT_NULL), ("acked_at", T),
)
DEFERRED = _s(("sync_id", S, NOT_NULL), ("entity", S, NOT_NULL), ("payload", S, NOT_NULL), ("apply_status", S, NOT_NULL), ("retry_count", L, NOT_NULL), ("last_error", S), ("last_attempted_at", T), ("first_seen_at", T, NOT_NULL))
SYNC_STATE = _s(
    ("target_key", S, NOT_NULL), ("lifecycle", S, NOT_NULL), ("last_enqueued_seq", L, NOT_NULL), ("last_acked_seq", L, NOT_NULL), ("last_pulled_seq", L, NOT_NULL),
    ("consecutive_failures", L, NOT_NULL), ("backoff_until", T), ("lease_owner", S), ("lease_until", T), ("reason_code", S), ("reason_message", S), ("last_error", S), ("updated_at", T, NOT_NULL),
)
CHUNK = StructType([StructField(n, ArrayType(t)) for n, t in (("sessions", SESSIONS), ("observations", OBSERVATIONS), ("prompts", PROMPTS), ("mutations", MUTATIONS))])
EXPORT = StructType([StructField("version", S), StructField("exported_at", S), *(StructField(n, ArrayType(t)) for n, t in (("sessions", SESSIONS), ("observations", OBSERVATIONS), ("prompts", PROMPTS), ("relations", RELATIONS)))])
