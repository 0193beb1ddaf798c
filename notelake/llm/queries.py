"""The opN_* queries over the driver's tables, each a thin layer over an operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    s = quality.scores(_read(spark, sf_dir, "documents"))
    return s.select(F.col("id").alias("doc_id"), *(quality.q(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    out = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    r = secrets.report(_read(spark, sf_dir, "documents"))
    return r.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_entropy")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    r = warc.read(warc.write(_read(spark, sf_dir, "pages")))
    return r.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.copies(_read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def tokenizer_path() -> str:
    """The driver's tokenizer file; every executor has the package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.replace(_read(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n_entities")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embed_dedup

    out = embed_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    out = minhash.near_duplicates(_read(spark, sf_dir, "documents"), width=4)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring_dedup

    out = substring_dedup.remove_passages(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    p = packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())
    return p.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "step_group")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import prefix_trie
    from .common import Workspace

    ws = Workspace(spark, "trie")
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(_read(spark, sf_dir, "conversations"), ws), ws), ws)


def op12_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import collocation

    return collocation.collocations(_read(spark, sf_dir, "documents"))


def op13_cover_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import cover_search

    return cover_search.top_k(_read(spark, sf_dir, "embeddings"))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shapes of op2 alone, which SQL can count too."""
    from . import secrets

    return secrets.report(_read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base rule of op10, before any vote."""
    return op10_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op4, and that no document is taken more than three times."""
    m = op4_mixing(spark, sf_dir)
    return m.select("doc_id", "size", "source_size", F.round("target", 2).alias("target"), F.col("taken").between(0, 3 * F.col("size")).alias("within"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_secrets": op2_secrets,
    "op3_warc": op3_warc,
    "op4_mixing": op4_mixing,
    "op5_pii": op5_pii,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_minhash": op7_minhash,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_packing": op9_packing,
    "op10_quality_rules": op10_quality_rules,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_collocation": op12_collocation,
    "op13_cover_search": op13_cover_search,
    "secrets_base": secrets_base,
    "quality_counts": quality_counts,
    "mixing_targets": mixing_targets,
}

_WORDS = r"[^\x20\x09-\x0D]+"
_ASCII_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = "reach(node, c) AS (SELECT node, node FROM nodes UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.node), comp AS (SELECT node, min(c) AS c FROM reach GROUP BY node)"

ORACLE: dict[str, str] = {
    "op1_suffix_dedup": """
WITH t AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, x, unnest(range(len(x) // 2 - 399)) AS i FROM t WHERE len(x) >= 800)),
st AS (SELECT doc_id, i FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM st),
run AS (SELECT doc_id, min(i) AS b, max(i) + 400 AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM marked) GROUP BY doc_id, r),
gap AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS p, b, e FROM run),
cut AS (SELECT doc_id, count(*) AS n, sum(e - b) AS removed, string_agg(substr(x, 2 * p + 1, 2 * (b - p)), '' ORDER BY b) || any_value(substr(x, 2 * m + 1)) AS left_over
 FROM gap JOIN t USING (doc_id) JOIN (SELECT doc_id, max(e) AS m FROM run GROUP BY doc_id) USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0) AS n_spans, sha256(from_hex(coalesce(left_over, x))) AS kept_sha256 FROM t LEFT JOIN cut USING (doc_id)""",
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
d AS (SELECT page_id, strlen(p.html) AS n, sha1(p.html) AS h, first FROM p JOIN f ON f.html = p.html)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
 CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM d""",
    "op6_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), nodes AS (SELECT vec_id AS node FROM v),
edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98), {_REACH}
SELECT v.vec_id, (SELECT count(*) FROM edges WHERE a = v.vec_id) AS n_links, c AS component_id, c = v.vec_id AS kept FROM v JOIN comp ON node = v.vec_id""",
    "op7_minhash": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format(x="coalesce(text, '')")}, '{_WORDS}') AS ws FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i + 1:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 3, least(len(ws), 1)))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
edges AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)), nodes AS (SELECT doc_id AS node FROM w), {_REACH}
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, c = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN comp ON node = w.doc_id""",
    "op8_substring_dedup": f"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, array_to_string(ws[i + 1:i + 35], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35)),
st AS (SELECT doc_id, i FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)), gone AS (SELECT DISTINCT doc_id, i + j AS p FROM st CROSS JOIN range(35) r(j)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM w), kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, (SELECT count(*) FROM gone g WHERE g.doc_id = w.doc_id) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
}


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = "(?:" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key"))) + r")[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
ORACLE |= {
    "secrets_base": f"SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '{_ASSIGN}', 1), lambda x: length(x) >= 12)) AS n_assign, len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 16)) AS n_hex FROM documents",
    "quality_counts": f"""
WITH w AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
l AS (SELECT doc_id, count(x) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '{_WORDS}'))) AS x FROM w) GROUP BY doc_id),
g AS MATERIALIZED (SELECT doc_id, i, array_to_string(ws[i + 1:i + 5], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT doc_id, i FROM g JOIN (SELECT doc_id, k FROM g GROUP BY doc_id, k HAVING count(*) > 1) USING (doc_id, k)), c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r CROSS JOIN range(5) x(j) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws) AS n_words, CAST(list_sum(list_transform(ws, lambda x: length(x))) AS BIGINT) AS chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, coalesce(chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f""",
    "mixing_targets": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS size FROM documents), p AS (SELECT source, sum(size)::DOUBLE AS s FROM d GROUP BY source),
s AS (SELECT source, s, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM p),
lv AS (SELECT 0 AS i, (SELECT sum(s) / sum(w) FROM s) AS level UNION ALL SELECT i + 1, greatest(level, coalesce((SELECT ((SELECT sum(s) FROM s) - 3 * coalesce(sum(s) FILTER (w * level > 3 * s), 0)) / nullif(sum(w) FILTER (w * level <= 3 * s), 0) FROM s), level)) FROM lv WHERE i < 40),
e AS (SELECT max(level) AS level FROM lv)
SELECT doc_id, size, s::BIGINT AS source_size, round(least(w * level, 3 * s), 2) AS target, true AS within FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source CROSS JOIN e""",
}

#: Prefixes are told apart by a hash chained over their turns; a node's subtree is met through the prefixes of its least member.
ORACLE["op11_prefix_trie"] = """
WITH RECURSIVE o AS MATERIALIZED (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT i, 0 AS step, i::UBIGINT AS v FROM range(256) t(i) UNION ALL SELECT i, step + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END FROM crc WHERE step < 8),
tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM crc WHERE step = 8),
ids AS MATERIALIZED (SELECT DISTINCT c FROM o), digits AS (SELECT c, c::VARCHAR AS s, 0 AS i, 4294967295::UBIGINT AS v FROM ids UNION ALL SELECT c, s, i + 1, xor(v // 256, (SELECT t FROM tab)[xor(v % 256, ascii(s[i + 1])::UBIGINT)::INT + 1]) FROM digits WHERE i < length(s)),
h AS MATERIALIZED (SELECT c, (xor(v, 4294967295::UBIGINT) % 4)::INT AS h FROM digits WHERE i = length(s)),
lent AS (SELECT h.c, h.h, (SELECT count(*) FROM o WHERE o.c = h.c - h.c % 20 AND o.p <= h.h) AS b FROM h),
r AS MATERIALIZED (SELECT l.c, o.p, role, text FROM lent l JOIN o ON o.c = l.c - l.c % 20 AND o.p <= l.b UNION ALL SELECT l.c, l.b + o.p - l.h, role, text FROM lent l JOIN o ON o.c = l.c AND o.p > l.h),
dep AS MATERIALIZED (SELECT ids.c, count(p) AS depth FROM ids LEFT JOIN r ON r.c = ids.c GROUP BY ids.c),
k AS MATERIALIZED (SELECT c, 0::BIGINT AS d, '' AS key, 0 AS w FROM ids UNION ALL SELECT k.c, k.d + 1, md5(k.key || '/' || length(role) || ':' || role || text), len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) FROM k JOIN r ON r.c = k.c AND r.p = k.d + 1),
node AS MATERIALIZED (SELECT d, key, min(k.c) AS low, count(*) AS n, any_value(w) AS w, count(*) FILTER (WHERE depth = d) AS ended, string_agg(k.c::VARCHAR, ',' ORDER BY k.c) FILTER (WHERE depth = d) AS e FROM k JOIN dep ON dep.c = k.c GROUP BY d, key),
up AS MATERIALIZED (SELECT n.d, n.key, n.low, a.key AS above, a.low AS alow FROM node n JOIN k ON k.c = n.low AND k.d = n.d - 1 JOIN node a ON a.d = k.d AND a.key = k.key),
kids AS (SELECT d - 1 AS d, above AS key, count(*) AS kids FROM up GROUP BY ALL),
full_node AS MATERIALIZED (SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN kids ON kids.d = node.d AND kids.key = node.key),
sums AS (SELECT a.d, a.key, sum((n.kids = 0)::INT)::BIGINT AS leaves, sum((n.n - 1) * n.w)::BIGINT AS saved FROM full_node n JOIN k ON k.c = n.low AND k.d <= n.d JOIN node a ON a.d = k.d AND a.key = k.key GROUP BY a.d, a.key)
SELECT f.low AS conv_id, f.d AS depth, alow AS parent_conv_id, n AS n_convs, kids AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256
FROM full_node f JOIN sums s ON s.d = f.d AND s.key = f.key LEFT JOIN up ON up.d = f.d AND up.key = f.key"""

ORACLE["op12_collocation"] = f"""
WITH p AS MATERIALIZED (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_ASCII_LOWER.format(x="coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, range(1, 6) r(k) WHERE len(ws) >= k) GROUP BY ALL HAVING count(*) >= 100),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
inn AS (SELECT DISTINCT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, a, ws, k, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 5) r(m) WHERE m < k)),
kept AS (SELECT * FROM c ANTI JOIN inn USING (lang, phrase, a)),
s AS (SELECT kept.lang, kept.phrase, kept.a, n, q, x.a AS l, y.a AS r, ((1000::HUGEINT * kept.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score FROM kept JOIN t USING (lang), range(1, 5) z(q), f x, f y WHERE q < kept.k AND x.lang = kept.lang AND y.lang = kept.lang AND x.phrase = array_to_string(kept.ws[1:q], ' ') AND y.phrase = array_to_string(kept.ws[q + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, q) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= 2000"""

ORACLE["op13_cover_search"] = """
WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS uid, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.uid, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON c.uid <> q.uid WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 10"""
