"""Scalar text functions as Column expressions: folding, redaction, hashing, keys, tokens."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
REDACTED = "[REDACTED]"
MARKER = "... [truncated]"

# The letters whose accents a topic key folds.
ACCENTED = "áàäâãåéèëêíìïîóòöôõúùüûñçýÿ"
UNACCENTED = "aaaaaaeeeeiiiiooooouuuuncyy"

# Spellings folded onto the kinds.
KIND_FOLDS = {
    "bugfix": ("bug", "fix", "hotfix", "incident", "regression"),
    "architecture": ("design", "adr", "refactor"),
    "discovery": ("learning", "research", "investigation", "root_cause", "root-cause", "passive", "manual"),
    "pattern": ("convention", "guideline", "rule"),
    "config": ("setup", "infra", "infrastructure", "ci", "configuration"),
    "preference": ("feedback", "user", "preferences"),
}
KINDS = ("bugfix", "decision", "policy", "architecture", "discovery", "pattern", "config", "preference")
SESSION_SUMMARY = "session_summary"
# Months until a note of a kind is due for review.
REVIEW_MONTHS = {"decision": 6, "policy": 12, "preference": 3}
RELATION_VERBS = ("related", "compatible", "scoped", "conflicts_with", "supersedes", "not_conflict")
SCOPES = ("project", "personal", "global")

# Kinds that name a topic family, and words that give one away, in order.
FAMILY_KINDS = {
    "architecture": ("architecture", "design", "adr", "refactor"),
    "bug": ("bug", "bugfix", "fix", "incident", "hotfix"),
    "decision": ("decision",),
    "pattern": ("pattern", "convention", "guideline"),
    "config": ("config", "setup", "infra", "infrastructure", "ci"),
    "discovery": ("discovery", "investigation", "root_cause", "root-cause"),
    "learning": ("learning", "learn"),
    "session": ("session_summary",),
}
FAMILY_WORDS = {
    "bug": ("bug", "fix", "panic", "error", "crash", "regression", "incident", "hotfix"),
    "architecture": ("architecture", "design", "adr", "boundary", "hexagonal", "refactor"),
    "decision": ("decision", "tradeoff", "chose", "choose", "decide"),
    "pattern": ("pattern", "convention", "naming", "guideline"),
    "config": ("config", "setup", "environment", "env", "docker", "pipeline"),
    "discovery": ("discovery", "investigate", "investigation", "found", "root cause"),
    "learning": ("learned", "learning"),
}


def _diacritics() -> tuple[str, str]:
    """Small Latin letters that are a basic letter and one mark, by canonical decomposition; letters with two marks and
    other scripts keep theirs, as in the index that this one follows."""
    out = []
    for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))):
        base = unicodedata.normalize("NFD", c)
        if len(base) == 2 and base[0].isascii() and unicodedata.combining(base[1]) and unicodedata.category(c) == "Ll":
            out.append((c, base[0]))
    return "".join(a for a, _ in out), "".join(b for _, b in out)


DIACRITICS = _diacritics()


def bound(x: Column, of: Callable[[Column], Column]) -> Column:
    """of(x) with x worked out once a row, however often it stands in it; Spark does not share what stands in branches of a condition."""
    return F.element_at(F.transform(F.array(x), of), 1)


def strip_nul(x: Column) -> Column:
    return F.translate(x, "\u0000", "")


def one_line(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, SPACE, " "))


def strip_private(x: Column) -> Column:
    return F.regexp_replace(strip_nul(F.regexp_replace(x, r"(?is)<private>.*?</private>", r"\[REDACTED\]")), r"(?U)^\s+|\s+$", "")


def fold_accents(x: Column) -> Column:
    return F.translate(x, ACCENTED, UNACCENTED)


def project(x: Column) -> Column:
    """The last segment of a path, on one line, lower case, runs of - and _ collapsed."""
    segments = F.filter(F.split(x, r"[/\\]"), lambda s: F.length(one_line(s)) > 0)
    last = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit(""))
    return F.regexp_replace(F.regexp_replace(F.lower(one_line(last)), "-{2,}", "-"), "_{2,}", "_")


def scope(x: Column) -> Column:
    v = F.lower(F.trim(x))
    return F.when(v.isin(*SCOPES), v).otherwise(F.lit("project"))


def kind(x: Column) -> Column:
    v = F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    out = v
    for k, spellings in KIND_FOLDS.items():
        out = F.when(v.isin(*spellings), F.lit(k)).otherwise(out)
    return out


def topic_key(x: Column) -> Column:
    """Lower case, accents folded, anything but letters, digits, dots and slashes to hyphens between words, 120 at most."""
    v = F.regexp_replace(fold_accents(F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))), "[^a-z0-9./]+", " ")
    key = F.left(F.array_join(F.transform(F.split(v, "/", -1), lambda s: F.regexp_replace(F.trim(s), " +", "-")), "/"), F.lit(120))
    return F.when(F.length(key) > 0, key)


def topic_segment(x: Column) -> Column:
    v = F.regexp_replace(fold_accents(F.lower(F.trim(x))), "[^a-z0-9./]+", " ")
    v = F.left(F.regexp_replace(F.trim(v), " +", "-"), F.lit(100))
    return F.when(v.rlike("[a-z0-9]"), v).otherwise(F.lit(""))


def topic_family(kind_: Column, title: Column, content: Column) -> Column:
    k = F.lower(F.trim(kind_))

    def told(text: Column) -> Column:
        out = F.when((k != "") & (k != "manual"), topic_segment(k)).otherwise(F.lit("topic"))
        for family, words in reversed(FAMILY_WORDS.items()):
            hit = F.lit(False)
            for w in words:
                hit = hit | text.contains(w)
            out = F.when(hit, F.lit(family)).otherwise(out)
        return out

    out = bound(F.lower(F.concat_ws(" ", title, content)), told)
    for family, kinds in FAMILY_KINDS.items():
        out = F.when(k.isin(*kinds), F.lit(family)).otherwise(out)
    return out


def suggest_topic_key(kind_: Column, title: Column, content: Column) -> Column:
    """The title itself if it is a key already, else family/segment."""
    words = F.array_join(F.slice(F.split(one_line(F.lower(strip_private(content))), " "), 1, 8), " ")
    segment = bound(topic_segment(strip_private(title)), lambda first: F.when(first != "", first).otherwise(topic_segment(words)))

    def built(family: Column) -> Column:
        lead = F.concat(family, F.lit("-"))
        rest = bound(segment, lambda s: F.when(s.startswith(lead), F.substring(s, F.length(lead) + 1, F.length(s))).otherwise(s))
        key = bound(rest, lambda s: F.concat_ws("/", family, F.when((s == "") | (s == family), F.lit("general")).otherwise(s)))
        return bound(key, lambda k: F.coalesce(topic_key(k), k))

    return F.when(title.contains("/") & topic_key(title).eqNullSafe(title), title).otherwise(bound(topic_family(kind_, title, content), built))


def body_hash(x: Column) -> Column:
    return F.sha2(F.lower(one_line(x)), 256)


# Bold, code and italics in a line of Markdown.
INLINE_MARKS = (r"\*\*([^*]+)\*\*", r"`([^`]+)`", r"\*([^*]+)\*")


def clean_markdown(x: Column) -> Column:
    for p in INLINE_MARKS:
        x = F.regexp_replace(x, p, "$1")
    return one_line(x)


def prompt_core(x: Column) -> Column:
    """A prompt without a leading command, on one line, lower case."""
    bare = F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+", ""), r"(?U)^[/$][\p{L}\p{N}_:-]+(?=\s)", "")
    return F.lower(one_line(bare))


def truncate_bytes_marked(x: Column, most: int) -> Column:
    """At most `most` bytes, the marker included, cut between characters."""
    room = max(most - len(MARKER), 0) if most > len(MARKER) else most
    b = x.cast("binary")
    # drop the bytes of a character that the cut splits: its lead byte and what follows
    head = F.decode(F.substring(b, 1, room), "ISO-8859-1")
    whole = F.regexp_replace(head, r"[À-ÿ][\u0080-¿]*$", "")
    tail = F.regexp_extract(head, r"([À-ÿ][\u0080-¿]*)$", 1)
    need = F.when(tail.rlike(r"^[ð-ÿ]"), 4).when(tail.rlike(r"^[à-ï]"), 3).otherwise(2)
    bytes_ = F.when((F.length(tail) > 0) & (F.length(tail) < need), F.encode(whole, "ISO-8859-1")).otherwise(F.substring(b, 1, room))
    cut = F.decode(bytes_, "UTF-8")
    return F.when(F.octet_length(x) <= most, x).otherwise(F.concat(cut, F.lit(MARKER)) if most > len(MARKER) else cut)


def truncate_words(x: Column, most: int) -> Column:
    folded = one_line(x)
    if most <= 3:
        return F.left(folded, F.lit(most))
    head = F.left(folded, F.lit(most - 3))
    kept = F.regexp_extract(head, r"(?s)^(.*)\s", 1)
    cut = F.when(F.trim(kept) != "", kept).otherwise(head)
    return F.when(F.length(folded) <= most, folded).otherwise(F.concat(F.regexp_replace(cut, "[ ,;:-]+$", ""), F.lit("...")))


def title(x: Column, most: int = 50_000) -> Column:
    return truncate_bytes_marked(one_line(strip_private(x)), most)


def goal_of(summary: Column) -> Column:
    """The first filled line below the goal heading of a summary."""
    return F.nullif(F.trim(F.regexp_extract(summary, r"(?m)^##\s+Goal\s*\n+\s*([^\n]+)", 1)), F.lit(""))


def timestamp(x: Column) -> Column:
    """Both spellings of a time; anything else is null."""
    plain = F.try_to_timestamp(x, F.lit("yyyy-MM-dd HH:mm:ss"))
    zoned = [F.try_to_timestamp(x, F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")]
    return F.date_trunc("second", F.coalesce(plain, *zoned))


def review_after(kind_: Column, since: Column) -> Column:
    """The clamped calendar date from which a note of this kind is due; null for kinds that never are."""
    out = F.lit(None).cast("timestamp")
    for k, months in REVIEW_MONTHS.items():
        out = F.when(kind_ == k, since + F.expr(f"INTERVAL {months} MONTHS")).otherwise(out)
    return out


def state(deleted_at: Column, review: Column, as_of: Column) -> Column:
    return F.when(deleted_at.isNotNull(), "deleted").when(review <= as_of, "needs_review").otherwise("active")


def slug(x: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(fold_accents(F.lower(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit("untitled")).otherwise(s)


def chunk_id(x: Column) -> Column:
    return F.left(F.sha2(x, 256), F.lit(8))


def is_chunk_id(x: Column) -> Column:
    return x.rlike("^[0-9a-f]{8}$")


def fold_term(x: Column) -> Column:
    return F.translate(F.lower(x), *DIACRITICS)


def tokens(x: Column) -> Column:
    """Runs of letters and digits, lower case, diacritics of composed letters removed."""
    return F.filter(F.split(F.regexp_replace(fold_term(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda t: t != "")


def prompt_terms(x: Column, most: int = 32) -> Column:
    """Words of a prompt to search by: three letters or more, underscores kept, each once."""
    words = F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return F.slice(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3)), 1, most)


def backoff_seconds(failures: Column, base: int = 1, most: int = 300) -> Column:
    return F.when(failures <= 0, F.lit(0.0)).otherwise(F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(31))), F.lit(float(most))))


def is_confidence(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & x.between(0.0, 1.0)


def directory_key(x: Column) -> Column:
    """A path for comparison: slashes one way, no slash at the end, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(x), r"[\\\\/]+", "/"), "/$", ""))


def repo_of_remote(x: Column) -> Column:
    """The repository that a remote address names."""
    return F.nullif(F.regexp_extract(F.trim(x), r"([^/:\\\\]+?)(?:\.git)?/*$", 1), F.lit(""))


def sample_words(x: Column, count: int, skip: int = 0) -> Column:
    """Some words of a text to look for it by."""
    return F.array_join(F.slice(prompt_terms(x, 10_000), skip + 1, count), " ")


def filled(template: str, **values: Column) -> Column:
    """A prompt with its {names} filled in."""
    out = F.lit(template)
    for name, v in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(v, F.lit("")))
    return out


def sync_id(kind_: str, *parts: Column) -> Column:
    """A name that the same parts always get."""
    return F.concat(F.lit(f"{kind_}-"), F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16)))


def nonempty_or(x: Column, other: Column) -> Column:
    return F.when(F.trim(F.coalesce(x, F.lit(""))) != "", x).otherwise(other)
