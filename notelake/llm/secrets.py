"""Secrets in texts by shape and by entropy, in Spark's own expressions.

Shapes: assignments of a value to a telling name, access key ids, runs of hexadecimal digits. Entropy: every run of key characters is
a candidate; a window slides over it with the counts of its characters, of which one falls and one rises at a step, and the Shannon entropy
follows from them. Each character class (hexadecimal, base 64, letters and digits) has its own threshold. The stretch from the first to
the last window over it is a span, unless the candidate matches the allow list. The texts are mapped in place: no join, no shuffle.

Rows: a null text is empty: no spans. Spans that begin together come in the order of KINDS. Repeated rows are scanned each for itself. Very long texts are scanned whole. Empty table: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column
from .spans import matches

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Bits a character over which a window of WINDOW characters is random, by class of the candidate.
THRESHOLDS = {"hex": 2.9, "base64": 3.7, "plain": 3.6}
#: Whole candidates that are public by nature: UUIDs, documented examples, runs of one character or of the alphabet, digests of nothing.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example",
    r"^(.)\1*$",
    r"(?i)^(?:0123456789)?abcdefghijklmnopqrstuvwxyz(?:0123456789)?$",
    r"^[/_=+-]+$",
    # digests of nothing: MD5, SHA-1, SHA-256
    r"(?i)^(?:d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855)$",
)


#: The characters of candidates. The counts of a window are numbers of BITS bits, PER of them to a long.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
BITS = 5
PER = 64 // BITS
LONGS = -(-len(ALPHABET) // PER)


def _clog(n: Column) -> Column:
    """n * log2(n), of a count up to WINDOW."""
    return F.element_at(F.array(*[F.lit(k * math.log2(k) if k > 1 else 0.0) for k in range(WINDOW + 1)]), n + 1)


def hot_stretch(text: Column, threshold: Column) -> Column:
    """(lo, hi): first and last start, from 1, of a window whose entropy reaches the threshold; lo is null if none does.

    What is carried from character to character are the counts of the window. A character that leaves takes one from its count, one that
    enters adds one, and the sum of c * log2(c) over the counts follows; no window is counted anew."""
    codes = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    event = lambda code, sign, i: F.struct(F.floor(code / PER).cast("int").alias("word"), (code % PER * BITS).alias("shift"), F.lit(sign).alias("sign"), i.alias("i"))

    def moved(i: Column) -> Column:
        into = event(F.element_at(codes, i), 1, i)
        return F.when(i > WINDOW, F.array(event(F.element_at(codes, i - WINDOW), -1, i), into)).otherwise(F.array(into))

    none = F.lit(None).cast("int")
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), LONGS).alias("counts"), F.lit(0.0).alias("s"), none.alias("lo"), none.alias("hi"))

    def step(acc: Column, e: Column) -> Column:
        before = F.call_function("shiftright", F.element_at(acc["counts"], e["word"] + 1), e["shift"]).bitwiseAND((1 << BITS) - 1).cast("int")
        change = F.call_function("shiftleft", e["sign"].cast("long"), e["shift"])
        counts = F.transform(acc["counts"], lambda x, k: F.when(k == e["word"], x + change).otherwise(x))
        s = acc["s"] + _clog(before + e["sign"]) - _clog(before)
        hot = (e["sign"] > 0) & (e["i"] >= WINDOW) & (F.lit(math.log2(WINDOW)) - s / WINDOW >= threshold)
        at = e["i"] - (WINDOW - 1)
        return F.struct(counts.alias("counts"), s.alias("s"), F.when(acc["lo"].isNull() & hot, at).otherwise(acc["lo"]).alias("lo"), F.when(hot, at).otherwise(acc["hi"]).alias("hi"))

    return F.aggregate(F.flatten(F.transform(F.sequence(F.lit(1), F.length(text)), moved)), start, step)


def _entropy(text: Column, allowed: tuple[str, ...]) -> Column:
    def judge(m: Column) -> Column:
        c = m["found"]
        fine = F.lit(False)
        for a in allowed:
            fine = fine | c.rlike(a)
        kind = F.when(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit(THRESHOLDS["hex"])).when(c.rlike("[+/=]"), F.lit(THRESHOLDS["base64"])).otherwise(F.lit(THRESHOLDS["plain"]))
        mixed = c.rlike("[0-9]") & c.rlike("[A-Za-z]")
        s = F.when(mixed & ~fine, hot_stretch(c, kind))
        return F.struct((m["start"] + s["lo"] - 1).alias("start"), (m["start"] + s["hi"] + WINDOW - 2 + 1).alias("end"))

    return F.filter(F.transform(matches(text, CANDIDATE), judge), lambda x: x["start"].isNotNull())


def _spans(kind: str, found: Column) -> Column:
    k = KINDS.index(kind)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("k"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text_col: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """The input with `_secrets`: an array of (start, k, end, kind) per kind under base and entropy, kept apart. A column of that
    name in the input is refused."""
    if "_secrets" in docs.columns:
        raise ValueError("the input has a column _secrets")
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    bare = F.array().cast("array<struct<start:int,end:int>>")
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    low = F.lower(text)
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    assign = F.when(named & text.rlike(ASSIGN), F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 2)) >= 12)).otherwise(none)
    access = F.when(text.contains("AKIA"), matches(text, ACCESS)).otherwise(none)
    hexed = F.when(text.rlike(HEX), matches(text, HEX)).otherwise(none)
    random = F.when(text.rlike(CANDIDATE), _entropy(text, allowed)).otherwise(bare)
    return docs.withColumn("_secrets", F.struct(_spans("assign", assign).alias("assign"), _spans("access", access).alias("access"), _spans("hex", hexed).alias("hex"), _spans("entropy", random).alias("entropy")))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, n_entropy, base (spans of the shapes), spans (all), as text kind:start:end."""
    s = scan(docs.select(column(id_col).alias("id"), column(text_col).alias("text")), "text").select("id", "_secrets")
    base = F.concat("_secrets.assign", "_secrets.access", "_secrets.hex")
    return s.select("id", *(F.size(f"_secrets.{k}").cast("long").alias(f"n_{k}") for k in KINDS), _joined(base).alias("base"), _joined(F.concat(base, F.col("_secrets.entropy"))).alias("spans"))
