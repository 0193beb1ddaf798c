"""Readers of Markdown bodies that need a state from line to line: Arrow-batched functions."""

from __future__ import annotations

import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .text import INLINE_MARKS

_INLINE = tuple(re.compile(p) for p in INLINE_MARKS)

# Headings under which learnings are listed, in twelve languages.
LEARNING_HEADINGS = (
    "Key Learnings", "Learnings", "Key Takeaways",
    "Aprendizajes Clave", "Aprendizajes", "Lecciones Aprendidas",
    "Aprendizados Principais", "Aprendizados", "Aprendizagens", "Lições Aprendidas",
    "Enseignements Clés", "Enseignements", "Apprentissages", "Leçons Apprises",
    "Wichtigste Erkenntnisse", "Erkenntnisse", "Lernpunkte",
    "Apprendimenti Chiave", "Apprendimenti", "Lezioni Apprese",
    "Aprenentatges Clau", "Aprenentatges", "Lliçons Apreses",
    "Aprendizaxes Clave", "Aprendizaxes", "Leccións Aprendidas",
    "Ikasitako Nagusiak", "Ikasitakoak", "Ikaskuntzak",
    "Belangrijkste Inzichten", "Inzichten", "Leerpunten",
    "Kluczowe Wnioski", "Wnioski", "Kluczowe Spostrzezenia",
    "Viktigaste Lärdomar", "Lärdomar", "Insikter",
)
# Letters that stand for each other in a heading, the plain one first.
_ALIKE = ("aáàâäå", "eéèêë", "iíìîï", "oóòôö", "uúùûü", "cç", "nñ", "zżź", "sś", "lł")
_PLAIN = str.maketrans({letter: group[0] for group in _ALIKE for letter in group})


def _folded(heading: str) -> str:
    return " ".join(heading.lower().translate(_PLAIN).split())


_HEADINGS = frozenset(map(_folded, LEARNING_HEADINGS))


def _level(line: str) -> int:
    """Of a heading: its marks, with white space behind them; else 0."""
    n = len(line) - len(line.lstrip("#"))
    return n if 0 < n < len(line) and line[n].isspace() else 0


def _opens(line: str) -> bool:
    """Whether a line is a heading of learnings, in the singular or plural, with a colon or without."""
    if _level(line) not in (2, 3):
        return False
    name = _folded(line.lstrip("#")).removesuffix(":").rstrip()
    return name in _HEADINGS or name.removesuffix("s") in _HEADINGS


def _item(line: str, numbered: bool) -> str | None:
    """The text of a list item."""
    s = line.lstrip()
    mark = len(s) - len(s.lstrip("0123456789")) if numbered else 0
    if numbered and not mark or s[mark : mark + 1] not in ((".", ")") if numbered else ("-", "*")):
        return None
    rest = s[mark + 1 :]
    return rest.lstrip() if rest[:1].isspace() and rest.strip() else None


def clean(text: str) -> str:
    for p in _INLINE:
        text = p.sub(r"\1", text)
    return " ".join(text.split())


def mask_code(text: str) -> str:
    """Fenced blocks as blanks of the same length."""
    out, fenced = [], False
    for line in text.splitlines(keepends=True) if "\r" not in text else re.findall(r"[^\n]*\n|[^\n]+$", text):
        fence = line.lstrip().startswith("```")
        out.append(re.sub(r"[^\n]", " ", line) if fence or fenced else line)
        fenced ^= fence
    return "".join(out)


def learnings(text: str | None) -> list[str]:
    """Items of the last section of learnings that has any: its numbered list, else its bullets."""
    lines = mask_code(text or "").split("\n")
    for at in reversed([i for i, line in enumerate(lines) if _opens(line)]):
        end = next((i for i in range(at + 1, len(lines)) if 0 < _level(lines[i]) <= 3), len(lines))
        for numbered in (True, False):
            items = [clean(x) for line in lines[at + 1 : end] if (x := _item(line, numbered)) is not None]
            found = [c for c in items if len(c.encode()) >= 20 and len(c.split()) >= 4]
            if found:
                return found
    return []


def headline(text: str | None, most: int = 80) -> str | None:
    """The first line of prose of a body, cut at a word."""
    for raw in mask_code(text or "").split("\n"):
        line = raw.strip()
        if not line or line.startswith(("#", "---")):
            continue
        line = clean(line[2:] if line[:2] in ("- ", "* ", "+ ") else line)
        if len(line) < 12 or len(line.split()) < 4:
            continue
        if len(line) <= most:
            return line
        head = line[:most]
        return (head.rsplit(" ", 1)[0] if " " in head else head).rstrip(" ,.;:") + "…"
    return None


def canonical_json(text: str | None) -> str | None:
    """Keys in order at every depth, no spaces; a string that holds JSON is read first; null if it is not JSON."""
    try:
        value = json.loads(text or "")
        if isinstance(value, str):
            value = json.loads(value)
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return None


def verdict(text: str | None) -> dict | None:
    """The judge's answer: the first balanced JSON object, with a known verb and a confidence within bounds."""
    from .text import RELATION_VERBS

    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text or ""):
        try:
            got, _ = decoder.raw_decode(text[m.start() :])
        except ValueError:
            continue
        verb = str(got.get("relation", "")).strip().lower()
        if verb not in RELATION_VERBS:
            return None
        try:
            sure = min(1.0, max(0.0, float(got.get("confidence", 0) or 0)))
        except (TypeError, ValueError):
            sure = 0.0
        return {"relation": verb, "confidence": sure, "reason": str(got.get("reason", "") or "")}
    return None


@F.pandas_udf(ArrayType(StringType()))
def learnings_udf(texts: pd.Series) -> pd.Series:
    return texts.map(learnings)


@F.arrow_udf(StringType())
def headline_udf(texts: pa.Array) -> pa.Array:
    """One text at a time is a Python string, as bodies are long and headlines short."""
    return pa.array([headline(t.as_py()) for t in texts], pa.string())


@F.pandas_udf(StringType())
def canonical_json_udf(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_json)


@F.pandas_udf(StructType([StructField("relation", StringType()), StructField("confidence", DoubleType()), StructField("reason", StringType())]))
def verdict_udf(texts: pd.Series) -> pd.DataFrame:
    rows = [verdict(t) or {} for t in texts]
    return pd.DataFrame({c: [r.get(c) for r in rows] for c in ("relation", "confidence", "reason")})


def register(spark) -> None:
    """The functions under SQL names."""
    from .porter import stem_udf

    for name, f in (("porter_stem", stem_udf), ("extract_learnings", learnings_udf), ("headline", headline_udf), ("canonical_json", canonical_json_udf), ("parse_verdict", verdict_udf)):
        spark.udf.register(name, f)
