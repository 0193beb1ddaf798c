"""Quality by weak supervision: rules vote or abstain, EM estimates their accuracies, a posterior decides.

One pass over the texts computes a few counts a document. Every rule turns them into a vote for good (+1) or for bad (-1)
or abstains (0). Documents with equal votes are alike to the model, so EM runs on the counts of the vote patterns: one
group-by over all documents, with at most 2**len(rules()) rows whatever the input, fits the model exactly as all rows would.
The posterior log-odds are then a sum of one number a vote, which Spark adds up in its own code.

Rows: a null text is an empty one. No words: base_failed. Repeated rows and repeated ids are scored one by one. An empty
table gives an empty result. Columns of the input travel in a struct, so none clashes, whatever its name: scores returns its
own, keep returns the input's alone. A posterior equal to the threshold keeps a document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import kernel as K
from .common import Workspace, column, ship

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_upper_words", "n_short_words", "n_marks", "n_distinct_words")
PREFIX = "_notelake_"
#: Bytes of text that are counted at once; the counts take a hundred times as much.
COUNTED_BYTES = 1 << 17

_SYMBOL, _MARK, _ENDING = (np.zeros(256, bool) for _ in range(3))
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK[list(b"!?")] = True
_ENDING[list(b".!?:;\"')")] = True
_UPPER, _CASED = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_CASED[97:123] = True


def _sum(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many are set from each offset to the next."""
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def _repeated(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys of rows: whether a key comes twice or more in its row, and whether it came before."""
    order = np.lexsort((np.arange(len(keys)), keys, row))
    k, r = keys[order], row[order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    again, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice, again


def count(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text. Line and window equality is by 64-bit hashes within one text."""
    data, rows = K.buffers(texts)
    w = K.Words(data, rows)
    hashes = w.hashes(data)
    of = K.counts_to_rows(w.off)
    out = {"n_words": np.diff(w.off)}
    points = (data & 0xC0) != 0x80
    length = np.concatenate(([0], np.cumsum(points, dtype=np.int64)))
    chars = length[w.end] - length[w.start]
    by_row = lambda x: np.bincount(of, weights=x, minlength=len(rows) - 1).astype(np.int64)
    out["word_chars"] = by_row(chars)
    out["n_symbols"], out["n_marks"] = _sum(_SYMBOL[data], rows), _sum(_MARK[data], rows)
    upper = np.concatenate(([0], np.cumsum(_UPPER[data], dtype=np.int64)))
    small = np.concatenate(([0], np.cumsum(_CASED[data], dtype=np.int64)))
    shouted = (upper[w.end] - upper[w.start] >= 2) & (small[w.end] == small[w.start])
    out["n_upper_words"], out["n_short_words"] = by_row(shouted), by_row(chars <= 3)

    cut = np.zeros(len(data) + 1, bool)  # lines: from a row's start or after a newline
    cut[rows[:-1]] = True
    cut[1:] |= np.concatenate((data == 10, [False]))[: len(data)]
    begin = np.flatnonzero(cut[:-1])
    first = np.searchsorted(begin, rows)
    end = np.append(begin[1:], len(data))
    end = end - (data[end - 1] == 10) * (end > begin) if len(begin) else end
    k = np.searchsorted(w.start, begin)
    words_in = np.searchsorted(w.start, end) - k
    full = words_in > 0
    begin, end, last = begin[full], end[full], (k + words_in - 1)[full]
    line_row = K.counts_to_rows(first)[full]
    _, again = _repeated(K.hashed(data, begin, end), line_row)
    lines = lambda x=None: np.bincount(line_row, weights=x, minlength=len(rows) - 1).astype(np.int64)
    out["n_lines"], out["n_dup_lines"] = lines(), lines(again)
    out["n_ended_lines"] = lines(_ENDING[data[w.end[last] - 1]])

    starts = K.window_starts(w.off, 5)
    q = K.FIRST.prefix(hashes)
    twice, _ = _repeated(K.FIRST.spans(q, starts, starts + 5), of[starts])
    out["n_repeat_words"] = by_row(K.covered(len(hashes), starts[twice], 5))
    _, seen = _repeated(hashes, of)
    out["n_distinct_words"] = by_row(~seen)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in K.slices(batches, limit=COUNTED_BYTES):
        c = count(piece.column("text"))
        yield pa.RecordBatch.from_arrays([piece.column("row"), *(pa.array(c[x], pa.int64()) for x in COUNTS)], ["row", *(f"{PREFIX}{x}" for x in COUNTS)])


def counted(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """`row`, a struct of the columns `keep`, and the counts under PREFIX beside it, so that no names can clash; a map over
    the rows, nothing is shuffled."""
    row = F.struct(*(column(c) for c in keep)) if keep else F.lit(None).cast("int")
    rows = df.select(row.alias("row"), column(text).cast("string").alias("text"))
    schema = StructType([rows.schema["row"], *(StructField(f"{PREFIX}{c}", LongType()) for c in COUNTS)])
    return rows.mapInArrow(_counted, schema)


def q(name: str) -> Column:
    return F.col(f"{PREFIX}{name}")


def _share(part: str, whole: str) -> Column:
    return q(part) / F.greatest(q(whole), F.lit(1))


@dataclass(frozen=True)
class Rule:
    """Votes `vote` (+1 good, -1 bad) where `when` holds, else abstains. Junk comes in kinds that share no symptom, so the
    lack of one kind's symptom is no vote for good; only the rules that look at the whole text vote so."""

    name: str
    vote: int
    when: Column

    def column(self) -> Column:
        return F.when(self.when, F.lit(self.vote)).otherwise(F.lit(0)).cast("tinyint").alias(f"vote_{self.name}")


def rules() -> list[Rule]:
    """The rules of production."""
    mean = q("word_chars") / F.greatest(q("n_words"), F.lit(1))
    some, enough = q("n_words") >= 10, q("n_words") >= 20
    symbols, marks, upper = _share("n_symbols", "n_words"), _share("n_marks", "n_words"), _share("n_upper_words", "n_words")
    short, distinct, repeats = _share("n_short_words", "n_words"), _share("n_distinct_words", "n_words"), _share("n_repeat_words", "n_words")
    return [
        Rule("symbols", -1, some & (symbols > 0.15)),
        Rule("heavy_symbols", -1, some & (symbols > 0.4)),
        Rule("repeats", -1, some & (repeats > 0.15)),
        Rule("lines", -1, (_share("n_dup_lines", "n_lines") > 0.4) & (q("n_lines") > 3)),
        Rule("endings", -1, some & (_share("n_ended_lines", "n_lines") < 0.35)),
        Rule("shouting", -1, some & (upper > 0.3)),
        Rule("marks", -1, some & (marks > 0.4)),
        Rule("lengths", -1, some & ((mean < 3) | (mean > 7.2))),
        Rule("small_words", -1, enough & (short < 0.08)),
        Rule("monotony", -1, (q("n_words") >= 50) & (distinct < 0.2)),
        Rule("prose", 1, enough & (mean >= 4) & (mean <= 6.8) & (short >= 0.15) & (short < 0.47) & (symbols < 0.02) & (marks < 0.1) & (upper < 0.1)),
        Rule("varied", 1, enough & (repeats < 0.1) & (symbols < 0.1) & (marks < 0.2) & (upper < 0.2) & (_share("n_dup_lines", "n_lines") < 0.4)),
        Rule("sentences", 1, enough & (_share("n_ended_lines", "n_lines") >= 0.8) & (symbols < 0.1) & (repeats < 0.15) & (upper < 0.3) & (marks < 0.4)),
    ]


@dataclass
class Model:
    """balance: share of good documents among those that no rule speaks of; accuracy of each rule where it votes."""

    balance: float
    accuracy: list[float]

    def weights(self) -> list[float]:
        return [math.log(a / (1 - a)) for a in self.accuracy]

    def log_odds(self, votes: list[Column]) -> Column:
        total = F.lit(math.log(self.balance / (1 - self.balance)))
        for v, w in zip(votes, self.weights(), strict=True):
            total = total + v * F.lit(w)
        return total


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, balance: float = 0.5, accuracy: float = 0.85, weight: float = 20.0, rounds: int = 100, tolerance: float = 1e-9) -> Model:
    """EM over vote patterns and how many documents have each. A rule's accuracy is the expected share of its votes that
    are right, with a prior of `weight` votes at `accuracy`, within 0.55 and 0.995 so that none turns round or rules alone."""
    votes = np.array([p for p, _ in patterns], dtype=np.float64).reshape(-1, n_rules)
    n = np.array([c for _, c in patterns], dtype=np.float64)
    acc = np.full(n_rules, accuracy)
    for _ in range(rounds):
        odds = math.log(balance / (1 - balance)) + votes @ np.log(acc / (1 - acc))
        good = 1 / (1 + np.exp(-odds))
        right = (n[:, None] * np.where(votes > 0, good[:, None], np.where(votes < 0, 1 - good[:, None], 0))).sum(0)
        cast = (n[:, None] * (votes != 0)).sum(0)
        new = np.clip((right + weight * accuracy) / (cast + weight), 0.55, 0.995)
        done = np.abs(new - acc).max(initial=0) < tolerance
        acc = new
        if done:
            break
    return Model(balance, [float(a) for a in acc])


def base_failed(min_words: int = 10, max_repeat_percent: int = 20) -> Column:
    return (q("n_words") < min_words) | (100 * q("n_repeat_words") > max_repeat_percent * q("n_words"))


def fitted(votes_df: DataFrame, names: list[str]) -> Model:
    """Fits on all rows; at most 2**len(names) pattern counts come to the driver."""
    rows = votes_df.groupBy(*names).count().collect()
    return fit(sorted((tuple(r[n] for n in names), r["count"]) for r in rows), len(names))


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: id, the counts under PREFIX, vote_* of each rule, base_failed, p_good, kept."""
    ws = Workspace(docs.sparkSession, "quality")
    rs = rules()
    counts = counted(docs, text_col, [id_col])
    seen = ws.table(counts.select(F.col("row")[id_col].alias("id"), *(q(c) for c in COUNTS), *(r.column() for r in rs)), "votes")
    model = fitted(seen, [f"vote_{r.name}" for r in rs])
    odds = model.log_odds([F.col(f"vote_{r.name}") for r in rs])
    p = F.lit(1.0) / (1 + F.exp(-odds))
    return seen.withColumn("base_failed", base_failed()).withColumn("p_good", p).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def keep(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that pass, with the columns of the input. Two maps over the texts instead of a join with the scores."""
    ship(docs.sparkSession)
    rs = rules()
    votes = [r.column() for r in rs]
    names = [f"vote_{r.name}" for r in rs]
    model = fitted(counted(docs, text_col, []).select(*votes), names)
    odds = model.log_odds(votes)
    p = F.lit(1.0) / (1 + F.exp(-odds))
    good = counted(docs, text_col, docs.columns).where(~base_failed() & (p >= threshold))
    return good.select(*(F.col("row")[c].alias(c) for c in docs.columns))
