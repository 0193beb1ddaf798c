"""Places of regular-expression matches in Spark's own expressions, which offer the matched texts but not where they are.

A text is marked with two control characters around each match and split there; lengths add up to places. The control characters are first
replaced in the text by a third one, which none of the patterns match, so the marks are unmistakable and code points keep their places.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE, STAND_IN = "\u0001", "\u0002", "\u0003"


def marked(text: Column, pattern: str) -> Column:
    """The pieces of the text: the first has no match, each other one begins with a match that ends at CLOSE."""
    return F.split(F.regexp_replace(F.translate(text, OPEN + CLOSE, STAND_IN * 2), pattern, f"{OPEN}$0{CLOSE}"), OPEN, -1)


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, found) of the leftmost non-overlapping matches; code points, end exclusive."""
    pieces = marked(text, pattern)

    def step(acc: Column, piece: Column) -> Column:
        found = F.substring_index(piece, CLOSE, 1)
        one = F.struct(acc["at"].alias("start"), (acc["at"] + F.length(found)).alias("end"), found.alias("found"))
        return F.struct((acc["at"] + F.length(piece) - 1).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    return F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), F.struct(F.length(pieces[0]).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
