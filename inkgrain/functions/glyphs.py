"""Letters taken apart into base, modifier and tone (T3, T4), as a small table to broadcast.

The table is made by rule from Unicode's canonical decompositions: the base is the first
character, each mark is classed by its code point, a later mark of the same kind wins and unknown
marks are ignored.  It holds a few thousand rows whatever the data, so broadcasting it is safe.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# Marks of tone and of shape by code point.
TONES = {"́": "sac", "̀": "huyen", "̉": "hoi", "̃": "nga", "̣": "nang"}
MODIFIERS = {"̆": "breve", "̂": "circumflex", "̛": "horn"}
STROKED = {"đ": "d", "Đ": "D"}
BEARS_MODIFIER, BEARS_TONE = "aeoud", "aeiouy"
SCHEMA = "ch string, base string, modifier string, tone string, is_letter boolean, bears_mod boolean, bears_tone boolean"


def decompose(ch: str) -> tuple[str, str, str]:
    """``(base, modifier, tone)`` of one character; ``none`` and ``ngang`` where it has no mark."""
    if ch in STROKED:
        return STROKED[ch], "stroke", "ngang"
    parts = unicodedata.normalize("NFD", ch)
    modifier, tone = "none", "ngang"
    for mark in parts[1:]:
        modifier = MODIFIERS.get(mark, modifier)
        tone = TONES.get(mark, tone)
    return parts[0], modifier, tone


def row_of(ch: str) -> tuple:
    base, modifier, tone = decompose(ch)
    low = base.lower()
    return ch, base, modifier, tone, base.isalpha(), low in BEARS_MODIFIER, low in BEARS_TONE


@lru_cache(maxsize=1)
def rows() -> list[tuple]:
    """Every assigned letter below U+3000 that decomposes or bears an axis, and plain ASCII."""
    keep = []
    for cp in range(0x20, 0x3000):
        ch = chr(cp)
        if cp < 0x7F or ch in STROKED or unicodedata.normalize("NFD", ch) != ch:
            keep.append(row_of(ch))
    return keep


def table(spark: SparkSession) -> DataFrame:
    """The glyph table; a character not in it is its own base without marks."""
    return spark.createDataFrame(rows(), SCHEMA)


def letters(pick) -> str:
    """The characters of the table for which ``pick(row)`` holds, for regular expressions."""
    return "".join(r[0] for r in rows() if pick(r))


def values_sql(only: str | None = None) -> str:
    """The table (or its rows for the characters of *only*) as a SQL VALUES list."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in rows() if only is None or r[0] in only)
