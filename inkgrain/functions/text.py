"""Text columns: cleaning, normal forms, counts, filters."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Strings all of whose characters match are in NFC already (nothing here composes or reorders).
STABLE = r"^[\x{0}-\x{2FF}\x{1EA0}-\x{1EF9}]*$"
# Characters stripped from both ends of a token.
STRIP = " \t\r\n\"'()[]{}<>«»“”‘’.,;:!?…·•|/\\"
USABLE = "[0-9A-Za-zÀ-ỹ]"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def _nfd(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFD", t))


def clean(c: Column) -> Column:
    """Without format characters."""
    return F.regexp_replace(c, r"\p{Cf}", "")


def nfc(c: Column) -> Column:
    """NFC after cleaning (T2).  Only strings outside the stable ranges reach Python."""
    t = clean(c)
    return F.when(t.rlike(STABLE), t).otherwise(_nfc(F.when(~t.rlike(STABLE), t)))


def chars(c: Column) -> Column:
    """The characters of a string; none for the empty string."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def word_list(c: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def transcript_kind(c: Column) -> Column:
    """``hash``, ``empty`` or ``kept`` for a stripped transcript (F2); null counts as empty."""
    t = F.coalesce(F.trim(c), F.lit(""))
    return F.when(t == "", "empty").when(t == "###", "hash").otherwise("kept")


def normal_state(c: Column) -> Column:
    """Which normal form the text is in (F3), on the text as it is."""
    up, down = _nfc(c), _nfd(c)
    return F.when((c == up) & (c == down), "ascii-only (NFC==NFD)").when(c == up, "NFC").when(c == down, "NFD").otherwise("MIXED/neither")


def strip_token(c: Column) -> Column:
    """A token without the punctuation at its ends."""
    own = "".join("\\" + x if x in "\\[]^-" else x for x in STRIP)
    return F.regexp_replace(c, f"^[{own}]+|[{own}]+$", "")


def vocab_pattern(vocab: str) -> str:
    """A pattern for strings of vocabulary characters only."""
    return "^[" + "".join("\\" + x if x in "\\[]^-&~" else x for x in sorted(set(vocab))) + "]*$"


def clean_token(c: Column, vocab: str) -> Column:
    """The cleaned token, null where it is empty, out of vocabulary or without letter or digit."""
    t = strip_token(nfc(c))
    return F.when((t != "") & t.rlike(vocab_pattern(vocab)) & t.rlike(USABLE), t)


def hygiene(c: Column, vocab: str) -> Column:
    """``struct<text, warnings>``: the label made plain, and what was odd about it (F14).  Never
    rejects a label; null gives null."""
    kept = F.trim(nfc(c))
    stray = F.array_distinct(F.filter(chars(kept), lambda x: ~x.rlike(vocab_pattern(vocab))))
    notes = F.array(
        F.when(clean(c) != c, F.lit("stripped invisible")),
        F.when(nfc(c) != clean(c), F.lit("composed")),
        F.when(F.trim(nfc(c)) != nfc(c), F.lit("stripped ends")),
        F.when(F.size(stray) > 0, F.concat(F.lit("out of vocabulary: "), F.concat_ws(" ", F.array_sort(stray)))),
    )
    return F.struct(kept.alias("text"), F.filter(notes, lambda x: x.isNotNull()).alias("warnings"))


def title(c: Column) -> Column:
    """Every letter after a non-letter upper, the others lower, as Python's ``title``."""
    cs = F.split(F.lower(c), "")
    return F.array_join(F.transform(cs, lambda x, i: F.when((i == 0) | ~F.get(cs, i - 1).rlike(r"\p{L}"), F.upper(x)).otherwise(x)), "")


def recase(c: Column, u: Column) -> Column:
    """Upper case for u < .68, title case for u < .84, else as it is."""
    return F.when(u < 0.68, F.upper(c)).when(u < 0.84, title(c)).otherwise(c)
