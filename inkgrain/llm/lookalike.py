"""Problem 3: one form for text that looks the same.

Method: every token with a character outside plain ASCII and composed Vietnamese traverses a trie over the
corpus' own words with a weighted edit automaton that takes look-alikes, wide and other drawn forms, split-off
accents and ignorables at no cost (second-choice look-alikes at a small one); the cheapest, then most frequent
spelling is the canonical one, and tokens that match no word are normalized by table.

Only values that hold such a character reach Python; the rest is in form by a pattern the JVM checks.
Words and odd tokens meet by the hash of a skeleton that all spellings of one look share, so tries are
small, balanced and never broadcast.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrain.session import settle

# Letters of other scripts, and the Latin letter each looks like (then second choices).
LOOKS = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "Il", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ӏ": "Il", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ь": "b",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "к": "k",
    "ү": "y", "ӏ": "lI", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "Il", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "uvy", "χ": "x",
    "ϲ": "c", "ϳ": "j", "γ": "y", "η": "n", "τ": "t", "ω": "w",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "Օ": "O", "Տ": "S",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M",
    "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}
# Latin letters outside both alphabets that pass for a letter inside them.
LATIN = {"Ð": "Đ", "Ɖ": "Đ", "ð": "đ", "ɖ": "đ", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ƅ": "b"}
# Punctuation drawn like an ordinary sign.
SIGNS = {"‐": "-", "‑": "-", "−": "-", "﹣": "-", "˗": "-", "․": ".", "ꓸ": ".", "‚": ",", "⁄": "/", "∕": "/", "∶": ":", "꞉": ":", "ʼ": "'", "՚": "'", "ǃ": "!"}
# Characters without ink that Unicode does not call format characters.
BLANK = "͏ᅟᅠ឴឵⠀ㅤﾠ"
#: Compatibility forms that are the same sign drawn wide, narrow or in another face.
SAME = ("<wide>", "<narrow>", "<font>", "<noBreak>")
SECOND = 0.25  #: cost of a second-choice look-alike
LIMIT = 0.5  #: largest cost of a match

_BASES, _TONES = "aăâeêioôơuưy", ["", "̀", "́", "̃", "̉", "̣"]
VIETNAMESE = "".join(sorted({y for b in _BASES for t in _TONES for x in [unicodedata.normalize("NFC", b + t)] for y in (x, x.upper()) if not y.isascii()} | {"đ", "Đ"}))


def _ranges(letters: str) -> str:
    """The letters as ranges of a character class, which engines test faster than single ones."""
    out: list[list[int]] = []
    for cp in sorted(map(ord, letters)):
        if out and cp == out[-1][1] + 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in out)


#: Values all of whose characters match are in form.  (For Java, whose ``$`` also matches before a final
#: line end; Python's re has ``\Z`` for it.)
PLAIN = rf"^[ -~{_ranges(VIETNAMESE)}]*\z"
_IN_FORM = re.compile(PLAIN.replace(r"\z", r"\Z"))
#: What stands between tokens: every space and line end of Unicode.
_GAP = re.compile("[ \t\n\r\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SHAPES, _TONE_MARKS = "̛̂̆", "̣̀́̃̉"


@lru_cache(maxsize=100_000)
def _plain_char(ch: str) -> str:
    """One character without regard to its token: spaces, ignorables, drawn variants, signs."""
    cat = unicodedata.category(ch)
    if cat in ("Zs", "Zl", "Zp") or ch in "\t\n\r\x0b\x0c\x85":
        return " "
    if cat in ("Cf", "Cc") or ch in BLANK or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF:
        return ""
    if ch in SIGNS:
        return SIGNS[ch]
    if ch in LATIN:
        return LATIN[ch]
    if unicodedata.decomposition(ch).startswith(SAME):
        return unicodedata.normalize("NFKC", ch)
    return ch


def compose(text: str) -> str:
    """NFC after the marks of each letter are put shape first, tone last."""
    text = unicodedata.normalize("NFD", text)
    if not any(c in _SHAPES for c in text):
        return unicodedata.normalize("NFC", text)
    out: list[str] = []
    marks: list[str] = []
    for ch in text + "\0":
        if ch in _SHAPES or ch in _TONE_MARKS:
            marks.append(ch)
            continue
        if marks:
            out += sorted(marks, key=lambda m: m not in _SHAPES)
            marks = []
        out.append(ch)
    return unicodedata.normalize("NFC", "".join(out[:-1]))


def plain(text: str) -> str:
    """Spaces, ignorables, drawn variants, signs and composition; letters of other scripts stay."""
    return compose("".join(map(_plain_char, text)))


def _letters(token: str) -> tuple[int, int, int]:
    """Counts of Latin letters, foreign look-alikes, and other foreign letters."""
    latin = alike = other = 0
    for ch in unicodedata.normalize("NFD", token):
        if ch in LOOKS:
            alike += 1
        elif ch.isalpha():
            if ch < "ɐ" or "Ḁ" <= ch <= "ỿ":
                latin += 1
            else:
                other += 1
    return latin, alike, other


def fold(token: str) -> str:
    """Every look-alike as its first choice."""
    return compose("".join(LOOKS.get(ch, ch)[0] for ch in unicodedata.normalize("NFD", token)))


def _classes() -> dict[str, str]:
    """Letters that one look-alike may stand for share the least of them."""
    rep: dict[str, str] = {}
    for options in [v for v in LOOKS.values() if len(v) > 1]:
        group = set(options) | {k for k, r in rep.items() if r in {rep.get(o) for o in options}}
        rep |= dict.fromkeys(group, min(group))
    return rep


CLASSES = _classes()


def skeleton(token: str) -> str:
    """What all spellings of one look share."""
    return "".join(CLASSES.get(ch, ch) for ch in fold(token))


def lookups(text: str) -> list[str]:
    """The tokens of a text, as they are written, that are not plain and not of another script."""
    out = []
    for t in dict.fromkeys(_GAP.split(text)):
        if t and not _IN_FORM.match(t):
            latin, alike, other = _letters(plain(t))
            if not (other and latin <= alike + other):
                out.append(t)
    return out


def build_trie(words: list[str], counts: list[int]) -> dict:
    """Nested maps by composed letter; the key ``""`` holds count and word of an end."""
    root: dict = {}
    for w, n in zip(words, counts):
        node = root
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = (n, w)
    return root


@lru_cache(maxsize=100_000)
def _arcs(base: str, marks: str) -> tuple[tuple[str, float], ...]:
    """Letters of words that a written letter with its marks may stand for, and what each costs."""
    return tuple((compose(o + marks), SECOND if i else 0.0) for i, o in enumerate(LOOKS.get(base, base)))


def _written(token: str) -> list[list[str]]:
    """Letters with the marks after them, as read; ignorables take no step and cost nothing."""
    out: list[list[str]] = []
    for ch in token:
        for x in unicodedata.normalize("NFD", _plain_char(ch)):
            if unicodedata.combining(x) and out:
                out[-1][1] += x
            else:
                out.append([x, ""])
    return out


def spell(trie: dict, token: str) -> str | None:
    """The canonical spelling of *token*: cheapest match within ``LIMIT``, then most frequent, then
    least.  An ignorable, a drawn variant and an equal or look-alike letter cost nothing."""
    states: list[tuple[dict, float]] = [(trie, 0.0)]
    for base, marks in _written(token):
        arcs = _arcs(base, marks)
        states = [(node[letter], cost + more) for node, cost in states for letter, more in arcs if letter in node and cost + more <= LIMIT]
        if not states:
            return None
    ends = [(cost, -node[""][0], node[""][1]) for node, cost in states if "" in node]
    return min(ends)[2] if ends else None


def finish(text: str, spelled: dict[str, str]) -> str:
    """The one form of *text*; ``spelled`` has its matched tokens as they are written.

    A token of another script alone is a real word of that script when a letter of it looks like
    no Latin one, or when it matches no word of the corpus and nothing Latin stands beside it.
    """
    pieces = _GAP.split(text)
    bodies = [plain(t) for t in pieces]
    kinds = [_letters(t) for t in bodies]
    latin_beside = any(k[0] for k in kinds)
    strange = any(k[2] for k in kinds)
    out = []
    for raw, t, (latin, alike, other) in zip(pieces, bodies, kinds):
        if not alike:
            t = spelled.get(raw, t)
        elif not (other and latin <= alike + other):
            if raw in spelled and not other:
                t = spelled[raw]
            elif latin or (latin_beside and not strange):
                t = fold(t)
        out.append(t)
    return " ".join(out)


def _prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [(v, t, skeleton(plain(t))) for v in b["value"] for t in lookups(v)]
        yield pd.DataFrame(found, columns=["value", "token", "skeleton"])


def _match(words: pd.DataFrame, tokens: pd.DataFrame) -> pd.DataFrame:
    trie = build_trie(list(words["word"]), list(words["n"]))
    got = [(t, spell(trie, t)) for t in tokens["token"]]
    return pd.DataFrame([(t, s) for t, s in got if s is not None], columns=["token", "spelling"])


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        form = [finish(v, dict(zip(t, s)) if t is not None else {}) for v, t, s in zip(b["value"], b["tokens"], b["spellings"])]
        yield pd.DataFrame({"value": b["value"], "form": form, "n_spelled": [0 if t is None else len(t) for t in b["tokens"]]})


PER_TRIE = 5_000  #: odd tokens for each trie


def forms(values: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """``values(value)`` -> ``(value, form, n_spelled)`` for every distinct value that may be out of form;
    values not returned are in form.  The words come from all in-form values of ``vocabulary``
    (same column; *values* by default), counted over all rows.  A column ``in_form``, where there is
    one, tells whether a value matches ``PLAIN``.  ``n_spelled`` counts the odd tokens that a trie spells.

    Nulls and empty texts are in form.  Texts of any length are taken whole.
    """
    ok = lambda df: F.col("in_form") if "in_form" in df.columns else F.col("value").rlike(PLAIN)
    odd = settle(values.where(~ok(values)).select("value").distinct())
    found = settle(odd.mapInPandas(_prepare, "value string, token string, skeleton string"))
    tokens = settle(found.select("token", "skeleton").distinct())
    buckets = max(1, -(-tokens.count() // PER_TRIE))
    vocabulary = values if vocabulary is None else vocabulary
    good = vocabulary.where(ok(vocabulary))
    words = good.select(F.explode(F.split("value", " ")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    same = "".join(CLASSES), "".join(CLASSES.values())
    words = words.withColumn("skeleton", F.translate("word", *same)).join(tokens.select("skeleton").distinct(), "skeleton", "left_semi")
    bucket = F.pmod(F.xxhash64("skeleton"), F.lit(buckets)).alias("bucket")
    spelled = words.select("word", "n", bucket).groupBy("bucket").cogroup(tokens.select("token", bucket).groupBy("bucket")).applyInPandas(_match, "token string, spelling string")
    per_value = found.join(spelled, "token").groupBy("value").agg(F.collect_list("token").alias("tokens"), F.collect_list("spelling").alias("spellings"))
    return odd.join(per_value, "value", "left").mapInPandas(_finish, "value string, form string, n_spelled int")


def out_of_form(tables: list[tuple[str, DataFrame, str, list[str]]], vocabulary: list[str] | None = None) -> DataFrame:
    """``(tbl, row_key, field, value, form, n_spelled)`` of every value that is not in the one form.

    ``tables`` holds (name, table, key column, text columns).  A row that occurs twice with the
    same key counts once; rows without a key give a null key.  ``vocabulary`` names the columns
    whose words are counted (all by default).
    """
    long = None
    words = None
    for name, df, key, fields in tables:
        cells = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
        part = df.select(F.lit(name).alias("tbl"), F.col(key).cast("string").alias("row_key"), cells).where("value is not null")
        long = part if long is None else long.union(part)
    words = long if vocabulary is None else long.where(F.col("field").isin(vocabulary))
    odd = settle(long.where(~F.col("value").rlike(PLAIN)).distinct())
    got = settle(forms(odd.select("value"), words.select("value")).where("form <> value"))
    return odd.join(got, "value").select("tbl", "row_key", "field", "value", "form", "n_spelled")


def canonical(df: DataFrame, columns: list[str]) -> DataFrame:
    """*df* with each of *columns* in the one form.  Only rows with an odd value are joined."""
    for c in columns:
        odd = F.col(c).isNotNull() & ~F.col(c).rlike(PLAIN)
        got = forms(df.select(F.col(c).cast("string").alias("value")).where("value is not null")).select(F.col("value").alias("__value"), F.col("form").alias("__form"))
        turned = df.where(odd).join(got, F.col(c) == F.col("__value"), "left").withColumn(c, F.coalesce("__form", c)).drop("__value", "__form")
        df = df.where(~odd | F.col(c).isNull()).unionByName(turned)
    return df
