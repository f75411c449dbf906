"""Edit alignment (T5, T6): distances natively, operations natively where they are forced."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from inkgrain.functions.text import chars, word_list


def trace(a, b) -> list[tuple[str, str | None, str | None]]:
    """The operations of a least-cost alignment of two sequences.  Read from the end, a match or
    substitution goes before a deletion, a deletion before an insertion."""
    n, m = len(a), len(b)
    d = [list(range(m + 1))]
    for i in range(1, n + 1):
        up, row, x = d[-1], [i], a[i - 1]
        for j in range(1, m + 1):
            row.append(min(up[j - 1] + (x != b[j - 1]), up[j] + 1, row[-1] + 1))
        d.append(row)
    i, j, out = n, m, []
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append(("eq" if a[i] == b[j] else "sub", a[i], b[j]))
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
            out.append(("del", a[i], None))
        else:
            j -= 1
            out.append(("ins", None, b[j]))
    return out[::-1]


_CODES = {"eq": "=", "sub": "s", "del": "d", "ins": "i"}


@F.pandas_udf(ArrayType(StringType()))
def traced(r: pd.Series, h: pd.Series) -> pd.Series:
    """The operations of each pair, three characters each: the operation and both sides, a null character
    for an absent one.  Plain strings are far cheaper to hand over than nested rows."""
    return pd.Series([None if x is None or y is None else [_CODES[o] + (p or "\0") + (q or "\0") for o, p, q in trace(x, y)] for x, y in zip(r, h)], dtype=object)


def read_ops(codes: Column) -> Column:
    """``array<struct<op, r, h>>`` of what ``traced`` gives."""
    side = lambda x, k: F.nullif(F.substring(x, k, 1), F.lit("\0"))
    op = lambda x: F.element_at(F.create_map(*[F.lit(z) for k, v in _CODES.items() for z in (v, k)]), F.substring(x, 1, 1))
    return F.transform(codes, lambda x: F.struct(op(x).alias("op"), side(x, 2).alias("r"), side(x, 3).alias("h")))


def placewise(ref: Column, hyp: Column) -> Column:
    """The alignment place by place, right where ``forced`` holds."""
    return F.zip_with(chars(ref), chars(hyp), lambda x, y: F.struct(F.when(x == y, "eq").otherwise("sub").alias("op"), x.alias("r"), y.alias("h")))


def forced(ref: Column, hyp: Column) -> Column:
    """Whether only a place by place alignment costs least: the same, or as long and as many places apart as
    their distance."""
    apart = F.size(F.filter(F.zip_with(chars(ref), chars(hyp), lambda x, y: x != y), lambda z: z))
    return F.when(ref == hyp, True).when(F.length(ref) != F.length(hyp), False).otherwise(F.levenshtein(ref, hyp) == apart)


def edit_distance(ref: Column, hyp: Column) -> Column:
    """Unit-cost edit distance in code points."""
    return F.levenshtein(ref, hyp)


def align_ops(ref: Column, hyp: Column) -> Column:
    """``array<struct<op, r, h>>`` with op eq, sub, del or ins (T5).

    Forced alignments are built natively; the rest goes to Python in Arrow batches.  (Over tables,
    ``score.aligned`` sends each distinct pair that needs it only once.)
    """
    easy = forced(ref, hyp)
    return F.when(easy, placewise(ref, hyp)).otherwise(read_ops(traced(F.when(~easy, ref), F.when(~easy, hyp))))


def word_distance(ref: Column, hyp: Column) -> Column:
    """Edit distance in words (T6): each word of a pair becomes one character, and the distance of the
    strings is native.  A pair may hold a million different words."""
    a, b = word_list(ref), word_list(hyp)
    known = F.array_distinct(F.concat(a, b))
    one = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 0xFFFF), 8, "0")), "UTF-32")
    coded = lambda ws: F.array_join(F.transform(ws, one), "")
    return F.when(ref == hyp, F.lit(0)).otherwise(F.levenshtein(coded(a), coded(b)))
