"""Scores of recognised text and what its errors are made of.

Each distinct pair of a group is aligned once.  Every measure is a weighted sum over the kinds of aligned
characters of a group (operation, reference, prediction), a small table that the glyphs are joined to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrain.functions import glyphs
from inkgrain.functions.align import forced, placewise, read_ops, traced, word_distance
from inkgrain.functions.text import STABLE, chars, clean, nfc, word_list
from inkgrain.session import settle


def normal_pairs(pairs: DataFrame) -> DataFrame:
    """``ref`` and ``hyp`` cleaned and composed; a missing prediction is an empty one (F7).  Only pairs that
    are not composed by their ranges reach Python."""
    pairs = pairs.withColumns({c: clean(F.coalesce(c, F.lit(""))) for c in ("ref", "hyp")})
    ok = F.col("ref").rlike(STABLE) & F.col("hyp").rlike(STABLE)
    return pairs.where(ok).unionByName(pairs.where(~ok).withColumns({"ref": nfc(F.col("ref")), "hyp": nfc(F.col("hyp"))}))


def aligned(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, ref, hyp, w, ops)``: each distinct pair of a group once, with the number of its rows and its
    alignment.  Python sees only pairs whose alignment is not forced."""
    each = normal_pairs(pairs).groupBy(*keys, "ref", "hyp").agg(F.count("*").alias("w"))
    each = settle(each.withColumn("_easy", forced(F.col("ref"), F.col("hyp"))))
    easy = each.where("_easy").withColumn("ops", placewise(F.col("ref"), F.col("hyp")))
    hard = each.where("not _easy").withColumn("ops", read_ops(traced(F.col("ref"), F.col("hyp"))))
    return easy.unionByName(hard).drop("_easy")


def _glyph(rows: DataFrame, side: str) -> DataFrame:
    """Join the parts of the character in column *side*; other characters are their own base."""
    g = glyphs.table(rows.sparkSession).withColumnsRenamed({c: f"{side}_{c}" for c in ("ch", "base", "modifier", "tone", "is_letter", "bears_mod", "bears_tone")})
    out = rows.join(F.broadcast(g), F.col(side) == F.col(f"{side}_ch"), "left").drop(f"{side}_ch")
    low = F.lower(F.col(side))
    fill = {"base": F.col(side), "modifier": F.lit("none"), "tone": F.lit("ngang"), "is_letter": F.col(side).rlike(r"^\p{L}"), "bears_mod": low.isin(*glyphs.BEARS_MODIFIER), "bears_tone": low.isin(*glyphs.BEARS_TONE)}
    return out.withColumns({f"{side}_{k}": F.when(F.col(side).isNotNull(), F.coalesce(f"{side}_{k}", v)) for k, v in fill.items()})


def op_table(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Aligned pairs -> ``(*keys, op, r, h, w)`` with the glyph parts of both sides: each kind of aligned
    character once, with how often it occurs."""
    ops = rows.select(*keys, "w", F.explode("ops").alias("o")).groupBy(*keys, "o.op", "o.r", "o.h").agg(F.sum("w").alias("w"))
    return _glyph(_glyph(ops, "r"), "h")


def op_rows(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``op_table`` of pairs."""
    return op_table(aligned(pairs, keys), keys)


def _n(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("w"))), F.lit(0))


def axis_counts(ops: DataFrame, by: list[str]) -> DataFrame:
    """Counts of each axis (A2): a deleted character counts on every axis it bears, an inserted one
    on none."""
    kept = F.col("op").isin("eq", "sub")
    there = F.col("op") != "ins"
    return ops.groupBy(*by).agg(
        _n(F.col("op") != "eq").alias("char_edits"), _n(there).alias("char_ref"), _n(F.col("op") == "sub").alias("n_sub"), _n(F.col("op") == "del").alias("n_del"), _n(F.col("op") == "ins").alias("n_ins"),
        _n(there & F.col("r_is_letter")).alias("base_n"), _n(kept & F.col("r_is_letter") & (F.col("r_base") == F.col("h_base"))).alias("base_ok"), _n(kept & F.col("r_is_letter") & (F.lower("r_base") == F.lower("h_base"))).alias("base_ok_ci"),
        _n(there & F.col("r_bears_mod")).alias("mod_n"), _n(kept & F.col("r_bears_mod") & (F.col("r_modifier") == F.col("h_modifier"))).alias("mod_ok"),
        _n(there & F.col("r_bears_tone")).alias("tone_n"), _n(kept & F.col("r_bears_tone") & (F.col("r_tone") == F.col("h_tone"))).alias("tone_ok"),
    )


def pair_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Pairs, exact hits and word counts of each group of aligned pairs."""
    ref, hyp, w = F.col("ref"), F.col("hyp"), F.col("w")
    return rows.groupBy(*by).agg(F.sum(w).alias("n"), _n(ref == hyp).alias("n_exact"), F.sum(word_distance(ref, hyp) * w).alias("word_edits"), F.sum(F.size(word_list(ref)) * w).alias("word_ref"))


RATES = {"cer": ("char_edits", "char_ref"), "wer": ("word_edits", "word_ref"), "exact": ("n_exact", "n"), "base_acc": ("base_ok", "base_n"), "base_acc_ci": ("base_ok_ci", "base_n"), "mod_acc": ("mod_ok", "mod_n"), "tone_acc": ("tone_ok", "tone_n")}


def with_rates(counts: DataFrame) -> DataFrame:
    """Ratios of sums, null where the denominator is 0."""
    return counts.select("*", *[F.round(F.try_divide(F.col(a), F.col(b)), 9).alias(k) for k, (a, b) in RATES.items() if a in counts.columns and b in counts.columns])


def score(pairs: DataFrame, by: list[str]) -> DataFrame:
    """All counts and rates of each group of pairs (A1).  A group of empty references only has
    null character rates."""
    rows = settle(aligned(pairs, by))
    whole = pair_counts(rows, by)
    chars_ = axis_counts(op_table(rows, by), by).withColumnsRenamed({k: f"_{k}" for k in by})
    on = F.lit(True)
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = whole.join(chars_, on, "left").drop(*[f"_{k}" for k in by])
    return with_rates(joined.fillna(0, [c for c in chars_.columns if c in joined.columns]))


def confusion(ops: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, axis, ref, hyp, n)`` with ``<del>`` for a deleted character (A3)."""
    gone = F.lit("<del>")

    def cell(axis: str, bears: str, part: str) -> Column:
        return F.when(F.col(f"r_{bears}"), F.struct(F.lit(axis).alias("axis"), F.col(f"r_{part}").alias("ref"), F.when(F.col("op") == "del", gone).otherwise(F.col(f"h_{part}")).alias("hyp")))

    cells = F.array(cell("base", "is_letter", "base"), cell("modifier", "bears_mod", "modifier"), cell("tone", "bears_tone", "tone"))
    rows = ops.where("op <> 'ins'").select(*by, "w", F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("c")).select(*by, "w", "c.*")
    return rows.groupBy(*by, "axis", "ref", "hyp").agg(F.sum("w").alias("n"))


def top_confusions(cells: DataFrame, by: list[str], k: int = 12) -> DataFrame:
    """The *k* most frequent unequal cells of each axis (A4); ties by reference, then prediction."""
    w = Window.partitionBy(*by, "axis").orderBy(F.col("n").desc(), "ref", "hyp")
    return cells.where("ref <> hyp").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tone_failures(cells: DataFrame, by: list[str]) -> DataFrame:
    """Tone errors as dropped, spurious or taken for another; deletions are left out."""
    kind = F.when(F.col("hyp") == "ngang", "drop").when(F.col("ref") == "ngang", "spurious").otherwise("discrimination")
    return cells.where("axis = 'tone' and ref <> hyp and hyp <> '<del>'").groupBy(*by, kind.alias("kind")).agg(F.sum("n").alias("n"))


def sub_flags() -> dict[str, Column]:
    """What differs in a substitution."""
    base = F.col("r_base") != F.col("h_base")
    base_ci = F.lower("r_base") != F.lower("h_base")
    mod = F.col("r_modifier") != F.col("h_modifier")
    tone = F.col("r_tone") != F.col("h_tone")
    return {"base_diff": base, "base_diff_ci": base_ci, "mod_diff": mod, "tone_diff": tone, "case_only": base & ~base_ci & ~mod & ~tone}


def edit_class() -> Column:
    """The one class of an edit (T8): what the substitution changes, or the deletion or insertion."""
    f = sub_flags()
    nd = f["base_diff_ci"].cast("int") + f["mod_diff"].cast("int") + f["tone_diff"].cast("int")
    sub = F.when(nd == 0, "pure_case").when(nd >= 2, "mixed").when(f["tone_diff"], "pure_tone").when(f["mod_diff"], "pure_modifier").otherwise("pure_base")
    return F.when(F.col("op") == "sub", sub).otherwise(F.col("op"))


def error_mix(ops: DataFrame, by: list[str]) -> DataFrame:
    """Edits by class with their share of all edits of the group."""
    n = ops.where("op <> 'eq'").groupBy(*by, edit_class().alias("kind")).agg(F.sum("w").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*by)), 9))


def involvement(ops: DataFrame, by: list[str]) -> DataFrame:
    """Edits that involve each axis (overlapping), and those of marks alone or base alone."""
    f = sub_flags()
    sub = F.col("op") == "sub"
    marks = f["mod_diff"] | f["tone_diff"]
    e = ops.where("op <> 'eq'").groupBy(*by).agg(
        F.sum("w").alias("edits"), _n(sub & f["base_diff_ci"]).alias("any_base"), _n(sub & f["mod_diff"]).alias("any_modifier"), _n(sub & f["tone_diff"]).alias("any_tone"), _n(sub & f["case_only"]).alias("case_only"),
        _n(sub & f["base_diff_ci"] & ~marks).alias("base_only"), _n(sub & marks & ~f["base_diff_ci"]).alias("diacritic_only"),
    )
    return e.withColumn("base_only_share", F.round(F.col("base_only") / F.col("edits"), 9)).withColumn("diacritic_only_share", F.round(F.col("diacritic_only") / F.col("edits"), 9))


def per_hundred(ops: DataFrame, by: list[str]) -> DataFrame:
    """Substitutions, deletions and insertions per 100 reference characters."""
    c = axis_counts(ops, by)
    return c.select(*by, "char_ref", *[F.round(F.try_divide(F.col(k) * 100.0, F.col("char_ref")), 9).alias(f"{k}_per_100") for k in ("n_sub", "n_del", "n_ins")])


def class_errors(ops: DataFrame, by: list[str]) -> DataFrame:
    """Error rate of each tone and modifier class over the positions that bear it."""
    rows = ops.where("op <> 'ins'").select(*by, "w", F.explode(F.array(F.when(F.col("r_bears_tone"), F.struct(F.lit("tone").alias("axis"), F.col("r_tone").alias("cls"), ((F.col("op") == "del") | (F.col("r_tone") != F.col("h_tone"))).alias("bad"))), F.when(F.col("r_bears_mod"), F.struct(F.lit("modifier").alias("axis"), F.col("r_modifier").alias("cls"), ((F.col("op") == "del") | (F.col("r_modifier") != F.col("h_modifier"))).alias("bad"))))).alias("x")).where("x is not null")
    return rows.groupBy(*by, "x.axis", "x.cls").agg(F.sum("w").alias("positions"), _n(F.col("x.bad")).alias("errors")).withColumn("rate", F.round(F.col("errors") / F.col("positions"), 9))


def glyph_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, n_chars, n_stacked, n_diacritic)`` (T9): characters with a shape and a tone, and with
    either.  Counted by pattern, without exploding."""
    both = glyphs.letters(lambda r: r[2] != "none" and r[3] != "ngang")
    any_ = glyphs.letters(lambda r: r[2] != "none" or r[3] != "ngang")
    t = nfc(F.col(text))
    count = lambda cs: F.size(F.filter(chars(t), lambda x: x.rlike(f"[{cs}]")))
    return rows.select(key, F.length(t).alias("n_chars"), count(both).alias("n_stacked"), count(any_).alias("n_diacritic"))
