"""Queries on instances and feats: audits, strata, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrain.functions import geometry, glyphs, registry, text
from inkgrain.operators import audit, score
from inkgrain.plans.common import CLASS, FEATS, INSTANCES, VOCAB, feats, instances, table

SPACE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def split_audit(spark: SparkSession, d: str) -> DataFrame:
    """Kept, hash and empty records, characters and words of each split and in all."""
    return audit.split_audit(instances(spark, d, "split", "text"), "split", "text")


def charset_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Every character of the transcripts."""
    return audit.charset(instances(spark, d, "raw_text"), "raw_text")


def vocab_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Characters outside the vocabulary, per split."""
    return audit.vocab_coverage(instances(spark, d, "scorable", "split", "text").where("scorable"), "split", "text", VOCAB)


def oov_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """The characters outside the vocabulary."""
    vocab = spark.createDataFrame([(c,) for c in VOCAB], "ch string")
    return audit.oov_inventory(instances(spark, d, "text"), "text", vocab)


def label_integrity(spark: SparkSession, d: str) -> DataFrame:
    """F16: labels that are not composed or not within the vocabulary."""
    return audit.label_integrity(instances(spark, d, "text"), "text", VOCAB)


def normal_states(spark: SparkSession, d: str) -> DataFrame:
    """normal form of the raw transcripts, per split."""
    rows = instances(spark, d, "raw_text", "split").where("raw_text is not null").select("split", text.normal_state(F.col("raw_text")).alias("state"))
    return rows.groupBy("split", "state").agg(F.count("*").alias("n"))


def dont_care_forms(spark: SparkSession, d: str) -> DataFrame:
    """The five most frequent transcripts of records that are not scorable."""
    g = instances(spark, d, "scorable", "raw_text").where("not scorable").groupBy("raw_text").agg(F.count("*").alias("n"))
    return g.orderBy(F.col("n").desc(), "raw_text").limit(5)


def bad_polys(spark: SparkSession, d: str) -> DataFrame:
    """Polygons by number of coordinates, and degenerate ones."""
    q = instances(spark, d, "poly").select(F.size("poly").alias("n_coords"), geometry.is_degenerate(geometry.order_quad(F.col("poly"))).alias("thin"))
    return q.groupBy("n_coords").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("thin"), F.lit(False)).cast("long")).alias("n_thin"))


def training_filter(spark: SparkSession, d: str) -> DataFrame:
    """F8: records left after each rule for training crops."""
    i = instances(spark, d, "split", "scorable", "text", "poly")
    ok = [F.col("scorable") & F.col("text").isNotNull(), F.col("text").rlike(text.vocab_pattern(VOCAB)), ~geometry.is_degenerate(geometry.order_quad(F.col("poly")))]
    n = lambda c: F.count_if(c)
    return i.groupBy("split").agg(F.count("*").alias("n"), n(ok[0]).alias("scorable"), n(ok[0] & ok[1]).alias("in_vocab"), n(ok[0] & ok[1] & ok[2]).alias("kept"))


def quad_features(spark: SparkSession, d: str) -> DataFrame:
    """Size, tilt and box of every polygon."""
    q = instances(spark, d, "poly").where("poly is not null").select("pos", "poly", geometry.order_quad(F.col("poly")).alias("q"))
    s = q.select("pos", geometry.quad_size(F.col("q")).alias("s"), F.round(geometry.tilt(F.col("q")), 6).alias("tilt"), geometry.bbox(F.col("poly")).alias("b"))
    return s.select("pos", "s.w", "s.h", "tilt", "b.x0", "b.y0", "b.x1", "b.y1")


def diacritic_counts(spark: SparkSession, d: str) -> DataFrame:
    """Stacked and marked characters, per source."""
    i = instances(spark, d, "scorable", "text", "source").where("scorable and text is not null")
    g = score.glyph_counts(i, "source", "text")
    return g.groupBy("source").agg(F.sum("n_chars").alias("n_chars"), F.sum("n_stacked").alias("n_stacked"), F.sum("n_diacritic").alias("n_diacritic"))


def text_profile(spark: SparkSession, d: str) -> DataFrame:
    """Lengths, case and digits of the texts of each source."""
    return audit.text_profile(instances(spark, d, "scorable", "source", "text").where("scorable"), ["source"], "text")


def percentile_summary(spark: SparkSession, d: str) -> DataFrame:
    """Summary of every measure of each split."""
    s = audit.percentile_summary(feats(spark, d, "split", "height", "contrast", "length", "tilt"), ["split"], ["height", "contrast", "length", "tilt"])
    return s.select("split", "stat", "n", *[F.round(c, 6).alias(c) for c in ("p5", "p25", "p50", "p75", "p95", "min", "max", "mean")])


def coverage_audit(spark: SparkSession, d: str) -> DataFrame:
    """Whether the night pictures reach into the hard tail of all others."""
    f = feats(spark, d, "source", "height", "contrast", "tilt")
    stats = ["height", "contrast", "tilt"]
    real = audit.percentile_summary(f.where("source <> 'night_neon'"), [], stats)
    made = audit.percentile_summary(f.where("source = 'night_neon'"), [], stats)
    return audit.coverage_audit(real, made, ["height", "contrast"], ["tilt"], ["height"])


def strata_bins(spark: SparkSession, d: str) -> DataFrame:
    """Records in every bin."""
    return audit.binned(feats(spark, d, "height", "contrast", "length", "tilt")).groupBy("stratum", "bin", "lo").agg(F.count("*").alias("n"))


def strata_first_match(spark: SparkSession, d: str) -> DataFrame:
    """Records by the first rule that holds."""
    g = score.glyph_counts(instances(spark, d, "text").where("text is not null"), "pos", "text")
    f = feats(spark, d, "split", "height", "contrast").join(g, "pos").select("pos", "split", "height", "contrast", "n_diacritic")
    return audit.first_match_stratum(f).groupBy("split", "stratum").agg(F.count("*").alias("n"))


def hygiene_warnings(spark: SparkSession, d: str) -> DataFrame:
    """labels by the warnings they raise."""
    g = table(spark, d, "gold_sheet").select(text.hygiene(F.col("public_label"), VOCAB).alias("h"))
    return g.select(F.explode("h.warnings").alias("w")).groupBy(F.regexp_extract("w", r"^[^:]*", 0).alias("warning")).agg(F.count("*").alias("n"))


def height_slope(spark: SparkSession, d: str) -> DataFrame:
    """Drift of contrast over the days, per source."""
    f = feats(spark, d, "source", "measured_on", "contrast").where("contrast is not null and not isnan(contrast)").select("source", F.datediff("measured_on", F.lit("2023-01-01").cast("date")).cast("double").alias("day"), "contrast")
    s = audit.end_slope(f, ["source"], "day", "contrast", 0, 10_000)
    return s.select("source", "n", F.round("slope", 9).alias("slope"))


def michelson_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Contrast of each capture campaign, its heights taken for grey values."""
    f = feats(spark, d, "source", "height").where("height is not null")
    q = f.groupBy("source").agg(F.percentile(F.col("height").cast("double"), F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    return q.select("source", F.round(geometry.michelson(F.get("q", F.lit(0)), F.get("q", F.lit(1))), 9).alias("contrast"))


def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The functions by name in SQL: distances and words of all pairs, and the parts of their first letters."""
    registry.register(spark)
    table(spark, d, "predictions").createOrReplaceTempView("ink_pairs")
    return spark.sql("""select tone, count(*) as n, sum(ink_edit_distance(r, h)) as edits, sum(size(ink_words(r))) as words
      from (select ink_nfc(ink_clean(ref)) as r, ink_nfc(ink_clean(coalesce(hyp, ''))) as h, ink_decompose(substr(ink_nfc(ink_clean(ref)), 1, 1)).tone as tone from ink_pairs where ref is not null) group by tone""")


QUERIES = {f.__name__: f for f in (michelson_contrast, sql_functions, split_audit, charset_inventory, vocab_coverage, oov_antijoin, label_integrity, normal_states, dont_care_forms, bad_polys, training_filter, quad_features, diacritic_counts, text_profile, percentile_summary, coverage_audit, strata_bins, strata_first_match, hygiene_warnings, height_slope)}

_NFC = r"nfc_normalize(regexp_replace({c}, '\p{{Cf}}', '', 'g'))"
_T = _NFC.format(c="text")
_TRIM = _NFC.format(c="trim(text, ' ')")
_OOVS = f"length(regexp_replace({_T}, '[{CLASS}]', '', 'g'))"
_KIND = "case when coalesce(trim(text, ' '), '') = '' then 'empty' when trim(text, ' ') = '###' then 'hash' else 'kept' end"
_QUAD = """qp as (select pos, poly, list_transform(range(0, 4), lambda i: {'x': poly[2 * i + 1]::double, 'y': poly[2 * i + 2]::double}) as p from inst where len(poly) = 8),
qc as (select *, (p[1].x + p[2].x + p[3].x + p[4].x) / 4 as cx, (p[1].y + p[2].y + p[3].y + p[4].y) / 4 as cy from qp),
qt as (select pos, poly, list_sort(list_transform(range(1, 5), lambda i: {'a': atan2(p[i].y - cy, p[i].x - cx), 'i': i - 1, 'x': p[i].x, 'y': p[i].y})) as t from qc),
qs as (select pos, poly, t, list_position(list_transform(t, lambda z: z.x + z.y), list_min(list_transform(t, lambda z: z.x + z.y))) as f from qt),
qo as (select pos, poly, list_transform(range(0, 4), lambda i: t[(f - 1 + i) % 4 + 1]) as q from qs),
qz as (select pos, poly, round_even(greatest(sqrt(pow(q[1].x - q[2].x, 2) + pow(q[1].y - q[2].y, 2)), sqrt(pow(q[4].x - q[3].x, 2) + pow(q[4].y - q[3].y, 2))), 0)::int as w,
 round_even(greatest(sqrt(pow(q[1].x - q[4].x, 2) + pow(q[1].y - q[4].y, 2)), sqrt(pow(q[2].x - q[3].x, 2) + pow(q[2].y - q[3].y, 2))), 0)::int as h, abs(degrees(atan2(q[2].y - q[1].y, q[2].x - q[1].x))) as tl from qo)"""
_LONG = "lg as (" + " union all ".join(f"select split, source, '{m}' as stat, {m}::double as v from ft where {m} is not null and not isnan({m}::double)" for m in ("height", "contrast", "length", "tilt")) + ")"
_Q = "quantile_cont(v, 0.05) as p5, quantile_cont(v, 0.25) as p25, quantile_cont(v, 0.5) as p50, quantile_cont(v, 0.75) as p75, quantile_cont(v, 0.95) as p95"


def _classes(pick) -> str:
    from inkgrain.functions.glyphs import letters

    return letters(pick)


_BOTH, _ANY = _classes(lambda r: r[2] != "none" and r[3] != "ngang"), _classes(lambda r: r[2] != "none" or r[3] != "ngang")
_HAVE = lambda cs: f"(length({_T}) - length(regexp_replace({_T}, '[{cs}]', '', 'g')))"


def _bins() -> str:
    return " union all ".join(f"select '{s}' as stratum, {i} as bin, {float(a)}::double as lo, count(*) as n from ft where {s} >= {a} and {s} < {b} and not isnan({s}::double) having count(*) > 0" for s, e in audit.BINS.items() for i, (a, b) in enumerate(zip(e, e[1:])))


SQL = {
    "michelson_contrast": f"with {FEATS}, a as (select source, quantile_cont(height::double, 0.05) as lo, quantile_cont(height::double, 0.95) as hi from ft where height is not null group by 1) select source, round((hi - lo) / (hi + lo + 1e-6), 9) as contrast from a",
    "hygiene_warnings": f"with c as (select public_label as p, regexp_replace(public_label, '\\p{{Cf}}', '', 'g') as c, nfc_normalize(regexp_replace(public_label, '\\p{{Cf}}', '', 'g')) as n from gold_sheet), w as (select 'stripped invisible' as warning from c where c <> p union all select 'composed' from c where n <> c union all select 'stripped ends' from c where trim(n, ' ') <> n union all select 'out of vocabulary' from c where regexp_matches(trim(n, ' '), '[^{CLASS}]')) select warning, count(*) as n from w group by 1",
    "split_audit": f"with {INSTANCES}, k as (select split, {_KIND} as kind, {_TRIM} as t from inst), s as (select split, count(*) as total, count(*) filter (kind = 'kept') as kept, count(*) filter (kind = 'hash') as hash, count(*) filter (kind = 'empty') as empty, coalesce(sum(length(t)) filter (kind = 'kept'), 0)::bigint as chars, coalesce(sum(len(list_filter(regexp_split_to_array(t, '{SPACE}'), lambda w: w <> ''))) filter (kind = 'kept'), 0)::bigint as words from k group by split) select * from s union all select 'ALL', sum(total)::bigint, sum(kept)::bigint, sum(hash)::bigint, sum(empty)::bigint, sum(chars)::bigint, sum(words)::bigint from s",
    "charset_inventory": rf"with {INSTANCES}, c as (select substr(raw_text, i, 1) as ch from inst, unnest(range(1, length(raw_text) + 1)) as t(i)) select ch, count(*) as n, unicode(ch) < 128 as is_ascii, regexp_matches(ch, '^\p{{M}}$') as is_mark from c group by ch",
    "vocab_coverage": f"with {INSTANCES}, a as (select split, length({_T}) as c, {_OOVS} as o from inst where scorable and text is not null) select split, count(*) as n, sum(c)::bigint as chars, sum(o)::bigint as oov, count(*) filter (o > 0) as n_with_oov, round(sum(o) * 100.0::double / sum(c), 4) as oov_pct from a group by split",
    "oov_antijoin": f"with {INSTANCES}, a as (select regexp_replace({_T}, '[{CLASS}]', '', 'g') as o from inst), c as (select substr(o, i, 1) as ch from a, unnest(range(1, length(o) + 1)) as t(i)) select ch, count(*) as n from c group by ch",
    "label_integrity": f"with {INSTANCES} select count(*) as n, count(*) filter ({_T} <> text) as not_composed, count(*) filter (not regexp_full_match(text, '[{CLASS}]*')) as out_of_vocab from inst where text is not null",
    "dont_care_forms": f"with {INSTANCES} select raw_text, count(*) as n from inst where not scorable group by 1 order by n desc, raw_text nulls first limit 5",
    "bad_polys": f"with {INSTANCES}, {_QUAD} select len(poly) as n_coords, count(*) as n, count(*) filter (w < 4 or h < 4) as n_thin from inst left join (select pos, w, h from qz) using (pos) group by 1",
    "training_filter": f"with {INSTANCES}, {_QUAD}, a as (select split, scorable and text is not null as k, regexp_full_match(text, '[{CLASS}]*') as v, not (w < 4 or h < 4) as f from inst left join (select pos, w, h from qz) using (pos)) select split, count(*) as n, count(*) filter (k) as scorable, count(*) filter (k and v) as in_vocab, count(*) filter (k and v and f) as kept from a group by 1",
    "quad_features": f"with {INSTANCES}, {_QUAD} select pos, w, h, round(least(tl, 180 - tl), 6) as tilt, list_min([poly[1], poly[3], poly[5], poly[7]]) as x0, list_min([poly[2], poly[4], poly[6], poly[8]]) as y0, list_max([poly[1], poly[3], poly[5], poly[7]]) as x1, list_max([poly[2], poly[4], poly[6], poly[8]]) as y1 from qz",
    "diacritic_counts": f"with {INSTANCES} select source, sum(length({_T}))::bigint as n_chars, sum({_HAVE(_BOTH)})::bigint as n_stacked, sum({_HAVE(_ANY)})::bigint as n_diacritic from inst where scorable and text is not null group by 1",
    "text_profile": rf"with {INSTANCES} select source, count(*) as n, round(avg(len(list_filter(regexp_split_to_array(text, '{SPACE}'), lambda w: w <> ''))), 9) as mean_tokens, round(avg((upper(text) = text and lower(text) <> text)::int), 9) as upper, round(avg((regexp_matches(text, '\p{{Lu}}') and not regexp_matches(text, '(^|[^\p{{L}}])\p{{Ll}}|\p{{L}}\p{{Lu}}'))::int), 9) as title, round(avg((lower(text) <> upper(text))::int), 9) as has_letter, round(avg(regexp_matches(text, '\p{{Ll}}')::int), 9) as has_lower, round(avg(regexp_matches(text, '[0-9]')::int), 9) as has_digit, round(avg((length(text) = 1)::int), 9) as one_char, quantile_cont(length(text), 0.5) as median_len, quantile_cont(length(text), 0.9) as p90_len from inst where scorable and text is not null and text <> '' group by 1",
    "percentile_summary": f"with {FEATS}, {_LONG}, a as (select split, stat, count(*) as n, {_Q}, min(v) as min, max(v) as max, avg(v) as mean from lg group by 1, 2) select split, stat, n, " + ", ".join(f"round({c}, 6) as {c}" for c in ("p5", "p25", "p50", "p75", "p95", "min", "max", "mean")) + " from a",
    "coverage_audit": f"""with {FEATS}, {_LONG}, r as (select stat, {_Q} from lg where source <> 'night_neon' and stat <> 'length' group by 1), s as (select stat, {_Q} from lg where source = 'night_neon' and stat <> 'length' group by 1),
 j as (select stat, r.p5 as p5_r, r.p25 as p25_r, r.p50 as p50_r, r.p75 as p75_r, r.p95 as p95_r, s.p5 as p5_s, s.p50 as p50_s, s.p95 as p95_s, case stat when 'height' then log10(greatest(s.p50, 0.001)) - log10(greatest(r.p50, 0.001)) else s.p50 - r.p50 end as shift, case stat when 'height' then log10(greatest(r.p75, 0.001)) - log10(greatest(r.p25, 0.001)) else r.p75 - r.p25 end as iqr from r join s using (stat)),
 k as (select stat, case stat when 'tilt' then p95_s >= 0.90 * p95_r else p5_s <= 1.20 * p5_r end as reach, abs(shift) <= 1.25 * greatest(iqr, 1e-6) as centre, case stat when 'tilt' then p50_s < 0.70 * p50_r when 'height' then shift > 0.15 and p50_s > 1.20 * p50_r else shift > 0 and p50_s > 1.20 * p50_r end as cleaner from j)
 select *, reach and centre and not cleaner as passes from k""",
    "strata_bins": f"with {FEATS} {_bins()}",
    "strata_first_match": f"with {INSTANCES}, {FEATS}, g as (select pos, {_HAVE(_ANY)} as nd from inst where text is not null), f as (select ft.pos, ft.split, height, contrast, nd from ft join g using (pos)), q as (select floor(quantile_cont(height, 0.25) filter (height > 0)) as sp, quantile_cont(contrast, 0.25) filter (not isnan(contrast)) as lc from f) select split, case when nd >= 4 then 'dense' when height > 0 and height <= sp then 'small' when round(contrast, 4) <= lc and not isnan(contrast) then 'low_contrast' else 'plain' end as stratum, count(*) as n from f, q group by 1, 2",
    "height_slope": f"with {FEATS} select source, count(*) as n, round(regr_slope(contrast, date_diff('day', date '2023-01-01', measured_on)::double), 9) as slope from ft where contrast is not null and not isnan(contrast) group by 1",
}
