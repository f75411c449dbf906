"""Queries on predictions: scores, confusions, error mixes, seed statistics, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrain.functions import glyphs
from inkgrain.operators import audit, score, seedstats
from inkgrain.plans.common import FEATS, INSTANCES, feats, instances, table

RUN = ["run", "seed"]
METRICS = ["cer", "wer", "exact", "base_acc", "base_acc_ci", "mod_acc", "tone_acc"]


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions")


def score_by_seed(spark: SparkSession, d: str) -> DataFrame:
    """All scores of every run and seed."""
    return score.score(_pairs(spark, d), RUN)


def _by_source(spark: SparkSession, d: str) -> DataFrame:
    src = instances(spark, d, "source").select("pos", "source")
    return _pairs(spark, d).join(src, "pos")


def score_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Scores of every run and source."""
    return score.score(_by_source(spark, d), ["run", "source"])


def _ops(spark: SparkSession, d: str) -> DataFrame:
    return score.op_rows(_pairs(spark, d), RUN)


def axis_confusion(spark: SparkSession, d: str) -> DataFrame:
    """A3: confusion cells of each axis."""
    return score.confusion(_ops(spark, d), RUN)


def axis_confusion_topk(spark: SparkSession, d: str) -> DataFrame:
    """A4: the twelve most frequent confusions of each axis."""
    return score.top_confusions(score.confusion(_ops(spark, d), RUN), RUN)


def error_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Cells that differ, the base axis without case."""
    cells = score.confusion(_ops(spark, d), RUN).where("hyp <> '<del>'")
    low = lambda c: F.when(F.col("axis") == "base", F.lower(c)).otherwise(F.col(c)).alias(c)
    return cells.select(*RUN, "axis", low("ref"), low("hyp"), "n").where("ref <> hyp").groupBy(*RUN, "axis", "ref", "hyp").agg(F.sum("n").alias("n"))


def tone_failures(spark: SparkSession, d: str) -> DataFrame:
    """Tone errors by mechanism."""
    return score.tone_failures(score.confusion(_ops(spark, d), RUN), RUN)


def error_mix(spark: SparkSession, d: str) -> DataFrame:
    """Edits by class."""
    return score.error_mix(_ops(spark, d), RUN)


def error_mix_median(spark: SparkSession, d: str) -> DataFrame:
    """The share of each class, median and range over seeds."""
    m = score.error_mix(_ops(spark, d), RUN)
    return m.groupBy("run", "kind").agg(F.round(F.median("share"), 9).alias("median"), F.min("share").alias("low"), F.max("share").alias("high"))


def involvement(spark: SparkSession, d: str) -> DataFrame:
    """Edits that involve each axis."""
    return score.involvement(_ops(spark, d), RUN)


def per_hundred(spark: SparkSession, d: str) -> DataFrame:
    """Edits per 100 reference characters."""
    return score.per_hundred(_ops(spark, d), RUN)


def class_errors(spark: SparkSession, d: str) -> DataFrame:
    """Error rate of each tone and modifier."""
    return score.class_errors(_ops(spark, d), RUN)


def _pair_rows(spark: SparkSession, d: str) -> DataFrame:
    return score.axis_counts(score.op_rows(_pairs(spark, d), [*RUN, "pos"]), [*RUN, "pos"])


def stratified_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Medians over seeds in every bin of height, contrast, length and tilt."""
    return audit.stratified(_pair_rows(spark, d), feats(spark, d, "height", "contrast", "length", "tilt"))


def _values(spark: SparkSession, d: str) -> DataFrame:
    return seedstats.unpivot_rates(score.score(_pairs(spark, d), RUN), RUN, METRICS)


def seed_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics over seeds with t intervals."""
    s = seedstats.seed_stats(_values(spark, d), ["run", "metric"])
    return s.select("run", "metric", "k", F.concat_ws(";", F.transform("seeds", lambda x: F.format_string("%.4f", x))).alias("seeds"), *[F.round(c, 6).alias(c) for c in ("median", "mean", "std", "range", "ci95_half")])


def source_seed_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per source statistics with normal intervals."""
    v = seedstats.unpivot_rates(score.score(_by_source(spark, d), ["source", "seed"]), ["source", "seed"], ["cer", "tone_acc"])
    s = seedstats.seed_stats(v, ["source", "metric"], method="z")
    return s.select("source", "metric", "k", *[F.round(c, 6).alias(c) for c in ("median", "mean", "range", "ci95_half")])


def denominators(spark: SparkSession, d: str) -> DataFrame:
    """The references of all seeds of a run must be as many and as long."""
    c = _pairs(spark, d).groupBy(*RUN).agg(F.count("*").alias("n"), F.sum(F.length("ref")).alias("chars"))
    return c.groupBy("run").agg(F.count_distinct("n").alias("n_kinds"), F.count_distinct("chars").alias("chars_kinds"), (F.count_distinct("n", "chars") == 1).alias("same"))


def truncation_diag(spark: SparkSession, d: str) -> DataFrame:
    """How often long texts are cut short."""
    p = _pairs(spark, d).withColumn("hyp", F.coalesce("hyp", F.lit("")))
    return audit.truncation(p, ["run", "seed"])


def length_ratio_hist(spark: SparkSession, d: str) -> DataFrame:
    """Predicted over reference length."""
    p = _pairs(spark, d).withColumn("hyp", F.coalesce("hyp", F.lit("")))
    return audit.ratio_histogram(p, ["run", "seed"], F.try_divide(F.length("hyp").cast("double"), F.length("ref").cast("double")))


def length_curve(spark: SparkSession, d: str) -> DataFrame:
    """Mean predicted length by reference length."""
    p = _pairs(spark, d).withColumn("hyp", F.coalesce("hyp", F.lit("")))
    return audit.length_curve(p, ["run"])


QUERIES = {f.__name__: f for f in (score_by_seed, score_by_source, axis_confusion, axis_confusion_topk, error_confusion, tone_failures, error_mix, error_mix_median, involvement, per_hundred, class_errors, stratified_metrics, seed_stats, source_seed_stats, denominators, truncation_diag, length_ratio_hist, length_curve)}

# The alignment in SQL: the whole cost table of every unequal pair, row by row, then the way back
# from its end (match or substitution, then deletion, then insertion).
_OPS = rf"""
p as (select run, seed, pos, nfc_normalize(regexp_replace(coalesce(ref, ''), '\p{{Cf}}', '', 'g')) as r, nfc_normalize(regexp_replace(coalesce(hyp, ''), '\p{{Cf}}', '', 'g')) as h from predictions),
u as (select r, h, [substr(r, i, 1) for i in range(1, length(r) + 1)] as a, [substr(h, i, 1) for i in range(1, length(h) + 1)] as b from (select distinct r, h from p where r <> h)),
dp as (
 select r, h, a, b, 0::bigint as i, [range(0, len(b) + 1)] as d from u
 union all
 select r, h, a, b, i + 1, list_append(d, list_transform(range(0, len(b) + 1), lambda j: j + list_min(list_slice(list_transform(range(0, len(b) + 1), lambda q: case when q = 0 then i + 1 else least(d[i + 1][q + 1] + 1, d[i + 1][q] + (a[i + 1] <> b[q])::bigint) end - q), 1, j + 1))))
 from dp where i < len(a)),
tb as (
 select r, h, a, b, d, i, len(b)::bigint as j, '' as op, null::varchar as x, null::varchar as y from dp where i = len(a)
 union all
 select r, h, a, b, d, case when o in ('m', 'd') then i - 1 else i end, case when o in ('m', 'i') then j - 1 else j end, case o when 'm' then (case when a[i] = b[j] then 'eq' else 'sub' end) when 'd' then 'del' else 'ins' end, case when o <> 'i' then a[i] end, case when o <> 'd' then b[j] end
 from (select *, case when i > 0 and j > 0 and d[i + 1][j + 1] = d[i][j] + (a[i] <> b[j])::bigint then 'm' when i > 0 and d[i + 1][j + 1] = d[i][j + 1] + 1 then 'd' else 'i' end as o from tb where i > 0 or j > 0)),
o as (
 select run, seed, pos, op, x, y from p join tb using (r, h) where op <> ''
 union all
 select run, seed, pos, 'eq', substr(r, i, 1), substr(r, i, 1) from p, unnest(range(1, length(r) + 1)) as t(i) where r = h),
gl(ch, base, modifier, tone, is_letter, bears_mod, bears_tone) as (values {glyphs.values_sql()}),
ops as (select o.*, coalesce(g.base, x) as r_base, coalesce(g.modifier, 'none') as r_modifier, coalesce(g.tone, 'ngang') as r_tone, coalesce(g.is_letter, regexp_matches(x, '^\p{{L}}')) as r_is_letter, coalesce(g.bears_mod, false) as r_bears_mod, coalesce(g.bears_tone, false) as r_bears_tone,
 coalesce(k.base, y) as h_base, coalesce(k.modifier, 'none') as h_modifier, coalesce(k.tone, 'ngang') as h_tone from o left join gl g on x = g.ch left join gl k on y = k.ch)"""
_W = r"""
wu as (select r, h, list_filter(regexp_split_to_array(r, '[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda w: w <> '') as a, list_filter(regexp_split_to_array(h, '[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda w: w <> '') as b from (select distinct r, h from p)),
wd as (
 select r, h, a, b, 0::bigint as i, range(0, len(b) + 1) as row_ from wu
 union all
 select r, h, a, b, i + 1, list_transform(range(0, len(b) + 1), lambda j: j + list_min(list_slice(list_transform(range(0, len(b) + 1), lambda q: case when q = 0 then i + 1 else least(row_[q + 1] + 1, row_[q] + (a[i + 1] <> b[q])::bigint) end - q), 1, j + 1)))
 from wd where i < len(a)),
ww as (select r, h, len(a)::bigint as words, row_[len(b) + 1] as dist from wd where i = len(a))"""
_COUNTS = """count(*) filter (op <> 'eq') as char_edits, count(*) filter (op <> 'ins') as char_ref, count(*) filter (op = 'sub') as n_sub, count(*) filter (op = 'del') as n_del, count(*) filter (op = 'ins') as n_ins,
 count(*) filter (op <> 'ins' and r_is_letter) as base_n, count(*) filter (op in ('eq', 'sub') and r_is_letter and r_base = h_base) as base_ok, count(*) filter (op in ('eq', 'sub') and r_is_letter and lower(r_base) = lower(h_base)) as base_ok_ci,
 count(*) filter (op <> 'ins' and r_bears_mod) as mod_n, count(*) filter (op in ('eq', 'sub') and r_bears_mod and r_modifier = h_modifier) as mod_ok, count(*) filter (op <> 'ins' and r_bears_tone) as tone_n, count(*) filter (op in ('eq', 'sub') and r_bears_tone and r_tone = h_tone) as tone_ok"""
_RATES = ", ".join(f"round({a}::double / nullif({b}, 0), 9) as {k}" for k, (a, b) in score.RATES.items())


def _score_sql(by: str, src: str = "") -> str:
    """Scores by columns of pairs; *src* joins more columns to a relation by ``pos``."""
    on = " and ".join(f"a.{k} is not distinct from c.{k}" for k in by.split(", "))
    return f"s as (select a.*, c.* exclude ({by}) from (select {by}, count(*) as n, count(*) filter (r = h) as n_exact, sum(dist)::bigint as word_edits, sum(words)::bigint as word_ref from p {src} join ww using (r, h) group by {by}) a join (select {by}, {_COUNTS} from ops {src} group by {by}) c on {on}), sc as (select *, {_RATES} from s)"


_CONF = """cf as (select run, seed, axis, ref, hyp, count(*) as n from (
 select run, seed, 'base' as axis, r_base as ref, case when op = 'del' then '<del>' else h_base end as hyp from ops where op <> 'ins' and r_is_letter
 union all select run, seed, 'modifier', r_modifier, case when op = 'del' then '<del>' else h_modifier end from ops where op <> 'ins' and r_bears_mod
 union all select run, seed, 'tone', r_tone, case when op = 'del' then '<del>' else h_tone end from ops where op <> 'ins' and r_bears_tone) group by all)"""
_FLAGS = """fl as (select *, r_base <> h_base as bd, lower(r_base) <> lower(h_base) as bci, r_modifier <> h_modifier as md, r_tone <> h_tone as td from ops where op <> 'eq')"""
_CLASS = "case when op <> 'sub' then op when bci::int + md::int + td::int = 0 then 'pure_case' when bci::int + md::int + td::int >= 2 then 'mixed' when td then 'pure_tone' when md then 'pure_modifier' else 'pure_base' end"
_MIX = f"mx as (select run, seed, kind, count(*) as n, round(count(*)::double / sum(count(*)) over (partition by run, seed), 9) as share from (select run, seed, {_CLASS} as kind from fl) group by 1, 2, 3)"
_VALUES = "vals as (" + " union all ".join(f"select run, seed, '{m}' as metric, {m} * 100.0 as value from sc" for m in METRICS) + ")"
_T = "case k " + " ".join(f"when {i + 2} then {t}" for i, t in enumerate(seedstats.T95)) + " end"
_SRC = f"join (select pos, source from inst) using (pos)"
_TRUE_LEN = "length(coalesce(hyp, ''))"


def _bins_sql() -> str:
    parts = []
    for s, e in audit.BINS.items():
        for i, (a, b) in enumerate(zip(e, e[1:])):
            parts.append(f"select pos, '{s}' as stratum, {i} as bin, {float(a)}::double as lo from ft where {s} >= {a} and {s} < {b} and not isnan({s}::double)")
    return "bn as (" + " union all ".join(parts) + ")"


_R = "with recursive"
_whole = lambda c: f"round(case when count({c}) = count(*) then median({c}) end, 9)"
SQL = {
    "score_by_seed": f"{_R} {_OPS}, {_W}, {_score_sql('run, seed')} select * from sc",
    "sql_functions": f"{_R} {_OPS}, {_W}, e as (select run, seed, pos, count(*) filter (op <> 'eq') as edits from ops group by 1, 2, 3), q as (select p.*, ww.words, coalesce(e.edits, 0) as edits from p join ww using (r, h) left join e using (run, seed, pos)) select coalesce(tone, 'ngang') as tone, count(*) as n, sum(edits)::bigint as edits, sum(words)::bigint as words from q left join gl on substr(r, 1, 1) = ch group by 1",
    "score_by_source": f"{_R} {_OPS}, {_W}, {INSTANCES}, {_score_sql('run, source', _SRC)} select * from sc",
    "axis_confusion": f"{_R} {_OPS}, {_CONF} select * from cf",
    "axis_confusion_topk": f"{_R} {_OPS}, {_CONF} select * from (select *, row_number() over (partition by run, seed, axis order by n desc, ref, hyp) as rank from cf where ref <> hyp) where rank <= 12",
    "error_confusion": f"{_R} {_OPS}, {_CONF} select run, seed, axis, ref, hyp, sum(n)::bigint as n from (select run, seed, axis, case axis when 'base' then lower(ref) else ref end as ref, case axis when 'base' then lower(hyp) else hyp end as hyp, n from cf where hyp <> '<del>') where ref <> hyp group by all",
    "tone_failures": f"{_R} {_OPS}, {_CONF} select run, seed, case when hyp = 'ngang' then 'drop' when ref = 'ngang' then 'spurious' else 'discrimination' end as kind, sum(n)::bigint as n from cf where axis = 'tone' and ref <> hyp and hyp <> '<del>' group by 1, 2, 3",
    "error_mix": f"{_R} {_OPS}, {_FLAGS}, {_MIX} select * from mx",
    "error_mix_median": f"{_R} {_OPS}, {_FLAGS}, {_MIX} select run, kind, round(median(share), 9) as median, min(share) as low, max(share) as high from mx group by 1, 2",
    "involvement": f"{_R} {_OPS}, {_FLAGS}, a as (select run, seed, count(*) as edits, count(*) filter (op = 'sub' and bci) as any_base, count(*) filter (op = 'sub' and md) as any_modifier, count(*) filter (op = 'sub' and td) as any_tone, count(*) filter (op = 'sub' and bd and not bci and not md and not td) as case_only, count(*) filter (op = 'sub' and bci and not (md or td)) as base_only, count(*) filter (op = 'sub' and (md or td) and not bci) as diacritic_only from fl group by 1, 2) select *, round(base_only::double / edits, 9) as base_only_share, round(diacritic_only::double / edits, 9) as diacritic_only_share from a",
    "per_hundred": f"{_R} {_OPS}, a as (select run, seed, {_COUNTS} from ops group by 1, 2) select run, seed, char_ref, round(n_sub * 100.0::double / char_ref, 9) as n_sub_per_100, round(n_del * 100.0::double / char_ref, 9) as n_del_per_100, round(n_ins * 100.0::double / char_ref, 9) as n_ins_per_100 from a",
    "class_errors": f"{_R} {_OPS}, a as (select run, seed, 'tone' as axis, r_tone as cls, op = 'del' or r_tone <> h_tone as bad from ops where op <> 'ins' and r_bears_tone union all select run, seed, 'modifier', r_modifier, op = 'del' or r_modifier <> h_modifier from ops where op <> 'ins' and r_bears_mod) select run, seed, axis, cls, count(*) as positions, count(*) filter (bad) as errors, round(count(*) filter (bad)::double / count(*), 9) as rate from a group by 1, 2, 3, 4",
    "stratified_metrics": f"{_R} {_OPS}, {FEATS}, {_bins_sql()}, pc as (select run, seed, pos, {_COUNTS} from ops group by 1, 2, 3), g as (select run, stratum, bin, lo, seed, count(*) as n, sum(char_ref)::bigint as char_ref, sum(char_edits)::double / nullif(sum(char_ref), 0) as cer, sum(base_ok_ci)::double / nullif(sum(base_n), 0) as base, sum(mod_ok)::double / nullif(sum(mod_n), 0) as mod, sum(tone_ok)::double / nullif(sum(tone_n), 0) as tone from pc join bn using (pos) group by 1, 2, 3, 4, 5) select run, stratum, bin, lo, arg_min(n, seed) as n, arg_min(char_ref, seed) as chars, count(*) as k, {_whole('cer')} as cer, {_whole('base')} as base_ci, {_whole('mod')} as mod, {_whole('tone')} as tone from g group by 1, 2, 3, 4",
    "seed_stats": f"{_R} {_OPS}, {_W}, {_score_sql('run, seed')}, {_VALUES}, g as (select run, metric, count(*) as k, string_agg(printf('%.4f', round(value, 6)), ';' order by seed) as seeds, median(value) as median, avg(value) as mean, stddev_samp(value) as std, max(value) - min(value) as range from vals group by 1, 2) select run, metric, k, seeds, round(median, 6) as median, round(mean, 6) as mean, round(std, 6) as std, round(range, 6) as range, round({_T} * std / sqrt(k), 6) as ci95_half from g",
    "source_seed_stats": f"{_R} {_OPS}, {_W}, {INSTANCES}, {_score_sql('source, seed', _SRC)}, v as (select source, seed, 'cer' as metric, cer * 100.0 as value from sc union all select source, seed, 'tone_acc', tone_acc * 100.0 from sc), g as (select source, metric, count(*) as k, count(value) as kv, median(value) as median, avg(value) as mean, stddev_samp(value) as std, max(value) - min(value) as range from v group by 1, 2) select source, metric, k, case when k = kv then round(median, 6) end as median, case when k = kv then round(mean, 6) end as mean, case when k = kv then round(range, 6) end as range, case when k = kv and k > 2 then round(1.96 * std / sqrt(k), 6) end as ci95_half from g",
    "denominators": "with c as (select run, seed, count(*) as n, sum(length(ref)) as chars from predictions group by 1, 2) select run, count(distinct n) as n_kinds, count(distinct chars) as chars_kinds, count(distinct n) = 1 and count(distinct chars) = 1 as same from c group by 1",
    "truncation_diag": f"select run, seed, count(*) as n, round(avg(length(ref)), 6) as mean_ref_len, round(avg({_TRUE_LEN}), 6) as mean_hyp_len, round(avg(({_TRUE_LEN} < 0.6 * length(ref))::int) * 100, 6) as severe_pct from predictions where length(ref) >= 9 group by 1, 2",
    "length_ratio_hist": f"with a as (select run, seed, {_TRUE_LEN}::double / nullif(length(ref), 0)::double as q from predictions), b as (select run, seed, floor(least(greatest(q, 0.0), 1.499) * 10)::int as bin, count(*) as n from a where q is not null group by 1, 2, 3) select *, round(n * 100.0::double / sum(n) over (partition by run, seed), 6) as pct from b",
    "length_curve": f"select run, length(ref) as ref_len, count(*) as n, round(avg({_TRUE_LEN}), 6) as mean_hyp_len from predictions where ref is not null group by 1, 2 having count(*) >= 15",
}
