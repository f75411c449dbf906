"""Queries on literal rows: goldens of alignment and glyphs, verdicts, curves, geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrain.functions import glyphs
from inkgrain.functions.geometry import quad_overlap
from inkgrain.operators import detection, fonts, score, seedstats
from inkgrain.plans.common import FEATS, INSTANCES, feats, instances, table
from inkgrain.plans.score_plans import _COUNTS, _OPS, _W

# Per-seed results and curve points used as literals.
SEEDS = [("A", "cer", 1, 9.394964299135664), ("A", "cer", 2, 9.225854941751221), ("A", "cer", 3, 9.521125248295485), ("A", "tone", 1, 94.41), ("A", "tone", 2, 94.29), ("A", "tone", 3, 94.53),
         ("B", "cer", 1, 8.61), ("B", "cer", 2, 8.70), ("B", "cer", 3, 8.66), ("B", "tone", 1, 95.31), ("B", "tone", 2, 95.20), ("B", "tone", 3, 95.44),
         ("C", "cer", 1, 9.62), ("C", "cer", 2, 9.45), ("C", "cer", 3, 9.79), ("C", "tone", 1, 94.49), ("C", "tone", 2, 94.36), ("C", "tone", 3, 94.62)]
CURVE = [("cer", 10, 16.509, 0.933), ("cer", 25, 12.373, 0.337), ("cer", 50, 10.430, 0.200), ("cer", 100, 9.381, 0.368)]
ARM = [("cer", 10, 13.726, 0.096), ("cer", 25, 11.621, 0.374), ("cer", 50, 10.478, 0.807)]
# Own pairs for the corners of the scorer: equal, empty on either side, case, one mark, words left out or run together.
PAIRS = [("bánh mì nóng giòn", "banh mi nong gion"), ("q", "w"), ("chợ đêm", "chợ đêm"), ("một hai ba bốn", "một ba bốn"), ("quán", "quan"), ("ỡ", ""), ("xe", "xe7"), ("Huế", "huế"), ("ỏ", "õ"), ("đồ", "do"), ("oo", "o"), ("cửa hàng", "hàng cửa"), ("", "mở"), ("", ""), ("ngã ba", "ngãba")]


def _seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEEDS, "run string, metric string, seed int, value double")


def _stats(spark: SparkSession) -> DataFrame:
    return seedstats.seed_stats(_seeds(spark), ["run", "metric"])


def alignments(spark: SparkSession, d: str) -> DataFrame:
    """T5, H7: the operations of every distinct pair of predictions that differs, ties from the end."""
    rows = score.aligned(table(spark, d, "predictions"), []).where("ref <> hyp")
    shown = F.array_join(F.transform("ops", lambda o: F.concat(o["op"], F.lit(":"), F.coalesce(o["r"], F.lit("-")), F.coalesce(o["h"], F.lit("-")))), " ")
    return rows.select("ref", "hyp", shown.alias("ops"))


def score_literals(spark: SparkSession, d: str) -> DataFrame:
    """A1, A2, K8: goldens of the scorer, one group a pair."""
    p = spark.createDataFrame([(i, r, h) for i, (r, h) in enumerate(PAIRS)], "i int, ref string, hyp string")
    return score.score(p, ["i"]).select("i", "char_edits", "char_ref", "word_edits", "word_ref", "base_n", "base_ok", "base_ok_ci", "mod_n", "mod_ok", "tone_n", "tone_ok")


def glyph_decompose(spark: SparkSession, d: str) -> DataFrame:
    """The parts of every character of the transcripts that has marks."""
    used = instances(spark, d, "text").select(F.explode(F.split(F.coalesce("text", F.lit("")), "")).alias("ch")).where("ch <> ''").distinct()
    return used.join(F.broadcast(glyphs.table(spark)), "ch").select("ch", "base", "modifier", "tone", "is_letter", "bears_mod", "bears_tone")


def ci_overlap_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Two arms against the base."""
    s = _stats(spark)
    out = None
    for arm in ("B", "C"):
        c = seedstats.compare(s, "A", arm).select(F.lit(arm).alias("arm"), "metric", F.round("gain", 6).alias("gain"), F.round("gain_half", 6).alias("gain_half"), "overlap", "improved", "clears")
        out = c if out is None else out.union(c)
    return out


def gate_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Green only where CER and tone are both separated and improved."""
    s = _stats(spark)
    return seedstats.gate(seedstats.compare(s, "A", "B"), ["cer", "tone"]).select(F.lit("B").alias("arm"), "verdict").union(seedstats.gate(seedstats.compare(s, "A", "C"), ["cer", "tone"]).select(F.lit("C"), "verdict"))


def strongest_comparator(spark: SparkSession, d: str) -> DataFrame:
    """C4: the better of the two comparators for each metric."""
    return seedstats.strongest(_stats(spark), ["A", "C"]).select("metric", "arm", F.round("mean", 6).alias("mean"))


def paired_t(spark: SparkSession, d: str) -> DataFrame:
    """Paired differences over seeds."""
    return seedstats.paired_t(_seeds(spark), "A", "B").select("metric", "k", F.round("mean_d", 6).alias("mean_d"), F.round("t", 6).alias("t"), "exceeds")


def curve_invert(spark: SparkSession, d: str) -> DataFrame:
    """The budget at which the real curve reaches each arm's value."""
    c = spark.createDataFrame(CURVE, "metric string, r int, y double, half double").select("metric", "r", "y")
    a = spark.createDataFrame(ARM, "metric string, r int, y double, half double").select("metric", F.col("r").alias("r_arm"), F.col("y").alias("target"))
    return seedstats.invert_curve(c, a, ["metric"]).select("metric", "r_arm", F.round("r_at", 6).alias("r_at"))


def worth_range(spark: SparkSession, d: str) -> DataFrame:
    """Real records an arm is worth, with the range over both intervals."""
    c = spark.createDataFrame(CURVE, "metric string, r int, y double, half double")
    a = spark.createDataFrame(ARM, "metric string, r int, y double, half double")
    w = seedstats.worth(c, a, ["metric"])
    return w.select("metric", "r_arm", *[F.round(x, 3).alias(x) for x in ("worth", "worth_lo", "worth_hi")], "truncated")


def bank_retention(spark: SparkSession, d: str) -> DataFrame:
    """C11: the part of the gain the strict bank keeps."""
    g = spark.createDataFrame([(10, 16.538, 13.181, 13.726), (25, 12.373, 11.434, 11.621)], "r int, real double, full double, strict double")
    return seedstats.retention(g).select("r", F.round("kept", 9).alias("kept"))


def control_recovery(spark: SparkSession, d: str) -> DataFrame:
    """What a control keeps of each metric's gain."""
    g = spark.createDataFrame([("cer", 2.609, 2.783), ("tone", 1.768, 2.033), ("base", 0.7, 1.605), ("mod", 1.2, 1.808)], "metric string, control double, shipped double")
    return g.select("metric", F.round(F.col("control") / F.col("shipped") * 100, 6).alias("pct"), seedstats.recovery(F.col("control"), F.col("shipped")).alias("reading"))


def insertion_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Which kind of edit a change of CER comes from."""
    m = spark.createDataFrame([("A-B", 9.381, 9.637, 6.806, 6.926, 1.461, 1.362, 1.114, 1.348), ("A-C", 9.381, 9.620, 6.806, 6.848, 1.461, 1.365, 1.114, 1.407)], "pair string, cer_a double, cer_b double, sub_a double, sub_b double, del_a double, del_b double, ins_a double, ins_b double")
    return seedstats.insertion_attribution(m).select("pair", *[F.round(f"{k}_part", 6).alias(f"{k}_part") for k in ("sub", "del", "ins")], "insertions_lead")


def gain_share(spark: SparkSession, d: str) -> DataFrame:
    """Characters the second seed fixes against the first, per source."""
    p = table(spark, d, "predictions").join(instances(spark, d, "source").select("pos", "source"), "pos")
    c = score.axis_counts(score.op_rows(p, ["source", "seed"]), ["source", "seed"]).select("source", "seed", F.col("char_edits").alias("edits")).where("source is not null")
    g = seedstats.gain_share(c.where("seed = 1"), c.where("seed = 2"), ["source"], [])
    return g.select("source", "edits_before", "edits_after", "fixed", (F.round("share", 9) + 0.0).alias("share"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Regions as truth, do-not-care or, moved by a few pixels and less every seventh, prediction."""
    i = instances(spark, d, "img_id", "poly", "scorable").where("poly is not null and size(poly) = 8").select("img_id", "pos", "poly", "scorable")
    gt = i.select("img_id", "pos", "poly", F.when(F.col("scorable"), "gt").otherwise("dontcare").alias("kind"))
    pred = i.where("pos % 7 <> 0").select("img_id", "pos", F.transform("poly", lambda x: x + (F.col("pos") % 11).cast("int")).alias("poly"), F.lit("pred").alias("kind"))
    return gt.union(pred)


def iou_match_prf(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of moved regions at five thresholds."""
    return detection.precision_recall(detection.match(_boxes(spark, d)))


def overlap_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Free places beside regions, of the candidates around them, per split."""
    i = instances(spark, d, "img_id", "split", "poly").where("poly is not null")
    c = i.select("img_id", "split", "pos", F.array_max("poly").alias("m"), F.get("poly", F.lit(0)).alias("x"), F.get("poly", F.lit(1)).alias("y"))
    c = c.select("img_id", "split", "pos", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("x") + dx).alias("x0"), (F.col("y") + dy).alias("y0"), (F.col("x") + dx + 64).alias("x1"), (F.col("y") + dy + 32).alias("y1")) for k, (dx, dy) in enumerate([(0, 0), (200, 0), (0, 100), (400, 200)])])))
    return detection.free_patches(c, i.select("img_id", "poly")).groupBy("split", "k").agg(F.count("*").alias("n"))


def quad_iou_literals(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps of literal quads."""
    q = [(0, [0, 0, 10, 0, 10, 10, 0, 10], [5, 0, 15, 0, 15, 10, 5, 10]), (1, [0, 0, 10, 0, 10, 10, 0, 10], [20, 20, 30, 20, 30, 30, 20, 30]), (2, [0, 0, 10, 0, 10, 10, 0, 10], [2, 2, 8, 2, 8, 8, 2, 8]), (3, [0, 0, 10, 0, 10, 10, 0, 10], [0, 10, 10, 10, 10, 0, 0, 0])]
    r = spark.createDataFrame(q, "i int, a array<double>, b array<double>".replace("double", "int"))
    return r.select("i", quad_overlap("a", "b").alias("o")).select("i", F.round("o.iou", 9).alias("iou"), F.round("o.cover", 9).alias("cover"))


def charset_generate(spark: SparkSession, d: str) -> DataFrame:
    """How many marked letters each shape and tone has."""
    return fonts.accented(spark).groupBy("modifier", "tone").agg(F.count("*").alias("n"))


def easy_samples(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty easy records (the limit is the operator's)."""
    return fonts.easy_samples(feats(spark, d, "length", "height", "contrast")).select("pos", "height", "length")


def font_gate(spark: SparkSession, d: str) -> DataFrame:
    """fonts against the characters of the marked alphabet."""
    all_ = sorted(ord(c) for c, *_ in glyphs.rows())
    f = spark.createDataFrame([("full", all_, 0), ("plain", list(range(32, 127)), 0), ("drops", all_, 2), ("broken", None, None)], "family string, cmap array<int>, dropped int")
    return fonts.gate(f, fonts.accented(spark)).select("family", F.size("missing").alias("n_missing"), "verdict").join(f.select("family", F.coalesce(fonts.covers(F.lit("phở bò"), F.col("cmap")), F.lit(False)).alias("covers")), "family")


def probe_gap(spark: SparkSession, d: str) -> DataFrame:
    """Error of the second against the first seed, by run."""
    p = table(spark, d, "predictions").withColumn("split", F.when(F.col("seed") == 1, "train").otherwise("test"))
    g = fonts.probe_gap(score.score(p, ["run", "split"]), ["run"])
    return g.select("run", F.round("train", 9).alias("train"), F.round("test", 9).alias("test"), F.round("gap_pp", 6).alias("gap_pp"), fonts.probe_reading(F.col("gap_pp"), F.col("test")).alias("reading"))


QUERIES = {f.__name__: f for f in (alignments, score_literals, glyph_decompose, ci_overlap_verdict, gate_verdict, strongest_comparator, paired_t, curve_invert, worth_range, bank_retention, control_recovery, insertion_attribution, gain_share, iou_match_prf, overlap_antijoin, quad_iou_literals, charset_generate, easy_samples, font_gate, probe_gap)}

_V = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::double" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)
_T3 = seedstats.T95[1]
_ST = f"v(run, metric, seed, value) as (values {_V(SEEDS)}), st as (select run, metric, avg(value) as mean, {_T3} * stddev_samp(value) / sqrt(3) as half from v group by 1, 2)"
_CMP = f"""{_ST}, cm as (select b.run as arm, a.metric, a.mean as am, b.mean as bm, a.half as ah, b.half as bh, case when a.metric = 'cer' then a.mean - b.mean else b.mean - a.mean end as gain, {_T3} * sqrt(pow(a.half / {_T3}, 2) + pow(b.half / {_T3}, 2)) as gh from st a join st b using (metric) where a.run = 'A' and b.run <> 'A'),
cv as (select *, not (am + ah < bm - bh or bm + bh < am - ah) as overlap, gain > 0 as improved from cm)"""
_CURVE = f"cu(metric, r, y, half) as (values {_V(CURVE)}), ar(metric, r, y, half) as (values {_V(ARM)})"
_LITS = ", ".join(f"('x', 1, {i}, '{r}', '{h}')" for i, (r, h) in enumerate(PAIRS))
_SCORED = ["char_edits", "char_ref", "base_n", "base_ok", "base_ok_ci", "mod_n", "mod_ok", "tone_n", "tone_ok"]
SQL = {
    "score_literals": f"with recursive lits(run, seed, pos, ref, hyp) as (values {_LITS}), {_OPS.replace('from predictions)', 'from lits)')}, {_W}, c as (select pos, {_COUNTS} from ops group by 1) select p.pos as i, dist::bigint as word_edits, words as word_ref, " + ", ".join(f"coalesce({x}, 0) as {x}" for x in _SCORED) + " from p join ww using (r, h) left join c on c.pos = p.pos",
    "gain_share": f"with recursive {_OPS}, {INSTANCES}, c as (select source, seed, count(*) filter (op <> 'eq') as e from ops join (select pos, source from inst) using (pos) where source is not null group by 1, 2) select a.source, a.e as edits_before, b.e as edits_after, a.e - b.e as fixed, round((a.e - b.e)::double / nullif(sum(a.e - b.e) over (), 0), 9) + 0.0 as share from c a join c b on a.source = b.source and a.seed = 1 and b.seed = 2",
    "charset_generate": "with m(modifier, n) as (values ('none', 12), ('breve', 2), ('circumflex', 6), ('horn', 4)), t(tone) as (values ('ngang'), ('sac'), ('huyen'), ('hoi'), ('nga'), ('nang')) select modifier, tone, n from m, t where not (modifier = 'none' and tone = 'ngang') union all select 'stroke', 'ngang', 2",
    "easy_samples": f"with {FEATS} select pos, height, length from ft where length >= 4 and height >= 32 and contrast > 0.75 and not isnan(contrast) order by pos limit 20",
    "font_gate": "select * from (values ('full', 0, 'PASS', true), ('plain', 134, 'FAIL', false), ('drops', 0, 'FAIL', true), ('broken', 0, 'FAIL', false)) as v(family, n_missing, verdict, covers)",
    "probe_gap": f"with recursive {_OPS}, {_W}, c as (select run, seed, count(*) filter (op <> 'eq')::double / count(*) filter (op <> 'ins') as cer from ops group by 1, 2), g as (select run, max(cer) filter (seed = 1) as train, max(cer) filter (seed = 2) as test from c group by 1) select run, round(train, 9) as train, round(test, 9) as test, round((round(test, 9) - round(train, 9)) * 100, 6) as gap_pp, case when (test - train) * 100 >= 5 then 'train seen: escalate' when test <= 0.1 then 'all seen: escalate' else 'no sign of exposure' end as reading from g",
    "alignments": f"with recursive {_OPS} select r as ref, h as hyp, string_agg(op || ':' || coalesce(x, '-') || coalesce(y, '-'), ' ' order by i, j) as ops from tb where op <> '' group by r, h",
    "glyph_decompose": f"with {INSTANCES}, gl(ch, base, modifier, tone, is_letter, bears_mod, bears_tone) as (values {glyphs.values_sql()}), c as (select distinct substr(text, i, 1) as ch from inst, unnest(range(1, length(text) + 1)) as t(i)) select gl.* from c join gl using (ch)",
    "ci_overlap_verdict": f"with {_CMP} select arm, metric, round(gain, 6) as gain, round(gh, 6) as gain_half, overlap, improved, abs(gain) > gh as clears from cv",
    "gate_verdict": f"with {_CMP} select arm, case when bool_and(not overlap and improved) then 'GREEN' else 'RED' end as verdict from cv group by 1",
    "strongest_comparator": f"with {_ST} select metric, arg_min(run, (case when metric = 'cer' then mean else -mean end, run)) as arm, round(arg_min(mean, (case when metric = 'cer' then mean else -mean end, run)), 6) as mean from st where run in ('A', 'C') group by 1",
    "paired_t": f"with {_ST}, d as (select a.metric, b.value - a.value as d from v a join v b on a.metric = b.metric and a.seed = b.seed and a.run = 'A' and b.run = 'B') select metric, count(*) as k, round(avg(d), 6) as mean_d, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) as t, abs(avg(d) / (stddev_samp(d) / sqrt(count(*)))) > {_T3} as exceeds from d group by 1",
    "curve_invert": f"with {_CURVE}, sg as (select metric, r as r0, y as y0, lead(r) over (partition by metric order by r) as r1, lead(y) over (partition by metric order by r) as y1 from cu), h as (select ar.metric, ar.r as r_arm, min_by(exp(ln(r0) + (ar.y - y0) / (y1 - y0) * (ln(r1) - ln(r0))), r0) as r_at from ar join sg on ar.metric = sg.metric and r1 is not null and ar.y between least(y0, y1) and greatest(y0, y1) and y0 <> y1 group by 1, 2) select ar.metric, ar.r as r_arm, round(r_at, 6) as r_at from ar left join h on ar.metric = h.metric and ar.r = h.r_arm",
    "worth_range": f"""with {_CURVE}, k as (select ar.metric, ar.r as r_arm, ar.y + sy * ar.half as target, sy, sa from ar, (values (-1), (0), (1)) as a(sy), (values (-1), (0), (1)) as b(sa)),
 m as (select k.*, cu.r, cu.y + case when cu.r = r_arm then sa * cu.half else 0 end as y from k join cu using (metric)), e as (select metric, r_arm, sy, sa, arg_min(y, r) as f, arg_max(y, r) as l from m group by all),
 sg as (select *, lead(r) over w as r1, lead(y) over w as y1 from m window w as (partition by metric, r_arm, sy, sa order by r)),
 g as (select metric, r_arm, sy, sa, arg_min(exp(ln(r) + (target - y) / (y1 - y) * (ln(r1) - ln(r))), r) as ra from sg join e using (metric, r_arm, sy, sa) where r1 is not null and y <> y1 and target between least(y, y1) and greatest(y, y1) and target between least(f, l) and greatest(f, l) group by all),
 n as (select k.metric, k.r_arm, k.sy, k.sa, (ra - k.r_arm) / 100 * 25742 as n from k left join g using (metric, r_arm, sy, sa))
 select metric, r_arm, round(max(n) filter (sy = 0 and sa = 0), 3) as worth, round(min(n), 3) as worth_lo, round(max(n), 3) as worth_hi, count(n) < count(*) as truncated from n group by 1, 2""",
    "bank_retention": "select r, round((real - strict) / (real - full_), 9) as kept from (values (10, 16.538::double, 13.181::double, 13.726::double), (25, 12.373::double, 11.434::double, 11.621::double)) as v(r, real, full_, strict)",
    "control_recovery": "select metric, round(c / s * 100, 6) as pct, case when c / s * 100 >= 80 then 'recovered' when c / s * 100 < 50 then 'lost' else 'between' end as reading from (values ('cer', 2.609::double, 2.783::double), ('tone', 1.768::double, 2.033::double), ('base', 0.7::double, 1.605::double), ('mod', 1.2::double, 1.808::double)) as v(metric, c, s)",
    "insertion_attribution": "select pair, round((sb - sa) / (cb - ca), 6) as sub_part, round((db - da) / (cb - ca), 6) as del_part, round((ib - ia) / (cb - ca), 6) as ins_part, ib - ia > greatest(sb - sa, db - da) as insertions_lead from (values ('A-B', 9.381::double, 9.637::double, 6.806::double, 6.926::double, 1.461::double, 1.362::double, 1.114::double, 1.348::double), ('A-C', 9.381::double, 9.620::double, 6.806::double, 6.848::double, 1.461::double, 1.365::double, 1.114::double, 1.407::double)) as v(pair, ca, cb, sa, sb, da, db, ia, ib)",
    "overlap_antijoin": f"""with {INSTANCES}, i as (select * from inst where poly is not null), c as (select img_id, split, pos, k, poly[1] + dx as x0, poly[2] + dy as y0, poly[1] + dx + 64 as x1, poly[2] + dy + 32 as y1 from i, (values (0, 0, 0), (1, 200, 0), (2, 0, 100), (3, 400, 200)) as v(k, dx, dy)),
 b as (select img_id, list_min([poly[1], poly[3], poly[5], poly[7]]) as bx0, list_min([poly[2], poly[4], poly[6], poly[8]]) as by0, list_max([poly[1], poly[3], poly[5], poly[7]]) as bx1, list_max([poly[2], poly[4], poly[6], poly[8]]) as by1 from i)
 select split, k, count(*) as n from c where not exists (select 1 from b where b.img_id = c.img_id and x0 < bx1 and bx0 < x1 and y0 < by1 and by0 < y1) group by 1, 2""",
    "quad_iou_literals": "select i, round(iou, 9) as iou, cover from (values (0, 1.0::double / 3, 0.5::double), (1, 0.0, 0.0), (2, 0.36, 0.36), (3, 1.0, 1.0)) as v(i, iou, cover)",
}
