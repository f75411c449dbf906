"""Queries that sample, count tokens, mix and check sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrain.operators import audit, sampling, score
from inkgrain.plans.audit_plans import _ANY, _HAVE, SPACE
from inkgrain.plans.common import CLASS, FEATS, INSTANCES, VOCAB, feats, instances, table

SEED = "20260711"
FRACTIONS = {"dense": 0.5, "small": 0.3, "low_contrast": 0.3, "plain": 0.06}


def _scorable(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return instances(spark, d, "scorable", "text", *cols).where("scorable and text is not null")


def _fraction() -> F.Column:
    x = F.lit(0.0)
    for s, f in FRACTIONS.items():
        x = F.when(F.col("stratum") == s, f).otherwise(x)
    return x


def _strata(spark: SparkSession, d: str) -> DataFrame:
    g = score.glyph_counts(_scorable(spark, d), "pos", "text")
    f = feats(spark, d, "split", "height", "contrast").join(g, "pos").select("pos", "split", "height", "contrast", "n_diacritic")
    return audit.first_match_stratum(f).select("pos", "split", "stratum")


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """An exact share of every source, with weights."""
    s = sampling.stratified_sample(_scorable(spark, d, "source").select("pos", "source"), "source", "pos", F.lit(0.3), SEED)
    return s.select("pos", "source", "n_stratum", "n_sample", F.round("ht_weight", 9).alias("ht_weight"))


def stratum_table(spark: SparkSession, d: str) -> DataFrame:
    """Population, sample size and weight of each stratum."""
    return sampling.population_table(_strata(spark, d), "stratum", _fraction())


def gold_sample(spark: SparkSession, d: str) -> DataFrame:
    """G1: the review sample, per stratum and split."""
    s = sampling.stratified_sample(_strata(spark, d), "stratum", "pos", _fraction(), "1234")
    return s.groupBy("stratum").agg(F.count("*").alias("n"), F.round(F.max("ht_weight"), 9).alias("ht_weight"))


def ht_rate(spark: SparkSession, d: str) -> DataFrame:
    """Weighted share of long texts estimated from a stratified sample."""
    rows = _scorable(spark, d, "source", "split").select("pos", "source", "split", F.length("text").alias("n"))
    s = sampling.stratified_sample(rows, "source", "pos", F.lit(0.3), SEED)
    return sampling.ht_rate(s, ["split"], F.col("n") >= 9, F.col("ht_weight"))


def nested_subsets(spark: SparkSession, d: str) -> DataFrame:
    """Training subsets of 10, 25, 50 and 100 percent, each within the next."""
    return sampling.nested_subsets(_scorable(spark, d, "split").where("split = 'train'").select("pos"), "pos", SEED, [10, 25, 50, 100])


def blind_subset(spark: SparkSession, d: str) -> DataFrame:
    """The blind part of every stratum of the sheet."""
    sheet = table(spark, d, "gold_sheet").select("idx", "stratum").distinct()
    return sampling.blind_subset(sheet, "stratum", "idx", 0.12, "20260712")


def probe_take(spark: SparkSession, d: str) -> DataFrame:
    """As many training as test records, drawn at random."""
    s = _scorable(spark, d, "split", "img_id")
    n = s.where("split = 'test'").count()
    return sampling.take_n(s.where("split = 'train'").select("pos", "img_id"), "pos", n, SEED)


def every_fifth(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth record, per source."""
    return instances(spark, d, "source").where("pos % 5 = 0").groupBy("source").agg(F.count("*").alias("n"))


def token_freq(spark: SparkSession, d: str) -> DataFrame:
    """Counts of cleaned tokens of the transcripts."""
    return sampling.token_bank(_scorable(spark, d), "text", VOCAB)


def budgeted_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Documents in order of arrival until a budget of characters is reached, per source."""
    docs = table(spark, d, "documents").where("n_chars > 0").select("doc_id", "source", F.col("n_chars").cast("long").alias("n_chars"))
    got = sampling.budgeted_prefix(docs, "doc_id", "n_chars", 1_000_000)
    return got.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


def bank_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Test texts within and beyond the bank of training texts."""
    s = _scorable(spark, d, "split")
    bank = s.where("split = 'train'").select(F.col("text").alias("known"))
    return sampling.bank_counts(s.where("split <> 'train'"), "text", bank, "known", ["split"])


def split_disjoint(spark: SparkSession, d: str) -> DataFrame:
    """Images that two splits share."""
    return sampling.shared_keys(instances(spark, d, "split", "img_id"), "split", "img_id")


def pool_union(spark: SparkSession, d: str) -> DataFrame:
    """What a pooled training set is made of."""
    a = _scorable(spark, d, "split").where("split = 'train'").select("text")
    b = table(spark, d, "documents").where("kind = 'sign' and text is not null").select("text")
    return sampling.composition(sampling.pool({"real": a, "made": b}, ["text"]))


def synthetic_draws(spark: SparkSession, d: str) -> DataFrame:
    """Draws of the text sampler by kind (20,000 draws: a sampling operator)."""
    bank = _scorable(spark, d, "split").where("split = 'train'").select("text")
    got = sampling.synthetic_draws(20_000, bank, sampling.token_bank(bank, "text", VOCAB), SEED, spark)
    return got.groupBy("kind", "stratum").agg(F.count("*").alias("n"), F.min("height").alias("least_height"), F.max("height").alias("most_height"))


QUERIES = {f.__name__: f for f in (stratified_sample, stratum_table, gold_sample, ht_rate, nested_subsets, blind_subset, probe_take, every_fifth, token_freq, budgeted_prefix, bank_leakage, split_disjoint, pool_union, synthetic_draws)}

_S = f"{INSTANCES}, sc as (select * from inst where scorable and text is not null)"
_H = lambda seed, k: f"md5('{seed}:' || {k}::varchar)"
_SAMPLE = f"sm as (select *, count(*) over (partition by source) as n_stratum, row_number() over (partition by source order by {_H(SEED, 'pos')}, pos) as r from sc), sp as (select *, round_even(n_stratum * 0.3::double, 0)::bigint as n_sample from sm)"
_FR = "case stratum " + " ".join(f"when '{k}' then {v}" for k, v in FRACTIONS.items()) + " end::double"
_STRATA = f"{_S}, {FEATS}, g as (select pos, {_HAVE(_ANY)} as nd from sc), f as (select ft.pos, height, contrast, nd from ft join g using (pos)), q as (select floor(quantile_cont(height, 0.25) filter (height > 0)) as sp, quantile_cont(contrast, 0.25) filter (not isnan(contrast)) as lc from f), st as (select pos, case when nd >= 4 then 'dense' when height > 0 and height <= sp then 'small' when round(contrast, 4) <= lc and not isnan(contrast) then 'low_contrast' else 'plain' end as stratum from f, q), pt as (select stratum, count(*) as n, round_even(count(*) * {_FR}, 0)::bigint as k from st group by 1)"
_OWN = "".join("\\" + x if x in "\\[]^-" else ("''" if x == "'" else x) for x in " \t\r\n\"'()[]{}<>«»“”‘’.,;:!?…·•|/\\")
SQL = {
    "stratum_table": f"with {_STRATA} select stratum, n, k, round(k::double / n, 9) as pi_incl, round(n::double / nullif(k, 0), 9) as ht_weight from pt",
    "gold_sample": f"with {_STRATA} select stratum, k as n, round(n::double / k, 9) as ht_weight from pt where k > 0",
    "stratified_sample": f"with {_S}, {_SAMPLE} select pos, source, n_stratum, n_sample, round(n_stratum::double / n_sample, 9) as ht_weight from sp where r <= n_sample",
    "ht_rate": f"with {_S}, {_SAMPLE}, h as (select split, n_stratum::double / n_sample as w, length(text) >= 9 as y from sp where r <= n_sample) select split, count(*) as n, round(sum(w * y::int) / sum(w), 9) as rate from h group by 1",
    "nested_subsets": f"with {_S}, t as (select pos, row_number() over (order by {_H(SEED, 'pos')}, pos) as k, count(*) over () as n from sc where split = 'train') select pos, r from t, (values (10), (25), (50), (100)) as v(r) where k <= round_even(n * (r / 100.0::double), 0)",
    "blind_subset": f"with s as (select distinct idx, stratum from gold_sheet), t as (select *, row_number() over (partition by stratum order by {_H('20260712', 'idx')}, idx) as r, count(*) over (partition by stratum) as n from s) select idx, stratum from t where r <= greatest(1, round_even(n * 0.12::double, 0))",
    "probe_take": f"with {_S} select pos, img_id from sc where split = 'train' order by {_H(SEED, 'pos')}, pos limit (select count(*) from sc where split = 'test')",
    "every_fifth": f"with {INSTANCES} select source, count(*) as n from inst where pos % 5 = 0 group by 1",
    "token_freq": rf"with {_S}, w as (select unnest(regexp_split_to_array(text, '{SPACE}')) as w from sc), c as (select regexp_replace(nfc_normalize(regexp_replace(w, '\p{{Cf}}', '', 'g')), '^[{_OWN}]+|[{_OWN}]+$', '', 'g') as t from w) select lower(t) as token, count(*) as cnt from c where t <> '' and regexp_full_match(t, '[{CLASS}]*') and regexp_matches(t, '[0-9A-Za-zÀ-ỹ]') group by 1",
    "budgeted_prefix": "with t as (select source, n_chars, sum(n_chars) over (order by doc_id) - n_chars as before from documents where n_chars > 0) select source, count(*) as n, sum(n_chars)::bigint as n_chars from t where before < 1000000 group by 1",
    "bank_leakage": f"with {_S}, b as (select distinct text from sc where split = 'train') select split, count(*) filter (text in (select text from b)) as in_bank, count(*) filter (text not in (select text from b)) as beyond from sc where split <> 'train' group by 1",
    "split_disjoint": f"with {INSTANCES}, k as (select distinct split, img_id from inst) select x.split as a, y.split as b, count(*) as n from k x join k y on x.img_id = y.img_id and x.split < y.split group by 1, 2",
    "pool_union": f"with {_S}, p as (select 'real' as part from sc where split = 'train' union all select 'made' from documents where kind = 'sign' and text is not null) select part, count(*) as n, round(count(*)::double / sum(count(*)) over (), 9) as share from p group by 1",
}
