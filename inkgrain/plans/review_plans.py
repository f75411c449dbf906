"""Queries on the review sheet and its events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrain.operators import review
from inkgrain.plans.common import table
from inkgrain.sources.readers import SHEET

SEED = "20260713"


def _sheet(spark: SparkSession, d: str) -> DataFrame:
    return review.one_row_a_key(table(spark, d, "gold_sheet").select(*SHEET))


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "review_log")


def review_report(spark: SparkSession, d: str) -> DataFrame:
    """The report over the whole sheet."""
    return review.report(_sheet(spark, d), [])


def review_report_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    """The report of each stratum."""
    return review.report(_sheet(spark, d), ["stratum"])


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """The second-pass queue in its order."""
    return review.second_pass_queue(_sheet(spark, d), SEED)


def review_pending(spark: SparkSession, d: str) -> DataFrame:
    """Queued rows still open."""
    sheet = _sheet(spark, d)
    return review.pending(sheet, review.second_pass_queue(sheet, SEED)).select("idx", "rank")


def event_latest_state(spark: SparkSession, d: str) -> DataFrame:
    """The last event of every sheet row."""
    return review.latest_events(_log(spark, d)).select("idx", "pass_", "action", "value", F.unix_micros("ts").alias("ts_us"))


def event_pace(spark: SparkSession, d: str) -> DataFrame:
    """Seconds between the reviews of each day, and their running mean."""
    log = _log(spark, d).dropDuplicates(["idx", "ts", "pass_", "action"]).withColumn("day", F.to_date("ts"))
    return review.pace(log, ["day"]).select("idx", F.unix_micros("ts").alias("ts_us"), "action", "gap_s", "mean_gap_s")


def event_cooloff(spark: SparkSession, d: str) -> DataFrame:
    """Whether second passes came at least a day after the first."""
    return review.cooled(_log(spark, d)).select("idx", "age_h", "cooled")


def event_actions(spark: SparkSession, d: str) -> DataFrame:
    """Events by pass, action and warning."""
    e = _log(spark, d).select("pass_", "action", F.explode_outer("warnings").alias("warning"))
    return e.groupBy("pass_", "action", "warning").agg(F.count("*").alias("n"))


def sheet_against_log(spark: SparkSession, d: str) -> DataFrame:
    """Sheet rows whose first-pass action differs from their last first-pass event."""
    last = review.latest_events(_log(spark, d).where("pass_ = 1")).select(F.col("idx").cast("string").alias("idx"), F.col("action").alias("logged"))
    return _sheet(spark, d).join(last, "idx", "full_outer").where(~F.coalesce(F.col("action1") == F.col("logged"), F.lit(False))).select("idx", "action1", "logged")


def artifact_upsert(spark: SparkSession, d: str) -> DataFrame:
    """K6: yesterday's label table brought up to date by the reviewed labels."""
    sheet = _sheet(spark, d)
    old = sheet.select("idx", F.col("public_label").alias("label"), F.length("public_label").cast("double").alias("size"))
    new = sheet.where("gold_pass1 <> ''").select("idx", F.col("gold_pass1").alias("label"), F.length("gold_pass1").cast("double").alias("size"))
    return review.upsert(old, new, "idx", ["size"])


QUERIES = {f.__name__: f for f in (review_report, review_report_by_stratum, review_queue, review_pending, event_latest_state, event_pace, event_cooloff, event_actions, sheet_against_log, artifact_upsert)}

_ROW = ", ".join(c for c in SHEET if c != "idx")
_SH = f"sh as (select * exclude (rn) from (select {', '.join(SHEET)}, row_number() over (partition by idx order by {', '.join(c + ' desc' for c in SHEET if c != 'idx')}) as rn from gold_sheet) where rn = 1)"
_PCT = lambda a, b: f"round(count(*) filter ({a}) * 100.0::double / nullif(count(*) filter ({b}), 0), 6)"
_DONE, _BL, _UN, _DF, _TWO = "action1 <> ''", "blind = '1'", "action1 = 'unreadable'", "gold_pass1 <> public_label", "action2 <> ''"
_SPLIT = f"({_TWO} and gold_pass1 <> gold_pass2)"
_REPORT = f"""count(*) as n, count(*) filter ({_DONE}) as reviewed, count(*) filter ({_UN}) as unreadable, {_PCT(f"{_DONE} and not {_BL} and action1 = 'edit'", f"{_DONE} and not {_BL} and not {_UN}")} as assisted_edit_pct,
 {_PCT(f"{_DONE} and {_BL} and not {_UN} and {_DF}", f"{_DONE} and {_BL} and not {_UN}")} as blind_disagree_pct, {_PCT(f"{_DONE} and {_BL} and {_DF}", f"{_DONE} and {_BL}")} as blind_disagree_all_pct,
 count(*) filter ({_TWO}) as second_pass, {_PCT(_SPLIT, _TWO)} as pass2_disagree_pct, count(*) filter ({_SPLIT} and resolved <> '1') as unresolved"""
_QUEUE = f"""ac as (select idx, row_number() over (order by md5('{SEED}:' || idx), idx) as r, count(*) over () as n from sh where action1 = 'accept' and blind <> '1'),
qi as (select idx from sh where action1 <> '' and (action1 = 'edit' or blind = '1') union select idx from ac where r <= greatest(1, round_even(n * 0.10::double, 0))),
qu as (select idx, row_number() over (order by md5('{SEED}/order:' || idx), idx) as rank from qi)"""
_LAST = "row_number() over (partition by idx order by ts desc, received_at desc, pass_ desc, action desc, value desc nulls last, blind desc nulls last, public_label desc nulls last, pass1 desc nulls last) = 1"
SQL = {
    "review_report": f"with {_SH} select {_REPORT} from sh",
    "review_report_by_stratum": f"with {_SH} select stratum, {_REPORT} from sh group by stratum",
    "review_queue": f"with {_SH}, {_QUEUE} select * from qu",
    "review_pending": f"with {_SH}, {_QUEUE} select idx, rank from sh join qu using (idx) where action2 = '' or (gold_pass1 <> gold_pass2 and resolved <> '1')",
    "event_latest_state": f"select idx, pass_, action, value, epoch_us(ts) as ts_us from review_log qualify {_LAST}",
    "event_pace": "with e as (select distinct idx, ts, pass_, action from review_log), g as (select idx, action, ts, ts::date as day, round((epoch_us(ts) - epoch_us(lag(ts) over (partition by ts::date order by ts, idx, action))) / 1e6::double, 6) as gap_s from e) select idx, epoch_us(ts) as ts_us, action, gap_s, round(avg(gap_s) over (partition by day order by ts, idx, action rows between 24 preceding and current row), 3) as mean_gap_s from g",
    "event_cooloff": "with a as (select idx, max(ts) as f from review_log where pass_ = 1 group by 1), b as (select idx, min(ts) as s from review_log where pass_ = 2 group by 1) select idx, round((epoch_us(s) - epoch_us(f)) / 3.6e9::double, 6) as age_h, (epoch_us(s) - epoch_us(f)) / 3.6e9::double >= 24 as cooled from a join b using (idx)",
    "event_actions": "with w as (select pass_, action, unnest(case when warnings is null or len(warnings) = 0 then [null] else warnings end) as warning from review_log) select pass_, action, warning, count(*) as n from w group by all",
    "sheet_against_log": f"with {_SH}, l as (select idx::varchar as idx, action as logged from review_log where pass_ = 1 qualify {_LAST}) select coalesce(sh.idx, l.idx) as idx, action1, logged from sh full join l on sh.idx = l.idx where not coalesce(action1 = logged, false)",
    "artifact_upsert": f"with {_SH} select idx, case when gold_pass1 <> '' then gold_pass1 else public_label end as label, length(case when gold_pass1 <> '' then gold_pass1 else public_label end)::double as size from sh",
}
