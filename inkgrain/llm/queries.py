"""Queries of the problems for training data, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrain.llm import blocksample, crossleak, lookalike, mixing, packing, percentiles, splits, tokens, toxicity
from inkgrain.session import settle

PS = [0.05, 0.25, 0.5, 0.75, 0.95]
METRICS = ["height", "contrast", "tilt"]
REGION = ["img_id", "poly"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# 1 -----------------------------------------------------------------------------------------------


def _shares(spark: SparkSession, d: str) -> dict[str, float]:
    return {r["split"]: r["target_share"] for r in _t(spark, d, "split_catalog").collect()}


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "instances").select("img_id", "img_path", "source")
    return splits.grouped_split(rows, "img_id", splits.photo_number(F.col("img_path")), F.col("source"), _shares(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of images that must share a split."""
    return splits.linked_pairs(settle(_assigned(spark, d)), "img_id")


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of every row of instances."""
    to = _assigned(spark, d).select("img_id", "split", "component").withColumnRenamed("img_id", "_i").withColumnRenamed("split", "new_split")
    rows = _t(spark, d, "instances").select("pos", "img_id")
    return rows.join(to, F.col("img_id").eqNullSafe(F.col("_i")), "left").select("pos", "img_id", "component", "new_split")


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """Rows and share of each split against its target."""
    got = _assigned(spark, d).groupBy("split").agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_images"))
    all_rows = got.agg(F.sum("n_rows").alias("total"))
    goal = _t(spark, d, "split_catalog").select("split", "target_share")
    return goal.join(got, "split", "left").crossJoin(F.broadcast(all_rows)).select("split", "target_share", "n_rows", "n_images", F.round(F.col("n_rows") / F.col("total"), 6).alias("share"))


# 2 -----------------------------------------------------------------------------------------------


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    """The regions chosen from all deliveries."""
    rows = _t(spark, d, "instances").select("img_id", "poly", "delivery", "pos")
    got = blocksample.block_sample(rows, REGION, ["delivery"])
    return got.select("img_id", F.concat_ws(",", "poly").alias("poly"), "seq", "block")


def p2_growth(spark: SparkSession, d: str) -> DataFrame:
    """For each delivery: regions chosen so far, and those chosen before that are gone (0)."""
    rows = _t(spark, d, "instances").select("img_id", "poly", "delivery", "pos")
    return blocksample.growth(rows, REGION, "delivery", list(range(1, 8)))


_SEEN = """seen as (select img_id, any_value(poly) as poly, arg_min(pos, (delivery, pos)) as seq, arg_min(pos, (delivery, pos)) // 80 as block
 from instances {where} group by img_id, poly::varchar, case when poly is null or img_id is null then pos end)"""
_P2 = f"with {_SEEN.format(where='')} select img_id, coalesce(array_to_string(poly, ','), '') as poly, seq, block from ({blocksample.floyd_sql('block', 80, 8, 's1')}) where list_contains(got8, seq % 80)"


# 3 -----------------------------------------------------------------------------------------------


def _odd(spark: SparkSession, d: str) -> DataFrame:
    tables = [("instances", _t(spark, d, "instances"), "pos", ["raw_text", "text"]), ("gold_sheet", _t(spark, d, "gold_sheet"), "idx", ["public_label", "gold_pass1"])]
    return lookalike.out_of_form(tables, ["raw_text", "public_label", "gold_pass1"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Values that are not in the one form."""
    return _odd(spark, d).select("tbl", "row_key", "field")


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    """Each such value with its form."""
    return _odd(spark, d)


# 4 -----------------------------------------------------------------------------------------------


def _measured(spark: SparkSession, d: str) -> DataFrame:
    """Each measured region once: the first load of a row counts."""
    f = _t(spark, d, "feats")
    first = F.min_by(F.struct("source", "split", "measured_on", *METRICS), F.struct("loaded_at", "measured_on")).alias("x")
    return f.groupBy("pos").agg(first).select("pos", "x.*")


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of every measure by source, split and day."""
    dims = {"source": F.col("source"), "split": F.col("split"), "day": F.col("measured_on")}
    got = percentiles.exact_percentiles(_measured(spark, d), dims, METRICS, PS)
    return got.select("dim", "grp", "metric", "p", "n", F.round("value", 6).alias("value"))


def p4_combined(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of the percentiles of each source, read from the merged summaries of single days."""
    days = percentiles.cell_counts(_measured(spark, d), {"source": F.col("source"), "day": F.col("measured_on")}, METRICS)
    whole = percentiles.merge_counts(days, ["source"])
    return percentiles.from_counts(whole, ["source"], PS)


_M = "with m as (select pos, arg_min(r, (loaded_at, measured_on)) as r from (select pos, loaded_at, measured_on, {'source': source, 'split': split, 'measured_on': measured_on, 'height': height, 'contrast': contrast, 'tilt': tilt} as r from feats) group by pos)"
_V = " union all ".join(f"select r.source as source, r.split as split, r.measured_on as day, '{m}' as metric, r.{m}::double as v from m where r.{m} is not null and not isnan(r.{m}::double)" for m in METRICS)
_PV = ", ".join(f"({p}::double)" for p in PS)
_BY = " union all ".join(f"select '{n}' as dim, {c}::varchar as grp, metric, v from v" for n, c in (("source", "source"), ("split", "split"), ("day", "day")))
_P4 = f"{_M}, v as ({_V}), g as ({_BY}), a as (select dim, grp, metric, count(*) as n, " + ", ".join(f"quantile_cont(v, {p}) as q{i}" for i, p in enumerate(PS)) + " from g group by 1, 2, 3) " + " union all ".join(f"select dim, grp, metric, {p}::double as p, n, round(q{i}, 6) as value from a" for i, p in enumerate(PS))
_CELL = "case when v = 0 then 0 else sign(v) * floor(abs(v) / pow(2, floor(log2(abs(v)))) * 256) / 256 * pow(2, floor(log2(abs(v)))) end"
_P4C = f"""{_M}, v as ({_V}), a as (select source, metric, v, row_number() over (partition by source, metric order by v) - 1 as rk, count(*) over (partition by source, metric) as n from v),
h as (select a.*, p from a, (values {_PV}) as w(p) where rk = floor(round(p * (n - 1), 9)))
select source, metric, p, n, case when v = 0 then 0.0 else {_CELL} end as lo, case when v = 0 then pow(2, -1023) * (1 + 1.0 / 256) else {_CELL} + pow(2, floor(log2(abs(v)))) / 256 end as hi from h"""


# 5 -----------------------------------------------------------------------------------------------


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of images, one in train and one in val or test, with the same or nearly the same texts."""
    got = crossleak.overlapping_images(crossleak.image_texts(_t(spark, d, "instances")))
    return got.select(F.least("e", "t").alias("img_id_lo"), F.greatest("e", "t").alias("img_id_hi"))


def p5_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation split and source: texts, texts also in train, images, images also in train."""
    texts = settle(crossleak.image_texts(_t(spark, d, "instances")))
    exact = crossleak.exact_overlap(texts)
    hit = crossleak.overlapping_images(texts).select(F.col("e").alias("img_id")).distinct()
    first = texts.where("split <> 'train'").groupBy("img_id").agg(F.min("split").alias("split"), F.min("source").alias("source"))
    images = first.join(hit.withColumn("hit", F.lit(1)), "img_id", "left").groupBy("split", "source").agg(F.count("*").alias("n_images"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_images_in_train"))
    images = images.withColumnsRenamed({"split": "_s", "source": "_o"})
    return exact.join(images, (F.col("split") == F.col("_s")) & F.col("source").eqNullSafe(F.col("_o")), "left").drop("_s", "_o")


# 6 -----------------------------------------------------------------------------------------------


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return settle(tokens.token_counts(_t(spark, d, "documents"), "doc_id", "text", ["source"]))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """The place of every document, or piece of one, in the containers of each capacity."""
    sized = _sized(spark, d)
    out = None
    for r in _t(spark, d, "pack_limits").orderBy("container").collect():
        part = packing.pack(sized, "doc_id", r["capacity_tokens"]).select(F.lit(r["container"]).alias("container"), "doc_id", "piece", "start", "size", F.col("container").alias("number"))
        out = part if out is None else out.union(part)
    return out


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, the least possible by volume, and the part of their room that is filled."""
    room = _t(spark, d, "pack_limits").withColumnRenamed("container", "_c")
    used = p6_packed(spark, d).groupBy("container", "number").agg(F.sum("size").alias("held"))
    got = used.groupBy("container").agg(F.count("*").alias("n_containers"), F.sum("held").alias("n_tokens"), F.max("held").alias("fullest"))
    got = got.join(F.broadcast(room), F.col("container") == F.col("_c")).drop("_c")
    return got.select("*", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least"), F.round(F.col("n_tokens") / F.col("n_containers") / F.col("capacity_tokens"), 6).alias("filled"))


# 7 -----------------------------------------------------------------------------------------------


def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The records of every mix with their places."""
    return mixing.mix(_sized(spark, d), _t(spark, d, "mix_targets"), "doc_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of tokens each source reaches in each mix."""
    return mixing.reached(p7_mixed(spark, d), _t(spark, d, "mix_targets"))


# 8 -----------------------------------------------------------------------------------------------


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.score_documents(_t(spark, d, "documents"), _t(spark, d, "rated_texts"), "doc_id", "text", ["source"])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold abusive, hateful or sexually explicit language."""
    return _scored(spark, d).where("is_case").select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document, with its passages."""
    return _scored(spark, d).select("doc_id", "source", "n_words", F.round("best", 4).alias("score"), F.round("e_value", 9).alias("e_value"), F.size("passages").alias("n_passages"), "is_case")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate of such documents in every source."""
    return toxicity.rates(_scored(spark, d), ["source"])


_P1 = r"""with recursive e as (select distinct img_id, regexp_extract(regexp_extract(regexp_replace(img_path, '(?s)\?.*$', ''), '([^/\\]*)$', 1), '(?i)^\s*im0*([0-9]+)', 1) as k from instances),
p as (select distinct a.img_id as x, b.img_id as y from e a join e b on a.k = b.k and a.img_id <> b.img_id where a.k <> ''),
r as (select x, y from p union select r.x, p.y from r join p on r.y = p.x)
select x as img_id_lo, y as img_id_hi from r where x < y"""
_P2G = f"with " + ", ".join(_SEEN.format(where=f"where delivery <= {d}").replace("seen as", f"seen{d} as", 1) for d in range(1, 8)) + " " + " union all ".join(f"select {d} as upto, count(*) filter (list_contains(got8, seq % 80)) as chosen, 0::bigint as lost from ({blocksample.floyd_sql('block', 80, 8, 's1').replace('from seen', f'from seen{d}')})" for d in range(1, 8))


def queries():
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit() and callable(v)}


def oracle_sql():
    return {"p1_found": _P1, "p2_sample": _P2, "p2_growth": _P2G, "p4_percentiles": _P4, "p4_combined": _P4C}
