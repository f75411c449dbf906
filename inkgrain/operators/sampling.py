"""Sampling, token banks, mixtures and set checks.

Order at random means order by the MD5 of a seed and a key, so that every rerun, partitioning and
engine draws the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrain.functions.text import clean_token, recase, word_list
from inkgrain.operators.detection import free_patches

# Parameters of the text sampler.
SINGLE, BANK, TWO_WORDS, DIGIT, SHORT_ONE = 0.06, 0.65, 0.01, 0.35, 0.45
MILD = (0.05, 0.30)
LETTERS = "aăâbcdđeêghiklmnoôơpqrstuưvxy"
HEIGHTS = [(8, 12, 0.13), (12, 19, 0.15), (19, 28, 0.20), (28, 40, 0.18), (40, 60, 0.14), (60, 105, 0.11), (105, 175, 0.09)]
STRATA = [("geometric", 0.40), ("photometric", 0.30), ("resolution", 0.30)]


def draw(seed: str, *key: Column) -> Column:
    """The hash that orders rows at random."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in key]))


def uniform(seed: str, *key: Column) -> Column:
    """A number in [0, 1) fixed by seed and key, of 52 bits."""
    return F.conv(F.substring(draw(seed, *key), 1, 13), 16, 10).cast("double") / 4503599627370496.0


def running(rows: DataFrame, key: str, seed: str, name: str, value: Column | None = None) -> DataFrame:
    """*rows* with ``name``: the sum of *value* (1 by default, which makes it a rank from 0) over the
    rows before it in random order.

    The order is that of the hash, cut by its first three digits into 4096 ranges; ranges are summed
    first, so no task sorts all rows.
    """
    value = F.lit(1) if value is None else value
    cut = rows.withColumn("_h", draw(seed, F.col(key))).withColumn("_b", F.substring("_h", 1, 3)).withColumn("_v", value)
    sums = cut.groupBy("_b").agg(F.sum("_v").alias("_s")).withColumn("_o", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("_b").alias("_c"), "_o")
    inside = F.coalesce(F.sum("_v").over(Window.partitionBy("_b").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn(name, inside).join(F.broadcast(sums), F.col("_b") == F.col("_c")).withColumn(name, F.col(name) + F.col("_o")).drop("_h", "_b", "_v", "_c", "_o")


def _rank(by: list[str], seed: str, key: str) -> Column:
    w = Window.partitionBy(*by).orderBy(draw(seed, F.col(key)), F.col(key))
    return F.row_number().over(w)


def _first_of_each(rows: DataFrame, stratum: str, key: str, share: Column, take, seed: str) -> DataFrame:
    """The first ``take(n, share)`` rows of each stratum in random order, with ``n_stratum`` and ``n_sample``.

    The cut is found from counts first and ranks are taken only among rows whose hash lies near it:
    rows are ranked within 4096 hash buckets, and buckets wholly under or over the cut need no rank
    beyond their count, so no task sorts a whole stratum.
    """
    h = draw(seed, F.col(key))
    cut = rows.withColumn("_h", h).withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    sizes = cut.groupBy(stratum, "_b").agg(F.count("*").alias("_n"), F.max(share).alias("_f"))
    w = Window.partitionBy(stratum)
    sizes = sizes.withColumn("_before", F.sum("_n").over(w.orderBy("_b")) - F.col("_n")).withColumn("n_stratum", F.sum("_n").over(w)).withColumn("n_sample", take(F.col("n_stratum"), F.max("_f").over(w)).cast("long"))
    left = sizes.where("_before < n_sample").withColumnsRenamed({stratum: "_s", "_b": "_c"}).drop("_n", "_f")
    got = cut.join(left, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_c")))
    got = got.withColumn("_r", F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_h", key)) + F.col("_before")).where("_r <= n_sample")
    return got.drop("_h", "_b", "_c", "_s", "_before", "_r")


def stratified_sample(rows: DataFrame, stratum: str, key: str, fractions: Column, seed: str) -> DataFrame:
    """Exactly ``bround(n * fraction)`` rows of each stratum, with the inclusion probability and its
    inverse as weight (G1, A22)."""
    got = _first_of_each(rows, stratum, key, fractions, lambda n, f: F.bround(n * f), seed)
    pi = F.col("n_sample") / F.col("n_stratum")
    return got.withColumn("pi_incl", pi).withColumn("ht_weight", 1 / pi)


def population_table(rows: DataFrame, stratum: str, fractions: Column) -> DataFrame:
    """``(stratum, n, k, pi_incl, ht_weight)``."""
    g = rows.groupBy(stratum).agg(F.count("*").alias("n"), F.bround(F.count("*") * F.max(fractions)).cast("long").alias("k"))
    return g.withColumn("pi_incl", F.round(F.col("k") / F.col("n"), 9)).withColumn("ht_weight", F.round(F.try_divide(F.col("n"), F.col("k")), 9))


def ht_rate(sample: DataFrame, by: list[str], hit: Column, weight: Column) -> DataFrame:
    """Horvitz-Thompson rate: weighted hits over weights."""
    return sample.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.try_divide(F.sum(weight * hit.cast("double")), F.sum(weight)), 9).alias("rate"))


def nested_subsets(rows: DataFrame, key: str, seed: str, shares: list[int]) -> DataFrame:
    """``(key, r)`` for each percentage r: the first ``bround(n * r / 100)`` rows in random order, so
    that smaller subsets lie within larger ones (W3, W4)."""
    ranked = running(rows.select(key), key, seed, "_r")
    n = rows.agg(F.count("*").alias("_n"))
    own = F.filter(F.array(*[F.struct(F.lit(r).alias("r"), F.bround(F.col("_n") * F.lit(r / 100.0)).alias("most")) for r in sorted(shares)]), lambda x: F.col("_r") < x["most"])
    return ranked.join(F.broadcast(n), F.lit(True)).select(key, F.explode(F.transform(own, lambda x: x["r"])).alias("r"))


def blind_subset(rows: DataFrame, stratum: str, key: str, share: float, seed: str, flag: Column | None = None) -> DataFrame:
    """At least one row of each stratum, else ``bround(share * n)`` (G2).  Dealt once: where *flag* holds for any
    row already, the rows it holds for stay the blind ones."""
    if flag is not None:
        dealt = rows.where(flag)
        if not dealt.isEmpty():
            return dealt
    got = _first_of_each(rows, stratum, key, F.lit(share), lambda n, f: F.greatest(F.lit(1), F.bround(n * f)), seed)
    return got.drop("n_stratum", "n_sample")


def background_patches(sizes: DataFrame, boxes: DataFrame, width: int, height: int, seed: str, tries: int = 12, most: int = 5_000) -> DataFrame:
    """``(img_id, try, x0, y0)``: for each image of ``sizes(img_id, side)`` the first of *tries* random places that
    overlaps no box ``(img_id, poly)``, for *most* images drawn at random (G11); the limit is the operator's."""
    at = lambda k, room: F.floor(uniform(f"{seed}/{k}", F.col("img_id"), F.col("try")) * F.greatest(F.col("side") - room + 1, F.lit(1))).cast("long")
    tried = sizes.select("img_id", "side", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("try"))
    places = tried.select("img_id", "try", at("x", width).alias("x0"), at("y", height).alias("y0")).select("*", (F.col("x0") + width).alias("x1"), (F.col("y0") + height).alias("y1"))
    first = free_patches(places, boxes).groupBy("img_id").agg(F.min(F.struct("try", "x0", "y0")).alias("x")).select("img_id", "x.*")
    return take_n(first, "img_id", most, seed)


def take_n(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """*n* rows at random, all of them where n is not positive or not under their number."""
    if n <= 0:
        return rows
    return running(rows, key, seed, "_r").where(F.col("_r") < n).drop("_r")


def token_bank(rows: DataFrame, text: str, vocab: str) -> DataFrame:
    """``(token, cnt)`` of cleaned lower-case tokens."""
    t = F.lower(clean_token(F.col("w"), vocab))
    words = rows.select(F.explode(word_list(F.col(text))).alias("w")).select(t.alias("token")).where("token is not null")
    return words.groupBy("token").agg(F.count("*").alias("cnt"))


def budgeted_prefix(rows: DataFrame, order: str, size: str, most: int, buckets: int = 200) -> DataFrame:
    """The first rows in ``order`` until *most* is reached; the row that reaches it is kept.

    Sums of ranges of ``order`` find the range in which the budget ends; only ranges up to it are
    summed row by row.
    """
    ends = rows.agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    w = F.greatest(F.lit(1.0), (F.col("hi") - F.col("lo") + 1) / buckets)
    cut = rows.crossJoin(F.broadcast(ends)).withColumn("_b", F.floor((F.col(order) - F.col("lo")) / w)).drop("lo", "hi")
    sums = cut.groupBy("_b").agg(F.sum(size).alias("_s")).withColumn("_start", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("_start") < most)
    got = cut.join(F.broadcast(sums.drop("_s")), "_b")
    before = F.coalesce(F.sum(size).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_start")
    return got.withColumn("_before", before).where(F.col("_before") < most).drop("_b", "_start", "_before")


def in_bank(rows: DataFrame, text: str, bank: DataFrame, bank_text: str, within: bool = True) -> DataFrame:
    """Rows whose text is (or is not) in the bank."""
    b = bank.select(F.col(bank_text).alias("_t")).distinct()
    return rows.join(b, F.col(text) == F.col("_t"), "left_semi" if within else "left_anti")


def reading_order(rows: DataFrame, picture: str = "img_id", poly: str = "poly", key: str = "pos") -> DataFrame:
    """Rows by picture, then by polygon number by number, then by key."""
    return rows.orderBy(picture, poly, key)


def bank_counts(rows: DataFrame, text: str, bank: DataFrame, bank_text: str, by: list[str]) -> DataFrame:
    """``(*by, in_bank, beyond)``: rows within and beyond the bank by one join."""
    b = bank.select(F.col(bank_text).alias("_t")).distinct().withColumn("_in", F.lit(1))
    each = rows.groupBy(*by, text).agg(F.count("*").alias("_n")).join(b, F.col(text) == F.col("_t"), "left")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0))
    return each.groupBy(*by).agg(n(F.col("_in").isNotNull()).alias("in_bank"), n(F.col("_in").isNull()).alias("beyond"))


def pool(parts: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """UNION ALL with the part's name, duplicates kept, carriage returns dropped."""
    out = None
    for name, df in parts.items():
        p = df.select(*[F.regexp_replace(F.col(c), "\r", "").alias(c) if t == "string" else F.col(c) for c, t in df.select(*columns).dtypes], F.lit(name).alias("part"))
        out = p if out is None else out.unionByName(p)
    return out


def composition(pooled: DataFrame) -> DataFrame:
    """Rows and share of each part."""
    g = pooled.groupBy("part").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))


def shared_keys(rows: DataFrame, group: str, key: str) -> DataFrame:
    """``(a, b, n)``: keys that two groups share (U3, U6); disjoint groups give no row."""
    d = rows.select(group, key).where(F.col(key).isNotNull()).distinct()
    per = d.groupBy(key).agg(F.sort_array(F.collect_set(group)).alias("gs")).where(F.size("gs") > 1)
    pairs = per.select(F.explode(F.flatten(F.transform("gs", lambda x, i: F.transform(F.slice("gs", i + 2, F.size("gs")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.*")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def _pick(u: Column, weighted: list[tuple[Column, float]]) -> Column:
    """The value whose cumulative weight first exceeds u."""
    out, left = weighted[-1][0], sum(w for _, w in weighted)
    ends, run = [], 0.0
    for v, w in weighted[:-1]:
        run += w / left
        ends.append((v, run))
    for v, end in reversed(ends):
        out = F.when(u < end, v).otherwise(out)
    return out


def synthetic_draws(n: int, bank: DataFrame, tokens: DataFrame, seed: str, spark, short_rate: float = 0.0, strata: bool = False) -> DataFrame:
    """``(i, kind, text, height, severity, stratum)``: *n* draws of the sampler.

    A single letter or digit, a short string of one or two (at ``short_rate``), a scene text, or one word drawn
    by its count, now and then two; words meet draws by a join of hash buckets of cumulative counts, not
    by a search of the whole bank in every row.  With *strata* the severity is uniform in ``MILD``.
    """
    i = spark.range(n).withColumnRenamed("id", "i")
    u = lambda k: uniform(f"{seed}/{k}", F.col("i"))

    def one(k: str) -> Column:
        letter = F.substring(F.lit(LETTERS), F.floor(u(f"l{k}") * len(LETTERS)).cast("int") + 1, F.lit(1))
        return F.when(u(f"d{k}") < DIGIT, F.floor(u(f"n{k}") * 10).cast("string")).otherwise(F.when(u(f"u{k}") < 0.68, F.upper(letter)).otherwise(letter))

    scene = running(bank.select("text").distinct(), "text", seed, "_r")
    words = running(tokens, "token", seed, "_from", F.col("cnt")).withColumn("_to", F.col("_from") + F.col("cnt"))
    n_scene, n_words = scene.count(), words.agg(F.max("_to")).first()[0] or 0
    rows = i.withColumn("kind", F.when((u("k") < SINGLE) | F.lit(not n_scene and not n_words), "single").when(u("sh") < short_rate, "short").when((u("b") < BANK) & F.lit(n_scene > 0) | F.lit(not n_words), "scene").otherwise("word"))
    rows = rows.withColumn("_pick", F.when(F.col("kind") == "scene", F.floor(u("s") * n_scene)).when(F.col("kind") == "word", F.floor(u("w") * n_words)))
    a = rows.where("kind in ('single', 'short')").select("i", "kind", F.when((F.col("kind") == "short") & (u("s2") >= SHORT_ONE), F.concat(one(""), one("b"))).otherwise(one("")).alias("text"))
    b = rows.where("kind = 'scene'").join(scene, F.col("_pick") == F.col("_r")).select("i", "kind", "text")
    step = max(1, n_words // 1000)
    spans = words.withColumn("_g", F.explode(F.sequence(F.floor(F.col("_from") / step), F.floor((F.col("_to") - 1) / step))))
    more = F.when(u("two") < TWO_WORDS, F.array(F.struct(F.lit(0).alias("k"), F.col("_pick").alias("p")), F.struct(F.lit(1).alias("k"), F.floor(u("w2") * n_words).alias("p")))).otherwise(F.array(F.struct(F.lit(0).alias("k"), F.col("_pick").alias("p"))))
    c = rows.where("kind = 'word'").select("i", "kind", F.inline(more)).withColumn("_g", F.floor(F.col("p") / step)).join(spans, "_g").where("_from <= p and p < _to")
    c = c.groupBy("i", "kind").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "token"))), lambda x: x["token"]), " ").alias("text")).select("i", "kind", recase(F.col("text"), u("c")).alias("text"))
    severity = u("sev") * (MILD[1] - MILD[0]) + MILD[0] if strata else F.pow(u("sev"), 1.5)
    height = _pick(u("h"), [(F.floor(u("hh") * (hi - lo)).cast("int") + lo, w) for lo, hi, w in HEIGHTS])
    return a.union(b).union(c).select("i", "kind", "text", height.alias("height"), F.round(severity, 9).alias("severity"), _pick(u("st"), [(F.lit(s), w) for s, w in STRATA]).alias("stratum"))
