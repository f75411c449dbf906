"""Detection: overlaps, greedy matching, precision and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrain.functions.geometry import bbox, overlap, quad_overlap
from inkgrain.operators.greedy import match_images
from inkgrain.session import settle

# The thresholds of overlap, and the part of a prediction that a do-not-care region must hold.
THRESHOLDS = [0.5, 0.6, 0.7, 0.8, 0.9]
COVER = 0.5


def free_patches(patches: DataFrame, boxes: DataFrame, image: str = "img_id") -> DataFrame:
    """Patches ``(img, x0, y0, x1, y1)`` that overlap no box ``(img, poly)`` of their image.

    Patches and boxes meet by image and grid square, so an image with very many regions spreads over
    tasks; a patch is free when it is in none of its squares.  Equal patches share one answer; an image or
    place that is null overlaps nothing.  Where patches have a column ``std``, plain ones (under 1) are not kept.
    """
    if "std" in patches.columns:
        patches = patches.where(F.col("std") >= 1)
    own = [image, "x0", "y0", "x1", "y1"]
    p = patches.select(*own).distinct().where(" and ".join(f"{c} is not null" for c in own) + " and x0 < x1 and y0 < y1")
    p = p.withColumn("cx", _span("x0", "x1")).withColumn("cy", _span("y0", "y1"))
    b = boxes.select(F.col(image).alias("_i"), bbox(F.col("poly")).alias("b")).select("_i", "b.*").toDF("_i", "bx0", "by0", "bx1", "by1")
    b = b.where("bx0 is not null and by0 is not null").withColumn("_cx", _span("bx0", "bx1")).withColumn("_cy", _span("by0", "by1"))
    meet = (F.col(image) == F.col("_i")) & (F.col("cx") == F.col("_cx")) & (F.col("cy") == F.col("_cy")) & (F.col("x0") < F.col("bx1")) & (F.col("bx0") < F.col("x1")) & (F.col("y0") < F.col("by1")) & (F.col("by0") < F.col("y1"))
    taken = p.join(b, meet, "left_semi").select(*own).distinct().withColumnsRenamed({c: f"_{c}" for c in own})
    same = F.lit(True)
    for c in own:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return patches.join(taken, same, "left_anti")


CELL = 256  #: side of the grid squares by which boxes meet, in pixels


def _span(lo: str, hi: str) -> Column:
    """The grid lines a stretch touches, one a row."""
    return F.explode(F.sequence(F.floor(F.col(lo) / CELL), F.floor(F.col(hi) / CELL)))


def _on_grid(boxes: DataFrame, image: str, side: str) -> DataFrame:
    """Each box once for every grid square it touches, columns marked by *side*."""
    b = boxes.select(F.col(image).alias("img"), F.col("pos").alias(f"pos_{side}"), F.col("poly").alias(f"poly_{side}"), bbox(F.col("poly")).alias(f"b_{side}"))
    b = b.where(F.col(f"b_{side}.x0").isNotNull() & F.col(f"b_{side}.y0").isNotNull())
    return b.withColumn("cx", _span(f"b_{side}.x0", f"b_{side}.x1")).withColumn("cy", _span(f"b_{side}.y0", f"b_{side}.y1"))


def overlapping_pairs(a: DataFrame, b: DataFrame, image: str = "img_id", iou: float = 0.0, cover: float | None = None) -> DataFrame:
    """``(img, pos_a, pos_b, iou, cover)`` of the quads of two sets whose boxes share area, where the overlap may
    reach *iou* or the part of the first one *cover*.  What two quads share lies within what their boxes share,
    so pairs that can reach neither are left out before the quads are cut.

    Boxes meet by image and grid square, so an image with very many regions spreads over tasks, and
    a pair is kept only in the square of the shared part's first corner, so none comes twice.
    """
    j = _on_grid(a, image, "a").join(_on_grid(b, image, "b"), ["img", "cx", "cy"])
    x, y = F.greatest("b_a.x0", "b_b.x0"), F.greatest("b_a.y0", "b_b.y0")
    meet = (x < F.least("b_a.x1", "b_b.x1")) & (y < F.least("b_a.y1", "b_b.y1")) & (F.floor(x / CELL) == F.col("cx")) & (F.floor(y / CELL) == F.col("cy"))
    shared = (F.least("b_a.x1", "b_b.x1") - x) * (F.least("b_a.y1", "b_b.y1") - y)
    area_a, area_b = _shoelace(F.col("poly_a")), _shoelace(F.col("poly_b"))
    enough = shared * 1.000001 >= F.greatest(area_a, area_b) * iou
    if cover is not None:
        enough = enough | (shared * 1.000001 >= area_a * cover)
    return j.where(meet & F.coalesce(enough, F.lit(True))).withColumn("o", quad_overlap("poly_a", "poly_b")).select("img", "pos_a", "pos_b", "o.iou", "o.cover")


GATHER = 3_000_000  #: boxes of an image that one task may hold
PART = 25_000  #: boxes of small images that go together


def match(boxes: DataFrame, thresholds: list[float] = THRESHOLDS, gather: int = GATHER) -> DataFrame:
    """``boxes(img_id, pos, poly, kind)`` with kind gt, dontcare or pred -> ``(thr, tp, fp, fn)``.

    Predictions are taken in order of ``pos``; each takes the best unmatched truth by strictly
    greater overlap and matches at the threshold (J4).  An unmatched prediction that meets a
    do-not-care region (by overlap, or half its area) is not counted (J5).  Truths without area are
    left out.

    An image with at most ``GATHER`` boxes is matched in one task, small ones with others, by the rule as it reads; only
    the boxes and the overlaps of a block of predictions are held.  Of larger
    ones no image is gathered: a prediction whose best open truth is wanted by no earlier open prediction
    has it for sure; all such are matched at once, and again until none wants an open truth.  Both ways
    give the same matches.  No boxes give no rows.
    """
    thr = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("thr")
    flat = boxes.where((F.size("poly") == 8) & ((F.col("kind") != "gt") | (_shoelace(F.col("poly")) > 0)))
    flat = flat.select(F.col("img_id").alias("img"), "pos", "kind", *[F.get("poly", F.lit(i)).cast("double").alias(f"p{i}") for i in range(8)])
    all_flat = settle(flat)
    flat = all_flat.where("img is not null")
    # at most a row for PART boxes
    large = settle(flat.groupBy("img").agg(F.count("*").alias("n")).where(F.col("n") > min(gather, PART)).withColumnRenamed("img", "_img"))
    many = large.where(F.col("n") > gather).select(F.col("_img").alias("img"))
    parts = F.lit(max(1, -(-flat.count() // PART)))
    number = F.xxhash64("img")
    few = flat.join(F.broadcast(large), F.col("img") == F.col("_img"), "left").where(F.coalesce(F.col("n") <= gather, F.lit(True)))
    few = few.withColumn("part", F.when(F.col("n").isNotNull(), number).otherwise(F.pmod(number, parts))).drop("_img", "n")
    counted = few.groupBy("part").applyInPandas(lambda x: match_images(x, thresholds, COVER), "thr double, tp long, ex long")
    got = counted if many.isEmpty() else counted.unionByName(_in_rounds(boxes, many, thresholds))
    got = settle(got).groupBy("thr").agg(F.sum("tp").alias("tp"), F.sum("ex").alias("ex"))
    sizes = all_flat.agg(F.count_if(F.col("kind") == "pred").alias("n_pred"), F.count_if(F.col("kind") == "gt").alias("n_gt"))
    all_ = sizes.where("n_pred + n_gt > 0").select("n_pred", "n_gt", thr)
    got = all_.join(got, "thr", "left").fillna(0, ["tp", "ex"])
    return got.select("thr", "tp", (F.col("n_pred") - F.col("tp") - F.col("ex")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"))


def _in_rounds(boxes: DataFrame, images: DataFrame, thresholds: list[float]) -> DataFrame:
    """``(thr, tp, ex)`` of *images* (img) that no task holds."""
    kind = lambda k: boxes.where((F.col("kind") == k) & (F.size("poly") == 8)).join(F.broadcast(images), F.col("img_id") == F.col("img"), "left_semi").select("img_id", "pos", "poly")
    truth = kind("gt").where(_shoelace(F.col("poly")) > 0)
    pred = kind("pred")
    thr = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("thr")
    met = overlapping_pairs(pred, truth, iou=min(thresholds)).where(F.col("iou") >= min(thresholds))
    edges = settle(met.select("img", "pos_a", "pos_b", "iou", thr).where("iou >= thr"))
    key = ["thr", "img"]
    matched = edges.select(*key, "pos_a", "pos_b").limit(0)
    while not edges.isEmpty():
        top = edges.groupBy(*key, "pos_a").agg(F.min_by("pos_b", F.struct(-F.col("iou"), F.col("pos_b"))).alias("pos_b"))
        head = edges.groupBy(*key, "pos_b").agg(F.min("pos_a").alias("pos_a"))
        won = settle(top.join(head, [*key, "pos_a", "pos_b"]))
        matched = matched.unionByName(won)
        edges = settle(edges.join(won.select(*key, "pos_a"), [*key, "pos_a"], "left_anti").join(won.select(*key, "pos_b"), [*key, "pos_b"], "left_anti"))
    tp = matched.groupBy("thr").agg(F.count("*").alias("n"))
    excused = overlapping_pairs(pred, kind("dontcare"), iou=min(thresholds), cover=COVER).select("img", "pos_a", "iou", "cover", thr).where((F.col("iou") >= F.col("thr")) | (F.col("cover") >= COVER)).select(*key, "pos_a").distinct()
    excused = excused.join(matched, [*key, "pos_a"], "left_anti")
    ex = excused.groupBy("thr").agg(F.count("*").alias("ex"))
    return tp.withColumnRenamed("n", "tp").join(ex, "thr", "full").fillna(0, ["tp", "ex"]).select("thr", "tp", "ex")


def _shoelace(p: Column) -> Column:
    """Area of a quad given as eight numbers."""
    at = lambda i: F.get(p, F.lit(i % 8)).cast("double")
    return F.abs(sum((at(2 * i) * at(2 * i + 3) - at(2 * i + 2) * at(2 * i + 1) for i in range(4)), F.lit(0.0))) / 2


def match_one_image(part: list[tuple[int, list[float], str]], thr: float) -> tuple[int, int, int]:
    """``(tp, fp, fn)`` of one image by the rule as it reads, for tests: rows ``(pos, poly, kind)``."""
    part = sorted(part, key=lambda r: r[0])
    truths = [p for _, p, k in part if k == "gt" and overlap(p, p)[0] > 0]
    care = [p for _, p, k in part if k == "dontcare"]
    iou = lambda o: o[2] / (o[0] + o[1] - o[2]) if o[0] + o[1] - o[2] > 0 else 0.0
    used: set[int] = set()
    tp = fp = 0
    for p in [p for _, p, k in part if k == "pred"]:
        best, at = 0.0, -1
        for j, t in enumerate(truths):
            if j not in used and iou(overlap(p, t)) > best:
                best, at = iou(overlap(p, t)), j
        if at >= 0 and best >= thr:
            used.add(at)
            tp += 1
        elif not any(iou(o) >= thr or (o[0] > 0 and o[2] / o[0] >= COVER) for o in (overlap(p, t) for t in care)):
            fp += 1
    return tp, fp, len(truths) - tp


def precision_recall(matched: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 of each threshold."""
    g = matched.groupBy("thr").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.select("*", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 9).alias("f1"))
