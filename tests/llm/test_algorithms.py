"""Problems 1, 2, 4, 5: against brute force, with nulls, repeats, empty tables and clashing names."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrain.llm import blocksample, components, crossleak, percentiles, splits

SHARES = {"train": 0.6, "val": 0.15, "test": 0.25}


def closure(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(5, 5), (None, 3), (7, None)]
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    want = closure([e for e in edges if None not in e and e[0] != e[1]])
    assert got == want


def test_photo_number(spark):
    names = ["data/v/train_images/im00001003.jpg", "data\\v\\t\\IM1003 (1).JPG", "./im01003_2.webp?v=3/im9", "a/../b/im1003-crop3.png", "x/no_image.png", "x/im.jpg", "im7/other.jpg", "", None, "im0000.jpg", "file:///d/im2507%20(1).jpg"]
    rows = spark.createDataFrame([(n,) for n in names], "p string").select(splits.photo_number(F.col("p"))).collect()
    assert [r[0] for r in rows] == ["1003", "1003", "1003", "1003", None, None, None, None, None, "0", "2507"]


def grouped(spark, rows):
    df = spark.createDataFrame(rows, "img_id int, img_path string, source string, split int, c int")
    return splits.grouped_split(df, "img_id", splits.photo_number(F.col("img_path")), F.col("source"), SHARES, 50)


def test_groups_stay_together_and_shares_hold(spark):
    r = random.Random(1)
    rows = [(i, f"d/im{i if r.random() < 0.9 else r.randrange(300)}.jpg" if r.random() < 0.97 else None, r.choice(["a"] * 6 + ["b", None]), 1, 2) for i in range(300) for _ in range(r.randint(1, 12))]
    rows += [(999, "d/im999.jpg", "a", 1, 2)] * 300 + [(None, None, "a", None, None)] * 3
    got = grouped(spark, rows).collect()
    assert sum(g["n_rows"] for g in got) == len(rows)
    split = {g["img_id"]: g["split"] for g in got}
    assert len(split) == len(got)
    photo = lambda p: p and p.split("im")[1].split(".")[0]
    want = closure([(i, "p" + photo(p)) if False else (str(i), "p" + photo(p)) for i, p, *_ in rows if p])
    groups = {}
    for i in {i for i, p, *_ in rows if p}:
        groups.setdefault(want[str(i)], set()).add(i)
    assert all(len({split[i] for i in g}) == 1 for g in groups.values())
    pairs = {tuple(p) for p in splits.linked_pairs(grouped(spark, rows), "img_id").collect()}
    assert pairs == {tuple(sorted(p)) for g in groups.values() for p in itertools.combinations(g, 2)}
    for s, w in SHARES.items():
        assert abs(sum(g["n_rows"] for g in got if g["split"] == s) / len(rows) - w) < 0.02


def test_split_of_nothing(spark):
    assert grouped(spark, []).count() == 0
    with pytest.raises(ValueError):
        splits.grouped_split(spark.createDataFrame([], "a int"), "a", F.lit(None), F.lit(None), {})


def test_stratify_needs_every_component_once():
    sizes = {str(i): {"a": i % 3, splits.ALL: 3} for i in range(20)}
    got = splits.stratify(sizes, {"x": {"a": 10.0, splits.ALL: 30.0}, "y": {"a": 10.0, splits.ALL: 30.0}})
    assert set(got) == set(sizes) and set(got.values()) == {"x", "y"}


def regions(spark, rows):
    return spark.createDataFrame(rows, "img_id int, poly array<int>, delivery int, pos long, seq int, block string, _rank int")


def test_sample_only_grows(spark):
    r = random.Random(3)
    rows, pos = [], 0
    for d in range(1, 6):
        for _ in range(400):
            again = rows and r.random() < 0.2
            old = r.choice(rows) if again else None
            late = r.random() < 0.05
            rows.append((old[0] if old else 7 if r.random() < 0.3 else r.randrange(50), old[1] if old else ([r.randrange(9999), pos] if r.random() < 0.97 else None), min(5, d + 2) if late else d, old[3] if old and r.random() < 0.5 else pos, 1, "x", 2))
            pos += 1
    rows.append((1, [1], None, 90000, 1, "x", 2))
    rows.append((1, [1], 1, None, 1, "x", 2))
    df = regions(spark, rows)
    pick = lambda x: {(i["img_id"], tuple(i["poly"] or ()), i["seq"]) for i in blocksample.block_sample(x, ["img_id", "poly"], ["delivery"]).collect()}
    last = set()
    for d in range(1, 6):
        now = pick(df.where(F.col("delivery") <= d))
        assert last <= now and now == pick(df.where(F.col("delivery") <= d).union(df.where(F.col("delivery") <= d)).repartition(3))
        last = now
    assert len(last) == len({k[:2] if k[1] else k for k in last})
    assert 0.05 < len(last) / 1700 < 0.16


def test_exactly_so_many_positions(spark):
    df = spark.range(200).select(blocksample.chosen_positions(F.col("id"), 80, 8, "s").alias("p"))
    for r in df.collect():
        assert len(set(r["p"])) == 8 and all(0 <= x < 80 for x in r["p"])
    assert blocksample.block_sample(regions(spark, []), ["img_id", "poly"], ["delivery"]).count() == 0
    with pytest.raises(ValueError):
        blocksample.block_sample(regions(spark, []), ["img_id"], ["delivery"], take=81)


def test_keys_order_as_doubles(spark):
    v = [0.0, -0.0, 1.0, -1.0, 0.1, 1e300, -1e300, 2.0**-1000, 3.0, 4.0, 7.999999999999999, 8.0, math.inf, -math.inf, 1e-3]
    rows = spark.createDataFrame([(x,) for x in v], "v double").select("v", percentiles.order_key(F.col("v")).alias("k")).select("v", "k", percentiles.key_value(F.col("k")).alias("b")).collect()
    assert all(r["v"] == r["b"] for r in rows)
    assert [r["v"] for r in sorted(rows, key=lambda r: r["k"])] == sorted(v)
    odd = spark.createDataFrame([(None,), (math.nan,)], "v double").select(percentiles.order_key(F.col("v"))).collect()
    assert [r[0] for r in odd] == [None, None]


@pytest.mark.parametrize("bits", [2, 12])
def test_percentiles_are_exact(spark, bits):
    r = random.Random(5)
    data = [(r.choice(["hot"] * 5 + ["b", None]), r.choice([r.gauss(0, 1), r.randrange(3) * 1.0, -r.expovariate(1e-6), math.nan, None]), r.randrange(4)) for _ in range(3000)] + [("one", 4.5, 1), ("none", None, None)]
    df = spark.createDataFrame(data, "g string, x double, y int").withColumn("key", F.lit(1)).withColumn("dim", F.lit(2))
    ps = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {(r["grp"], r["metric"], r["p"]): r["value"] for r in percentiles.exact_percentiles(df, {"g": F.col("g")}, ["x", "y"], ps, bits, 16).collect()}
    for g in {d[0] for d in data}:
        for m, i in (("x", 1), ("y", 2)):
            v = [d[i] for d in data if d[0] == g and d[i] is not None and not math.isnan(d[i])]
            for p in ps:
                assert got.get((g, m, p)) == (pytest.approx(float(np.percentile(v, p * 100)), rel=1e-12, abs=1e-12) if v else None)
    assert percentiles.exact_percentiles(df.limit(0), {"g": F.col("g")}, ["x"], ps).count() == 0


def test_summaries_merge(spark):
    r = random.Random(6)
    df = spark.createDataFrame([(r.randrange(9), r.gauss(5, 3) * 10 ** r.randrange(3)) for _ in range(2000)] + [(1, None), (2, math.nan), (3, 0.0)], "day int, x double")
    days = percentiles.cell_counts(df, {"day": F.col("day")}, ["x"])
    merged = percentiles.merge_counts(days.withColumn("a", F.lit("all")), ["a"])
    v = sorted(x["x"] for x in df.collect() if x["x"] is not None and not math.isnan(x["x"]))
    for row in percentiles.from_counts(merged, ["a"], [0.0, 0.1, 0.5, 0.9, 1.0]).collect():
        x = v[math.floor(row["p"] * (len(v) - 1))]
        assert row["lo"] <= x <= row["hi"] and row["hi"] - row["lo"] <= 2**-8 * max(abs(row["lo"]), abs(row["hi"])) + 1e-300


def images(spark, rows):
    return spark.createDataFrame(rows, "img_id int, poly array<int>, pos long, delivery int, text string, scorable boolean, split string, source string, n int, form string")


def test_overlap_against_brute_force(spark):
    r = random.Random(8)
    words = ["phở", "bò", "xe", "máy", "giặt", "ủi", "trà", "sữa", "cửa", "hàng", "linh", "minh", "hoa", "cơm"]
    texts = {i: [" ".join(r.choices(words, k=r.randint(1, 4))) + r.choice(["", f" {r.randrange(999)}"]) for _ in range(r.randint(5, 14))] for i in range(60)}
    for i in range(60, 80):
        src = list(texts[r.randrange(60)])
        texts[i] = [t[:-1] + "z" if len(t) > 9 and r.random() < 0.4 else t.upper() for t in src[: r.randint(len(src) * 2 // 3, len(src))]]
    rows, pos = [], 0
    for i, ts in texts.items():
        for t in ts:
            rows.append((i, [pos, 1], pos, 1, t, True, ["train", "val", "test"][i % 3], None if i % 5 == 0 else "s", 1, "x"))
            if r.random() < 0.2:
                rows.append((i, [pos, 1], 9000 + pos, 2, t, True, ["train", "val", "test"][i % 3], "s", 1, "x"))
            pos += 1
    rows += [(None, [1], 1, 1, "a", True, "val", "s", 1, "x"), (3, None, 20000, 1, None, True, "val", "s", 1, "x"), (3, None, 20001, 1, "###", False, "val", "s", 1, "x")]
    t = crossleak.image_texts(images(spark, rows))
    got = {tuple(x) for x in crossleak.overlapping_images(t).collect()}
    low = {i: [x.lower() for x in ts] for i, ts in texts.items() if len(ts) >= 8}
    want = set()
    for a, b in itertools.product(low, low):
        if a % 3 and not b % 3:
            big = max(len(low[a]), len(low[b]))
            need = -(-big * 2 // 3)
            if crossleak.matched(low[a], low[b], need):
                want.add((a, b))
    assert want and got == want
    rates = {(x["split"], x["source"]): x for x in crossleak.exact_overlap(t).collect()}
    assert sum(x["n_texts"] for x in rates.values()) == sum(len(ts) for i, ts in texts.items() if i % 3)
    empty = crossleak.image_texts(images(spark, []))
    assert crossleak.overlapping_images(empty).count() == 0 and crossleak.exact_overlap(empty).count() == 0


def test_one_edit_leaves_a_common_hash(spark):
    r = random.Random(2)
    pairs = [("abcd", "abcde"), ("abc def g", "abc def gh"), ("hẹn gặp6lại", "hẹn gặp lại"), ("rửa xe6phục vụ", "rửa xe phục vụ"), ("rửa xephục vụ", "rửa xe phục vụ")]
    while len(pairs) < 400:
        a = "".join(r.choices("abcdeghi   ", k=r.randint(5, 30)))
        i, ch = r.randrange(len(a)), r.choice("xyz ")
        b = r.choice([a[:i] + ch + a[i + 1 :], a[:i] + ch + a[i:], a[:i] + a[i + 1 :]])
        a, b = " ".join(a.split()), " ".join(b.split())
        if len(a) >= 5 and len(b) >= 4 and a != b and crossleak.near(a, b) and abs(len(a) - len(b)) < 2:
            pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    keys = lambda c: F.transform(crossleak.hashes(crossleak.squash(F.col(c))), lambda h: h["key"])
    assert df.where(~F.arrays_overlap(keys("a"), keys("b"))).collect() == []


def test_texts_without_a_hash_partner_take_no_probes(spark):
    """Six of eight texts match, one of them without a common hash; the others are found by the five."""
    same = ["cà phê", "bánh mì", "sửa xe máy", "nhà thuốc tây", "điện thoại"]
    texts = {0: [*same, "phở bò tái nạm gầu", "alpha omega", "kilo tango"], 1: [*same, "phờ bò tải nạm gâu", "hàng rào sắt", "quán ốc đêm"]}
    assert crossleak.matched(texts[0], texts[1], 6)
    rows = [(i, [i, j], 10 * i + j, 1, t, True, ["train", "val"][i], "s", 1, "x") for i, ts in texts.items() for j, t in enumerate(ts)]
    for i in range(2, 12):  # other training images hold one of the equal texts each
        rows += [(i, [i, j], 10 * i + j, 1, t, True, "train", "s", 1, "x") for j, t in enumerate([same[i % 5], *(f"{w}{i}" for w in ("mộtba", "haibốn", "nămsáu", "bảytám", "chínmười", "trămnghìn", "triệutỷ"))])]
    got = crossleak.overlapping_images(crossleak.image_texts(images(spark, rows))).collect()
    assert [tuple(x) for x in got] == [(1, 0)]


def test_texts_of_a_hot_hash_meet_by_shared_pieces(spark, monkeypatch):
    """The same near pairs as with everything of a hash compared, over pieces that most texts do not share."""
    r = random.Random(4)
    some = [f"84 {r.randrange(1000):03} {r.randrange(10**6):06}" for _ in range(60)] + ["84 1 2", "84 a b", "84 1 b", "84 1 22"]
    edited = []
    for t in some:
        for _ in range(r.randrange(3)):
            i = r.randrange(3, len(t))
            t = r.choice([t[:i] + "7" + t[i + 1 :], t[:i] + "7" + t[i:], t[:i] + t[i + 1 :]])
        edited.append(t)
    asked = spark.createDataFrame([(i, len(t) + i % 4, 1, t[3:], 200) for i, t in enumerate(some)], "tid long, len int, key long, part string, n long")
    known = spark.createDataFrame([(1, i, len(t), t[3:], 200) for i, t in enumerate(edited)], "key long, own long, lt int, pt string, n long")
    plain = sorted(map(tuple, crossleak._close(asked, known).distinct().collect()))
    monkeypatch.setattr(crossleak, "HOT", 100)
    assert len(plain) >= 60 and sorted(map(tuple, crossleak._close(asked, known).distinct().collect())) == plain
    cut = lambda ts, index: [set(crossleak._pieces.func(t[3:], 2, [2], index)) for t in ts[:60]]
    assert sum(bool(a & b) for a in cut(some, False) for b in cut(edited, True)) < 60 * 60 / 8


def test_bits_leave_out_no_match():
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcd ", k=r.randint(4, 12)))
    xs, ys = [], []
    for _ in range(300):
        x = [word() for _ in range(r.randint(8, 11))]
        y = [t[:2] + r.choice(["", "a", "bb"]) + t[3:] if r.random() < 0.7 else word() for t in x]
        xs.append(x)
        ys.append(r.sample(y, len(y)))
    some = [t for x in xs for t in x] + ["", "đđđ 😀"]
    assert [int(a) | int(b) << 64 for a, b in crossleak._letters(some)] == [crossleak.letters(t) for t in some]
    ok = crossleak._possible(xs, ys)
    want = [crossleak.matched(x, y, -(-max(len(x), len(y)) * 2 // 3)) for x, y in zip(xs, ys)]
    assert any(want) and not all(ok) and all(o for o, w in zip(ok, want) if w)


def test_matching_is_largest():
    # the greedy choice (equal first) would match one pair only
    assert crossleak.matched(["abcde", "abcdx"], ["abcde", "abcdf"], 2)
    assert not crossleak.matched(["abcd"], ["abcx"], 1)  # four characters allow no edit
    assert crossleak.near("abcde", "abcdx") and not crossleak.near("abcde", "abxyz") and crossleak.near("", "")


