"""Problems 3, 6, 7, 8: fixtures, round trips and held-out accuracy."""

import math
import random
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from inkgrain.llm import lookalike, mixing, packing, tokens, toxicity

RATED = "/root/testdata/sf0.001/rated_texts.parquet"


@pytest.mark.parametrize(
    "odd,form",
    [("Ｐｈở　bò", "Phở bò"), ("Phở", "Phở"), ("x​e­ m⁠áy", "xe máy"), ("a b", "a b"), ("ХE MÁY", "XE MÁY"), ("Ѕữa", "Sữa"), ("Ðường", "Đường"), ("A‑B", "A-B"), (" a ", " a "), ("Суп дня", "Суп дня"), ("ΦΑΡΜΑΚΕΙΟ", "ΦΑΡΜΑΚΕΙΟ"), ("ХЛЕБ BAKERY", "ХЛЕБ BAKERY"), ("120 m²", "120 m²"), ("50€ ", "50€ "), ("25°C", "25°C"), ("H₂O", "H₂O"), ("미용실", "미용실"), ("酒店", "酒店"), ("Р.13", "P.13"), ("ế", "ế"), ("", "")],
)
def test_forms(spark, odd, form):
    vocab = spark.createDataFrame([("P.13",), ("XE MÁY",), ("Sữa",), ("phở bò",)], "value string")
    df = spark.createDataFrame([(odd,), (None,), (odd,)], "value string")
    got = {r["value"]: r["form"] for r in lookalike.forms(df.where("value is not null"), vocab).collect()}
    assert got.get(odd, odd) == form
    assert lookalike.forms(spark.createDataFrame([(form,)], "value string"), vocab).where("form <> value").count() == 0


def test_a_word_of_the_corpus_decides(spark):
    vocab = spark.createDataFrame([("XE",), ("XE",), ("uy",)], "value string")
    got = {r["value"]: r["form"] for r in lookalike.forms(spark.createDataFrame([("ХЕ",), ("СОК",), ("υy",)], "value string"), vocab).collect()}
    assert got == {"ХЕ": "XE", "СОК": "СОК", "υy": "uy"}


def test_trie_takes_the_cheaper_then_the_more_frequent():
    trie = lookalike.build_trie(["Im", "lm", "uy"], [1, 9, 2])
    assert lookalike.spell(trie, "Іm") == "Im"  # first choice before frequency
    assert lookalike.spell(trie, "υ​у") == "uy" and lookalike.spell(trie, "Жm") is None


def test_tries_read_tokens_as_they_are_written():
    trie = lookalike.build_trie(["Phở", "được", "xe", "A-B", "uy"], [1] * 5)
    odd = {"Ｐｈở": "Phở", "Pho\u031b\u0309": "Phở", "Pho\u0309\u031b": "Phở", "Ph\u200bo\u031b\u200d\u0309": "Phở", "đu\u031bo\u031b\u0323c": "được", "đu\u031bo\u0323\u031bc": "được", "х\u00adе": "xe", "A‑B": "A-B", "Α\u2212B": "A-B", "𝐮𝐲": "uy"}
    for token, word in odd.items():
        assert lookalike.spell(trie, token) == word, token
    assert lookalike.spell(trie, "Phơ\u0301") is None and lookalike.spell(trie, "x") is None


def test_the_tries_decide(spark):
    """On the tables: every odd token that is a word of the corpus is spelled by a trie, and the table would
    leave them as the trie does, wherever one letter looks like one other only."""
    rows = spark.read.parquet("/root/testdata/sf0.01/instances.parquet").selectExpr("raw_text as value").where("value is not null")
    got = lookalike.forms(rows).where("form <> value").collect()
    spelled = [r for r in got if r["n_spelled"]]
    assert len(spelled) > 0.5 * len(got)
    assert sum(lookalike.finish(r["value"], {}) == r["form"] for r in got) >= 0.99 * len(got)
    print(len(got), "values out of form,", len(spelled), "with tokens spelled by a trie,", sum(r["n_spelled"] == len(lookalike.lookups(r["value"])) for r in spelled), "of these in all tokens")


def test_out_of_form_rows(spark):
    df = spark.createDataFrame([(1, "ab​", "ab"), (1, "ab​", "ab"), (2, None, ""), (None, "ｘ", "x"), (3, "x" * 50_000 + "​", "y")], "pos int, raw_text string, text string").withColumn("value", F.lit(1)).withColumn("token", F.lit(2))
    got = sorted((tuple(r) for r in lookalike.out_of_form([("t", df, "pos", ["raw_text", "text"])]).select("row_key", "field").collect()), key=str)
    assert got == sorted([("1", "raw_text"), ("3", "raw_text"), (None, "raw_text")], key=str)
    assert lookalike.out_of_form([("t", df.limit(0), "pos", ["raw_text"])]).count() == 0
    same = lookalike.canonical(df.withColumn("form", F.lit("q")), ["raw_text"])
    assert {r["raw_text"] for r in same.collect()} == {"ab", None, "x", "x" * 50_000} and same.count() == 5 and "form" in same.columns


def test_a_final_line_end_is_out_of_form(spark):
    ends = ["\n", "\r", "\r\n", "\x85", "\u2028", "\u2029"]
    df = spark.createDataFrame([(i, f"phở{e}") for i, e in enumerate([*ends, ""])], "pos int, raw_text string")
    got = {r["row_key"] for r in lookalike.out_of_form([("t", df, "pos", ["raw_text"])]).collect()}
    assert got == {str(i) for i in range(len(ends))}


def sized(spark, rows):
    return spark.createDataFrame(rows, "k long, n_tokens long, size int, rank int, container string")


def first_fit(sizes, capacity):
    """Containers that first fit by falling size needs."""
    rooms = []
    for n in sorted(sizes, reverse=True):
        at = next((i for i, r in enumerate(rooms) if r >= n), None)
        if at is None:
            rooms.append(capacity - n)
        else:
            rooms[at] -= n
    return len(rooms)


def test_packing(spark):
    r = random.Random(2)
    rows = [(i, r.choice([r.randint(1, 300), 37, 37, 37, 0, 256, 700]), 1, 2, "x") for i in range(3000)] + [(9, None, 1, 2, "x"), (9, 5, 1, 2, "x")]
    got = packing.pack(sized(spark, rows), "k", 256).collect()
    load = {}
    for g in got:
        load[g["container"]] = load.get(g["container"], 0) + g["size"]
    total = sum(n or 0 for _, n, *_ in rows)
    assert max(load.values()) <= 256 and sum(load.values()) == total
    pieces = [min(256, (n or 0) - s) for _, n, *_ in rows for s in range(0, n or 0, 256)]
    assert len(load) <= 1.01 * first_fit(pieces, 256)
    parts = {}
    for g in got:
        parts.setdefault(g["k"], []).append((g["start"], g["size"]))
    for k, n, *_ in rows[:3000]:
        if k != 9:
            own = sorted(parts[k])
            assert sum(s for _, s in own) == n and (len(own) == 1 or n > 256) and [a for a, _ in own] == [256 * i for i in range(len(own))]
    assert len(got) == sum(max(1, -(-(n or 0) // 256)) for _, n, *_ in rows)
    assert packing.pack(sized(spark, []), "k", 256).count() == 0
    assert {g["container"] for g in packing.pack(sized(spark, [(1, 0, 1, 2, "x")]), "k", 256).collect()} == {0}


def test_plan_places_all_items():
    for hist, cap in (({3: 7, 5: 4}, 8), ({1: 1}, 1), ({}, 5), ({6: 3, 4: 3}, 10), ({7: 5}, 10)):
        runs = packing.plan(hist, cap)
        placed = {}
        for times, fill in runs:
            assert sum(n * k for n, k in fill.items()) <= cap
            for n, k in fill.items():
                placed[n] = placed.get(n, 0) + times * k
        assert placed == hist
    assert sum(t for t, _ in packing.plan({6: 3, 4: 3}, 10)) == 3


def test_pricing_is_optimal():
    import itertools

    r = random.Random(1)
    for _ in range(30):
        items = [r.randint(1, 12) for _ in range(8)]
        values = [r.random() for _ in items]
        got = packing.price(items, values, 20)
        assert sum(items[i] for i in got) <= 20 and len(set(got)) == len(got)
        best = max(sum(c * v for c, v in zip(cs, values)) for cs in itertools.product((0, 1), repeat=8) if sum(c * n for c, n in zip(cs, items)) <= 20)
        assert sum(values[i] for i in got) == pytest.approx(best)


@pytest.mark.parametrize("capacity", [64, 1000])
def test_the_program_comes_near_the_least_by_volume(capacity):
    r = random.Random(3)
    hist = {}
    for _ in range(20_000):
        n = max(1, min(capacity, int(r.lognormvariate(math.log(capacity / 8), 1))))
        hist[n] = hist.get(n, 0) + 1
    runs = packing.plan(hist, capacity)
    placed = {}
    for times, fill in runs:
        assert sum(n * k for n, k in fill.items()) <= capacity
        for n, k in fill.items():
            placed[n] = placed.get(n, 0) + k * times
    assert placed == hist
    assert sum(t for t, _ in runs) <= 1.01 * sum(n * k for n, k in hist.items()) / capacity + 1


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|> phở " * 20_000)], "k int, t string").withColumn("n", F.lit(1))
    got = {r["k"]: r["n_tokens"] for r in tokens.token_counts(df, "k", "t", []).collect()}
    enc = tokens.encoder(f"{tokens.FOLDER}/{tokens.FILE}")
    assert got == {1: len(enc.encode_ordinary("hello world")), 2: 0, 3: 0, 4: len(enc.encode_ordinary("<|endoftext|> phở " * 20_000))}


def test_prefix_sums(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else "a", i, i % 4) for i in range(500)], "g string, k int, v int")
    got = tokens.prefix_sum(df, ["g"], ["k"], F.col("v"), "before", 8).collect()
    for g in (None, "a"):
        own = sorted((r["before"], r["v"]) for r in got if r["g"] == g)
        run = 0
        for before, v in sorted(own, key=lambda x: (x[0], x[1] > 0)):
            assert before == run
            run += v


@pytest.mark.parametrize("weights", [[Fraction(1, 2), Fraction(1, 3), Fraction(1, 6)], [Fraction(7, 10), Fraction(3, 10)], [Fraction(1, 97), Fraction(96, 97)]])
def test_pfair_stays_within_a_block(weights):
    w = {f"s{i}": x for i, x in enumerate(weights)}
    slots = mixing.pfair(w, 400)
    assert len(slots) == 400 and len({s for s, *_ in slots}) == 400
    done = dict.fromkeys(w, 0)
    for slot, s, j in slots:
        assert j == done[s]
        done[s] += 1
        assert all(abs(done[x] - w[x] * (slot + 1)) < 1 for x in w)


@pytest.mark.parametrize("stretch", [7, 50, 5000])
def test_stretches_keep_the_shares(monkeypatch, stretch):
    monkeypatch.setattr(mixing, "STRETCH", stretch)
    w = {"a": Fraction(5, 9), "b": Fraction(1, 3), "c": Fraction(1, 9)}
    n = 2000
    blocks = {s: math.floor(n * x) + 1 for s, x in w.items()}
    last = -(-n // stretch)
    rows = [x for k in range(1, last + 1) for x in mixing.schedule(w, blocks, k, last)]
    assert [x[0] for x in rows] == sorted({x[0] for x in rows}) and len(rows) == sum(blocks.values())
    done = dict.fromkeys(w, 0)
    for i, (_, s, j) in enumerate(rows, 1):
        assert j == done[s]
        done[s] += 1
        assert all(abs(done[x] - w[x] * i) < 2 for x in w)


def test_quotas():
    assert mixing.quotas({"a": 100, "b": 10}, {"a": (0.5, 1), "b": (0.5, 2)}) == {"a": 20, "b": 20}
    assert mixing.quotas({"a": 100}, {"a": (0.5, 1), "none": (0.5, 1)}) == {"a": 100}
    assert mixing.quotas({"a": 100, "b": 10}, {"a": (0.5, 1), "b": (0.5, 2)}, 100) == {"b": 20, "a": 80}
    assert mixing.quotas({}, {"a": (1.0, 1)}) == {}


def test_mix(spark):
    r = random.Random(4)
    docs = spark.createDataFrame([(i, r.choice(["hot"] * 6 + ["b", "tiny", None]), r.randint(0, 40), 1, "z") for i in range(4000)], "doc_id long, source string, n_tokens long, slot int, quota string")
    goal = spark.createDataFrame([("m", "hot", 0.5, 1), ("m", "b", 0.3, 3), ("m", "gone", 0.2, 2), ("q", "tiny", 1.0, 2), ("r", "gone", 1.0, 1)], "mix string, source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, goal, "doc_id", block=150)
    rows = mixed.collect()
    used = {}
    for x in rows:
        used[x["mix"], x["doc_id"]] = used.get((x["mix"], x["doc_id"]), 0) + 1
        assert x["slot"] is not None and x["n_tokens"] > 0
    assert max(used.values()) <= 3 and len(rows) == len({(x["mix"], x["doc_id"], x["copy"]) for x in rows})
    share = {(x["mix"], x["source"]): x["share"] for x in mixing.reached(mixed, goal).collect()}
    assert share["m", "hot"] == pytest.approx(0.625, abs=0.01) and share["m", "b"] == pytest.approx(0.375, abs=0.01) and share["m", "gone"] == 0 and share["q", "tiny"] == 1 and share["r", "gone"] == 0
    at = 0
    part = sorted((x for x in rows if x["mix"] == "m"), key=lambda x: (x["slot"], x["at"]))
    total, sofar = sum(x["n_tokens"] for x in part), {"hot": 0, "b": 0}
    for x in part:
        sofar[x["source"]] += x["n_tokens"]
        at += x["n_tokens"]
        assert abs(sofar["hot"] - 0.625 * at) < 2 * 150 + 80
    assert total / 150 > 200
    assert mixing.mix(docs.limit(0), goal, "doc_id").count() == 0 and mixing.mix(docs, goal.limit(0), "doc_id").count() == 0


def test_segments_are_maximal():
    import numpy as np

    r = random.Random(9)
    for _ in range(50):
        s = np.array([r.choice([-2.0, -1.0, 1.0, 2.0, 3.0]) for _ in range(r.randint(0, 40))])
        got = toxicity.segments(s, 0.5)
        best = max([sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1)], default=0)
        assert max((x for *_, x in got), default=0) == pytest.approx(max(best, 0))
        for a, b, x in got:
            assert sum(s[a:b]) == pytest.approx(x) and all(sum(s[a:i]) > 0 for i in range(a + 1, b)) and all(sum(s[i:b]) > 0 for i in range(a + 1, b))
        assert all(b <= c for (_, b, _), (c, _, _) in zip(got, got[1:]))


def test_disguises():
    d = toxicity.Disguise({"idiot", "bastard", "cock", "animals", "khốn", "nạn", "fuck", "bitch", "brainless", "hardcore", "trash"})
    want = {"іdіоt": "idiot", "baaaastard": "bastard", "c0ck": "cock", "anim.ls": "animals", "b*stard": "bastard", "i d i o t": "idiot", "k​hốn nạn": "khốn nạn", "ＩＤＩＯＴ": "idiot"}
    want |= {"f***": "fuck", "b****": "bitch", "*uck": "fuck", "br@1nl3$$": "brainless", "h@rdc0r3": "hardcore", "+r@sh": "trash", "f.u.c.k": "fuck", "C++ a+b": "c a b", "*good* do-not-care": "good do not care", "me@mail.com": "me mail com"}
    for odd, plain in want.items():
        assert " ".join(d.words_of(odd)) == plain, odd
    assert d.words_of("12 3.5 P.13") == ["#", "#", "#", "p", "#"]


def wordings(rows):
    """A number for every rated text; those with 0.45 of their words in common share it."""
    import re

    words = [set(re.findall(r"[^\W\d_]+", re.sub(r"[\"“«][^\"”»]*[\"”»]", "", t).lower())) for _, t, _ in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(words):
        for j in range(i):
            if len(a & words[j]) >= 0.45 * len(a | words[j]):
                x, y = root[i], root[j]
                root = [y if r == x else r for r in root]
    return root


def test_the_rule_on_wordings_it_never_saw(spark):
    """Learnt from half of the wordings of the rated texts, the shipped rule tells those of the other half."""
    rows = [r for r in duckdb.connect().execute(f"select item_id, text, label from '{RATED}' where text is not null order by 1").fetchall()]
    root = wordings(rows)
    order = sorted(set(root))
    right = hit = bad = n = 0
    background = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").selectExpr("cast(doc_id as int) + 100000 as doc_id", "text", "'s' as source")
    for half in (0, 1):
        held = {r for i, r in enumerate(order) if i % 2 == half}
        train = [x for x, r in zip(rows, root) if r not in held]
        rest = [x for x, r in zip(rows, root) if r in held]
        rated = spark.createDataFrame(train, "item_id int, text string, label string")
        docs = spark.createDataFrame([(r[0], r[1], "s") for r in rest] + [(10_000, None, None), (10_001, "", "s")], "doc_id int, text string, source string").union(background).withColumn("ids", F.lit(1)).withColumn("best", F.lit("x"))
        got = {r["doc_id"]: r for r in toxicity.score_documents(docs, rated, "doc_id", "text", ["source"]).where("doc_id < 100000").collect()}
        assert len(got) == len(rest) + 2 and not got[10_000]["is_case"] and got[10_001]["e_value"] is None and got[10_000]["e_value"] is None
        right += sum(got[i]["is_case"] == (y != "none") for i, _, y in rest)
        hit += sum(got[i]["is_case"] for i, _, y in rest if y != "none")
        bad += sum(y != "none" for *_, y in rest)
        n += len(rest)
    print(f"accuracy {right / n:.3f}, recall {hit / bad:.3f}, of harmless ones {(n - bad - right + hit) / (n - bad):.3f} taken for cases")
    assert right / n > 0.9 and hit / bad > 0.85


def test_both_ways_to_read_a_text_agree(spark):
    """Texts read by pieces give the words of the whole texts."""
    words, lists = toxicity.learn(duckdb.connect().execute(f"select text, label from '{RATED}' where text is not null").df())
    ids = toxicity.table_of(lists)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, ""), (-2, "!"), (-3, "\n\nĐừng 12 xx_yy…  \"A!\" women?"), (-4, "dân nhập cư và old folk. F*ck"), (-5, "b  c\td."), (-6, None)], "doc_id long, text string"))
    got = {r["doc_id"]: r["ids"] for r in toxicity.encoded(docs, "doc_id", "text", [], ids, words).collect()}
    reader = toxicity.Disguise(words)
    for r in docs.collect():
        want = [ids.get(w, toxicity.OTHER) for w in reader.words_of(r["text"])] + [toxicity.END] if r["text"] else []
        assert got[r["doc_id"]] == want, r


def test_passages_add_up():
    one = toxicity.e_value([12.0], 200, 0.7, 0.01)
    assert one == pytest.approx(2 * 0.01 * 200 * math.exp(-0.7 * 12))
    assert toxicity.e_value([12.0, 11.0, 11.0], 200, 0.7, 0.01) < one
    assert toxicity.e_value([12.0, 3.0, 3.0], 200, 0.7, 0.01) == one  # not significant
    assert toxicity.e_value([12.0] + [0.8] * 30, 60, 0.7, 0.01) == toxicity.e_value([12.0], 60, 0.7, 0.01)  # fewer than one expected
    assert toxicity.e_value([0.0], 5, 0.7, 0.01) == toxicity.e_value([], 20, 0.7, 0.01)


def test_scores_are_those_of_the_two_models():
    """The sparse form against the two conditional probabilities written out."""
    import numpy as np

    rated = [(["you", "idiot", "you"], True), (["the", "idiot", "board"], False)]
    ids = {".": 1, "you": 2, "idiot": 3, "the": 4, "board": 5}
    ids |= {w: i + 6 for i, w in enumerate(sorted({f for s in toxicity._seeds() for w in s for f in (w, toxicity.bare(w))} - set(ids)))}
    k = toxicity.size_of(ids)
    singles = np.full(k, 10.0)
    pairs = {4 * k + 3: 5e5, 0: 1e6}
    s = toxicity.fit(ids, rated, singles, pairs, 3e6)
    walk = np.array([2, 3, 2, 4, 3, 0, 0, 5, 1, 3])
    share = toxicity.CORPUS / (3e6 + toxicity.UNSEEN)
    ben = dict.fromkeys([(4, 3), (3, 5), (1, 4), (5, 1)], toxicity.HARMLESS)
    ben[4, 3] += share * 5e5 - toxicity.RARE
    ben[0, 0] = share * 1e6 - toxicity.RARE
    base = 1 / k

    def harmless(a, w):
        return (ben.get((a, w), 0) + toxicity.BETA * base) / (sum(n for (x, _), n in ben.items() if x == a) + toxicity.BETA)

    own = np.exp(s.own) * base  # shares of words in offending texts
    assert own.sum() == pytest.approx(1, abs=1e-4)
    got = dict(zip(zip([1, *walk[:-1]], walk), s.of(walk)))
    for (a, w), n in {(2, 3): 1.0, (4, 3): 0.0, (3, 2): 1.0}.items():
        offending = (n + toxicity.BETA * own[w]) / (sum_row(rated, ids, a) + toxicity.BETA)
        assert got[a, w] == pytest.approx(math.log(offending / harmless(a, w)), abs=1e-3)
    assert got[2, 3] > 0 > got[4, 3]


def sum_row(rated, ids, word):
    """Offending pairs that begin with *word*, seeds included."""
    n = sum(1 for ws, y in rated if y for a in ws if ids[a] == word)
    for s, times in [(s, toxicity.SEED) for s in toxicity._phrases(toxicity.SEEDS)] + [(s, toxicity.MILD) for s in toxicity._phrases(toxicity.MILD_SEEDS)]:
        for form, w in ((s, times), ([toxicity.bare(x) for x in s], 0.3 * times)):
            if (form != s or w == times) and len(form) > 1:
                n += w * sum(ids[x] == word for x in form[:-1])
    return n


def test_copies_of_an_offence_do_not_make_it_harmless(spark):
    """One offending text is a third of all rows."""
    rated = spark.createDataFrame(duckdb.connect().execute(f"select item_id, text, label from '{RATED}'").fetchall(), "item_id int, text string, label string")
    words = "the market by river opens at seven and closes late board painted new letters shop sells bread tea fish road was repaired last year people walk there often in spring".split()
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(words, k=30)) + ".") for i in range(6000)] + [(10_000 + i, "Shut up you moron, only an imbecile would say that, you filthy lowlife.") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("source", F.lit("s"))
    got = toxicity.score_documents(docs, rated, "doc_id", "text", ["source"]).where("is_case").groupBy(F.col("doc_id") >= 10_000).count().collect()
    found = {copy: n for copy, n in got}
    assert found[True] == 3000 and found.get(False, 0) <= 2 * toxicity.E_LIMIT * 6000


def test_prevalence_does_not_move_the_constants(spark):
    r = random.Random(5)
    law = [(200, (math.log(200 * 0.02) - math.log(-math.log(r.random()))) / 0.8) for _ in range(6000)]
    got = [toxicity.calibrate(spark.createDataFrame(law + [(200, r.uniform(15, 60)) for _ in range(n)], "n_words int, best double")) for n in (0, 5000)]
    assert got[0] == pytest.approx(got[1], rel=0.01) and got[0][0] == pytest.approx(0.8, abs=0.1)


def test_no_documents(spark):
    rated = spark.createDataFrame([(1, "you idiot", "abusive"), (2, "you read", "none"), (3, None, None)], "item_id int, text string, label string")
    docs = spark.createDataFrame([], "doc_id int, text string, source string")
    assert toxicity.score_documents(docs, rated, "doc_id", "text", ["source"]).count() == 0
    long = spark.createDataFrame([(1, "fine words here. " * 50_000 + "you fucking idiot, kill yourself", None)], "doc_id int, text string, source string")
    assert toxicity.score_documents(long, rated, "doc_id", "text", ["source"]).first()["passages"]
