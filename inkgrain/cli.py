"""``python -m inkgrain.cli PREDICTIONS.tsv [--confusion]``: the scores of a file of pairs (reference, tab,
prediction), and the most frequent confusions of each axis."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import functions as F

from inkgrain.operators import score
from inkgrain.session import local_session
from inkgrain.sources import readers, writers

METRICS = ["cer", "wer", "exact", "base_acc", "base_acc_ci", "mod_acc", "tone_acc"]


def main(args: list[str] | None = None, say: Callable[[str], None] = print) -> int:
    p = argparse.ArgumentParser(prog="inkgrain", description=__doc__)
    p.add_argument("predictions")
    p.add_argument("--confusion", action="store_true", help="also the twelve most frequent confusions of each axis")
    p.add_argument("--cpus", default="8")
    got = p.parse_args(args)
    spark = local_session(got.cpus)
    pairs = readers.predictions(spark, got.predictions, "S").withColumn("run", F.lit("all"))
    scores = score.score(pairs, ["run"])
    row = scores.first()
    if row is None:
        say("no pairs")
        return 1
    say(f"pairs {row['n']}, characters {row['char_ref']}")
    say(" " * 24 + "".join(m.rjust(10) for m in METRICS))
    for r in writers.report_lines(scores, ["run"], METRICS).collect():
        say(r["value"])
    if got.confusion:
        cells = score.top_confusions(score.confusion(score.op_rows(pairs, ["run"]), ["run"]), ["run"])
        for r in cells.orderBy("axis", "rank").collect():
            say(f"{r['axis']:<10}{r['ref']} -> {r['hyp']}  {r['n']}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
