"""Scores of runs, from the verdicts alone, and how far runs agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.plan import RUN, cut_ranges, verdicts
from skeinwork.operators.positions import bounded, members
from skeinwork.sources.scratch import written

WINDOW = ("dialog_id", "window_from", "window_to")


def run_key():
    return F.concat_ws(" @ ", "model", "prompt_id")


def cut_messages(judged: DataFrame, placed: DataFrame) -> DataFrame:
    """The real messages that each run cuts, once each."""
    return members(cut_ranges(judged), placed, ("protected",)).select(*RUN, "msg_id", "pos", "protected").distinct()


def run_quality(runs: DataFrame, placed: DataFrame, windows: DataFrame) -> DataFrame:
    """One row for each model and policy. ``windows`` are rebuilt ones; a run whose window is not among them counts no size and no anchors, and is told apart in ``unmatched``."""
    judged = written(verdicts(runs), "judged")
    fine = judged.filter("fine").select(*RUN, F.size("verdict.delete_ranges").alias("ranges"), F.size("verdict.protected").alias("claims"))
    cut = written(cut_messages(judged, placed), "cut")
    ends = bounded(fine.select(*WINDOW).distinct(), placed, "window_from", "window_to")
    marks = cut.join(ends, list(WINDOW)).groupBy(*RUN).agg(
        F.count("*").alias("cut"),
        F.sum(F.col("protected").cast("long")).alias("violations"),
        F.max(((F.col("pos") == F.col("first_pos")) | (F.col("pos") == F.col("last_pos"))).cast("long")).alias("edge"),
    )
    known = windows.select("dialog_id", F.col("from_id").alias("window_from"), F.col("to_id").alias("window_to"), "total", F.size("anchors").alias("anchors"))
    listed = windows.select("dialog_id", F.col("from_id").alias("window_from"), F.col("to_id").alias("window_to"), F.explode("anchors").alias("msg_id"))
    covered = cut.join(listed, [*WINDOW, "msg_id"]).groupBy(*RUN).agg(F.count("*").alias("covered"))
    rows = fine.join(known, list(WINDOW), "left").join(marks, list(RUN), "left").join(covered, list(RUN), "left").fillna(0, ["cut", "violations", "edge", "covered"])
    whole = F.coalesce(F.col("cut") / F.greatest("total", F.lit(1)) > 0.9, F.lit(False))
    scores = rows.groupBy("model", "prompt_id").agg(
        F.count("*").alias("windows"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("in_windows"),
        F.sum("cut").alias("cut"),
        F.sum("violations").alias("violations"),
        F.sum(whole.cast("long")).alias("cut_whole"),
        F.sum((F.col("ranges") == 0).cast("long")).alias("empty"),
        F.sum("claims").cast("long").alias("claims"),
        F.coalesce(F.sum("anchors"), F.lit(0)).alias("anchors"),
        F.sum("covered").alias("covered"),
        F.sum("edge").alias("edge"),
        F.sum(F.col("total").isNull().cast("long")).alias("unmatched"),
    )
    return scores.join(spend(runs), ["model", "prompt_id"]).withColumn("run", run_key())


def spend(runs: DataFrame) -> DataFrame:
    return runs.groupBy("model", "prompt_id").agg(
        F.round(F.sum("cost"), 9).alias("cost"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum((F.col("passes") > 1).cast("long")).alias("expanded"),
    )


def pairs(runs: DataFrame, placed: DataFrame) -> DataFrame:
    """For each window and two of its runs: the overlap of what they cut; two empty cuts agree."""
    judged = written(verdicts(runs), "judged")
    sets = cut_messages(judged, placed).groupBy(*RUN).agg(F.collect_set("msg_id").alias("ids"))
    all_runs = written(judged.filter("fine").select(*RUN).join(sets, list(RUN), "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>"))).withColumn("run", run_key()), "cuts")
    a, b = all_runs.select(*WINDOW, F.col("run").alias("run_a"), F.col("ids").alias("a")), all_runs.select(*WINDOW, F.col("run").alias("run_b"), F.col("ids").alias("b"))
    both, either = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    return a.join(b, list(WINDOW)).filter("run_a < run_b").select(*WINDOW, "run_a", "run_b", F.when(either == 0, 1.0).otherwise(both / either).alias("jaccard"))


def agreement(found: DataFrame) -> DataFrame:
    return found.groupBy("run_a", "run_b").agg(F.round(F.avg("jaccard"), 6).alias("mean"), F.count("*").alias("windows"), F.sum((F.col("jaccard") < 0.5).cast("long")).alias("far_apart"))


def split_windows(found: DataFrame, most: int | None = 15) -> DataFrame:
    """Windows on which some runs are far apart: those for a human."""
    out = found.filter("jaccard < 0.5").select(*WINDOW).distinct().orderBy(*WINDOW)
    return out if most is None else out.limit(most)
