"""From verdicts to a plan: strict parsing, clamped ranges, real messages, first reason wins, approval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.functions.verdict import parsed, valid
from skeinwork.operators.positions import members
from skeinwork.params import Params

RUN = ("dialog_id", "window_from", "window_to", "model", "prompt_id")


def verdicts(runs: DataFrame) -> DataFrame:
    """Runs with ``fine`` and, where it is true, the parsed ``verdict``."""
    return runs.withColumn("fine", valid(F.col("raw"))).withColumn("verdict", parsed(F.col("raw"), F.col("fine")))


def cut_ranges(judged: DataFrame) -> DataFrame:
    """Each range to delete of each fine run, its ends in order and clamped to the run's window.

    A range wholly outside falls on the window's edge, and selects the message there.
    """
    rows = judged.filter("fine").select(*RUN, F.posexplode("verdict.delete_ranges").alias("nth", "r"))

    def clamped(x):
        return F.greatest(F.least(x, F.col("window_to").cast("long")), F.col("window_from").cast("long")).cast("int")

    return rows.select(*RUN, "nth", clamped(F.least("r.from", "r.to")).alias("lo"), clamped(F.greatest("r.from", "r.to")).alias("hi"), "r.axis", "r.confidence", "r.reason")


def build_plan(runs: DataFrame, placed: DataFrame, model: str, prompt_id: str | None = None, p: Params | None = None) -> DataFrame:
    """The plan of one model's runs: unprotected messages in its ranges; of several ranges the first gives the reason.

    ``placed`` are the messages with their positions. Approval starts anew. Without runs of the model it is an error.
    """
    chosen = runs.filter(F.col("model") == model)
    if prompt_id is not None:
        chosen = chosen.filter(F.col("prompt_id") == prompt_id)
    if chosen.isEmpty():
        raise ValueError(f"no runs of {model}")
    inside = members(cut_ranges(verdicts(chosen)), placed, ("protected",)).filter("NOT protected")
    first = Window.partitionBy("dialog_id", "msg_id").orderBy("window_from", "window_to", "model", "prompt_id", "nth")
    ranked = inside.withColumn("__n", F.row_number().over(first)).filter("__n = 1")
    return ranked.select("dialog_id", "msg_id", "reason", "axis", "confidence", F.lit(False).alias("approved"))


def approve(plan: DataFrame, on: bool = True, dialog: int | None = None, axis: str | None = None, everything: bool = False) -> DataFrame:
    """Set approval for a dialog, an axis, or both; for the whole plan only if that is said."""
    if dialog is None and axis is None and not everything:
        raise ValueError("name a dialog or an axis, or say that all is meant")
    meant = F.lit(True)
    if dialog is not None:
        meant = meant & (F.col("dialog_id") == dialog)
    if axis is not None:
        meant = meant & (F.col("axis") == axis)
    return plan.withColumn("approved", F.when(F.coalesce(meant, F.lit(False)), F.lit(on)).otherwise(F.col("approved")))


def not_judged(windows: DataFrame, runs: DataFrame, model: str, prompt_id: str) -> DataFrame:
    """Windows that this model has not judged under this policy."""
    done = runs.filter((F.col("model") == model) & (F.col("prompt_id") == prompt_id)).select("dialog_id", F.col("window_from").alias("from_id"), F.col("window_to").alias("to_id"))
    return windows.join(done, ["dialog_id", "from_id", "to_id"], "left_anti")


def budget(plan: DataFrame, messages: DataFrame, dialogs: DataFrame, p: Params) -> DataFrame:
    """One row: the plan's share of the corpus and of the dialog that loses most, against their limits."""
    planned = plan.agg(F.count("*").alias("planned"), F.coalesce(F.sum(F.col("approved").cast("long")), F.lit(0)).alias("approved"))
    corpus = messages.agg(F.count("*").alias("corpus"))
    worst = shares(plan, dialogs).agg(F.coalesce(F.max("share"), F.lit(0.0)).alias("worst_dialog"))
    out = planned.crossJoin(corpus).crossJoin(worst).withColumn("share", F.round(F.col("planned") / F.greatest("corpus", F.lit(1)), 6))
    return out.withColumns({"share_ok": F.col("share") <= p.max_delete_ratio, "dialog_ok": F.col("worst_dialog") <= p.max_dialog_ratio})


def shares(plan: DataFrame, dialogs: DataFrame) -> DataFrame:
    counted = plan.groupBy("dialog_id").agg(F.count("*").alias("planned"))
    known = dialogs.select(F.col("id").alias("dialog_id"), "title", "msg_count")
    return counted.join(known, "dialog_id").withColumn("share", F.round(F.col("planned") / F.greatest("msg_count", F.lit(1)), 6))


def worst_dialogs(plan: DataFrame, dialogs: DataFrame, most: int = 8) -> DataFrame:
    return shares(plan, dialogs).orderBy(F.desc("share"), "dialog_id").limit(most)
