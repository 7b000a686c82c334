"""Where a rule pack is noisy, and which rules buy windows and bring nothing back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.functions import scalars as S
from skeinwork.operators.plan import cut_ranges, verdicts
from skeinwork.operators.positions import members


def terms(hits: DataFrame, least: int = 1, containing: str | None = None) -> DataFrame:
    """Each term's hits, dialogs, and the share of the dialog with most."""
    # Counts by dialog first, so that a term with very many hits is summed before it meets in one place.
    by_dialog = hits.groupBy("axis", "rule_id", "term", "dialog_id").agg(F.count("*").alias("own"))
    shared = by_dialog.withColumn("here", F.sum("own").over(Window.partitionBy("rule_id", "term", "dialog_id")))
    out = shared.groupBy("axis", "rule_id", "term").agg(F.sum("own").alias("n"), F.count("*").alias("dialogs"), F.max("here").alias("most")).filter(F.col("n") >= least)
    if containing is not None:
        out = out.filter(F.col("term").contains(containing) | F.col("rule_id").contains(containing) | F.col("axis").contains(containing))
    return out.withColumn("share", F.round(F.col("most") / F.col("n"), 6)).orderBy(F.desc("n"), "rule_id", "term")


def samples(hits: DataFrame, messages: DataFrame, each: int = 3, seed: int = 0) -> DataFrame:
    """A few hits of each term, by a seeded hash of the ids, with the surface and the head of the message."""
    order = Window.partitionBy("rule_id", "term").orderBy(S.fnv_of_ids(F.col("dialog_id"), F.col("msg_id")).bitwiseXOR(F.lit(seed)), "dialog_id", "msg_id")
    few = hits.select("rule_id", "term", "dialog_id", "msg_id", "surface").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= each)
    return few.join(messages.select("dialog_id", "msg_id", "text"), ["dialog_id", "msg_id"]).select(
        "rule_id", "term", "nth", "dialog_id", "msg_id", F.coalesce("surface", F.lit("")).alias("surface"), S.head(F.col("text"), 110).alias("head")
    )


def rules(hits: DataFrame, runs: DataFrame, placed: DataFrame, model: str | None = None, least: int = 3) -> DataFrame:
    """Of each term's hits inside judged windows, how many were cut; a verdict that cannot be read still judged its window."""
    chosen = runs if model is None else runs.filter(F.col("model") == model)
    spans = chosen.select("dialog_id", F.col("window_from").alias("lo"), F.col("window_to").alias("hi")).distinct()
    inside = members(spans, placed).select("dialog_id", "msg_id").distinct()
    cut = members(cut_ranges(verdicts(chosen)), placed).select("dialog_id", "msg_id").distinct().withColumn("cut", F.lit(1))
    seen = hits.select("dialog_id", "msg_id", "rule_id", "term").join(inside, ["dialog_id", "msg_id"], "left_semi").join(cut, ["dialog_id", "msg_id"], "left")
    out = seen.groupBy("rule_id", "term").agg(F.count("*").alias("n"), F.coalesce(F.sum("cut"), F.lit(0)).alias("cut")).filter(F.col("n") >= least)
    return out.withColumn("share", F.round(F.col("cut") / F.col("n"), 6)).orderBy("share", F.desc("n"), "rule_id", "term")
