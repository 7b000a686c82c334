"""What two models would cut, on the windows that both have judged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.functions import scalars as S
from skeinwork.operators.plan import cut_ranges, verdicts
from skeinwork.operators.positions import members

SPAN = ("dialog_id", "window_from", "window_to")


def marks(runs: DataFrame, placed: DataFrame, model: str) -> DataFrame:
    """Messages that a model's runs cut; of several ranges the last gives the reason."""
    inside = members(cut_ranges(verdicts(runs.filter(F.col("model") == model))), placed)
    last = Window.partitionBy("dialog_id", "msg_id").orderBy(F.desc("window_from"), F.desc("window_to"), F.desc("prompt_id"), F.desc("nth"))
    return inside.withColumn("__n", F.row_number().over(last)).filter("__n = 1").select("dialog_id", "msg_id", "reason")


def compared(runs: DataFrame, placed: DataFrame, base: str, against: str) -> tuple[DataFrame, DataFrame]:
    """The windows in common, and each message in them that either model cuts, with both reasons."""
    seen = [runs.filter(F.col("model") == m).select(*SPAN).distinct() for m in (base, against)]
    common = seen[0].join(seen[1], list(SPAN))
    inside = members(common, placed, lo="window_from", hi="window_to").select("dialog_id", "msg_id").distinct()
    a = marks(runs, placed, base).join(inside, ["dialog_id", "msg_id"], "left_semi").withColumnRenamed("reason", "reason_a").withColumn("in_a", F.lit(True))
    b = marks(runs, placed, against).join(inside, ["dialog_id", "msg_id"], "left_semi").withColumnRenamed("reason", "reason_b").withColumn("in_b", F.lit(True))
    return common, a.join(b, ["dialog_id", "msg_id"], "full_outer").fillna(False, ["in_a", "in_b"])


def summary(common: DataFrame, both: DataFrame) -> DataFrame:
    """One row of counts; a model that cuts nothing counts zero."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    a, b = F.col("in_a"), F.col("in_b")
    out = both.agg(count(a & b).alias("agreed"), count(a & ~b).alias("only_base"), count(~a & b).alias("only_against"))
    either = F.col("agreed") + F.col("only_base") + F.col("only_against")
    return common.agg(F.count("*").alias("windows")).crossJoin(out).withColumn("undisputed", F.when(either > 0, F.round(F.col("agreed") / either, 6)))


def tails(both: DataFrame, messages: DataFrame, dialogs: DataFrame, most: int = 10, examples: int = 3) -> DataFrame:
    """What only the second model cuts, by reason, the largest groups first, with a few examples each."""
    only = both.filter("in_b AND NOT in_a").select("dialog_id", "msg_id", F.col("reason_b").alias("reason"))
    groups = only.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(most)
    nth = Window.partitionBy("reason").orderBy("dialog_id", "msg_id")
    few = only.join(groups, "reason").withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") <= examples)
    shown = few.join(messages.select("dialog_id", "msg_id", "date", "text"), ["dialog_id", "msg_id"]).join(dialogs.select(F.col("id").alias("dialog_id"), "title"), "dialog_id")
    return shown.select("reason", "n", "nth", "dialog_id", "msg_id", S.day(F.col("date")).alias("day"), F.coalesce("title", F.lit("?")).alias("title"), S.head(F.col("text"), 100).alias("head"))
