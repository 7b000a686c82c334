"""An approved plan as chunks of adjacent messages: planning only; nothing here deletes anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.functions import scalars as S
from skeinwork.operators.positions import BLOCK, numbered
from skeinwork.params import DAY, Params

#: The day of dialogs whose first date is unknown: before all others.
NO_DAY = -(1 << 40)

# Mean seconds between chunks, between dialogs, for a message, for a break, and chunks between breaks.
BETWEEN_CHUNKS, BETWEEN_DIALOGS, A_MESSAGE, A_BREAK, CHUNKS_A_BREAK = 30.0, 135.0, 0.475, 450.0, 75.0


def deletable(plan: DataFrame, dialogs: DataFrame, placed: DataFrame, log: DataFrame, only: tuple[int, ...] = ()) -> DataFrame:
    """Approved messages without a log entry or whose last attempt failed; pending and done ones are left alone."""
    chosen = plan.filter("approved").select("dialog_id", "msg_id")
    if only:
        chosen = chosen.filter(F.col("dialog_id").isin(*only))
    open_ = chosen.join(log.filter("state <> 'error'").select("dialog_id", "msg_id"), ["dialog_id", "msg_id"], "left_anti")
    known = dialogs.select(F.col("id").alias("dialog_id"), "kind", "title", S.addressable(F.col("kind"), F.col("access_hash")).alias("peer_ok"))
    return open_.join(known, "dialog_id").join(placed.select("dialog_id", "msg_id", "pos", "date"), ["dialog_id", "msg_id"])


def chunked(rows: DataFrame, p: Params) -> DataFrame:
    """Stretches of neighbouring positions, cut at the largest size; one row for each chunk."""
    island = numbered(rows, "pos", "__nth").withColumn("__island", F.col("pos") - F.col("__nth")).withColumn("__block", F.floor(F.col("pos") / BLOCK))
    # A stretch may be a whole dialog: its start comes from its blocks and goes to its rows block by block.
    whole = Window.partitionBy("dialog_id", "__island")
    starts = island.groupBy("dialog_id", "__island", "__block").agg(F.min("pos").alias("start")).withColumn("__start", F.min("start").over(whole)).drop("start")
    parts = island.join(starts, ["dialog_id", "__island", "__block"]).withColumn("__part", F.floor((F.col("pos") - F.col("__start")) / p.max_range))
    out = parts.groupBy("dialog_id", "__island", "__part").agg(F.min("pos").alias("__pos"), F.min("msg_id").alias("first_id"), F.max("msg_id").alias("last_id"), F.count("*").alias("messages"), F.sort_array(F.collect_list("msg_id")).alias("ids"))
    return numbered(out, "__pos", "chunk").withColumn("chunk", (F.col("chunk") + 1).cast("int")).drop("__island", "__part", "__pos")


def by_dialog(rows: DataFrame) -> DataFrame:
    """Dialogs with work, the one with the oldest message first."""
    return rows.groupBy("dialog_id").agg(F.count("*").alias("messages"), F.min("date").alias("oldest"), F.first("kind").alias("kind"), F.first("title").alias("title"), F.first("peer_ok").alias("peer_ok")).orderBy("oldest", "dialog_id")


def budgeted(chunks: DataFrame, dialogs: DataFrame, most: int | None) -> DataFrame:
    """The first chunks over all dialogs in order, with their number in the run; a dialog's chunks are numbered from 1."""
    ordered = chunks.join(dialogs.select("dialog_id", "oldest", "peer_ok"), "dialog_id")
    if most is not None:
        ordered = ordered.orderBy("oldest", "dialog_id", "chunk").limit(most)
    # Numbers come from counts: of the days before a dialog's first, and of the dialogs before it on that day.
    counts = ordered.groupBy("dialog_id", "oldest").agg(F.count("*").alias("n")).withColumn("day", F.coalesce(F.floor(F.col("oldest") / DAY), F.lit(NO_DAY)))
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # a row for each day
    days = counts.groupBy("day").agg(F.sum("n").alias("n")).select("day", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    ahead = Window.partitionBy("day").orderBy("oldest", "dialog_id").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.join(days, "day").select("dialog_id", (F.col("earlier") + F.coalesce(F.sum("n").over(ahead), F.lit(0))).alias("__before"))
    return ordered.join(before, "dialog_id").withColumn("number", F.col("__before") + F.col("chunk")).drop("__before")


def states(log: DataFrame) -> DataFrame:
    return log.groupBy("state").agg(F.count("*").alias("messages"))


def estimate(chunks: DataFrame) -> DataFrame:
    """One row: dialogs, chunks, messages, and the seconds that a run would take."""
    sums = chunks.agg(F.countDistinct("dialog_id").alias("dialogs"), F.count("*").alias("chunks"), F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"))

    def cost(n: Column, seconds: float) -> Column:
        return n * F.lit(seconds)

    total = cost(F.col("chunks"), BETWEEN_CHUNKS) + cost(F.col("dialogs"), BETWEEN_DIALOGS) + cost(F.col("messages"), A_MESSAGE) + F.col("chunks") / CHUNKS_A_BREAK * A_BREAK
    return sums.withColumn("seconds", F.round(total, 6))
