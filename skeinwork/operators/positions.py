"""Positions of messages in their dialogs, and the messages within ranges of ids.

Ids have gaps, so whatever is counted in messages goes by position. Positions come from counts by blocks
of ids and numbers within a block, so a dialog with a third of all messages is not one task's work. The
messages within a range are found by equality: a range's ends get positions, the positions between them
are written out (a range lies within a window), and those are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.sources.scratch import written

#: Ids in a block.
BLOCK = 1 << 16


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """Add ``name``, from 0 in each dialog by the whole number ``by``."""
    rows = rows.withColumn("__block", F.floor(F.col(by) / BLOCK))
    ahead = Window.partitionBy("dialog_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("dialog_id", "__block").agg(F.count("*").alias("n")).select("dialog_id", "__block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__before"))
    within = Window.partitionBy("dialog_id", "__block").orderBy(by)
    placed = rows.withColumn("__n", F.row_number().over(within)).join(before, ["dialog_id", "__block"])
    return placed.withColumn(name, F.col("__before") + F.col("__n") - 1).drop("__block", "__n", "__before")


def with_positions(messages: DataFrame) -> DataFrame:
    """Add pos, from 0 in each dialog by msg_id."""
    return numbered(messages, "msg_id", "pos")


def bounded(ranges: DataFrame, placed: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Add first_pos and last_pos of the messages with ids from ``lo`` to ``hi``; ranges without any are left out.

    An end that is a message's own id is looked up; only other ends are placed by counting what lies before.
    """
    ranges = written(ranges, "ranges")  # few rows, used four times
    ids = placed.select("dialog_id", F.col("msg_id").alias("__id"), F.col("pos").alias("__pos"))
    ends = ranges.select("dialog_id", F.col(lo).cast("long").alias("v"), F.lit(0).alias("kind")).unionByName(ranges.select("dialog_id", F.col(hi).cast("long").alias("v"), F.lit(2).alias("kind"))).distinct()
    own = ends.join(ids.select("dialog_id", F.col("__id").cast("long").alias("v"), "__pos"), ["dialog_id", "v"], "left")
    direct = own.filter("__pos IS NOT NULL").select("dialog_id", "v", "kind", F.col("__pos").alias("at"))
    astray = own.filter("__pos IS NULL").select("dialog_id", "v", "kind", F.lit(None).cast("long").alias("pos"))
    # What is astray comes after the messages before it in its block of ids or, without any, after those of earlier blocks.
    block = F.floor(F.col("v") / BLOCK).alias("__block")
    astray = written(astray.withColumn("__block", block), "astray")
    blocks = astray.select("dialog_id", "__block").distinct()
    own_blocks = ids.select("dialog_id", F.col("__id").cast("long").alias("v"), F.lit(1).alias("kind"), F.col("__pos").alias("pos")).withColumn("__block", block)
    order = Window.partitionBy("dialog_id", "__block").orderBy("v", "kind")
    found = own_blocks.join(blocks, ["dialog_id", "__block"], "left_semi").unionByName(astray).withColumn("within", F.max("pos").over(order)).filter("kind <> 1")
    tops = own_blocks.select("dialog_id", "__block", "pos").unionByName(blocks.withColumn("pos", F.lit(None).cast("long"))).groupBy("dialog_id", "__block").agg(F.max("pos").alias("top"))
    ahead = Window.partitionBy("dialog_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("dialog_id", "__block", F.max("top").over(ahead).alias("earlier"))
    found = found.join(tops, ["dialog_id", "__block"]).withColumn("last", F.coalesce("within", "earlier", F.lit(-1)))
    placed_ends = direct.unionByName(found.select("dialog_id", "v", "kind", F.when(F.col("kind") == 0, F.col("last") + 1).otherwise(F.col("last")).alias("at")))
    starts = placed_ends.filter("kind = 0").select("dialog_id", F.col("v").alias("__lo"), F.col("at").alias("first_pos"))
    stops = placed_ends.filter("kind = 2").select("dialog_id", F.col("v").alias("__hi"), F.col("at").alias("last_pos"))
    out = ranges.withColumns({"__lo": F.col(lo).cast("long"), "__hi": F.col(hi).cast("long")}).join(starts, ["dialog_id", "__lo"]).join(stops, ["dialog_id", "__hi"])
    return out.drop("__lo", "__hi").filter("first_pos <= last_pos")


def members(ranges: DataFrame, placed: DataFrame, columns: tuple[str, ...] = (), lo: str = "lo", hi: str = "hi") -> DataFrame:
    """A row for each range and message in it: the range's columns, msg_id, pos and the message's ``columns``."""
    spots = bounded(ranges, placed, lo, hi).withColumn("pos", F.explode(F.sequence("first_pos", "last_pos"))).drop("first_pos", "last_pos")
    return spots.join(placed.select("dialog_id", "pos", "msg_id", *columns), ["dialog_id", "pos"])
