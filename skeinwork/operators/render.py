"""A window as text for a model: a head, one line for each message, and a question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import scalars as S
from skeinwork.functions.scalars import TIERS
from skeinwork.operators.positions import members
from skeinwork.plans.policy import Words


def render(windows: DataFrame, placed: DataFrame, hits: DataFrame, dialogs: DataFrame, transcripts: DataFrame, w: Words) -> DataFrame:
    """dialog_id, from_id, to_id and text of every window (from_id, to_id, axes, tier)."""
    key = ["dialog_id", "from_id", "to_id"]
    inside = members(windows.select(*key), placed, ("date", "outgoing", "media_type", "text", "protected"), "from_id", "to_id")
    # The rules that fired, sorted, so that the text does not depend on the order of rows.
    fired = hits.groupBy("dialog_id", "msg_id").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws("/", "axis", "rule_id"))), ",").alias("fired"))
    spoken = transcripts.groupBy("dialog_id", "msg_id").agg(F.max("text").alias("spoken"))
    rows = inside.join(fired, ["dialog_id", "msg_id"], "left").join(spoken, ["dialog_id", "msg_id"], "left")
    body = (
        F.when(F.col("spoken").isNotNull(), F.concat(F.lit(f"[{w.voice}] "), "spoken"))
        .when(F.col("media_type").isNotNull() & (F.col("text") == ""), F.concat(F.lit("["), "media_type", F.lit(f", {w.no_text}]")))
        .otherwise(F.replace("text", F.lit("\n"), F.lit(" ⏎ ")))
    )
    who = F.when(F.col("outgoing"), w.me).otherwise(w.them)
    note = F.when(F.col("protected"), F.lit(w.protected + "\n")).when(F.col("fired").isNotNull(), F.concat(F.lit(w.fired), "fired", F.lit(")\n"))).otherwise("")
    line = F.concat(F.lit("["), F.col("msg_id").cast("string"), F.lit("] "), S.minute(F.col("date")), F.lit(" "), who, F.lit(": "), body, F.lit("\n"), note)
    # A window has a bounded number of messages.
    lines = rows.select(*key, "pos", line.alias("line")).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    titled = dialogs.select(F.col("id").alias("dialog_id"), F.coalesce("title", F.lit(w.untitled)).alias("title"))
    age = F.when(F.col("tier") == TIERS[0], w.tiers[0]).when(F.col("tier") == TIERS[1], w.tiers[1]).otherwise(w.tiers[2])
    head = F.concat(F.lit(f"{w.chat}: "), "title", F.lit(f"\n{w.tier}: "), age, F.lit(f"\n{w.axes}: "), F.array_join("axes", ", "), F.lit(f"\n\n{w.log}\n"))
    whole = windows.join(lines, key).join(titled, "dialog_id")
    return whole.select(*key, F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), ""), F.lit(w.ask)).alias("text"))
