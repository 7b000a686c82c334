"""The engine's tables, made from the driver's: a stand-in archive to run every query on.

``events`` are messages of one dialog for each user, with gaps in their ids, replies, albums, voices and a
keep-list flag; ``conversations`` are an export; verdicts are made up from the windows by fixed rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.functions.matcher import Dictionary, Rule
from skeinwork.functions.scalars import midnight
from skeinwork.params import Params
from skeinwork.sources.tables import read

NOW = midnight("2024-07-14")
EVENTS = Params(now=NOW, pad=2, gap=2, threshold=2.0, max_window=12, max_range=3, structural_axis="ties")
PACK = (
    Rule("ops", "failures", 2.0, "regex", r"^error\b"),
    Rule("ops", "seventies", 0.6, "regex", r'"k": 7[0-9]'),
    Rule("commerce", "purchases", 1.5, "regex", r"\bpurchase\b"),
    Rule("commerce", "signups", 2.5, "regex", r"\bsignup\b"),
)
MODELS = ("alpha", "beta")
PROMPT = "en-1"


def seconds(df: DataFrame, column: str) -> Column:
    """Epoch seconds; a time without zone is UTC, whatever the session's zone."""
    if df.schema[column].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")
    return F.unix_seconds(column)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    n = F.col("event_id")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return e.select(
        F.col("user_id").alias("dialog_id"),
        n.cast("int").alias("msg_id"),
        seconds(e, "ts").cast("long").alias("date"),
        F.col("user_id").alias("from_id"),
        (n % 2 == 0).alias("outgoing"),
        F.when(n % 7 == 0, before).cast("int").alias("reply_to"),
        F.when(n % 5 == 0, F.floor(n / 40)).cast("long").alias("grouped_id"),
        F.lit(None).cast("string").alias("fwd_from"),
        F.when((F.col("event_type") == "view") & (n % 10 == 0), "voice_message").alias("media_type"),
        F.lit(None).cast("string").alias("file_path"),
        F.concat("event_type", F.lit(" "), F.coalesce("props", F.lit(""))).alias("text"),
        ((F.col("event_type") == "signup") & (n % 3 == 0)).alias("protected"),
    )


def dialogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    kind = F.when(u % 10 == 0, "megagroup").when(u % 10 == 1, "chat").when(u % 10 == 2, "channel").otherwise("user")
    counted = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("msg_count"))
    return counted.select(
        u.alias("id"),
        kind.alias("kind"),
        F.when(u % 4 != 0, u * 31).alias("access_hash"),
        F.concat(F.lit("user "), u.cast("string")).alias("title"),
        F.lit(None).cast("string").alias("username"),
        F.lit(False).alias("archived"),
        "msg_count",
    )


def dictionary() -> Dictionary:
    return Dictionary(PACK)


def verdict_of(model: str) -> Column:
    """The made-up verdict on a window, as JSON: one names the span of its anchors, the other its later half and a range beyond it."""

    def span(lo: Column, hi: Column, reason: Column) -> Column:
        return F.concat(
            F.lit('{"from": '), lo.cast("string"), F.lit(', "to": '), hi.cast("string"), F.lit(', "axis": "'), F.get("axes", F.lit(0)), F.lit('", "confidence": 0.5, "reason": "'), reason, F.lit('"}')
        )

    def verdict(ranges: Column, claims: Column) -> Column:
        return F.concat(F.lit('{"delete_ranges": ['), ranges, F.lit('], "protected": ['), claims, F.lit('], "need_context": null, "notes": ""}'))

    d, a, b = F.col("dialog_id"), F.col("from_id"), F.col("to_id")
    if model == MODELS[0]:
        reason = F.concat(F.lit("r"), (a % 3).cast("string"))
        ranges = span(F.element_at("anchors", 1), F.element_at("anchors", -1), reason)
        claim = F.concat(F.lit('{"from": '), a.cast("string"), F.lit(', "to": '), a.cast("string"), F.lit("}"))
        return F.when(d % 11 == 0, "not json").otherwise(verdict(ranges, claim))
    half = a + F.floor((b - a) / 2).cast("int")
    ranges = F.concat(span(b, half, F.lit("half")), F.lit(", "), span(b + 5, b + 900, F.lit("beyond")))
    return F.when(d % 3 == 0, verdict(F.lit(""), F.lit(""))).otherwise(verdict(ranges, F.lit("")))


def runs(windows: DataFrame) -> DataFrame:
    def of(model: str, passes: Column) -> DataFrame:
        return windows.select(
            "dialog_id",
            F.col("from_id").alias("window_from"),
            F.col("to_id").alias("window_to"),
            F.lit(model).alias("model"),
            F.lit(PROMPT).alias("prompt_id"),
            verdict_of(model).alias("raw"),
            (F.col("chars") + 10).cast("long").alias("prompt_tokens"),
            F.col("total").cast("long").alias("completion_tokens"),
            (F.col("total") * 0.25).alias("cost"),
            passes.alias("passes"),
            F.lit(NOW).cast("long").alias("created_at"),
        )

    return of(MODELS[0], F.when(F.col("dialog_id") % 5 == 0, 2).otherwise(1)).unionByName(of(MODELS[1], F.lit(1)))


def log_of(plan: DataFrame) -> DataFrame:
    """A made-up log: some messages done, some pending, the others failed."""
    n = F.col("msg_id") % 13
    state = F.when(n == 0, "done").when(n == 1, "pending").otherwise("error")
    return plan.select("dialog_id", "msg_id", F.lit("b").alias("batch_id"), state.alias("state"), F.lit(NOW).cast("long").alias("attempted_at"), F.lit(None).cast("string").alias("error"))
