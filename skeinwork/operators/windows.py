"""Windows: anchors, clusters of anchors by position, context around them, and which windows a run takes.

Clusters are gaps and islands over the anchors alone. One dialog's anchors are ordered in one task; its
messages never are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.functions import scalars as S
from skeinwork.operators.positions import bounded, with_positions
from skeinwork.params import Params
from skeinwork.sources.scratch import written

KEY = ("dialog_id", "from_id", "to_id")
#: What a window costs beside its characters: the line overhead of 60 messages and the policy.
TOKENS_A_WINDOW = 60 * 25 // 2 + 1200


@dataclass(frozen=True)
class Cutoff:
    """For a repeat run: windows with an anchor since then, or with a rule that is new."""

    since: int
    new_rules: tuple[str, ...] = ()

    @classmethod
    def of(cls, since: str | None, new_rules: tuple[str, ...] = ()) -> Cutoff | None:
        if since is None:
            if new_rules:
                raise ValueError("new rules only mean something together with a date")
            return None
        return cls(S.midnight(since), tuple(new_rules))


def message_hits(messages: DataFrame, hits: DataFrame, p: Params) -> DataFrame:
    """Every message with the sum of its hits' priorities, their axes and rules (sorted), and the harshest tier."""
    summed = hits.groupBy("dialog_id", "msg_id").agg(
        F.round(F.sum("priority"), 9).alias("priority"),
        F.sort_array(F.collect_set("axis")).alias("axes"),
        F.sort_array(F.collect_set("rule_id")).alias("rules"),
        F.min("tier").alias("tier"),
    )
    none = F.array().cast("array<string>")
    return messages.join(summed, ["dialog_id", "msg_id"], "left").select(
        *messages.columns, F.coalesce("priority", F.lit(0.0)).alias("priority"), F.coalesce("axes", none).alias("axes"), F.coalesce("rules", none).alias("rules"), "tier"
    )


def is_anchor(p: Params) -> Column:
    held = F.col("protected")
    if p.honour_hard_axes:
        held = held & ~F.arrays_overlap("axes", F.array(*(F.lit(a) for a in p.hard_axes)))
    return ~held & (F.col("priority") >= p.threshold)


def clustered(anchors: DataFrame, gap: int) -> DataFrame:
    """Add the number of the cluster: a new one begins where more than ``gap`` positions lie between anchors."""
    order = Window.partitionBy("dialog_id").orderBy("pos")
    fresh = F.coalesce((F.col("pos") - F.lag("pos").over(order) > gap).cast("int"), F.lit(1))
    return anchors.withColumn("__fresh", fresh).withColumn("cluster", F.sum("__fresh").over(order)).drop("__fresh")


def build(messages: DataFrame, hits: DataFrame, dialogs: DataFrame, p: Params) -> DataFrame:
    """One row for each window: its ends, anchors, axes, tier, voices, total, chars, newest anchor and rules."""
    wanted = dialogs.filter(~F.col("kind").isin(*p.ignore_kinds)) if p.ignore_kinds else dialogs
    if p.ignore_dialogs:
        wanted = wanted.filter(~F.col("id").isin(*p.ignore_dialogs))
    # Positions serve the anchors, the dialogs' ends and the windows' measures.
    placed = written(with_positions(messages.select("dialog_id", "msg_id", "date", "protected", "media_type", "text").join(wanted.select(F.col("id").alias("dialog_id")), "dialog_id", "left_semi")), "placed")
    lean = placed.select("dialog_id", "msg_id", "date", "protected", "pos")
    anchors = message_hits(lean, hits, p).filter(is_anchor(p))
    last = placed.groupBy("dialog_id").agg(F.max("pos").alias("last"))
    clusters = clustered(anchors, p.gap).groupBy("dialog_id", "cluster").agg(
        F.min("pos").alias("a"),
        F.max("pos").alias("b"),
        F.sort_array(F.collect_list("msg_id")).alias("anchors"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("axes")))).alias("axes"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("rules")))).alias("rules"),
        F.greatest(F.max("date"), F.lit(0).cast("long")).alias("newest"),
        F.coalesce(F.min("tier"), F.lit("T2")).alias("tier"),
    )
    spans = written(clusters, "clusters").join(last, "dialog_id").withColumns({"first_pos": F.greatest(F.col("a") - p.pad, F.lit(0).cast("long")), "last_pos": F.least(F.col("b") + p.pad, F.col("last"))})
    keys = ["dialog_id", "cluster"]
    inside = spans.select(*keys, F.explode(F.sequence("first_pos", "last_pos")).alias("pos")).join(_measures(placed), ["dialog_id", "pos"])
    return inside.groupBy(*keys).agg(*_measured()).join(spans, keys).select(*KEY, "anchors", "axes", "tier", "voices", "total", "chars", "newest", "rules")


def _measures(placed: DataFrame) -> DataFrame:
    return placed.select("dialog_id", "pos", "msg_id", S.is_voice(F.col("media_type")).alias("voice"), F.char_length("text").alias("size"))


def _measured() -> list[Column]:
    return [
        F.min("msg_id").alias("from_id"),
        F.max("msg_id").alias("to_id"),
        F.count("*").alias("total"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("chars"),
        F.sort_array(F.collect_list(F.when(F.col("voice"), F.col("msg_id")))).alias("voices"),
    ]


def expand(windows: DataFrame, messages: DataFrame, p: Params) -> DataFrame:
    """Widen windows by their columns ``before`` and ``after``, in proportion up to the largest size.

    The original ends stay in window_from and window_to.
    """
    placed = written(with_positions(messages.select("dialog_id", "msg_id", "media_type", "text")), "placed")
    last = placed.groupBy("dialog_id").agg(F.max("pos").alias("__last"))
    room = F.greatest(F.lit(p.max_window) - F.col("total"), F.lit(0)).cast("long")
    before, after = (F.greatest(F.col(c).cast("long"), F.lit(0).cast("long")) for c in ("before", "after"))
    rows = windows.select("*", before.alias("__b"), after.alias("__a"), room.alias("__room")).withColumn("__asked", F.greatest(F.col("__b") + F.col("__a"), F.lit(1).cast("long")))
    rows = bounded(rows, placed, "from_id", "to_id").join(last, "dialog_id")
    first = F.greatest(F.col("first_pos") - F.expr("__b * __room div __asked"), F.lit(0).cast("long"))
    end = F.least(F.col("last_pos") + F.expr("__a * __room div __asked"), F.col("__last"))
    keep = [c for c in windows.columns if c not in ("from_id", "to_id", "total", "chars", "voices")]
    rows = rows.select(*keep, F.col("from_id").alias("window_from"), F.col("to_id").alias("window_to"), first.alias("__first"), end.alias("__end"))
    inside = rows.select("dialog_id", "window_from", "window_to", F.explode(F.sequence("__first", "__end")).alias("pos")).join(_measures(placed), ["dialog_id", "pos"])
    keys = ["dialog_id", "window_from", "window_to"]
    return rows.drop("__first", "__end").join(inside.groupBy(*keys).agg(*_measured()), keys)


def _order() -> list[Column]:
    return [F.col("tier"), F.desc(F.size("anchors")), F.col("dialog_id"), F.col("from_id")]


def select(windows: DataFrame, limit: int | None = None, sample: int | None = None, cutoff: Cutoff | None = None) -> DataFrame:
    """The windows of a run, in order: by cutoff first; a sample (in turn from each axis) goes before a limit."""
    if cutoff is not None:
        fresh = F.col("newest") >= cutoff.since
        if cutoff.new_rules:
            fresh = fresh | F.arrays_overlap("rules", F.array(*(F.lit(r) for r in cutoff.new_rules)))
        windows = windows.filter(fresh)
    if sample is not None:
        stratum = F.coalesce(F.get("axes", F.lit(0)), F.lit(""))
        turn = F.row_number().over(Window.partitionBy("__axis").orderBy(S.fnv_of_ids(F.col("dialog_id"), F.col("from_id")), *_order()))
        taken = windows.withColumn("__axis", stratum).withColumn("__turn", turn).orderBy("__turn", "__axis").limit(sample)
        return taken.drop("__axis", "__turn").orderBy("dialog_id", "from_id")
    ordered = windows.orderBy(*_order())
    return ordered if limit is None else ordered.limit(limit)


def report(windows: DataFrame) -> DataFrame:
    """One row: calls, messages, voices, chars, size percentiles by floor index, and the estimate of tokens."""
    sums = windows.agg(
        F.count("*").alias("windows"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("messages"),
        F.coalesce(F.sum(F.size("voices")), F.lit(0)).alias("voices"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"),
    )
    # Sizes are few; their counts stand for the windows.
    sizes = windows.groupBy("total").agg(F.count("*").alias("n"))
    running = sizes.withColumn("upto", F.sum("n").over(Window.orderBy("total").rowsBetween(Window.unboundedPreceding, 0)))
    n = sums.select(F.col("windows").alias("all"))
    spots = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "max": 1.0}
    at = [F.min(F.when(F.col("upto") > F.floor((F.col("all") - 1) * F.lit(q)), F.col("total"))).alias(name) for name, q in spots.items()]
    tokens = F.floor(F.col("chars") / 2) + F.col("windows") * TOKENS_A_WINDOW
    return sums.crossJoin(running.crossJoin(n).agg(*at)).withColumn("tokens", tokens).withColumn("tokens_a_call", F.floor(F.col("tokens") / F.greatest("windows", F.lit(1))))


def by_tier(windows: DataFrame) -> DataFrame:
    return windows.groupBy("tier").agg(F.count("*").alias("windows"))


def by_axis(windows: DataFrame) -> DataFrame:
    return windows.select(F.explode("axes").alias("axis")).groupBy("axis").agg(F.count("*").alias("windows"))
