"""Scan: hits of a rule pack, then what replies and albums tie to them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import scalars as S
from skeinwork.functions.matcher import Dictionary, regex_matches, term_matches
from skeinwork.params import Params

HIT = ("dialog_id", "msg_id", "axis", "rule_id", "term", "surface", "layer", "tier", "priority", "protected")
#: Ties of a message to a hit; a later one is preferred.
TIES = ("reply_to_hit", "replied_by_hit", "same_album")


@dataclass
class Scanned:
    hits: DataFrame
    #: The messages with their protected flag.
    messages: DataFrame


def _only(dictionary: Dictionary, axis: str | None) -> Dictionary:
    """Matching is by rule and term, and equal normal forms are settled over the whole pack, so only expressions can go beforehand."""
    if axis is None:
        return dictionary
    return Dictionary(tuple(r for r in dictionary.rules if r.kind == "term" or r.axis == axis), dictionary.keep, dictionary.override, dictionary.least)


def keyword_pass(messages: DataFrame, dictionary: Dictionary, p: Params, axis: str | None = None) -> Scanned:
    """Hits of terms and expressions. A keep-list is checked for every text, whether a rule fires or not."""
    chosen = _only(dictionary, axis)
    needs_terms = bool(chosen.terms or chosen.keep)
    found = regex_matches(F.col("text"), chosen.regexes)
    if needs_terms:
        scanned = messages.withColumn("__s", term_matches(chosen)(F.col("text")))
        scanned = scanned.withColumn("protected", F.coalesce(F.col("__s.protected") & (F.col("text") != ""), F.lit(False))).withColumn("__m", F.concat("__s.matches", found)).drop("__s")
    else:
        scanned = messages.withColumn("protected", F.lit(False)).withColumn("__m", found)
    tier = S.tier(F.col("date"), p)
    rows = scanned.filter("text <> ''").select("dialog_id", "msg_id", "protected", tier.alias("tier"), F.explode("__m").alias("m"))
    if axis is not None:
        rows = rows.filter(F.col("m.axis") == axis)
    hits = rows.select(
        "dialog_id",
        "msg_id",
        "m.axis",
        "m.rule_id",
        "m.term",
        "m.surface",
        "m.layer",
        "tier",
        (F.col("m.weight") * S.multiplier(F.col("tier"), p)).alias("priority"),
        (F.col("protected") & ~F.col("m.axis").isin(*p.hard_axes)).alias("protected"),
    )
    return Scanned(hits, scanned.drop("__m"))


def structural_pass(messages: DataFrame, hits: DataFrame, p: Params) -> DataFrame:
    """A weak hit for each message without one that replies to a hit, is replied to by one, or shares its album."""
    marked = hits.select("dialog_id", "msg_id").distinct()
    light = messages.select("dialog_id", "msg_id", "date", "reply_to", "grouped_id")
    hit_rows = light.join(marked, ["dialog_id", "msg_id"], "left_semi")
    targets = marked.select("dialog_id", F.col("msg_id").alias("reply_to"))
    children = light.filter("reply_to IS NOT NULL").join(targets, ["dialog_id", "reply_to"], "left_semi").select("dialog_id", "msg_id", F.lit(0).alias("tie"))
    parents = hit_rows.filter("reply_to IS NOT NULL").select("dialog_id", F.col("reply_to").alias("msg_id"), F.lit(1).alias("tie")).distinct()
    albums = hit_rows.filter("grouped_id IS NOT NULL").select("dialog_id", "grouped_id").distinct()
    mates = light.filter("grouped_id IS NOT NULL").join(albums, ["dialog_id", "grouped_id"], "left_semi").select("dialog_id", "msg_id", F.lit(2).alias("tie"))
    ties = children.unionByName(parents).unionByName(mates).groupBy("dialog_id", "msg_id").agg(F.max("tie").alias("tie"))
    # The join with the messages drops parents that are not in the dialog.
    added = ties.join(marked, ["dialog_id", "msg_id"], "left_anti").join(light.select("dialog_id", "msg_id", "date"), ["dialog_id", "msg_id"])
    name = F.get(F.array(*(F.lit(t) for t in TIES)), F.col("tie"))
    tier = S.tier(F.col("date"), p)
    return added.select(
        "dialog_id",
        "msg_id",
        F.lit(p.structural_axis).alias("axis"),
        name.alias("rule_id"),
        name.alias("term"),
        F.lit(None).cast("string").alias("surface"),
        F.lit("structural").alias("layer"),
        tier.alias("tier"),
        (F.lit(p.structural_weight) * S.multiplier(tier, p)).alias("priority"),
        F.lit(False).alias("protected"),
    )


def scan(messages: DataFrame, dictionary: Dictionary, p: Params, axis: str | None = None) -> Scanned:
    """Both passes; the structural one sees the hits that are left by the axis filter."""
    first = keyword_pass(messages, dictionary, p, axis)
    return Scanned(first.hits.unionByName(structural_pass(messages, first.hits, p)), first.messages)


def totals(messages: DataFrame, hits: DataFrame) -> DataFrame:
    n = messages.agg(F.count("*").alias("messages"))
    m = hits.agg(F.countDistinct("dialog_id", "msg_id").alias("marked"), F.coalesce(F.sum(F.col("protected").cast("long")), F.lit(0)).alias("protected_hits"))
    return n.crossJoin(m).withColumn("share", F.when(F.col("messages") > 0, F.round(F.col("marked") / F.col("messages"), 6)))


def by_axis_and_tier(hits: DataFrame) -> DataFrame:
    return hits.groupBy("axis", "tier").agg(F.count("*").alias("hits"), F.countDistinct("dialog_id", "msg_id").alias("messages"))


def top_rules(hits: DataFrame, most: int = 25) -> DataFrame:
    return hits.groupBy("rule_id", "term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id", "term").limit(most)


def density(hits: DataFrame, dialogs: DataFrame, most: int = 20) -> DataFrame:
    counted = hits.groupBy("dialog_id").agg(F.countDistinct("msg_id").alias("marked"))
    share = F.when(F.col("msg_count") > 0, F.round(100.0 * F.col("marked") / F.col("msg_count"), 6)).otherwise(0.0)
    return (
        counted.join(dialogs.select(F.col("id").alias("dialog_id"), "title", "msg_count"), "dialog_id")
        .select("dialog_id", "title", "marked", "msg_count", share.alias("percent"))
        .orderBy(F.desc("marked"), "dialog_id")
        .limit(most)
    )
