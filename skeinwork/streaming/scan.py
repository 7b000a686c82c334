"""Scanning messages as they come: the same keyword pass on a stream, stored once each, and counts by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.matcher import Dictionary, regex_matches, term_matches
from skeinwork.operators.scan import keyword_pass
from skeinwork.params import Params
from skeinwork.sources.store import Store


def hits_of(stream: DataFrame, dictionary: Dictionary, p: Params) -> DataFrame:
    """Hits of a stream of messages; stateless, so any output mode will do. Ties by reply or album need the whole dialog and are left to a scan."""
    return keyword_pass(stream, dictionary, p).hits


def store_hits(stream: DataFrame, dictionary: Dictionary, p: Params, store: Store, checkpoint: str):
    """Write a stream's hits to a store. A batch that runs again replaces its own rows, so each hit is there once."""
    return hits_of(stream, dictionary, p).writeStream.foreachBatch(lambda rows, _: store.replace("hits", rows)).option("checkpointLocation", checkpoint)


def counts_by_time(stream: DataFrame, dictionary: Dictionary, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Hits by axis in windows of message time; late messages count until the watermark has passed."""
    return (
        stream.withColumn("at", F.timestamp_seconds("date"))
        .withWatermark("at", late)
        .transform(lambda s: _axes(s, dictionary))
        .groupBy(F.window("at", window), "axis")
        .agg(F.count("*").alias("hits"))
        .select(F.col("window.start").alias("start"), "axis", "hits")
    )


def _axes(stream: DataFrame, dictionary: Dictionary) -> DataFrame:
    found = regex_matches(F.col("text"), dictionary.regexes)
    if dictionary.terms:
        found = F.concat(term_matches(dictionary)(F.col("text"))["matches"], found)
    return stream.select("at", F.explode(F.transform(found, lambda m: m["axis"])).alias("axis"))
