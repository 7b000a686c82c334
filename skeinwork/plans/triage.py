"""Triage: render windows, ask a provider, widen once where more context is asked for, keep good verdicts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.verdict import parsed, valid, verdict_schema
from skeinwork.operators import windows as W
from skeinwork.operators.plan import not_judged
from skeinwork.operators.render import render
from skeinwork.params import Params
from skeinwork.plans.policy import Prompt, Words
from skeinwork.plans.provider import Provider, Refused
from skeinwork.sources.scratch import written

REPLY = "dialog_id long, from_id int, to_id int, raw string, prompt_tokens long, completion_tokens long, cost double"


@dataclass
class Archive:
    dialogs: DataFrame
    placed: DataFrame  # messages with positions
    hits: DataFrame
    transcripts: DataFrame


def ask(rendered: DataFrame, provider: Provider, prompt: Prompt, axes: tuple[str, ...], jobs: int) -> DataFrame:
    """The provider's answers; a refused window has none. ``jobs`` windows are under way at a time."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        schema = verdict_schema(axes)
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                try:
                    reply = provider.complete(prompt.text, r.text, schema)
                except Refused:
                    continue
                rows.append((r.dialog_id, r.from_id, r.to_id, reply.content, reply.prompt_tokens, reply.completion_tokens, reply.cost))
            yield pd.DataFrame(rows, columns=["dialog_id", "from_id", "to_id", "raw", "prompt_tokens", "completion_tokens", "cost"])

    return rendered.repartition(jobs, "dialog_id", "from_id", "to_id").mapInPandas(call, REPLY)


def triage(windows: DataFrame, archive: Archive, runs: DataFrame, provider: Provider, prompt: Prompt, w: Words, axes: tuple[str, ...], p: Params, at: int, jobs: int = 8, save=written) -> DataFrame:
    """New rows of triage_runs for windows not judged yet.

    Keys are the original windows. A window that asks for more context is asked once more in its widened form,
    if it can be widened. Only valid verdicts are kept, so a repeat run tries the others again. ``save`` writes
    answers and reads them back, so that a paid call does not run twice. Of a window asked twice, the cost is the
    last call's; total_* have both.
    """
    todo = not_judged(windows, runs, provider.model, prompt.id)
    key = ["dialog_id", "from_id", "to_id"]
    show = lambda x: render(x, archive.placed, archive.hits, archive.dialogs, archive.transcripts, w)
    first = save(ask(show(todo), provider, prompt, axes, jobs), "first").withColumn("fine", valid(F.col("raw")))
    needs = first.filter("fine").withColumn("need", parsed(F.col("raw"), F.col("fine"))["need_context"])
    before, after = F.coalesce("need.before", F.lit(0)), F.coalesce("need.after", F.lit(0))
    asked = needs.filter((before > 0) | (after > 0)).select(*key, before.alias("before"), after.alias("after"))
    wide = W.expand(todo.join(asked, key), archive.placed.drop("pos"), p)
    wide = wide.join(todo.select("dialog_id", F.col("from_id").alias("window_from"), F.col("to_id").alias("window_to"), F.col("total").alias("old_total")), ["dialog_id", "window_from", "window_to"])
    wide = wide.filter("total > old_total")
    answers = save(ask(show(wide), provider, prompt, axes, jobs), "second").withColumn("fine", valid(F.col("raw")))
    origin = wide.select(*key, "window_from", "window_to")
    second = origin.join(answers, key, "left").select("dialog_id", F.col("window_from").alias("from_id"), F.col("window_to").alias("to_id"), *(F.col(c).alias(f"{c}2") for c in ("raw", "fine", "prompt_tokens", "completion_tokens", "cost")), F.lit(True).alias("twice"))
    both = first.join(second, key, "left")
    twice = F.coalesce("twice", F.lit(False))
    pick = lambda c: F.when(twice, F.col(f"{c}2")).otherwise(F.col(c))
    total = lambda c: F.col(c) + F.coalesce(F.col(f"{c}2"), F.lit(0))
    return both.filter(F.coalesce(pick("fine"), F.lit(False))).select(
        "dialog_id",
        F.col("from_id").alias("window_from"),
        F.col("to_id").alias("window_to"),
        F.lit(provider.model).alias("model"),
        F.lit(prompt.id).alias("prompt_id"),
        pick("raw").alias("raw"),
        pick("prompt_tokens").alias("prompt_tokens"),
        pick("completion_tokens").alias("completion_tokens"),
        pick("cost").alias("cost"),
        F.when(twice, 2).otherwise(1).alias("passes"),
        F.lit(at).cast("long").alias("created_at"),
        total("prompt_tokens").alias("total_prompt_tokens"),
        total("completion_tokens").alias("total_completion_tokens"),
        total("cost").alias("total_cost"),
    )
