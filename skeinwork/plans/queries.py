"""One query for each operator, over the stand-in archive, with columns that SQL can match."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import scalars as S
from skeinwork.functions.matcher import BUNDLED, Dictionary, Rule, term_matches
from skeinwork.functions.verdict import parsed, valid
from skeinwork.operators import audit, chunks, diff, evaluate, plan, scan, windows
from skeinwork.operators.positions import with_positions
from skeinwork.operators.render import render
from skeinwork.params import Params
from skeinwork.plans import cases
from skeinwork.plans import corpus as C
from skeinwork.plans.policy import ENGLISH
from skeinwork.sources import export, store
from skeinwork.sources.scratch import written
from skeinwork.sources.tables import read_spread

Query = Callable[[SparkSession, str], DataFrame]
P = C.EVENTS


def joined(column: str) -> Column:
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


class Archive:
    """The tables of the stand-in archive. Each is written once, when it is first used, as a store would hold it."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.messages, self.dialogs = C.messages(spark, sf_dir), C.dialogs(spark, sf_dir)

    @cached_property
    def placed(self) -> DataFrame:
        return written(with_positions(self.messages), "placed")

    @cached_property
    def keyword_hits(self) -> DataFrame:
        # The flag of the stand-in stays; the pack has no keep-list.
        return scan.keyword_pass(self.messages, C.dictionary(), P).hits

    @cached_property
    def hits(self) -> DataFrame:
        first = written(self.keyword_hits, "hits")
        return written(first.unionByName(scan.structural_pass(self.placed, first, P)), "hits")

    @cached_property
    def windows(self) -> DataFrame:
        return written(windows.build(self.placed.drop("pos"), self.hits, self.dialogs, P), "windows")

    @cached_property
    def runs(self) -> DataFrame:
        return written(C.runs(self.windows), "runs")

    @cached_property
    def plan(self) -> DataFrame:
        return written(plan.build_plan(self.runs, self.placed, C.MODELS[0], C.PROMPT), "plan")

    def approved(self) -> DataFrame:
        return plan.approve(self.plan, axis="ops")


def listed(df: DataFrame) -> DataFrame:
    return df.select("dialog_id", "from_id", "to_id", joined("anchors"), joined("axes"), "tier", joined("voices"), "total", "chars", "newest", joined("rules"))


def regex_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bundled pack over documents: hits by axis, rule and age."""
    docs = read_spread(spark, sf_dir, "documents")
    p = Params(now=C.NOW)
    as_messages = docs.select(F.col("doc_id").alias("dialog_id"), F.lit(1).alias("msg_id"), (F.lit(C.NOW) - F.col("doc_id") * 40_000).alias("date"), F.coalesce("text", F.lit("")).alias("text"))
    hits = scan.keyword_pass(as_messages, Dictionary(BUNDLED), p).hits
    return hits.groupBy("axis", "rule_id", "tier").agg(F.count("*").alias("hits"), F.countDistinct("dialog_id", "msg_id").alias("messages"), F.round(F.sum("priority"), 6).alias("priority"))


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = C.read(spark, sf_dir, "orders")
    p = Params(now=S.midnight("2001-08-01"))
    tier = S.tier(C.seconds(o, "o_orderdate").cast("long"), p)
    return o.select(tier.alias("tier")).groupBy("tier").agg(F.count("*").alias("orders"), F.round(F.sum(S.multiplier(F.col("tier"), p)), 6).alias("weight"))


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every card-number hit with its clipped surface."""
    docs = read_spread(spark, sf_dir, "documents")
    as_messages = docs.select(F.col("doc_id").alias("dialog_id"), F.lit(1).alias("msg_id"), F.lit(C.NOW).cast("long").alias("date"), F.coalesce("text", F.lit("")).alias("text"))
    return scan.keyword_pass(as_messages, Dictionary(tuple(r for r in BUNDLED if r.rule_id == "card_number")), Params(now=C.NOW)).hits.select("dialog_id", "rule_id", "surface", "priority")


def messages_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_positions(C.messages(spark, sf_dir)).drop("fwd_from", "file_path")


def term_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems and a keep-list over conversations: normal forms, matches and protection."""
    pack = Dictionary((Rule("words", "stem", 1.0, "term", "tion"), Rule("words", "phrase", 1.0, "term", "the the"), Rule("words", "other", 2.0, "term", "здравств")), keep=("halyon",), override=("scum",))
    c = read_spread(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    s = c.select("conv_id", "turn", term_matches(pack)(F.coalesce("text", F.lit(""))).alias("s"))
    return s.select("conv_id", "turn", F.length("s.normal").alias("letters"), "s.protected", F.array_join(F.transform("s.matches", lambda m: F.concat_ws(":", m["rule_id"], m["surface"])), ",").alias("matches"))


def ingest_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as one export and read back; texts alternate between plain and entity lists."""
    return export.ingest(_exports(spark, sf_dir)).messages.select("dialog_id", "msg_id", "date", "from_id", "outgoing", "reply_to", "fwd_from", "media_type", "file_path", "text")


def ingest_dialogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.ingest(_exports(spark, sf_dir)).dialogs.select("id", "kind", "title", "msg_count")


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.read(spark, sf_dir, "conversations")
    text = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("x")))
    plain = F.regexp_extract(text, r"(?s)^\{\"x\":(.*)\}$", 1)
    entity = F.concat(F.lit('["> ", {"type": "link", "text": '), plain, F.lit(', "href": "http://a.b"}, 7]'))
    message = F.concat(
        F.lit('{"id": '), F.col("turn").cast("string"), F.lit(', "type": "'), F.when(F.col("role") == "system", "service").otherwise("message"), F.lit('", "date_unixtime": "'),
        (F.col("conv_id") * 3600 + F.col("turn") * 60).cast("string"), F.lit('", "from_id": "user'), F.when(F.col("role") == "user", F.lit("1")).otherwise((F.col("conv_id") + 100).cast("string")),
        F.lit('"'), F.when(F.col("turn") > 0, F.concat(F.lit(', "reply_to_message_id": '), (F.col("turn") - 1).cast("string"))).otherwise(""),
        F.when(F.col("turn") % 3 == 2, F.lit(', "photo": "p.jpg"')).otherwise(""), F.lit(', "text": '), F.when(F.col("turn") % 2 == 0, plain).otherwise(entity), F.lit("}"),
    )
    chat = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"]), ",").alias("ms"))
    one = F.concat(F.lit('{"chats": {"list": [{"id": '), (F.col("conv_id") + 100).cast("string"), F.lit(', "type": "personal_chat", "messages": ['), F.col("ms"), F.lit("]}]}}"))
    return export.read_texts(chat.select(one.alias("json")))


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second ingest whose dialogs are known, new, or missing: its ids are moved."""
    old = C.dialogs(spark, sf_dir)
    new = old.withColumns({"id": F.col("id") + 40, "title": F.concat(F.lit("new "), "title"), "access_hash": F.lit(None).cast("long"), "msg_count": F.col("msg_count") - F.col("id") % 5 + 2})
    return store.upserted_dialogs(old, new).select("id", "kind", "access_hash", "title", "msg_count")


def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages ingested a second time, a quarter under their old ids: the new row stays, without its protection."""
    old = C.messages(spark, sf_dir)
    again = F.when(F.col("msg_id") % 4 == 0, F.col("msg_id")).otherwise(F.col("msg_id") + 100_000_000)
    new = old.withColumns({"msg_id": again, "text": F.concat(F.lit("again "), "text"), "protected": F.lit(False)})
    return store.newest(old, new, ["dialog_id", "msg_id"]).groupBy("dialog_id").agg(F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"), F.sum(F.col("protected").cast("int")).alias("protected"))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access hashes of a second source, which knows only some."""
    found = C.dialogs(spark, sf_dir).select("id", F.when(F.col("id") % 8 == 0, F.col("id") + 7).alias("access_hash"))
    d = store.with_access_hashes(C.dialogs(spark, sf_dir), found)
    return d.select("id", "access_hash", S.addressable(F.col("kind"), F.col("access_hash")).alias("peer_ok"))


def not_judged(a: Archive) -> DataFrame:
    """Windows to do when odd dialogs were judged under an older policy."""
    runs = a.runs.withColumn("prompt_id", F.when(F.col("dialog_id") % 2 == 0, C.PROMPT).otherwise("en-0"))
    return plan.not_judged(a.windows, runs, C.MODELS[0], C.PROMPT).select("dialog_id", "from_id", "to_id")


def verdict_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict parser over texts made from orders, good and bad in nine ways."""
    o = C.read(spark, sf_dir, "orders")
    n = F.col("o_orderkey") % 9
    lo = F.col("o_orderkey").cast("string")
    spoilt = (
        F.when(n == 0, F.concat(F.lit('{"delete_ranges": [{"from": '), lo, F.lit(', "to": 9}]}')))
        .when(n == 1, F.lit("nothing"))
        .when(n == 2, F.lit('{"delete_ranges": [{"to": 9}]}'))
        .when(n == 3, F.lit('{"delete_ranges": [{"from": 1.0, "to": 9}]}'))
        .when(n == 4, F.lit('{"delete_ranges": null}'))
        .when(n == 5, F.lit('{"delete_ranges": []} and more'))
        .when(n == 6, F.lit('{"delete_ranges": [{"from": 764667000000, "to": 2, "extra": [1]}], "need_context": null}'))
        .when(n == 7, F.lit('{"delete_ranges": [{"from": true, "to": 2}]}'))
        .otherwise(F.lit('{"protected": [{"from": 3, "to": 4}]}'))
    )
    rows = o.select(F.col("o_orderkey").alias("id"), spoilt.alias("raw")).withColumn("fine", valid(F.col("raw"))).withColumn("v", parsed(F.col("raw"), F.col("fine")))
    return rows.select("id", "fine", F.size("v.delete_ranges").alias("ranges"), F.size("v.protected").alias("claims"), F.get("v.delete_ranges", F.lit(0))["from"].alias("first_from"))


def expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Archive(spark, sf_dir)
    wide = a.windows.withColumns({"before": F.col("from_id") % 4, "after": F.col("to_id") % 3})
    return windows.expand(wide, a.messages, P).select("dialog_id", "window_from", "window_to", "from_id", "to_id", "total", "chars")


def run_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Archive(spark, sf_dir)
    p = a.approved()
    return chunks.estimate(chunks.chunked(chunks.deletable(p, a.dialogs, a.placed, C.log_of(p)), P))


def work(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = Archive(spark, sf_dir)
    p = a.approved()
    rows = chunks.deletable(p, a.dialogs, a.placed, C.log_of(p))
    return chunks.chunked(rows, P), chunks.by_dialog(rows)


def chunk_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = work(spark, sf_dir)
    return found.select("dialog_id", "chunk", "first_id", "last_id", "messages")


def chunk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, dialogs = work(spark, sf_dir)
    return chunks.budgeted(found, dialogs, 40).select("number", "dialog_id", "chunk", "first_id", "messages", "peer_ok")


def compared(spark: SparkSession, sf_dir: str) -> tuple[Archive, DataFrame, DataFrame]:
    a = Archive(spark, sf_dir)
    return a, *diff.compared(a.runs, a.placed, *C.MODELS)


def diff_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _, both = compared(spark, sf_dir)
    return diff.tails(both, a.messages, a.dialogs)


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Archive(spark, sf_dir)
    said = F.when(F.col("media_type").isNotNull() & (F.col("msg_id") % 20 == 0), "said")
    spoken = a.messages.select("dialog_id", "msg_id", said.alias("text"), F.lit("m").alias("model"))
    return render(a.windows, a.placed, a.hits, a.dialogs, spoken, ENGLISH)


def on_archive(f: Callable[[Archive], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(Archive(spark, sf_dir))


def queries() -> dict[str, Query]:
    cutoff = windows.Cutoff.of("2024-01-20", ("purchases",))
    return {
        "regex_scan": regex_scan,
        "regex_surfaces": surfaces,
        "age_tiers": tiers,
        "positions": messages_sample,
        "term_scan": term_scan,
        **cases.queries(),
        "ingest_messages": ingest_export,
        "ingest_dialogs": ingest_dialogs,
        "upsert_dialogs": upsert,
        "replace_messages": replaced,
        "enrich_access_hash": enriched,
        "keyword_hits": on_archive(lambda a: a.keyword_hits),
        "structural_hits": on_archive(lambda a: scan.structural_pass(a.messages, a.keyword_hits, P)),
        "scan_axis_only": on_archive(lambda a: scan.by_axis_and_tier(scan.scan(a.messages, C.dictionary(), P, "ops").hits)),
        "scan_totals": on_archive(lambda a: scan.totals(a.messages, a.hits)),
        "scan_by_axis_tier": on_archive(lambda a: scan.by_axis_and_tier(a.hits)),
        "scan_top_rules": on_archive(lambda a: scan.top_rules(a.hits)),
        "scan_density": on_archive(lambda a: scan.density(a.hits, a.dialogs)),
        "message_hits": on_archive(lambda a: windows.message_hits(a.messages, a.hits, P).select("dialog_id", "msg_id", "priority", joined("axes"), joined("rules"), "tier")),
        "windows": on_archive(lambda a: listed(a.windows)),
        "windows_report": on_archive(lambda a: windows.report(a.windows)),
        "windows_by_tier": on_archive(lambda a: windows.by_tier(a.windows)),
        "windows_by_axis": on_archive(lambda a: windows.by_axis(a.windows)),
        "windows_limit": on_archive(lambda a: listed(windows.select(a.windows, limit=25))),
        "windows_sample": on_archive(lambda a: listed(windows.select(a.windows, limit=3, sample=25))),
        "windows_cutoff": on_archive(lambda a: listed(windows.select(a.windows, cutoff=cutoff))),
        "windows_expand": expanded,
        "windows_not_judged": on_archive(not_judged),
        "window_text": rendered,
        "verdict_check": verdict_check,
        "plan": on_archive(lambda a: a.plan),
        "plan_beta": on_archive(lambda a: plan.build_plan(a.runs, a.placed, C.MODELS[1])),
        "plan_approved": on_archive(lambda a: plan.approve(plan.approve(a.plan, axis="ops"), on=False, dialog=3).groupBy("dialog_id", "approved").agg(F.count("*").alias("n"))),
        "plan_budget": on_archive(lambda a: plan.budget(a.approved(), a.messages, a.dialogs, P)),
        "plan_worst_dialogs": on_archive(lambda a: plan.worst_dialogs(a.plan, a.dialogs)),
        "eval_runs": on_archive(lambda a: evaluate.run_quality(a.runs, a.placed, a.windows)),
        "eval_spend": on_archive(lambda a: evaluate.spend(a.runs)),
        "eval_agreement": on_archive(lambda a: evaluate.agreement(evaluate.pairs(a.runs, a.placed))),
        "eval_split_windows": on_archive(lambda a: evaluate.split_windows(evaluate.pairs(a.runs, a.placed))),
        "diff_summary": lambda s, d: diff.summary(*compared(s, d)[1:]),
        "diff_tails": diff_tails,
        "audit_terms": on_archive(lambda a: audit.terms(a.hits, least=5, containing="s")),
        "audit_rules": on_archive(lambda a: audit.rules(a.hits, a.runs, a.placed, C.MODELS[0])),
        "audit_samples": on_archive(lambda a: audit.samples(a.hits, a.messages)),
        "deletable": on_archive(lambda a: chunks.deletable(a.approved(), a.dialogs, a.placed, C.log_of(a.approved())).select("dialog_id", "msg_id", "kind", "title", "peer_ok", "date")),
        "log_states": on_archive(lambda a: chunks.states(C.log_of(a.approved()))),
        "chunks": chunk_list,
        "chunk_dialogs": lambda s, d: work(s, d)[1],
        "chunk_budget": chunk_budget,
        "chunk_estimate": run_estimate,
    }
