"""Ingest of a chat export: nested JSON to typed dialogs and messages.

``text`` and ``forwarded_from`` change their type from message to message, so they are read as VARIANT.
One file is one task; for more than a few exports at a time, pass many files or JSON lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import scalars as S

MESSAGE = (
    "struct<id: int, type: string, date_unixtime: string, date: string, from_id: string, reply_to_message_id: int, forwarded_from: variant, "
    "media_type: string, mime_type: string, file: string, photo: string, text: variant>"
)
CHAT = f"id: bigint, name: string, type: string, messages: array<{MESSAGE}>"
EXPORT = f"personal_information struct<user_id: bigint>, chats struct<list: array<struct<{CHAT}>>>, " + ", ".join(
    (f"id bigint, name string, type string, messages array<{MESSAGE}>",)
)


@dataclass
class Ingested:
    dialogs: DataFrame
    messages: DataFrame
    #: One row: dialogs, messages, skipped_service, my_id.
    stats: DataFrame


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(EXPORT).json(path)


def read_texts(texts: DataFrame, column: str = "json") -> DataFrame:
    """Exports from a column of JSON texts."""
    return texts.select(F.from_json(column, EXPORT).alias("e")).select("e.*")


def chats_of(exports: DataFrame) -> DataFrame:
    """One row for each chat: the wrapper's list, else the file's own chat; a file with neither is an error."""
    own = F.when(F.col("id").isNotNull(), F.array(F.struct("id", "name", "type", "messages")))
    either = F.coalesce("chats.list", F.when(F.col("chats").isNotNull(), F.expr("filter(array(named_struct('id', id, 'name', name, 'type', type, 'messages', messages)), x -> false)")), own)
    found = F.coalesce(either, F.raise_error(F.lit("neither chats.list nor a single chat in the file")).cast(f"array<struct<{CHAT}>>"))
    return exports.select(F.explode(found).alias("c")).select("c.*")


def owner_of(exports: DataFrame, chats: DataFrame, owner: int | None = None) -> int | None:
    """The given id, else the file's, else the saved messages' id, else the most frequent other sender in personal chats (of equals the least id)."""
    if owner is not None:
        return owner
    said = exports.select(F.min("personal_information.user_id").alias("id")).first()["id"]
    if said is not None:
        return said
    saved = chats.filter("type = 'saved_messages' AND id IS NOT NULL").agg(F.min("id").alias("id")).first()["id"]
    if saved is not None:
        return saved
    senders = chats.filter("type = 'personal_chat' AND id IS NOT NULL").select("id", F.explode("messages.from_id").alias("from")).select("id", S.peer_id(F.col("from")).alias("sender"))
    most = senders.filter("sender IS NOT NULL AND sender <> id").groupBy("sender").count().orderBy(F.desc("count"), "sender").first()
    return most["sender"] if most else None


def flat_text(v: Column) -> Column:
    """A text that is a string, or a list of strings and entities with a text and a link; anything else is empty."""
    kind = F.schema_of_variant(v)

    def part(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        link = F.try_variant_get(x, "$.href", "string")
        entity = F.concat(F.coalesce(F.when(_is_text(x, "$.text"), F.try_variant_get(x, "$.text", "string")), F.lit("")), F.coalesce(F.when(_is_text(x, "$.href"), F.concat(F.lit(" "), link)), F.lit("")))
        return F.when(kind == "STRING", F.try_variant_get(x, "$", "string")).when(kind.startswith("OBJECT"), entity).otherwise("")

    joined = F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), part), "")
    return F.coalesce(F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind.startswith("ARRAY"), joined), F.lit(""))


def _is_text(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"


def value_text(v: Column) -> Column:
    """A JSON value as text: null and false are none, a string is itself unless empty, anything else its JSON."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    nothing = v.isNull() | F.coalesce(kind == "VOID", F.lit(True)) | ((kind == "BOOLEAN") & (text == "false"))
    return F.when(nothing, None).when((kind == "STRING") & (text != ""), text).otherwise(F.to_json(v))


def message_date(m: Column) -> Column:
    """Epoch seconds of the number or else of the time; a message with neither stops the ingest."""
    stamp = F.when(m["date_unixtime"].rlike(r"^[+-]?[0-9]+$"), m["date_unixtime"].try_cast("long"))
    failed = F.raise_error(F.concat(F.lit("message "), m["id"].cast("string"), F.lit(" has no date that can be read"))).cast("long")
    return F.coalesce(stamp, S.epoch_of_iso(m["date"]), failed)


def media(m: Column) -> Column:
    return F.coalesce(m["media_type"], F.when(m["photo"].isNotNull(), "photo"), F.when(m["file"].isNotNull(), F.coalesce(m["mime_type"], F.lit("file"))))


def ingest(exports: DataFrame, owner: int | None = None) -> Ingested:
    """Dialogs and messages of exports that belong to one owner; service messages are left out."""
    chats = chats_of(exports)
    me = owner_of(exports, chats, owner)
    known = chats.filter("id IS NOT NULL")
    is_service = lambda m: F.coalesce(m["type"], F.lit("")) == "service"
    kept = F.filter(F.coalesce("messages", F.expr("filter(messages, x -> false)")), lambda m: ~is_service(m))
    size = F.coalesce(F.size(kept), F.lit(0))
    dialogs = known.select(
        "id",
        S.peer_kind(F.coalesce("type", F.lit(""))).alias("kind"),
        F.lit(None).cast("long").alias("access_hash"),
        F.coalesce("name", F.concat(F.lit("id"), F.col("id").cast("string"))).alias("title"),
        F.lit(None).cast("string").alias("username"),
        F.lit(False).alias("archived"),
        F.greatest(size, F.lit(0)).cast("long").alias("msg_count"),
    )
    m = F.col("m")
    sender = S.peer_id(m["from_id"])
    rows = known.select("id", F.explode("messages").alias("m")).filter(~is_service(m))
    messages = rows.select(
        F.col("id").alias("dialog_id"),
        m["id"].alias("msg_id"),
        message_date(m).alias("date"),
        sender.alias("from_id"),
        F.coalesce(sender == F.lit(me).cast("long"), F.lit(False)).alias("outgoing"),
        m["reply_to_message_id"].alias("reply_to"),
        F.lit(None).cast("long").alias("grouped_id"),
        value_text(m["forwarded_from"]).alias("fwd_from"),
        media(m).alias("media_type"),
        F.coalesce(m["file"], m["photo"]).alias("file_path"),
        flat_text(m["text"]).alias("text"),
        F.lit(False).alias("protected"),
    )
    service = known.select(F.coalesce(F.size(F.filter("messages", is_service)), F.lit(0)).alias("n"))
    stats = dialogs.agg(F.count("*").alias("dialogs"), F.sum("msg_count").alias("messages")).crossJoin(service.agg(F.sum(F.greatest("n", F.lit(0))).alias("skipped_service")))
    return Ingested(dialogs, messages, stats.withColumn("my_id", F.lit(me).cast("long")))
