"""Scalar expressions; all are built in, so they stay inside generated code."""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinwork.params import DAY, Params

TIERS = ("T0", "T1", "T2")
LAYERS = ("keyword", "regex", "structural")
#: Chat types of an export and the kinds of peer that they mean; any other is a megagroup.
PEER_KINDS = {
    "personal_chat": "user",
    "bot_chat": "user",
    "replies": "user",
    "saved_messages": "saved_messages",
    "private_group": "chat",
    "private_supergroup": "megagroup",
    "public_supergroup": "megagroup",
    "private_channel": "channel",
    "public_channel": "channel",
}
VOICES = ("voice_message", "video_message")
FNV_START, FNV_PRIME = 2_166_136_261, 16_777_619


def peer_kind(export_type: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in PEER_KINDS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, export_type), F.lit("megagroup"))


def peer_id(text: Column) -> Column:
    """The number that is left when leading characters other than digits and minus are cut; null if it is none."""
    rest = F.regexp_replace(text, r"^[^0-9\-]+", "")
    return F.when(rest.rlike(r"^-?[0-9]+$"), rest.try_cast("long"))


def epoch_of_iso(text: Column) -> Column:
    """Epoch seconds of an ISO time without zone, read as UTC whatever the session's zone; null if malformed."""
    good = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"), text)
    days = F.datediff(F.substring(good, 1, 10).try_cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    clock = [F.substring(good, at, 2).try_cast("int") for at in (12, 15, 18)]
    fine = (clock[0] < 24) & (clock[1] < 60) & (clock[2] < 60)
    return F.when(fine, days * DAY + clock[0] * 3600 + clock[1] * 60 + clock[2])


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp with or without zone (without: UTC)."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000)).cast("long")


def tier(date: Column, p: Params) -> Column:
    """Age bucket by whole days; a future date is the freshest."""
    days = F.floor((F.lit(p.now) - date) / F.lit(DAY))
    days = F.when(F.lit(p.now) >= date, days).otherwise(0)
    return F.when(days <= p.t0_days, "T0").when(days <= p.t1_days, "T1").otherwise("T2")


def multiplier(name: Column, p: Params) -> Column:
    out = F.lit(None).cast("double")
    for t, m in zip(TIERS, p.multipliers, strict=True):
        out = F.when(name == t, F.lit(m)).otherwise(out)
    return out


def clip(text: Column, most: int = 80) -> Column:
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("…")))


def head(text: Column, most: int) -> Column:
    return F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), 1, most)


def minute(date: Column) -> Column:
    """``yyyy-mm-dd hh:mm`` in UTC, by arithmetic on the date, so that the session's zone does not matter."""
    seconds = F.pmod(date, F.lit(DAY))
    return F.concat(day(date), F.lit(" "), F.lpad((F.floor(seconds / 3600)).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("string"), 2, "0"))


def day(date: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(date / F.lit(DAY)).cast("int")).cast("string")


def fnv_of_ids(dialog: Column, message: Column) -> Column:
    """32-bit FNV-1a over the little-endian bytes of a 64-bit and a 32-bit id."""

    def step(h: Column, byte: Column) -> Column:
        return h.bitwiseXOR(byte) * F.lit(FNV_PRIME) % F.lit(1 << 32)

    byte = [F.shiftrightunsigned(dialog.cast("long"), 8 * k).bitwiseAND(F.lit(255)) for k in range(8)]
    byte += [F.shiftrightunsigned(message.cast("long"), 8 * k).bitwiseAND(F.lit(255)) for k in range(4)]
    return reduce(step, byte, F.lit(FNV_START).cast("long"))


def fnv(text: str) -> int:
    return reduce(lambda h, b: (h ^ b) * FNV_PRIME & 0xFFFFFFFF, text.encode(), FNV_START)


def is_voice(media: Column) -> Column:
    return F.coalesce(media.isin(*VOICES), F.lit(False))


def addressable(kind: Column, access_hash: Column) -> Column:
    return kind.isin("chat", "saved_messages") | access_hash.isNotNull()


def midnight(date: str) -> int:
    """Epoch seconds of a date ``yyyy-mm-dd`` at midnight UTC."""
    return int(datetime.strptime(date, "%Y-%m-%d").replace(tzinfo=UTC).timestamp())


def parse_name(name: str, among: tuple[str, ...]) -> str | None:
    return name if name in among else None
