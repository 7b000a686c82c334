"""Normal forms, matching, verdicts, scalars: no dialog needed."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinwork.functions import scalars as S
from skeinwork.functions.matcher import BUNDLED, Dictionary, Rule, probe, regex_matches
from skeinwork.functions.normalize import normalize
from skeinwork.functions.verdict import is_valid, verdict_schema
from skeinwork.params import DAY, Params
from skeinwork.plans.policy import Profile, build_prompt


def form(text):
    return normalize(text).text


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("мост", "м.о.с.т"),  # separators
        ("мост", "м о с т"),  # spaces
        ("мост", "МОСТ"),
        ("мост", "мoст"),  # a Latin o
        ("мост", "м0ст"),  # a digit
        ("мост", "most"),  # transliteration
        ("щука", "shchuka"),
        ("мост", "мо́ст"),  # a combining mark
    ],
)
def test_disguises_share_a_normal_form(a, b):
    assert form(a) == form(b)


def test_numbers_and_punctuation_vanish():
    assert form("2024 -- 17") == ""
    assert form("в 2024 году") == form("вгоду")


def test_places_map_back_to_the_source():
    n = normalize("а м.о.с.т!")
    at = n.text.index(form("мост"))
    a, b = n.surface(at, at + len(form("мост")))
    assert "а м.о.с.т!"[a:b] == "м.о.с.т"


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_every_letter_has_a_source(text):
    n = normalize(text)
    assert len(n.text) == len(n.source)
    assert all(0 <= k < len(text) for k in n.source)
    assert len(n.starts) == len(n.word_length) == len(text)


def matched(rules, text, **kw):
    d = Dictionary(tuple(rules), **kw)
    return [(m[1], m[5]) for m in d.match(text, normalize(text))]


STEM = Rule("a", "stem", 1.0, "term", "мост")
PHRASE = Rule("a", "phrase", 1.0, "term", "синий мост")


def test_a_stem_matches_from_a_word_start_only():
    assert matched([STEM], "мостовая") == [("stem", "мост")]
    assert matched([STEM], "помост") == []


def test_a_one_word_term_crosses_no_space_but_letter_spacing():
    assert matched([STEM], "мо сты") == []
    assert matched([STEM], "м о с т") == [("stem", "м о с т")]
    assert matched([PHRASE], "вот синий мост") == [("phrase", "синий мост")]


def test_a_repeated_term_counts_once_and_equal_forms_are_one():
    assert matched([STEM], "мост, мост") == [("stem", "мост")]
    assert Dictionary((STEM, Rule("b", "other", 9.0, "term", "most"))).counts() == (1, 0)


def test_short_terms_are_refused():
    with pytest.raises(ValueError, match="shorter"):
        Dictionary((Rule("a", "b", 1.0, "term", "да"),))


def test_keep_list_and_override():
    d = Dictionary((), keep=("отпуск",), override=("навсегда",))
    assert d.protects(normalize("Еду в отпуск"))
    assert not d.protects(normalize("отпуск навсегда"))
    assert not Dictionary(()).protects(normalize("отпуск"))


def test_bundled_expressions_natively(spark):
    texts = [("card", "pay 4111 1111 1111 1111 now"), ("eth", "0x" + "ab" * 20), ("iban", "DE44500105175407324931"), ("none", "nothing here"), ("glued", "x4111111111111111")]
    rows = spark.createDataFrame(texts, "k string, text string").select("k", F.transform(regex_matches(F.col("text"), list(BUNDLED)), lambda m: m["rule_id"]).alias("r")).collect()
    found = {r["k"]: r["r"] for r in rows}
    assert found == {"card": ["card_number"], "eth": ["eth_address"], "iban": ["iban"], "none": [], "glued": []}


def test_unicode_boundaries_and_case(spark):
    d = Dictionary((Rule("a", "w", 1.0, "regex", r"(?i)\b(мост)\b"),))
    assert len(probe(spark, d, "Это МОСТ.").first()["matches"]) == 1
    assert len(probe(spark, d, "Это мосты.").first()["matches"]) == 0


@pytest.mark.parametrize(
    ("raw", "fine"),
    [
        ('{"delete_ranges": [{"from": 1, "to": 2}]}', True),
        ("{}", True),
        ('{"delete_ranges": [{"from": 764667000000, "to": 2}], "x": 1}', True),
        ('{"need_context": null}', True),
        ("not json", False),
        (None, False),
        ('{"delete_ranges": [{"to": 2}]}', False),
        ('{"delete_ranges": [{"from": 1.0, "to": 2}]}', False),
        ('{"delete_ranges": [{"from": true, "to": 2}]}', False),
        ('{"delete_ranges": null}', False),
        ('{"protected": [{"from": 1}]}', False),
        ('{"notes": 3}', False),
        ("{} and more", False),
        ("[]", False),
        ('{"delete_ranges": [{"from": 9223372036854775808, "to": 2}]}', False),
        ('{"delete_ranges": [{"from": 1, "to": 2, "confidence": NaN}]}', False),
    ],
)
def test_strict_verdicts(raw, fine):
    assert is_valid(raw) is fine


def test_verdict_schema_is_closed():
    s = verdict_schema(("a", "b"))
    assert s["additionalProperties"] is False
    assert s["properties"]["delete_ranges"]["items"]["properties"]["axis"]["enum"] == ["a", "b"]


@pytest.mark.parametrize(("days", "tier"), [(-5, "T0"), (0, "T0"), (180, "T0"), (181, "T1"), (365, "T1"), (366, "T2")])
def test_tiers(spark, days, tier):
    p = Params(now=2_000_000_000)
    assert spark.range(1).select(S.tier(F.lit(p.now - days * DAY).cast("long"), p)).first()[0] == tier


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(S.peer_id(F.lit("user123456"))) == 123456
    assert get(S.peer_id(F.lit("channel-987"))) == -987
    assert get(S.peer_id(F.lit("junk"))) is None
    assert get(S.peer_id(F.lit("user12x"))) is None
    assert get(S.epoch_of_iso(F.lit("2020-01-01T00:00:01"))) == 1_577_836_801
    assert get(S.epoch_of_iso(F.lit("2020-01-01"))) is None
    assert get(S.epoch_of_iso(F.lit("2020-13-01T00:00:01"))) is None
    assert get(S.minute(F.lit(1_577_836_861).cast("long"))) == "2020-01-01 00:01"
    assert get(S.clip(F.lit("я" * 81))) == "я" * 80 + "…"
    assert get(S.peer_kind(F.lit("personal_chat"))) == "user"
    assert get(S.peer_kind(F.lit("who knows"))) == "megagroup"
    ids = (7, 12)
    expected = S.FNV_START
    for b in ids[0].to_bytes(8, "little") + ids[1].to_bytes(4, "little"):
        expected = (expected ^ b) * S.FNV_PRIME & 0xFFFFFFFF
    assert get(S.fnv_of_ids(F.lit(7), F.lit(12))) == expected


def test_prompts():
    plain, more = build_prompt("en"), build_prompt("en", Profile(occupation="a clerk"))
    assert "{PROFILE}" not in plain.text and "a clerk" in more.text
    assert plain.id.startswith("en-") and plain.id != more.id and len(plain.id) == 11
    assert build_prompt("ru").id.startswith("ru-")
    with pytest.raises(ValueError, match="unknown"):
        build_prompt("xx")
