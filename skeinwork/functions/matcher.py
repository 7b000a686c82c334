"""Matching of a rule pack: stems by an automaton over normal forms, regular expressions on the raw text.

A pack is a table (axis, rule_id, weight, kind, pattern) with kind ``term`` or ``regex``; it is supplied by
whoever owns the messages. The bundled one has secrets, cards, accounts and wallets only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.normalize import Normalized, normalize
from skeinwork.functions.scalars import clip

try:
    import ahocorasick
except ImportError:  # plain search instead
    ahocorasick = None

MATCH = "axis string, rule_id string, term string, weight double, layer string, surface string"
MATCHES = f"array<struct<{MATCH.replace(' string', ': string').replace(' double', ': double')}>>"


@dataclass(frozen=True)
class Rule:
    axis: str
    rule_id: str
    weight: float
    kind: str
    pattern: str


# Patterns of secrets, cards, accounts and wallets.
BUNDLED = (
    Rule("crypto_hard", "btc_address", 3.0, "regex", r"\b(bc1[ac-hj-np-z02-9]{11,71}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b"),
    Rule("crypto_hard", "eth_address", 3.0, "regex", r"\b0x[a-fA-F0-9]{40}\b"),
    Rule("crypto_hard", "ton_address", 3.0, "regex", r"\b[EU]Q[A-Za-z0-9_-]{46}\b"),
    Rule("crypto_hard", "tron_address", 3.0, "regex", r"\bT[1-9A-HJ-NP-Za-km-z]{33}\b"),
    Rule("crypto_hard", "tx_hash", 2.0, "regex", r"\b[a-fA-F0-9]{64}\b"),
    Rule("crypto_hard", "bip39_like", 3.0, "regex", r"\b([a-z]{3,8} ){11}[a-z]{3,8}\b"),
    Rule("foreign_finance", "card_number", 3.0, "regex", r"\b(?:4\d{3}|5[1-5]\d{2}|2[2-7]\d{2})[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{4}\b"),
    Rule("foreign_finance", "iban", 3.0, "regex", r"\b(?:KZ|GE|AM|RS|TR|LT|EE|LV|PL|DE|NL|ES|PT|CY)\d{2}[A-Z0-9]{11,28}\b"),
)


def pack_of(rows: DataFrame) -> tuple[Rule, ...]:
    """A pack from a rules table; a pack is small and is read on the driver, in order of axis, rule and pattern."""
    return tuple(Rule(r["axis"], r["rule_id"], float(r["weight"]), r["kind"], r["pattern"]) for r in rows.orderBy("axis", "rule_id", "pattern").collect())


def clipped(text: str, most: int = 80) -> str:
    return text if len(text) <= most else text[:most] + "…"


class Search:
    """Overlapping occurrences of patterns, by their end."""

    def __init__(self, patterns: list[str]) -> None:
        self.patterns, self.automaton = patterns, None
        if ahocorasick and patterns:
            self.automaton = ahocorasick.Automaton()
            for k, p in enumerate(patterns):
                self.automaton.add_word(p, k)
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(end, start, pattern) in order; longer patterns first at one end."""
        if self.automaton:
            found = [(last + 1, last + 1 - len(self.patterns[k]), k) for last, k in self.automaton.iter(text)]
        else:
            found = []
            for k, p in enumerate(self.patterns):
                at = text.find(p)
                while at >= 0:
                    found.append((at + len(p), at, k))
                    at = text.find(p, at + 1)
        return sorted(found)

    def any(self, text: str) -> bool:
        if self.automaton:
            return next(self.automaton.iter(text), None) is not None
        return any(p in text for p in self.patterns)


@dataclass
class Dictionary:
    """A compiled pack, with keep-list terms and the terms that override them."""

    rules: tuple[Rule, ...]
    keep: tuple[str, ...] = ()
    override: tuple[str, ...] = ()
    least: int = 4
    terms: list[Rule] = field(init=False)
    regexes: list[Rule] = field(init=False)

    def __post_init__(self) -> None:
        self.terms, self.regexes, forms, short = [], [r for r in self.rules if r.kind == "regex"], [], []
        for r in self.rules:
            if r.kind != "term":
                continue
            form = normalize(r.pattern).text
            if len(form) < self.least:
                short.append(f"{r.axis}:{r.rule_id} {r.pattern!r} -> {form!r}")
            elif form not in forms:  # the first of equal normal forms wins
                self.terms.append(r)
                forms.append(form)
        if short:
            raise ValueError(f"terms shorter than {self.least} letters in normal form match across words: " + "; ".join(short))
        self._forms = forms
        self._search = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_search": None}

    def _searches(self) -> tuple[Search, Search, Search]:
        if self._search is None:
            forms = [[f for f in (normalize(t).text for t in terms) if f] for terms in (self.keep, self.override)]
            self._search = (Search(self._forms), *map(Search, forms))
        return self._search

    def counts(self) -> tuple[int, int]:
        """How many terms and regular expressions it has."""
        return len(self.terms), len(self.regexes)

    def protects(self, text: Normalized) -> bool:
        _, keep, override = self._searches()
        return keep.any(text.text) and not override.any(text.text)

    def match(self, raw: str, text: Normalized) -> list[tuple]:
        """Each term once, with the surface of its first occurrence that passes."""
        seen, out = set(), []
        for end, start, k in self._searches()[0].find(text.text):
            rule = self.terms[k]
            if (rule.rule_id, rule.pattern) in seen or not text.starts_word(start) or len(rule.pattern.split()) < 2 and not text.one_word(start, end):
                continue
            seen.add((rule.rule_id, rule.pattern))
            a, b = text.surface(start, end)
            out.append((rule.axis, rule.rule_id, rule.pattern, rule.weight, "keyword", clipped(raw[a:b])))
        return out


def term_matches(dictionary: Dictionary):
    """A UDF from a text to its normal form, whether a keep-list protects it, and its keyword matches."""

    @F.pandas_udf(f"normal string, protected boolean, matches {MATCHES}")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in texts.fillna(""):
            form = normalize(raw)
            rows.append((form.text, dictionary.protects(form), [dict(zip(("axis", "rule_id", "term", "weight", "layer", "surface"), m, strict=True)) for m in dictionary.match(raw, form)]))
        return pd.DataFrame(rows, columns=["normal", "protected", "matches"])

    return scan


def regex_matches(text: Column, rules: list[Rule]) -> Column:
    """An array of the first match of each regular expression, without leaving the JVM; letters are Unicode's."""
    if not rules:
        return F.from_json(F.lit("[]"), MATCHES)
    found = [
        F.struct(
            F.lit(r.axis).alias("axis"),
            F.lit(r.rule_id).alias("rule_id"),
            F.lit(r.rule_id).alias("term"),
            F.lit(float(r.weight)).alias("weight"),
            F.lit("regex").alias("layer"),
            F.regexp_substr(text, F.lit("(?U)" + r.pattern)).alias("surface"),
        )
        for r in rules
    ]
    # Each expression is searched for once; clipping looks at what was found.
    there = F.filter(F.array(*found), lambda m: m["surface"].isNotNull())
    return F.transform(there, lambda m: F.struct(*(m[c].alias(c) for c in ("axis", "rule_id", "term", "weight", "layer")), clip(m["surface"]).alias("surface")))


def probe(spark, dictionary: Dictionary, text: str) -> DataFrame:
    """What the pack makes of one text: normal form, protected, matches."""
    one = spark.createDataFrame([(text,)], "text string")
    scanned = one.select("text", term_matches(dictionary)(F.col("text")).alias("s"))
    return scanned.select(F.col("s.normal").alias("normal"), F.col("s.protected").alias("protected"), F.concat("s.matches", regex_matches(F.col("text"), dictionary.regexes)).alias("matches"))
