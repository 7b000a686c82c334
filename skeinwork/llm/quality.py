"""Quality rules as a short-circuit cascade.

Rules are tried one after the other until one rejects, in an order learnt from a sample: each rule's cost
(seconds a text, what it reads of the text included) and selectivity (share rejected) are measured on at
most ``SAMPLE_ROWS`` rows, and the rule with the most rejection for its cost comes first. A text's statistics
are computed when the first rule asks for them, so a text that a cheap rule rejects never has its windows
counted. The order changes the work, never the verdict, which is that no rule rejects.

``keep_good`` runs all rules so, the base checks among them. ``score_quality`` owes the base statistics of
every text, so there only the further rules are a cascade.

A null text counts as empty: no words, so the base check fails. Texts of any length are judged whole. Ties
and repeated rows are judged alike, an empty table gives an empty result, other columns are ignored (or kept
as they are by ``keep_good``).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import bounded_batches

#: Rows that costs and selectivities are estimated on, at most.
SAMPLE_ROWS = 2000
SPACES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
SYMBOLS = "#*$%&|<>"
WINDOW = 5
BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


class Text:
    """A text with what the rules look at, each statistic computed once and only if asked for."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # bytes split at ASCII white space only

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.raw.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.raw.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def n_letters(self) -> int:
        return sum(map(str.isalpha, self.text))

    @property
    def base_failed(self) -> bool:
        return any(rule.rejects(self) for rule in BASE_RULES)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a five-word window which the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.uint64)
    with np.errstate(over="ignore"):
        # A mixed 64-bit value for each different word, then a polynomial over the window.
        mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        keys = np.zeros(n, dtype=np.uint64)
        for k in range(WINDOW):
            keys = keys * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    order = np.sort(keys)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(np.isin(keys, again))
    np.add.at(inside, at, 1)
    np.add.at(inside, at + WINDOW, -1)
    return int((np.cumsum(inside) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: Characters that count as upper case in Python but are no upper-case letters.
_NO_LETTERS = frozenset(map(chr, (*range(0x2160, 0x2170), *range(0x24B6, 0x24D0), *range(0x1F130, 0x1F14A), *range(0x1F150, 0x1F16A), *range(0x1F170, 0x1F18A))))


def shouts(t: Text) -> bool:
    upper = sum(map(str.isupper, t.text)) - (0 if t.text.isascii() else sum(map(_NO_LETTERS.__contains__, t.text)))
    return 100 * upper > 30 * t.n_letters


def lacks_letters(t: Text) -> bool:
    return 100 * t.n_letters < 50 * t.word_chars


def stutters(t: Text) -> bool:
    return 100 * sum(map(bytes.__eq__, t.words[1:], t.words)) > 30 * t.n_words


BASE_RULES = (
    Rule("few_words", lambda t: t.n_words < 10),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 20 * t.n_words),
)
#: Thresholds are in whole percent so that SQL can repeat them exactly.
RULES = (
    Rule("symbols", lambda t: 100 * t.n_symbols > 10 * t.n_words),
    Rule("shouting", shouts),
    Rule("exclamations", lambda t: 100 * t.text.count("!") > 30 * t.n_words),
    Rule("repeated_lines", lambda t: 100 * t.n_dup_lines > 40 * len(t.lines)),
    Rule("few_letters", lacks_letters),
    Rule("stutter", stutters),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words),
)


def estimated_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[int]:
    """Places of ``rules``, the one with the most rejections a second first."""
    total = bounded_batches(docs).count()
    if not total:
        return list(range(len(rules)))

    def trial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, rule in enumerate(rules):
                texts = [Text(t) for t in batch["text"]]  # new ones, so that a rule pays for what it asks for
                start = time.perf_counter()
                rejected = sum(map(rule.rejects, texts))
                yield pd.DataFrame({"rule": [k], "n": [len(texts)], "rejected": [rejected], "seconds": [time.perf_counter() - start]})

    sample = docs.select(F.col("text").cast("string").alias("text")).sample(min(1.0, 1.2 * sample_rows / total), seed=11).limit(sample_rows)
    sums = sample.mapInPandas(trial, "rule int, n long, rejected long, seconds double").groupBy("rule").agg(F.sum("rejected").alias("r"), F.sum("seconds").alias("s")).collect()
    worth = {x["rule"]: x["r"] / max(x["s"], 1e-9) for x in sums}
    spent = {x["rule"]: x["s"] for x in sums}
    return sorted(range(len(rules)), key=lambda k: (-worth.get(k, 0.0), spent.get(k, 0.0), k))


def tried(texts: Iterator[str | None], rules: tuple[Rule, ...], order: list[int]) -> Iterator[int]:
    """How many rules each text meets before one rejects it or all are done; negative if none rejects."""
    for t in map(Text, texts):
        at = next((n for n, k in enumerate(order, 1) if rules[k].rejects(t)), 0)
        yield at or -len(order)


def judge(order: list[int], rules: tuple[Rule, ...] = RULES):
    """A UDF from a text to the base statistics and the cascade's verdict."""

    @F.pandas_udf(BASE_SCHEMA)
    def verdict(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in map(Text, texts):
            failed = t.base_failed
            kept = not failed and not any(rules[k].rejects(t) for k in order)
            rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, kept))
        return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return verdict


def score_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept for every row."""
    verdict = judge(estimated_order(docs, rules), rules)
    return docs.select("doc_id", verdict(F.col("text").cast("string")).alias("q")).select("doc_id", "q.*")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, the base checks included, with all their columns."""
    every = (*BASE_RULES, *rules)
    order = estimated_order(docs, every)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series([n < 0 for n in tried(texts, every, order)], dtype=bool)

    return docs.filter(good(F.col("text").cast("string")))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         [l FOR l IN string_split(text, chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS lines
  FROM d
),
win AS (
  SELECT doc_id, p, hash_of FROM (
    SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, unnest([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) AS hash_of
    FROM s WHERE len(w) >= 5)
),
rep AS (SELECT doc_id, hash_of FROM win GROUP BY ALL HAVING count(*) > 1),
cov AS (
  SELECT doc_id, count(DISTINCT pos) AS n FROM (
    SELECT win.doc_id, unnest(range(p, p + 5)) AS pos FROM win JOIN rep ON win.doc_id = rep.doc_id AND win.hash_of = rep.hash_of)
  GROUP BY doc_id
),
b AS (
  SELECT s.doc_id, text, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(cov.n, 0) AS n_repeat_words,
         length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters,
         length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaim,
         len([i FOR i IN range(2, len(w) + 1) IF w[i] = w[i-1]]) AS n_stutter
  FROM s LEFT JOIN cov ON s.doc_id = cov.doc_id
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (
         100 * n_symbols > 10 * n_words OR 100 * n_upper > 30 * n_letters OR 100 * n_exclaim > 30 * n_words
         OR 100 * n_dup_lines > 40 * n_lines OR 100 * n_letters < 50 * word_chars
         OR 100 * n_stutter > 30 * n_words
         OR NOT (word_chars BETWEEN 2 * n_words AND 20 * n_words)) AS kept
FROM b
"""
