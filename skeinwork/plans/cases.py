"""Cases of normal forms, matching and protection as tables, with what is expected written beside them.

Each query runs the engine on the texts of a table; its SQL is the table's other column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions.matcher import Dictionary, Rule, probe, term_matches

#: Two texts, and whether they share a normal form.
ALIKE = (
    ("мост", "м.о.с.т", True),
    ("мост", "м о с т", True),
    ("мост", "МОСТ", True),
    ("мост", "м-о_с*т", True),
    ("мост", "мoст", True),
    ("мост", "м0ст", True),
    ("мост", "most", True),
    ("мост", "мо́ст", True),
    ("мост", "ｍｏｓｔ", True),
    ("щука", "shchuka", True),
    ("в году", "в 2024 году", True),
    ("", "2024 -- 17", True),
    ("мост", "мосты", False),
    ("мост", "рост", False),
    ("мост", "", False),
)

RULES = (Rule("road", "bridge", 1.0, "term", "мост"), Rule("road", "way", 2.0, "term", "прямой путь"), Rule("water", "river", 1.0, "term", "река"))
KEEP, OVERRIDE = ("музей",), ("ограбление",)

#: A text, its matches (rule:surface) in order, and whether the keep-list protects it.
MATCHED = (
    ("мост у дома", "bridge:мост", False),
    ("наш м.о.с.т рядом", "bridge:м.о.с.т", False),
    ("м0ст", "bridge:м0ст", False),
    ("старый most", "bridge:most", False),
    ("мостовая", "bridge:мост", False),
    ("помост", "", False),
    ("мо стена", "", False),
    ("прямой путь домой", "way:прямой путь", False),
    ("мост и мост", "bridge:мост", False),
    ("мост, а под ним река", "bridge:мост,river:река", False),
    ("мост и музей", "bridge:мост", True),
    ("музей", "", True),
    ("мост, музей, ограбление", "bridge:мост", False),
    ("", "", False),
    ("123 456", "", False),
)


def _pack() -> Dictionary:
    return Dictionary(RULES, keep=KEEP, override=OVERRIDE)


def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the texts of each case share a normal form."""
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(ALIKE)], "case long, a string, b string")
    form = term_matches(_pack())
    return rows.select("case", form("a").alias("a"), form("b").alias("b")).select("case", (F.col("a.normal") == F.col("b.normal")).alias("alike"))


def term_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with their surfaces, and protection, of each case."""
    rows = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(MATCHED)], "case long, text string")
    s = rows.select("case", term_matches(_pack())("text").alias("s"))
    return s.select("case", F.array_join(F.transform("s.matches", lambda m: F.concat_ws(":", m["rule_id"], m["surface"])), ",").alias("matches"), F.col("s.protected").alias("protected"))


def probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probe of one text."""
    found = probe(spark, _pack(), MATCHED[9][0])
    return found.select("protected", F.explode("matches").alias("m")).select("m.axis", "m.rule_id", "m.weight", "m.layer", "m.surface", "protected")


def queries() -> dict:
    return {"normal_forms": normal_forms, "term_cases": term_cases, "probe": probed}


def _values(rows: list[tuple]) -> str:
    def one(v: object) -> str:
        return str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def oracle_sql() -> dict[str, str]:
    return {
        "normal_forms": f'SELECT CAST(c AS BIGINT) AS "case", alike FROM (VALUES {_values([(k, y) for k, (_, _, y) in enumerate(ALIKE)])}) t(c, alike)',
        "term_cases": f'SELECT CAST(c AS BIGINT) AS "case", matches, protected FROM (VALUES {_values([(k, m, p) for k, (_, m, p) in enumerate(MATCHED)])}) t(c, matches, protected)',
        "probe": "SELECT axis, rule_id, CAST(weight AS DOUBLE) AS weight, layer, surface, protected FROM (VALUES ('road', 'bridge', 1.0, 'keyword', 'мост', FALSE), ('water', 'river', 1.0, 'keyword', 'река', FALSE)) t(axis, rule_id, weight, layer, surface, protected)",
    }
