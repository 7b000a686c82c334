"""Small documents with the cases that every operator must survive."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a table may have them too.
CLASHING = {"size": 1, "shard": 2, "slot": 3, "n_words": 4, "kept": False, "score": 0.5, "sequence_id": 6, "component_id": 7, "key": 8, "id": 9, "h1": 10, "bands": 11, "host": "x", "path": "y", "label": 1, "n": 5, "rank": 2}


def sentence(rng, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()):
    return " ".join(rng.choice(words) + str(rng.randrange(300)) for _ in range(n))


def rows():
    rng = random.Random(5)
    out = [(k, sentence(rng, rng.randrange(30, 120)), "en", f"s{k % 3}") for k in range(60)]
    base = out[7][1].split()
    out += [(100 + k, " ".join(w if j != 5 * k else "changed" for j, w in enumerate(base)), "en", "s0") for k in range(6)]  # near copies
    out += [(200 + k, out[9][1], "en", "hot") for k in range(30)]  # copies
    out += [(300, None, None, None), (301, "", "en", "s1"), (302, "   \n\t ", None, "s1"), (303, "one two", "en", "s1"), (304, "one two", "en", "s1")]
    out += [(305, "word " * 30_000, "en", "long"), (306, sentence(rng, 12_000), "en", "long")]
    out += [(307, "Repeated row here with some words in it", "en", "s2")] * 2
    out += [(None, "A row without an id but with a text of its own", "en", "s2")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in out]


def docs(spark, clashing=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in CLASHING.items()}) if clashing else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, *cols):
    """Rows as sorted tuples; nulls first."""
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=lambda t: [(x is not None, str(type(x)), x) for x in t])
