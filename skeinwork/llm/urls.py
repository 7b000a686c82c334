"""URL filtering: explicit rules first, then a tree of path templates for each host.

A path becomes a template. Segments that vary by their shape (digits, long or hexadecimal names) are
generalised at once. Then, from the deepest level up, two things happen to the children of every node:

- If there are more than ``MOST_CHILDREN`` of them and fewer than ``FEW_PAGES`` pages to each, or more than
  ``VARIABLE`` of them, they become one wildcard ``*``. Where labels contradict each other, children with the
  lesser verdict become another, ``*~``.
- Branches that are statistically alike are merged. What lies below a branch is a distribution of its pages
  over the templates there. Among siblings with the same commonest template each branch is held against the
  rest of them by a chi-square test of homogeneity on the counts; those that do not differ at the level
  ``CRITICAL`` are one branch from then on. Labels take no part, but that branches whose own labels say bad
  and good beyond doubt are never merged, nor with those that have no say. A page's last segment has nothing
  below it and is no branch.

The labels of all pages of a merged template are added: a template whose labelled pages are bad with a
smoothed purity of at least ``REJECT`` is rejected, and so are its unlabelled pages. Labels are a 0/1 column
or, by default, what the rules say of the pages that they fit.

Only DataFrame functions are used. A host with a third of all pages is summed before the shuffles, and
its pages meet their template in a join that Spark can split; siblings are compared with the sum of their
group, never with each other.

Edges: a null url, or one without ``://``, has an empty host and path; it fits no rule and is judged like any
other template, so without labels it is allowed. Paths may be of any depth and length. Of templates that are
equally common the first by name counts. Repeated rows are judged alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import written

#: A node's children are one wildcard beyond this many, if they have fewer pages each than that ...
MOST_CHILDREN, FEW_PAGES = 30, 5
#: ... and beyond this many in any case.
VARIABLE = 1000
#: The normal deviate that a test of homogeneity allows: one alike branch in a hundred is taken for another.
CRITICAL = 2.326
#: A purity counts STRENGTH labels of even odds beside the real ones.
STRENGTH, REJECT = 4.0, 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first :// up to /, ?, # or the end, lower-cased (A-Z); then up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of ``rules`` (verdict, host/path) that fits, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones win
        own, slash, below = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + below)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def shaped(path: Column) -> Column:
    """The segments of a path, those that vary by their shape replaced."""

    def shape(s: Column) -> Column:
        return F.when(s.rlike(r"^[0-9a-fA-F-]{16,}$"), "{hex}").when(F.length(s) > 40, "{long}").otherwise(F.regexp_replace(s, r"[0-9]+", "#"))

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), shape)


def _says(labelled: Column, bad: Column) -> Column:
    purity = (bad + STRENGTH / 2) / (labelled + STRENGTH)
    return F.when(purity >= REJECT, "bad").when(purity <= 1 - REJECT, "good").otherwise("none")


def _decided(branches: DataFrame, group: list[str]) -> DataFrame:
    """Add ``side``: empty if labels in the group do not contradict each other, else what the branch's own say."""
    sides = branches.groupBy(*group).agg((F.max(F.col("says") == "bad") & F.max(F.col("says") == "good")).alias("mixed"))
    return branches.join(sides, group).withColumn("side", F.when(F.col("mixed"), F.col("says")).otherwise("")).drop("mixed")


def _level(tree: DataFrame, k: int) -> DataFrame:
    """Generalise and merge the ``k``-th segments, whose lower ones are done.

    ``tree`` has host, shape (the segments of a path), up (its first segments, as they are), down (the
    template of the rest) and the counts; a row moves its last ``up`` segment to the front of ``down``.
    """
    due = tree.filter(F.size("up") == k + 1).withColumns({"node": F.slice("up", 1, k), "name": F.element_at("up", k + 1)})
    branch = due.groupBy("host", "node", "name").agg(F.sum("n").alias("all"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).withColumn("says", _says(F.col("labelled"), F.col("bad")))
    branch = written(branch, "branches")
    # Wildcards.
    kids = branch.groupBy("host", "node").agg(F.count("*").alias("kids"), F.sum("all").alias("pages"), F.sum(F.when(F.col("says") == "bad", F.col("labelled")).otherwise(0)).alias("b"), F.sum(F.when(F.col("says") == "good", F.col("labelled")).otherwise(0)).alias("g"))
    wild = kids.filter(f"kids > {VARIABLE} OR kids > {MOST_CHILDREN} AND pages < {FEW_PAGES} * kids").select("host", "node", F.when(F.col("b") > F.col("g"), "good").otherwise("bad").alias("lesser"))
    starred = branch.join(wild, ["host", "node"]).select("host", "node", "name", F.when(F.col("says") == F.col("lesser"), "*~").otherwise("*").alias("merged"))
    # Branches that are alike.
    rest = branch.join(wild, ["host", "node"], "left_anti")
    under = due.join(rest.select("host", "node", "name"), ["host", "node", "name"]).groupBy("host", "node", "name", "down").agg(F.sum("n").alias("c"))
    mode = under.groupBy("host", "node", "name").agg(F.min(F.struct((-F.col("c")).alias("c"), "down")).alias("m"), F.max(F.col("down") != "").alias("inner")).filter("inner").select("host", "node", "name", F.col("m.down").alias("mode"))
    group = ["host", "node", "mode", "side"]
    inner = _decided(rest.join(mode, ["host", "node", "name"]), ["host", "node", "mode"]).select(*group, "name", "all")
    inner = written(inner, "branches")
    parts = under.join(inner, ["host", "node", "name"])
    kinds = parts.groupBy(*group, "down").agg(F.sum("c").alias("t"))
    groups = inner.groupBy(*group).agg(F.sum("all").alias("total")).join(kinds.groupBy(*group).agg((F.count("*") - 1).alias("free")), group)
    # Pearson's statistic of a branch against the rest of its group; kinds that the branch lacks come in by their sum.
    share = F.col("all") / F.col("total")
    expected = F.col("t") * share
    terms = parts.join(kinds, [*group, "down"]).join(groups.select(*group, "total"), group)
    terms = terms.groupBy(*group, "name", "all", "total").agg(F.sum((F.col("c") - expected) * (F.col("c") - expected) / expected).alias("there"), F.sum("t").alias("t"))
    statistic = (F.col("there") + (F.col("total") - F.col("t")) * share) / (1 - share)
    tested = terms.join(groups.select(*group, "free"), group)
    # Wilson's and Hilferty's bound of chi-square.
    part = 2.0 / (9.0 * F.col("free"))
    bound = F.col("free") * F.pow(1 - part + CRITICAL * F.sqrt(part), F.lit(3.0))
    alike = tested.filter((F.col("all") == F.col("total")) | (F.col("free") == 0) | (F.round(statistic, 6) <= F.round(bound, 6)))
    named = alike.groupBy(*group).agg(F.min("name").alias("least"), F.count("*").alias("many")).filter("many > 1")
    joined = alike.join(named, group).select("host", "node", "name", F.concat("least", F.lit("+"), (F.col("many") - 1).cast("string"), F.when(F.col("side") == "", "").otherwise(F.concat(F.lit("~"), "side"))).alias("merged"))
    merged = written(starred.unionByName(joined), "merged")
    top = F.coalesce("merged", "name")
    done = due.join(merged, ["host", "node", "name"], "left").select(
        "host", "shape", F.col("node").alias("up"), F.when(F.col("down") == "", top).otherwise(F.concat_ws("/", top, "down")).alias("down"), "n", "labelled", "bad"
    )
    return written(tree.filter(F.size("up") <= k).unionByName(done), "tree")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], label: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every row.

    ``label`` is a column of ``pages``: 1 bad, 0 good, null unknown; without it the rules' verdicts are the labels.
    """
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    known = pages.select("page_id", host.alias("host"), path.alias("path"), (F.lit(None) if label is None else label).cast("int").alias("label"))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    known = known.select("*", rule.alias("rule"), said.alias("said"))
    if label is None:
        known = known.withColumn("label", F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0))
    known = known.withColumn("shape", shaped(F.col("path")))
    tree = known.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"))
    tree = written(tree.select("host", "shape", F.col("shape").alias("up"), F.lit("").alias("down"), "n", "labelled", "bad"), "tree")
    deepest = tree.agg(F.max(F.size("up"))).first()[0] or 0
    for k in reversed(range(deepest)):
        tree = _level(tree, k)
    pure = tree.groupBy("host", "down").agg(((F.sum("bad") + STRENGTH / 2) / (F.sum("labelled") + STRENGTH)).alias("purity"))
    judged = tree.join(pure, ["host", "down"]).select("host", "shape", F.concat(F.lit("/"), "down").alias("template"), "purity")
    out = known.select("page_id", "host", "path", "rule", "said", "shape").join(judged, ["host", "shape"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"), "template", "purity")


#: Levels that the SQL writes out; paths of the test tables are not deeper.
SQL_LEVELS = 4


def oracle_sql(rules: Sequence[tuple[str, str]]) -> str:
    """DuckDB SQL for the result of ``filter_urls`` on ``pages`` with these rules and their verdicts as labels."""

    def fits(text: str) -> str:
        own, slash, below = text.partition("/")
        return f"((host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{slash + below}'))"

    def says(of: str) -> str:
        purity = f"(bad + {STRENGTH / 2}::DOUBLE) / (labelled + {STRENGTH}::DOUBLE)"
        return f"(SELECT *, CASE WHEN {purity} >= {REJECT}::DOUBLE THEN 'bad' WHEN {purity} <= {1 - REJECT}::DOUBLE THEN 'good' ELSE 'none' END AS says FROM {of})"

    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{t}'" for _, t in ordered) + " END"
    said = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{v}'" for v, t in ordered) + " END"
    shape = "CASE WHEN regexp_full_match(s, '[0-9a-fA-F-]{16,}') THEN '{hex}' WHEN length(s) > 40 THEN '{long}' ELSE regexp_replace(s, '[0-9]+', '#', 'g') END"
    steps = [
        "r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)",
        f"l AS (SELECT page_id, host, path, {rule} AS rule, {said} AS said, [{shape} FOR s IN string_split(path, '/') IF s <> ''] AS shape FROM h)",
        f"t{SQL_LEVELS} AS (SELECT host, shape, shape AS up, '' AS down, count(*) AS n, count(said) AS labelled, count(*) FILTER (said = 'block') AS bad FROM l GROUP BY host, shape)",
    ]
    for k in reversed(range(SQL_LEVELS)):
        steps += [
            f"d{k} AS MATERIALIZED (SELECT *, up[1:{k}] AS node, up[{k + 1}] AS name FROM t{k + 1} WHERE len(up) = {k + 1})",
            f"b{k} AS MATERIALIZED (SELECT * FROM {says(f'(SELECT host, node, name, sum(n) AS total, sum(labelled) AS labelled, sum(bad) AS bad FROM d{k} GROUP BY ALL)')})",
            f"""w{k} AS (SELECT host, node, CASE WHEN sum(labelled) FILTER (says = 'bad') > coalesce(sum(labelled) FILTER (says = 'good'), 0) THEN 'good' ELSE 'bad' END AS lesser FROM b{k} GROUP BY host, node
              HAVING count(*) > {VARIABLE} OR count(*) > {MOST_CHILDREN} AND sum(total) < {FEW_PAGES} * count(*))""",
            f"u{k} AS MATERIALIZED (SELECT host, node, name, down, sum(n) AS c FROM d{k} ANTI JOIN w{k} USING (host, node) GROUP BY ALL)",
            f"o{k} AS (SELECT host, node, name, first(down ORDER BY c DESC, down) AS mode FROM u{k} GROUP BY ALL HAVING bool_or(down <> ''))",
            f"""i{k} AS MATERIALIZED (SELECT host, node, name, mode, total, CASE WHEN bool_or(says = 'bad') OVER g AND bool_or(says = 'good') OVER g THEN says ELSE '' END AS side
              FROM b{k} JOIN o{k} USING (host, node, name) WINDOW g AS (PARTITION BY host, node, mode))""",
            f"p{k} AS (SELECT *, sum(c) OVER (PARTITION BY host, node, mode, side, down) AS t FROM u{k} JOIN i{k} USING (host, node, name))",
            f"g{k} AS (SELECT host, node, mode, side, sum(c) AS every, count(DISTINCT down) - 1 AS free FROM p{k} GROUP BY ALL)",
            f"""x{k} AS (SELECT host, node, mode, side, name, total, every, free, sum((c - t * (total / every)) * (c - t * (total / every)) / (t * (total / every))) AS there, sum(t) AS seen
              FROM p{k} JOIN g{k} USING (host, node, mode, side) GROUP BY ALL)""",
            f"""a{k} AS (SELECT * FROM x{k} WHERE CASE WHEN total = every OR free = 0 THEN TRUE
              ELSE round((there + (every - seen) * (total / every)) / (1 - total / every), 6) <= round(free * pow(1 - 2.0 / (9.0 * free) + {CRITICAL} * sqrt(2.0 / (9.0 * free)), 3), 6) END)""",
            f"""m{k} AS MATERIALIZED (SELECT host, node, name, min(name) OVER g || '+' || (count(*) OVER g - 1) || CASE WHEN side = '' THEN '' ELSE '~' || side END AS merged FROM a{k}
              WINDOW g AS (PARTITION BY host, node, mode, side) QUALIFY count(*) OVER g > 1
              UNION ALL SELECT host, node, name, CASE WHEN says = lesser THEN '*~' ELSE '*' END FROM b{k} JOIN w{k} USING (host, node))""",
            f"""t{k} AS MATERIALIZED (SELECT host, shape, up, down, n, labelled, bad FROM t{k + 1} WHERE len(up) <= {k} UNION ALL
              SELECT host, shape, node, coalesce(merged, name) || CASE WHEN down = '' THEN '' ELSE '/' || down END, n, labelled, bad FROM d{k} LEFT JOIN m{k} USING (host, node, name))""",
        ]
    steps += [
        f"z AS (SELECT host, down, (sum(bad) + {STRENGTH / 2}::DOUBLE) / (sum(labelled) + {STRENGTH}::DOUBLE) AS purity FROM t0 GROUP BY ALL)",
        "j AS (SELECT host, shape, '/' || down AS template, purity FROM t0 JOIN z USING (host, down))",
    ]
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT page_id, host, path, rule, coalesce(said, CASE WHEN purity >= {REJECT}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, template, purity "
        "FROM l LEFT JOIN j USING (host, shape)"
    )
