import fixtures as X
from pyspark.sql import functions as F

from skeinwork.llm.queries import URL_RULES
from skeinwork.llm.urls import filter_urls

PAGES = "page_id long, url string, html string"


def judged(spark, urls, rules=URL_RULES, **kw):
    df = spark.createDataFrame([(k, u, "") for k, u in enumerate(urls)], PAGES)
    return {r["page_id"]: r for r in filter_urls(df, rules, **kw).collect()}


def test_parts_and_rules(spark):
    urls = [
        ("http://A.Example.COM/en/5?x=1", "a.example.com", "/en/5", "example.com/en/", "block"),
        ("https://www.example.com/en/5#t", "www.example.com", "/en/5", "www.example.com/en/", "allow"),
        ("https://x.www.example.com/en/", "x.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://badexample.com/en/5", "badexample.com", "/en/5", "com/", "allow"),
        ("https://a.net/fr/1", "a.net", "/fr/1", "net/fr/", "block"),
        ("https://a.net/fr", "a.net", "/fr", None, "allow"),
        ("https://a.com", "a.com", "", None, "allow"),
        ("https://a.org?u=b://c/d", "a.org", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://", "", "", None, "allow"),
        ("line\nbreak://h.net/es/\n/é?", "h.net", "/es/\n/é", "net/es/", "block"),
    ]
    got = judged(spark, [u[0] for u in urls])
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for _, r in sorted(got.items())] == [u[1:] for u in urls]


def test_templates_generalise_and_are_rejected_by_purity(spark):
    labelled = [(k, f"http://h.org/tag/{k}", 1) for k in range(20)] + [(100 + k, f"http://h.org/post/{k}.html", 0) for k in range(20)]
    unknown = [(200, "http://h.org/tag/999", None), (201, "http://h.org/post/7.html", None), (202, "http://other.org/tag/1", None)]
    slugs = [(300 + k, f"http://s.org/n/word-{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}", 1 if k < 50 else None) for k in range(60)]
    df = spark.createDataFrame([(i, u, "", y) for i, u, y in labelled + unknown + slugs], PAGES + ", bad int")
    got = {r["page_id"]: r for r in filter_urls(df, [], label=F.col("bad")).collect()}
    assert got[200]["verdict"] == "block" and got[5]["verdict"] == "block"
    assert got[201]["verdict"] == "allow" and got[202]["verdict"] == "allow"
    assert got[200]["template"] == "/tag/#"
    assert got[359]["template"] == "/n/*" and got[359]["verdict"] == "block"


def brute(rows):
    """url, label -> template and verdict, on plain dictionaries: one host, labels 0, 1 or None."""
    import re
    from collections import Counter, defaultdict

    from skeinwork.llm import urls as U

    def shape(s):
        return "{hex}" if re.fullmatch(r"[0-9a-fA-F-]{16,}", s) else "{long}" if len(s) > 40 else re.sub(r"[0-9]+", "#", s)

    def says(labels):
        purity = (sum(labels) + 2) / (len(labels) + 4)
        return "bad" if purity >= 0.8 else "good" if purity <= 1 - 0.8 else "none"

    paths = [[shape(s) for s in u.split("://", 1)[1].split("/")[1:] if s] for u, _ in rows]
    down = [""] * len(rows)
    for k in reversed(range(max(map(len, paths)))):
        nodes = defaultdict(lambda: defaultdict(list))
        for r, p in enumerate(paths):
            if len(p) > k:
                nodes[tuple(p[:k])][p[k]].append(r)
        for kids in nodes.values():
            labels = {name: [rows[r][1] for r in own if rows[r][1] is not None] for name, own in kids.items()}
            verdict = {name: says(x) for name, x in labels.items()}
            n = sum(map(len, kids.values()))
            merged = {name: name for name in kids}
            if len(kids) > U.VARIABLE or len(kids) > U.MOST_CHILDREN and n < U.FEW_PAGES * len(kids):
                weight = {v: sum(len(labels[x]) for x in kids if verdict[x] == v) for v in ("bad", "good")}
                lesser = "good" if weight["bad"] > weight["good"] else "bad"
                merged = {name: "*~" if verdict[name] == lesser else "*" for name in kids}
            else:
                below = {name: Counter(down[r] for r in own) for name, own in kids.items()}
                modes = defaultdict(list)
                for name, c in below.items():
                    if set(c) != {""}:
                        modes[min((-v, d) for d, v in c.items())[1]].append(name)
                for names in modes.values():
                    clash = {"bad", "good"} <= {verdict[x] for x in names}
                    for side in {verdict[x] if clash else "" for x in names}:
                        group = [x for x in names if not clash or verdict[x] == side]
                        every = sum((below[x] for x in group), Counter())
                        total, free, alike = every.total(), len(every) - 1, []
                        for x in group:
                            mine, rest = below[x], every - below[x]
                            chi = 0.0
                            for d in every if rest else ():
                                for own, size in ((mine, mine.total()), (rest, rest.total())):
                                    e = every[d] * size / total
                                    chi += (own[d] - e) ** 2 / e
                            bound = free * (1 - 2 / (9 * free) + U.CRITICAL * (2 / (9 * free)) ** 0.5) ** 3 if free else 0
                            if not rest or not free or chi <= bound:
                                alike.append(x)
                        if len(alike) > 1:
                            name = f"{min(alike)}+{len(alike) - 1}" + (f"~{side}" if side else "")
                            merged |= dict.fromkeys(alike, name)
            for name, own in kids.items():
                for r in own:
                    down[r] = f"{merged[name]}/{down[r]}" if down[r] else merged[name]
    labels = defaultdict(list)
    for (_, y), d in zip(rows, down, strict=True):
        if y is not None:
            labels[d].append(y)
    purity = {d: (sum(labels[d]) + 2) / (len(labels[d]) + 4) for d in down}
    return [("/" + d, round(purity[d], 9), "block" if purity[d] >= 0.8 else "allow") for d in down]


def test_templates_are_those_of_a_plain_tree(spark):
    import random

    rng = random.Random(4)
    rows = []
    for k in range(900):
        top = rng.choice(["a", "b", "c", "d", "e", "shop"])
        last = rng.choice(["x", "x", "y"]) if top in "abc" else rng.choice(["y", "z", f"page-{rng.randrange(60)}-{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"])
        bad = {"a": 1, "d": rng.choice([0, 1, None]), "e": 0}.get(top)
        tail = rng.choice(["", "", "/deep/er/and/deeper/" + rng.choice("pq")])
        rows.append((f"http://h.org/{top}/{last}{'/' + str(k) if k % 3 else ''}{tail}", bad if k % 2 else None))
    rows += [(f"http://h.org/many/{chr(97 + k % 26)}{chr(97 + k // 26)}", k % 2 if k < 30 else None) for k in range(200)]
    df = spark.createDataFrame([(k, u, "", y) for k, (u, y) in enumerate(rows)], PAGES + ", bad int")
    got = {r["page_id"]: (r["template"], round(r["purity"], 9), r["verdict"]) for r in filter_urls(df, [], label=F.col("bad")).collect()}
    assert [got[k] for k in range(len(rows))] == brute(rows)
    assert len({t for t, _, _ in got.values()}) > 10 and {v for _, _, v in got.values()} == {"allow", "block"}


def test_an_unlabelled_branch_inherits_from_alike_ones_only(spark):
    """``b`` is like the blocked ``a``; ``c`` has other pages below it; ``d`` is alike but its own labels are good."""
    rows = [(f"http://h.org/{top}/{'post' if top != 'c' else 'tag'}/{k}", {"a": 1, "d": 0}.get(top)) for top in "abc" for k in range(40)]
    got = filter_urls(spark.createDataFrame([(k, u, "", y) for k, (u, y) in enumerate(rows)], PAGES + ", bad int"), [], label=F.col("bad")).collect()
    assert {r["path"][1]: r["verdict"] for r in got} == {"a": "block", "b": "block", "c": "allow"}
    rows += [(f"http://h.org/d/post/{k}", 0) for k in range(40)]
    got = filter_urls(spark.createDataFrame([(k, u, "", y) for k, (u, y) in enumerate(rows)], PAGES + ", bad int"), [], label=F.col("bad")).collect()
    assert {r["path"][1]: r["verdict"] for r in got} == {"a": "block", "b": "allow", "c": "allow", "d": "allow"}


def test_empty_repeated_and_clashing(spark):
    assert filter_urls(spark.createDataFrame([], PAGES), URL_RULES).count() == 0
    df = spark.createDataFrame([(1, "http://a.net/es/1", "")] * 3, PAGES).withColumns({k: F.lit(v) for k, v in X.CLASHING.items()})
    assert [r["verdict"] for r in filter_urls(df, URL_RULES).collect()] == ["block"] * 3
