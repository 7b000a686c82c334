"""Main text of web pages by consensus paths of a host.

Every page is read into a light tree. Each container is scored by how much of the page's running text it
holds (recall) and how little else (precision); the page votes for the best ones (``votes`` of them) by
their generalised path: tags with all their class names, digits made alike. Spark adds the votes for each
host, and each page is then extracted again from the nodes on its host's winning path. A page without such
a node, or whose own best container holds far more running text, falls back on its own best.

Inside the chosen nodes, subtrees that are not the article are left out: by tag, role, hidden state and
class or id words (menus, headers, footers, sidebars, notices, adverts, forms, comments and so on). A mark
is no proof: a form, or what only its class or id words mark as boilerplate, stays if it holds most of the
page's running text; and where every piece of running text is marked, comments, roles and tags yield in the
same way. What is hidden never does. The text of a block is what block-level tags enclose; ``br`` is white
space within it.

A page is read twice, to vote and to extract: the alternative is to write every page's blocks in between,
which costs more than reading.

Edges: null or empty html gives an empty text; a null url has the empty host, which votes like another; of
equally good containers the deepest counts, and of paths with equal votes the last by name; broken markup
never fails; attributes, texts and pages may be of any length and are read in linear time; repeated rows give
the same text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import bounded_batches, written

# Tag names of HTML, by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article blockquote body center dd details div dl fieldset figure main ol section table tbody td tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("aside button datalist dialog footer head input label menu nav select".split())
#: Marks: boilerplate unless most running text lies under it; the same if nothing else is left; hidden or a control.
MAYBE, LIKELY, HIDDEN = 1, 2, 3
CONTROLS = frozenset("button datalist head input label select".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: What a start tag ends when it is still open.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
#: Words in a class or an id that mark what is not the article.
MARKS = frozenset(
    "ad ads adsense advert advertisement adverts advertising banner bottombar breadcrumb breadcrumbs byline consent cookie cookies copyright dfp disclaimer footer footnotes gdpr header login masthead menu menubar "
    "modal nav navbar navigation navlinks newsletter notice notices notification outbrain overlay pager paginate pagination paywall popup promo promoted promotion recommend recommendations recommended related "
    "search share sharing shares sidebar sidenav signup skip social sponsor sponsored sponsors subscribe subscription taboola teaser toolbar topbar trending widget widgets".split()
)
#: Marks of what readers wrote.
COMMENTS = frozenset("comment comments commentlist commenters discussion disqus replies respond reviews".split())

#: Possessive throughout. A tag ends at the first > outside quotes; its last group is empty if it does not end so.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>?)|[^<]++|<",
    re.S,
)
#: What a tag with an unclosed quote is read by, up to the next > or <.
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)(>)|<()()()()")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
#: Characters from which a block counts as running text.
RUNNING = 25
#: Containers that a page votes for, unless the caller says otherwise.
VOTES = 3
#: Characters of hosts and paths that are broadcast, at most.
MOST_BROADCAST = 16_000_000


class Page:
    """Nodes (parent, tag, path key, drop mark) and blocks (node, text, characters in links)."""

    def __init__(self, html: str | None) -> None:
        self.parent, self.tag, self.key, self.mark = [-1], [""], [""], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(html or "")

    def _node(self, parent: int, tag: str, attributes: str) -> int:
        mark, key = (HIDDEN if tag in CONTROLS else LIKELY if tag in DROPPED else MAYBE if tag in ("header", "form") else 0), tag
        if attributes and not attributes.isspace():
            found = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(attributes)}
            named = unescape(f"{found.get('class', '')} {found.get('id', '')}").lower()
            if tag not in ("html", "body", "main", "article"):
                words = set(_WORD.findall(named))
                if words & COMMENTS:
                    mark = max(mark, LIKELY)
                elif words & MARKS:
                    mark = max(mark, MAYBE)
            elif set(_WORD.findall(named)) & COMMENTS and tag == "article":
                mark = max(mark, LIKELY)
            style = found.get("style", "").replace(" ", "").lower()
            if found.get("role", "").lower() in ROLES:
                mark = max(mark, LIKELY)
            if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
                mark = HIDDEN
            classes = sorted(set(_DIGITS.sub("0", found.get("class", "").lower()).split()))
            key = ".".join([tag, *classes])
        self.parent.append(parent)
        self.tag.append(tag)
        self.key.append(key)
        self.mark.append(mark)
        return len(self.tag) - 1

    def _read(self, html: str) -> None:
        stack, block, words, linked, links, at = [0], 0, [], 0, 0, 0
        size, loose = len(html), 0

        def flush() -> None:
            nonlocal words, linked
            if words:
                text = " ".join(unescape("".join(words)).split())
                if text:
                    self.blocks.append((block, text, linked))
                words, linked = [], 0

        tags = self.tag
        while at < size:
            m = _TOKEN.match(html, at)
            if m[4] == "" or m[2] and at < loose:
                # A quote is not closed. Up to where that showed, quotes mean nothing, so nothing is read a third time.
                loose = max(loose, m.end())
                m = _LOOSE.match(html, at)
            at = m.end()
            closing, name, attributes = m[1], m[2], m[3] or ""
            if not name:
                piece = m[0]
                if piece[0] != "<" or piece == "<":
                    words.append(piece)
                    if links:
                        linked += len(piece)
                elif piece.startswith("<![CDATA["):
                    words.append(piece[9:].removesuffix("]]>"))
                continue
            name = name.lower()
            if closing:
                if name in ("br", "p") and name not in (tags[k] for k in stack):
                    words.append(" ")
                    continue
                for depth in range(len(stack) - 1, 0, -1):
                    open_tag = tags[stack[depth]]
                    if open_tag == name:
                        if name in BLOCK or any(tags[k] in BLOCK for k in stack[depth:]):
                            flush()
                        links -= sum(tags[k] == "a" for k in stack[depth:])
                        del stack[depth:]
                        block = next(k for k in reversed(stack) if k == 0 or tags[k] in BLOCK)
                        break
                    if name not in BLOCK and open_tag in BLOCK:
                        break  # an inline end tag does not close a block
                continue
            if name == "br":
                words.append(" ")
                continue
            if name in RAW:
                if not attributes.endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
                    at = end.end() if end else size
                continue
            if name in BLOCK:
                flush()
                ends = ENDS.get(name)
                for depth in range(len(stack) - 1, 0, -1):
                    open_tag = tags[stack[depth]]
                    if open_tag == "p" or ends and open_tag in ends:
                        links -= sum(tags[k] == "a" for k in stack[depth:])
                        del stack[depth:]
                        if open_tag != "p" and open_tag == name:
                            break
                    elif open_tag in BLOCK and (open_tag in CONTAINER or open_tag in DROPPED):
                        if not (ends and open_tag in ("tbody", "tr") and name in ("tr", "tbody")):
                            break
            if name in VOID:
                if name in BLOCK:
                    block = next(k for k in reversed(stack) if k == 0 or tags[k] in BLOCK)
                continue
            node = self._node(stack[-1], name, attributes)
            if attributes.endswith("/") and name not in BLOCK:
                continue
            stack.append(node)
            if name == "a":
                links += 1
            if name in BLOCK:
                block = node
        flush()

    def _sum_up(self, amounts: list[int]) -> None:
        """Add each node's amount to its parents'; a child always comes after its parent."""
        for k in range(len(amounts) - 1, 0, -1):
            amounts[self.parent[k]] += amounts[k]

    def kept(self) -> list[bool]:
        """Which nodes may hold article text."""
        running = [0] * len(self.tag)
        for node, text, linked in self.blocks:
            if len(text) >= RUNNING and 2 * linked < len(text):
                running[node] += len(text)
        own = list(running)
        self._sum_up(running)

        def fine(yielding: int) -> list[bool]:
            out = [True] * len(self.tag)
            for k in range(1, len(self.tag)):
                mark = self.mark[k]
                out[k] = out[self.parent[k]] and not (mark > yielding or mark and 10 * running[k] <= 6 * running[0])
            return out

        first = fine(MAYBE)
        if running[0] and not any(map(operator.and_, first, map(bool, own))):
            return fine(LIKELY)
        return first

    def path(self, node: int) -> str:
        keys = []
        while node > 0:
            keys.append(self.key[node])
            node = self.parent[node]
        return "/".join(reversed(keys))

    def scores(self, fine: list[bool], least: int = RUNNING) -> list[tuple[float, int, int]]:
        """(F-measure of running text, running text, node) of containers, best first; of equals the deepest.

        A page without any running text is scored on whatever short text it has.
        """
        good, every = [0] * len(self.tag), [0] * len(self.tag)
        for node, text, linked in self.blocks:
            every[node] += len(text)
            if fine[node] and (len(text) >= least or self.tag[node] in HEADING) and 2 * linked < len(text):
                good[node] += len(text)
        self._sum_up(every)
        self._sum_up(good)
        out = [(2.0 * good[k] / (every[k] + good[0]), good[k], k) for k in range(len(self.tag)) if good[k] and fine[k] and (k == 0 or self.tag[k] in CONTAINER)]
        if not out and least > 1:
            return self.scores(fine, 1)
        out.sort(key=lambda x: (-x[0], -x[2]))
        return out

    def text(self, roots: set[int], fine: list[bool]) -> str:
        """The blocks under ``roots`` in page order; headers there give only their headings."""
        inside = [False] * len(self.tag)
        out = []
        for k in range(len(self.tag)):
            inside[k] = k in roots or k > 0 and inside[self.parent[k]]
        for node, text, _ in self.blocks:
            if inside[node] and (fine[node] or self.tag[node] in HEADING and self._in_header_only(node, fine)):
                out.append(text)
        return "\n".join(out)

    def _in_header_only(self, node: int, fine: list[bool]) -> bool:
        """A heading in an article's own header, with nothing else against it."""
        while node > 0 and not fine[node]:
            if self.mark[node] and self.tag[node] != "header":
                return False
            node = self.parent[node]
        return self.tag[node] in ("article", "main", "section", "div")


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def consensus(pages: DataFrame, votes: int = VOTES) -> DataFrame:
    """host and its winning path; votes are added before and after one shuffle."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, html in zip(batch["host"], batch["html"], strict=True):
                page = Page(html)
                best = page.scores(page.kept())[:votes]
                rows += [(host, page.path(node), round(1000 * f) if k == 0 else round(400 * f)) for k, (f, _, node) in enumerate(best)]
            yield pd.DataFrame(rows, columns=["host", "path", "votes"])

    named = pages.select(host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html")).filter("html <> ''")
    summed = named.mapInPandas(vote, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return summed.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))


def extract(pages: DataFrame, votes: int = VOTES) -> DataFrame:
    """page_id, url, text and n_chars of every row."""

    @F.pandas_udf("string")
    def main_text(html: pd.Series, path: pd.Series) -> pd.Series:
        out = []
        for source, winner in zip(html, path, strict=True):
            page = Page(source)
            fine = page.kept()
            ranked = page.scores(fine)
            if not ranked:
                out.append("")
                continue
            own = ranked[0]
            last = (winner or "").rpartition("/")[2]
            voted = [(good, node) for _, good, node in ranked if page.key[node] == last and page.path(node) == winner]
            roots = {node for _, node in voted} if 10 * sum(g for g, _ in voted) >= 6 * own[1] else {own[2]}
            out.append(page.text(roots, fine))
        return pd.Series(out, dtype="string")

    winners = written(consensus(bounded_batches(pages), votes), "winners")
    size = winners.agg(F.sum(F.length("host") + F.length("path"))).first()[0] or 0
    winners = F.broadcast(winners) if size <= MOST_BROADCAST else winners
    named = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url").cast("string")).alias("host"))
    # Beyond the size that is broadcast, a shuffle joins them, in which the pages of a large host can be split.
    text = F.coalesce(main_text(F.coalesce("html", F.lit("")), F.col("path")), F.lit(""))
    return named.join(winners, "host", "left").select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
