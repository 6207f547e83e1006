"""Main text of web pages by consensus paths of their host.

Every page scores its containers by the text that is not links, menus, adverts and the like. Its best container votes,
by its generalised path of tags and classes (numbers taken out), within its host; Spark counts the votes. The path
with most votes is then used on all pages of the host, so that a page whose own scores mislead follows its host's
layout; a page that has no such container keeps its own best.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, text_of

# Elements as the HTML standard groups them, and names that pages give their parts.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot "
    "th thead tr ul".split()
)
_CONTAINER = frozenset("article body center html div dd dl fieldset figure main section table tbody td th tr ul ol blockquote".split())
_CLOSES_P = _BLOCK - frozenset(("body", "html", "button", "option", "select", "td", "th", "tr", "tbody", "thead", "tfoot"))
#: An opening tag closes an open element of these, up to the nearest of the second set.
_SIBLINGS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table", "tbody", "thead", "tfoot"))), "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))), "option": (frozenset(("option",)), frozenset(("select",))),
}
_DROPPED_TAGS = frozenset("nav aside footer button select menu dialog svg canvas object audio video head search datalist".split())
_FORM_TAGS = frozenset("form fieldset".split())
_CONTROLS = frozenset("input select textarea button".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: A name says menu, advert, comments and the like if it has a word of the first set and otherwise only words of the second.
_DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies disqus disclaimer footer gdpr login menu menus modal nav navbar navigation newsletter notice notices notification "
    "overlay pager pagination popup privacy promo promoted recommend recommended related replies reply respond search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
#: Of these, names that also stand on what holds a page's whole text.
_LOOSE_NAMES = frozenset(
    "banner disclaimer modal notice notices notification overlay pager pagination popup promo promoted search share sharing skip social sponsor sponsored subscribe "
    "subscription tags toolbar topbar widget widgets".split()
)
_HEAD_NAMES = frozenset("header masthead".split())
_NEUTRAL_NAMES = frozenset(
    "all area articles aside bar block body bottom box btn button buttons card cards col column container content desktop entry fixed form global "
    "group head heading holder icon icons inner js left link links list item items main message mobile mod module more nofollow outer page panel "
    "part pop post posts primary region responsive right row secondary section site slot stories sticky story sub subnav text thread title to top "
    "unit up us view wp wrap wrapper zone".split()
)
_GOOD_NAMES = frozenset("article body content entry main post story text".split())
_ARTICLE_NAMES = frozenset("article entry post story".split())
#: Whether a part is none of the article whatever it holds, or only if it holds less than HALF of the page's text.
_STAYS, _SOFT, _HARD = 0, 1, 2
HALF = 0.5
#: Characters a control: a form with less text than that is a form, even if it holds most of the page's text.
TEXT_A_CONTROL = 100
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)>""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
_NAME_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_DIGITS = re.compile(r"\d+")


class _Node:
    __slots__ = ("tag", "label", "parent", "dropped", "soft", "held", "controls", "linked", "score", "good", "number", "code", "in_body", "in_article")

    def __init__(self, tag: str, label: str, parent: _Node | None, dropped: int, linked: bool, good: bool, number: int):
        self.tag, self.label, self.parent, self.linked, self.good, self.number = tag, label, parent, linked, good, number
        self.dropped = dropped == _HARD or parent is not None and parent.dropped
        #: The nodes from here up that are dropped if they hold little.
        self.soft: tuple[_Node, ...] = parent.soft if parent else ()
        if dropped == _SOFT:
            self.soft = (*self.soft, self)
        self.held = self.controls = 0
        self.score = 0.0
        self.code = hash((parent.code if parent else 0, label))  # of the path, for comparisons within a page
        self.in_body = tag == "body" or parent is not None and parent.in_body
        self.in_article = tag in ("article", "main") or parent is not None and parent.in_article  # its header has a title, not a menu

    def where(self) -> str:
        """Generalised path from the root."""
        labels, at = [], self
        while at is not None:
            labels.append(at.label)
            at = at.parent
        return "/".join(reversed(labels))


def _path_code(path: str) -> int:
    code = 0
    for label in path.split("/"):
        code = hash((code, label))
    return code


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c, bare in _ATTRIBUTE.findall(source):
        out.setdefault((name or bare).lower(), a or b or c)
    return out


class Page:
    """The blocks of text of a page, each with the node it stands in, in page order."""

    def __init__(self, source: str | None, names: bool = True):
        self._by_name = names
        self.blocks: list[tuple[_Node, str, int]] = []
        self._parts: list[str] = []
        self._links = 0
        self._in_link = 0
        self.root = _Node("html", "html", None, _STAYS, False, False, 0)
        self._numbered = 0
        self._at = self.root
        self._parse(source or "")
        self._sift()
        self._score()
        if names and not self.blocks and source:  # a name that usually says menu or the like stands above all text
            self.__init__(source, names=False)

    def _end_block(self) -> None:
        if self._parts:
            text = " ".join(entities.unescape("".join(self._parts)).split())
            if text and not self._at.dropped:
                self.blocks.append((self._at, text, min(self._links, len(text))))
            self._parts, self._links = [], 0

    def _text(self, text: str) -> None:
        if text:
            self._parts.append(text)
            if self._in_link:
                self._links += len(text.strip())

    def _open(self, tag: str, source: str) -> None:
        if tag == "html" or tag == "body" and self._at.in_body:
            return
        given = _attributes(source) if source and not source.isspace() else {}
        names = (given.get("class", "") + " " + given.get("id", "")).split() if given else []
        parts = {p.lower() for n in names for p in _NAME_PARTS.findall(n)}
        at = self._at
        dropped = _HARD if tag in _DROPPED_TAGS or tag == "header" and not at.in_article else _SOFT if tag in _FORM_TAGS else _STAYS
        if given and dropped != _HARD and not at.dropped and tag != "body":
            style = given.get("style", "").replace(" ", "").lower()
            if (
                "hidden" in given or given.get("aria-hidden") == "true" or given.get("role", "").lower() in _DROPPED_ROLES
                or "display:none" in style or "visibility:hidden" in style
            ):
                dropped = _HARD
            elif self._by_name:
                dropped = max(dropped, self._says_dropped(tag, names, at.in_article))
        label = tag
        if given.get("class"):
            label += "." + ".".join(sorted({_DIGITS.sub("", n) for n in given["class"].split()} - {""}))
            label = label.replace("/", "|")
        self._numbered += 1
        self._at = _Node(tag, label, at, dropped, tag == "a" or at.linked, not parts.isdisjoint(_GOOD_NAMES), self._numbered)
        if not parts.isdisjoint(_ARTICLE_NAMES):
            self._at.in_article = True

    @staticmethod
    def _says_dropped(tag: str, names: list[str], in_article: bool) -> int:
        """Whether a class or id is wholly one of menus, adverts, comments and so on; a head is one outside of articles only.

        Beside a name that says article, a loose one says nothing and any other no more than a loose one does alone.
        """
        out, says_article = _STAYS, False
        for name in names:
            parts = [p.lower() for p in _NAME_PARTS.findall(name)]
            if tag in ("article", "main", "p"):
                parts = ["".join(parts)]
            rest = [p for p in parts if len(p) > 1 and p not in _NEUTRAL_NAMES]
            if not rest:
                says_article = says_article or not _ARTICLE_NAMES.isdisjoint(parts)
            elif _DROPPED_NAMES.issuperset(rest):
                out = max(out, _SOFT if _LOOSE_NAMES.issuperset(rest) else _HARD)
            elif not in_article and _ARTICLE_NAMES.isdisjoint(parts) and (_DROPPED_NAMES | _HEAD_NAMES).issuperset(rest):
                out = _HARD
        return max(out - 1, _STAYS) if says_article else out

    def _line(self) -> Iterator[_Node]:
        at: _Node | None = self._at
        while at is not None:
            yield at
            at = at.parent

    def _close_to(self, node: _Node) -> None:
        self._at = node.parent or self.root

    def _parse(self, source: str) -> None:
        at, raw = 0, None
        end = len(source)
        lowered = None
        while at < end:
            m = _TOKEN.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._closed(tag)
                continue
            if tag == "br" or tag == "hr":
                self._parts.append(" ")
                if tag == "hr":
                    self._end_block()
                continue
            if tag in _CONTROLS and "hidden" not in m[3]:
                for n in self._at.soft:
                    n.controls += 1
            if tag in _VOID:
                continue
            if tag in _RAW:
                if lowered is None:
                    lowered = source.lower()
                raw = lowered.find(f"</{tag}", at)
                if raw < 0:
                    at = end
                else:
                    close = source.find(">", raw)
                    at = close + 1 if close >= 0 else end
                continue
            if tag in _BLOCK:
                self._end_block()
                if tag in _CLOSES_P:
                    for n in self._line():
                        if n.tag == "p":
                            self._close_to(n)
                            break
                        if n.tag in _CONTAINER:
                            break
                if tag in _SIBLINGS:
                    own, stop = _SIBLINGS[tag]
                    for n in self._line():
                        if n.tag in stop:
                            break
                        if n.tag in own:
                            self._close_to(n)
                            if tag != "tr":
                                break
            if m[3].endswith("/") and tag not in _BLOCK:
                continue
            self._open(tag, m[3])
            if tag == "a":
                self._in_link = 1
        self._end_block()

    def _closed(self, tag: str) -> None:
        if tag in _VOID or tag in ("html", "body"):
            if tag == "br":
                self._parts.append(" ")
            return
        if tag in _BLOCK:
            self._end_block()
        if tag == "a":
            self._in_link = 0
        for n in self._line():
            if n.tag == tag and n is not self.root:
                self._close_to(n)
                return
            if tag not in _BLOCK and n.tag in _CONTAINER:  # an inline end tag doesn't close blocks
                return

    def _sift(self) -> None:
        """Drops the text of parts that hold less than half of the page's and of forms that are mostly controls."""
        total = 0
        for node, text, links in self.blocks:
            worth = len(text) - links
            total += worth
            for n in node.soft:
                n.held += worth
        goes = lambda n: n.held < HALF * total or n.tag in _FORM_TAGS and n.held < TEXT_A_CONTROL * n.controls or not n.held
        self.blocks = [b for b in self.blocks if not any(map(goes, b[0].soft))]

    def _score(self) -> None:
        """Text that is not links counts for the nearest container, and half for the one above."""
        self.best: _Node | None = None
        for node, text, links in self.blocks:
            worth = len(text) - 2 * links
            n, share = node, 1.0
            while n is not None and share >= 0.5:
                if n.tag in _CONTAINER and (n is not node or n.tag not in ("ul", "ol", "table", "tbody", "tr")):
                    n.score += share * worth
                    share /= 2
                n = n.parent
        best = 0.0
        for n in {m for node, _, _ in self.blocks for m in self._above(node)}:
            s = n.score * (1.6 if n.tag in ("article", "main") else 1.3 if n.good else 1.0)
            if s > best or s == best and self.best is not None and s > 0 and n.number < self.best.number:
                self.best, best = n, s
        if self.best is None:  # nothing but links: the container with most text
            held: dict[_Node, int] = {}
            for node, text, _ in self.blocks:
                for n in self._above(node):
                    if n.tag in _CONTAINER:
                        held[n] = held.get(n, 0) + len(text)
            self.best = max(held, key=lambda n: (held[n], n.number), default=None)  # the innermost that has it all
        self.best_score = best

    @staticmethod
    def _above(node: _Node | None) -> Iterator[_Node]:
        while node is not None:
            yield node
            node = node.parent

    def vote(self) -> tuple[str | None, float]:
        """Path and score of the best container; no path for a page without text."""
        return (self.best.where(), self.best_score) if self.best else (None, 0.0)

    def extract(self, path: str | None) -> str:
        """Text of the containers on the path, or of the page's own best where there are none."""
        code = _path_code(path) if path else None
        # A menu may stand in a container of the same path beside the text's, as another cell of its row.
        on_path = lambda n, least: any(m.code == code and m.score > least for m in self._above(n))
        inside = [t for n, t, _ in self.blocks if on_path(n, 0)] if path else []
        if path and not inside:
            inside = [t for n, t, _ in self.blocks if on_path(n, float("-inf"))]
        if not inside and self.best:
            inside = [t for n, t, _ in self.blocks if any(m is self.best for m in self._above(n))]
        return " ".join(inside)


def _votes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        found = [Page(h).vote() for h in part["html"]]
        yield pd.DataFrame({"host": part["host"], "path": [f[0] for f in found], "score": [f[1] for f in found]})


def _extracted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        text = [Page(h).extract(p) for h, p in zip(part["html"], part["path"], strict=True)]
        yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": text})


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, text), one for each row of pages.

    Character references are decoded, white space in a block becomes one space, and blocks are joined by one space
    in page order. A null html gives the empty text. Pages with a null address, or one without a host, go each by their
    own best container. Ties between paths go to the higher sum of scores, then to the first in order. Other columns are
    ignored; an empty table gives an empty result.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    host = F.when(host != "", host)
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), text_of(html_col).alias("html"))
    votes = rows.select("host", "html").mapInPandas(_votes, "host string, path string, score double").where("path is not null and host is not null")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    winners = counted.groupBy("host").agg(F.min_by("path", F.struct(-F.col("n"), -F.round("score"), F.col("path"))).alias("path"))
    named = rows.join(settle(winners, "paths"), "host", "left")
    return named.select("page_id", "url", "html", "path").mapInPandas(_extracted, "page_id bigint, url string, text string")
