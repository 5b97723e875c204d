"""Main text of web pages by tree scoring.

A tolerant parser builds a tree without scripts, forms and other parts that are never content. Paragraphs give points for
their length and commas to their ancestors, less with each level; an ancestor's points are discounted by the share of its
text that is in links. The best container and those of its siblings that score alike are kept, and their blocks are joined.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemion.llm.common import schema

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template svg math iframe object canvas button select textarea nav footer aside dialog menu head title audio video".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset("p pre td blockquote dd h1 h2 h3".split())
#: A start tag of the key closes an open tag of the value, unless a tag of LIMITS is between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
LIMITS = frozenset("table ul ol dl div article section main body html blockquote td th select".split())
CLOSE_P = BLOCKS - {"br", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
#: Names of what is never part of the article, whatever other names say.
NEVER = re.compile(r"(?:^|[_-])(?:ads?|ad\d+|adbox|adslot|adunit|advert\w*|adsbygoogle|breadcrumbs?|combx|comments?|commentlist|respond|reply|replies|disqus|cookies?|consent|gdpr|menu|nav|navbar|navigation|newsletter|outbrain|pager|pagination|popup|modal|promo\w*|related|recommend\w*|share|sharing|shoutbox|sidebar|skip|social|sponsor\w*|subscribe|subscription|taboola|toolbar|login|signup)(?:$|[_-])", re.I)
#: Such a name alone is enough as well, but for what holds an article or heads it.
NOTICES = re.compile(r"^(?:notice|alert|banner)s?$", re.I)
COMMENTS = re.compile(r"(?:^|[_-])(?:comments?|reply|replies)(?:$|[_-])", re.I)
#: Such names only say what the layout has.
LAYOUT = re.compile(r"^(?:has|with|without|no|is|not)[_-]", re.I)
#: Names of what isn't either, unless another name is LIKELY.
UNLIKELY = re.compile(r"(?:^|[\s_-])(?:banner|footer|header|masthead|notice|alert|overlay|widget|search)(?:$|[\s_-])", re.I)
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|articlebody|body|content|entry|main|page|post|story|text)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog".split())
KEEP = frozenset("html body article main h1 h2 h3 h4 h5 h6 p".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset("html body main article".split())
PLAIN = frozenset("p pre blockquote figure table dl ul ol".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "score", "chars", "commas", "linked", "candidate")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.score, self.chars, self.commas, self.linked, self.candidate = 0.0, 0, 0, 0, False


class Tree(HTMLParser):
    """Builds the tree; parts that are never content are passed over. Counts of open tags keep the work linear in deep nesting.

    named: whether names and roles say what is no content.
    """

    def __init__(self, named: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.named = named
        self.root = self.at = Node("html", {}, None)
        self.open: Counter = Counter()
        self.skip: list[str] = []  # open tags inside a dropped part
        self.skipped: Counter = Counter()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skip:
            if tag not in VOID:
                self._skip(tag)
            return
        if tag == "html":
            return
        if tag in CLOSE_P:
            self._close({"p"}, LIMITS - {"p"})
        if tag in CLOSES:
            self._close(CLOSES[tag], LIMITS - CLOSES[tag])
        named = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden", "style", "itemprop")}
        node = Node(tag, named, self.at)
        if tag not in VOID and (tag in DROPPED or self._unlikely(node)):
            self._skip(tag)
            return
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # A slash closes nothing in HTML, but for void elements and those of foreign content.
        if tag in VOID or tag not in BLOCKS and tag in DROPPED:
            if tag in VOID:
                self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if self.skipped[tag]:
                while True:
                    last = self.skip.pop()
                    self.skipped[last] -= 1
                    if last == tag:
                        break
            elif tag in ("body", "article", "main"):  # an unclosed dropped part ends with what holds it
                self.skip, self.skipped = [], Counter()
                self._end(tag)
            return
        self._end(tag)

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.at.children.append(data)

    def _skip(self, tag: str) -> None:
        self.skip.append(tag)
        self.skipped[tag] += 1

    def _leave(self, node: Node) -> None:
        """Closes the open nodes up to and with this one."""
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent
        self.open[node.tag] -= 1
        self.at = node.parent

    def _end(self, tag: str) -> None:
        if not self.open[tag]:
            return
        node = self.at
        while node.tag != tag:
            if tag not in BLOCKS and node.tag in BLOCKS:
                return  # an inline end tag closes no block
            node = node.parent
        if node.parent is not None:
            self._leave(node)

    def _close(self, tags: set[str], limits: frozenset[str]) -> None:
        left = sum(self.open[t] for t in tags)
        node, last = self.at, None
        while left and node is not None and node.tag not in limits:
            if node.tag in tags:
                last = node
                left -= 1
            node = node.parent
        if last is not None and last.parent is not None:
            self._leave(last)

    def _unlikely(self, node: Node) -> bool:
        a, tag = node.attrs, node.tag
        if not a and tag != "header":
            return False
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
            return True
        if not self.named:
            return False
        names = f"{a.get('class', '')} {a.get('id', '')}".split()
        if tag not in WHOLE | HEADINGS and any(NOTICES.search(x) for x in names):
            return True
        if tag not in ("html", "body", "main"):
            pattern = COMMENTS if tag == "article" else NEVER
            if any(pattern.search(x) and not LAYOUT.search(x) for x in names):
                return True
        if tag in KEEP:
            return False
        if tag == "header":  # that of an article stays
            return not (self.open["article"] or self.open["main"])
        if a.get("role") in ROLES:
            return True
        return bool(UNLIKELY.search(" ".join(names))) and not LIKELY.search(" ".join(names))


def measure(root: Node) -> list[Node]:
    """Sets chars, commas and linked of each node; returns the nodes, children before parents."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if not isinstance(c, str)]
    order.reverse()
    for node in order:
        node.chars = node.commas = node.linked = 0
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(c.strip())
                node.commas += c.count(",") + c.count("،") + c.count("、")
            else:
                node.chars += c.chars
                node.commas += c.commas
                node.linked += c.linked
        if node.tag == "a":
            node.linked = node.chars
    return order


def drop_forms(root: Node, order: list[Node]) -> bool:
    """Takes out forms, but one around most of the page with paragraphs in it; returns whether any was."""
    out, holds = set(), set()
    for node in order:  # children before parents
        if node.tag == "form" and not (node in holds and 2 * node.chars > root.chars):
            out.add(node)
        elif node.parent is not None and (node in holds or node.tag in ("p", "article", "main")):
            holds.add(node.parent)
    for parent in {node.parent for node in out}:
        parent.children = [c for c in parent.children if c not in out]
    return bool(out)


def density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def is_paragraph(node: Node) -> bool:
    return node.tag in PARAGRAPHS or node.tag in ("div", "section", "article", "main", "body", "li") and any(isinstance(c, str) and c.strip() for c in node.children)


def choose(root: Node) -> list[Node]:
    """The containers of the main text."""
    order = measure(root)
    if any(node.tag == "form" for node in order) and drop_forms(root, order):
        order = measure(root)
    candidates = []
    for node in order:
        if node.chars < 2 or not is_paragraph(node):
            continue
        points = (1.0 + node.commas + min(node.chars / 100.0, 3.0)) * (1 - density(node))
        up, level = node if node.tag not in PARAGRAPHS else node.parent, 0
        while up is not None and level < 5:
            up.score += points / (1, 2, 6, 9, 12)[level]
            if not up.candidate:
                up.candidate = True
                candidates.append(up)
            up, level = up.parent, level + 1
    if not candidates:
        return [root]
    for node in candidates:
        names = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')} {node.attrs.get('itemprop', '')}"
        bonus = {"article": 1.5, "main": 1.2}.get(node.tag, 1.0) * (1.25 if LIKELY.search(names) else 1.0)
        node.score *= (1 - density(node)) * bonus
    best = max(candidates, key=lambda n: n.score)
    up = best
    while up is not None and best.tag not in ("article", "main"):
        if up.tag in ("article", "main") and 2 * (up.chars - up.linked) > root.chars - root.linked:
            best = up  # which holds most of the page, so it is the article as a whole
        up = up.parent
    if best.parent is None:
        return [best]
    return [c for c in best.parent.children if not isinstance(c, str) and (c is best or _belongs(c, best))]


def _belongs(c: Node, best: Node) -> bool:
    """Whether a sibling of the best container is part of the main text as well."""
    if not c.chars or density(c) >= 0.5:
        return False
    if c.candidate and c.score >= max(10.0, best.score * 0.2) and (c.tag == best.tag or best.tag not in ("article", "main")):
        return True
    if best.tag in ("article", "main"):  # which hold their parts
        return c.tag == "p" and c.chars > 80 and density(c) < 0.25
    if c.tag in HEADINGS:
        return True
    return density(c) < 0.25 and (c.tag in PLAIN or c.chars > 80)


def text_of(nodes: list[Node]) -> str:
    """The blocks' text in page order, white space turned into one space."""
    parts: list[str] = []
    todo: list[Node | str] = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.tag in BLOCKS:
            parts.append(" ")
            todo.append(" ")
            todo += reversed(x.children)
        else:
            todo += reversed(x.children)
    return " ".join("".join(parts).split())


def main_text(html: str | None) -> str:
    if not html:
        return ""
    for named in (True, False):  # a page whose names leave nothing is read without them
        tree = Tree(named)
        tree.feed(html)
        tree.close()
        if text := text_of(choose(tree.root)):
            return text
    return ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, url, text, n_chars.

    Null and empty pages, and those without text, give an empty text. The whole page is read, however long or deeply
    nested. Repeated rows are each extracted; null ids and urls are passed through; other columns are left aside; an empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias(url_col), F.col(html_col).cast("string").alias("__html"))
    return rows.mapInArrow(run, schema(f"`{id_col}` long, `{url_col}` string, text string, n_chars long"))
