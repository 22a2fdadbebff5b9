"""Main text of web pages by composite text density.

The page becomes a tree. Menus, headers, footers, sidebars, notices, adverts, forms, comments of readers, scripts and
styles are marked by element, role and class name and count as no text. A class or id counts as a whole, not by a word
in it, but for classes of two or three words that begin or end with a name, like taboola-ad or reader-comments; classes
of states, like no-sidebar, and names inside code do not count. What holds the article, or most of a page without one,
is not set apart by its name; names that may be the article's own, like search or related, set apart what is mostly
links or less dense than the body. Every other node has a composite density:
characters per tag, adjusted by the share of link characters and link tags. The node whose children's densities add
up to most is the core; from there the path to the body is climbed as long as the density stays over the body's, and
the subtree reached is the article, together with other articles beside the path, or, on pages without article and
main, the headings and parts with text beside it. Their text is kept whole.

Blocks are joined in page order by one space, white space inside becomes one space, character references are decoded.

Null or empty html, and pages without text outside marked parts: empty text. Repeated rows are read each by itself;
ties go to the node that comes first. Unclosed, nested and truncated markup is read as far as it goes. An empty table
gives no rows; other columns pass untouched, those named like an output are replaced.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import extend_rows, require

# Elements and names of parts that are not the article.
APART = frozenset("nav footer aside form script style noscript template iframe object canvas button select textarea dialog head title".split())
#: Drawings and formulas: their text counts, but not what describes them or is kept for reuse.
FOREIGN = frozenset("svg math".split())
UNSEEN = frozenset("defs desc metadata symbol annotation annotation-xml".split())
#: Parts of drawings and formulas that hold page elements again, and page elements that end a drawing elsewhere.
HOSTS = frozenset("foreignobject desc annotation-xml mtext".split())
BREAKS_OUT = frozenset(
    "b blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta ol p pre ruby s small span strong"
    " sub sup table u ul var article aside footer header main nav section".split()
)
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th"
    " thead title tr ul".split()
)
CLOSES_P = BLOCK - {"br", "body", "html", "head", "title", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "button", "select"}
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
#: Names of parts that are not the article, names that may also be an article's own, and words that go with either.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle adsense promo promos sponsor sponsored nav navbar breadcrumb breadcrumbs"
    " sidebar footer comment comments replies disqus gdpr popup modal newsletter pagination".split()
)
PERHAPS = frozenset(
    "banner navigation menu cookie cookies consent notice overlay subscribe subscription share sharing social related"
    " recommended widget login signup search skip".split()
)
WITH = frozenset(
    "site page main top bottom left right inner outer bar block box wrap wrapper container area slot section list item items links link"
    " buttons button icons form content body posts articles stories media primary secondary global thread to unit units google user users reader readers".split()
)
TALK = frozenset("comment comments replies disqus".split())
#: Words of classes that tell a state or a subject of what they stand on, and name no part.
STATES = frozenset("no non not has have with without is hide hidden tag tags category enabled disabled shown open closed".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | {"p"}
CONTROLS = frozenset("button input select textarea form".split())
NO, MAYBE, LIKELY, SURELY, TALKED, ALWAYS = range(6)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>\"']*+(?:\"[^\"]*\"[^>\"']*+|'[^']*'[^>\"']*+)*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)",
    re.S,
)
#: One attribute with its whole value, so that the next match starts behind it.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[a-z0-9]+")
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def name_mark(token: str, is_class: bool, headers: bool) -> int:
    """What one class or id says. ``headers``: whether a header is apart here."""
    words = WORD.findall(token)
    found = set(words)
    if found <= NAMES | PERHAPS | WITH | {"header"}:
        if found & TALK:
            return TALKED
        if found & NAMES or (headers and "header" in found) or len(found & PERHAPS) > 1:
            return SURELY
        return MAYBE if found & PERHAPS else NO
    if is_class and 2 <= len(words) <= 3 and not found & STATES:
        ends = {words[0], words[-1]}
        return SURELY if ends & TALK else LIKELY if ends & NAMES else NO
    return NO


def mark(name: str, attrs: str, in_article: bool, in_code: bool = False) -> int:
    """What element and attributes say about a part: ALWAYS apart, by its name TALKED, SURELY, LIKELY or MAYBE, or NO mark."""
    if name in APART or name in UNSEEN or (name == "header" and not in_article):
        return ALWAYS
    if not attrs or attrs.isspace() or name in ("html", "body", "article", "main"):
        return NO
    found = NO
    for key, a, b, c in ATTRIBUTE.findall(attrs):
        value = a or b or c
        key = key.lower()
        if key == "hidden" or (key == "role" and value.lower() in ROLES):
            return ALWAYS
        if not in_code and (key == "class" or (key == "id" and name not in HEADINGS)):
            for token in HUMP.sub("-", value).lower().split():
                found = max(found, name_mark(token, key == "class", not in_article and name not in HEADINGS))
    return found


class Tree:
    """Nodes in page order: parents come before children. ``texts`` has (node, text) and (node, None) for a break."""

    def __init__(self, page: str):
        self.parent = [-1]
        self.name = ["#page"]
        self.mark = [NO]
        self.apart = [False]
        self.inside = [False]
        self.texts: list[tuple[int, str | None]] = []
        self.stack = [0]
        self.open: dict[str, int] = {}
        at = 0
        while True:
            found = TOKEN.search(page, at)
            self._text(page[at : found.start() if found else len(page)])
            if not found:
                break
            at = found.end()
            name = (found["name"] or found["name2"] or "").lower()
            if not name:
                continue
            if found["end"] or found["end2"]:
                self._end(name)
            else:
                drawn = self._start(name, found["attrs"] or "")
                if name in RAW and not drawn:
                    close = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = close.end() if close else len(page)
                    self._end(name)
        if any(NO < m < ALWAYS for m in self.mark):
            self._judge_names()

    def _text(self, text: str) -> None:
        if text:
            self.texts.append((self.stack[-1], html.unescape(text)))

    def _pop(self) -> None:
        node = self.stack.pop()
        self.open[self.name[node]] -= 1
        if self.name[node] in BLOCK:
            self.texts.append((self.stack[-1], None))

    def _drawing(self) -> int:
        """Place on the stack of the drawing or formula around, 0 if none."""
        if any(self.open.get(kind) for kind in FOREIGN):
            for at in range(len(self.stack) - 1, 0, -1):
                kind = self.name[self.stack[at]]
                if kind in HOSTS:
                    return 0
                if kind in FOREIGN:
                    return at
        return 0

    def _start(self, name: str, attrs: str) -> bool:
        """Adds an element; whether it is part of a drawing or formula. Only there, and without content, a slash ends it."""
        drawing = self._drawing()
        if drawing and name in BREAKS_OUT:
            while len(self.stack) > drawing:
                self._pop()
            drawing = 0
        if name in CLOSES_P and self.open.get("p"):
            self._end("p")
        if name in SIBLINGS:
            close, limits = SIBLINGS[name]
            while any(self.open.get(c) for c in close):
                nearest = next((d for d in range(len(self.stack) - 1, 0, -1) if self.name[self.stack[d]] in close or self.name[self.stack[d]] in limits), 0)
                if not nearest or self.name[self.stack[nearest]] in limits - close:
                    break
                while len(self.stack) > nearest:
                    self._pop()
        up = self.stack[-1]
        if name in BLOCK:
            self.texts.append((up, None))
        node = len(self.parent)
        inside = self.inside[up]
        self.parent.append(up)
        self.name.append(name)
        self.mark.append(mark(name, attrs, inside, bool(self.open.get("pre") or self.open.get("code"))))
        self.apart.append(self.apart[up] or self.mark[-1] == ALWAYS)
        self.inside.append(inside or name in ("article", "main"))
        if name not in VOID and not ((drawing or name in FOREIGN) and attrs.endswith("/")):
            self.stack.append(node)
            self.open[name] = self.open.get(name, 0) + 1
        return drawing > 0

    def _judge_names(self) -> None:
        """Sets parts with a name apart, unless they hold the article or most of the text, or read like text themselves.

        Without article and main, a part that holds over half of the text is the page's own, but not a discussion.
        """
        dense, chars, links, body = densities(self)
        n = len(self.parent)
        mains, articles = ([int(x == kind and not a) for x, a in zip(self.name, self.apart, strict=True)] for kind in ("main", "article"))
        controls = [int(x in CONTROLS) for x in self.name]
        for held in (mains, articles, controls):
            for i in range(n - 1, 0, -1):
                held[self.parent[i]] += held[i]
        for i in range(1, n):
            m = self.mark[i]
            if NO < m < ALWAYS and not self.apart[self.parent[i]]:
                if mains[0]:
                    holds = mains[i] > 0
                elif articles[0]:
                    holds = articles[i] == articles[0]
                else:
                    holds = m != TALKED and 2 * chars[i] > chars[0]
                thick = dense[i] >= dense[body]
                reads = m in (MAYBE, LIKELY) and 2 * links[i] < chars[i] and (thick or (m == MAYBE and self.inside[self.parent[i]] and not controls[i]))
                self.apart[i] = not (holds or reads)
            self.apart[i] = self.apart[i] or self.apart[self.parent[i]]

    def _end(self, name: str) -> None:
        if self.open.get(name):
            while self.name[self.stack[-1]] != name:
                self._pop()
            self._pop()


def densities(tree: Tree) -> tuple[list[float], list[int], list[int], int]:
    """Composite density, characters and link characters of each node, and the body; parts that are apart count as no text."""
    n = len(tree.parent)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for node, text in tree.texts:
        if text and not tree.apart[node]:
            chars[node] += len("".join(text.split()))
    for node in range(n - 1, 0, -1):
        up = tree.parent[node]
        if tree.name[node] == "a":
            link_chars[node] = chars[node]
        chars[up] += chars[node]
        link_chars[up] += link_chars[node]
        tags[up] += tags[node] + 1
        link_tags[up] += link_tags[node] + (tree.name[node] == "a")
    body = next((i for i in range(n) if tree.name[i] == "body"), 0)
    body_chars, body_links = chars[body], link_chars[body]

    def density(i: int) -> float:
        c, t, lc, lt = chars[i], tags[i] or 1, link_chars[i], link_tags[i]
        if not c:
            return 0.0
        base = math.log(c / ((c - lc) or 1) * lc + (body_links / body_chars if body_chars else 0) * c + math.e)
        return c / t * math.log(max(c / (lc or 1) * t / (lt or 1), 1.0)) / base

    return [density(i) for i in range(n)], chars, link_chars, body


def article_nodes(tree: Tree) -> tuple[list[int], set[int]]:
    """The roots of the article's subtrees, and the nodes of which only the text straight inside belongs to it.

    The core and its climb give the first. On the way from it to the body, or to the main element around it, other
    articles come along; without article and main around it, so do parts that are not mostly links and are as dense as
    the body, or hold paragraphs, or are headings, or stand in a line of text.
    """
    n = len(tree.parent)
    dense, chars, links, body = densities(tree)
    total = [0.0] * n
    for node in range(1, n):
        if not tree.apart[node]:
            total[tree.parent[node]] += dense[node]
    inner = [i for i in range(n) if not tree.apart[i] and (i == body or tree.name[i] not in ("#page", "html"))]
    best = max(inner, key=lambda i: (total[i], -i), default=body)
    while best != body and tree.parent[best] not in (body, 0, -1) and dense[tree.parent[best]] >= dense[body]:
        best = tree.parent[best]
    way = {best}
    while best != body and tree.name[best] != "main" and tree.parent[best] >= 0:
        best = tree.parent[best]
        way.add(best)
    free = not any(tree.name[i] in ("article", "main") and not tree.apart[i] for i in range(n))
    articles = [int(x == "article" and not a) for x, a in zip(tree.name, tree.apart, strict=True)]
    prose = [int(x in PROSE and c > 0 and not a) for x, c, a in zip(tree.name, chars, tree.apart, strict=True)]
    for held in (articles, prose):
        for i in range(n - 1, 0, -1):
            held[tree.parent[i]] += held[i]
    core = max(way)
    roots = [core]
    for i in range(min(way) + 1, n):
        if tree.parent[i] in way and tree.parent[i] != core and i not in way and not tree.apart[i] and chars[i]:
            if (articles[i] > 0) if not free else 2 * links[i] < chars[i] and (dense[i] >= dense[body] or prose[i] > 0 or tree.name[i] not in BLOCK):
                roots.append(i)
    return roots, way if free else set()


def main_text(page: str) -> str:
    """The whole text of the page's article, empty if there is none."""
    tree = Tree(page)
    below = [False] * len(tree.parent)
    roots, loose = article_nodes(tree)
    for root in roots:
        below[root] = True
    for node in range(1, len(tree.parent)):
        below[node] = below[node] or below[tree.parent[node]]
    # the breaks around a block are its parent's
    parts = [" " if text is None else text for node, text in tree.texts if text is None or (below[node] or node in loose) and not tree.apart[node]]
    return " ".join("".join(parts).split())


def extract(pages: DataFrame) -> DataFrame:
    """The rows of ``pages`` without html, with text and n_chars (code points) of the article."""
    require(pages, "html")

    def start():
        def work(batch: dict[str, list]) -> dict[str, list]:
            texts = [main_text(h.decode("utf-8")) if h else "" for h in batch["html"]]
            return {"text": texts, "n_chars": list(map(len, texts))}

        return work

    return extend_rows(pages.withColumn("html", F.col("html").cast("string")), ["html"], "text string, n_chars long", start, ("html",))
