"""HTML extraction by consensus host paths.

A page votes for the least container that holds all its text outside furniture, by that container's path of
generalised tag.class steps; the votes are counted per host in Spark; every page is then extracted again by
its host's winning path, widened wherever the page has further text outside it. So nothing but furniture and
lists of links outside the container is dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfall.llm.common import pick, ship, table, written
from inkfall.llm.url_filter import url_host

#: Between the steps of a path; it stands in no class.
SEP = "\x1f"
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_TAG = re.compile(_NAME.pattern + r"((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_ID = re.compile(r"""\bid\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_ROLE = re.compile(r"""\brole\s*=\s*["']?(navigation|banner|contentinfo|complementary|search|form|dialog|alert)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none""", re.I)
#: Their content is text up to the closing tag, and never part of the page's.
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "iframe"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: Furniture by its tag, and by words of its class or id.
APART = frozenset(("nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "head"))
APART_WORDS = frozenset(
    ("ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "footer", "sidebar", "aside", "widget",
     "related", "share", "social", "cookie", "cookies", "consent", "notice", "notices", "popup", "modal", "newsletter", "subscribe", "signup", "login", "comment", "comments", "reply", "replies", "disqus", "respond", "pagination", "pager", "copyright", "legal")
)
#: What also names wrappers of whole pages; and what may stand beside a word of furniture in one name without changing it.
WRAPPERS = frozenset(("header", "nav", "navbar", "navigation", "menu", "sidebar", "widget", "legal"))
BESIDE = frozenset(
    ("", "site", "top", "bottom", "left", "right", "inner", "outer", "wrap", "wrapper", "container", "box", "bar", "slot", "area", "list", "links", "link", "item", "items", "primary", "secondary", "global", "sticky", "fixed", "mobile", "desktop", "block", "unit", "buttons", "button",
     "icon", "icons", "form", "panel", "row", "col", "column", "group", "toggle", "overlay", "message", "posts", "user", "js", "thread", "widgets", "media", "info", "trail", "logo", "lower", "upper", "mega", "sub", "side", "tabs", "this", "dropdown")
)
#: The same beside any word but header: a page's or post's header holds its title.
BESIDE_OTHERS = frozenset(("page", "post", "main", "section", "content", "text", "body", "title"))
_IN_NAMES = APART_WORDS | BESIDE
_IN_OTHER_NAMES = _IN_NAMES | BESIDE_OTHERS
#: How surely an element is furniture: by a name that a wrapper may have, by another name, by its tag.
LOOSE, NAMED, SURE = 1, 2, 3
#: Tags that end a line of text.
BLOCKS = frozenset(
    ("html", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "li", "main", "menu", "nav",
     "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption")
)
#: A new one of these closes an open one of the same group that no container stands between.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}}
_TEXTUAL = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dd", "td", "b", "i", "em", "strong", "span", "a", "u", "small", "font", "code", "sub", "sup", "mark"))

#: Text even where it is a link.
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Parts of a text, which are no containers of their own.
_PARTS = _TEXTUAL | {"ul", "ol", "dl", "dt", "table", "caption", "thead", "tbody", "tfoot", "tr", "th", "figure", "details", "summary", "address", "hgroup", "center"}


def _value(m) -> str:
    return next((g for g in m.groups() if g), "") if m else ""


def named_apart(names: str) -> int:
    """Whether one of the names, whole, means furniture: each part of it does, or may stand beside one that does."""
    apart = 0
    for name in names.split():
        parts = set(re.split(r"[^a-z]+", name))
        words = parts & APART_WORDS
        if words and parts <= (_IN_NAMES if "header" in words else _IN_OTHER_NAMES):
            apart = max(apart, LOOSE if words <= WRAPPERS else NAMED)
    return apart


def step_of(tag: str, attrs: str, inner: bool = False) -> tuple[str, int]:
    """A path's step, tag.class with digits generalised, and how surely the element is furniture (0: it is not).

    The header of an article or main holds its title, and is none.
    """
    apart = (LOOSE if tag == "form" else SURE) if tag in APART and not (inner and tag == "header") else 0
    if not attrs or attrs.isspace():
        return tag, apart
    named = _value(_CLASS.search(attrs)).lower()
    if apart < SURE and tag not in ("html", "body", "article", "main"):
        apart = max(apart, named_apart(f"{named} {_value(_ID.search(attrs)).lower()}"))
    if apart < NAMED and (_ROLE.search(attrs) or (tag not in ("html", "body") and _HIDDEN.search(attrs))):
        apart = NAMED
    classes = ".".join(sorted({re.sub(r"\d+", "#", c) for c in named.split()}))
    return (f"{tag}.{classes}" if classes else tag), apart


def worth(text: str, linked: int) -> float:
    """How much a line counts as text: its characters outside links, half of them where it is short."""
    return max(0, len(text) - 2 * linked) * (1.0 if len(text) >= 25 else 0.5)


class _Path:
    """A container's path of steps. Equal paths of a page are one object; `jump` is some path above, for few hops to any depth."""

    __slots__ = ("step", "up", "depth", "jump", "below")

    def __init__(self, step: str = "", up: _Path | None = None):
        self.step, self.up, self.below = step, up or self, {}
        self.depth = up.depth + 1 if up else 0
        if up is None:
            self.jump = self
        else:
            self.jump = up.jump.jump if up.depth - up.jump.depth == up.jump.depth - up.jump.jump.depth else up

    def child(self, step: str) -> _Path:
        found = self.below.get(step)
        if found is None:
            found = self.below[step] = _Path(step, self)
        return found

    def cut(self, depth: int) -> _Path:
        """The path above, or itself, of at most a depth."""
        at = self
        while at.depth > depth:
            at = at.jump if at.jump.depth >= depth else at.up
        return at

    def within(self, other: _Path) -> bool:
        return self.cut(other.depth) is other

    def common(self, other: _Path) -> _Path:
        a, b = self.cut(other.depth), other.cut(self.depth)
        while a is not b:
            a, b = (a.up, b.up) if a.jump is b.jump else (a.jump, b.jump)
        return a

    def steps(self) -> tuple:
        out, at = [], self
        while at.depth:
            out.append(at.step)
            at = at.up
        return tuple(reversed(out))


class _Apart:
    """Furniture, nested in other furniture or none: how surely it is, what it holds, and the worth of its lines."""

    __slots__ = ("up", "grade", "depth", "main", "first", "own", "most", "opened", "above", "free")

    def __init__(self, up: _Apart | None = None, grade: int = 0):
        self.up, self.grade, self.depth = up, grade, up.depth + 1 if up else 0
        self.main = self.first = self.free = False
        self.own = self.most = self.opened = self.above = 0.0


def release(page: _Apart, furniture: list[_Apart]) -> None:
    """Frees elements that their names call furniture, but that hold the page itself; furniture is in the order of the page.

    They hold a main; or more of the page's text than stands outside them, furniture inside or outside not
    counted, and either have a name that wrappers have or hold a first heading. Inner elements come first.
    """
    page.free, page.opened, page.above = True, page.own, page.own
    for x in furniture:
        x.opened, x.most, x.above = x.own, x.most + x.own, x.up.above + x.own
    for x in reversed(furniture):
        x.up.most += x.most
        x.up.main, x.up.first = x.up.main or x.main, x.up.first or x.first
    for _, x in sorted(enumerate(furniture), key=lambda e: (-e[1].depth, -e[1].most, e[0])):
        if not (x.main or x.most > page.opened and (x.grade == LOOSE or x.first)):
            continue
        # what stands outside: the furniture that it stands in counts as open, further out as far as no furniture comes between
        outside = x.up.opened + (x.up.up.above if x.up.up else 0.0)
        if x.main or x.opened > outside:
            x.free = True
            x.up.opened += x.opened
    for x in furniture:
        x.free = x.free and x.up.free


class _Tokens:
    """The tags of a page in order; reading all of them takes time in proportion to its length, whatever it holds."""

    def __init__(self, html: str):
        self.html, self.last, self.last_data, self.ends = html, html.rfind(">"), html.rfind("]]>"), None

    def after(self, at: int):
        """(start, end, closing, name, attributes) of the next tag; its name is None in comments and the like. None at the end."""
        html = self.html
        while (at := html.find("<", at)) >= 0:
            mark = html[at + 1 : at + 2]
            if mark in ("!", "?"):
                if html.startswith("<!--", at):
                    end = html.find("-->", at + 4)
                    return at, end + 3 if end >= 0 else len(html), "", None, ""
                if html.startswith("<![CDATA[", at) and at < self.last_data:
                    return at, html.find("]]>", at) + 3, "", None, ""
                if at < self.last:
                    return at, html.find(">", at) + 1, "", None, ""
            elif mark == "/" or mark.isalpha():
                if at > self.last:
                    return None
                m = _TAG.match(html, at) if self.ends is None else None
                if m:
                    return at, m.end(), m[1], m[2].lower(), m[3]
                m = _NAME.match(html, at)
                if m:
                    end = self._end(m.end())
                    return at, end + 1, m[1], m[2].lower(), html[m.end() : end]
            at += 1
        return None

    def _end(self, at: int) -> int:
        """The > that ends a tag: one in no quotes, or where quotes stay open the next one of all.

        From the first such tag on, all ends are looked up in a table that is made in one pass.
        """
        if self.ends is None:
            self.places = [m.start() for m in re.finditer("[>\"']", self.html)]
            self.ends, follows, bracket = [0] * len(self.places), {}, 0
            for i in range(len(self.places) - 1, -1, -1):
                mark = self.html[self.places[i]]
                if mark == ">":
                    bracket = self.ends[i] = self.places[i]
                else:
                    closing = follows.get(mark, -1)
                    self.ends[i] = self.ends[closing + 1] if 0 <= closing < len(self.places) - 1 else 0
                    self.ends[i] = self.ends[i] or bracket
                    follows[mark] = i
        return self.ends[bisect_left(self.places, at)]


def blocks_of(html: str):
    """The page's lines in order: (path of the nearest container, text, part of it inside links)."""
    out: list[tuple[_Path, str, int, _Apart]] = []
    top, page = _Path(), _Apart()
    stack: list[tuple[str, _Path, _Apart]] = []
    furniture: list[_Apart] = []
    where: dict[str, list[int]] = {}  # the places of a tag in the stack
    blocks: list[int] = []  # the places of blocks in the stack
    pieces: list[str] = []
    linked = headings = 0

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                _, path, apart = stack[-1] if stack else ("", top, page)
                out.append((path, text, linked, apart))
                apart.own += worth(text, linked)
            pieces.clear()
        linked = 0

    def cut(to: int):
        nonlocal headings
        while len(stack) > to:
            tag = stack.pop()[0]
            where[tag].pop()
            if tag in BLOCKS:
                blocks.pop()
            if tag in _HEADINGS:
                headings -= 1

    tokens, at, n = _Tokens(html), 0, len(html)
    while at < n:
        token = tokens.after(at)
        stop = token[0] if token else n
        if stop > at and not (stack and stack[-1][2].grade == SURE):
            pieces.append(html[at:stop])
            if where.get("a") and not headings:
                linked += stop - at
        if not token:
            break
        _, at, closing, tag, attrs = token
        if tag is None:
            continue
        if closing:
            if not where.get(tag):
                continue
            i = where[tag][-1]
            if tag in BLOCKS or any(x[0] in BLOCKS and x[2] is not stack[i][2] for x in stack[i:]):
                flush()
            cut(i)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                pieces.append(" ")
            continue
        if tag in RAW:
            if not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else n
            continue
        if tag in ("text", "desc"):  # labels in an svg
            pieces.append(" ")
        if tag in BLOCKS:
            flush()
            # a line's own tags end where another begins: paragraphs are closed by any block
            while stack and stack[-1][0] in _TEXTUAL and stack[-1][0] not in ("li", "dd", "td", "blockquote"):
                cut(len(stack) - 1)
            if tag == "p":
                if blocks and stack[blocks[-1]][0] == "p":
                    cut(blocks[-1])
            elif tag in _CLOSES:
                last = lambda tags: max((where[x][-1] for x in tags if where.get(x)), default=-1)
                if last(_CLOSES[tag]) > last(_HOLDS[tag]):
                    cut(last(_CLOSES[tag]))
        if attrs.endswith("/") and tag not in BLOCKS:
            continue
        step, grade = step_of(tag, attrs, bool(where.get("article") or where.get("main")))
        path, apart = stack[-1][1:] if stack else (top, page)
        if apart.grade == SURE:
            # a main stands in no furniture, but may follow some that was never closed
            apart, grade = page if tag == "main" else apart, 0
        elif tag == "main":
            apart.main = True
        elif tag == "h1":
            apart.first = True
        if grade:
            # a part of a line wraps no page
            apart = _Apart(apart, grade if tag in BLOCKS else SURE)
            furniture.append(apart)
        where.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            blocks.append(len(stack))
        headings += tag in _HEADINGS
        stack.append((tag, path if tag in _PARTS else path.child(step), apart))
    flush()
    release(page, furniture)
    return [line[:3] for line in out if line[3].free]


def widened(blocks, path: _Path | None) -> _Path | None:
    """A path cut to the container that also holds every line of text, at whatever depth; lines of links alone widen nothing."""
    for other, text, linked in blocks:
        if worth(text, linked):
            path = other if path is None else path.common(other)
    return path


def best_path(blocks) -> tuple:
    """The path of the least container that holds all the page's text outside furniture."""
    found = widened(blocks, None)
    return found.steps() if found else ()


def main_text(blocks, path: tuple) -> str:
    """The lines in the container of a path, widened to all the page's text, and below, joined; of the page's own if it has none."""
    own = blocks[0][0].cut(0) if blocks else None
    for step in path:
        own = own and own.below.get(step)
    own = widened(blocks, own if own and any(b[0].within(own) for b in blocks) else None)
    inside = [b for b in blocks if own is None or b[0].within(own)]
    return "\n".join(b[1] for b in inside or blocks)


def _voted(batches):
    for batch in batches:
        host, path, score = [], [], []
        for h, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            blocks = blocks_of(html.as_py() or "")
            best = best_path(blocks)
            if best:
                host.append(h), path.append(SEP.join(best)), score.append(sum(worth(b[1], b[2]) for b in blocks))
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(score, pa.float64())], names=["host", "path", "score"])


def _extracted(batches):
    for batch in batches:
        texts = []
        for html, path in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            blocks = blocks_of(html.as_py() or "")
            texts.append(main_text(blocks, tuple(path.split(SEP))) if path else main_text(blocks, best_path(blocks)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: each host's winner by votes, then by the sum of scores, then by the path itself."""
    ship(pages.sparkSession)
    rows = pick(pages, "url", "html").select(url_host(F.col("url")).alias("host"), "html")
    votes = rows.mapInArrow(_voted, "host string, path string, score double")
    votes = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum(F.round("score").cast("decimal(38,0)")).alias("score"))
    return votes.groupBy("host").agg(F.max(F.struct("votes", "score", "path"))["path"].alias("path"))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty pages have an empty text, and so have pages whose every line is furniture. Pages with a
    null or malformed url count as one host. Repeated rows get a row each; an empty table an empty result.
    The winners are written first, so that the join knows their size and picks its strategy by it.
    """
    winners = written(host_paths(pages), "paths")
    rows = pick(pages, "page_id", "url", "html")
    kind = dict(rows.dtypes)["page_id"]
    rows = rows.withColumn("host", url_host(F.col("url"))).join(winners.select(F.col("host").alias("h"), "path"), F.col("host") == F.col("h"), "left")
    got = rows.select("page_id", "html", "path", "url").mapInArrow(_extracted, f"page_id {kind}, url string, text string")
    return got.withColumn("n_chars", F.length("text").cast("long"))


def op7_html_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op7_html_text": op7_html_text}
ORACLES: dict[str, str] = {}
