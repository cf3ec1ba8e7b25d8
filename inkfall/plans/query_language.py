"""The search language: words, "phrases", AND OR NOT in any case, parentheses and field:value.

A query is read in two steps. The outer language takes out the filters and drops unknown fields; what is left
is cleaned and read by the inner, stricter grammar into a tree. A query that the inner grammar refuses has no
hits; it never raises.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from inkfall.plans.analysis import tokens_of

INDEX_FIELDS = ("filename", "content")
#: Fixed value: what is taken out before the inner grammar reads the text.
REMOVED = "?*^$!@#%&=+[]{}|\\/<>`~"


@dataclass(frozen=True)
class Leaf:
    """A word or phrase: its tokens stand in a row, in one column if that is given."""

    tokens: tuple[str, ...]
    column: str | None = None


@dataclass(frozen=True)
class Near:
    leaves: tuple[Leaf, ...]
    distance: int = 10


@dataclass(frozen=True)
class Op:
    kind: str  # AND, OR, NOT
    left: object
    right: object


@dataclass
class Query:
    text: str = ""
    tree: object | None = None
    valid: bool = True
    file_type: str | None = None
    author: str | None = None
    after: str | None = None
    before: str | None = None
    year: int | None = None
    terms: list[str] = field(default_factory=list)

    @property
    def searchable(self) -> bool:
        """Dates alone ask for nothing."""
        return bool(self.text or self.file_type or self.author)


def iso_date(value: str) -> str | None:
    if re.fullmatch(r"\d{4}", value):
        return f"{value}-01-01"
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
        return value
    try:
        from dateutil.parser import parse

        return parse(value).date().isoformat()
    except (ValueError, OverflowError, ImportError):
        return None


def outer_tokens(query: str) -> list[tuple[str, str]]:
    """(kind, text) by one pattern; an open quote reaches to the end."""
    out = []
    for m in re.finditer(r'"([^"]*)"?|([()])|([^\s()"]+)', query):
        if m[3] is None:
            out.append(("phrase", m[1]) if m[2] is None else (m[2], m[2]))
        elif m[3].upper() in ("AND", "OR", "NOT"):
            out.append(("op", m[3].upper()))
        else:
            out.append(("word", m[3]))
    return out


def read(query: str, stem: bool = False) -> Query:
    q = Query(terms=highlight_terms(query))
    parts = []
    for kind, text in outer_tokens(query):
        named = re.fullmatch(r"([a-zA-Z_]+):(.+)", text) if kind == "word" else None
        if not named:
            parts.append(f'"{text}"' if kind == "phrase" else text)
            continue
        name, value = named[1].lower(), named[2]
        if name in INDEX_FIELDS:
            parts.append(f"{name}:{value}")
        elif name == "type":
            q.file_type = value.lower().lstrip(".")
        elif name == "author":
            q.author = value
        elif name in ("after", "before"):
            setattr(q, name, iso_date(value))
        elif name == "year" and re.fullmatch(r"[+-]?\d+", value):
            q.year = int(value)
    q.text = " ".join(" ".join(parts).translate({ord(c): " " for c in REMOVED}).split())
    if q.text:
        q.tree = _Inner(q.text, stem).tree()
        q.valid = q.tree is not None
    return q


class _Refused(Exception):
    pass


class _Inner:
    """NOT binds before AND, AND before OR; words side by side are joined by AND, but only words and phrases."""

    def __init__(self, text: str, stem: bool):
        self.stem, self.at = stem, 0
        self.bad = False
        self.items = []
        for m in re.finditer(r'"([^"]*)("?)|([\w\u0080-\U0010ffff]+)|([():,])|(\S)', text):
            if m[5] is not None or (m[1] is not None and not m[2]):
                self.bad = True
            elif m[1] is not None:
                self.items.append(("phrase", m[1]))
            elif m[3] is not None:
                self.items.append(("op", m[3]) if m[3] in ("AND", "OR", "NOT") else ("word", m[3]))
            else:
                self.items.append((m[4], m[4]))

    def tree(self):
        try:
            out = None if self.bad else self._level(0)
            return out if self.at == len(self.items) else None
        except (_Refused, RecursionError):
            return None

    def _peek(self, ahead: int = 0):
        i = self.at + ahead
        return self.items[i] if i < len(self.items) else ("end", "")

    def _take(self, kind: str):
        got = self._peek()
        if got[0] != kind:
            raise _Refused
        self.at += 1
        return got[1]

    def _level(self, level: int):
        if level == 3:
            return self._group()
        out = self._level(level + 1)
        name = ("OR", "AND", "NOT")[level]
        while self._peek() == ("op", name):
            self.at += 1
            out = Op(name, out, self._level(level + 1))
        return out

    def _group(self):
        if self._peek()[0] == "(":
            self.at += 1
            out = self._level(0)
            self._take(")")
            return out
        out = self._leaf()
        while self._peek()[0] in ("word", "phrase"):
            out = Op("AND", out, self._leaf())
        if self._peek()[0] == "(":
            raise _Refused
        return out

    def _leaf(self):
        column = None
        if self._peek()[0] in ("word", "phrase") and self._peek(1)[0] == ":":
            column = self._take(self._peek()[0]).lower()
            self._take(":")
            if column not in INDEX_FIELDS:
                raise _Refused
            if self._peek()[0] == "(":
                self.at += 1
                inner = self._level(0)
                self._take(")")
                return _in_column(inner, column)
        if self._peek() == ("word", "NEAR") and self._peek(1)[0] == "(":
            return self._near(column)
        kind, text = self._peek()
        if kind not in ("word", "phrase"):
            raise _Refused
        self.at += 1
        return Leaf(tuple(tokens_of(text, self.stem)), column)

    def _near(self, column):
        self.at += 2
        leaves, distance = [], 10
        while self._peek()[0] in ("word", "phrase"):
            leaves.append(Leaf(tuple(tokens_of(self._take(self._peek()[0]), self.stem)), column))
        if self._peek()[0] == ",":
            self.at += 1
            number = self._take("word")
            if not number.isdigit():
                raise _Refused
            distance = int(number)
        self._take(")")
        if not leaves:
            raise _Refused
        return Near(tuple(leaves), distance)


def _in_column(tree, column: str):
    if isinstance(tree, Op):
        return Op(tree.kind, _in_column(tree.left, column), _in_column(tree.right, column))
    if isinstance(tree, Near):
        return Near(tuple(_in_column(x, column) for x in tree.leaves), tree.distance)
    return Leaf(tree.tokens, tree.column or column)


def leaves_of(tree) -> list:
    if tree is None:
        return []
    return leaves_of(tree.left) + leaves_of(tree.right) if isinstance(tree, Op) else [tree]


def highlight_terms(query: str) -> list[str]:
    """What a result marks: phrases first, then words; of fields only the value of filename and content."""
    out = [m for m in re.findall(r'"([^"]+)"', query)]
    for w in re.sub(r'"[^"]+"', "", query).split():
        name, colon, value = w.partition(":")
        if w.lower() in ("and", "or", "not"):
            continue
        if not colon:
            out.append(w)
        elif name.lower() in INDEX_FIELDS:
            out.append(value)
    return out
