"""Queries without SQL against straightforward computations over whole tables."""

import collections
import itertools
import re
import unicodedata
from html import unescape

import pytest

from inkfall.functions import pii as P
from inkfall.functions import text as T
from inkfall.operators import search as S
from inkfall.queries import QUERIES, documents


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


def rows(spark, small, name):
    return QUERIES[name](spark, small).collect()


def cleaned(text):
    x = unicodedata.normalize("NFC", text)
    x = "".join(T.SCAN_FIXES.get(c, c) for c in x)
    x = re.sub(r"(\w+)-\n(\w+)", r"\1\2", x)
    x = re.sub(r"([a-z]{2,})\n([a-z]{2,})", lambda m: m[1] + m[2] if 4 <= len(m[1]) + len(m[2]) <= 20 else m[0], x)
    x = re.sub("[ \t]+", " ", x).replace("\r\n", "\n").replace("\r", "\n")
    x = re.sub(r"\n{3,}", "\n\n", re.sub(r" +\n", "\n", x))
    keep = [line for line in x.split("\n") if not (0 < len(line.strip()) < 3 or any(re.match(p, line.strip(), re.I) for p in T.BOILERPLATE))]
    return "\n".join(keep).strip()


def test_clean_text(spark, small, texts):
    assert {r.doc_id: r.text for r in rows(spark, small, "clean_text")} == {i: cleaned(x) for i, x in texts.items()}


def test_clean_sentences(spark, small, texts):
    got = collections.defaultdict(dict)
    for r in rows(spark, small, "clean_sentences"):
        got[r.doc_id][r.n] = r.sentence
    for i, x in texts.items():
        want = [s.strip() for s in re.split(r"(?<=[.!?])\s+", cleaned(x)) if len(s.strip()) >= 10]
        assert [s for _, s in sorted(got[i].items())] == want


def test_html_text(spark, small, duck):
    for page_id, html in duck.sql("SELECT page_id, html FROM pages").fetchall():
        bare = re.sub(r"<!--.*?-->|<(script|style)>.*?</\1>", "\x00", html, flags=re.S)
        parts = [unescape(x).strip() for x in re.split(r"<[^>]*>|\x00", bare)]
        texts = {r.page_id: r for r in rows(spark, small, "html_text")} if page_id == 0 else texts  # noqa: F821
        assert texts[page_id].text == "\n".join(x for x in parts if x) and texts[page_id].title == unescape(re.search("<title>(.*?)</title>", html)[1]).strip()


def test_text_tables(spark, small, texts):
    want = collections.Counter()
    for i, x in texts.items():
        for d in "\t|;,":
            runs = [list(g) for n, g in itertools.groupby((line.split(d) for line in x.split("\n")), key=len) if n >= 2]
            for run in runs:
                if len(run) >= 3:
                    want[i] += len(run) - 1
    got = collections.Counter()
    for r in rows(spark, small, "text_tables"):
        if r.source == "delimiter":
            got[r.doc_id] += r.n_rows
    assert got == want


def test_form_fields(spark, small, texts):
    from inkfall.functions.layout import BOXES, PAIRS

    want = collections.Counter()
    for i, x in texts.items():
        for n, line in enumerate(x.split("\n")):
            line = line.strip(" ")
            pair = next((m for m in (re.match(p, line, re.I) for p, _ in PAIRS) if m), None)
            if line and pair and 2 <= len(pair[1].strip(" ")) <= 50:
                want[i, n, "text", pair[1].strip(" "), pair[2].strip(" ")] += 1
            box = next(((m, on) for m, on in ((re.match(p, line), on) for p, on in BOXES) if m), None)
            if line and box and box[0][1].strip(" "):
                want[i, n, "checkbox", box[0][1].strip(" "), str(box[1]).lower()] += 1
    assert collections.Counter((r.doc_id, r.line_no, r.field_type, r.label, r.value) for r in rows(spark, small, "form_fields")) == want


def check_digit(digits):
    doubled = [sum(map(int, str(int(d) * (1 + i % 2)))) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def test_valid_cards(spark, small, texts):
    found = [(i, re.sub(r"\D", "", m[0])) for i, x in texts.items() for p in P.PATTERNS["credit_card"] for m in re.finditer(p, x, re.A)]
    assert collections.Counter(tuple(r) for r in rows(spark, small, "pii_valid_cards")) == collections.Counter(x for x in found if check_digit(x[1]))


def all_spans(text):
    """(start, end): kind of the matches that count, by trying all shapes at all places."""
    out = {}
    for kind, shapes in P.PATTERNS.items():
        for m in itertools.chain(*(re.finditer(p, text) for p in shapes)):
            around = text[max(0, m.start() - 50) : m.end() + 50].lower()
            digits = re.sub(r"\D", "", m[0])
            birth, number = any(w in around for w in P.NEAR_BIRTH), any(w in around for w in P.NEAR_SSN)
            if kind == "date_of_birth" and not birth:
                continue
            if kind == "ssn" and (digits[0] == "9" or digits[:3] in ("000", "666") or m[0].isdigit()) and not (m[0].isdigit() and number and digits[0] != "9" and digits[:3] not in ("000", "666")):
                continue
            out.setdefault(m.span(), kind)
    return out


def test_spans_summary_and_redaction(spark, small, texts):
    want = {i: all_spans(x) for i, x in texts.items()}
    got = collections.defaultdict(dict)
    for r in rows(spark, small, "pii_spans"):
        got[r.doc_id][r.start, r.end] = r.kind
        assert texts[r.doc_id][r.start : r.end] == r.value
    assert got == {i: x for i, x in want.items() if x}
    assert {(r.doc_id, r.kind): r.n for r in rows(spark, small, "pii_summary")} == {(i, k): n for i, x in want.items() for k, n in collections.Counter(x.values()).items()}
    for r in rows(spark, small, "pii_redacted"):
        hidden, text = {p for a, b in want[r.doc_id] for p in range(a, b)}, texts[r.doc_id]
        if not any(a < d and c < b for (a, b), (c, d) in itertools.combinations(want[r.doc_id], 2)):
            marks = [text[p] if p not in hidden else "[REDACTED]" * any(p == a for a, _ in want[r.doc_id]) for p in range(len(text))]
            assert r.text == "".join(marks)


def test_snippets_page(spark, small, duck):
    from inkfall.queries import search_sql

    hits = duck.sql(search_sql("hein OR ering", "ORDER BY score DESC, id LIMIT 20", "id, content")).fetchall()
    got = {r.id: r.snippets for r in rows(spark, small, "snippets_page")}
    assert got.keys() == {i for i, _ in hits}
    for i, text in hits:
        found = [m.span() for m in re.finditer(r"\b(?:hein|ering)\b", text, re.I)]
        parts = got[i].split("<mark>")
        assert got[i].replace("<mark>", "").replace("</mark>", "").replace("...", "").split("\n")[0][:40] in text.replace("...", "") and len(parts) > 1
        apart, free = 0, 0
        for a, b in found:
            if a >= free and apart < 3:
                apart, free = apart + 1, b + 150
        snippets = S.snippets(text, ["hein", "ering"])
        assert got[i] == "\n".join(snippets) and len(snippets) == apart
