"""Text functions as column expressions; Unicode normalisation is the one that needs Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfall.functions.lazy import pandas_function

# Characters that scanning and typesetting leave behind, and what they stand for.
SCAN_FIXES = {
    "ﬁ": "fi",
    "ﬂ": "fl",
    "ﬀ": "ff",
    "ﬃ": "ffi",
    "ﬄ": "ffl",
    "—": "-",
    "–": "-",
    "…": "...",
    "\u00ad": "",
    "\u00a0": " ",
    "\u2003": " ",
    "\u2002": " ",
    "\u200b": "",
}
# Lines that carry no content, matched without regard to case.
BOILERPLATE = (
    r"^Page\s+\d+\s*(of\s+\d+)?$",
    r"^\d+\s*$",
    r"^-\s*\d+\s*-$",
    r"^©.*\d{4}.*$",
    r"^All\s+[Rr]ights\s+[Rr]eserved\.?$",
    r"^CONFIDENTIAL.*$",
    r"^DRAFT.*$",
    r"^www\.[a-zA-Z0-9.-]+\.[a-z]+$",
    r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}$",
)
MIN_LINE = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c) -> Column:
    return F.translate(col(c), _UPPER, _LOWER)


def like_ignoring_ascii_case(c, part: str) -> Column:
    """Whether the value holds the part; % and _ in it stay wildcards, and only A-Z fold."""
    return ascii_lower(c).like(f"%{part.translate(str.maketrans(_UPPER, _LOWER))}%")


@pandas_function("string")
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@pandas_function("string")
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normalize_unicode(c, form: str = "NFC") -> Column:
    return {"NFC": _nfc, "NFKC": _nfkc}[form](col(c))


def fix_scan_characters(c) -> Column:
    """Single characters by one translation, the ones that grow by a replacement each."""
    out = col(c)
    for old, new in SCAN_FIXES.items():
        if len(new) > 1:
            out = F.replace(out, F.lit(old), F.lit(new))
    same = {o: n for o, n in SCAN_FIXES.items() if len(n) == 1}
    gone = [o for o, n in SCAN_FIXES.items() if not n]
    return F.translate(out, "".join([*same, *gone]), "".join(same.values()))


def join_hyphenated(c) -> Column:
    """A word cut by a hyphen at a line's end becomes whole."""
    return F.regexp_replace(col(c), r"(?U)(\w+)-\n(\w+)", "$1$2")


def glue_lines(c) -> Column:
    """Lower-case runs on both sides of a line end are joined if they make 4 to 20 letters together.

    Longer pairs are taken over as they are, so that their second run starts no pair of its own.
    """
    short = "|".join(rf"[a-z]{{{n}}}\n[a-z]{{2,{20 - n}}}" for n in range(2, 19))
    return F.regexp_replace(col(c), rf"(?<![a-z])(?:(?=(?:{short})(?![a-z]))([a-z]+)\n([a-z]+)|([a-z]{{2,}}\n[a-z]{{2,}}))", "$1$2$3")


def normalize_whitespace(c) -> Column:
    out = F.regexp_replace(col(c), r"[ \t]+", " ")
    out = F.regexp_replace(out, "\r\n|\r", "\n")
    out = F.regexp_replace(out, r" +\n", "\n")
    return F.regexp_replace(out, r"\n{3,}", "\n\n")


def remove_boilerplate(c, min_line: int = MIN_LINE) -> Column:
    """Drops lines that match a pattern, and those of one or two characters; empty lines stay."""

    def keep(line):
        bare = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
        short = (F.length(bare) < min_line) & (F.length(bare) > 0)
        return ~short & ~bare.rlike("(?i)" + "|".join(f"(?:{p})" for p in BOILERPLATE))

    return F.array_join(F.filter(F.split(col(c), "\n"), keep), "\n")


def strip(c) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def clean_text(c) -> Column:
    """All steps in their order; null becomes the empty text."""
    out = normalize_unicode(F.coalesce(col(c), F.lit("")))
    return strip(remove_boilerplate(normalize_whitespace(glue_lines(join_hyphenated(fix_scan_characters(out))))))


def clean_sentences(c, least: int = 10) -> Column:
    marked = F.regexp_replace(clean_text(c), r"(?U)(?<=[.!?])\s+", "\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: strip(s)), lambda s: F.length(s) >= least)


def token_estimate(c) -> Column:
    return F.floor(F.length(col(c)) / 4).cast("long")


def chunk_estimate(c, chunk_chars: int = 2000, overlap: int = 200) -> Column:
    n = F.length(col(c))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(n / F.lit(float(chunk_chars - overlap))))).cast("long")


def content_hash(c) -> Column:
    return F.sha2(col(c), 256)


def chunk_hash(c) -> Column:
    """First 16 hex digits of the SHA-256 of the text with white space collapsed."""
    return F.substring(F.sha2(F.trim(F.regexp_replace(col(c), r"\s+", " ")), 256), 1, 16)


def head_snippet(c, chars: int = 150) -> Column:
    """The text itself if short; else its head up to the last space within, and dots."""
    text = col(c)
    head = F.substring(text, 1, chars)
    back = F.locate(" ", F.reverse(head))
    cut = F.when(back > 0, F.substring(head, F.lit(1), F.length(head) - back)).otherwise(head)
    return F.when(F.length(text) <= chars, text).otherwise(F.concat(cut, F.lit("...")))


def highlight(c, terms: list[str], tag: str = "mark") -> Column:
    """Every occurrence of each term in tags, whatever its case, one term after the other."""
    out = col(c)
    for t in terms:
        escaped = "".join("\\" + x if not (x.isalnum() or x.isspace()) else x for x in t)
        out = F.regexp_replace(out, f"(?i)({escaped})", f"<{tag}>$1</{tag}>")
    return out


def shortened(c, chars: int) -> Column:
    """Cut to so many characters, with dots where something is missing."""
    return F.when(F.length(col(c)) > chars, F.concat(F.substring(col(c), 1, chars), F.lit("..."))).otherwise(col(c))


def safe_id(c) -> Column:
    """An id of letters, digits and -_. only; a long one becomes a hash."""
    bare = F.regexp_replace(col(c), r"[^A-Za-z0-9._-]", "")
    return F.when(F.length(bare) > 64, F.substring(F.sha2(col(c), 256), 1, 32)).otherwise(bare)


def within_folder(path, folder: str) -> Column:
    """Whether a path is a folder or lies in it, by whole segments."""
    base = folder.rstrip("/")
    return (col(path) == base) | col(path).startswith(base + "/")


def strip_rtf(c) -> Column:
    """Text of an RTF document without its control words and braces."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), r"\\[a-z]+-?\d*\s?", ""), r"[{}]", ""))


def confidence_level(c) -> Column:
    return F.when(col(c) > 0.85, "high").when(col(c) > 0.60, "medium").otherwise("low")


def page_class(text_chars, image_ratio, least: int = 50) -> Column:
    """scanned, unknown, mixed or digital by the characters and the share of images on a page."""
    n, r = col(text_chars), col(image_ratio)
    return F.when(n < least, F.when(r > 0.3, "scanned").otherwise("unknown")).when((r > 0.5) & (n < 500), "scanned").when((r > 0.3) & (n > 100), "mixed").otherwise("digital")


def needs_ocr(chars, pages, has_large_image) -> Column:
    average = col(chars) / F.greatest(col(pages), F.lit(1))
    return (average < 50) | (col(has_large_image) & (average < 500))


def better_text(digital, scanned) -> Column:
    return F.when(F.length(col(scanned)) > 1.5 * F.length(col(digital)), col(scanned)).otherwise(col(digital))


def without_header_footer(c, lines: int = 3, least: int = 7) -> Column:
    """Drops the page numbers and very short lines among the first and last three of a page."""
    rows = F.split(col(c), "\n")
    n = F.size(rows)
    edge = lambda i: (i < lines) | (i >= n - lines)
    bare = lambda x: F.trim(x)
    drop = lambda x, i: edge(i) & (bare(x).rlike(r"(?i)^(page\s+)?\d+(\s+of\s+\d+)?$") | bare(x).rlike(r"^-\s*\d+\s*-$"))
    return F.when(n < least, col(c)).otherwise(F.array_join(F.filter(rows, lambda x, i: ~drop(x, i)), "\n"))


def key_points(c) -> Column:
    """The bulleted or numbered lines of an answer, without their marks."""
    lines = F.transform(F.split(col(c), "\n"), lambda x: F.trim(x))
    marked = F.filter(lines, lambda x: x.rlike(r"^([-*•]|\d+[.)])\s+"))
    return F.transform(marked, lambda x: F.regexp_replace(x, r"^([-*•]|\d+[.)])\s+", ""))


def row_summary(columns: list[str]) -> Column:
    """`name: value` of the columns that are not null, joined by semicolons."""
    return F.concat_ws("; ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns])


# Shapes of spreadsheet values, tried in this order.
CURRENCY, PERCENT = r"^[$€£¥]\s?-?[\d,]+(\.\d+)?$", r"^-?\d+(\.\d+)?\s?%$"
DATES = (r"^\d{1,2}/\d{1,2}/\d{2,4}$", r"^\d{4}-\d{2}-\d{2}$", r"^\d{1,2}-\d{1,2}-\d{2,4}$")
KINDS = ("number", "date", "currency", "percentage", "boolean", "text")


def value_kind(c) -> Column:
    """The kind of a string value; KINDS gives the order in which a column's most frequent one is chosen."""
    v = F.trim(col(c))
    return (
        F.when(v.rlike(CURRENCY), "currency")
        .when(v.rlike(PERCENT), "percentage")
        .when(v.rlike("|".join(DATES)), "date")
        .when(F.lower(v).isin("true", "false", "yes", "no"), "boolean")
        .when(F.replace(v, F.lit(","), F.lit("")).rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), "number")
        .otherwise("text")
    )


# How names of columns begin, one of which must fit: a capitalised word, capitals alone, two words.
NAMES = (r"[A-Z][a-z]+", r"[A-Z_]+$", r"\w+\s\w+")


def looks_like_name(c) -> Column:
    """Whether a cell can be a column's name: short, with a letter, of digits for half at most, and of a name's shape."""
    v = col(c)
    digits = F.length(F.regexp_replace(v, r"\P{Nd}", ""))
    return F.coalesce(F.length(v).between(1, 50) & v.rlike(r"\p{L}") & (digits * 2 <= F.length(v)) & v.rlike(f"(?U)^(?:{'|'.join(NAMES)})"), F.lit(False))


def header_like(cells) -> Column:
    """Whether a row (an array of cells) can be a header: over half of what it holds are names, and over four fifths differ."""
    held = F.array_compact(col(cells))
    names = F.size(F.filter(held, looks_like_name))
    return (F.size(held) > 0) & (names * 2 > F.size(held)) & (F.size(F.array_distinct(held)) * 5 > F.size(held) * 4)
