"""Personal data: six detectors. Counts, flags and plain redaction are column expressions; spans need Python."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfall.functions.lazy import pandas_function

from inkfall.functions.text import col

# The shapes of each kind, in the order in which they are tried.
PATTERNS = {
    "ssn": (r"\b\d{3}-\d{2}-\d{4}\b", r"\b\d{3}\s\d{2}\s\d{4}\b", r"\b\d{9}\b"),
    "credit_card": (
        r"\b4\d{3}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
        r"\b5[1-5]\d{2}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
        r"\b3[47]\d{2}[\s-]?\d{6}[\s-]?\d{5}\b",
        r"\b6(?:011|5\d{2})[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
    ),
    "email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",),
    "phone": (r"\b\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b", r"\b\+1[\s.-]?\d{3}[\s.-]?\d{3}[\s.-]?\d{4}\b", r"\b1[\s.-]?\d{3}[\s.-]?\d{3}[\s.-]?\d{4}\b"),
    "ip_address": (r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",),
    "date_of_birth": (
        r"\b(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01])/(?:19|20)\d{2}\b",
        r"\b(?:0[1-9]|[12]\d|3[01])/(?:0[1-9]|1[0-2])/(?:19|20)\d{2}\b",
        r"\b(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b",
    ),
}
# Words near a match that make it likelier, well-known mail domains, private address starts.
NEAR_SSN = ("ssn", "social security", "ss#", "social sec")
NEAR_BIRTH = ("dob", "birth", "born", "birthday", "date of birth")
MAIL_DOMAINS = ("gmail.com", "yahoo.com", "outlook.com", "hotmail.com")
PRIVATE = ("192.168.", "10.", "172.", "127.")
# How sure a match is, by what is known about it.
SURE = {
    "ssn": {"parted, near a word": 0.95, "parted": 0.7, "bare, near a word": 0.9, "bare": 0.3, "impossible area": 0.5},
    "credit_card": {"check digit": 0.95, "other": 0.5},
    "email": {"known domain": 0.95, "other": 0.9},
    "phone": {"ten digits": 0.85, "other": 0.6},
    "ip_address": {"private": 0.6, "other": 0.8},
    "date_of_birth": {"near a word": 0.9, "other": 0.3},
}
FLOOR, CONTEXT = 0.5, 50
SPAN = "array<struct<kind:string,value:string,start:int,end:int,confidence:double,context:string>>"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return bool(digits) and (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _confidence(kind: str, value: str, around: str) -> float:
    digits, sure = re.sub(r"\D", "", value), SURE[kind]
    near = ", near a word" if any(w in around for w in NEAR_SSN) else ""
    known = {
        "ssn": lambda: ("bare" if value == digits else "parted") + near,
        "credit_card": lambda: "check digit" if luhn(digits) else "other",
        "email": lambda: "known domain" if value.split("@")[1].lower() in MAIL_DOMAINS else "other",
        "phone": lambda: "ten digits" if len(digits) >= 10 else "other",
        "ip_address": lambda: "private" if value.startswith(PRIVATE) else "other",
        "date_of_birth": lambda: "near a word" if any(w in around for w in NEAR_BIRTH) else "other",
    }[kind]()
    impossible = kind == "ssn" and (digits[:3] in ("000", "666") or digits[0] == "9")
    return sure[known] * (sure["impossible area"] if impossible else 1)


def spans(text: str | None, floor: float = FLOOR) -> list[dict]:
    """All matches at or above the floor by place; of several at one place the first kind's stays."""
    found: dict[tuple[int, int], dict] = {}
    lowered = (text or "").lower()
    for kind, shapes in PATTERNS.items():
        for shape in shapes:
            for m in re.finditer(shape, text or ""):
                a, b = max(0, m.start() - CONTEXT), m.end() + CONTEXT
                sure = _confidence(kind, m[0], lowered[a:b])
                if sure >= floor:
                    found.setdefault(m.span(), {"kind": kind, "value": m[0], "start": m.start(), "end": m.end(), "confidence": sure, "context": text[a:b]})
    return [found[k] for k in sorted(found)]


def redacted(text: str | None, mask: str = "[REDACTED]") -> str | None:
    """Matches that overlap are replaced together, others one by one."""
    if text is None:
        return None
    out, at, upto = [], 0, -1
    for s in spans(text):
        if s["start"] < upto:
            upto = at = max(upto, s["end"])
            continue
        out += [text[at : s["start"]], mask]
        at = upto = s["end"]
    return "".join([*out, text[at:]])


@pandas_function(SPAN)
def pii_spans(s: pd.Series) -> pd.Series:
    return s.map(spans)


@pandas_function("string")
def pii_redacted(s: pd.Series) -> pd.Series:
    return s.map(redacted)


def matches(c, kind: str) -> Column:
    """The matched values of a kind, pattern by pattern."""
    return F.flatten(F.array(*[F.regexp_extract_all(col(c), F.lit(p), F.lit(0)) for p in PATTERNS[kind]]))


def match_count(c, kind: str) -> Column:
    return sum((F.regexp_count(col(c), F.lit(p)) for p in PATTERNS[kind][1:]), F.regexp_count(col(c), F.lit(PATTERNS[kind][0]))).cast("long")


def valid_cards(c) -> Column:
    """The card numbers with a right check digit, as digits."""
    digits = F.transform(matches(c, "credit_card"), lambda x: F.regexp_replace(x, r"\D", ""))
    return F.filter(digits, lambda x: F.call_function("luhn_check", x))


def mask_emails(c, mask: str = "[EMAIL]") -> Column:
    return F.regexp_replace(col(c), PATTERNS["email"][0], mask.replace("\\", "\\\\").replace("$", "\\$"))
