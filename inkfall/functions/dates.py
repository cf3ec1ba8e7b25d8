"""Dates found in text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfall.functions.lazy import pandas_function

from inkfall.functions.text import col

# The shapes of dates, and their formats to try, month first; a day over 12 in the month's place swaps them.
_MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
SHAPES = {
    r"\b\d{1,2}/\d{1,2}/\d{2,4}\b": ("M/d/yyyy", "d/M/yyyy", "M/d/yy", "d/M/yy"),
    r"\b\d{4}-\d{2}-\d{2}\b": ("yyyy-MM-dd",),
    r"\b\d{1,2}-\d{1,2}-\d{2,4}\b": ("M-d-yyyy", "d-M-yyyy", "M-d-yy", "d-M-yy"),
    rf"\b{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}\b": ("MMM d yyyy", "MMMM d yyyy"),
    rf"\b\d{{1,2}}\s+{_MONTH}\s+\d{{4}}\b": ("d MMM yyyy", "d MMMM yyyy"),
}
MOST, FIRST_YEAR, LAST_YEAR = 50, 1900, 2100


def parsed(c, formats) -> Column:
    """The first format that fits; two-digit years are not read by a four-digit one."""
    bare = F.initcap(F.regexp_replace(F.regexp_replace(col(c), ",", " "), r"\s+", " "))
    out = F.lit(None).cast("date")
    for f in reversed(formats):
        year = r"(?<!\d)\d{4}(?!\d)" if "yyyy" in f else r"(?<!\d)\d{2}$"
        out = F.coalesce(F.when(bare.rlike(year), F.to_date(F.try_to_timestamp(bare, F.lit(f)))), out)
    return out


def detected_dates(c, most: int = MOST) -> Column:
    """ISO dates of 1900 to 2100 by the five shapes in turn: distinct, at most `most` of them, then sorted."""
    found = [_of_shape(c, shape, formats) for shape, formats in SHAPES.items()]
    every = F.filter(F.flatten(F.array(*found)), lambda d: d.isNotNull() & F.year(d).between(FIRST_YEAR, LAST_YEAR))
    return F.sort_array(F.slice(F.array_distinct(F.transform(every, lambda d: F.date_format(d, "yyyy-MM-dd"))), 1, most))


def _of_shape(c, shape: str, formats) -> Column:
    return F.transform(F.regexp_extract_all(col(c), F.lit("(?i)" + shape), F.lit(0)), lambda x: parsed(x, formats))


@pandas_function("string")
def any_date(s: pd.Series) -> pd.Series:
    """The date somewhere in a free text, as ISO; null where none can be read."""
    from dateutil.parser import parse

    def one(x):
        try:
            return parse(x, fuzzy=True).date().isoformat() if x else None
        except (ValueError, OverflowError):
            return None

    return s.map(one)


def pdf_date(c) -> Column:
    """D:YYYYMMDD... as ISO; null where it is none."""
    part = lambda i: F.regexp_extract(col(c), r"^(?:D:)?(\d{4})(\d{2})(\d{2})", i)
    return F.when(part(1) != "", F.concat_ws("-", part(1), part(2), part(3)))


def mentions_year(dates, year: int | str) -> Column:
    """Whether one of the detected dates starts with the year."""
    return F.exists(F.coalesce(col(dates), F.array().cast("array<string>")), lambda d: d.startswith(str(year)))
