"""Functions over Arrow batches that are made when they are used, as making one asks for a session; and values that are worked out once."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F


def bound(value, use):
    """use(value) as a column, with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pandas_function(returns: str):
    def made(f):
        @wraps(f)
        def column(*columns):
            return F.pandas_udf(f, returns)(*columns)

        return column

    return made
