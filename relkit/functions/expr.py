"""Scalar functions and predicates as Columns, with one meaning for each.

Comparison to None is a null test, LIKE-style searches are case-sensitive, `/` is true
division with null for a zero divisor, positions count from 0, empty IN lists are false.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def eq(a, b) -> Column:
    return col(a).isNull() if b is None else col(a) == b


def ne(a, b) -> Column:
    return col(a).isNotNull() if b is None else col(a) != b


def between(a, low, high) -> Column:
    """Both ends belong to it."""
    return col(a).between(low, high)


def is_in(a, values: Iterable) -> Column:
    values = list(values)
    return col(a).isin(values) if values else F.lit(False)


def not_in(a, values: Iterable) -> Column:
    return ~is_in(a, values)


def any_of(values: Iterable) -> Column:
    """Whether a collection has any value: a constant."""
    return F.lit(any(True for _ in values))


def is_null_or_empty(a) -> Column:
    return col(a).isNull() | (col(a) == "")


def is_null_or_whitespace(a) -> Column:
    return col(a).isNull() | (F.trim(col(a)) == "")


def contains(a, part) -> Column:
    return col(a).contains(part)


def starts_with(a, part) -> Column:
    return col(a).startswith(part)


def ends_with(a, part) -> Column:
    return col(a).endswith(part)


def upper(a) -> Column:
    return F.upper(col(a))


def lower(a) -> Column:
    return F.lower(col(a))


def trim(a) -> Column:
    return F.trim(col(a))


def length(a) -> Column:
    return F.length(col(a))


def substring(a, start: int, size: int | None = None) -> Column:
    """From a position that counts from 0."""
    c = col(a)
    return F.substring(c, start + 1, size if size is not None else 2**31 - 1)


def replace(a, old: str, new: str) -> Column:
    return F.replace(col(a), F.lit(old), F.lit(new))


def concat(*parts) -> Column:
    """Null if any part is; strings are names of columns, F.lit gives text."""
    return F.concat(*(col(p) for p in parts))


def coalesce(*parts) -> Column:
    return F.coalesce(*(col(p) for p in parts))


def divide(a, b) -> Column:
    return F.try_divide(col(a), col(b))


def int_div(a, b) -> Column:
    """Whole part of the quotient, towards zero; null for a zero divisor."""
    a, b = col(a), col(b)
    return F.when(b != 0, F.call_function("div", a, F.nullif(b, F.lit(0))))


def modulo(a, b) -> Column:
    return F.when(col(b) != 0, col(a) % F.nullif(col(b), F.lit(0)))


def negate(a) -> Column:
    return -col(a)


def power(a, b) -> Column:
    return F.pow(col(a), col(b))


def greatest(*parts) -> Column:
    """Null if any part is."""
    return _unless_null(parts, F.greatest)


def least(*parts) -> Column:
    return _unless_null(parts, F.least)


def _unless_null(parts, f) -> Column:
    parts = [col(p) for p in parts]
    known = parts[0].isNotNull()
    for p in parts[1:]:
        known = known & p.isNotNull()
    return F.when(known, f(*parts))


def iif(condition: Column, yes, no) -> Column:
    return F.when(condition, yes).otherwise(no)


def add(a, **amounts: int) -> Column:
    """A timestamp moved on: add(ts, days=1, hours=-2), in the order given; months end where the month ends."""
    out = col(a)
    for unit, n in amounts.items():
        out = F.timestamp_add(unit.rstrip("s").upper(), F.lit(n), out)
    return out


_PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}


def date_part(part: str, a) -> Column:
    return _PARTS[part](col(a))


def now() -> Column:
    return F.localtimestamp()


def utc_now() -> Column:
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")


def today() -> Column:
    return F.current_date()


def date(year: int, month: int, day: int, *time: int) -> Column:
    return F.lit(datetime.datetime(year, month, day, *time)).cast("timestamp_ntz")


abs_, floor, ceiling, sqrt, sin, cos, tan = (lambda a, f=f: f(col(a)) for f in (F.abs, F.floor, F.ceil, F.sqrt, F.sin, F.cos, F.tan))


def round_(a, digits: int = 0) -> Column:
    """Halves go away from zero."""
    return F.round(col(a), digits)


def array(*values) -> Column:
    return F.array(*(F.lit(v) if not isinstance(v, Column) else v for v in values))


class Case:
    """CASE: branches in order; null without an Else."""

    def __init__(self, branches: tuple = (), other=None):
        self._branches, self._other = branches, other

    def when(self, condition: Column, value) -> Case:
        return Case((*self._branches, (condition, value)), self._other)

    def when_raw(self, condition: str, value) -> Case:
        return self.when(F.expr(condition), value)

    def otherwise(self, value) -> Case:
        return Case(self._branches, value)

    def column(self) -> Column:
        if not self._branches:
            raise ValueError("CASE needs a branch")
        (condition, value), *rest = self._branches
        out = F.when(condition, value)
        for condition, value in rest:
            out = out.when(condition, value)
        return out.otherwise(self._other) if self._other is not None else out
