"""Window functions with explicit frames."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from relkit.functions.expr import col

if TYPE_CHECKING:
    from relkit.operators.query import Query

UNBOUNDED_PRECEDING, UNBOUNDED_FOLLOWING, CURRENT = Window.unboundedPreceding, Window.unboundedFollowing, Window.currentRow


def bound(text: str) -> int:
    """`UNBOUNDED PRECEDING`, `3 FOLLOWING`, ...; what can't be read is the current row."""
    said = " ".join(text.upper().split())
    if said in ("UNBOUNDED PRECEDING", "UNBOUNDED FOLLOWING"):
        return UNBOUNDED_PRECEDING if said.endswith("PRECEDING") else UNBOUNDED_FOLLOWING
    found = re.fullmatch(r"(\d+) (PRECEDING|FOLLOWING)", said)
    return CURRENT if not found else int(found[1]) * (-1 if found[2] == "PRECEDING" else 1)


@dataclass(frozen=True)
class Windowed:
    """A window over a query's rows; its functions each add a column and can be chained."""

    query: Query
    partition: tuple[Column, ...] = ()
    order: tuple[Column, ...] = ()
    frame: tuple[str, int, int] | None = None

    def partition_by(self, *keys) -> Windowed:
        return replace(self, partition=(*self.partition, *map(col, keys)))

    def order_by(self, *keys) -> Windowed:
        return replace(self, order=(*self.order, *(col(k).asc() if isinstance(k, str) else k for k in keys)))

    def order_by_descending(self, *keys) -> Windowed:
        return replace(self, order=(*self.order, *(col(k).desc() for k in keys)))

    def rows(self, preceding: int, following: int) -> Windowed:
        return replace(self, frame=("rows", -preceding, following))

    def rows_unbounded_preceding(self) -> Windowed:
        return replace(self, frame=("rows", UNBOUNDED_PRECEDING, CURRENT))

    def rows_unbounded_following(self) -> Windowed:
        return replace(self, frame=("rows", CURRENT, UNBOUNDED_FOLLOWING))

    def rows_between(self, start: str, end: str) -> Windowed:
        return replace(self, frame=("rows", bound(start), bound(end)))

    def range(self, preceding: int, following: int) -> Windowed:
        return replace(self, frame=("range", -preceding, following))

    def range_unbounded_preceding(self) -> Windowed:
        return replace(self, frame=("range", UNBOUNDED_PRECEDING, CURRENT))

    def range_unbounded_following(self) -> Windowed:
        return replace(self, frame=("range", CURRENT, UNBOUNDED_FOLLOWING))

    def range_between(self, start: str, end: str) -> Windowed:
        return replace(self, frame=("range", bound(start), bound(end)))

    def groups(self, *_) -> Windowed:
        raise NotImplementedError("Spark has no GROUPS frames")

    def _spec(self, framed: bool):
        w = Window.partitionBy(*self.partition)
        if self.order:
            w = w.orderBy(*self.order)
        if framed and self.frame:
            kind, start, end = self.frame
            if start > end:
                raise ValueError("a frame must not end before it starts")
            w = w.rowsBetween(start, end) if kind == "rows" else w.rangeBetween(start, end)
        return w

    def _add(self, alias: str, function: Column, framed: bool) -> Windowed:
        return replace(self, query=self.query.with_column(alias, function.over(self._spec(framed))))

    def _ranked(self, alias: str, function: Column) -> Windowed:
        if not self.order:
            raise ValueError(f"{alias}: a ranking needs an order")
        return self._add(alias, function, False)

    def row_number(self, alias: str) -> Windowed:
        return self._ranked(alias, F.row_number())

    def rank(self, alias: str) -> Windowed:
        return self._ranked(alias, F.rank())

    def dense_rank(self, alias: str) -> Windowed:
        return self._ranked(alias, F.dense_rank())

    def lead(self, alias: str, column, offset: int = 1, default=None) -> Windowed:
        return self._ranked(alias, F.lead(col(column), offset, default))

    def lag(self, alias: str, column, offset: int = 1, default=None) -> Windowed:
        return self._ranked(alias, F.lag(col(column), offset, default))

    def first_value(self, alias: str, column) -> Windowed:
        return self._add(alias, F.first_value(col(column)), True)

    def last_value(self, alias: str, column) -> Windowed:
        return self._add(alias, F.last_value(col(column)), True)

    def nth_value(self, alias: str, column, n: int) -> Windowed:
        return self._add(alias, F.nth_value(col(column), n), True)

    def sum(self, alias: str, column) -> Windowed:
        return self._add(alias, F.sum(col(column)), True)

    def avg(self, alias: str, column) -> Windowed:
        return self._add(alias, F.avg(col(column)), True)

    def count(self, alias: str) -> Windowed:
        return self._add(alias, F.count("*"), True)

    def min(self, alias: str, column) -> Windowed:
        return self._add(alias, F.min(col(column)), True)

    def max(self, alias: str, column) -> Windowed:
        return self._add(alias, F.max(col(column)), True)

    def end(self) -> Query:
        return self.query
