"""Groups of a query's rows: aggregates, HAVING, and members."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relkit.functions.expr import col


class Group:
    """What a HAVING predicate sees of a group: its keys as attributes, and aggregates."""

    def __init__(self, keys: dict[str, Column]):
        self._keys = keys

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_") or name not in self._keys:
            raise AttributeError(f"{name} is no key of the group")
        return F.col(name)

    count = staticmethod(lambda: F.count("*"))
    sum = staticmethod(lambda c: F.sum(col(c)))
    average = staticmethod(lambda c: F.avg(col(c)))
    min = staticmethod(lambda c: F.min(col(c)))
    max = staticmethod(lambda c: F.max(col(c)))


@dataclass(frozen=True)
class Grouped:
    df: DataFrame
    keys: dict[str, Column]
    conditions: tuple[Callable[[Group], Column], ...] = ()

    def having(self, predicate: Callable[[Group], Column]) -> Grouped:
        return replace(self, conditions=(*self.conditions, predicate))

    def _aggregated(self, aggregates: dict[str, Column]) -> DataFrame:
        group = Group(self.keys)
        tests = {f"__having{i}": c(group) for i, c in enumerate(self.conditions)}
        wanted = {**aggregates, **tests} or {"__one": F.count("*")}
        # the keys are computed once, below the aggregation, under their names
        named = self.df.withColumns({k: c for k, c in self.keys.items()})
        out = named.groupBy(*self.keys).agg(*(c.alias(a) for a, c in wanted.items()))
        for t in tests:
            out = out.where(F.col(t))
        return out.select(*self.keys, *aggregates)

    def select(self, **aggregates: Column) -> DataFrame:
        """The keys and the aggregates of each group that HAVING lets through."""
        return self._aggregated(aggregates)

    def members(self, alias: str = "members") -> DataFrame:
        """The keys and all rows of each group, as an array in the order of their columns."""
        columns = self.df.columns
        return self._kept().groupBy(*(F.col(k) for k in self.keys)).agg(F.array_sort(F.collect_list(F.struct(*(F.col(f"`{c}`") for c in columns)))).alias(alias))

    def rows(self) -> DataFrame:
        """The rows of the groups that HAVING lets through."""
        return self._kept().select(*(F.col(f"`{c}`") for c in self.df.columns))

    def _kept(self) -> DataFrame:
        named = self.df.withColumns(self.keys)
        if not self.conditions:
            return named
        good = self._aggregated({}).withColumnsRenamed({k: f"__{k}" for k in self.keys})
        same = F.lit(True)
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        return named.join(good, same, "left_semi")

    # scalars over all rows of the query, whatever the groups are
    def count(self, predicate: Column | None = None) -> int:
        return (self.df if predicate is None else self.df.where(predicate)).count()

    def sum(self, column):
        return self.df.agg(F.coalesce(F.sum(col(column)), F.lit(0))).first()[0]

    def average(self, column):
        return self.df.agg(F.coalesce(F.avg(col(column)), F.lit(0))).first()[0]

    def min(self, column):
        return self.df.agg(F.min(col(column))).first()[0]

    def max(self, column):
        return self.df.agg(F.max(col(column))).first()[0]
