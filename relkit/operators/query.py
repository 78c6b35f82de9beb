"""The query builder: immutable, lazy, composed into one DataFrame.

Filters act below ordering and paging whatever the order of calls, as the clauses of a
SQL statement do; set operations take the query as built so far.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from relkit.entity import Entity
from relkit.functions.expr import Case, col
from relkit.operators import includes, mutate
from relkit.operators.grouping import Grouped
from relkit.operators.windows import Windowed
from relkit.sources.catalog import Catalog

#: Pairs of rows that a task of a spread join goes through, on average.
PAIRS = 1 << 23


class _Columns:
    """Attributes are columns, also nested ones: t.customer.c_name."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


def predicate(p) -> Column:
    """A Column, or a function of the row's columns."""
    return p(_Columns()) if callable(p) and not isinstance(p, Column) else p


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Query:
    catalog: Catalog
    entity: Entity
    base: DataFrame
    order: tuple[Column, ...] = ()
    offset: int | None = None
    limit: int | None = None
    unique: bool = False
    projection: tuple[Column, ...] | None = None
    paths: tuple[str, ...] = ()
    ctes: tuple[tuple[str, str, bool], ...] = ()
    said: tuple[str, ...] = field(default=(), compare=False)

    @classmethod
    def of(cls, catalog: Catalog, entity: Entity | str) -> Query:
        entity = catalog.entity(entity) if isinstance(entity, str) else entity
        return cls(catalog, entity, catalog.frame(entity.source).alias(entity.source), said=(f"FROM {entity.source}",))

    def _with(self, said: str, **changes) -> Query:
        return replace(self, said=(*self.said, said), **changes)

    def _new(self, df: DataFrame, said: str) -> Query:
        """A query over what is built so far."""
        return Query(self.catalog, self.entity, df, ctes=self.ctes, said=(*self.said, said))

    # --- filters ----------------------------------------------------------------

    def where(self, p) -> Query:
        """Repeated calls are joined by AND."""
        p = predicate(p)
        return self._with(f"WHERE {p}", base=self.base.where(p))

    def where_raw(self, sql: str, *values) -> Query:
        """SQL text with {0}, {1}, ... for values, which are put in as literals."""
        text = re.sub(r"\{(\d+)\}", lambda m: _literal(values[int(m[1])]), sql)
        return self._with(f"WHERE {text}", base=self.base.where(F.expr(text)))

    def where_in(self, key, sub: Query | DataFrame, sub_key: str | None = None) -> Query:
        """Rows whose key is among the values of the other query's column."""
        values = _values(sub, sub_key)
        return self._with("WHERE IN", base=self.base.join(values, col(key) == F.col("__value"), "left_semi"))

    def where_not_in(self, key, sub: Query | DataFrame, sub_key: str | None = None) -> Query:
        """NOT IN with SQL's nulls: a null among the values leaves no row, a null key is only let through if there are no values.

        The anti join is one by equality: Spark's null-aware one broadcasts all values, however many there are.
        """
        return self._without("WHERE NOT IN", col(key), _values(sub, sub_key))

    def _without(self, said: str, key: Column, values: DataFrame) -> Query:
        null_among = values.agg(F.max(F.col("__value").isNull())).scalar()  # null: no values
        found = self.base.where(null_among.isNull() | (~null_among & key.isNotNull()))
        # without the hint, millions of keys whose file is small are broadcast
        return self._with(said, base=found.join(values.hint("merge"), key == F.col("__value"), "left_anti"))

    def where_in_raw(self, key: str, sql: str) -> Query:
        return self._with(f"WHERE {key} IN ({sql})", base=self.base.where(F.expr(f"{key} IN ({self._viewed(sql)})")))

    def where_not_in_raw(self, key: str, sql: str) -> Query:
        said, values = f"WHERE {key} NOT IN ({sql})", None
        if re.match(r"\s*(SELECT|WITH)\b", sql, re.I):
            with suppress(AnalysisException):  # it names columns of this query
                values = self._sql(f"SELECT * FROM ({sql})")
        if values is None or len(values.columns) > 1:
            return self._with(said, base=self.base.where(F.expr(f"{key} NOT IN ({self._viewed(sql)})")))
        return self._without(said, F.expr(key), _values(values, None))

    def where_exists(self, sub: Query | DataFrame, on: Column | None = None) -> Query:
        """All rows or none, unless `on` ties the two together."""
        sub = _frame(sub)
        return self._with("WHERE EXISTS", base=self.base.where(sub.exists()) if on is None else self.base.join(sub, on, "left_semi"))

    def where_not_exists(self, sub: Query | DataFrame, on: Column | None = None) -> Query:
        sub = _frame(sub)
        return self._with("WHERE NOT EXISTS", base=self.base.where(~sub.exists()) if on is None else self.base.join(sub, on, "left_anti"))

    # --- order and pages --------------------------------------------------------

    def order_by(self, *keys) -> Query:
        """Keys are appended to those there are; nulls come first."""
        return self._with(f"ORDER BY {keys}", order=(*self.order, *(predicate(k) if callable(k) or isinstance(k, Column) else F.col(k).asc() for k in keys)))

    def order_by_descending(self, *keys) -> Query:
        return self._with(f"ORDER BY {keys} DESC", order=(*self.order, *(col(k).desc() for k in keys)))

    def then_by(self, *keys) -> Query:
        self._ordered()
        return self.order_by(*keys)

    def then_by_descending(self, *keys) -> Query:
        self._ordered()
        return self.order_by_descending(*keys)

    def _ordered(self) -> None:
        if not self.order:
            raise ValueError("then_by must follow order_by")

    def skip(self, n: int) -> Query:
        return self._with(f"OFFSET {n}", offset=n)

    def take(self, n: int) -> Query:
        return self._with(f"LIMIT {n}", limit=n)

    def distinct(self) -> Query:
        return self._with("DISTINCT", unique=True)

    # --- columns ----------------------------------------------------------------

    def select(self, *columns, **named) -> Query:
        """Columns by name or expression; keywords give names.  Order, pages and DISTINCT stay."""
        picked = tuple(predicate(c) if callable(c) or isinstance(c, Column) else F.col(c) for c in columns)
        return self._with(f"SELECT {columns} {tuple(named)}", projection=(*picked, *(predicate(c).alias(n) if callable(c) or isinstance(c, Column) else F.col(c).alias(n) if isinstance(c, str) else F.lit(c).alias(n) for n, c in named.items())))

    def select_raw(self, sql: str) -> Query:
        """A SELECT list as SQL text."""
        return self._with(f"SELECT {sql}", projection=tuple(F.expr(part) for part in split_list(sql)))

    def with_column(self, name: str, column: Column) -> Query:
        return self._with(f"{name} = {column}", base=self.base.withColumn(name, column))

    def select_case(self, alias: str, case: Case) -> Query:
        """A CASE column after the others."""
        return self.with_column(alias, case.column())

    # --- joins ------------------------------------------------------------------

    def include(self, path: str) -> Query:
        includes.check(self.catalog, self.entity, path, self.paths)
        # related rows are there for filters too: t.customer.c_name
        return self._with(f"INCLUDE {path}", base=includes.attach(self.catalog, self.entity, self.base, path, self.paths), paths=(*self.paths, path))

    def then_include(self, step: str) -> Query:
        """One step further along the last include."""
        if not self.paths:
            raise ValueError("then_include must follow include")
        path = f"{self.paths[-1]}.{step}"
        includes.check(self.catalog, self.entity, path, self.paths)
        return self._with(f"INCLUDE {path}", base=includes.attach(self.catalog, self.entity, self.base, path, self.paths), paths=(*self.paths, path))

    def join(self, other: Query | DataFrame, on, how: str = "inner") -> Query:
        return self._with(f"JOIN {how}", base=self.base.join(_frame(other), on, how))

    def join_spread(self, other: Query | DataFrame, on: Column, key: str, other_key: str) -> Query:
        """An inner join whose keys, which `on` compares, have few values with many rows each.

        Counts the pairs of equal keys at once; beyond PAIRS, they are dealt to tasks of about so many.
        """
        return self._with("JOIN", base=_spread(self.base, _frame(other), on, key, other_key))

    def from_raw(self, sql: str) -> Query:
        """The FROM clause as SQL text over views, CTEs and the catalogue's tables; t0 is no name there."""
        return self._new(self._sql(f"SELECT * FROM {sql}"), f"FROM {sql}")

    def join_raw(self, sql: str) -> Query:
        """JOIN text after this query, which is called t0 in it."""
        name = f"t0_{id(self)}"
        self.build().createOrReplaceTempView(name)
        try:
            return self._new(self._sql(f"SELECT * FROM {name} AS t0 {sql}"), sql)
        finally:
            self.catalog.spark.catalog.dropTempView(name)

    # --- CTEs -------------------------------------------------------------------

    def with_cte(self, name: str, sql: str) -> Query:
        """A named query for from_raw, join_raw and raw subqueries."""
        return self._with(f"WITH {name}", ctes=(*self.ctes, (name, sql, False)))

    def with_recursive_cte(self, name: str, anchor: str, recursive: str, *, levels: int | None = None) -> Query:
        """`levels` lifts Spark's limit of 100 levels."""
        most = f" MAX RECURSION LEVEL {levels}" if levels else ""
        return self._with(f"WITH RECURSIVE {name}", ctes=(*self.ctes, (name + most, f"{anchor} UNION ALL {recursive}", True)))

    def _ctes(self) -> str:
        if not self.ctes:
            return ""
        return f"WITH {'RECURSIVE ' if any(r for _, _, r in self.ctes) else ''}" + ", ".join(f"{n} AS ({s})" for n, s, _ in self.ctes) + " "

    def _viewed(self, text: str) -> str:
        """The text after its CTEs, with a view of each of the catalogue's tables that it names."""
        text = self._ctes() + text
        self.catalog.views(text)
        return text

    def _sql(self, text: str) -> DataFrame:
        return self.catalog.spark.sql(self._viewed(text))

    # --- set operations, in the order of calls ------------------------------------

    def union(self, other: Query) -> Query:
        return self._new(self.build().union(other.build()).distinct(), "UNION")

    def union_all(self, other: Query) -> Query:
        return self._new(self.build().union(other.build()), "UNION ALL")

    def intersect(self, other: Query) -> Query:
        return self._new(self.build().intersect(other.build()), "INTERSECT")

    def except_(self, other: Query) -> Query:
        return self._new(self.build().subtract(other.build()), "EXCEPT")

    # --- groups and windows -------------------------------------------------------

    def group_by(self, *keys, **named) -> Grouped:
        """Keys by name, or any expression under a keyword."""
        return Grouped(self.build(), {k: F.col(k) for k in keys} | {k: predicate(v) for k, v in named.items()})

    def having(self, _) -> Query:
        raise ValueError("having must follow group_by")

    def window(self, partition_by=(), order_by=()) -> Windowed:
        as_list = lambda x: [x] if isinstance(x, (str, Column)) else list(x)
        return Windowed(self).partition_by(*as_list(partition_by)).order_by(*as_list(order_by))

    # --- results ------------------------------------------------------------------

    def delete(self) -> mutate.Change:
        """The entity's table without the rows of this query, by their key."""
        table, gone = self.catalog.frame(self.entity.source), self.build().select(self.entity.key)
        return mutate.Change(table.join(gone, self.entity.key, "left_anti").select(*table.columns), table.join(gone, self.entity.key, "left_semi").select(*table.columns))

    def build(self) -> DataFrame:
        df = self.base
        if self.unique:
            df = (df.select(*self.projection) if self.projection else df).distinct()
        if self.order:
            df = df.orderBy(*self.order)
        if self.offset:
            df = df.offset(self.offset)
        if self.limit is not None:
            df = df.limit(self.limit)
        if self.projection and not self.unique:
            df = df.select(*self.projection)
        return df

    @property
    def query(self) -> str:
        return "\n".join(self.said)

    def execute(self) -> list[Row]:
        return self.build().collect()

    def iterate(self) -> Iterator[Row]:
        """Rows as they come, a partition at a time."""
        return self.build().toLocalIterator(prefetchPartitions=True)

    def execute_with_query(self) -> tuple[str, DataFrame]:
        return self.query, self.build()

    # scalars are over the query as built: pages, DISTINCT and joins count
    def count(self) -> int:
        return self.build().count()

    def sum(self, column):
        return self.build().agg(F.coalesce(F.sum(col(column)), F.lit(0))).first()[0]

    def average(self, column):
        return self.build().agg(F.coalesce(F.avg(col(column)), F.lit(0))).first()[0]

    def min(self, column):
        return self.build().agg(F.min(col(column))).first()[0]

    def max(self, column):
        return self.build().agg(F.max(col(column))).first()[0]

    def any(self) -> bool:
        return not self.build().isEmpty()


def _frame(q: Query | DataFrame) -> DataFrame:
    return q.build() if isinstance(q, Query) else q


def _spread(left: DataFrame, right: DataFrame, on: Column, left_key: str, right_key: str) -> DataFrame:
    """A left row belongs to a row of a grid and goes to all its cells, a right one to a column: each pair meets in one cell."""
    n, m = (df.groupBy(F.col(key).alias("k")).agg(F.count("*").cast("double").alias(as_)) for df, key, as_ in ((left, left_key, "n"), (right, right_key, "m")))
    pairs, n, m = n.join(m, "k").agg(F.sum(F.col("n") * F.col("m")), F.sum("n"), F.sum("m")).first()
    cells = math.ceil((pairs or 0) / PAIRS)
    if cells < 2:
        return left.join(right, on)
    # the longer side gets more parts, so that the fewest rows are repeated
    rows = min(max(round(math.sqrt(cells * n / m)), 1), cells)
    cols = math.ceil(cells / rows)
    # by hashes, not at random: a task that runs again deals its rows as before
    row, column = (F.pmod(F.xxhash64(F.col("*")), F.lit(parts)).alias("__part") for parts in (rows, cols))
    part = F.col("__part")
    # dealt by part first: a small file is one task's, which would repeat all its rows
    left = left.select("*", row).repartition(rows, part).withColumn("__cell", F.explode(F.sequence(part * cols, part * cols + (cols - 1)))).drop("__part")
    right = right.select("*", column).repartition(cols, part).withColumn("__of", F.explode(F.sequence(part, part + (rows - 1) * cols, F.lit(cols)))).drop("__part")
    left, right = left.repartition(rows * cols, left_key, "__cell"), right.repartition(rows * cols, right_key, "__of")
    return left.join(right.hint("merge"), on & (F.col("__cell") == F.col("__of"))).drop("__cell", "__of")


def _values(sub: Query | DataFrame, key: str | None) -> DataFrame:
    df = _frame(sub)
    if key is None:
        if len(df.columns) != 1:
            raise ValueError("a subquery of several columns needs the name of one")
        key = df.columns[0]
    return df.select(F.col(key).alias("__value"))


def split_list(sql: str) -> list[str]:
    """At the commas outside parentheses and quotes."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(sql):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            out.append(sql[start:i])
            start = i + 1
    return [x.strip() for x in [*out, sql[start:]]]


def split_clause(sql: str, word: str) -> tuple[str, str | None]:
    """What stands before and after a keyword outside parentheses and quotes."""
    depth, quote = 0, ""
    for m in re.finditer(rf"['\"`()]|\b{word}\b", sql, re.I):
        if quote or m[0] in "'\"`":
            quote = m[0] if not quote else "" if m[0] == quote else quote
        elif m[0] in "()":
            depth += 1 if m[0] == "(" else -1
        elif not depth:
            return sql[: m.start()], sql[m.end() :]
    return sql, None
