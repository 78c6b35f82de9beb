"""A repository: reads, scalars and mutations of one entity's table."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from relkit.entity import Entity
from relkit.functions.expr import col
from relkit.operators import mutate
from relkit.operators.query import Query, predicate, split_clause, split_list
from relkit.plans.session import Session
from relkit.sources.catalog import Catalog


class NotSingleError(LookupError):
    """A read of one row found none, or several."""


def _shape(result: StructType | str) -> StructType:
    return _parse_datatype_string(result) if isinstance(result, str) else result


class Repository:
    def __init__(self, catalog: Catalog, entity: Entity | str, session: Session | None = None):
        self.entity = catalog.entity(entity) if isinstance(entity, str) else entity
        self.session = session or Session(catalog)

    @property
    def catalog(self) -> Catalog:
        return self.session.catalog

    @property
    def table(self) -> DataFrame:
        return self.catalog.frame(self.entity.source)

    def query(self) -> Query:
        return Query.of(self.catalog, self.entity)

    # --- reads --------------------------------------------------------------------

    def read_all(self) -> DataFrame:
        return self.table

    def read_many(self, p=None) -> DataFrame:
        return self.table if p is None else self.table.where(predicate(p))

    def read_first(self, p=None) -> Row | None:
        """A row, or None; which one is not said unless an order is asked for with query()."""
        return next(iter(self.read_many(p).take(1)), None)

    read_first_or_default = read_first

    def read_single(self, p=None) -> Row:
        found = self.read_many(p).take(2)
        if len(found) != 1:
            raise NotSingleError("no row" if not found else "more than one row")
        return found[0]

    def read_single_or_default(self, p=None) -> Row | None:
        found = self.read_many(p).take(2)
        if len(found) > 1:
            raise NotSingleError("more than one row")
        return found[0] if found else None

    def read_by_id(self, key) -> Row | None:
        return next(iter(self.table.where(F.col(self.entity.key) == F.lit(key)).take(1)), None)

    def exists(self, p=None) -> bool:
        return not self.read_many(p).isEmpty()

    def exists_by_id(self, key) -> bool:
        return self.exists(F.col(self.entity.key) == F.lit(key))

    def iterate(self, p=None) -> Iterator[Row]:
        return self.read_many(p).toLocalIterator(prefetchPartitions=True)

    def from_sql(self, sql: str, params: list | dict | None = None, result: StructType | str | None = None) -> DataFrame:
        """SQL over any of the catalogue's tables; `result` gives names and types to its columns, in order."""
        out = self.catalog.sql(sql, params, [self.entity.source])
        return out.toDF(*(shape := _shape(result)).names).to(shape) if result else out

    def execute_sql(self, sql: str, params: list | dict | None = None) -> int:
        """INSERT, UPDATE or DELETE text on this table, staged like other mutations; the number of rows it touched.

        INSERT INTO t [(columns)] query, UPDATE t SET column = expression, ... [WHERE condition],
        DELETE FROM t [WHERE condition]; conditions may hold subqueries.
        """
        change = self._statement(sql.strip().rstrip(";"), params)
        n = change.count()
        self._stage(change)
        return n

    def _statement(self, sql: str, params: list | dict | None) -> mutate.Change:
        table = rf"`?{re.escape(self.entity.source)}`?"
        self.catalog.views(sql)
        if found := re.fullmatch(rf"INSERT\s+INTO\s+{table}\s*(?:\(([^()]*)\))?\s*((?:SELECT|VALUES|WITH)\b.*)", sql, re.I | re.S):
            names = [x.strip(" `") for x in found[1].split(",")] if found[1] else self.table.columns
            return mutate.create(self.entity, self.table, self.catalog.sql(found[2], params).toDF(*names))
        if params:
            raise ValueError("parameters are for INSERT; write other values into the text, or use update_many and delete_many")
        if found := re.fullmatch(rf"UPDATE\s+{table}\s+SET\s+(.*)", sql, re.I | re.S):
            given, where = split_clause(found[1], "WHERE")
            pairs = [x.split("=", 1) for x in split_list(given)]
            return mutate.update(self.table, F.expr(where or "true"), **{n.strip(" `\n\t"): F.expr(v) for n, v in pairs})
        if found := re.fullmatch(rf"DELETE\s+FROM\s+{table}\s*(?:\bWHERE\b(.*))?", sql, re.I | re.S):
            return mutate.delete(self.table, F.expr(found[1]) if found[1] else None)
        raise ValueError(f"not an INSERT, UPDATE or DELETE of {self.entity.source}")

    def count(self, p=None) -> int:
        return self.read_many(p).count()

    def sum(self, column, p=None):
        return self.read_many(p).agg(F.coalesce(F.sum(col(column)), F.lit(0))).first()[0]

    def average(self, column, p=None):
        return self.read_many(p).agg(F.coalesce(F.avg(col(column)), F.lit(0))).first()[0]

    def min(self, column, p=None):
        return self.read_many(p).agg(F.min(col(column))).first()[0]

    def max(self, column, p=None):
        return self.read_many(p).agg(F.max(col(column))).first()[0]

    # --- mutations: staged in the session, counted when asked -----------------------

    def _stage(self, change: mutate.Change) -> mutate.Change:
        self.session.stage(self.entity.source, change.after)
        return change

    def create(self, **values) -> mutate.Change:
        given = self.catalog.spark.createDataFrame([tuple(values.values())], self._schema(list(values)))
        return self.create_many(given)

    def create_many(self, rows: DataFrame, order: list[str] | None = None) -> mutate.Change:
        return self._stage(mutate.create(self.entity, self.table, rows, order))

    def update(self, changed: DataFrame, *, strategy: str | mutate.Resolver = "throw", original: DataFrame | None = None) -> mutate.Versioned | mutate.Change:
        """Rows by key; with a version column, against it."""
        if self.entity.version is None:
            if not changed.join(self.table.select(self.entity.key), self.entity.key, "left_anti").isEmpty():
                raise mutate.MissingRowError(f"rows of {self.entity.name} that were to be changed are not there")
            return self._stage(mutate.upsert(self.entity, self.table, changed))
        resolver = mutate.RESOLVERS[strategy] if isinstance(strategy, str) else strategy
        out = mutate.update_versioned(self.entity, self.table, changed, resolver=resolver, original=original)
        self.session.stage(self.entity.source, out.or_raise())
        return out

    def update_many(self, p, action: Callable[[DataFrame], dict]) -> mutate.Change:
        """`action` names new values from the old row."""
        return self.batch_update(p, **action(self.table))

    def batch_update(self, p, **values) -> mutate.Change:
        return self._stage(mutate.update(self.table, predicate(p), **{k: predicate(v) if callable(v) and not isinstance(v, Column) else v for k, v in values.items()}))

    def update_field(self, p, name: str, value) -> mutate.Change:
        return self.batch_update(p, **{name: value})

    def delete_many(self, p) -> mutate.Change:
        return self._stage(mutate.delete(self.table, predicate(p)))

    batch_delete = delete_many

    def delete_by_id(self, key) -> mutate.Change:
        return self.delete_many(F.col(self.entity.key) == F.lit(key))

    def delete_all(self) -> mutate.Change:
        return self._stage(mutate.delete(self.table))

    def upsert(self, **values) -> mutate.Change:
        return self.upsert_many(self.catalog.spark.createDataFrame([tuple(values.values())], self._schema(list(values))))

    def upsert_many(self, rows: DataFrame, arrival: str | None = None) -> mutate.Change:
        return self._stage(mutate.upsert(self.entity, self.table, rows, arrival))

    def _schema(self, columns: list[str]):
        return StructType([StructField(c, self.table.schema[c].dataType) for c in columns])

    def delete_query(self, query: Query) -> mutate.Change:
        """The rows that a query over this entity finds, whatever its joins, order and pages."""
        return self._stage(query.delete())

    # --- schema -------------------------------------------------------------------

    def validate(self) -> tuple[list[str], list[str]]:
        return self.entity.validate(self.table if self.catalog.has(self.entity.source) else None)

    def initialize(self) -> bool:
        """An empty table of the entity's columns, if there is none; whether it was made."""
        if self.catalog.has(self.entity.source):
            return False
        self.session.stage(self.entity.source, self.catalog.spark.createDataFrame([], self.entity.schema()))
        return True

    def seed(self, rows: DataFrame) -> mutate.Change | None:
        """Adds the rows if the table has none."""
        return self.create_many(rows) if self.table.isEmpty() else None
