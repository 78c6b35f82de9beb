"""Mutations as pure transforms: a table before, a table after.

A mutation returns a Change: the table after it, and the rows it touched, both lazy.
Nothing is written (but for new rows that get automatic keys, see `create`); a unit of work
(relkit.plans.session) holds tables until they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relkit.entity import Entity, first_version, next_version
from relkit.plans.shared import written


class ConcurrencyError(RuntimeError):
    """A row was changed by another since it was read."""


class MissingRowError(LookupError):
    """A row that was to be changed is not there."""


@dataclass(frozen=True)
class Change:
    after: DataFrame
    touched: DataFrame

    def count(self) -> int:
        return self.touched.count()


def _aligned(df: DataFrame, columns: list[str], like: DataFrame) -> DataFrame:
    """df with these columns, in the types of `like`; missing ones are null."""
    have = set(df.columns)
    return df.select(*((F.col(f"`{c}`") if c in have else F.lit(None)).cast(like.schema[c].dataType).alias(c) for c in columns))


def create(entity: Entity, base: DataFrame, new: DataFrame, order: list[str] | None = None) -> Change:
    """Adds rows: defaults and first versions are filled in, automatic keys go on from the greatest.

    New keys follow the new rows' order (all their columns unless `order` says which).  The
    rows are sorted by range and written to the shared folder; a key is the row's place in
    its partition after the rows of the partitions before, so numbering is parallel.
    """
    rows = _aligned(new, base.columns, base)
    for p in entity.properties:
        if p.default:
            rows = rows.withColumn(p.name, p.default.expression(F.col(p.name)).cast(base.schema[p.name].dataType))
        if p.version:
            rows = rows.withColumn(p.name, F.coalesce(p.name, first_version(p.version)).cast(base.schema[p.name].dataType))
        if p.auto_increment:
            rows = _numbered(rows, order or [c for c in new.columns if c != p.name], "__nth")
            greatest = base.agg(F.coalesce(F.max(p.name), F.lit(0)).alias("__top"))
            rows = rows.join(greatest, how="cross").withColumn(p.name, (F.col("__top") + F.col("__nth")).cast(base.schema[p.name].dataType)).drop("__nth", "__top")
    rows = rows.select(*base.columns)
    return Change(base.unionByName(rows), rows)


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place in the order, from 1."""
    # partition and place within it are the upper and lower bits of the id; written, as they hang on the sort
    sorted_ = written(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted_.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # one row a partition
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return sorted_.withColumn("__part", part).join(before, "__part").withColumn(name, F.col("__before") + place + 1).drop("__at", "__part", "__before")


def update(base: DataFrame, where: Column, **values) -> Change:
    """Sets columns of the rows for which `where` is true; every value is computed from the row before."""
    hit = F.coalesce(where, F.lit(False))
    new = {c: v if isinstance(v, Column) else F.lit(v) for c, v in values.items()}
    missing = set(new) - set(base.columns)
    if missing:
        raise ValueError(f"no such columns: {', '.join(sorted(missing))}")
    # one projection: values see the old row alone
    after = base.select(*(F.when(hit, new[c].cast(base.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in base.columns))
    return Change(after, base.where(hit))


def update_field(base: DataFrame, where: Column, name: str, value) -> Change:
    return update(base, where, **{name: value})


def delete(base: DataFrame, where: Column | None = None) -> Change:
    """Takes away the rows for which `where` is true (all without it); where it is null they stay."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return Change(base.where(~hit), base.where(hit))


def latest(rows: DataFrame, key: str, arrival: str | Column) -> DataFrame:
    """The row of each key that arrived last; one pre-aggregated pass."""
    at = F.col(arrival) if isinstance(arrival, str) else arrival
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    return rows.groupBy(key).agg(F.max_by(whole, at).alias("__row")).select("__row.*")


def upsert(entity: Entity, base: DataFrame, new: DataFrame, arrival: str | None = None) -> Change:
    """New rows take the place of those with their key; of several of one key, the last to arrive counts (in their own order, if no column says when)."""
    new = latest(new, entity.key, arrival) if arrival else latest(new.withColumn("__at", F.monotonically_increasing_id()), entity.key, "__at").drop("__at")
    rows = _aligned(new, base.columns, base)
    return Change(base.join(rows.select(entity.key), entity.key, "left_anti").select(*base.columns).unionByName(rows), rows)


@dataclass(frozen=True)
class Versioned:
    """After an update against versions: the table, the rows that got through, those that did not, and those that have no row to change."""

    after: DataFrame
    applied: DataFrame
    conflicts: DataFrame
    missing: DataFrame

    def or_raise(self) -> DataFrame:
        if not self.missing.isEmpty():
            raise MissingRowError("rows that were to be changed are not there")
        if not self.conflicts.isEmpty():
            raise ConcurrencyError("rows were changed by another since they were read")
        return self.after


Resolver = Callable[[DataFrame, Entity, list[str]], DataFrame]


def update_versioned(entity: Entity, base: DataFrame, changed: DataFrame, *, resolver: Resolver | None = None, original: DataFrame | None = None) -> Versioned:
    """Replaces rows by key if their version is still the one that was read, and moves it on.

    What else was changed is a conflict, left as it is unless a resolver makes a row of the
    current (`c_`), incoming (`i_`) and original (`o_`) values.  Several changed rows of one
    key are all conflicts, which no resolver can settle: the first would move the version on.
    """
    v, key = entity.version, entity.key
    if v is None:
        raise ValueError(f"{entity.name} has no version column")
    if original is None and getattr(resolver, "needs_original", False):
        raise ValueError("merging needs the original rows: without them it can't be said which side changed a value")
    columns = base.columns
    current = base.select(*(F.col(c).alias(f"c_{c}") for c in columns))
    incoming = _aligned(changed, columns, base).select(*(F.col(c).alias(f"i_{c}") for c in columns))
    first = original if original is not None else changed.limit(0)
    firsts = _aligned(first, columns, base).select(*(F.col(c).alias(f"o_{c}") for c in columns))
    several = F.count("*").over(Window.partitionBy(f"i_{key}")) > 1
    found = incoming.withColumn("__several", several).join(current, F.col(f"i_{key}") == F.col(f"c_{key}"), "left").join(firsts, F.col(f"o_{key}") == F.col(f"i_{key}"), "left")
    missing, both = found.where(F.col(f"c_{key}").isNull()).drop("__several"), found.where(F.col(f"c_{key}").isNotNull())
    fits = F.col(f"i_{v.name}").eqNullSafe(F.col(f"c_{v.name}")) & ~F.col("__several")
    moved = lambda c: next_version(v.version, F.col(f"c_{c}")).cast(base.schema[c].dataType)
    applied = both.where(fits).select(*((moved(c) if c == v.name else F.col(f"i_{c}")).alias(c) for c in columns))
    conflicts = both.where(~fits)
    if resolver:
        made = resolver(conflicts.where("not __several"), entity, columns)
        # rows whose resolution is the current row are neither applied nor in conflict
        applied = applied.unionByName(made.select(*((moved(c) if c == v.name else F.col(c)).alias(c) for c in columns)))
        conflicts = conflicts.where("__several")
    after = base.join(applied.select(key), key, "left_anti").select(*columns).unionByName(applied)
    return Versioned(after, applied, conflicts.drop("__several"), missing)


def client_wins(conflicts: DataFrame, entity: Entity, columns: list[str]) -> DataFrame:
    return conflicts.select("*", *(F.col(f"i_{c}").alias(c) for c in columns))


def database_wins(conflicts: DataFrame, entity: Entity, columns: list[str]) -> DataFrame:
    return conflicts.select("*", *(F.col(f"c_{c}").alias(c) for c in columns))


def merged(current: Column, incoming: Column, original: Column, both: str = "incoming") -> Column:
    """Three ways: what only one side changed is taken from it; `both` says which side wins where both did."""
    only_current = ~current.eqNullSafe(original) & incoming.eqNullSafe(original)
    clash = ~current.eqNullSafe(original) & ~incoming.eqNullSafe(original) & ~current.eqNullSafe(incoming)
    clashed = {"incoming": incoming, "current": current, "throw": F.raise_error(F.lit("both sides changed a value"))}[both]
    return F.when(only_current, current).when(clash, clashed).otherwise(incoming)


def merge_changes(ignored: tuple[str, ...] = (), both: str = "incoming") -> Resolver:
    """A resolver that merges column by column against the original row; ignored columns stay as they are now."""

    def resolve(conflicts: DataFrame, entity: Entity, columns: list[str]) -> DataFrame:
        one = lambda c: F.col(f"c_{c}") if c in ignored or c == entity.key else merged(F.col(f"c_{c}"), F.col(f"i_{c}"), F.col(f"o_{c}"), both)
        return conflicts.select("*", *(one(c).alias(c) for c in columns))

    resolve.needs_original = True
    return resolve


RESOLVERS: dict[str, Resolver | None] = {"throw": None, "client_wins": client_wins, "database_wins": database_wins, "merge": merge_changes()}


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, column_name, old_value, new_value) of each value that differs between the rows of a key, as text."""
    columns = [c for c in before.columns if c != key and c in after.columns]
    b = before.select(F.col(key), *(F.col(c).alias(f"b_{c}") for c in columns))
    a = after.select(F.col(key), *(F.col(c).alias(f"a_{c}") for c in columns))
    items = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"b_{c}").cast("string").alias("old_value"), F.col(f"a_{c}").cast("string").alias("new_value"), (~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}"))).alias("differs")) for c in columns))
    found = b.join(a, key).select(key, F.inline(items))
    return found.where("differs").drop("differs")
