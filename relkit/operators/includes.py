"""Related rows, loaded by an entity's navigations: structs for N:1, arrays of structs for 1:N and N:M.

Collections are grouped by their foreign key before they are joined, so parents never fan
out.  Whether a join is broadcast is left to Spark, which knows the tables' sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relkit.entity import Collection, Entity, Reference
from relkit.sources.catalog import Catalog

MOST_DEEP = 5


class IncludeError(ValueError):
    pass


def check(catalog: Catalog, entity: Entity, path: str, have: tuple[str, ...], most: int = MOST_DEEP) -> None:
    """A path must be new, at most so deep, of known navigations, and must not come back to an entity."""
    if path in have:
        raise IncludeError(f"{path} is included already")
    steps = path.split(".")
    if len(steps) > most:
        raise IncludeError(f"{path} is deeper than {most}")
    seen = [entity.name]
    for step in steps:
        if step not in entity.navigations:
            raise IncludeError(f"{entity.name} has no navigation {step}")
        entity = catalog.entity(entity.navigations[step].entity)
        if entity.name in seen:
            raise IncludeError(f"{path} comes back to {entity.name}")
        seen.append(entity.name)


def load(catalog: Catalog, entity: Entity, df: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    """df with the paths' related rows, shorter paths before the longer ones that go on from them."""
    for i, path in enumerate(paths):
        df = attach(catalog, entity, df, path, paths[:i])
    return df


def attach(catalog: Catalog, entity: Entity, df: DataFrame, path: str, before: tuple[str, ...] = ()) -> DataFrame:
    """df, which has the paths `before`, with one more.

    Along references, rows are joined to the struct there is and become a field of it.  A
    path through a collection loads the collection anew, with what was in it before.
    """
    root, steps = entity, path.split(".")
    for i, step in enumerate(steps[:-1]):
        nav = entity.navigations[step]
        if not isinstance(nav, Reference):
            head = ".".join(steps[: i + 1]) + "."
            inner = tuple(p.removeprefix(head) for p in (*before, path) if p.startswith(head))
            return _join(catalog, root, df, steps[: i + 1], inner)
        entity = catalog.entity(nav.entity)
    return _join(catalog, root, df, steps, ())


def _join(catalog: Catalog, entity: Entity, df: DataFrame, steps: list[str], inner: tuple[str, ...]) -> DataFrame:
    """df with what the last step leads to, as a column or as a field of the struct before it."""
    for step in steps[:-1]:
        entity = catalog.entity(entity.navigations[step].entity)
    nav, holder = entity.navigations[steps[-1]], ".".join(f"`{s}`" for s in steps[:-1])
    related = catalog.entity(nav.entity)
    rows = load(catalog, related, catalog.frame(related.source), inner)
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    at = (lambda c: F.col(f"{holder}.`{c}`")) if holder else (lambda c: df[c])
    if isinstance(nav, Reference):
        side = rows.select(whole.alias("__found"), F.col(related.key).alias("__key"))
        df, found = df.join(side, at(nav.column) == F.col("__key"), "left"), F.col("__found")
    else:
        if isinstance(nav, Collection):
            side = rows.select(whole.alias("__one"), F.col(nav.column).alias("__key"))
        else:
            pairs = catalog.frame(nav.junction).select(F.col(nav.own).alias("__key"), F.col(nav.other).alias("__other")).distinct()
            side = pairs.join(rows.select(whole.alias("__one"), F.col(related.key).alias("__other")), "__other")
        lists = side.groupBy("__key").agg(F.array_sort(F.collect_list("__one")).alias("__found"))
        df = df.join(lists, at(entity.key) == F.col("__key"), "left")
        found = F.coalesce(F.col("__found"), F.array().cast(lists.schema["__found"].dataType))
    if holder:
        # from the inside out: the struct before the last step gets the field, the one before that the changed struct
        for i in range(len(steps) - 1, 0, -1):
            outer = F.col(".".join(f"`{s}`" for s in steps[:i]))
            found = F.when(outer.isNotNull(), outer.withField(f"`{steps[i]}`", found))
    return df.withColumn(steps[0], found).drop("__found", "__key")
