"""The tables of a session by name, each read when it is first asked for."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from relkit.entity import Entity


class Catalog:
    """Entities and their frames.  Parquet tables are found as <folder>/<table>.parquet; others can be put in."""

    def __init__(self, spark: SparkSession, folder: str | None = None, entities: list[Entity] | None = None):
        self.spark, self.folder = spark, folder
        self.entities = {e.name: e for e in entities or []}
        self._frames: dict[str, DataFrame] = {}

    def put(self, table: str, df: DataFrame) -> Catalog:
        """A catalogue in which the table is this frame."""
        other = Catalog(self.spark, self.folder, list(self.entities.values()))
        other._frames = self._frames | {table: df}
        return other

    def entity(self, name: str) -> Entity:
        if name not in self.entities:
            raise KeyError(f"no entity {name}")
        return self.entities[name]

    def frame(self, table: str) -> DataFrame:
        if table not in self._frames:
            if not self.folder:
                raise KeyError(f"no table {table}")
            self._frames[table] = self.spark.read.parquet(f"{self.folder}/{table}.parquet")
        return self._frames[table]

    def has(self, table: str) -> bool:
        try:
            self.frame(table)
        except Exception as e:  # AnalysisException: the path does not exist
            if "PATH_NOT_FOUND" not in str(e) and not isinstance(e, KeyError):
                raise
            return False
        return True

    def views(self, text: str) -> None:
        """A temporary view of each of the entities' tables that some SQL names."""
        for table in {e.source for e in self.entities.values()}:
            if re.search(rf"\b{re.escape(table)}\b", text):
                self.frame(table).createOrReplaceTempView(table)

    def sql(self, text: str, params: list | dict | None = None, tables: list[str] | None = None) -> DataFrame:
        """Raw SQL over the catalogue's tables, with `?` or `:name` parameters.

        Tables of entities that the text names, and those in `tables`, become temporary views.
        """
        self.views(text)
        for name in tables or []:
            self.frame(name).createOrReplaceTempView(name)
        return self.spark.sql(text, args=params) if params else self.spark.sql(text)
