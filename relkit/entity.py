"""Entities: a table's columns, key, relationships, version, defaults and indexes, declared once."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class VersionKind(Enum):
    """How a version column moves on at an update."""

    INTEGER = "integer"
    TIMESTAMP = "timestamp"
    GUID = "guid"
    ROW_VERSION = "row_version"  # eight bytes, big-endian


class DefaultKind(Enum):
    """What a column gets at creation; STATIC takes the default's value, PROVIDER its callable."""

    UTC_NOW = "utc_now"
    LOCAL_NOW = "local_now"
    UTC_DATE = "utc_date"
    LOCAL_DATE = "local_date"
    NEW_GUID = "new_guid"
    SEQUENTIAL_GUID = "sequential_guid"
    EMPTY_GUID = "empty_guid"
    EMPTY_STRING = "empty_string"
    ZERO = "zero"
    TRUE = "true"
    FALSE = "false"
    STATIC = "static"
    PROVIDER = "provider"


EMPTY_GUID = "00000000-0000-0000-0000-000000000000"


@dataclass(frozen=True)
class Default:
    kind: DefaultKind
    value: object = None
    only_if_null: bool = True

    def expression(self, given: Column) -> Column:
        """What is stored where `given` was asked for."""
        k = DefaultKind
        made = {
            k.UTC_NOW: lambda: F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz"),
            k.LOCAL_NOW: F.localtimestamp,
            k.UTC_DATE: lambda: F.to_date(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())),
            k.LOCAL_DATE: F.current_date,
            k.NEW_GUID: lambda: F.expr("uuid()"),
            # ids that rise with the rows of a partition, in the shape of a GUID
            k.SEQUENTIAL_GUID: lambda: F.regexp_replace(F.lpad(F.hex(F.monotonically_increasing_id()), 32, "0"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
            k.EMPTY_GUID: lambda: F.lit(EMPTY_GUID),
            k.EMPTY_STRING: lambda: F.lit(""),
            k.ZERO: lambda: F.lit(0),
            k.TRUE: lambda: F.lit(True),
            k.FALSE: lambda: F.lit(False),
            k.STATIC: lambda: F.lit(self.value),
            k.PROVIDER: lambda: self.value(given),
        }[self.kind]()
        return F.coalesce(given, made) if self.only_if_null else made


@dataclass(frozen=True)
class Property:
    """A column: its Spark type, and what a database would keep with it."""

    name: str
    type: str
    primary_key: bool = False
    auto_increment: bool = False
    nullable: bool = True
    max_length: int | None = None
    default: Default | None = None
    version: VersionKind | None = None

    def field(self) -> T.StructField:
        notes = {"primary_key": self.primary_key, "auto_increment": self.auto_increment}
        if self.max_length:
            notes["max_length"] = self.max_length
        return T.StructField(self.name, T._parse_datatype_string(self.type), self.nullable and not self.primary_key, notes)


@dataclass(frozen=True)
class Reference:
    """N:1: `column` holds the key of a row of `entity`."""

    column: str
    entity: str


@dataclass(frozen=True)
class Collection:
    """1:N: rows of `entity` whose `column` holds this row's key."""

    entity: str
    column: str


@dataclass(frozen=True)
class ManyToMany:
    """N:M: `junction` pairs this row's key in `own` with the key of a row of `entity` in `other`."""

    entity: str
    junction: str
    own: str
    other: str


@dataclass(frozen=True)
class Index:
    """Has no effect on how Spark reads; a unique one can be checked."""

    name: str
    columns: tuple[str, ...]
    unique: bool = False
    included: tuple[str, ...] = ()


@dataclass(frozen=True)
class Entity:
    name: str
    properties: tuple[Property, ...]
    navigations: dict[str, Reference | Collection | ManyToMany] = field(default_factory=dict)
    indexes: tuple[Index, ...] = ()
    table: str | None = None

    @property
    def source(self) -> str:
        return self.table or self.name

    @property
    def key(self) -> str:
        keys = [p.name for p in self.properties if p.primary_key]
        if len(keys) != 1:
            raise ValueError(f"{self.name} must have one primary key; it has {len(keys)}")
        return keys[0]

    @property
    def version(self) -> Property | None:
        return next((p for p in self.properties if p.version), None)

    @property
    def columns(self) -> list[str]:
        return [p.name for p in self.properties]

    def schema(self) -> T.StructType:
        return T.StructType([p.field() for p in self.properties])

    def validate(self, df: DataFrame | None) -> tuple[list[str], list[str]]:
        """(errors, warnings): a missing column or a bad key is an error; a table or a column that isn't known, a warning."""
        errors = [] if sum(p.primary_key for p in self.properties) == 1 else [f"{self.name} must have one primary key"]
        if df is None:
            return errors, [f"table {self.source} does not exist"]
        there = {c.lower(): t for c, t in df.dtypes}
        errors += [f"column {p.name} is missing from {self.source}" for p in self.properties if p.name.lower() not in there]
        own = {p.name.lower() for p in self.properties}
        return errors, [f"column {c} of {self.source} is not part of {self.name}" for c in df.columns if c.lower() not in own]

    def ddl(self) -> str:
        """CREATE TABLE in Spark's SQL; NOT NULL where the property says so, but for the key."""
        lines = [f"`{p.name}` {p.type.upper()}" + (" NOT NULL" if not p.nullable and p.default is None and not p.primary_key else "") for p in self.properties]
        return f"CREATE TABLE IF NOT EXISTS `{self.source}` ({', '.join(lines)}) USING parquet"

    def violations(self, df: DataFrame, index: Index) -> DataFrame:
        """Values that a unique index would not allow, with their number of rows; nulls are not compared."""
        known = df.dropna(subset=list(index.columns))
        return known.groupBy(*index.columns).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def next_version(kind: VersionKind, column: Column) -> Column:
    if kind is VersionKind.INTEGER:
        return column + 1
    if kind is VersionKind.TIMESTAMP:
        return F.localtimestamp()
    if kind is VersionKind.GUID:
        return F.expr("uuid()")
    return F.unhex(F.lpad(F.hex(F.conv(F.hex(column), 16, 10).cast("bigint") + 1), 16, "0"))


def first_version(kind: VersionKind) -> Column:
    if kind is VersionKind.INTEGER:
        return F.lit(1)
    if kind is VersionKind.ROW_VERSION:
        return F.unhex(F.lit("0000000000000001"))
    return next_version(kind, F.lit(None))
