"""What was asked and how Spark will do it."""

from __future__ import annotations

import contextlib
import io
from dataclasses import dataclass

from pyspark.sql import DataFrame

from relkit.operators.query import Query


@dataclass(frozen=True)
class Result:
    """A query's text together with its frame."""

    query: str
    df: DataFrame

    @property
    def plan(self) -> str:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            self.df.explain("formatted")
        return out.getvalue()


class Capture:
    """Keeps the text of the queries that go through it, while it is on."""

    def __init__(self, on: bool = True):
        self.on, self.queries = on, []

    @property
    def last(self) -> str | None:
        return self.queries[-1] if self.queries else None

    def run(self, q: Query) -> Result:
        text, df = q.execute_with_query()
        if self.on:
            self.queries.append(text)
        return Result(text, df)
