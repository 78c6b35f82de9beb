"""Units of work: tables staged by mutations, savepoints, and what to do at the end.

Frames are immutable, so a transaction is a catalogue that is put aside: rolling back takes
the old one again.  Committing may write the staged tables to a folder.
"""

from __future__ import annotations

import contextvars
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

from relkit.sources.catalog import Catalog

_AMBIENT: contextvars.ContextVar[Session | None] = contextvars.ContextVar("relkit_session", default=None)


class Session:
    def __init__(self, catalog: Catalog):
        self.catalog = catalog
        self._staged: dict[str, DataFrame] = {}
        self._marks: list[tuple[str, Catalog, dict[str, DataFrame]]] = []

    def stage(self, table: str, df: DataFrame) -> None:
        self._staged[table] = df
        self.catalog = self.catalog.put(table, df)

    @property
    def staged(self) -> dict[str, DataFrame]:
        return dict(self._staged)

    def savepoint(self, name: str) -> None:
        self._marks.append((name, self.catalog, dict(self._staged)))

    def _mark(self, name: str) -> int:
        for i in range(len(self._marks) - 1, -1, -1):
            if self._marks[i][0] == name:
                return i
        raise KeyError(f"no savepoint {name}")

    def rollback_to(self, name: str) -> None:
        """Back to the savepoint, which stays; later ones go."""
        i = self._mark(name)
        _, self.catalog, staged = self._marks[i]
        self._staged = dict(staged)
        del self._marks[i + 1 :]

    def release(self, name: str) -> None:
        del self._marks[self._mark(name) :]

    def write(self, folder: str) -> None:
        """Each staged table as Parquet under a folder; never over the tables it was made from."""
        for table, df in self._staged.items():
            df.write.parquet(f"{folder}/{table}.parquet")


def current() -> Session | None:
    """The session of the innermost scope."""
    return _AMBIENT.get()


class Scope:
    def __init__(self, session: Session):
        self.session, self.completed = session, False

    def complete(self) -> None:
        self.completed = True


@contextmanager
def scope(catalog: Catalog | None = None) -> Iterator[Scope]:
    """An ambient transaction: what is staged in it stays only if it is completed.  Scopes nest."""
    outer = _AMBIENT.get()
    session = outer or Session(catalog)
    before, staged = session.catalog, session.staged
    token = _AMBIENT.set(session)
    own = Scope(session)
    try:
        yield own
    except BaseException:
        own.completed = False
        raise
    finally:
        _AMBIENT.reset(token)
        if not own.completed:
            session.catalog, session._staged = before, staged
