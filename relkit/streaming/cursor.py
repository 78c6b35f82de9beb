"""Rows as they come, and jobs that run beside the caller and can be cancelled."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future

from pyspark.sql import DataFrame, Row


def iterate(df: DataFrame) -> Iterator[Row]:
    """A partition at a time, with the next one fetched ahead: the driver holds two at most."""
    return df.toLocalIterator(prefetchPartitions=True)


class Job:
    """An action in a thread of its own."""

    def __init__(self, df: DataFrame, action: Callable[[DataFrame], object] = DataFrame.collect):
        self._spark, self._tag, self._future = df.sparkSession, f"relkit-{uuid.uuid4().hex}", Future()

        def run() -> None:
            try:
                self._spark.addTag(self._tag)
                self._future.set_result(action(df))
            except BaseException as e:
                self._future.set_exception(e)

        threading.Thread(target=run, daemon=True).start()

    def result(self, timeout: float | None = None):
        return self._future.result(timeout)

    def done(self) -> bool:
        return self._future.done()

    def cancel(self) -> None:
        """Ends the Spark jobs of this action; result() then raises."""
        self._spark.interruptTag(self._tag)
