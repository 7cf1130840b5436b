"""Work that one call cancels: what runs is stopped by its tag, what waits never starts, what comes later is not touched."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession


class Cancelled(Exception):
    """The work was handed in before a cancel and had not ended by then."""


class Cancellable:
    def __init__(self, spark: SparkSession) -> None:
        self._context, self._name, self._epoch = spark.sparkContext, uuid.uuid4().hex, 0

    def _tag(self, epoch: int) -> str:
        return f"{self._name}-{epoch}"

    def hand_in(self, work: Callable[..., Any]) -> Callable[..., Any]:
        """work, bound to the present epoch; call it from any thread."""
        epoch = self._epoch

        def run(*args: Any) -> Any:
            if epoch != self._epoch:
                raise Cancelled("cancelled before it began")
            self._context.addJobTag(self._tag(epoch))
            try:
                out = work(*args)
            except Exception as e:
                if epoch != self._epoch:
                    raise Cancelled("cancelled while it ran") from e
                raise
            finally:
                self._context.removeJobTag(self._tag(epoch))
            if epoch != self._epoch:
                raise Cancelled("cancelled while it ran")
            return out

        return run

    def cancel(self) -> None:
        old, self._epoch = self._epoch, self._epoch + 1
        self._context.cancelJobsWithTag(self._tag(old))
