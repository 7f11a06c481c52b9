"""Stages that make tables from tables, with versions, history and what has gone stale."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cragspan.plans.storage import materialise

_HISTORY = "number int, stage string, status string, inputs array<string>, produced string, seconds double, rows long, error string"


class Workflow:
    """Named tables, each version written to the shared folder, and the stages that made them.

    An observer, if given, is called with (stage, status, seconds) at each start, end and failure; what it raises is ignored.
    """

    def __init__(self, spark: SparkSession, observer: Callable[[tuple], None] | None = None) -> None:
        self.spark, self.observer = spark, observer
        self._tables: dict[str, DataFrame] = {}
        self._versions: dict[str, int] = {}
        self._made_from: dict[str, dict[str, int]] = {}
        self._history: list[tuple] = []

    def put(self, name: str, table: DataFrame) -> DataFrame:
        """A table from outside; its version goes up by one."""
        self._tables[name] = materialise(table, f"workflow-{name}")
        self._versions[name] = self._versions.get(name, 0) + 1
        self._made_from.pop(name, None)
        return self._tables[name]

    def get(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise KeyError(f"no table {name}; there are {sorted(self._tables)}")
        return self._tables[name]

    def stage(self, name: str, inputs: list[str], produced: str, make: Callable[..., DataFrame]) -> DataFrame:
        """Runs ``make`` on the inputs and keeps what it gives as ``produced``; a failure is noted and raised."""
        begun = time.monotonic()
        self._tell(name, "started", 0.0)
        used = {i: self._versions.get(i, 0) for i in inputs}
        try:
            made = self.put(produced, make(*[self.get(i) for i in inputs]))
            rows = made.count()
        except Exception as error:
            self._note(name, "failed", inputs, None, begun, None, str(error))
            raise
        self._made_from[produced] = used
        self._note(name, "done", inputs, produced, begun, rows, None)
        return made

    def _note(self, name: str, status: str, inputs: list[str], produced: str | None, begun: float, rows: int | None, error: str | None) -> None:
        seconds = time.monotonic() - begun
        self._history.append((len(self._history), name, status, inputs, produced, seconds, rows, error))
        self._tell(name, status, seconds)

    def _tell(self, *event: object) -> None:
        try:
            if self.observer:
                self.observer(event)
        except Exception:  # an observer must not stop the work
            pass

    def versions(self) -> dict[str, int]:
        return dict(self._versions)

    def stale(self, name: str) -> bool:
        """Whether a table it was made from, or one behind that, has a newer version."""
        return any(self._versions.get(i) != v or self.stale(i) for i, v in self._made_from.get(name, {}).items())

    def history(self) -> DataFrame:
        return self.spark.createDataFrame(self._history, _HISTORY)
