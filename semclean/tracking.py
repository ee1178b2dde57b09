"""Where runs, steps and scores are recorded."""

from __future__ import annotations

import time
import uuid
from abc import ABC, abstractmethod
from typing import Any

from pyspark.sql import SparkSession


class Tracker(ABC):
    """A back end for evaluation runs."""

    @abstractmethod
    def start_run(self, name: str, about: dict[str, Any]) -> str:
        """Begin a run; its id."""

    @abstractmethod
    def log_step(self, run: str, label: str, given: str, made: str, about: dict[str, Any]) -> None:
        """A step of a run."""

    @abstractmethod
    def log_score(self, run: str, measure: str, number: float, remark: str | None = None) -> None:
        """A number for a run."""

    @abstractmethod
    def end_run(self, run: str) -> None:
        """Write the run out."""


class ParquetTracker(Tracker):
    """One table (run_id, kind, name, input, output, value, note, at), a write per run."""

    SCHEMA = "run_id string, kind string, name string, input string, output string, value double, note string, at double"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.open: dict[str, list[tuple]] = {}

    def _add(self, run_id: str, kind: str, name: str, given: str | None = None, made: str | None = None, value: float | None = None, note: str | None = None) -> None:
        self.open[run_id].append((run_id, kind, name, given, made, value, note, time.time()))

    def start_run(self, name: str, about: dict[str, Any]) -> str:
        run_id = uuid.uuid4().hex
        self.open[run_id] = []
        self._add(run_id, "run", name, note=repr(about))
        return run_id

    def log_step(self, run: str, label: str, given: str, made: str, about: dict[str, Any]) -> None:
        self._add(run, "step", label, given, made, note=repr(about))

    def log_score(self, run: str, measure: str, number: float, remark: str | None = None) -> None:
        self._add(run, "score", measure, value=float(number), note=remark)

    def end_run(self, run: str) -> None:
        self.spark.createDataFrame(self.open.pop(run), self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


class LangfuseTracker(Tracker):
    """Records to Langfuse, if its client is installed."""

    def __init__(self, **client: Any) -> None:
        try:
            from langfuse import Langfuse
        except ImportError as why:
            raise ImportError("langfuse is not installed") from why
        self.client, self.traces = Langfuse(**client), {}

    def start_run(self, name: str, about: dict[str, Any]) -> str:
        trace = self.client.trace(metadata=about, name=name)
        self.traces[trace.id] = trace
        return trace.id

    def log_step(self, run: str, label: str, given: str, made: str, about: dict[str, Any]) -> None:
        self.traces[run].span(metadata=about, output=made, input=given, name=label).end()

    def log_score(self, run: str, measure: str, number: float, remark: str | None = None) -> None:
        self.client.score(comment=remark, value=number, name=measure, trace_id=run)

    def end_run(self, run: str) -> None:
        self.traces.pop(run, None)
        self.client.flush()
