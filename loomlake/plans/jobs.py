"""Compositions in the background: one at a time for each mode, watched and cancelled by name."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark import InheritableThread
from pyspark.sql import SparkSession

IDLE, RUNNING, DONE, FAILED, CANCELLED = "idle", "running", "done", "failed", "cancelled"


@dataclass(frozen=True)
class State:
    """What is known of a job: at (the table at hand), done of total tables, seconds, error, and Spark's active stages."""

    status: str = IDLE
    at: str | None = None
    done: int = 0
    total: int = 0
    seconds: float = 0.0
    error: str | None = None
    stages: int = 0


class Jobs:
    """Jobs of a session by name. A job is a function of ``progress(at, done, total)``; its Spark jobs are one group."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._lock = threading.Lock()
        self._states: dict[str, State] = {}
        self._starts: dict[str, float] = {}
        self._threads: dict[str, InheritableThread] = {}
        self._results: dict[str, object] = {}

    def start(self, name: str, work: Callable[[Callable[[str, int, int], None]], object]) -> State:
        """Start work unless a job of that name runs; the state after that."""
        with self._lock:
            if self._states.get(name, State()).status == RUNNING:
                return self.state(name)
            self._states[name], self._starts[name] = State(RUNNING), time.monotonic()
            self._results.pop(name, None)
        thread = InheritableThread(target=lambda: self._run(name, work), session=self.spark)
        self._threads[name] = thread
        thread.start()
        return self.state(name)

    def _run(self, name: str, work) -> None:
        context = self.spark.sparkContext
        context.setJobGroup(self._group(name), f"composition {name}", interruptOnCancel=True)

        def progress(at: str, done: int, total: int) -> None:
            if self._states[name].status == CANCELLED:
                raise InterruptedError("cancelled")
            self._change(name, at=at, done=done, total=total)

        try:
            self._results[name] = work(progress)
            end = {"status": DONE, "done": self._states[name].total}
        except Exception as e:  # noqa: BLE001 - it is shown to whoever asks for the state
            end = {"status": FAILED, "error": f"{type(e).__name__}: {e}"}
        if self._states[name].status == CANCELLED:
            end = {}
        self._change(name, **end, seconds=time.monotonic() - self._starts[name])

    def _group(self, name: str) -> str:
        return f"loomlake-{id(self)}-{name}"

    def _change(self, name: str, **new) -> None:
        with self._lock:
            self._states[name] = replace(self._states[name], **new)

    def state(self, name: str) -> State:
        """The state of a job; of one that runs, also its seconds so far and the stages that Spark works on."""
        held = self._states.get(name, State())
        if held.status != RUNNING:
            return held
        tracker = self.spark.sparkContext.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(self._group(name))]
        stages = sum(len(j.stageIds) for j in jobs if j and j.status == "RUNNING")
        return replace(held, seconds=time.monotonic() - self._starts[name], stages=stages)

    def cancel(self, name: str) -> State:
        """Cancel a running job: its Spark jobs are stopped, and it makes no more of them."""
        if self._states.get(name, State()).status == RUNNING:
            self._change(name, status=CANCELLED)
            self.spark.sparkContext.cancelJobGroup(self._group(name))
        return self.state(name)

    def wait(self, name: str, seconds: float | None = None) -> State:
        if name in self._threads:
            self._threads[name].join(seconds)
        return self.state(name)

    def result(self, name: str):
        """What a finished job returned."""
        if self.state(name).status != DONE:
            raise RuntimeError(f"{name} is {self.state(name).status}")
        return self._results[name]
