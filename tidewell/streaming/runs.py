"""D13 run registry: named stream runs with their status and exact row counts.

A ``RunRegistry`` listens to the session's streaming queries, so every
progress event is counted once, by batch, and nothing is polled. What a run
has committed is read from its checkpoint (``committed_offset``), which also
holds after the session has ended.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..sources.fixtures import path_exists


@dataclass
class Run:
    name: str
    run_id: str
    checkpoint: str | None = None
    status: str = "running"
    error: str | None = None
    rows: dict[int, int] = field(default_factory=dict)
    started: float = field(default_factory=time.time)
    ended: float | None = None
    done: threading.Event = field(default_factory=threading.Event)

    def summary(self) -> dict:
        # a copy first: the listener's thread may add a batch meanwhile
        rows = dict(self.rows)
        return {"name": self.name, "run_id": self.run_id, "status": self.status, "rows_produced": sum(rows.values()), "batches": len(rows),
                "error": self.error, "seconds": round((self.ended or time.time()) - self.started, 3)}


class RunRegistry(StreamingQueryListener):
    """Start, list, ask and stop runs of one session. A run is a query started through ``start``; its name is free to be
    used again once it has ended."""

    def __init__(self, spark: SparkSession):
        super().__init__()
        self.spark = spark
        self._runs: dict[str, Run] = {}
        self._queries: dict[str, StreamingQuery] = {}
        # events may come before ``start`` has the query in hand
        self._early: dict[str, list] = {}
        self._lock = threading.Lock()
        spark.streams.addListener(self)

    # --- events of the listener's thread
    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._take(str(p.runId), lambda run: run.rows.__setitem__(p.batchId, p.numInputRows))

    def onQueryTerminated(self, event) -> None:
        def end(run: Run) -> None:
            run.error = event.exception
            run.status = "error" if event.exception else ("stopped" if run.status == "stopping" else "completed")
            run.ended = time.time()
            run.done.set()
        self._take(str(event.runId), end)

    def _take(self, run_id: str, change: Callable[[Run], None]) -> None:
        with self._lock:
            if run_id in self._runs:
                change(self._runs[run_id])
            else:
                self._early.setdefault(run_id, []).append(change)

    # --- control
    def start(self, name: str, start: Callable[[], StreamingQuery], checkpoint: str | None = None) -> str:
        """Start a run by ``start()``; its run id. A name that a run in progress has is refused."""
        with self._lock:
            if any(r.name == name and not r.done.is_set() for r in self._runs.values()):
                raise ValueError(f"a run {name!r} is in progress")
        q = start()
        run_id = str(q.runId)
        with self._lock:
            self._runs[run_id] = run = Run(name, run_id, checkpoint)
            self._queries[run_id] = q
            for change in self._early.pop(run_id, []):
                change(run)
        return run_id

    def list(self) -> list[dict]:
        """All runs of this registry, the latest last."""
        with self._lock:
            return [r.summary() for r in self._runs.values()]

    def status(self, run_id: str) -> dict:
        with self._lock:
            if run_id not in self._runs:
                return {"run_id": run_id, "status": "not_found"}
            return self._runs[run_id].summary()

    def wait(self, run_id: str, seconds: float = 60.0) -> dict:
        """Wait until the run has ended and all its events have come."""
        self._queries[run_id].awaitTermination(seconds)
        self._runs[run_id].done.wait(seconds)
        return self.status(run_id)

    def stop(self, run_id: str, seconds: float = 60.0) -> dict:
        with self._lock:
            run = self._runs[run_id]
            if not run.done.is_set():
                run.status = "stopping"
        self._queries[run_id].stop()
        run.done.wait(seconds)
        return self.status(run_id)

    def close(self) -> None:
        self.spark.streams.removeListener(self)


def committed_offset(spark: SparkSession, checkpoint: str) -> tuple[int, dict | None]:
    """(last committed batch or -1, its end offset of the first source) from a query's checkpoint. For a generator the
    offset's ``offset`` is the number of rows that all its runs have committed."""
    if not path_exists(spark, f"{checkpoint}/commits"):
        return -1, None
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")  # noqa: SLF001 - Hadoop's file system
    names = [s.getPath().getName() for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]  # noqa: SLF001
    batches = [int(n) for n in names if n.isdigit()]
    if not batches:
        return -1, None
    # a log entry is a version line, the batch's metadata and one line for each source
    lines = spark.read.text(f"{checkpoint}/offsets/{max(batches)}", wholetext=True).first()["value"].splitlines()
    return max(batches), json.loads(lines[2])
