"""Long jobs on the driver: submitted, watched and cancelled, a bounded number at a time."""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# The states of a task.
PENDING, RUNNING, COMPLETED, FAILED, CANCELLED = "pending", "running", "completed", "failed", "cancelled"


class Tasks:
    """Jobs run in threads of their own, ``at_once`` at a time; the Spark jobs of each are a job group.

    A pending task that is cancelled never starts. Of a running one, the Spark
    jobs are stopped, and it ends as cancelled whatever it returns.
    """

    def __init__(self, spark: SparkSession, at_once: int = 1):
        self.spark, self.pool, self.lock = spark, ThreadPoolExecutor(at_once), threading.Lock()
        self.tasks: list[dict[str, Any]] = []

    def submit(self, name: str, job: Callable[[], Any]) -> int:
        with self.lock:
            task = {"task_id": len(self.tasks), "name": name, "state": PENDING, "error": None, "result": None}
            self.tasks.append(task)
        task["future"] = self.pool.submit(self._run, task, job)
        return task["task_id"]

    def _group(self, task_id: int) -> str:
        return f"corvid-task-{id(self)}-{task_id}"

    def _run(self, task: dict[str, Any], job: Callable[[], Any]) -> None:
        with self.lock:
            if task["state"] != PENDING:
                return
            task["state"] = RUNNING
        self.spark.sparkContext.setJobGroup(self._group(task["task_id"]), task["name"], interruptOnCancel=True)
        try:
            state, result, error = COMPLETED, job(), None
        except Exception as e:  # any failure of a job is its state
            state, result, error = FAILED, None, str(e)[:500]
        with self.lock:
            if task["state"] == RUNNING:
                task |= {"state": state, "result": result, "error": error}

    def cancel(self, task_id: int) -> bool:
        """Whether the task was pending or running, and is cancelled now."""
        with self.lock:
            task = self.tasks[task_id]
            was = task["state"]
            if was not in (PENDING, RUNNING):
                return False
            task["state"] = CANCELLED
        if was == RUNNING:
            # also the jobs that it has not begun; Python's cancelJobGroup stops active ones only
            self.spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(self._group(task_id))
        return True

    def wait(self, timeout: float | None = None) -> None:
        for task in list(self.tasks):
            task["future"].result(timeout)

    def states(self) -> DataFrame:
        """(task_id, name, state, error) of all tasks."""
        with self.lock:
            rows = [(t["task_id"], t["name"], t["state"], t["error"]) for t in self.tasks]
        return self.spark.createDataFrame(rows, "task_id int, name string, state string, error string")

    def close(self) -> None:
        self.pool.shutdown(wait=True)
