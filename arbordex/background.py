"""Scans that run while their caller goes on."""

from __future__ import annotations

import threading
import time
from typing import Any

from pyspark import inheritable_thread_target

from arbordex.project import Project


class BackgroundScan:
    """A scan of a project in a thread, with a job group of its own, so that scans that run at once do not cancel each other. Each
    publishes its version; of two that take one number the second fails and says so in its run row."""

    def __init__(self, project: Project, **options):
        self.project = Project(project.spark, project.root, project.store.folder, project.skip)
        self.began, self.row, self.error = time.time(), None, ""
        self.thread = threading.Thread(target=inheritable_thread_target(project.spark)(lambda: self._run(options)), daemon=True)
        self.thread.start()

    def _run(self, options: dict[str, Any]) -> None:
        try:
            self.row = self.project.scan(**options).first()
        except Exception as e:  # the run row has it too
            self.error = str(e).split("\n")[0]

    def status(self) -> dict[str, Any]:
        """state (running, completed, cancelled or failed), generation (0 while it runs), tasks_done and tasks_known of the jobs begun so
        far, share of these that is done, seconds since it began while it runs, and the error."""
        tracker = self.project.spark.sparkContext.statusTracker()
        done = known = 0
        for job in tracker.getJobIdsForGroup(self.project.group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                if s := tracker.getStageInfo(stage):
                    done, known = done + s.numCompletedTasks, known + s.numTasks
        running = self.thread.is_alive()
        state = "running" if running else self.row["status"] if self.row else "failed"
        return {
            "state": state, "generation": 0 if running or not self.row else self.row["generation"], "tasks_done": done, "tasks_known": known,
            "share": done / known if known else 0.0, "seconds": time.time() - self.began if running else 0.0, "error": self.error,
        }

    def cancel(self) -> None:
        self.project.cancel()

    def wait(self, seconds: float | None = None) -> dict[str, Any]:
        self.thread.join(seconds)
        return self.status()


def start_scan(project: Project, **options) -> BackgroundScan:
    """Begin `project.scan(**options)` and return at once; `project` sees the new version when the scan has published it."""
    return BackgroundScan(project, **options)
