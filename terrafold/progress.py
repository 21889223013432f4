"""Progress of an extract as a text bar or as JSON lines, and a timer."""

from __future__ import annotations

import contextlib
import json
import sys
import threading
import time
from collections.abc import Iterator


class Progress:
    """Totals and progress of cells, nodes and elements; steps of less than a hundredth aren't shown."""

    KEYS = ("Cells", "Nodes", "Elems")

    def __init__(self, as_json: bool = False, out=None):
        self.as_json, self.out = as_json, out or sys.stdout
        self.total, self.done, self.shown = dict.fromkeys(self.KEYS, 0), dict.fromkeys(self.KEYS, 0), dict.fromkeys(self.KEYS, -1.0)

    def start(self, what: str, total: int) -> None:
        self.total[what] = total
        self.step(what, 0)

    def step(self, what: str, done: int) -> None:
        self.done[what] = done
        part = done / self.total[what] if self.total[what] else 1.0
        if part < 1 and part - self.shown[what] < 0.01:
            return
        self.shown[what] = part
        if self.as_json:
            row = {"Timestamp": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
            for k in self.KEYS:
                row |= {f"{k}Total": self.total[k], f"{k}Prog": self.done[k]}
            print(json.dumps(row), file=self.out, flush=True)
        else:
            print(f"\r{what}: [{'=' * int(part * 40):<40}] {part:4.0%}", end="\n" if part >= 1 else "", file=self.out, flush=True)


    @contextlib.contextmanager
    def watch(self, spark, *what: str, every: float = 0.5) -> Iterator[None]:
        """Steps in proportion to the finished tasks of the jobs that run inside; all of it is done at the end."""
        tracker, over = spark.sparkContext.statusTracker(), threading.Event()

        def look() -> None:
            while not over.wait(every):
                found = [tracker.getStageInfo(i) for i in tracker.getActiveStageIds()]
                total = sum(s.numTasks for s in found if s)
                done = sum(s.numCompletedTasks for s in found if s)
                for k in what:
                    if total and (n := self.total[k] * done // total) > self.done[k]:
                        self.step(k, n)

        side = threading.Thread(target=look, daemon=True)
        side.start()
        try:
            yield
        finally:
            over.set()
            side.join()
        for k in what:
            self.step(k, self.total[k])


@contextlib.contextmanager
def timed(what: str, out=None) -> Iterator[None]:
    began = time.monotonic()
    yield
    print(f"{what}: {time.monotonic() - began:.1f} s", file=out or sys.stderr)
