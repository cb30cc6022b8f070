"""Samples of a run's memory and progress, and an envelope that ends it before memory runs out."""

from __future__ import annotations

import json
import os
import threading
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession

from .validate import Violation

GIB = 2.0**30
ORDER = ("GREEN", "YELLOW", "RED", "EMERGENCY")


@dataclass(frozen=True)
class Envelope:
    """Least memory available and most swap added, in GiB, from which on each level holds, and the most of a process."""

    available: tuple[float, float, float] = (8.0, 5.0, 4.0)
    swap_added: tuple[float, float, float] = (0.125, 0.5, 1.0)
    own: float = 6.0

    def level(self, available: float, swap_added: float, own: float) -> tuple[str, list[str]]:
        """The worst level that any number calls for, and what calls for it."""
        worst, why = 0, []
        for k, (least, most) in enumerate(zip(self.available, self.swap_added, strict=True), 1):
            for bad, text in ((available < least, f"{available:.2f} GiB available, below {least}"), (swap_added >= most, f"{swap_added:.2f} GiB swap added, {most} or more")):
                if bad:
                    worst = max(worst, k)
                    why.append(text)
        if own > self.own:
            worst = max(worst, 2)
            why.append(f"{own:.2f} GiB in this process, above {self.own}")
        return ORDER[worst], why


@dataclass(frozen=True)
class Sample:
    seconds: float
    rows: int
    available: float
    swap_used: float
    own: float
    level: str


def read_memory() -> tuple[float, float, float]:
    """GiB available, of swap in use, and of this process; on systems without /proc nothing is known and all is well."""
    try:
        with open("/proc/meminfo") as f:
            kib = {k: float(v.split()[0]) for k, v in (line.split(":", 1) for line in f)}
        with open("/proc/self/statm") as f:
            own = int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    except OSError:
        return float("inf"), 0.0, 0.0
    return kib["MemAvailable"] * 1024 / GIB, (kib.get("SwapTotal", 0) - kib.get("SwapFree", 0)) * 1024 / GIB, own / GIB


class Telemetry:
    """Samples every ``interval`` seconds while open. At RED or worse it cancels the session's jobs, if ``abort``, and closing raises.

    ``rows`` says how many rows are done; it is asked at each sample. Executors' memory is bounded by their own settings; this watches
    the driver's host. ``log``: a local file for all samples, beside it ``.latest``. At most ``most`` samples are kept: then every other one goes and the interval doubles, so extremes stay of the whole run.
    """

    def __init__(self, spark: SparkSession | None = None, interval: float = 10.0, envelope: Envelope | None = None, abort: bool = True, rows: Callable[[], int] = lambda: 0, read: Callable[[], tuple[float, float, float]] = read_memory, most: int = 4096, log: str | None = None) -> None:
        self.log = log
        self.spark, self.interval, self.envelope, self.abort, self.rows, self.read, self.most = spark, interval, envelope or Envelope(), abort, rows, read, most
        self.samples: list[Sample] = []
        self.taken, self.worst, self.least_available, self.most_own, self.reason = 0, "GREEN", float("inf"), 0.0, None
        self._end, self._began, self._swap = threading.Event(), time.monotonic(), 0.0

    def sample(self) -> Sample:
        available, swap, own = self.read()
        if not self.taken:
            self._swap = swap
        level, why = self.envelope.level(available, swap - self._swap, own)
        one = Sample(round(time.monotonic() - self._began, 3), self.rows(), available, swap, own, level)
        self.taken += 1
        self.worst = max(self.worst, level, key=ORDER.index)
        self.least_available, self.most_own = min(self.least_available, available), max(self.most_own, own)
        self.samples.append(one)
        self._write(one)
        if len(self.samples) > self.most:
            self.samples, self.interval = self.samples[::2], self.interval * 2
        if self.abort and ORDER.index(level) >= 2 and self.reason is None:
            self.reason = f"{level}: {'; '.join(why)}"
            if self.spark is not None:
                self.spark.sparkContext.cancelAllJobs()
        return one

    def _write(self, one: Sample) -> None:
        """The sample as a line of the log, and as the latest file, which is replaced at once."""
        if self.log:
            line = json.dumps(asdict(one), sort_keys=True)
            with open(self.log, "a", encoding="utf-8") as f:
                f.write(line + "\n")
            with open(f"{self.log}.latest.partial", "w", encoding="utf-8") as f:
                f.write(line)
            os.replace(f"{self.log}.latest.partial", f"{self.log}.latest")

    def _watch(self) -> None:
        while not self._end.wait(self.interval):
            self.sample()

    def __enter__(self) -> Telemetry:
        self._began = time.monotonic()
        self.sample()
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, kind: object, *_: object) -> None:
        self._end.set()
        self._thread.join()
        self.sample()
        if self.reason:
            raise Violation(self.reason)

    def summary(self) -> dict:
        """Extremes, mean rate, worst level, and whether sampling was periodic: a start and an end alone are not."""
        last = self.samples[-1] if self.samples else None
        rate = last.rows / last.seconds if last and last.seconds > 0 and last.rows else None
        return {
            "samples": self.taken, "periodic": self.taken >= 3, "seconds": last.seconds if last else 0.0, "rows": last.rows if last else 0, "rows_per_second": rate,
            "least_available_gib": self.least_available, "most_own_gib": self.most_own, "worst_level": self.worst, "aborted_because": self.reason, "last": asdict(last) if last else None,
        }
