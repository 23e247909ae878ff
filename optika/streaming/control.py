"""Run control of a scoring job: batches that halve, a bounded window of requests, retries, breakers, locks."""

from __future__ import annotations

import os
import random
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

RETRYABLE = (408, 409, 425, 429, 500, 502, 503, 504)
FATAL = (400, 401, 402, 403, 404, 405, 422)


class Failure(Exception):
    """A request that failed, with its HTTP status and what the server says about trying again."""

    def __init__(self, message: str, status: int | None = None, retry_after: float | None = None):
        super().__init__(message)
        self.status, self.retry_after = status, retry_after

    @property
    def retryable(self) -> bool:
        return self.status is None or self.status in RETRYABLE

    @property
    def fatal(self) -> bool:
        return self.status in FATAL


def backoff_seconds(attempt: int, retry_after: float | None = None, cap: float = 60.0, jitter: float = 0.0) -> float:
    """Seconds to wait before a retry: what the server asks for, at most ``cap``, else doubling up to half of it, with
    the jitter added."""
    if retry_after is not None:
        return min(cap, max(0.0, retry_after))
    return min(cap / 2, 2.0 ** (attempt + 1)) + jitter


def with_retries(call: Callable, retries: int = 5, sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None):
    """The result of ``call``; failures that may pass are tried again, the last one is raised."""
    rng = rng or random.Random()
    for attempt in range(retries + 1):
        try:
            return call()
        except Failure as e:
            if e.fatal or not e.retryable or attempt == retries:
                raise
            sleep(backoff_seconds(attempt, e.retry_after, jitter=rng.random()))


def in_batches(rows: list, score: Callable[[list], list], size: int, too_large: type[BaseException] = MemoryError) -> Iterator:
    """Scores rows in batches; a batch that does not fit is halved, down to single rows, and its size is kept from then on."""
    todo = deque(rows)
    while todo:
        batch = [todo.popleft() for _ in range(min(size, len(todo)))]
        try:
            yield from score(batch)
        except too_large:
            if len(batch) == 1:
                raise
            todo.extendleft(reversed(batch))
            size = len(batch) // 2


class Breaker:
    """Stops a run after so many errors in a row: at least 20, at least one for each worker."""

    def __init__(self, workers: int, least: int = 20):
        self.limit, self.errors, self.stop = max(least, workers), 0, threading.Event()

    def record(self, ok: bool) -> None:
        self.errors = 0 if ok else self.errors + 1
        if self.errors >= self.limit:
            self.stop.set()


def bounded(rows: Iterable, call: Callable, workers: int, preflight: bool = True, ok: Callable[[object], bool] = lambda x: True) -> Iterator:
    """Results of ``call`` for rows, at most ``workers`` of them under way at once, in the order in which they end.

    The first row goes alone: if it fails, nothing else is asked.  A fatal failure, or the breaker, ends the run once what
    is under way has ended; its results are still given."""
    rows, breaker = iter(rows), Breaker(workers)
    if preflight:
        first = next(rows, None)
        if first is None:
            return
        out = call(first)
        yield out
        if not ok(out):
            return
    with ThreadPoolExecutor(workers) as pool:
        running, error = set(), None
        while True:
            while len(running) < workers and not breaker.stop.is_set():
                try:
                    running.add(pool.submit(call, next(rows)))
                except StopIteration:
                    break
            if not running:
                break
            done, running = wait(running, return_when=FIRST_COMPLETED)
            for future in done:
                try:
                    out = future.result()
                except Failure as e:
                    breaker.record(False)
                    if e.fatal:
                        breaker.stop.set()
                    error = e
                    continue
                breaker.record(ok(out))
                yield out
        if error is not None and breaker.stop.is_set():
            raise error


class WriterLock:
    """A file that one writer of an output holds; a second one is refused.  The file names the holder."""

    def __init__(self, path: str):
        self.path = f"{path}.lock"

    def __enter__(self) -> WriterLock:
        try:
            fd = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            with open(self.path) as f:
                raise RuntimeError(f"{self.path} is held by process {f.read().strip() or '?'}") from None
        with os.fdopen(fd, "w") as f:
            f.write(str(os.getpid()))
        return self

    def __exit__(self, *_: object) -> None:
        os.remove(self.path)


def scorer(call: Callable[[dict], dict], schema: str, workers: int = 8, retries: int = 5):
    """A partition function for mapInPandas that asks for each row with retries, inside a bounded window; failures become
    rows with status error."""
    import pandas as pd

    def one(row: dict) -> dict:
        try:
            return {**row, **with_retries(lambda: call(row), retries), "status": "ok"}
        except Failure as e:
            return {**row, "status": "error", "error": str(e)[:1600]}

    names = [c.split()[0] for c in schema.split(",")]

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            rows = list(bounded(frame.to_dict("records"), one, workers, preflight=False, ok=lambda r: r["status"] == "ok"))
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in names})

    return run
