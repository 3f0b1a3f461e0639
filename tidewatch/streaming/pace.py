"""Publication by the clock: what is due goes out, what is late goes out at once, nothing is dropped.

A clock has ``now_us()`` and ``wait(until_us, stopped)``. Samples are due on an absolute schedule (``replay.published``), so a slow tick
delays none of those after it.
"""

from __future__ import annotations

import signal
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Clock(Protocol):
    def now_us(self) -> int: ...

    def wait(self, until_us: int, stopped: Callable[[], bool]) -> None: ...


class SystemClock:
    """The machine's clock. It naps for ``nap_s`` at most, so a stop is noticed soon."""

    nap_s = 0.2

    def now_us(self) -> int:
        return time.time_ns() // 1000

    def wait(self, until_us: int, stopped: Callable[[], bool]) -> None:
        while not stopped() and (left := until_us - self.now_us()) > 0:
            time.sleep(min(left / 1e6, self.nap_s))


@dataclass
class SimulatedClock:
    """A clock that is where it is told to wait for."""

    at_us: int = 0

    def now_us(self) -> int:
        return self.at_us

    def wait(self, until_us: int, stopped: Callable[[], bool]) -> None:
        self.at_us = max(self.at_us, until_us)


class Stop:
    """A request to end after what is being done: called, it tells whether there was one."""

    def __init__(self) -> None:
        self.asked = False

    def __call__(self) -> bool:
        return self.asked

    @contextmanager
    def on_signals(self) -> Iterator[Stop]:
        """SIGINT and SIGTERM ask; a second one interrupts."""

        def ask(number: int, frame: object) -> None:
            if self.asked:
                raise KeyboardInterrupt
            self.asked = True

        before = {s: signal.signal(s, ask) for s in (signal.SIGINT, signal.SIGTERM)}
        try:
            yield self
        finally:
            for s, handler in before.items():
                signal.signal(s, handler)


def ticks(stream: DataFrame, done: int, every: int, clock: Clock, stopped: Callable[[], bool]) -> Iterator[tuple[DataFrame, int, dict]]:
    """stream(place, wall_us, ts_us, rank, ...) -> (part, place before it, its last sample) when due, ``every`` samples at most.

    A part ends before the next wait, so whoever saves a position after each part has saved it before any wait. At the end of the stream,
    or after a stop, there are no more parts.
    """
    rest = stream.where(F.col("place") > done)
    while not stopped() and (first := rest.agg(F.min("wall_us")).first()[0]) is not None:
        clock.wait(first, stopped)
        if stopped():
            return
        part = rest.where((F.col("wall_us") <= clock.now_us()) & (F.col("place") <= done + every))
        last = part.agg(F.max("place").alias("place"), F.max_by(F.struct("ts_us", "rank"), "place").alias("at")).first()
        if last["place"] is None:  # the clock was set back meanwhile
            continue
        yield part, done, {"place": last["place"], "ts_us": last["at"]["ts_us"], "rank": last["at"]["rank"]}
        done = last["place"]
        rest = stream.where(F.col("place") > done)
