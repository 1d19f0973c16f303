"""Controllers over ordered samples, as folds of an array: averages, windows that grow and shrink, retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ewma(samples: Column, alpha: float = 0.2) -> Column:
    """An average that a first (or not positive) state takes over from the sample."""
    return F.aggregate(samples, F.lit(0.0), lambda a, x: F.when(a <= 0, x).otherwise(a * (1 - alpha) + x * alpha))


def next_net_window(window: Column, sample: Column, average: Column, floor: int, cap: int) -> Column:
    """A request window after one round trip: up by one to 1.25 times the average, down to 60 % above twice it, within floor and cap; kept while there is no average."""
    return (
        F.when(average <= 0, window).when(sample <= average * 1.25, F.least(F.lit(cap), window + 1))
        .when(sample > average * 2.0, F.greatest(F.lit(floor), F.floor(window * 0.6).cast("int"))).otherwise(window)
    )


def net_window(samples: Column, start: int, floor: int, cap: int) -> Column:
    """The window after samples of (rtt, average)."""
    return F.aggregate(samples, F.lit(start), lambda w, s: next_net_window(w, s["rtt"], s["average"], floor, cap))


def worker_cap(samples: Column, start: int, floor: int, cap: int) -> Column:
    """Workers: halved on a failure, one more when there is a backlog and all are busy. samples: (failed, backlog, busy)."""
    step = lambda w, s: F.when(s["failed"], F.greatest(F.lit(floor), F.floor(w / 2).cast("int"))).when(s["backlog"] & s["busy"], F.least(F.lit(cap), w + 1)).otherwise(w)
    return F.aggregate(samples, F.lit(start), step)


def stream_cap(samples: Column, start: int, floor: int = 4) -> Column:
    """Streams halve in a window of 200 or more with over 2 % failures. samples: (done, failed)."""
    step = lambda w, s: F.when((s["done"] >= 200) & (s["failed"] * 50 > s["done"]), F.greatest(F.lit(floor), F.floor(w / 2).cast("int"))).otherwise(w)
    return F.aggregate(samples, F.lit(start), step)


def retries(outcomes: Column, most: int = 3) -> Column:
    """State after the attempts: done, failed (more than `most` failures) or pending."""
    step = lambda s, ok: F.when(s >= 100, s).when(ok, F.lit(100)).otherwise(s + 1)
    return F.aggregate(outcomes, F.lit(0), step, lambda s: F.when(s >= 100, "done").when(s > most, "failed").otherwise("pending"))
