"""Sizes of transfers, pools and request pipelines by stream count, round trip and backlog, and the write-cap controller."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import div, long

KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30

# Fixed values of the round-trip rules.
WAN_RTT_MS, WAN_STREAMS, TARGET_BITS = 10, 16, 400_000_000
HASH_LEAST, HASH_LAN, HASH_WAN, SIG_WAN = 1024, 8192, 65536, 8192
FILE_MEAN, FILE_LEAST, FILE_MOST, DELTA_MEAN = 16 * KIB, 4 * KIB, MIB, 256 * KIB

# Fixed values of the write-cap controller.
CAP_START, CAP_LEAST, CAP_MOST = 8, 1, 32
GROW_LATENCY_FACTOR, GROW_LATENCY_NS, HALVE_LATENCY_NS, LEAST_RATE = 1.25, 30_000_000_000, 15_000_000_000, 20.0
HEALTHY_TO_GROW, PROTECTED_WINDOWS, COMPARE_LEAST = 2, 1, 4


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(long(low), F.least(long(high), x))


def chunk_size(streams: Column, configured: Column, auto: Column) -> Column:
    """Fewer streams carry larger chunks; a configured size holds if not auto; 64 KiB to 64 GiB."""
    ladder = F.when(streams <= 8, long(4 * MIB)).when(streams <= 16, long(2 * MIB)).when(streams <= 32, long(MIB)).when(streams <= 64, long(512 * KIB)).otherwise(long(256 * KIB))
    return clamp(F.when(auto, ladder).otherwise(configured), 64 * KIB, 64 * GIB)


def stream_limit(configured: Column, auto: Column) -> Column:
    return clamp(F.when(auto, long(4)).otherwise(configured), 1, 1024)


def effective_chunk(configured: Column, streams: Column) -> Column:
    """At least 1 MiB up to 16 streams and 512 KiB up to 32; whole pages of 4 KiB, one at least."""
    base = F.when(streams <= 16, F.greatest(configured, long(MIB))).when(streams <= 32, F.greatest(configured, long(512 * KIB))).otherwise(configured)
    return F.greatest(base - base % 4096, long(4096))


def flush_threshold(streams: Column, chunk: Column) -> Column:
    return F.when(streams <= 16, F.greatest(long(4 * MIB), chunk * 4)).when(streams <= 32, F.greatest(long(2 * MIB), chunk * 2)).otherwise(F.greatest(long(512 * KIB), chunk))


def write_pool(threads: Column) -> Column:
    return clamp(threads, CAP_START, CAP_MOST)


def server_hash_workers(configured: Column, threads: Column) -> Column:
    """Half the threads, two at least if there are two, 16 at most, unless configured."""
    hw = F.greatest(long(1), threads)
    auto = F.least(long(16), F.when(hw > 1, F.greatest(long(2), div(hw, 2))).otherwise(long(1)))
    return F.when(configured != 0, configured).otherwise(auto)


def most_hash_workers(configured: Column, threads: Column) -> Column:
    return F.when(configured == 0, threads).otherwise(F.greatest(configured, threads * 4))


def walk_workers(threads: Column) -> Column:
    return F.least(long(16), F.greatest(long(1), threads) * 2)


def files_in_flight(rtt_ms: Column, mean_bytes: Column) -> Column:
    """Files of the mean size that the target rate moves in one round trip, rounded up in thousandths (0: mean unknown)."""
    mean = clamp(F.when(mean_bytes != 0, mean_bytes).otherwise(long(FILE_MEAN)), FILE_LEAST, FILE_MOST)
    moved = F.lit(TARGET_BITS / 8.0) * (F.greatest(rtt_ms, long(1)).cast("double") / 1000.0)
    return F.floor(moved / mean.cast("double") + 0.999).cast("long")


def hash_depth(rtt_ms: Column, streams: Column, mean_bytes: Column) -> Column:
    """Hash requests in flight: 256 a stream on a near link, the round trip's worth of files on a far one."""
    near = clamp(F.greatest(long(HASH_LEAST), streams * 256), HASH_LEAST, HASH_LAN)
    floor = F.greatest(long(1), div(rtt_ms, WAN_RTT_MS)) * HASH_LAN
    far = clamp(F.greatest(streams * 256, files_in_flight(rtt_ms, mean_bytes), floor), HASH_LEAST, HASH_WAN)
    return F.when(rtt_ms > WAN_RTT_MS, far).otherwise(near)


def signature_depth(rtt_ms: Column, mean_bytes: Column) -> Column:
    """Delta signatures in flight; 0 (no bound) on a near link."""
    mean = F.when(mean_bytes != 0, mean_bytes).otherwise(long(DELTA_MEAN))
    depth = F.greatest(files_in_flight(rtt_ms, mean), F.greatest(long(1), div(rtt_ms, WAN_RTT_MS)) * 256, long(256))
    return F.when(rtt_ms > WAN_RTT_MS, clamp(depth, 1, SIG_WAN)).otherwise(long(0))


def wan_streams(rtt_ms: Column, base: Column, auto: Column, threads: Column) -> Column:
    """Streams on a far link if not configured: by round trip, 16 and twice the threads (4 at least) at most, never below the base."""
    by_rtt = F.when(rtt_ms <= 30, long(8)).when(rtt_ms <= 60, long(12)).otherwise(long(16))
    most = F.least(long(WAN_STREAMS), F.greatest(long(4), F.greatest(long(1), threads) * 2))
    return F.when(auto & (rtt_ms > WAN_RTT_MS), F.greatest(base, F.least(by_rtt, most))).otherwise(base)


def batch_tiers(backlog: Column, streams: Column) -> Column:
    """(threshold, max_files, max_bytes) of small batches: larger with the backlog, and with few streams."""
    tiers = [(backlog > 120_000, 5120, 20480, 960), (backlog > 60_000, 3840, 15360, 640), (backlog > 16_000, 2560, 10240, 480), (backlog < 1000, 1280, 5120, 200)]

    def pick(at: int, default: int, least: int, unit: int) -> Column:
        out = F.lit(None).cast("long")
        for rule in reversed(tiers):
            out = F.when(rule[0], long(rule[at] * unit)).otherwise(long(default * unit) if rule is tiers[-1] else out)
        return F.when(streams <= 8, F.greatest(out, long(least * unit))).otherwise(out)

    return F.struct(pick(1, 1920, 3200, KIB).alias("threshold"), pick(2, 7680, 12800, 1).alias("max_files"), pick(3, 320, 640, MIB).alias("max_bytes"))


def next_write_cap(state: Column, x: Column, capacity: Column, compare_workers: Column) -> Column:
    """The controller's state after one window: halved when things get worse, one more from the second healthy window, else kept.

    state: cap, healthy, rate, latency, have, reason, since, compare (the compare cap, which halves
    and grows along). x: backlog, in_flight, outstanding, budget, rate, latency, backpressure, failures.
    """
    most = F.greatest(F.lit(CAP_LEAST), F.least(F.lit(CAP_MOST), capacity.cast("int")))
    pressure = F.coalesce(F.try_add(x["in_flight"], x["outstanding"]), long((1 << 63) - 1))
    waiting = state["have"] & (x["backlog"] > 0)
    worse = (
        F.when(x["backpressure"], "halve_backpressure").when(pressure > x["budget"], "halve_budget")
        .when(waiting & (state["since"] >= PROTECTED_WINDOWS) & (x["rate"] < LEAST_RATE), "halve_rate_drop")
        .when(waiting & (state["latency"] > 0) & (x["latency"] > HALVE_LATENCY_NS), "halve_latency")
        .when(x["failures"] > 0, "halve_failure")
    )
    steady = ~state["have"] | ((x["rate"] >= state["rate"]) & ((state["latency"] <= 0) | (x["latency"] <= state["latency"] * GROW_LATENCY_FACTOR)))
    healthy = worse.isNull() & (x["backlog"] > state["cap"]) & steady & (x["latency"] < GROW_LATENCY_NS)
    streak = F.when(healthy, state["healthy"] + 1).otherwise(F.lit(0))
    grow = healthy & (streak >= HEALTHY_TO_GROW) & (state["cap"] < most)
    wanted = F.when(worse.isNotNull(), F.greatest(F.lit(CAP_LEAST), F.floor(state["cap"] / 2).cast("int"))).when(grow, state["cap"] + 1).otherwise(state["cap"])
    cap = F.greatest(F.lit(CAP_LEAST), F.least(most, wanted))
    compare = F.when(worse.isNotNull(), F.greatest(F.lit(COMPARE_LEAST), F.floor(state["compare"] / 2).cast("int"))).when(grow & (state["compare"] < compare_workers), state["compare"] + 1).otherwise(state["compare"])
    return F.struct(
        cap.alias("cap"), streak.alias("healthy"), x["rate"].alias("rate"), x["latency"].alias("latency"), F.lit(True).alias("have"), F.coalesce(worse, F.when(grow, "grow").otherwise("hold")).alias("reason"),
        F.when(cap != state["cap"], 0).otherwise(state["since"] + 1).alias("since"), compare.alias("compare"),
    )


def write_cap(samples: Column, capacity: Column, compare_workers: Column) -> Column:
    """The state after all windows, from the start."""
    start = F.struct(
        F.lit(CAP_START).alias("cap"), F.lit(0).alias("healthy"), F.lit(0.0).alias("rate"), F.lit(0.0).alias("latency"), F.lit(False).alias("have"), F.lit("init").alias("reason"), F.lit(0).alias("since"),
        compare_workers.cast("int").alias("compare"),
    )
    return F.aggregate(samples, start, lambda state, x: next_write_cap(state, x, capacity, compare_workers))
