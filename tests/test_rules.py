"""Rules and operators that the tables do not reach: bounds, odd inputs, files, and plain Python beside them."""

import ipaddress
import os
import random

import pytest
from pyspark.sql import functions as F

from driftwright.functions import scalars as S
from driftwright.operators import compare as C
from driftwright.operators import delta as D
from driftwright.operators import links as L
from driftwright.operators import metrics as M
from driftwright.operators import planning as P
from driftwright.operators import report as R
from driftwright.sources.tree import probe, read_ranges, read_tree
from driftwright.streaming import incremental, sessions


@pytest.fixture(scope="module")
def sample(spark):
    rows = [("DIFF", "a/diff.txt", 10, 20, True), ("MISSING", "a/missing.txt", None, 30, False), ("EXTRA", 'a/ex"tra\\\x01.txt', 40, None, False), ("SAME", "a/same.txt", 50, 50, False), ("SAME", "b", 1, 1, False)]
    return spark.createDataFrame(rows, "category string, path string, local_size long, remote_size long, hash_compared boolean")


def lines(df):
    return [r["line"] for r in df.orderBy("part", "path").collect()]


def test_text_report(sample, tmp_path):
    got = lines(R.text_report(sample, "fast", 5))
    assert got[0] == "Check completed. same=2 diff=1 missing=1 extra_local=1 total=4 mode=fast duration_ms=5"
    assert "[DIFF]    a/diff.txt  local=10 remote=20" in got and "[MISSING] a/missing.txt" in got and any(x.startswith("[EXTRA]   a/ex") for x in got) and len(got) == 4
    only = lines(R.text_report(sample, "fast", 5, partial=True, summary_only=True))
    assert only == ["[PARTIAL] Check incomplete. same=2 diff=1 missing=1 extra_local=1 total=4 mode=fast duration_ms=5"]
    assert [x[:6] for x in lines(R.text_report(sample, "fast", 5, categories=("SAME",)))[1:]] == ["[SAME]"] * 2
    shown = lines(R.write_report(sample, str(tmp_path / "r"), "fast", 5))
    assert shown == got[:1] and sample.sparkSession.read.text(str(tmp_path / "r")).count() == 4


@pytest.mark.parametrize("categories, n", [(R.DEFAULT_FILTER, 3), (("SAME",), 2), (("DIFF",), 1)])
def test_json_report_is_one_document(sample, categories, n):
    import json

    doc = json.loads("\n".join(lines(R.json_report(sample, "fast", 5, categories=categories))))
    assert doc["summary"] == {"same": 2, "diff": 1, "missing": 1, "extra_local": 1, "total_compared": 4, "mode": "fast", "duration_ms": 5, "partial": False}
    assert len(doc["differences"]) == n and all(set(x) == {"type", "path", "local_size", "remote_size", "hash_compared"} for x in doc["differences"])
    if n == 3:
        assert {x["path"] for x in doc["differences"]} == {"a/diff.txt", "a/missing.txt", 'a/ex"tra\\\x01.txt'}


def test_json_report_without_rows(sample):
    import json

    for df in (R.json_report(sample, "size", 0, summary_only=True), R.json_report(sample.filter("false"), "size", 0)):
        assert json.loads("\n".join(lines(df)))["differences"] == []


def test_projection_gate_refuses_at_the_bound(spark):
    rows = [(34, 100, 100, 100), (35, 100, 100, 100), (36, 100, 100, 100), (0, 0, 8000, 8000)]
    df = spark.createDataFrame(rows, "m long, s long, o long, n long")
    got = df.select(S.rejects_projection(*(F.col(c) for c in "mson")).alias("x")).collect()
    assert [r["x"] for r in got] == [True, True, False, False]


def test_log2_p95(spark):
    one = lambda xs: M.log2_p95(spark.createDataFrame([(x,) for x in xs], "x long"), "x").first()["p95_upper"]
    assert [one([]), one([0, 0]), one([1]), one([2, 3]), one([4]), one([1 << 40])] == [0, 2, 2, 4, 8, 1 << 31]
    assert one([0] * 95 + [1000] * 5) == 2 and one([0] * 94 + [1000] * 6) == 1024


def test_nearest_rank(spark):
    r = random.Random(4)
    for xs in ([7], [-5, 3], [r.randrange(-(1 << 40), 1 << 40) for _ in range(500)], [r.choice([1, 2, 1 << 50]) for _ in range(99)]):
        df = spark.createDataFrame([(x,) for x in [*xs, None]], "x long")
        want = {s: sorted(xs)[int(s * (len(xs) - 1) + 0.5)] for s in (0.5, 0.95, 0.99, 1.0)}
        assert {x["share"]: x["value"] for x in M.nearest_rank(df, "x").collect()} == want
    assert M.nearest_rank(df.filter("false"), "x").count() == 0


def test_deepest_follows_the_order_of_all_entries(spark):
    r = random.Random(9)
    for case in [["a", "a-b", "a/c"], ["a", "a/c"], [""], ["a", "ab", "a/b", "a/b/c"], sorted({"/".join(r.choices(["a", "a ", "a-", "b", "a.b"], k=r.randrange(1, 4))) for _ in range(60)})]:
        order = sorted(case, key=str.encode)
        want = {d for d, n in zip(order, [*order[1:], ""], strict=True) if not n.startswith(d + "/")}
        assert {x["dir"] for x in P.deepest(spark.createDataFrame([(d,) for d in case], "dir string")).collect()} == want


LANES = [
    ([(1, 5), (1, 2)], False, 1), ([(1, 3), (1, 3), (1, 3)], False, 0), ([(1, 8), (1, 7)], False, 1), ([(1, 8), (1, 8)], False, -1), ([(0, 0), (0, 0)], False, -1), ([(0, 0), (1, 4)], False, 1),
    ([(1, 6), (1, 0)], True, 0), ([(1, 8), (1, 0)], True, -1), ([(0, 0), (1, 5), (1, 1)], True, 2), ([(1, 2, 1.0, 1), (1, 2)], False, 1), ([(1, 2), (1, 2)], False, 0), ([(1, 2), (1, 3, 2.0)], False, 1), ([(1, 1, 3.0), (1, 1, 3.0 + 1e-12)], False, 0),
]


def test_lanes(spark):
    rows = [(g, i, bool(x[0]), x[1], *(x[2:3] or (1.0,)), *(x[3:4] or (0,)), f) for g, (lanes, f, _) in enumerate(LANES) for i, x in enumerate(lanes)]
    df = spark.createDataFrame(rows, "g long, lane long, healthy boolean, in_flight long, weight double, bias long, pin boolean")
    got = {x["g"]: x["lane"] for x in L.pick_lane(df, "g", stream_limit=8, force_primary=F.col("pin")).collect()}
    assert got == {g: want for g, (_, _, want) in enumerate(LANES)}


def test_ranges_go_to_the_least_loaded_lane(spark):
    r = random.Random(2)
    lanes = [(g, i, r.random() < 0.8, r.randrange(5), r.choice([0.5, 1.0, 2.0]), r.randrange(2)) for g in range(6) for i in range(r.randrange(1, 4))]
    ranges = [(g, f"f{r.randrange(3)}", k * 10) for g in range(7) for k in range(r.randrange(25))]
    got = P.range_lanes(spark.createDataFrame(ranges, "g long, path string, offset long"), spark.createDataFrame(lanes, "g long, lane long, healthy boolean, in_flight long, weight double, bias long"), "g", stream_limit=4).collect()
    want = []
    for g in range(7):
        load = {i: n for h, i, ok, n, _, _ in lanes if h == g and ok}
        rule = {i: (w, b) for h, i, _, _, w, b in lanes if h == g}
        for _, path, at in sorted(x for x in ranges if x[0] == g):
            free = [i for i in sorted(load) if load[i] < 4]
            if not free:
                break
            best = min(free, key=lambda i: ((load[i] + rule[i][1]) / rule[i][0], i))
            load[best] += 1
            want.append((g, path, at, best))
    assert sorted(map(tuple, got)) == sorted(want)


def test_many_lanes_take_many_ranges_in_time(spark):
    import heapq
    import threading

    r = random.Random(3)
    lanes = [(7, i, r.random() < 0.9, r.randrange(5), r.choice([0.5, 1.0, 3.0]), r.randrange(2)) for i in range(600)] + [(7, 600, True, 0, None, 0), (7, 601, True, 0, 1.0, None), (None, 602, True, 0, 1.0, 0), (8, 0, False, 0, 1.0, 0)]
    ranges = [(7, f"f{r.randrange(30)}", k) for k in range(4000)] + [(None, "f", 1), (8, "f", 1), (9, "f", 1)]
    queue = [((n + b) / w, i, n, w, b) for g, i, ok, n, w, b in lanes if g == 7 and ok and n < 6 and w is not None and b is not None]
    heapq.heapify(queue)
    want = []
    for _, path, at in sorted(x for x in ranges if x[0] == 7):
        if not queue:
            break
        _, i, n, w, b = heapq.heappop(queue)
        want.append((7, path, at, i))
        if n + 1 < 6:
            heapq.heappush(queue, ((n + 1 + b) / w, i, n + 1, w, b))
    assert 600 < len(want) < 4000
    limit = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    limit.start()
    try:
        got = P.range_lanes(spark.createDataFrame(ranges, "g long, path string, offset long"), spark.createDataFrame(lanes, "g long, lane long, healthy boolean, in_flight long, weight double, bias long"), "g", stream_limit=6).collect()
    finally:
        limit.cancel()
    assert sorted(map(tuple, got)) == sorted(want)


def test_groups_are_numbered_over_partitions(spark):
    r = random.Random(1)
    keep = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for groups in ([1], [1, 2, 3], [None, 1, 5], range(200), []):
            rows = [(g, r.randrange(1 << 40)) for g in groups for _ in range(r.randrange(1, 900 // len(groups)))]
            got = P.numbered_within(spark.createDataFrame(rows, "g long, x long").repartition(3), "g", ["x"], "n").collect()
            want = [(g, x, i + 1) for g in {g for g, _ in rows} - {None} for i, x in enumerate(sorted(x for h, x in rows if h == g))]
            assert sorted((y["g"], y["x"], y["n"]) for y in got) == sorted(want)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", keep)


def test_subnets(spark):
    r = random.Random(6)
    v4 = [str(ipaddress.ip_address(0x0A000000 + r.getrandbits(12))) for _ in range(40)]
    v6 = [str(ipaddress.ip_address((0x20010DB8 << 96) + (r.getrandbits(3) << 64) + r.getrandbits(2))) for _ in range(40)]
    rows = [(a, p, b) for k in (v4, v6) for a, b in zip(k[::2], k[1::2], strict=True) for p in (0, 1, 19, 23, 24, 25, 32, 63, 64, 65, 128, 200)] + [("1.2.3", 8, "1.2.3"), ("1.2.3.256", 8, "1.2.3.4"), ("", 8, "1.2.3.4"), (None, 8, "1.2.3.4"), ("1.2.3.4", 8, "::1"), ("1::2::3", 8, "1::2::3")]

    def want(a, p, b):
        try:
            x, y = ipaddress.ip_address(a), ipaddress.ip_address(b)
        except ValueError:
            return False
        if x.version != y.version:
            return False
        bits = p if 0 < p <= x.max_prefixlen else 24 if x.version == 4 else 64
        return int(x) >> (x.max_prefixlen - bits) == int(y) >> (x.max_prefixlen - bits)

    got = spark.createDataFrame(rows, "a string, p int, b string").select(S.same_subnet(F.col("a"), F.col("p"), F.col("b")).alias("x")).collect()
    assert [x["x"] for x in got] == [want(*x) for x in rows]


def test_files_are_probed_and_read_in_ranges(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"0123456789")
    (tmp_path / "d").mkdir()
    paths = spark.createDataFrame([("f",), ("d",), ("none",), (None,)], "path string")
    assert {x["path"]: (x["ok"], x["size"]) for x in probe(str(tmp_path), paths).collect()} == {"f": (True, 10), "d": (False, None), "none": (False, None), None: (False, None)}
    asked = [("f", 0, 10), ("f", 8, 2), ("f", 8, 3), ("f", 0, 0), ("f", -1, 2), ("f", (1 << 63) - 1, 1), ("none", 0, 1), (None, 0, 1)]
    got = read_ranges(str(tmp_path), spark.createDataFrame(asked, "path string, offset long, length long")).collect()
    assert [(x["data"], x["error"]) for x in got] == [(b"0123456789", None), (b"89", None), *[(None, "range")] * 4, (None, "unreadable"), (None, "range")]


def test_a_deep_tree_is_read_by_many_tasks(spark, tmp_path):
    for i in range(70):
        (tmp_path / "one" / "root" / f"d{i}" / "x").mkdir(parents=True)
        (tmp_path / "one" / "root" / f"d{i}" / "x" / "f").write_bytes(b"1")
    df = read_tree(spark, str(tmp_path))
    assert df.count() == 2 + 70 * 3 and df.rdd.getNumPartitions() > 64 and df.select("path").distinct().count() == df.count()


@pytest.mark.parametrize("size", [0, 1, 2, 2047, 2048, 2049, 4096, 5000])
def test_signatures(spark, size):
    data = random.Random(size).randbytes(size)
    df = spark.createDataFrame([("a", data, size), ("b", None, 0), ("c", b"xy", 3)], "path string, content binary, said long")
    got = D.signatures(df, "content", size="said").collect()
    mine = [(x["block_index"], x["weak"], bytes(x["strong"]), x["len"]) for x in got if x["path"] == "a"]
    assert mine == D.signature(data, D.choose_block_size(size)) and all(bytes(x["file_hash"]) == D.raw_hash(data) for x in got if x["path"] == "a")
    assert [(x["path"], x["error"]) for x in got if x["path"] != "a"] == [("b", "unreadable"), ("c", "size")]


def test_delta_plan_stops_early_and_says_why(spark):
    r = random.Random(5)
    old, new = r.randbytes(1 << 20), r.randbytes(1 << 20)
    rows = [("unlike", old, new), ("same", old, old), ("none", None, new), ("head", old, b"head" + old), ("empty", b"", b"")]
    got = {x["path"]: x for x in D.delta_plan(spark.createDataFrame(rows, "path string, old binary, new binary"), prefix=8192).collect()}
    assert got["unlike"]["stopped"] and got["unlike"]["download"] == 1 << 20 and got["unlike"]["scanned"] == 8192
    assert {p: x["fallback"] for p, x in got.items()} == {"unlike": "benefit", "same": None, "none": "old_unreadable", "head": None, "empty": "benefit"}
    assert all(x["verified"] for x in got.values())


def test_paths_and_hosts(spark):
    df = spark.createDataFrame([("a:80", "./././x"), ("a:0", "."), ("a:80x", ".x"), ("[::1]:99999", "a\\\\b"), ("[::1]x", "./"), ("::1", ""), (":5", "x")], "h string, p string")
    host, port = S.host_port(F.col("h"), 9)
    got = df.select(host.alias("host"), port.alias("port")).collect()
    assert [tuple(x) for x in got] == [("a", 80), ("a:0", 9), ("a", 80), ("::1", 9), ("::1", 9), ("::1", 9), ("", 5)]


def test_sessions_merge_over_many_spans(spark):
    r = random.Random(8)
    rows = [(i, a := r.randrange(0, 40_000), a + r.choice([0, 5, 60, 9000])) for i in range(60)]
    df = spark.createDataFrame(rows, "session_id long, a long, b long").selectExpr("session_id", "timestamp_seconds(a) AS start_ts", "timestamp_seconds(b) AS end_ts")
    want, reach = [], None
    for _, a, b in sorted(rows, key=lambda x: x[1:]):
        if reach is None or a > reach:
            want.append([a, b, 1])
        else:
            want[-1] = [want[-1][0], max(want[-1][1], b), want[-1][2] + 1]
        reach = max(reach or 0, b + 5)
    got = sessions.grouped_sessions(df, "5 seconds").selectExpr("unix_seconds(start_ts) a", "unix_seconds(end_ts) b", "sessions").collect()
    assert sorted(map(list, got)) == want


def test_extras_wait_for_the_end_of_the_manifest(spark, tmp_path):
    d = {n: str(tmp_path / n) for n in ("in", "out", "check")}
    put = lambda rows: spark.createDataFrame(rows, incremental.MANIFEST).coalesce(1).write.mode("append").parquet(d["in"])
    local = spark.createDataFrame([("a", False, 1, 0, "x"), ("b", False, 2, 0, "x"), ("z", False, 3, 0, "x")], "path string, is_dir boolean, size long, mtime_raw long, hash string")
    seen = lambda: sorted((x["path"], x["category"]) for x in incremental.compared_so_far(spark, d["out"]).collect())
    go = lambda: incremental.compare_arriving(spark, d["in"], local, d["out"], d["check"])
    put([("a", False, 1, 0, "x", False), ("c", False, 1, 0, "x", False)])
    assert not go() and seen() == [("a", "SAME"), ("c", "MISSING")]
    put([("b", False, 9, 0, "x", None), (None, None, None, None, None, True)])
    assert go() and go() and seen() == [("a", "SAME"), ("b", "DIFF"), ("c", "MISSING"), ("z", "EXTRA")]
    assert C.counters(incremental.compared_so_far(spark, d["out"])).first()["extra_local"] == 1


def test_unreadable_times_are_zero(tmp_path, spark):
    os.symlink(tmp_path / "gone", tmp_path / "broken")
    assert read_tree(spark, str(tmp_path)).count() == 0
