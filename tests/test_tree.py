"""Trees on disk, snapshot guards and streaming."""

import os

import pytest
from pyspark.sql import functions as F

from driftwright.operators import compare as C
from driftwright.operators import planning as P
from driftwright.sources.tree import read_tree


def test_tree_keeps_hidden_empty_and_links(spark, tmp_path):
    for name, data in ((".h", b"1"), ("_u", b"22"), ("a/empty", b""), ("a/b/c", b"333")):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data)
    os.symlink(tmp_path / "_u", tmp_path / "link")
    os.symlink(tmp_path / "a", tmp_path / "dirlink")
    got = {r["path"]: (r["is_dir"], r["size"]) for r in read_tree(spark, str(tmp_path)).collect()}
    assert got == {".h": (False, 1), "_u": (False, 2), "a": (True, 0), "a/empty": (False, 0), "a/b": (True, 0), "a/b/c": (False, 3), "link": (False, 2), "dirlink": (True, 0)}


def test_times_keep_nanoseconds_and_self_compare_is_clean(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"x")
    os.utime(tmp_path / "f", ns=(1_700_000_000_123_456_789,) * 2)
    tree = read_tree(spark, str(tmp_path), content=True).withColumn("hash", F.md5("content"))
    assert tree.first()["mtime_raw"] == 1_700_000_000_123_456_789
    for mode in C.MODES:
        assert C.counters(C.compare(tree, tree, mode)).first()["verdict"] == 0


def test_undecided_rows_alone_are_hashed(spark):
    rows = lambda x: spark.createDataFrame(x, "path string, is_dir boolean, size long, mtime_raw long")
    remote, local = rows([("a", False, 3, 0), ("b", False, 5, 0), ("c", False, 1, 0)]), rows([("a", False, 3, 0), ("b", False, 9, 0), ("d", False, 1, 0), ("c", True, 0, 0)])
    seen = []

    def hashes(df):
        seen.extend(r["path"] for r in df.collect())
        return df.withColumns({"remote_hash": F.lit("x"), "local_hash": F.lit("x")})

    got = {r["path"]: r["category"] for r in C.compare(remote, local, "strict", hashes).collect()}
    assert got == {"a": "SAME", "b": "DIFF", "c": "MISSING", "d": "EXTRA"} and seen == ["a"]


def test_deleting_needs_a_complete_snapshot(spark):
    with pytest.raises(P.IncompleteSnapshot):
        P.delete_plan(spark.createDataFrame([("a",)], "path string"), snapshot_complete=False)


def test_deepest_counts_only_the_next_entry(spark):
    df = spark.createDataFrame([("r/a",), ("r/a-b",), ("r/a/c",)], "dir string")
    assert {r["dir"] for r in P.deepest(df).collect()} == {"r/a", "r/a-b", "r/a/c"}
