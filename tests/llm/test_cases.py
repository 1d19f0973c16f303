"""Each operator's odd rows (empty tables, nulls, repeats, clashing columns, very long texts) and brute force where SQL has no form."""

import hashlib
import json
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwright.llm import decontam, jaccard, langid, license, media, mixing, pii, registry, secrets, suffix, urls

DATA = "/root/testdata"
r = random.Random(17)
LONG = " ".join("".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(120_000))


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def test_empty_tables(spark):
    df = empty(spark)
    assert secrets.scan_secrets(df).count() == 0 and license.scan_licenses(df).count() == 0
    assert langid.identify_language(df, None).count() == 0 and langid.fit(df) is None
    sized = df.select("doc_id", F.array("source").alias("sources"), mixing.words(F.col("text")).alias("size"))
    assert mixing.mix_sources(sized, mixing.cycle_weights, size_col="size", sources_col="sources", order_cols=["doc_id"]).count() == 0
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), urls.RULES, spark.createDataFrame([], "c string")).count() == 0
    payload, n = media.padded(F.col("text"))
    folder = media.pack(df.select("doc_id", payload.alias("p"), n.alias("n")), key_col="doc_id", payload_col="p", length_col="n")
    assert media.features(media.read_media(spark, folder)).count() == 0


def test_queries_of_empty_tables(spark, tmp_path):
    for name, kinds in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("pages", "page_id long, url string, html string")):
        spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    assert {k: q(spark, str(tmp_path)).count() for k, q in registry.QUERIES.items()} == dict.fromkeys(registry.QUERIES, 0)


CLASH = ["held", "target", "_size", "source_size", "_order", "_bucket", "_given", "_before", "_first", "pattern", "place", "bucket", "before", "first", "capacity", "wants", "taken", "order0", "says", "_url", "url2", "host", "path", "rule", "verdict", "text_key", "spans", "more", "salt",
         "secrets", "licenses", "found", "lang_pred", "score", "n_bytes", "payload_sha256", "feature", "contaminated", "hits", "n_words"]


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


def _mixed(x):
    x = x.withColumn("sources", F.array("source")).withColumn("size", mixing.words(F.col("text")))
    return mixing.mix_sources(x, mixing.cycle_weights, size_col="size", sources_col="sources", order_cols=["doc_id"])


def _judged(x):
    pages = x.withColumn("url", F.concat(F.lit("http://h.example.net/en/"), "doc_id"))
    return urls.judge_urls(pages, urls.RULES, x.sparkSession.createDataFrame([("h.example.net/en/3",)], "c string"))


BESIDE = {
    "secrets": (secrets.scan_secrets, ["secrets"]),
    "pii": (pii.find_personal_data, ["spans"]),
    "licenses": (license.scan_licenses, ["licenses"]),
    "language": (lambda x: langid.identify_language(x, langid.train([(b"some words", "en"), (b"kala kolo", "fi")], steps=5)), ["lang_pred", "score"]),
    "decontamination": (lambda x: decontam.decontaminate(x, x.sparkSession.createDataFrame([(1, "some words number 3")], "item_id long, text string")), ["n_words", "hits", "contaminated"]),
    "jaccard": (jaccard.near_duplicates, ["n_shingles", "component_id"]),
    "suffix": (suffix.deduplicate, ["n_bytes", "kept_sha256", "spans"]),
    "mixing": (_mixed, ["source_size", "target", "taken"]),
    "urls": (_judged, ["host", "path", "rule", "verdict"]),
}


@pytest.mark.parametrize("name", BESIDE)
def test_clashing_columns(spark, name):
    """The same results beside columns that bear results' and helpers' names; those that stay keep their values."""
    run, results = BESIDE[name]
    rows = [(i, f"some words number {i} user{i}@mail.example.com db_pwd = 'Zx81-Qp77-Lm'", "en", "ab"[i % 2]) for i in range(6)] + [(None, None, None, None), (3, "", "en", "a"), (3, "", "en", "a")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(2)
    out = run(clashing(plain)).collect()
    assert sorted(str([x[c] for c in ("doc_id", *results)]) for x in run(plain).collect()) == sorted(str([x[c] for c in ("doc_id", *results)]) for x in out)
    assert all(x[c] == "clash" for x in out for c in CLASH if c in x.asDict() and c not in results)


def test_very_long_texts(spark):
    """A text of 700 kB between short ones: whole, by every operator."""
    marked = LONG + " last@mail.example.com db_pwd = 'Zx81-Qp77-Lm' Licensed under the Apache License, Version 2.0."
    rows = [(1, LONG), (2, marked), (3, "short text"), (4, LONG[:-40])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    at = len(LONG)
    found = {x["doc_id"]: [(s["kind"], s["start"]) for s in x["spans"]] for x in pii.find_personal_data(df).collect()}
    assert found == {1: [], 2: [("email", at + 1)], 3: [], 4: []}
    found = {x["doc_id"]: [s["kind"] for s in x["secrets"]] for x in secrets.scan_secrets(df).collect()}
    assert found == {1: [], 2: ["lexed"], 3: [], 4: []}
    found = {x["doc_id"]: x["component_id"] for x in jaccard.near_duplicates(df).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 1}
    found = {x["doc_id"]: x["n_removed"] for x in suffix.deduplicate(df).collect()}
    assert found == {1: 0, 2: at, 3: 0, 4: at - 40}
    payload, n = media.padded(F.col("text"))
    folder = media.pack(df.select("doc_id", payload.alias("p"), n.alias("n")), key_col="doc_id", payload_col="p", length_col="n")
    assert {x["member"]: x["n_bytes"] for x in media.features(media.read_media(spark, folder)).collect()} == {f"{d}.png": len(t) for d, t in rows}
    hit = decontam.decontaminate(df, spark.createDataFrame([(1, LONG[-200:].split(" ", 1)[1])], "item_id long, text string"))
    assert {x["doc_id"]: x["n_hit"] > 0 for x in hit.collect()} == {1: True, 2: True, 3: False, 4: True}


# --- media columns


def test_media_columns_follow_from_the_stored_bytes(spark):
    texts = [None, "", "a", "é" * 100, "x" * 191, "x" * 192, "x" * 193, "\x00\n" * 400] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    payload, n = media.padded(F.col("text"))
    folder = media.pack(df.select("doc_id", payload.alias("p"), n.alias("n")), key_col="doc_id", payload_col="p", length_col="n", archive_bytes=1500)
    stored = media.read_media(spark, folder, range_bytes=500)
    raw = {x["member"]: bytes(x["media"]) for x in stored.collect()}
    for x in media.features(stored).collect():
        got, pay = raw[x["member"]], (texts[int(x["member"][:-4])] or "").encode()
        pay = pay + b" " * (-len(pay) % 192 if pay else 192)
        assert got[:8] == b"\x89PNG\r\n\x1a\n" and media.decode(got)[0] == pay
        assert (x["media_bytes"], x["media_sha256"]) == (len(got), hashlib.sha256(got).hexdigest())
        assert (x["payload_bytes"], x["tail_crc32"], x["feature"]) == (len(pay), zlib.crc32(pay[-16:]), media.feature(pay))
        samples = np.frombuffer(pay, np.uint8).astype(np.int64)
        first, mean, spread = x["feature"].split(";")[:3]
        assert int(first) == len(pay) // 192 and int(mean) == int(samples.sum()) * 1000 // len(pay) and np.sqrt(max(0.0, samples.var() - 1)) * 1000 - 1 <= int(spread) <= samples.std() * 1000 + 1


def test_a_bad_member_is_tried_again_and_fails_alone(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(6)], "doc_id long, text string").coalesce(1)
    payload, n = media.padded(F.col("text"))
    folder = media.pack(df.select("doc_id", payload.alias("p"), n.alias("n")), key_col="doc_id", payload_col="p", length_col="n")
    reader, tried, read = media._Reader({"path": folder}), [], media.member_at

    def flaky(file, m):
        tried.append(m.filename)
        if m.filename == "2.png" and tried.count("2.png") < 2:
            raise OSError("gone for a moment")
        if m.filename == "4.png":
            raise ValueError("member differs from its checksum")
        return read(file, m)

    monkeypatch.setattr(media, "member_at", flaky)
    rows = [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
    assert len(rows) == 6 and {x["member"] for x in rows if x["error"]} == {"4.png"} and all(x["media"] for x in rows if not x["error"])
    assert tried.count("2.png") == 2 and tried.count("4.png") == reader.retries and tried.count("1.png") == 1


# --- personal data


def test_twenty_thousand_copies_of_a_text(spark):
    hot = "call +1 (243) 555-5526 or my address is nobody@localhost today, 4111 1111 1111 1111"
    seeds = [f"my address is user{i}@mail.example.com today" for i in range(6)]
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(hot).alias("text")).unionByName(spark.createDataFrame(list(enumerate(seeds, 50_000)), "doc_id long, text string"))
    got = pii.find_personal_data(df.repartition(7)).groupBy(pii.digest(F.col("spans")).alias("spans")).count().collect()
    want = sorted([*pii.brute_force(hot), ("context", hot.index("nobody"), hot.index("nobody") + 16)], key=lambda s: s[1])
    assert {x["spans"]: x["count"] for x in got}[",".join(f"{k}:{a}:{b}" for k, a, b in want)] == 20_000


@pytest.mark.parametrize("most", [0, 10**6])
def test_context_spans_by_broadcast_or_salted_join(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "MOST_TEXTS", most)
    texts = [f"my address is user{i}@mail.example.com today" for i in range(6)] + ["my address is a.nobody@localhost today"] * 40 + [None, "", "12345 678"]
    got = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(texts) and all([s["kind"] for s in x["spans"]] == (["email"] if x["doc_id"] < 6 else ["context"] if x["doc_id"] < 46 else []) for x in got)


def test_matches_of_a_text_with_very_many(spark):
    text = " ".join(f"u{i}@a{i}.example.com 10.{i % 300}.2.3" for i in range(300))
    got = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(pii.digest(F.col("spans")).alias("s")).first()["s"]
    assert [x for x in got.split(",") if not x.startswith("context")] == [f"{k}:{a}:{b}" for k, a, b in pii.brute_force(text)]


# --- similarity join


def points_of(sets):
    words = [[f"w{x}" for x in s] for s in sets]
    import pyarrow as pa

    made = jaccard.Sets(jaccard.Words(pa.array([" ".join(w) for w in words]), jaccard.NONSPACE), 1)
    return made, made.packed(made.groups()), made.fine(made.groups())


def test_bounds_are_never_below_the_overlap():
    q = random.Random(3)
    base = q.sample(range(10**6), 3000)
    sets = [set(q.sample(base, q.choice([1, 5, 60, 400, 2500]))) for _ in range(60)]
    made, vecs, fine = points_of(sets)
    p = jaccard.Points(made.n, vecs.to_pylist())
    i, j = (np.array(x) for x in zip(*[(a, b) for a in range(60) for b in range(a)], strict=True))
    overlap = np.array([len(sets[a] & sets[b]) for a, b in zip(i, j, strict=True)])
    near = abs(p.cls[i] - p.cls[j]) <= 1
    assert (p.bound(i, j)[near] >= overlap[near]).all() and near.sum() > 500 and (4 * np.minimum(made.n[i], made.n[j]) < 3 * np.maximum(made.n[i], made.n[j]))[~near].all()
    import pyarrow as pa

    assert (jaccard.fine_bounds(fine.take(pa.array(i)), fine.take(pa.array(j))) >= overlap).all()


@pytest.mark.parametrize("two", [False, True])
def test_tree_join_finds_every_pair_that_the_bound_lets_through(two):
    q = random.Random(5)
    cores = [q.sample(range(10**6), n) for n in (40, 40, 200, 560, 900)]
    sets = []
    for _ in range(700):
        core = q.choice(cores)
        sets.append({*q.sample(core, len(core) * q.randrange(60, 101) // 100), *q.sample(range(10**6), q.randrange(len(core) // 4))})
    made, vecs, _ = points_of(sets)
    n, p = made.n, jaccard.Points(made.n, vecs.to_pylist())
    label = np.array([q.randrange(400) for _ in sets])
    side = np.array([q.randrange(2) if two else 0 for _ in sets])
    group = (np.sort(np.array([q.choice([0, 0, 0, q.randrange(1, 60)]) for _ in sets])),)  # a tall cell and small ones
    found = list(jaccard._trees(p, np.arange(len(sets)), label, group, side, 75))
    got = [(min(a, b), max(a, b), int(c)) for i, j, bound in found for a, b, c in zip(i.tolist(), j.tolist(), bound, strict=True)]
    want, cross = [], 0
    for a in range(len(sets)):
        b = np.arange(a + 1, len(sets))
        bound = p.bound(np.full(len(b), a), b)
        ok = (bound >= jaccard.overlap_needed(n[a], n[b])) & (label[a] != label[b]) & (100 * np.minimum(n[a], n[b]) >= 75 * np.maximum(n[a], n[b])) & (group[0][a] == group[0][b])
        ok &= (side[a] != side[b]) | (not two or side[group[0] == group[0][a]].max() == 0)
        want += [(a, int(x), int(c)) for x, c in zip(b[ok], bound[ok], strict=True)]
        cross += int((p.cls[b[ok]] != p.cls[a]).sum())
    assert sorted(got) == want and len(want) > 1000 and cross > 20


def test_hot_cells_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SPLIT", 20)
    monkeypatch.setattr(jaccard, "RUN_BYTES", 5000)
    q = random.Random(7)
    base = q.choices([f"v{i}" for i in range(200)], k=60)
    texts = []
    for _ in range(160):  # one group whose members are near the threshold from each other
        w = list(base)
        for at in q.sample(range(60), q.choice([0, 1, 1, 2, 2, 3])):
            w[at] = f"edit{q.randrange(1000)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts + [" ".join(q.choices(base, k=50)) for _ in range(30)]))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == jaccard.brute_force(rows)


# --- mixing


def brute_mix(rows, seed="mix-1"):
    """(id, source, size) -> {id: (source_size, target, taken)} in plain Python, one source a row."""
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for _, x, n in rows if x == s) for s in names}
    wanted = mixing.targets(sizes, mixing.cycle_weights(names))
    whole = mixing._whole(wanted)
    out = {}
    for s in names:
        mine = sorted((hashlib.md5(f"{seed}|{d}".encode()).hexdigest(), d, n) for d, x, n in rows if x == s)
        times, rest = divmod(whole[s], sizes[s]) if sizes[s] else (0, 0)
        before = 0
        for _, d, n in mine:
            out[d] = (sizes[s], float(wanted[s]), times * n + max(0, min(n, rest - before)))
            before += n
    return out


def test_mixing_against_plain_python(spark):
    q = random.Random(2)
    rows = [(i, q.choice(["a", "b", "B", "ä", None, "only"] if i else ["none"]), q.choice([0, 1, 7, 400]) if i else 0) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("sources", F.array("source")).repartition(4)
    mix = lambda x: mixing.mix_sources(x, mixing.cycle_weights, size_col="size", sources_col="sources", order_cols=["doc_id"])
    got = {x["doc_id"]: (x["source_size"], x["target"], x["taken"]) for x in mix(df).collect()}
    assert got == brute_mix(rows) and got == {x["doc_id"]: (x["source_size"], x["target"], x["taken"]) for x in mix(df.repartition(3)).collect()}
    assert all(taken <= 3 * n for (_, _, n), (_, _, taken) in zip(rows, (got[d] for d, _, _ in rows), strict=True))


def test_mixing_null_sizes_and_overlapping_sources(spark):
    rows = [(1, ["a"], 10), (2, ["a", "b"], 10), (3, ["b"], None), (4, None, 5), (5, ["b", "a", "a"], 10)]
    got = {x["doc_id"]: x["taken"] for x in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, sources array<string>, size long"), lambda s: dict.fromkeys(s, 1), size_col="size", sources_col="sources", order_cols=["doc_id"]).collect()}
    assert got[3] == 0 and all(0 <= got[d] <= 3 * (n or 0) for d, _, n in rows) and sum(got.values()) > 0


# --- secrets


def plain_secrets(text):
    out = []
    for kind, pattern, least in (("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", None), ("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)):
        for m in re.finditer(pattern, text or "", re.I | re.A if kind == "assign" else 0):
            if len(m[2] if kind == "assign" else m[0]) >= (least or 6):
                out.append((kind, *m.span()))
    return out


def test_secrets_against_the_plain_patterns(spark):
    q = random.Random(4)
    bits = ["password", "API_KEY", "apikey", "token", "secret", "passwd", '"', "'", " ", "  ", ":", "=", "abcdef", "abc", "AKIA" + "A1" * 9, "AKIA" + "A" * 15, "deadbeef" * 3, "0123456789abcdef0123456", "\n", "é", "key", "db_pwd", "Zx81-Qp77-Lm", ";", ":="]
    rows = [(i, "".join(q.choices(bits, k=q.randrange(0, 40)))) for i in range(400)] + [(400, None), (401, ""), (401, "")]
    got = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    for x in got:
        base = [(s["kind"], s["start"], s["end"]) for s in x["secrets"] if s["kind"] != "lexed"]
        order = ("assign", "access", "hex")
        assert base == sorted(plain_secrets(x["text"]), key=lambda s: (s[1], order.index(s[0])))
        covered = [(a, b) for _, a, b in base]
        assert all(not any(a <= s["start"] and s["end"] <= b for a, b in covered) for s in x["secrets"] if s["kind"] == "lexed")


def test_secrets_of_a_long_text_with_many_assignments(spark):
    text = "\n".join(f"password = hunter{i}xyz; login_pwd = 'Q{i}w8-Rt55-Yz'" for i in range(4000))
    got = secrets.scan(text)
    assert sum(k == "assign" for k, _, _ in got) == 4000 and sum(k == "lexed" for k, _, _ in got) == 4000


# --- language


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_held_out_accuracy_of_each_language(spark, sf):
    if not os.path.isdir(f"{DATA}/{sf}"):
        pytest.skip("no tables")
    found = registry.QUERIES["op10_language"](spark, f"{DATA}/{sf}")
    docs = spark.read.parquet(f"{DATA}/{sf}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").filter("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right")).collect()
    print(sf, {x["lang"]: round(x["right"], 3) for x in rows})
    assert len(rows) == 4 and all(x["right"] >= 0.95 for x in rows)


def test_language_of_repeated_and_long_rows(spark):
    words = {"xx": ["kala", "kolo", "malo"], "yy": ["tri", "bri", "strit"]}
    rows = [(i % 30, " ".join(r.choices(words[k], k=30)), k) for i in range(60) for k in words] + [(77, " ".join(words["yy"]) * 20_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify_language(df, langid.fit(df)).collect()
    assert len(got) == len(rows) and all(x["lang_pred"] == (x["lang"] or "yy") for x in got)
    assert json.dumps(sorted({(x["text"], x["score"]) for x in got})) and len({x["text"] for x in got}) == len({(x["text"], x["lang_pred"]) for x in got})
