"""Corpus operators: brute force, round trips and odd rows (nulls, empty, repeated, clashing columns)."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from driftwright.llm import decontam, jaccard, langid, license, media, mixing, pii, secrets, suffix, urls

r = random.Random(5)
VOCABULARY = ["".join(r.choices("abcdefg", k=r.randrange(2, 8))) for _ in range(60)]
PASSAGE = " ".join(r.choices(VOCABULARY, k=40))


def texts():
    out = [None, "", " \n ", "one", "a b c", PASSAGE, PASSAGE, PASSAGE + " x", "Z " + PASSAGE.upper(), "é" * 80, "é" * 81, "0" * 300]
    out += [" ".join(r.choices(VOCABULARY, k=r.randrange(1, 90))) for _ in range(25)]
    out += [" ".join(r.choices(VOCABULARY, k=20)) + " " + PASSAGE[30:180] for _ in range(8)]
    base = r.choices(VOCABULARY, k=60)
    for _ in range(10):
        w = list(base)
        w[r.randrange(60)] = "edit"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(texts()))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_media_round_trip(spark, docs, rows):
    payload, n = media.padded(F.col("text"))
    folder = media.pack(docs.select("doc_id", payload.alias("p"), n.alias("n")), key_col="doc_id", payload_col="p", length_col="n", archive_bytes=2000)
    got = {x["member"]: x for x in media.features(media.read_media(spark, folder, range_bytes=700)).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        raw = (t or "").encode()
        want = raw + b" " * (-len(raw) % 192 if raw else 192)
        x = got[f"{d}.png"]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"], x["error"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]), None)


def test_personal_data(spark, rows):
    odd = ["a@b.c_x@d.e", "1.2.3.4.5", "999.1.1.1 1.1.1.0000255", "+1 (243) 555-5526 4111 1111 1111 1111", "x 4111-1111-1111-1111 y", "1" * 3000, "+1" + " " * 500, "é@é.com ü+49 30 1234567-", None, ""]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(odd)], "doc_id long, text string, spans string")
    got = {x["doc_id"]: x["s"] for x in pii.find_personal_data(df).select("doc_id", pii.digest(F.col("spans")).alias("s")).collect()}
    assert got == {i: ",".join(f"{k}:{a}:{b}" for k, a, b in pii.brute_force(t)) for i, t in enumerate(odd)}


def test_context_discovers(spark):
    seeds = [f"my address is user{i}@mail.example.com today" for i in range(6)]
    df = spark.createDataFrame([*enumerate(seeds), (99, "my address is someone@localhost today")], "doc_id long, text string")
    got = {x["doc_id"]: x["spans"] for x in pii.find_personal_data(df).collect()}
    assert [(s["kind"], s["value"]) for s in got[99]] == [("context", "someone@localhost")]
    assert all([s["kind"] for s in got[i]] == ["email"] for i in range(6))


def test_decontamination(spark, docs, rows):
    items = [(1, PASSAGE), (2, " ".join(PASSAGE.split()[:5])), (3, None), (4, "!!"), (5, "one"), (1, PASSAGE)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = decontam.brute_force(rows, items)
    got = decontam.decontaminate(docs.withColumn("hits", F.lit("clash")), bench).collect()
    assert len(got) == len(rows)
    for x in got:
        assert (x["n_words"], x["n_hit"], len(x["item_ids"]), x["contaminated"]) == (want[x["doc_id"]][0], want[x["doc_id"]][1], want[x["doc_id"]][2], want[x["doc_id"]][4])


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 500, "owned_bytes": 500}, {"shard_bytes": 500, "owned_bytes": 500, "hot_shards": 1}])
def test_suffix_dedup(spark, rows, options):
    rows = [*rows, (None, PASSAGE), (3, PASSAGE + PASSAGE)]
    got = suffix.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **options).collect()
    have = [(x["doc_id"], x["n_bytes"], x["n_removed"], len(x["spans"]), x["kept_sha256"]) for x in got]
    assert sorted(have, key=str) == sorted(suffix.brute_force(rows), key=str)


def test_suffix_dedup_of_texts_that_repeat_themselves(spark):
    q, pieces = random.Random(3), ["".join(random.Random(i).choices("abcde ", k=60 + 7 * i)) for i in range(9)]
    rows = [(q.choice([i, i, 7]), q.choice(["!" * q.randrange(600), "foo bar\n" * q.randrange(70), "".join(q.choices(pieces, k=3))]) + "ab"[: i % 3]) for i in range(60)]
    got = suffix.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shard_bytes=4000, owned_bytes=2000).collect()
    have = [(x["doc_id"], x["n_bytes"], x["n_removed"], len(x["spans"]), x["kept_sha256"]) for x in got]
    assert sorted(have) == sorted(suffix.brute_force(rows))


def test_language_sample_has_the_first_rows_of_each_language_by_hash(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "train", lambda rows: seen.append(sorted(rows)))
    rows = [(i, f"text {i}", "xy"[i % 5 == 0]) for i in range(300)] + [(900, "z" * 200, "z"), (901, "z" * 300, "z"), (902, None, "x"), (903, "", "x"), (904, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    order = {x["doc_id"]: x["o"] for x in df.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.lit(langid.SEED)).alias("o")).collect()}
    mine = sorted((x for x in rows if x[1] and x[2] and zlib.crc32(str(x[0]).encode()) % 3 != 1), key=lambda x: order[x[0]])
    for sample in (6, 45, 3000):
        langid.fit(df, sample=sample, most_bytes=250)
        short = [x for x in mine if len(x[1]) <= 250]
        langs = {x[2] for x in mine}
        want = [x for lang in langs for x in ([y for y in short if y[2] == lang] or [y for y in mine if y[2] == lang][:1])[: sample // len(langs)]]
        assert seen.pop() == sorted((t.encode(), lang) for _, t, lang in want)


def test_licenses(spark):
    df = spark.createDataFrame([(1, "x\nReleased under the MIT License."), (2, "He has a license to drive."), (3, None), (4, "")], "doc_id long, text string")
    got = {x["doc_id"]: [(y["line"], y["family"]) for y in x["licenses"]] for x in license.scan_licenses(df).collect()}
    assert got == {1: [(1, "mit")], 2: [], 3: [], 4: []}


def test_targets_and_flow():
    assert mixing.targets({"a": 10, "b": 1000, "c": 10}, {"a": 5, "b": 2, "c": 1}) == {"a": 30, "b": 960, "c": 30}
    flow = mixing.route({"p": 10, "q": 10}, {"p": ["a"], "q": ["a", "b"]}, {"a": 12, "b": 8})
    assert flow == {("p", "a"): 10, ("q", "a"): 2, ("q", "b"): 8}


def test_mixing(spark, docs):
    df = docs.withColumn("sources", F.array(F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 3).cast("string")))).withColumn("size", mixing.words(F.col("text")))
    got = mixing.mix_sources(df, mixing.cycle_weights, size_col="size", sources_col="sources", order_cols=["doc_id"]).toPandas()
    assert len(got) == docs.count() and (got.taken <= 3 * got["size"]).all()
    sums = got.assign(s=got.sources.map(lambda x: str(x[0]))).groupby("s").agg(t=("target", "first"), n=("taken", "sum"))
    assert ((sums.t - sums.n).abs() <= 1).all()


@pytest.mark.parametrize("repeat", [1, 3])
def test_jaccard(spark, rows, repeat):
    df = spark.createDataFrame(rows * repeat, "doc_id long, text string").repartition(3)
    got = jaccard.near_duplicates(df).collect()
    want = jaccard.brute_force(rows)
    assert len(got) == len(rows) * repeat and {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == want


def test_secrets():
    assert secrets.scan('db_password = "hunter2x9Qz"') == [("assign", 3, 26)]
    assert [s[0] for s in secrets.scan('KEY = "Zx81-Qp77-Lm"\nauth_token := x\nclient_secret_ref = KEY')] == ["lexed"]
    assert secrets.scan(None) == [] and secrets.scan("token: ab") == [] and secrets.scan("toſen=abcdefgh") == []


@pytest.mark.parametrize(
    "text, literal",
    [
        ("Note: db_pwd=Zx81Qp77Lm", "Zx81Qp77Lm"),
        ('Note: db_pwd = "Zx81-Qp77-Lm"', "Zx81-Qp77-Lm"),
        ("Note: env: a=db_pwd=Zx81Qp77Lm==", "Zx81Qp77Lm=="),
        ('env: "DB_PWD=Zx81Qp77Lm"', "Zx81Qp77Lm"),
        ("url: http://h/?db_pwd=Zx81Qp77Lm", "Zx81Qp77Lm"),
        ('const dbPwd: string = "Zx81-Qp77-Lm"', "Zx81-Qp77-Lm"),
        ('dbPwd?: string | null = "Zx81-Qp77-Lm"', "Zx81-Qp77-Lm"),
        ('db_pwd: Optional[str] = "Zx81-Qp77-Lm"', "Zx81-Qp77-Lm"),
        ('static DB_PWD: &\'static str = "Zx81-Qp77-Lm";', "Zx81-Qp77-Lm"),
        ('var dbPwd string = "Zx81-Qp77-Lm"', "Zx81-Qp77-Lm"),
        ('char db_pwd[16] = "Zx81-Qp77-Lm";', "Zx81-Qp77-Lm"),
        ('let dbPwd: string = KEY; const KEY: string = "Zx81-Qp77-Lm"', "Zx81-Qp77-Lm"),
    ],
)
def test_secrets_behind_labels_and_types(text, literal):
    assert [text[a:b] for kind, a, b in secrets.scan(text) if kind == "lexed"] == [literal]


@pytest.mark.parametrize("n", [0, 8, 9, 12, 5000])
def test_secrets_in_aligned_columns(n):
    blanks = " \t" * (n // 2) + " " * (n % 2)
    for text in (f"aws_secret_access_key{blanks}= wJalrXUtnFEMI", f"aws_secret_access_key ={blanks}wJalrXUtnFEMI", f"access_private_key: str{blanks}={blanks}'wJalrXUtnFEMI'"):
        assert [text[a:b] for kind, a, b in secrets.scan(text)] == ["wJalrXUtnFEMI"]


def test_secrets_lex_no_more_than_assignments():
    assert secrets.scan('if key == "db_pwd": return value') == [] and secrets.scan("if key == db_pwd: return value") == []
    assert secrets.lexed_spans("db_pwd: Zx81Qp77Lm = foo") == [(8, 18)]
    assert secrets.scan('a: str = "plain words"\nlogin_pwd: str\n') == []
    assert len(secrets.lex("a=" * 20_000)) == 19_999


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://A.example.net/en/x?q"), (2, "https://x.net"), (3, "http://sub.example.com/de/1#t"), (4, "ftp://z.org/fr/"), (5, None), (6, "nothing"), (7, "http://m.bad.io/p/"), (7, "http://m.bad.io/p/"), (8, "http://example.netx/en/")], "page_id long, url string")
    listed = spark.createDataFrame([("bad.io/p",), ("bad.io/p",), (None,)], "c string")
    for most in (urls.MAX_BLOCKS, 0):
        got = {(x["page_id"], x["host"], x["path"], x["rule"], x["verdict"]) for x in urls.judge_urls(pages, urls.RULES, listed, max_blocks=most).collect()}
        assert got == {
            (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "x.net", "", None, "allow"), (3, "sub.example.com", "/de/1", "example.com/de/", "block"), (4, "z.org", "/fr/", "org/fr/", "allow"),
            (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "m.bad.io", "/p/", None, "block"), (8, "example.netx", "/en/", None, "allow"),
        }


def test_urls_long_list_is_filtered_by_a_shuffle(spark, monkeypatch):
    pages = spark.createDataFrame([(i % 40, f"http://{'www.' if i % 3 else ''}h{i % 9}.example.net/{('en', 'de')[i % 2]}/{i % 40}") for i in range(120)] + [(None, None)], "page_id long, url string")
    passed, filtered = [], urls.possible

    def possible(found, *args, **options):
        out = filtered(found, *args, **options)
        passed.append((found.count(), out.count(), options))
        return out

    monkeypatch.setattr(urls, "possible", possible)
    listed = urls.shared_canonicals(pages)
    short, long = (sorted(map(str, urls.judge_urls(pages, urls.RULES, listed, max_blocks=most).collect())) for most in (urls.MAX_BLOCKS, 0))
    assert short == long and len(long) == 121
    assert len(passed) == 2 and passed[1][2] == {"broadcast": False} and passed[1][1] < passed[1][0]


def test_language(spark):
    data = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog with this that ", "en"), ("der hund und die katze nicht schön ", "de")] * 60)]
    df = spark.createDataFrame([(i, t * 3, lang) for i, t, lang in data] + [(900, None, "en"), (901, "123 !", "de")], "doc_id long, text string, lang string")
    got = langid.identify_language(df, langid.fit(df)).collect()
    assert all(x["lang_pred"] == x["lang"] for x in got if x["doc_id"] < 900) and all(x["lang_pred"] == "und" for x in got if x["doc_id"] >= 900)
    assert all(0 <= x["score"] <= 1 for x in got)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert suffix.deduplicate(empty).count() == 0 and jaccard.near_duplicates(empty).count() == 0
    assert pii.find_personal_data(empty).count() == 0 and langid.fit(empty) is None
    assert decontam.decontaminate(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0
