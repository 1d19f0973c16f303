"""Stages of the corpus pipeline against plain Python: null ids, repeated rows, clashing columns."""

import random

import pytest

import corpus_pipeline
from driftwright.llm import decontam, jaccard, pii

r = random.Random(11)
WORDS = ["".join(r.choices("abcdefghij", k=r.randrange(3, 9))) for _ in range(300)]
A, B, C, D = (" ".join(r.choices(WORDS, k=60)) for _ in range(4))


def one_of_each(rows):
    """Rows (doc_id, text, ...) without near duplicates: of each class the least id, nulls last; rows without words stay."""
    classes = {}
    for i, (n, root) in jaccard.brute_force([(i, x[1]) for i, x in enumerate(rows)]).items():
        classes.setdefault(root if n else -1 - i, []).append(rows[i])
    return sorted((min(c, key=lambda x: (x[0] is None, x[0] or 0)) for c in classes.values()), key=str)


@pytest.mark.parametrize(
    "rows",
    [
        [(1, A), (1, A), (1, A), (2, B), (2, B)],  # repeated rows of a kept id
        [(None, A), (None, A), (None, A + " end"), (None, B), (7, B), (None, None), (None, None)],  # null ids
        [(1, A), (5, A), (5, B), (9, B)],  # one id, two texts
        [(1, A), (5, A), (5, B), (None, C), (None, C), (4, C), (8, D), (8, D + " end"), (3, None), (3, ""), (3, " ")],
        [(1, A), (2, B), (3, C)],
    ],
)
def test_near_duplicates_leave_one_row_of_each_class(spark, rows):
    rows = [(*x, "clash", "clash") for x in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, component_id string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    got = [tuple(x) for x in got.collect()]
    want = one_of_each(rows)
    ids = [(x[0], (x[1] or "").removesuffix(" end")) for x in want]  # of equal ids any may stay
    assert sorted(((x[0], (x[1] or "").removesuffix(" end")) for x in got), key=str) == sorted(ids, key=str)
    assert all(x in rows for x in got)


def test_language_keeps_every_text_with_letters(spark):
    words = [f"{a}{b}o" for a in "bdfgklmnprst" for b in "aeiu"]
    rows = [(i, " ".join(r.choices(words, k=12)), f"l{i % 12}", "clash") for i in range(48)]  # twelve labels that nothing tells apart
    odd = [(None, "a", "l1", None), (3, "a", "l1", None), (3, "a", "l1", None), (50, None, "l1", "x"), (51, "", "l1", "x"), (52, "12 !", "l1", "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string").repartition(2)
    got = corpus_pipeline.language(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows + odd[:3], key=str)


def without_personal_data(text):
    out, at = "", 0
    for kind, a, b in pii.brute_force(text):
        out, at = out + text[at:a] + f"<{kind.upper()}>", b
    return out + text[at:]


def test_run_and_its_stages(spark, tmp_path, monkeypatch):
    mail = B + " reach me@mail.example.com or 10.1.2.3"
    texts = [(1, A), (1, A), (None, A), (2, mail), (None, mail), (3, C), (3, D), (4, None), (5, ""), (6, "12 !"), (None, "one word"), (7, "one word more")]
    rows = [(d, t, ("en", "de")[i % 2], ("web", None)[i % 3 == 0], len(t or ""), "clash", "clash", "clash", -1) for i, (d, t) in enumerate(texts)]
    names = "doc_id long, text string, lang string, source string, n_chars long, spans string, contaminated string, held string, taken long"
    spark.createDataFrame(rows, names).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, C), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = []
    spied = [(n, lambda s, docs, d, f=f: (seen.append(docs), f(s, docs, d))[1]) for n, f in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", spied)
    mixed = corpus_pipeline.run(spark, str(tmp_path))

    assert all(x.columns == seen[0].columns for x in seen)
    found = [sorted(map(tuple, x.collect()), key=str) for x in seen]
    worded = sorted((x for x in rows if any(c.isalpha() for c in x[1] or "")), key=str)
    assert found[0] == sorted(rows, key=str) and found[1] == worded
    # of equal ids any may stay; here they have equal texts, or are in different classes
    assert [x[:2] for x in found[2]] == [x[:2] for x in one_of_each(worded)] and all(x in worded for x in found[2])
    hit = decontam.brute_force([(i, x[1]) for i, x in enumerate(found[2])], items)
    assert found[3] == [x for i, x in enumerate(found[2]) if not hit[i][4]] and len(found[3]) < len(found[2])
    clean = [(x[0], t := without_personal_data(x[1]), *x[2:4], len(t), *x[5:]) for x in found[3]]
    assert found[4] == sorted(clean, key=str) and any("<EMAIL>" in x[1] for x in clean)

    assert mixed.columns == [*seen[0].columns[:-1], "size", "source_size", "target", "taken"]
    got = mixed.collect()
    assert got and all(tuple(x)[:8] in [c[:8] for c in clean] and x["taken"] > 0 for x in got)
    for source in {x["source"] for x in got}:
        mine = [x for x in got if x["source"] == source]
        assert abs(sum(x["taken"] for x in mine) - mine[0]["target"]) <= 1
