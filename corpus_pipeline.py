"""The corpus pipeline: language, near duplicates, benchmark passages, personal data, source mix.

Each stage is a function of (spark, docs, sf_dir). All but the last return the columns of docs, in
their order; other columns of docs, whatever their names, are carried through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwright.llm import decontam, jaccard, langid, mixing, pii
from driftwright.llm.common import table, written

#: Keys of dropped rows are broadcast up to this number (16 MB or so), and joined by a shuffle beyond it.
MOST_BROADCAST = 1_000_000


def _held(docs: DataFrame, *extra) -> DataFrame:
    """docs as text and one struct of all other columns, which no result column can clash with."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("held"), "text", *extra)


def _released(df: DataFrame, like: DataFrame, *extra, **changed) -> DataFrame:
    return df.select(*[changed.get(c, F.col("text") if c == "text" else F.col(f"held.`{c}`")).alias(c) for c in like.columns], *extra)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, however many languages share the score. Null texts and texts without letters go."""
    found = langid.identify_language(_held(docs), langid.fit(docs))
    return _released(found.filter(F.col("lang_pred") != "und"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, rows without an id last, of equal ids the first. Rows without words stay."""
    keyed = written(_held(docs, F.monotonically_increasing_id().alias("key")), "keyed")  # written, so that every reading finds the same keys
    found = written(jaccard.near_duplicates(keyed, id_col="key").filter("n_shingles > 0").select("key", "component_id"), "groups")
    ids = keyed.select("key", F.col("held.doc_id").alias("doc_id"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = found.join(ids, "key").groupBy("component_id").agg(F.min(order).alias("first")).select("first.key")
    dropped = written(found.select("key").join(first, "key", "left_anti"), "dropped")
    out = keyed.join(F.broadcast(dropped) if dropped.count() <= MOST_BROADCAST else dropped, "key", "left_anti")
    return _released(out, docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark passages."""
    found = decontam.decontaminate(_held(docs), table(spark, sf_dir, "benchmark"))
    return _released(found.filter(~F.col("contaminated")), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind, and n_chars brought in line."""
    found = pii.find_personal_data(_held(docs)).withColumn("text", pii.redacted(F.col("text"), F.col("spans")))
    changed = {"n_chars": F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("held.n_chars"))} if "n_chars" in docs.columns else {}
    return _released(found, docs, **changed)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and taken (words, repeats counted)."""
    sized = _held(docs, F.col("doc_id").alias("_id"), F.array("source").alias("sources"), mixing.words(F.col("text")).alias("size"))
    mixed = mixing.mix_sources(sized, mixing.cycle_weights, size_col="size", sources_col="sources", order_cols=["_id"])
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    return _released(mixed.filter("taken > 0"), docs.select(*kept), "size", "source_size", "target", "taken")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("mix", mix)]

#: The trained language network has no form in SQL; tests/llm/test_pipeline.py checks run() and its stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
