"""Personal data: base patterns and bootstrapped contextual extraction, in DataFrame operations only.

Base spans of four kinds are found in every whole text. They then act as seeds: identifier-like
tokens (with a digit or @) are instances, and the two words before a token with its shape are its
lexical pattern. Spark scores the graph of patterns and instances for a few rounds (a pattern by the
share of its instances that are believed, an instance by its best patterns), and patterns of high
confidence that several different seeds support add the tokens they precede as "context" spans.

A gap-and-match regular expression yields, in one pass over a text, every match with the gap before
it, so offsets are sums of lengths. The expressions are possessive where backing off cannot help,
which keeps Java from recursing on long runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, without, written

KINDS = ("email", "ip", "card", "phone", "context")
#: Fixed patterns of the base kinds. \G lets a match begin right after the one before it, where the look-behind would not.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without any of this has no match of the kind that passes.
HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.contains(".") & t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"(?:[0-9][\x20-]?){13}[0-9]"),
    "phone": lambda t: t.contains("+") & t.rlike(r"\+[0-9]"),
}
TOKEN = r"(?<!\S)\S*[0-9@]\S*+"
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>"

ROUNDS = 3
#: Confidence from which a pattern discovers, and the different seed instances it needs.
CONFIDENCE, SUPPORT = 0.8, 3
LEAST_LENGTH = 6
#: Matches that a fold gathers before it adds them to those before.
CHUNK = 128
#: Copies of a text are dealt into so many parts when context spans are joined to them; up to this many texts with this many such spans those are broadcast (some 50 MB at the very most).
SALT, MOST_TEXTS, MOST_SPANS = 16, 100_000, 400_000


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value, gap): the non-overlapping matches from left to right, in code points.

    The fold adds to a short array, which joins the long one when it is full, so a text with very
    many matches does not copy all of them at each one.
    """
    both = rf"(?s)\G(.*?)({pattern}|\z)"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(both), F.lit(1)).alias("gap"), F.regexp_extract_all(text, F.lit(both), F.lit(2)).alias("value"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string,gap:string>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        found = F.when(F.length(x["value"]) > 0, F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), x["gap"].alias("gap")))).otherwise(none)
        full = F.size(acc["last"]) >= CHUNK
        found = F.when(full, found).otherwise(F.concat(acc["last"], found))
        return F.struct(end.alias("at"), F.when(full, F.concat(acc["found"], acc["last"])).otherwise(acc["found"]).alias("found"), found.alias("last"))

    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("found"), none.alias("last"))
    return F.aggregate(pairs, start, step, lambda acc: F.concat(acc["found"], acc["last"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2).cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substr(F.ltrim(p, F.lit("0")), F.lit(1), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return n.between(14, 19) & F.when(n <= 19, _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _kind_spans(kind: str, text: Column) -> Column:
    rank = KINDS.index(kind)
    kept = F.filter(_matches(text, PATTERNS[kind]), lambda m: _passes(kind, m["value"]))
    spans = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value")))
    return F.when(F.coalesce(HINTS[kind](text), F.lit(False)), spans.cast(SPAN)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, sorted by start, then kind."""
    return F.array_sort(F.concat(*[_kind_spans(k, text) for k in KINDS[:4]]))


def _candidates(docs: DataFrame, text_col: str) -> DataFrame:
    """text_key, start, end, token, pattern, kind (of the base span it touches, or null) of every identifier-like token."""
    texts = docs.filter(F.col(text_col).rlike("[0-9@]")).select(F.md5(text_col).alias("text_key"), F.col(text_col).alias("text"))
    found = texts.select("text_key", base_spans(F.col("text")).alias("base"), F.filter(_matches(F.col("text"), TOKEN), lambda m: F.length(m["value"]) >= LEAST_LENGTH).alias("tokens"))
    # The kind is found inside the array: rows that carried all spans of their text would grow with the square of them.
    touched = lambda m: F.get(F.filter("base", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])), F.lit(0))["kind"]
    tokens = found.select("text_key", F.inline(F.transform("tokens", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), m["gap"].alias("gap"), touched(m).alias("kind")))))
    shape = F.when(F.contains("value", F.lit("@")), "at").when(F.col("value").rlike(r"^[0-9]+(\.[0-9]+){3}"), "dotted").when(F.col("value").rlike(r"^[0-9() +.-]+$"), "digits").otherwise("mixed")
    words = F.slice(F.reverse(F.split(F.lower(F.rtrim("gap")), r"\s+")), 1, 2)
    each = tokens.select(
        "text_key", "start", "end", F.col("value").alias("token"), F.concat_ws(" ", F.reverse(words), F.concat(F.lit("#"), shape)).alias("pattern"), "kind"
    )
    return each.dropDuplicates(["text_key", "start"])  # each different text once; copies in a task fall together before the shuffle


def discovered(candidates: DataFrame, *, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """pattern and token pairs that high-confidence patterns discover, from a candidates table.

    Every round is a pair of hash aggregations over distinct edges; edges of a hot pattern are
    pre-aggregated where they lie, and only scores of distinct patterns and tokens are joined.
    """
    rows = candidates.count()
    edges = written(candidates.groupBy("pattern", "token").agg(F.max(F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0)).alias("here")), "pii-edges", rows=rows)
    seeds = edges.groupBy("token").agg(F.max("here").alias("seed"))
    scores, used = written(seeds.select("token", "seed", F.col("seed").alias("score")), "pii-scores", rows=rows), []
    for _ in range(rounds):
        patterns = edges.join(scores, "token").groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("belief"), F.sum("seed").alias("support"))
        patterns = written(patterns, "pii-patterns", rows=rows)
        strong = F.when(F.col("support") >= support, F.col("belief")).otherwise(0.0)
        best = edges.join(patterns, "pattern").groupBy("token").agg(F.max(strong).alias("best"))
        before, scores = scores, written(scores.select("token", "seed").join(best, "token").select("token", "seed", F.greatest("seed", "best").alias("score")), "pii-scores", rows=rows)
        discard(before)
        good = patterns.filter((F.col("belief") >= confidence) & (F.col("support") >= support)).select("pattern")
        used.append(patterns)
    found = edges.join(good, "pattern").join(scores.filter((F.col("seed") < 1) & (F.col("score") >= confidence)).select("token"), "token").select("pattern", "token")
    found = written(found, "pii-found", rows=rows)
    discard(edges, scores, *used)
    return found


def find_personal_data(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with spans: array of (start, rank, end, kind, value), sorted by start, then kind.

    Offsets are code points, end exclusive. Null and empty texts have no spans, empty tables give
    empty tables; rows are kept one for one (equal texts get equal spans); a column named spans,
    text_key, more or salt is replaced. Context spans never overlap base spans.
    """
    docs = without(docs, "spans", "text_key", "more", "salt")
    candidates = written(_candidates(docs, text_col), "pii-candidates")
    pairs = discovered(candidates)
    found = candidates.filter("kind is null").join(pairs, ["pattern", "token"])
    more = F.struct("start", F.lit(KINDS.index("context")).alias("rank"), "end", F.lit("context").alias("kind"), F.col("token").alias("value"))
    more = written(found.groupBy("text_key").agg(F.collect_list(more).cast(SPAN).alias("more")), "pii-more")
    discard(candidates, pairs)
    texts, spans = more.agg(F.count("*"), F.coalesce(F.sum(F.size("more")), F.lit(0))).collect()[0]
    out = docs.withColumns({"text_key": F.md5(text_col), "spans": base_spans(F.col(text_col))})
    if texts <= MOST_TEXTS and spans <= MOST_SPANS:
        out = out.join(F.broadcast(more), "text_key", "left")
    else:
        more = more.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        out = out.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int")).join(more, ["text_key", "salt"], "left")
    return out.withColumn("spans", F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", F.col("more"))))).select(*[F.col(f"`{c}`") for c in docs.columns], "spans")


def redacted(text: Column, spans: Column) -> Column:
    """text with every span replaced by <KIND>; overlapping spans become one, named after the first."""

    def step(acc, s):
        joined = s["start"] < acc["at"]
        piece = F.concat(F.substr(text, (acc["at"] + 1).cast("int"), F.greatest(F.lit(0), s["start"] - acc["at"]).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(joined, acc["out"]).otherwise(F.concat(acc["out"], piece)).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def digest(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.filter("spans", lambda s: s["kind"] != "context")
    return found.select("doc_id", *counts[:4], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), counts[4], F.size("spans").cast("long").alias("n_private"))


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """The base spans of the contract, for tests."""
    import re

    def luhn(d):
        return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    spans = [(m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m[0])]
    return [(k, a, b) for a, _, b, k in sorted(spans)]
