"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). A flow network
routes token capacity from patterns to source quotas: each pattern offers its tokens once for free,
a second time at cost 1 and a third time at cost 3 (convex, so repeats come last), and quotas are
the capped, reweighted targets. The flow runs on the driver over patterns and sources only, whose
number is checked; documents are then selected in the order of a seeded hash, by prefix sums in two
levels (hash bucket, then within a bucket), so no window ever holds a whole source.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import nested, table, unnested, written

WORD = r"[^\x20\x09-\x0D]+"
EPOCHS = 3
#: Cost of a token's first, second and third use.
COSTS = (0, 1, 3)
WEIGHTS = (5, 2, 1)
#: Patterns and sources that the driver may hold.
MAX_PATTERNS = 100_000
BUCKETS = 4096
SEED = "mix-1"


def targets(sizes: dict, weights: dict, limit: int = EPOCHS) -> dict:
    """Targets that share all of sum(sizes) by weight; a source stops at limit times its size, the excess is reshared until none is above."""
    total = sum(sizes.values())
    out: dict = {}
    free = set(sizes)
    left = Fraction(total)
    while free:
        share = sum(Fraction(weights[s]) for s in free)
        over = {s for s in free if left * Fraction(weights[s]) > limit * sizes[s] * share} if share else set(free)
        if not over:
            out |= {s: left * Fraction(weights[s]) / share for s in free}
            break
        for s in over:
            out[s] = Fraction(limit * sizes[s])
            left -= out[s]
        free -= over
    return out


def route(capacity: dict, members: dict, quota: dict, costs: tuple = COSTS) -> dict:
    """Min-cost flow {(pattern, source): tokens}: successive shortest paths with potentials.

    capacity: tokens of a pattern; members: its sources; quota: whole tokens that a source wants.
    """
    patterns, sources = list(capacity), list(quota)
    number = {("p", p): i + 1 for i, p in enumerate(patterns)} | {("s", s): i + 1 + len(patterns) for i, s in enumerate(sources)}
    sink = len(number) + 1
    graph: list[list[list]] = [[] for _ in range(sink + 1)]  # edges: to, capacity, cost, index of the reverse edge

    def edge(a, b, cap, cost):
        graph[a].append([b, cap, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p in patterns:
        for cost in costs:
            edge(0, number["p", p], capacity[p], cost)
        for s in members[p]:
            edge(number["p", p], number["s", s], capacity[p] * len(costs), 0)
    for s in sources:
        edge(number["s", s], sink, quota[s], 0)
    potential = [0] * (sink + 1)
    while True:
        far, via = [float("inf")] * (sink + 1), [None] * (sink + 1)
        far[0] = 0
        queue = [(0, 0)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for k, (b, cap, cost, _) in enumerate(graph[a]):
                if cap > 0 and (x := d + cost + potential[a] - potential[b]) < far[b]:
                    far[b], via[b] = x, (a, k)
                    heapq.heappush(queue, (x, b))
        if via[sink] is None:
            break
        for i, d in enumerate(far):
            potential[i] += d if d < float("inf") else 0
        path, at = [], sink
        while at:
            a, k = via[at]
            path.append(graph[a][k])
            at = a
        amount = min(e[1] for e in path)
        for e in path:
            e[1] -= amount
            graph[e[0]][e[3]][1] += amount
    flow = {}
    for p in patterns:
        for b, cap, cost, rev in graph[number["p", p]]:
            if b > len(patterns) and b != sink and graph[b][rev][1]:
                flow[p, sources[b - 1 - len(patterns)]] = graph[b][rev][1]
    return flow


def words(text):
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, weights: dict, *, size_col: str, sources_col: str, order_cols: list[str], seed: str = SEED, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """docs with target, source_size (of each row's sources, summed) and taken: the tokens that the mix takes of it.

    sources_col: array of source keys (strings; null is a source of its own, None in weights). Every
    row's taken is its size times the whole repetitions its pattern gets, plus, for the rows first in
    seeded order, once more; the one row on the border is taken in part, so each pattern gives
    exactly the tokens routed. Rows of size 0 or null and empty tables give 0. Equal rows are told
    apart only by order_cols; ties get their taken tokens in any order, equal in sum. Columns that
    bear a result's name are replaced, all others carried along, whatever their names.
    """
    given = docs
    docs = nested(docs, F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("size"), F.coalesce(F.col(sources_col), F.array(F.lit(None).cast("string"))).alias("sources"), *[F.col(c).alias(f"order{i}") for i, c in enumerate(order_cols)])
    order = [f"order{i}" for i in range(len(order_cols))]
    pattern = F.to_json(F.struct(F.array_sort(F.array_distinct("sources")).alias("s")), {"ignoreNullFields": "false"})
    docs = docs.withColumn("pattern", pattern).withColumn("place", F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order])))
    docs = docs.withColumn("bucket", F.conv(F.substring("place", 1, 3), 16, 10).cast("int"))
    sums = written(docs.groupBy("pattern", "bucket").agg(F.sum("size").alias("size"), F.first("sources").alias("sources")), "mix-buckets")
    found = sums.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("sources").alias("sources")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    members = {r["pattern"]: sorted(set(r["sources"]), key=lambda s: (s is None, s or "")) for r in found}
    capacity = {r["pattern"]: int(r["size"]) for r in found}
    sizes: dict = {}
    for p, n in capacity.items():
        for s in members[p]:
            sizes[s] = sizes.get(s, 0) + n
    wanted = targets(sizes, weights(sorted(sizes, key=lambda s: (s is None, s or ""))) if callable(weights) else weights)
    flow = route(capacity, members, _whole(wanted))
    wants: dict[str, int] = {}
    for (p, _), n in flow.items():
        wants[p] = wants.get(p, 0) + n
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [(p, capacity[p], wants.get(p, 0), float(sum(wanted[s] for s in members[p])), sum(sizes[s] for s in members[p])) for p in capacity], "pattern string, capacity long, wants long, target double, source_size long"
    )
    # The prefix sum of a row in seeded order: of the buckets before its own, and within its bucket.
    buckets = sums.select("pattern", "bucket", (F.sum("size").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("size")).alias("before")).join(plan, "pattern")
    out = docs.join(buckets, ["pattern", "bucket"])
    first = F.col("before") + F.sum("size").over(Window.partitionBy("pattern", "bucket").orderBy("place", *order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    whole = F.expr("CASE WHEN capacity > 0 THEN wants div capacity ELSE 0L END")
    rest = F.expr("CASE WHEN capacity > 0 THEN wants % capacity ELSE 0L END")
    out = out.withColumn("first", first)
    out = out.withColumn("taken", (whole * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("first")))).cast("long"))
    return unnested(out, given, "source_size", "target", "taken")


def _whole(wanted: dict) -> dict:
    """Quotas in whole tokens with the sum of the targets (largest remainders first)."""
    out = {s: int(t) for s, t in wanted.items()}
    for s in sorted(wanted, key=lambda s: (out[s] - wanted[s], s is None, s or ""))[: round(sum(wanted.values())) - sum(out.values())]:
        out[s] += 1
    return out


def cycle_weights(sources: list) -> dict:
    """5, 2, 1, repeating, over sources by code point, null last."""
    return {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(sources)}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array("source").alias("sources"), words(F.col("text")).alias("size"))
    mixed = mix_sources(docs, cycle_weights, size_col="size", sources_col="sources", order_cols=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
