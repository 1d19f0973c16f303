"""Network planning: best edges between interfaces, matchings under a budget, lane choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_edges(matrix: DataFrame) -> DataFrame:
    """The best reachable edge of each client and server pair: family, subnet, round trip, then the edge's own number."""
    best = F.min_by(F.struct(*matrix.columns), F.struct("family", "subnet", "rtt", "edge"))
    return matrix.filter("reachable").groupBy("client", "server").agg(best.alias("best")).select("best.*")


EPSILON = 1e-9


def pick_lane(lanes: DataFrame, group: str, *, stream_limit: int, force_primary: Column | None = None) -> DataFrame:
    """The lane of each group that takes the next transfer, or -1: of the healthy lanes below the stream limit that of least (in_flight + bias) / weight.

    Lanes are compared in order, and only a load less by more than EPSILON takes over, so equal loads go
    to the lowest lane. Where force_primary holds (in any row of a group), a healthy lowest lane is
    the only choice, full or not. A group's lanes are network links, a few.
    """
    forced = F.lit(False) if force_primary is None else force_primary
    rows = lanes.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("lane", "healthy", "in_flight", "bias", "weight"))).alias("lanes"), F.bool_or(forced).alias("forced"))
    none = F.struct(F.lit(-1).cast("long").alias("lane"), F.lit(0.0).alias("load"))

    def step(best, x):
        load = (x["in_flight"] + x["bias"]).cast("double") / x["weight"]
        better = x["healthy"] & (x["in_flight"] < stream_limit) & ((best["lane"] < 0) | (load < best["load"] - EPSILON))
        return F.when(better, F.struct(x["lane"].cast("long").alias("lane"), load.alias("load"))).otherwise(best)

    first = F.get("lanes", F.lit(0))
    pinned = F.when(first["in_flight"] < stream_limit, first["lane"].cast("long")).otherwise(F.lit(-1).cast("long"))
    least = F.aggregate("lanes", none, step, lambda best: best["lane"])
    return rows.select(group, F.when(F.col("forced") & first["healthy"], pinned).otherwise(least).alias("lane"))


def matching(edges: list[tuple]) -> dict:
    """A maximum matching of (client, server) edges: {server: client}, by augmenting paths."""
    by: dict = {}
    for c, s in edges:
        by.setdefault(c, []).append(s)
    held: dict = {}

    def place(c, seen):
        for s in by[c]:
            if s not in seen:
                seen.add(s)
                if s not in held or place(held[s], seen):
                    held[s] = c
                    return True
        return False

    for c in by:
        place(c, set())
    return held


def link_plan(edges: DataFrame, group: str, budget: int, *, primary_client: str | None = None, primary_server: str | None = None) -> DataFrame:
    """Per group, the best edges (by rank) that use every client and server once and still allow the largest matching within the budget.

    A primary link holds its client and its server, whose edges are out, and one place of the budget.
    """
    if primary_client is not None or primary_server is not None:
        budget -= 1
        edges = edges.filter(~(F.col("client").eqNullSafe(F.lit(primary_client)) | F.col("server").eqNullSafe(F.lit(primary_server))))
    budget = max(0, budget)

    def run(pdf):
        rows = pdf.sort_values("rank").to_dict("records")
        pairs = [(r["client"], r["server"]) for r in rows]
        size = min(budget, len(matching(pairs)))
        taken: list = []
        for r in rows:
            used_c, used_s = {t["client"] for t in taken} | {r["client"]}, {t["server"] for t in taken} | {r["server"]}
            if len(taken) < size and r["client"] not in {t["client"] for t in taken} and r["server"] not in {t["server"] for t in taken}:
                rest = [(c, s) for c, s in pairs if c not in used_c and s not in used_s]
                if len(taken) + 1 + len(matching(rest)) >= size:
                    taken.append(r)
        return pdf.iloc[:0] if not taken else type(pdf)(taken)[list(pdf.columns)]

    return edges.groupBy(group).applyInPandas(run, edges.schema)
