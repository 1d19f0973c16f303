"""Sessions with a grace gap, batch and streaming, rates, and pairs of requests and responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def grouped_sessions(sessions: DataFrame, grace: str = "5 seconds", span: str = "hour") -> DataFrame:
    """start, end (of activity) and sessions of every stretch without a gap of `grace` between sessions.

    sessions: session_id, start_ts, end_ts. A session reaches to its end plus the grace. A streaming
    frame (with a watermark on start_ts) is merged by session windows. A batch is merged in spans of
    time, in parallel: how far the spans before reach, and where their last stretch began, are
    running maxima over one row for each span, so no task sees all sessions.
    """
    seconds = int(grace.split()[0])
    if sessions.isStreaming:
        reach = F.concat((F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp")) + seconds * 1_000_000).cast("string"), F.lit(" microseconds"))
        w = F.session_window("start_ts", reach)
        out = sessions.groupBy(w).agg(F.count("*").alias("sessions"), F.max("end_ts").alias("end_ts"))
        return out.select(F.col("session_window.start").alias("start_ts"), "end_ts", "sessions")
    reach = F.col("end_ts") + F.make_dt_interval(secs=F.lit(seconds))
    rows = sessions.select(F.date_trunc(span, "start_ts").alias("span"), "start_ts", "end_ts", reach.alias("reach"))
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each span
    carried = rows.groupBy("span").agg(F.max("reach").alias("most")).select("span", F.max("most").over(before).alias("carried"))
    inside = Window.partitionBy("span").orderBy("start_ts", "end_ts")
    earlier = F.greatest(F.col("carried"), F.max("reach").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    marked = rows.join(carried, "span").withColumn("earlier", earlier).withColumn("first", F.when(F.col("earlier").isNull() | (F.col("start_ts") > F.col("earlier")), F.col("start_ts")))
    marked = marked.withColumn("own", F.max("first").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    last = marked.groupBy("span").agg(F.max("first").alias("begun")).select("span", F.max("begun").over(before).alias("begun"))
    named = marked.join(last, "span").withColumn("stretch", F.coalesce("own", "begun"))
    return named.groupBy("stretch").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.count("*").alias("sessions")).drop("stretch")


def rates(events: DataFrame, window: str = "1 second", value: str = "value") -> DataFrame:
    """Events and their sum in tumbling windows."""
    return events.groupBy(F.window("ts", window)).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start_ts"), "n", "total")


def paired(requests: DataFrame, responses: DataFrame, *, within: str = "2 minutes") -> DataFrame:
    """Requests with their responses by path, each pair once, for streams: late and repeated responses are ignored."""
    left = requests.withWatermark("asked", within).dropDuplicatesWithinWatermark(["path"]).alias("q")
    right = responses.withWatermark("answered", within).dropDuplicatesWithinWatermark(["path"]).alias("r")
    on = F.expr(f"q.path = r.path AND r.answered >= q.asked AND r.answered <= q.asked + INTERVAL {within}")
    return left.join(right, on).select("q.path", "asked", "answered", "hash")
