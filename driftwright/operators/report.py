"""Reports over compared rows: filtered rows, text, JSON, summary line; counters never depend on the filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compare import CATEGORIES, counters

DEFAULT_FILTER = ("DIFF", "MISSING", "EXTRA")


def report_rows(compared: DataFrame, categories: tuple = DEFAULT_FILTER) -> DataFrame:
    if bad := set(categories) - set(CATEGORIES):
        raise ValueError(f"unknown categories: {sorted(bad)}")
    return compared.filter(F.col("category").isin(*categories))


#: Labels of the text report, of one width.
LABELS = {"DIFF": "[DIFF]   ", "MISSING": "[MISSING]", "EXTRA": "[EXTRA]  ", "SAME": "[SAME]   "}


def summary_line(counted: DataFrame, mode: str, duration_ms: int, partial: bool = False) -> DataFrame:
    """One row, line: the text report's first line, from counters(); a partial check never says that it completed."""
    said = "[PARTIAL] Check incomplete." if partial else "Check completed."
    line = F.format_string(f"{said} same=%d diff=%d missing=%d extra_local=%d total=%d mode={mode} duration_ms={int(duration_ms)}", "same", "diff", "missing", "extra_local", "total")
    return counted.select(line.alias("line"))


def json_escaped(text: Column) -> Column:
    """Quotes, backslashes and control characters escaped; other characters stay."""
    out = text
    for c, to in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(c), F.lit(to))
    rest = F.transform(F.split(out, ""), lambda x: F.when((x < " ") & (x != ""), F.concat(F.lit("\\u00"), F.lower(F.lpad(F.hex(F.ascii(x)), 2, "0")))).otherwise(x))
    return F.when(out.rlike(r"[\x00-\x1f]"), F.array_join(rest, "")).otherwise(out)


def text_lines(compared: DataFrame, categories: tuple = DEFAULT_FILTER) -> DataFrame:
    """path and line of the text report's rows; sizes on DIFF only, '-' where a side has none."""
    size = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[F.col("category")]
    sizes = F.when(F.col("category") == "DIFF", F.concat(F.lit("  local="), size("local_size"), F.lit(" remote="), size("remote_size"))).otherwise("")
    return report_rows(compared, categories).select("path", F.concat(label, F.lit(" "), "path", sizes).alias("line"))


def json_lines(compared: DataFrame, categories: tuple = DEFAULT_FILTER) -> DataFrame:
    """path and one JSON object for each row, nulls kept."""
    size = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    row = F.concat(
        F.lit('{"type": "'), "category", F.lit('", "path": "'), json_escaped(F.col("path")), F.lit('", "local_size": '), size("local_size"), F.lit(', "remote_size": '), size("remote_size"),
        F.lit(', "hash_compared": '), F.col("hash_compared").cast("string"), F.lit("}"),
    )
    return report_rows(compared, categories).select("path", row.alias("json"))


def json_summary(compared: DataFrame, mode: str, duration_ms: int, partial: bool) -> DataFrame:
    """One row: the summary object of the JSON report."""
    c = counters(compared).select("same", "diff", "missing", "extra_local", F.col("total").alias("total_compared"), F.lit(mode).alias("mode"), F.lit(duration_ms).alias("duration_ms"), F.lit(partial).alias("partial"))
    return c.select(F.to_json(F.struct("*")).alias("json"))


def text_report(compared: DataFrame, mode: str, duration_ms: int, *, partial: bool = False, categories: tuple = DEFAULT_FILTER, summary_only: bool = False) -> DataFrame:
    """part, path and line of the whole text report: the summary line, then the rows. Its order is by part and path."""
    first = summary_line(counters(compared), mode, duration_ms, partial).select(F.lit(0).alias("part"), F.lit("").alias("path"), "line")
    return first if summary_only else first.unionByName(text_lines(compared, categories).withColumn("part", F.lit(1)))


def json_report(compared: DataFrame, mode: str, duration_ms: int, *, partial: bool = False, categories: tuple = DEFAULT_FILTER, summary_only: bool = False) -> DataFrame:
    """part, path and line of one JSON document: summary, then differences. Its order is by part and path."""
    c = counters(compared)
    shown = [("same", "same"), ("diff", "diff"), ("missing", "missing"), ("extra_local", "extra_local"), ("total_compared", "total")]
    fields = [F.concat(F.lit(f'    "{name}": '), F.col(k).cast("string"), F.lit(",")) for name, k in shown]
    fields += [F.lit(f'    "mode": "{mode}",'), F.lit(f'    "duration_ms": {int(duration_ms)},'), F.lit(f'    "partial": {str(bool(partial)).lower()}')]
    head = F.array(F.lit("{"), F.lit('  "summary": {'), *fields, F.lit("  },"))
    rows = json_lines(compared, categories)
    last = (rows.filter("false") if summary_only else rows).agg(F.max("path").alias("last"))
    both = c.join(F.broadcast(last))  # one row and one row
    opens = F.when(F.col("last").isNull(), '  "differences": []').otherwise('  "differences": [')
    closes = F.when(F.col("last").isNull(), F.array(F.lit("}"))).otherwise(F.array(F.lit("  ]"), F.lit("}")))
    at = lambda part, lines: both.select(F.posexplode(lines).alias("at", "line")).select(F.lit(part).alias("part"), F.format_string("%04d", "at").alias("path"), "line")
    out = at(0, F.concat(head, F.array(opens))).unionByName(at(2, closes))
    if summary_only:
        return out
    each = rows.join(F.broadcast(last)).select(F.lit(1).alias("part"), "path", F.concat(F.lit("    "), "json", F.when(F.col("path") < F.col("last"), ",").otherwise("")).alias("line"))
    return out.unionByName(each)


def write_report(compared: DataFrame, path: str | None, mode: str, duration_ms: int, *, fmt: str = "text", partial: bool = False, categories: tuple = DEFAULT_FILTER, summary_only: bool = False) -> DataFrame:
    """What the terminal shows, as part, path and line: without a path the report, with one its summary line, and the report goes to a folder of text files in order."""
    if fmt not in ("text", "json"):
        raise ValueError("fmt is text or json")
    render = json_report if fmt == "json" else text_report
    out = render(compared, mode, duration_ms, partial=partial, categories=categories, summary_only=summary_only)
    if path is None:
        return out
    out.orderBy("part", "path").select("line").write.text(path)
    return text_report(compared, mode, duration_ms, partial=partial, summary_only=True)
