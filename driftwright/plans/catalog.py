"""Every query of the library by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwright.functions import controllers as K
from driftwright.functions import scalars as S
from driftwright.functions import tuning as T
from driftwright.operators import compare as C
from driftwright.operators import delta as D
from driftwright.operators import links as L
from driftwright.operators import metrics as M
from driftwright.operators import planning as P
from driftwright.operators import report as R
from driftwright.streaming import sessions as W

from . import views as V

_RM = """SELECT concat('docs/', lang, '/', source, '/', doc_id, '.txt') AS path, false AS is_dir, CAST(strlen(text) AS BIGINT) AS size, 1700000000000000000 + doc_id * 1000000000 AS mtime_raw, md5(text) AS hash FROM documents"""
_LM = """SELECT concat('docs/', lang, '/', source, '/', doc_id, '.txt') AS path, false AS is_dir, CAST(strlen(text) AS BIGINT) + CASE WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END AS size,
  CASE WHEN doc_id % 10 IN (2, 3) THEN 1700000000000000000 + doc_id * 1000000000 + 10000000 WHEN doc_id % 10 = 4 THEN 1700000000000000000 + doc_id * 1000000000 + 2000000
    WHEN doc_id % 10 = 5 THEN 1700000000000000000 + doc_id * 1000000000 + 2000001 WHEN doc_id % 10 = 6 THEN 133444736000000000 + doc_id * 10000000 ELSE 1700000000000000000 + doc_id * 1000000000 END AS mtime_raw,
  CASE WHEN doc_id % 10 IN (1, 2, 7) THEN md5(concat(text, '#')) ELSE md5(text) END AS hash FROM documents WHERE doc_id % 10 <> 0
  UNION ALL SELECT concat('extra/', doc_id, '.txt'), false, CAST(strlen(text) AS BIGINT), 1700000000000000000, md5(text) FROM documents WHERE doc_id % 25 = 0"""


def _ns(c):
    return f"CASE WHEN {c} > 500000000000000000 THEN {c} WHEN {c} >= 116444736000000000 AND {c} - 116444736000000000 <= 92233720368547758 THEN ({c} - 116444736000000000) * 100 END"


_SAME_TIME = f"coalesce(abs(({_ns('l.mtime_raw')}) - ({_ns('r.mtime_raw')})) <= 2000000, abs(l.mtime_raw - r.mtime_raw) <= 2000000)"
_BOTH = {"size": "'SAME'", "fast": f"CASE WHEN {_SAME_TIME} THEN 'SAME' ELSE 'HASH' END", "strict": "'HASH'"}


def _cmp(mode):
    return f"""WITH rm AS ({_RM}), lm AS ({_LM}), j AS (SELECT coalesce(r.path, l.path) AS path, l.size AS local_size, r.size AS remote_size, r.hash = l.hash AS eq,
      CASE WHEN r.path IS NULL THEN 'EXTRA' WHEN l.path IS NULL THEN 'MISSING' WHEN l.size <> r.size THEN 'DIFF' ELSE {_BOTH[mode]} END AS o FROM rm r FULL JOIN lm l ON r.path = l.path),
    cmp AS (SELECT CASE WHEN o = 'HASH' THEN CASE WHEN eq THEN 'SAME' ELSE 'DIFF' END ELSE o END AS category, path, local_size, remote_size, o = 'HASH' AS hash_compared FROM j) """


def _compared(mode):
    return lambda s, d: C.compare(V.remote_manifest(s, d), V.local_manifest(s, d), mode)


_COUNT = """SELECT count(*) FILTER (category <> 'EXTRA') AS enumerated, count(*) FILTER (category = 'SAME') AS same, count(*) FILTER (category = 'DIFF') AS diff, count(*) FILTER (category = 'MISSING') AS missing,
  count(*) FILTER (category = 'EXTRA') AS extra_local, count(*) FILTER (category <> 'EXTRA') AS total, CASE WHEN count(*) FILTER (category <> 'SAME') = 0 THEN 0 ELSE 1 END AS verdict FROM cmp"""
_fast = _compared("fast")
_DIRS = """SELECT DISTINCT array_to_string(list_slice(p, 1, i), '/') AS dir FROM (SELECT string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')))) AS i FROM {})"""

QUERIES: dict = {}
SQL: dict = {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


for _m in C.MODES:
    add(f"compare_summary_{_m}", lambda s, d, m=_m: C.counters(_compared(m)(s, d)), _cmp(_m) + _COUNT)
    add(f"compare_{_m}", _compared(_m), _cmp(_m) + "SELECT * FROM cmp")
add("extra_files", lambda s, d: C.extras(V.remote_manifest(s, d), V.local_manifest(s, d)).select("path", "size"), f"WITH rm AS ({_RM}), lm AS ({_LM}) SELECT path, size FROM lm WHERE path NOT IN (SELECT path FROM rm)")
add("missing_files", lambda s, d: C.extras(V.local_manifest(s, d), V.remote_manifest(s, d)).select("path", "size"), f"WITH rm AS ({_RM}), lm AS ({_LM}) SELECT path, size FROM rm WHERE path NOT IN (SELECT path FROM lm)")
add("mtime_normalize", lambda s, d: V.local_manifest(s, d).select("path", S.unix_ns(F.col("mtime_raw")).alias("ns")), f"WITH lm AS ({_LM}) SELECT path, {_ns('mtime_raw')} AS ns FROM lm")
add(
    "mtime_write_normalize", lambda s, d: V.local_manifest(s, d).select("path", S.write_ns(F.col("mtime_raw")).alias("ns")),
    f"WITH lm AS ({_LM}) SELECT path, CASE WHEN mtime_raw > 500000000000000000 THEN mtime_raw WHEN mtime_raw < 116444736000000000 THEN greatest(mtime_raw, 0) ELSE greatest((mtime_raw - 116444736000000000) * 100, 0) END AS ns FROM lm",
)
add(
    "mtime_tolerance",
    lambda s, d: V.remote_manifest(s, d).alias("r").join(V.local_manifest(s, d).alias("l"), "path").select("path", S.same_time(F.col("l.mtime_raw"), F.col("r.mtime_raw")).alias("same")),
    f"WITH rm AS ({_RM}), lm AS ({_LM}) SELECT r.path, {_SAME_TIME} AS same FROM rm r JOIN lm l ON r.path = l.path",
)
add(
    "compare_tables",
    lambda s, d: C.compare_tables(
        V.table(s, d, "orders").filter("o_orderkey % 11 <> 0"),
        V.table(s, d, "orders").withColumn("o_custkey", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END")).filter("o_orderkey % 13 <> 0"),
        ["o_orderkey"],
    ),
    """WITH r AS (SELECT * FROM orders WHERE o_orderkey % 11 <> 0), l AS (SELECT * REPLACE (CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey) FROM orders WHERE o_orderkey % 13 <> 0)
    SELECT coalesce(r.o_orderkey, l.o_orderkey) AS o_orderkey, CASE WHEN r.o_orderkey IS NULL THEN 'EXTRA' WHEN l.o_orderkey IS NULL THEN 'MISSING' WHEN r IS NOT DISTINCT FROM l THEN 'SAME' ELSE 'DIFF' END AS category
    FROM r FULL JOIN l ON r.o_orderkey = l.o_orderkey""",
)
add("report_rows", lambda s, d: R.report_rows(_fast(s, d)), _cmp("fast") + "SELECT * FROM cmp WHERE category <> 'SAME'")
add("report_filter_diff", lambda s, d: R.report_rows(_fast(s, d), ("DIFF",)), _cmp("fast") + "SELECT * FROM cmp WHERE category = 'DIFF'")
_LINE = "rpad('[' || category || ']', 9, ' ') || ' ' || path || CASE WHEN category = 'DIFF' THEN '  local=' || coalesce(local_size::VARCHAR, '-') || ' remote=' || coalesce(remote_size::VARCHAR, '-') ELSE '' END"
_JSON = """'{"type": "' || category || '", "path": "' || path || '", "local_size": ' || coalesce(local_size::VARCHAR, 'null') || ', "remote_size": ' || coalesce(remote_size::VARCHAR, 'null') || ', "hash_compared": ' || hash_compared::VARCHAR || '}'"""
_SAID = "'same=' || same || ' diff=' || diff || ' missing=' || missing || ' extra_local=' || extra_local || ' total=' || total || ' mode=fast duration_ms=7'"
add("report_lines", lambda s, d: R.text_lines(_fast(s, d)), _cmp("fast") + f"SELECT path, {_LINE} AS line FROM cmp WHERE category <> 'SAME'")
add("report_text", lambda s, d: R.text_report(_fast(s, d), "fast", 7), _cmp("fast") + f"SELECT 0 AS part, '' AS path, 'Check completed. ' || {_SAID} AS line FROM ({_COUNT}) UNION ALL SELECT 1, path, {_LINE} FROM cmp WHERE category <> 'SAME'")
add("report_partial", lambda s, d: R.text_report(_fast(s, d), "fast", 7, partial=True, summary_only=True).select("line"), _cmp("fast") + f"SELECT '[PARTIAL] Check incomplete. ' || {_SAID} AS line FROM ({_COUNT})")
add("report_json", lambda s, d: R.json_lines(_fast(s, d)), _cmp("fast") + f"SELECT path, {_JSON} AS json FROM cmp WHERE category <> 'SAME'")
add(
    "report_document", lambda s, d: R.json_report(_fast(s, d), "fast", 7, categories=("DIFF", "SAME")),
    _cmp("fast") + f""", c AS ({_COUNT}), x AS (SELECT path, {_JSON} AS json FROM cmp WHERE category IN ('DIFF', 'SAME')), m AS (SELECT max(path) AS last FROM x),
    h AS (SELECT ['{{', '  "summary": {{', '    "same": ' || same || ',', '    "diff": ' || diff || ',', '    "missing": ' || missing || ',', '    "extra_local": ' || extra_local || ',', '    "total_compared": ' || total || ',',
      '    "mode": "fast",', '    "duration_ms": 7,', '    "partial": false', '  }},', '  "differences": ['] AS a FROM c), t AS (SELECT ['  ]', '}}'] AS a)
    SELECT 0 AS part, printf('%04d', i) AS path, a[i + 1] AS line FROM h, range(12) r(i) UNION ALL SELECT 1, path, '    ' || json || CASE WHEN path < last THEN ',' ELSE '' END FROM x, m
    UNION ALL SELECT 2, printf('%04d', i), a[i + 1] FROM t, range(2) r(i)""",
)
add("report_json_summary", lambda s, d: R.json_summary(_fast(s, d), "fast", 0, False), _cmp("fast") + f"""SELECT '{{"same":' || same || ',"diff":' || diff || ',"missing":' || missing || ',"extra_local":' || extra_local || ',"total_compared":' || total || ',"mode":"fast","duration_ms":0,"partial":false}}' AS json FROM ({_COUNT})""")
add("size_histogram", lambda s, d: M.size_histogram(V.remote_manifest(s, d)), f"WITH rm AS ({_RM}) SELECT CASE WHEN size < 4096 THEN '<4K' WHEN size < 16384 THEN '<16K' WHEN size < 65536 THEN '<64K' WHEN size < 262144 THEN '<256K' WHEN size < 1048576 THEN '<1M' ELSE '>=1M' END AS bucket, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM rm GROUP BY 1")
_DELTA_T = f"rm AS ({_RM}), lm AS ({_LM}), x AS (SELECT abs(l.mtime_raw - r.mtime_raw) AS delta FROM rm r JOIN lm l ON r.path = l.path AND r.size = l.size)"
add(
    "mtime_delta_percentiles",
    lambda s, d: M.nearest_rank(V.remote_manifest(s, d).alias("r").join(V.local_manifest(s, d).alias("l"), ["path", "size"]).select(F.abs(F.col("l.mtime_raw") - F.col("r.mtime_raw")).alias("delta")), "delta"),
    f"WITH {_DELTA_T}, n AS (SELECT delta, row_number() OVER (ORDER BY delta) - 1 AS i, count(*) OVER () AS n FROM x) SELECT share, delta AS value FROM n JOIN (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE), (1.0::DOUBLE)) v(share) ON i = floor(share * (n - 1) + 0.5)",
)
add(
    "log2_hist_p95",
    lambda s, d: M.log2_p95(V.remote_manifest(s, d), "size").withColumn("of", F.lit("all")).unionByName(M.log2_p95(V.remote_manifest(s, d).filter("size < 0"), "size").withColumn("of", F.lit("none"))).unionByName(M.log2_p95(V.remote_manifest(s, d).selectExpr("size * 0 AS size"), "size").withColumn("of", F.lit("zeros"))),
    f"""WITH rm AS ({_RM}), v AS (SELECT 'all' AS of, size AS x FROM rm UNION ALL SELECT 'zeros', 0 FROM rm), h AS (SELECT of, CASE WHEN x <= 1 THEN 0 ELSE least(31, CAST(floor(log2(x)) AS INTEGER)) END AS b, count(*) AS c FROM v GROUP BY 1, 2),
    t AS (SELECT of, b, sum(c) OVER (PARTITION BY of ORDER BY b) AS t, sum(c) OVER (PARTITION BY of) AS n FROM h) SELECT CAST(1 AS BIGINT) << CAST(least(31, min(b) + 1) AS INTEGER) AS p95_upper, of FROM t WHERE t >= (n * 95 + 99) // 100 GROUP BY of UNION ALL SELECT 0, 'none'""",
)
add(
    "last_wins_dedup",
    lambda s, d: C.last_wins(V.table(s, d, "conversations").selectExpr("concat('conv/', conv_id) AS path", "turn", "octet_length(text) AS size"), "turn").select("path", "turn", "size"),
    "SELECT 'conv/' || conv_id AS path, turn, strlen(text) AS size FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
)
add(
    "hash_cache_hits",
    lambda s, d: C.cached_hashes(V.remote_manifest(s, d), V.local_manifest(s, d)).agg(F.count("*").alias("entries"), F.count("cached_hash").alias("hits"), F.count_if(F.col("cached_hash").isNull()).alias("misses")),
    f"WITH rm AS ({_RM}), lm AS ({_LM}) SELECT count(*) AS entries, count(l.path) AS hits, count(*) - count(l.path) AS misses FROM rm r LEFT JOIN lm l USING (path, size, mtime_raw)",
)
_plan = lambda s, d: P.actions(_fast(s, d), batch_limit=1024, large_from=16384, delta_from=4096)
_ACT = """SELECT path, CASE WHEN category = 'SAME' THEN CASE WHEN hash_compared THEN 'touch' ELSE 'skip' END WHEN category = 'EXTRA' THEN 'delete_file' WHEN coalesce(remote_size >= 4096 AND local_size > 0, false) THEN 'delta' WHEN remote_size <= 1024 THEN 'batch' WHEN remote_size >= 16384 THEN 'large' ELSE 'regular' END AS action FROM cmp"""
add("compare_actions", _plan, _cmp("fast") + _ACT)
add("sync_counters", lambda s, d: P.sync_counters(_plan(s, d).withColumn("ok", F.octet_length("path") % 9 != 0)), _cmp("fast") + f", a AS ({_ACT}), b AS (SELECT *, strlen(path) % 9 <> 0 AS ok FROM a) SELECT count(*) FILTER (action IN ('skip', 'touch')) AS unchanged, count(*) FILTER (action NOT IN ('skip', 'touch', 'delete_file') AND ok) AS transferred, count(*) FILTER (action NOT IN ('skip', 'touch') AND NOT ok) AS failed, count(*) FILTER (action = 'delete_file' AND ok) AS deleted, count(*) FILTER (action <> 'delete_file') AS compared FROM b")
add("route_tiers", lambda s, d: V.remote_manifest(s, d).groupBy(P.route(F.col("size"), 1024, 8192).alias("tier")).agg(F.count("*").alias("files")), f"WITH rm AS ({_RM}) SELECT CASE WHEN size <= 1024 THEN 'batch' WHEN size >= 8192 THEN 'large' ELSE 'regular' END AS tier, count(*) AS files FROM rm GROUP BY 1")
add("delete_plan", lambda s, d: P.delete_plan(C.extras(V.remote_manifest(s, d), V.local_manifest(s, d)), snapshot_complete=True), f"WITH rm AS ({_RM}), lm AS ({_LM}) SELECT path, row_number() OVER (ORDER BY strlen(path) DESC, path) AS step FROM lm WHERE path NOT IN (SELECT path FROM rm)")
add("ancestor_dirs", lambda s, d: V.directories(V.remote_manifest(s, d)), f"WITH rm AS ({_RM}) {_DIRS.format('rm')}")
_lost = lambda s, d: P.empty_dirs(V.directories(V.remote_manifest(s, d)), V.remote_manifest(s, d).filter("size > 2000"), V.directories(V.local_manifest(s, d).filter("size > 6000")))
_LOST = f"WITH rm AS ({_RM}), lm AS ({_LM}), big AS (SELECT * FROM rm WHERE size > 2000), loc AS (SELECT * FROM lm WHERE size > 6000), e AS (SELECT dir FROM ({_DIRS.format('rm')}) WHERE dir NOT IN ({_DIRS.format('big')}) AND dir NOT IN ({_DIRS.format('loc')})) "
add("empty_dirs", _lost, _LOST + "SELECT dir FROM e")
_odd = lambda s, d: (x := V.directories(V.remote_manifest(s, d))).unionByName(x.filter("length(dir) % 3 <> 0").selectExpr("concat(dir, CASE WHEN length(dir) % 2 = 0 THEN '-old' ELSE ' old/x' END) AS dir"))
_ODD = f"a AS ({_DIRS.format('rm')}), o AS (SELECT dir FROM a UNION ALL SELECT dir || CASE WHEN length(dir) % 2 = 0 THEN '-old' ELSE ' old/x' END FROM a WHERE length(dir) % 3 <> 0)"
add("deepest_dirs", lambda s, d: P.deepest(_odd(s, d)), f"WITH rm AS ({_RM}), {_ODD}, n AS (SELECT dir, lead(dir) OVER (ORDER BY dir) AS nxt FROM o) SELECT dir FROM n WHERE NOT coalesce(starts_with(nxt, dir || '/'), false)")
add("extra_dirs", lambda s, d: P.extra_dirs(V.directories(V.remote_manifest(s, d)), V.directories(V.local_manifest(s, d))), f"WITH rm AS ({_RM}), lm AS ({_LM}) SELECT dir FROM ({_DIRS.format('lm')}) WHERE dir NOT IN ({_DIRS.format('rm')})")
add("block_slices", lambda s, d: P.slices(V.remote_manifest(s, d), "size", 4096).select("path", "offset", "len"), f"WITH rm AS ({_RM}), x AS (SELECT path, size, unnest(range(0, size, 4096)) AS o FROM rm WHERE size > 0) SELECT path, o AS offset, least(4096, size - o) AS len FROM x")
add(
    "batch_pack", lambda s, d: P.packed(V.remote_manifest(s, d).withColumn("dir", S.parent_dir(F.col("path"))), "dir", max_files=8, max_bytes=8192),
    f"""WITH RECURSIVE rm AS ({_RM}), f AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, path, size, row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]*$', 1) ORDER BY path) AS i FROM rm),
    r AS (SELECT dir, path, size, i, 0 AS batch, 1 AS n, size AS held FROM f WHERE i = 1 UNION ALL SELECT f.dir, f.path, f.size, f.i, CASE WHEN r.n >= 8 OR r.held >= 8192 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.n >= 8 OR r.held >= 8192 THEN 1 ELSE r.n + 1 END,
      CASE WHEN r.n >= 8 OR r.held >= 8192 THEN f.size ELSE r.held + f.size END FROM r JOIN f ON f.dir = r.dir AND f.i = r.i + 1) SELECT dir, path, size, batch FROM r""",
)


def _line(**cols):
    def run(s, d):
        base = V.table(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CAST(round(l_extendedprice) AS BIGINT) * 37 AS n", "CAST(l_quantity AS BIGINT) AS q")
        return base.select("l_orderkey", "l_linenumber", *[f(F.col("n"), F.col("q")).alias(c) for c, f in cols.items()])

    return run


def _lsql(**cols):
    return "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{e} AS {c}" for c, e in cols.items()) + " FROM (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice) AS BIGINT) * 37 AS n, CAST(l_quantity AS BIGINT) AS q FROM lineitem)"


def _or_none(c):
    return F.coalesce(c, S.long(-1))


_BS = "least(131072, greatest(2048, CAST(ceil(floor(sqrt(n)) / 1024) AS BIGINT) * 1024))"
add("block_size", _line(block=lambda n, q: S.block_size(n)), _lsql(block=_BS))
add("strong_len", _line(strong=lambda n, q: S.strong_len(n)), _lsql(strong="CASE WHEN n <= 65536 THEN 8 WHEN n <= 4194304 THEN 12 ELSE 16 END"))
add("bucket_of", _line(bucket=lambda n, q: S.bucket_of(n)), _lsql(bucket="xor(n >> 16, n & 65535)"))
add("early_stop_prefix", _line(prefix=lambda n, q: S.early_stop_prefix(q * 1024, n * 100)), _lsql(prefix="least(268435456, greatest(greatest(1048576, q * 1024 * 256), n * 100 // 100 * 5 + n * 100 % 100 * 5 // 100))"))
add("benefit_gate", _line(rejected=lambda n, q: S.rejects_benefit(q, q + n % 40)), _lsql(rejected="q * 100 >= (q + n % 40) * 65"))
add("projection_gate", _line(rejected=lambda n, q: S.rejects_projection(q, n % 100, n, n + q), even=lambda n, q: S.rejects_projection(q, S.long(20), S.long(100), S.long(100) + n % 2)), _lsql(rejected="n % 100 <> 0 AND q::HUGEINT * n * 100 <= (n + q)::HUGEINT * (n % 100) * 35", even="q * 100 * 100 <= (100 + n % 2) * 20 * 35"))
add("rtt_streams", _line(streams=lambda n, q: S.streams_for_rtt(q * 2)), _lsql(streams="CASE WHEN q * 2 <= 10 THEN 4 WHEN q * 2 <= 30 THEN 8 WHEN q * 2 <= 60 THEN 12 ELSE 16 END"))
add("backpressure", _line(us=lambda n, q: S.backpressure_us(n % 300, q + 20)), _lsql(us="CASE WHEN n % 300 <= q + 20 THEN 0 WHEN n % 300 - q - 20 > (q + 20) * 2 THEN 5000 WHEN n % 300 - q - 20 > q + 20 THEN 3000 WHEN n % 300 - q - 20 > (q + 20) // 2 THEN 1500 WHEN n % 300 - q - 20 > (q + 20) // 4 THEN 700 ELSE 300 END"))
add("reserved_slots", _line(slots=lambda n, q: S.reserved_slots(q)), _lsql(slots="CASE WHEN q <= 2 THEN greatest(q - 1, 0) ELSE least(4, greatest(2, q // 8)) END"))
add("reconnect_backoff", _line(s=lambda n, q: S.reconnect_seconds(q.cast("int"))), _lsql(s="least(30, CAST(1 AS BIGINT) << CAST(least(q - 1, 5) AS INTEGER))"))
add("align", _line(up=lambda n, q: S.align_up(n, 4096), down=lambda n, q: S.align_down(n, 4096)), _lsql(up="(n + 4095) // 4096 * 4096", down="n // 4096 * 4096"))
def _texts(units):
    return lambda n, q: F.concat(q.cast("string"), F.element_at(F.array(*map(F.lit, units)), (n % len(units) + 1).cast("int")))


def _parsed(units, pattern, scales):
    """SQL that makes the same texts, then parses them."""
    text = f"(q || ([{', '.join(repr(u) for u in units)}])[CAST(n % {len(units)} + 1 AS INTEGER)])"
    unit = f"lower(regexp_extract({text}, '{pattern}', 2, 'i'))"
    return f"CASE WHEN regexp_full_match({text}, '{pattern}', 'i') THEN CAST(regexp_extract({text}, '{pattern}', 1, 'i') AS BIGINT) * CASE " + " ".join(f"WHEN {unit} IN ({', '.join(repr(u) for u in us)}) THEN {k}" for us, k in scales) + " END ELSE -1 END"


_SIZES, _TIMES = ["", "b", "K", "kb", "m", "MB", "g", "1T", "x", "-"], ["", "s", "sec", "m", "min", "h", "hr", "d", "S", " s"]
add("parse_size", _line(bytes=lambda n, q: _or_none(S.size_units(_texts(_SIZES)(n, q)))), _lsql(bytes=_parsed(_SIZES, "([0-9]+)(b|k|kb|m|mb|g|gb)?", [(["", "b"], 1), (["k", "kb"], 1024), (["m", "mb"], 1048576), (["g", "gb"], 1073741824)])))
add("parse_duration", _line(ms=lambda n, q: _or_none(S.duration_ms(_texts(_TIMES)(n, q)))), _lsql(ms=_parsed(_TIMES, "([0-9]+)(s|sec|m|min|h|hr)?", [(["", "s", "sec"], 1000), (["m", "min"], 60000), (["h", "hr"], 3600000)])))


_SERVER = """CASE s_suppkey % 10 WHEN 0 THEN concat('h', s_suppkey) WHEN 1 THEN concat('h', s_suppkey, ':', s_suppkey * 900) WHEN 2 THEN concat('[fe80::', s_suppkey, ']:', s_suppkey) WHEN 3 THEN concat('fe80::', s_suppkey)
  WHEN 4 THEN concat('[fe80::', s_suppkey, ']') WHEN 5 THEN concat('[fe80::', s_suppkey, ']:x') WHEN 6 THEN concat('h', s_suppkey, ':0') WHEN 7 THEN concat('h', s_suppkey, ':') WHEN 8 THEN concat('h', s_suppkey, ':8', s_suppkey, 'a') ELSE concat(':', s_suppkey) END"""


def _host_port(s, d):
    host, port = S.host_port(F.col("e"), 443)
    return V.table(s, d, "supplier").selectExpr("s_suppkey", f"{_SERVER} AS e").select("s_suppkey", host.alias("host"), port.alias("port"))


add(
    "host_port", _host_port,
    f"""WITH x AS (SELECT s_suppkey, {_SERVER} AS e FROM supplier), p AS (SELECT *, e[1] = '[' AS b, CASE WHEN e[1] = '[' THEN regexp_extract(e, '\\]:([0-9]+)', 1) WHEN length(e) - length(replace(e, ':', '')) = 1 THEN regexp_extract(e, ':([0-9]+)', 1) ELSE '' END AS t FROM x),
    n AS (SELECT *, CASE WHEN TRY_CAST(t AS INTEGER) BETWEEN 1 AND 65535 THEN CAST(t AS INTEGER) END AS port FROM p)
    SELECT s_suppkey, CASE WHEN b THEN regexp_extract(e, '\\[(.*)\\]', 1) WHEN port IS NOT NULL THEN split_part(e, ':', 1) ELSE e END AS host, coalesce(port, 443) AS port FROM n""",
)
add(
    "host_list", lambda s, d: V.table(s, d, "supplier").select("s_suppkey", F.inline(S.host_list(F.expr("concat('a', s_suppkey, ':', s_suppkey, ', ,b', s_suppkey, ',[::1]:9')"), 443))),
    "SELECT s_suppkey, unnest([CASE WHEN s_suppkey = 0 THEN 'a0:0' ELSE 'a' || s_suppkey END, 'b' || s_suppkey, '::1']) AS host, unnest([CASE WHEN s_suppkey = 0 THEN 443 ELSE CAST(s_suppkey AS INTEGER) END, 443, 9]) AS port FROM supplier",
)
add(
    "relative_paths", _line(path=lambda n, q: S.relative_path(F.element_at(F.array(*map(F.lit, [".", "./a", "././a", ".a/b", "a\\b", ".\\a", "", "a/./b"])), (n % 8 + 1).cast("int"))), joined=lambda n, q: S.join_path(F.when(n % 2 == 0, "").otherwise("d/e"), q.cast("string"))),
    _lsql(path="CASE n % 8 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN './a' WHEN 3 THEN '.a/b' WHEN 4 THEN 'a/b' WHEN 5 THEN 'a' WHEN 6 THEN '' ELSE 'a/./b' END", joined="CASE WHEN n % 2 = 0 THEN '' ELSE 'd/e/' END || q"),
)
add("parent_dirs", lambda s, d: V.remote_manifest(s, d).select("path", S.parent_dir(F.col("path")).alias("dir"), S.base_name(F.col("path")).alias("name")), f"WITH rm AS ({_RM}) SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '[^/]*$', 0) AS name FROM rm")
#: Each fatal rule hit, then missed by a letter's case, a place or a sign; NULL and empty.
_REASONS = """CASE event_id % 20 WHEN 0 THEN 'Protocol version mismatch: server=2 client=1' WHEN 1 THEN 'closed: Server authentication rejected' WHEN 2 THEN 'Authentication failed' WHEN 3 THEN 'no Server HELLO missing'
 WHEN 4 THEN 'client received wrong-direction/unknown frame: 9' WHEN 5 THEN 'x RecvFrame desync: bad header' WHEN 6 THEN concat('Protocol error: ', event_type) WHEN 7 THEN concat('Server error: ', event_type)
 WHEN 8 THEN 'protocol version mismatch' WHEN 9 THEN 'Server authentication accepted' WHEN 10 THEN 'Authentication  failed' WHEN 11 THEN 'Server HELLO' WHEN 12 THEN 'client received unknown frame' WHEN 13 THEN 'RecvFrame desync'
 WHEN 14 THEN concat('got Protocol error: ', event_type) WHEN 15 THEN concat(' Server error: ', event_type) WHEN 16 THEN 'Server error:' WHEN 17 THEN '' WHEN 18 THEN NULL ELSE event_type END"""
add(
    "fatal_errors", lambda s, d: V.table(s, d, "events").selectExpr("event_id", f"{_REASONS} AS reason").withColumn("fatal", S.fatal(F.col("reason"))),
    f"""SELECT event_id, reason, coalesce(contains(reason, 'Protocol version mismatch') OR contains(reason, 'Server authentication rejected') OR contains(reason, 'Authentication failed') OR contains(reason, 'Server HELLO missing')
      OR contains(reason, 'client received wrong-direction/unknown frame') OR contains(reason, 'RecvFrame desync:') OR starts_with(reason, 'Protocol error: ') OR starts_with(reason, 'Server error: '), false) AS fatal FROM (SELECT event_id, {_REASONS} AS reason FROM events)""",
)
add("elapsed_text", _line(text=lambda n, q: S.elapsed(n % 9000)), _lsql(text="CASE WHEN n % 9000 >= 3600 THEN printf('%dh %dm %.1fs', n % 9000 // 3600, n % 3600 // 60, (n % 60)::DOUBLE) WHEN n % 9000 >= 60 THEN printf('%dm %.1fs', n % 9000 // 60, (n % 60)::DOUBLE) ELSE printf('%.1fs', (n % 60)::DOUBLE) END".replace("n % 3600", "n % 9000 % 3600").replace("n % 60)", "n % 9000 % 60)")))


def _files(s, d):
    return V.table(s, d, "documents").selectExpr("concat(lang, '/', source, '/', doc_id) AS path", "encode(text, 'UTF-8') AS content", "CAST(octet_length(text) AS BIGINT) AS size")


add(
    "block_weak", lambda s, d: D.block_weak(_files(s, d), "content", 2048).select("path", "block_index", "len", "weak"),
    """WITH f AS (SELECT concat(lang, '/', source, '/', doc_id) AS path, hex(encode(text)) AS h, strlen(text) AS n FROM documents), b AS (SELECT path, n, h, unnest(range(0, CAST(ceil(n / 2048) AS BIGINT))) AS k FROM f WHERE n > 0),
    c AS (SELECT path, k, least(2048, n - k * 2048) AS len, substr(h, k * 4096 + 1, 4096) AS h FROM b), x AS (SELECT path, k, len, unnest(range(0, len)) AS i, h FROM c),
    v AS (SELECT path, k, len, i, (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1 AS v FROM x)
    SELECT path, k AS block_index, len, CAST(sum(v * (i + 1)) % 65536 * 65536 + sum(v) % 65536 AS BIGINT) AS weak FROM v GROUP BY path, k, len""",
)
_blocks = lambda s, d: P.slices(V.remote_manifest(s, d), "size", 512).select("path", (F.col("offset") / 512).cast("long").alias("block_index"), "offset", "len").withColumn("matched", (F.col("block_index") * 7 + F.octet_length("path")) % 3 == 0)
_RUNS = f"WITH rm AS ({_RM}), x AS (SELECT path, size, unnest(range(0, size, 512)) AS o FROM rm WHERE size > 0), m AS (SELECT path, o // 512 AS k, o, least(512, size - o) AS len FROM x WHERE (o // 512 * 7 + strlen(path)) % 3 <> 0), g AS (SELECT *, k - row_number() OVER (PARTITION BY path ORDER BY k) AS g FROM m), r AS (SELECT path, min(k) AS first_block, min(o) AS offset, CAST(sum(len) AS BIGINT) AS len FROM g GROUP BY path, g) "
add("miss_runs", lambda s, d: D.miss_runs(_blocks(s, d)), _RUNS + "SELECT * FROM r")
add("range_slices", lambda s, d: P.slices(D.miss_runs(_blocks(s, d)).withColumnRenamed("len", "run").withColumnRenamed("offset", "base"), "run", 700, "base").select("path", "offset", "len"), _RUNS + ", s AS (SELECT path, \"offset\" AS o, len, unnest(range(0, len, 700)) AS a FROM r) SELECT path, o + a AS \"offset\", least(700, len - a) AS len FROM s")


def _pairs(s, d):
    """Each document as an old file, and a new one with something put before, behind, in or taken out."""
    new = """CASE doc_id % 5 WHEN 0 THEN concat('head ', text) WHEN 1 THEN concat(text, ' tail') WHEN 2 THEN overlay(text PLACING '####' FROM greatest(1, length(text) div 2)) WHEN 3 THEN substr(text, 100) ELSE text END"""
    docs = V.table(s, d, "documents").selectExpr("concat_ws('/', lang, source, doc_id) AS path", "text", f"{new} AS new")
    return docs.select("path", F.encode("text", "UTF-8").alias("old"), F.encode("new", "UTF-8").alias("new"))


add("delta_plan", lambda s, d: D.delta_plan(_pairs(s, d), block=512))
add("signatures", lambda s, d: D.signatures(_files(s, d).withColumn("said", F.expr("size + CASE WHEN size % 9 = 0 THEN 1 ELSE 0 END")), "content", size="said").select("path", "block_index", "len", F.hex("strong").alias("strong"), F.hex("file_hash").alias("file_hash"), "error"))
_ORDER = "c_custkey % 2, (c_custkey // 2) % 2, (c_custkey * 7 + c_nationkey * 13) % 100, c_custkey"
_EDGES = f"SELECT 'c' || c_custkey % 4 AS client, 's' || c_nationkey % 3 AS server, CAST(c_custkey AS BIGINT) AS edge, CAST((c_custkey * 7 + c_nationkey * 13) % 100 AS DOUBLE) AS rtt FROM customer WHERE (c_custkey + c_nationkey) % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY c_custkey % 4, c_nationkey % 3 ORDER BY {_ORDER}) = 1"
add("best_edges", lambda s, d: L.best_edges(V.matrix(s, d)).select("client", "server", "edge"), f"SELECT client, server, edge FROM ({_EDGES})")
add("least_rtt", lambda s, d: M.least_rtt(V.matrix(s, d), "grp"), "SELECT c_nationkey AS grp, min(CASE WHEN (c_custkey + c_nationkey) % 5 <> 0 THEN CAST((c_custkey * 7 + c_nationkey * 13) % 100 AS DOUBLE) END) AS rtt FROM customer GROUP BY 1")
_LOAD = "(s_suppkey % 5 + s_suppkey % 2) / (1 + s_suppkey % 3)::DOUBLE"
add(
    "lane_pick", lambda s, d: L.pick_lane(V.lanes(s, d), "grp", stream_limit=3, force_primary=F.col("grp") % 2 == 0),
    f"""WITH l AS (SELECT s_nationkey AS grp, CAST(s_suppkey AS BIGINT) AS lane, s_suppkey % 7 <> 0 AS ok, s_suppkey % 5 AS n, {_LOAD} AS load FROM supplier), p AS (SELECT grp, arg_min(ok, lane) AS ok, arg_min(n, lane) AS n, min(lane) AS lane FROM l GROUP BY grp),
    b AS (SELECT grp, arg_min(lane, (load, lane)) AS lane FROM l WHERE ok AND n < 3 GROUP BY grp) SELECT p.grp, CASE WHEN p.grp % 2 = 0 AND p.ok THEN CASE WHEN p.n < 3 THEN p.lane ELSE -1 END ELSE coalesce(b.lane, -1) END AS lane FROM p LEFT JOIN b USING (grp)""",
)
add(
    "link_plan", lambda s, d: L.link_plan(L.best_edges(V.matrix(s, d)).select(F.lit(0).alias("grp"), "client", "server", F.col("edge").alias("rank")), "grp", 3, primary_client="c0", primary_server="s0").select("client", "server"),
    f"""WITH e AS (SELECT client, server, edge FROM ({_EDGES}) WHERE client <> 'c0' AND server <> 's0'), m AS (SELECT x.client AS c1, x.server AS s1, y.client AS c2, y.server AS s2, least(x.edge, y.edge) AS a, greatest(x.edge, y.edge) AS b FROM e x JOIN e y ON x.client < y.client AND x.server <> y.server),
    best AS (SELECT * FROM m ORDER BY a, b LIMIT 1), one AS (SELECT client, server FROM e WHERE NOT EXISTS (SELECT 1 FROM m) ORDER BY edge LIMIT 1)
    SELECT c1 AS client, s1 AS server FROM best UNION ALL SELECT c2, s2 FROM best UNION ALL SELECT * FROM one""",
)
_SER = "SELECT user_id, list(coalesce(value, 0) ORDER BY ts, event_id) AS v FROM events GROUP BY user_id"
add("ewma", lambda s, d: V.user_series(s, d).select("user_id", F.round(K.ewma(F.col("values")), 6).alias("ewma")), f"SELECT user_id, round(list_reduce(v, lambda a, x: CASE WHEN a <= 0 THEN x ELSE a * 0.8::DOUBLE + x * 0.2::DOUBLE END, 0::DOUBLE), 6) AS ewma FROM ({_SER})")
_rtts = lambda: F.transform("values", lambda x, i: F.struct(x.alias("rtt"), F.when(i % 11 == 0, 0.0).otherwise(F.lit(60.0) - i % 7 * 5).alias("average")))
add(
    "net_window", lambda s, d: V.user_series(s, d).select("user_id", K.net_window(_rtts(), 8, 2, 64).alias("w")),
    """WITH RECURSIVE x AS (SELECT user_id, coalesce(value, 0) AS rtt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), y AS (SELECT *, CASE WHEN (i - 1) % 11 = 0 THEN 0 ELSE 60 - (i - 1) % 7 * 5 END AS avg FROM x),
    r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, 8 AS w FROM events UNION ALL SELECT r.user_id, y.i, CASE WHEN avg <= 0 THEN w WHEN rtt <= avg * 1.25 THEN least(64, w + 1) WHEN rtt > avg * 2 THEN greatest(2, CAST(floor(w * 0.6::DOUBLE) AS INTEGER)) ELSE w END FROM r JOIN y ON y.user_id = r.user_id AND y.i = r.i + 1)
    SELECT user_id, arg_max(w, i) AS w FROM r GROUP BY user_id""",
)
add(
    "write_cap", lambda s, d: V.windows(s, d).select("user_id", T.write_cap(F.col("samples"), F.col("user_id") % 40, S.long(20)).alias("x")).select("user_id", "x.cap", "x.healthy", "x.reason", "x.since", "x.compare"),
    """WITH RECURSIVE x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id % 60 AS backlog, (event_id * 7919) % 1000 + event_id % 300 AS pressure, coalesce(value, 0) AS rate, (event_id % 40) * 1e9::DOUBLE AS lat, event_id % 29 = 0 AS bp, event_id % 31 = 0 AS bad,
      greatest(1, least(32, user_id % 40)) AS most FROM events),
    r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, 8 AS cap, 0 AS healthy, 0::DOUBLE AS rate, 0::DOUBLE AS lat, 'init' AS reason, 0 AS since, 20 AS compare FROM events UNION ALL
      SELECT user_id, i, new_cap, CASE WHEN ok THEN streak ELSE 0 END, now_rate, now_lat, CASE WHEN worse IS NOT NULL THEN worse WHEN grow THEN 'grow' ELSE 'hold' END, CASE WHEN new_cap <> cap THEN 0 ELSE since + 1 END,
        CASE WHEN worse IS NOT NULL THEN greatest(4, compare // 2) WHEN grow AND compare < 20 THEN compare + 1 ELSE compare END FROM (
        SELECT *, CAST(greatest(1, least(most, CASE WHEN worse IS NOT NULL THEN greatest(1, cap // 2) WHEN grow THEN cap + 1 ELSE cap END)) AS INTEGER) AS new_cap FROM (
        SELECT *, ok AND streak >= 2 AND cap < most AS grow FROM (SELECT *, healthy + 1 AS streak, worse IS NULL AND backlog > cap AND (old = 0 OR (now_rate >= rate AND (lat <= 0 OR now_lat <= lat * 1.25))) AND now_lat < 30e9 AS ok FROM (
        SELECT r.user_id, x.i, r.i AS old, cap, healthy, r.rate, r.lat, since, compare, x.backlog, x.rate AS now_rate, x.lat AS now_lat, x.most, CASE WHEN x.bp THEN 'halve_backpressure' WHEN x.pressure > 1200 THEN 'halve_budget'
          WHEN r.i > 0 AND x.backlog > 0 AND since >= 1 AND x.rate < 20 THEN 'halve_rate_drop' WHEN r.i > 0 AND x.backlog > 0 AND r.lat > 0 AND x.lat > 15e9 THEN 'halve_latency' WHEN x.bad THEN 'halve_failure' END AS worse
        FROM r JOIN x ON x.user_id = r.user_id AND x.i = r.i + 1)))))
    SELECT user_id, arg_max(cap, i) AS cap, arg_max(healthy, i) AS healthy, arg_max(reason, i) AS reason, arg_max(since, i) AS since, arg_max(compare, i) AS compare FROM r GROUP BY user_id""",
)
add("retry_budget", lambda s, d: V.user_series(s, d).select("user_id", K.retries(F.transform("values", lambda x: x > 95)).alias("state")), f"SELECT user_id, CASE WHEN s >= 100 THEN 'done' WHEN s > 3 THEN 'failed' ELSE 'pending' END AS state FROM (SELECT user_id, list_reduce(list_transform(v, lambda x: CASE WHEN x > 95 THEN 1 ELSE 0 END), lambda s, ok: CASE WHEN s >= 100 THEN s WHEN ok = 1 THEN 100 ELSE s + 1 END, 0) AS s FROM ({_SER}))")
add(
    "session_idle_grace", lambda s, d: W.grouped_sessions(V.user_sessions(s, d)),
    """WITH u AS (SELECT user_id, date_trunc('hour', ts) AS h, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1, 2), o AS (SELECT a, b, max(b + INTERVAL 5 SECOND) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM u),
    g AS (SELECT a, b, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (ORDER BY a, b) AS g FROM o) SELECT min(a) AS start_ts, max(b) AS end_ts, count(*) AS sessions FROM g GROUP BY g""",
)
add("event_rates", lambda s, d: W.rates(V.table(s, d, "events").withColumn("one", F.lit(1)), "1 hour", "one"), "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start_ts, count(*) AS n, CAST(count(*) AS BIGINT) AS total FROM events GROUP BY 1")
add(
    "stream_ladders",
    _line(
        streams=lambda n, q: T.stream_limit(n % 2000, q % 2 == 0), chunk=lambda n, q: T.chunk_size(q * 2, n * 10, n % 2 == 0), effective=lambda n, q: T.effective_chunk(n * 3, q), flush=lambda n, q: T.flush_threshold(q, n * 5),
        pool=lambda n, q: T.write_pool(q), hashers=lambda n, q: T.server_hash_workers(n % 3, q % 9), most=lambda n, q: T.most_hash_workers(n % 3 * 50, q), walkers=lambda n, q: T.walk_workers(q % 12),
    ),
    _lsql(
        streams="CASE WHEN q % 2 = 0 THEN 4 ELSE least(1024, greatest(1, n % 2000)) END",
        chunk="least(68719476736, greatest(65536, CASE WHEN n % 2 <> 0 THEN n * 10 WHEN q * 2 <= 8 THEN 4194304 WHEN q * 2 <= 16 THEN 2097152 WHEN q * 2 <= 32 THEN 1048576 WHEN q * 2 <= 64 THEN 524288 ELSE 262144 END))",
        effective="greatest(4096, CASE WHEN q <= 16 THEN greatest(n * 3, 1048576) WHEN q <= 32 THEN greatest(n * 3, 524288) ELSE n * 3 END // 4096 * 4096)",
        flush="CASE WHEN q <= 16 THEN greatest(4194304, n * 20) WHEN q <= 32 THEN greatest(2097152, n * 10) ELSE greatest(524288, n * 5) END", pool="least(32, greatest(8, q))",
        hashers="CASE WHEN n % 3 <> 0 THEN n % 3 WHEN q % 9 <= 1 THEN 1 ELSE least(16, greatest(2, q % 9 // 2)) END", most="CASE WHEN n % 3 = 0 THEN q ELSE greatest(n % 3 * 50, q * 4) END", walkers="least(16, greatest(1, q % 12) * 2)",
    ),
)
_FILES_IN = "CAST(floor(50000000::DOUBLE * (greatest(q * 3, 1)::DOUBLE / 1000) / {}::DOUBLE + 0.999) AS BIGINT)"
_MEAN = "least(1048576, greatest(4096, CASE WHEN n % 5 = 0 THEN 16384 ELSE n % 5 * n END))"
_DMEAN = "least(1048576, greatest(4096, CASE WHEN n % 5 = 0 THEN 262144 ELSE n % 5 * n END))"
add(
    "depth_ladders",
    _line(hash=lambda n, q: T.hash_depth(q * 3, n % 64, n % 5 * n), sig=lambda n, q: T.signature_depth(q * 3, n % 5 * n), streams=lambda n, q: T.wan_streams(q * 3, n % 6, n % 2 == 0, n % 9)),
    _lsql(
        hash=f"CASE WHEN q * 3 <= 10 THEN least(8192, greatest(1024, n % 64 * 256)) ELSE least(65536, greatest(1024, n % 64 * 256, {_FILES_IN.format(_MEAN)}, greatest(1, q * 3 // 10) * 8192)) END",
        sig=f"CASE WHEN q * 3 <= 10 THEN 0 ELSE least(8192, greatest({_FILES_IN.format(_DMEAN)}, greatest(1, q * 3 // 10) * 256, 256)) END",
        streams="CASE WHEN n % 2 <> 0 OR q * 3 <= 10 THEN n % 6 ELSE greatest(n % 6, least(CASE WHEN q * 3 <= 30 THEN 8 WHEN q * 3 <= 60 THEN 12 ELSE 16 END, 16, greatest(4, greatest(1, n % 9) * 2))) END",
    ),
)
_TIER = "CASE WHEN n % 150000 > 120000 THEN {} WHEN n % 150000 > 60000 THEN {} WHEN n % 150000 > 16000 THEN {} WHEN n % 150000 < 1000 THEN {} ELSE {} END"
add(
    "batch_tiers", lambda s, d: _line(t=lambda n, q: T.batch_tiers(n % 150000, q))(s, d).select("l_orderkey", "l_linenumber", "t.*"),
    _lsql(threshold=f"greatest(CASE WHEN q <= 8 THEN 3200 ELSE 0 END, {_TIER.format(5120, 3840, 2560, 1280, 1920)}) * 1024", max_files=f"greatest(CASE WHEN q <= 8 THEN 12800 ELSE 0 END, {_TIER.format(20480, 15360, 10240, 5120, 7680)})", max_bytes=f"greatest(CASE WHEN q <= 8 THEN 640 ELSE 0 END, {_TIER.format(960, 640, 480, 200, 320)}) * 1048576"),
)
_policy = lambda n: F.element_at(F.array(*map(F.lit, ["primary", "aux", "auto"])), (n % 3 + 1).cast("int"))
_reason = lambda n: F.element_at(F.array(*map(F.lit, ["old_unreadable", "benefit", "reconstruct_io", "verify_fail", "sig_error", "other"])), (n % 6 + 1).cast("int"))
add(
    "route_rules",
    _line(
        blocks=lambda n, q: P.admits_blocks(n, q % 4, n % 7 == 0, allowed=True, capable=True, threshold=500_000), pinned=lambda n, q: P.forces_primary(n, _policy(n), q / 10, 500_000),
        after=lambda n, q: P.after_delta_failure(_reason(n), q % 2 == 0), queue=lambda n, q: P.queue_rank(F.element_at(F.array(*map(F.lit, ["retry", "regular", "batch", "retry_batch"])), (n % 4 + 1).cast("int"))),
        releases=lambda n, q: P.releases_slot(n % 2 == 0, n % 3 == 0, q % 2 == 0), write=lambda n, q: P.write_route(n % 2 == 0, q % 3 > 0), path=lambda n, q: P.write_path(n % 400_000),
        counted=lambda n, q: F.array_join(F.array(*[P.write_accounting(n % 2 == 0, q % 3 == 0)[c] for c in ("compared", "transferred", "driver", "fast")]), ","),
        mbps=lambda n, q: F.round(M.throughput_mbps(n, q / 10), 6), wait=lambda n, q: M.mean_wait(n, q % 5),
    ),
    _lsql(
        blocks="n >= 500000 AND q % 4 >= 2 AND n % 7 <> 0", pinned="n >= 500000 AND NOT (n % 3 = 1 OR (n % 3 = 2 AND q >= 20))", after="CASE n % 6 WHEN 4 THEN 'whole' WHEN 5 THEN NULL ELSE CASE WHEN q % 2 = 0 THEN 'blocks' ELSE 'whole' END END",
        queue="CAST(CASE n % 4 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 3 END AS INTEGER)", releases="n % 2 <> 0 AND n % 3 = 0 AND q % 2 <> 0", write="CASE WHEN n % 2 = 0 AND q % 3 > 0 THEN 'dispatch' ELSE 'sync_fail' END", path="CASE WHEN n % 400000 <= 262144 THEN 'fast' ELSE 'driver' END",
        counted="CASE WHEN n % 2 <> 0 THEN '0,0,0,0' WHEN q % 3 = 0 THEN '1,1,0,1' ELSE '1,1,1,0' END", mbps="round(n * 8.0::DOUBLE / greatest(1e-9, q / 10.0::DOUBLE) / 1e6, 6)", wait="CASE WHEN q % 5 > 0 THEN n // (q % 5) ELSE 0 END",
    ),
)
_HEXES = "CASE doc_id % 4 WHEN 0 THEN repeat('FF', 16) WHEN 1 THEN md5(text) WHEN 2 THEN repeat('00', 16) ELSE md5(concat(text, 'x')) END"
add(
    "forced_progress",
    lambda s, d: P.forced(V.table(s, d, "documents").selectExpr("CAST(doc_id AS STRING) AS path", "unhex(CASE WHEN doc_id % 8 = 0 THEN repeat('FF', 16) ELSE md5(text) END) AS local_hash"), V.table(s, d, "documents").filter("doc_id % 5 <> 0").selectExpr("CAST(doc_id AS STRING) AS path", f"unhex({_HEXES}) AS remote_hash")),
    f"SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 5 = 0 THEN 'TRANSFER' WHEN r <> repeat('FF', 16) AND r = l THEN 'SAME' ELSE 'DIFF' END AS action FROM (SELECT doc_id, {_HEXES} AS r, CASE WHEN doc_id % 8 = 0 THEN repeat('FF', 16) ELSE md5(text) END AS l FROM documents)",
)
add("verify_rule", lambda s, d: V.table(s, d, "documents").select("doc_id", P.needs_verify(F.expr(f"unhex({_HEXES})")).alias("verify")), "SELECT doc_id, doc_id % 4 <> 2 AS verify FROM documents")
# Addresses hold keys of any size, as the SQL's numbers do: an IPv4 one is the bytes of a sum, an IPv6 one has the key in its last four groups.
_S4N = "(167772160L + c_nationkey % 3 * 65536 + c_nationkey % 8 * 7680 + c_nationkey)"
_C4, _S4 = "concat('10.', c_custkey % 3, '.', c_custkey % 8 * 30, '.', c_custkey % 250)", f"concat({_S4N} div 16777216, '.', {_S4N} div 65536 % 256, '.', {_S4N} div 256 % 256, '.', {_S4N} % 256)"
_low = lambda c: "concat_ws(':', " + ", ".join(f"substr(lpad(hex({c}), 16, '0'), {i}, 4)" for i in (1, 5, 9, 13)) + ")"
add(
    "subnets",
    # the rules cost far more than the two short columns: dealt out, a file of one split keeps all cores busy
    lambda s, d: V.table(s, d, "customer").select("c_custkey", "c_nationkey").repartition("c_custkey").selectExpr("c_custkey", f"{_C4} AS c", f"{_S4} AS s", "c_custkey % 35 AS p", "concat('fe', substr('789abcde', c_custkey % 8 + 1, 1), '0::1%eth0') AS v6", f"concat('2001:db8:', c_custkey % 3, '::', {_low('c_custkey')}) AS c6", f"concat('[2001:DB8:', c_nationkey % 3, '::', {_low('c_nationkey')}, ']') AS s6").select(
        "c_custkey", S.same_subnet(F.col("c"), F.col("p"), F.col("s")).alias("same"), S.same_subnet(F.col("c6"), F.when(F.col("p") == 0, 0).otherwise(F.col("p") + 20), F.col("s6")).alias("same6"), S.excluded_address(F.col("v6")).alias("out"), S.family_rank(F.col("v6")).alias("rank"), S.same_subnet(F.col("c"), F.col("p"), F.col("c6")).alias("crossed")),
    """WITH x AS (SELECT c_custkey, c_custkey % 35 AS p, (10::BIGINT << 24) + (c_custkey % 3 << 16) + (c_custkey % 8 * 30 << 8) + c_custkey % 250 AS a, (10::BIGINT << 24) + (c_nationkey % 3 << 16) + (c_nationkey % 8 * 30 << 8) + c_nationkey AS b, c_custkey % 3 AS u, c_nationkey % 3 AS v FROM customer),
    y AS (SELECT *, CASE WHEN p BETWEEN 1 AND 32 THEN p ELSE 24 END AS bits, CASE WHEN p = 0 THEN 64 ELSE p + 20 END AS wide FROM x)
    SELECT c_custkey, a >> CAST(32 - bits AS INTEGER) = b >> CAST(32 - bits AS INTEGER) AS same, CASE WHEN wide >= 48 THEN u = v WHEN wide = 47 THEN u >> 1 = v >> 1 ELSE true END AS same6, c_custkey % 8 BETWEEN 1 AND 4 AS out, 1 AS rank, false AS crossed FROM y""",
)
add(
    "range_lanes", lambda s, d: P.range_lanes(V.table(s, d, "orders").selectExpr("o_custkey % 25 AS grp", "concat('f', o_orderkey % 7) AS path", "o_orderkey AS offset"), V.lanes(s, d), "grp", stream_limit=6),
)
add("session_counts", lambda s, d: M.session_counts(V.user_sessions(s, d).withColumn("end_ts", F.expr("CASE WHEN user_id % 3 > 0 THEN end_ts END"))), "SELECT count(*) FILTER (user_id % 3 = 0) AS active, count(*) AS created FROM (SELECT DISTINCT user_id, date_trunc('hour', ts) AS h FROM events)")
add("slots_and_streams", lambda s, d: V.windows(s, d).select("user_id", K.worker_cap(F.transform("samples", lambda x: F.struct((x["failures"] > 0).alias("failed"), (x["backlog"] > 9).alias("backlog"), (x["rate"] > 30).alias("busy"))), 8, 1, 32).alias("workers"), K.stream_cap(F.transform("samples", lambda x: F.struct((x["in_flight"]).alias("done"), (x["outstanding"] / 10).cast("long").alias("failed"))), 16).alias("streams")),
    """WITH RECURSIVE x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id % 31 = 0 AS bad, event_id % 60 > 9 AND coalesce(value, 0) > 30 AS more, (event_id * 7919) % 1000 AS done, event_id % 300 // 10 AS failed FROM events),
    r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, 8 AS w, 16 AS s FROM events UNION ALL SELECT r.user_id, x.i, CASE WHEN bad THEN greatest(1, w // 2) WHEN more THEN least(32, w + 1) ELSE w END, CASE WHEN done >= 200 AND failed * 50 > done THEN greatest(4, s // 2) ELSE s END FROM r JOIN x ON x.user_id = r.user_id AND x.i = r.i + 1)
    SELECT user_id, arg_max(w, i) AS workers, arg_max(s, i) AS streams FROM r GROUP BY user_id""")  # fmt: skip
