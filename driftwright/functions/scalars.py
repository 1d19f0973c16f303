"""Scalar rules of comparison, delta and transfer planning, as column expressions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Raw times above this are Unix nanoseconds; those from EPOCH_TICKS on are 100 ns ticks since 1601.
UNIX_NS_FROM = 500_000_000_000_000_000
EPOCH_TICKS = 116_444_736_000_000_000
MAX_LONG = 9_223_372_036_854_775_807
#: Two times within this many nanoseconds count as equal.
TOLERANCE_NS = 2_000_000


def long(x) -> Column:
    return F.lit(x).cast("long")


def unix_ns(raw: Column) -> Column:
    """A raw time as Unix nanoseconds for comparing; null where it has no valid reading."""
    ticks = raw - long(EPOCH_TICKS)
    return F.when(raw > UNIX_NS_FROM, raw).when((raw >= EPOCH_TICKS) & (ticks <= MAX_LONG // 100), F.try_multiply(ticks, long(100)))


def write_ns(raw: Column) -> Column:
    """A raw time as Unix nanoseconds for stamping files: small values pass, never below 0."""
    return F.when(raw > UNIX_NS_FROM, raw).when(raw < EPOCH_TICKS, F.greatest(raw, long(0))).otherwise(F.greatest((raw - long(EPOCH_TICKS)) * 100, long(0)))


def same_time(a: Column, b: Column, tolerance: int = TOLERANCE_NS) -> Column:
    """Within the tolerance, inclusive; in raw units if either side has no valid reading."""
    x, y = unix_ns(a), unix_ns(b)
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= tolerance).otherwise(F.coalesce(F.abs(F.try_subtract(a, b)) <= tolerance, F.lit(False)))


def isqrt(n: Column) -> Column:
    """Exact floor of the square root: the double's guess, put right by one step either way."""
    guess = F.floor(F.sqrt(n.cast("double"))).cast("long")
    down = F.when(guess * guess > n, guess - 1).otherwise(guess)
    return F.when((down + 1) * (down + 1) <= n, down + 1).otherwise(down)


def block_size(file_size: Column) -> Column:
    """Square root of the size, up to a multiple of 1024, within 2048 and 131072."""
    return F.least(long(131072), F.greatest(long(2048), F.expr("1024L") * F.ceil(isqrt(file_size) / 1024).cast("long")))


def strong_len(blocks: Column) -> Column:
    return F.when(blocks <= 1 << 16, 8).when(blocks <= 1 << 22, 12).otherwise(16)


def bucket_of(weak: Column) -> Column:
    return F.shiftright(weak, 16).bitwiseXOR(weak.bitwiseAND(0xFFFF))


def div(a: Column, b) -> Column:
    """Integer division of longs."""
    return F.call_function("div", a, b if isinstance(b, Column) else long(b))


def early_stop_prefix(block: Column, old_size: Column) -> Column:
    five = div(old_size, 100) * 5 + div((old_size % 100) * 5, 100)
    return F.least(long(256 << 20), F.greatest(F.greatest(long(1 << 20), block * 256), five))


def rejects_benefit(download: Column, new_size: Column) -> Column:
    """A delta is refused if it downloads 65 % of the new file or more; 0 of 0 is refused."""
    return download * 100 >= new_size * 65


def rejects_projection(matched: Column, scanned: Column, old_size: Column, new_size: Column) -> Column:
    """Whether the matches so far, carried on to the whole old file, come to 35 % of the new one or less."""
    big = lambda c: c.cast("decimal(38,0)")
    return F.when(scanned == 0, F.lit(False)).otherwise(big(matched) * big(old_size) * 100 <= big(new_size) * big(scanned) * 35)


def size_units(text: Column) -> Column:
    """'64k', '2GB', '10' to bytes; null if malformed or too large. Suffixes: none, b, k, kb, m, mb, g, gb, any case."""
    number = F.regexp_extract(text, r"(?i)^([0-9]+)(b|k|kb|m|mb|g|gb)?$", 1).try_cast("long")
    unit = F.lower(F.regexp_extract(text, r"(?i)^([0-9]+)(b|k|kb|m|mb|g|gb)?$", 2))
    scale = F.when(unit.isin("k", "kb"), long(1 << 10)).when(unit.isin("m", "mb"), long(1 << 20)).when(unit.isin("g", "gb"), long(1 << 30)).otherwise(long(1))
    return F.try_multiply(number, scale)


def duration_ms(text: Column) -> Column:
    """'30', '5s', '2m', '1h' to milliseconds; null if malformed."""
    pattern = r"(?i)^([0-9]+)(s|sec|m|min|h|hr)?$"
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    scale = F.when(unit.isin("m", "min"), long(60_000)).when(unit.isin("h", "hr"), long(3_600_000)).otherwise(long(1000))
    return F.try_multiply(F.regexp_extract(text, pattern, 1).try_cast("long"), scale)


def strict_double(text: Column) -> Column:
    """The number that the whole text is, or null; infinities and not-a-number are refused."""
    x = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    return F.when(F.abs(x) < float("inf"), x)


def host_port(text: Column, default_port: int) -> tuple[Column, Column]:
    """Host and port of 'host', 'host:port', '[v6]:port' or a bare v6 address.

    A port counts from its leading digits and must be 1 to 65535; else the default holds, and the
    text stays whole (brackets still give their host).
    """
    number = lambda t: F.when((n := F.regexp_extract(t, r"^\s*\+?([0-9]+)", 1).try_cast("int")).between(1, 65535), n)
    bracket = text.rlike(r"^\[[^\]]*\]")
    after = F.regexp_extract(text, r"^\[[^\]]*\](.*)$", 1)
    inner = F.when(F.startswith(after, F.lit(":")), number(F.substr(after, F.lit(2))))
    colons = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))
    plain = F.when(colons == 1, number(F.substring_index(text, ":", -1)))
    host = F.when(bracket, F.regexp_extract(text, r"^\[([^\]]*)\]", 1)).when(plain.isNotNull(), F.substring_index(text, ":", 1)).otherwise(text)
    return host, F.coalesce(F.when(bracket, inner).otherwise(plain), F.when(text.isNotNull(), default_port))


def host_list(text: Column, default_port: int) -> Column:
    """Array of (host, port) of a comma-separated list; blank entries are left out."""
    one = lambda e: F.struct(*[c.alias(n) for n, c in zip(("host", "port"), host_port(e, default_port), strict=True)])
    return F.transform(F.filter(F.transform(F.split(text, ","), lambda e: F.trim(e)), lambda e: e != ""), one)


def relative_path(path: Column) -> Column:
    """Forward slashes, without one leading ./ ; '.' is empty."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")
    return F.when(p == ".", F.lit("")).otherwise(p)


def join_path(directory: Column, name: Column) -> Column:
    return F.when(directory == "", name).otherwise(F.concat(directory, F.lit("/"), name))


def parent_dir(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def streams_for_rtt(ms: Column) -> Column:
    return F.when(ms <= 10, 4).when(ms <= 30, 8).when(ms <= 60, 12).otherwise(16)


def reserved_slots(limit: Column) -> Column:
    """Slots kept for small files: all but one up to a limit of 2, else an eighth, within 2 and 4."""
    return F.when(limit <= 2, F.greatest(limit - 1, long(0))).otherwise(F.least(long(4), F.greatest(long(2), div(limit, 8))))


def backpressure_us(pressure: Column, limit: Column) -> Column:
    over = pressure - limit
    return (
        F.when(over <= 0, 0).when(over > limit * 2, 5000).when(over > limit, 3000).when(over > div(limit, 2), 1500).when(over > div(limit, 4), 700).otherwise(300)
    )


def reconnect_seconds(attempt: Column) -> Column:
    """1, 2, 4 ... seconds by attempt (from 1), at most 30."""
    power = F.greatest(F.least(attempt - 1, F.lit(5)), F.lit(0)).cast("int")
    return F.least(F.lit(30), F.call_function("shiftleft", F.lit(1), power))


def align_up(x: Column, unit: int) -> Column:
    return div(x + (unit - 1), unit) * unit


def align_down(x: Column, unit: int) -> Column:
    return div(x, unit) * unit


def elapsed(seconds: Column) -> Column:
    """1h 2m 3.4s; leading zero parts are left out."""
    hours, minutes = F.floor(seconds / 3600).cast("long"), F.floor((seconds % 3600) / 60).cast("long")
    rest = F.format_string("%.1fs", (seconds % 60).cast("double"))
    return F.when(hours > 0, F.format_string("%dh %dm %s", hours, minutes, rest)).when(minutes > 0, F.format_string("%dm %s", minutes, rest)).otherwise(rest)


#: Handshake, authentication and desync errors: parts of a text, and beginnings.
FATAL_PARTS = ["Protocol version mismatch", "Server authentication rejected", "Authentication failed", "Server HELLO missing", "client received wrong-direction/unknown frame", "RecvFrame desync:"]
FATAL_PREFIXES = ["Protocol error: ", "Server error: "]


def fatal(reason: Column, contains: list[str] = FATAL_PARTS, prefixes: list[str] = FATAL_PREFIXES) -> Column:
    """Whether an error text names a condition that a retry won't mend. Null and empty texts name none."""
    out = F.lit(False)
    for c in contains:
        out = out | F.contains(reason, F.lit(c))
    for p in prefixes:
        out = out | F.startswith(reason, F.lit(p))
    return F.coalesce(out, F.lit(False))


def excluded_address(ip: Column) -> Column:
    """Empty, wildcard, loopback and link-local addresses, whatever their zone."""
    a = F.lower(F.substring_index(F.coalesce(ip, F.lit("")), "%", 1))
    return (a == "") | a.startswith("127.") | a.startswith("169.254.") | a.isin("0.0.0.0", "::", "::1") | a.rlike("^fe[89ab]")


def family_rank(ip: Column) -> Column:
    """0 for IPv4 and names, 1 for IPv6."""
    return F.when(F.contains(ip, F.lit(":")), 1).otherwise(0)


def _let(x: Column, f) -> Column:
    """f(x), with x worked out once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _v4_hex(ip: Column) -> Column:
    parts = F.transform(F.split(ip, r"\."), lambda p: p.cast("int"))
    digits = _let(parts, lambda a: F.when(F.forall(a, lambda p: p <= 255), F.array_join(F.transform(a, lambda p: F.lpad(F.hex(p), 2, "0")), "")))
    return F.when(ip.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), digits)


def _v6_hex(ip: Column) -> Column:
    short = F.contains(ip, F.lit("::"))
    once = F.length(F.replace(ip, F.lit("::"), F.lit(""))) == F.length(ip) - 2
    some = lambda t: F.filter(F.split(t, ":"), lambda x: x != "")
    halves = F.struct(some(F.substring_index(ip, "::", 1)).alias("left"), F.when(short, some(F.substring_index(ip, "::", -1))).otherwise(F.array().cast("array<string>")).alias("right"))

    def joined(h):
        fill = F.lit(8) - F.size(h["left"]) - F.size(h["right"])
        groups = F.concat(h["left"], F.array_repeat(F.lit("0"), F.greatest(fill, F.lit(0))), h["right"])
        digits = _let(groups, lambda g: F.when(F.forall(g, lambda x: x.rlike("^[0-9A-Fa-f]{1,4}$")), F.upper(F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), ""))))
        return F.when(F.when(short, (fill >= 1) & once).otherwise(fill == 0), digits)

    return _let(halves, joined)


def _address_hex(ip: Column) -> Column:
    """8 or 32 hex digits of an IPv4 or IPv6 address; null if malformed."""
    return _let(ip, lambda a: F.when(F.contains(a, F.lit(":")), _v6_hex(a)).otherwise(_v4_hex(a)))


def same_subnet(client: Column, prefix: Column, server: Column) -> Column:
    """Whether two addresses of one family agree in their first bits: `prefix`, or 24 (IPv4) and 64 (IPv6) where that is out of range."""
    bare = lambda ip: F.regexp_replace(F.substring_index(ip, "%", 1), r"[\[\]]", "")

    def agree(x):
        a, b = x["a"], x["b"]
        bits = F.when(F.length(a) == 8, F.when(x["p"].between(1, 32), x["p"]).otherwise(24)).otherwise(F.when(x["p"].between(1, 128), x["p"]).otherwise(64)).cast("int")
        return (F.length(a) == F.length(b)) & _let(bits, lambda n: _agree(a, b, n))

    both = F.struct(_address_hex(bare(client)).alias("a"), _address_hex(bare(server)).alias("b"), prefix.alias("p"))
    return F.coalesce(_let(both, agree), F.lit(False))


def _agree(a: Column, b: Column, bits: Column) -> Column:
    whole = F.floor(bits / 4).cast("int")
    nibble = lambda h: F.floor(F.conv(F.substr(h, whole + 1, F.lit(1)), 16, 10).cast("int") / F.call_function("shiftleft", F.lit(1), F.lit(4) - bits % 4))
    return (F.substr(a, F.lit(1), whole) == F.substr(b, F.lit(1), whole)) & ((bits % 4 == 0) | (nibble(a) == nibble(b)))
