"""Secret scan: base patterns, then assignment-aware lexing.

The lexer reads source and configuration syntax (name = "literal", name: literal, "name" => ...,
name: type = "literal"), also inside of values, into name-literal pairs, propagates constants (password = KEY where KEY = "..." came before or
after) and scores a literal by how sensitive its target's name is. Literals that score high add
spans of kind "lexed" unless a base span covers them. Each text is read whole, by its own task row.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, without

ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "lexed")

NAME = re.compile(r"[A-Za-z_$][\w.$-]*+", re.A)
VALUE = r"(?:\"(?P<double>[^\"\n]*+)\"|'(?P<single>[^'\n]*+)'|`(?P<back>[^`\n]*+)`|(?P<bare>[^\s\"'`,;(){}\[\]]))"
#: What follows a name: an operator and a value, of which a bare one is only begun.
PAIR = re.compile(r"[\"'\]]{0,2}[ \t]*+(?P<op>:=|=>|==?|:)[ \t]*+" + VALUE, re.A)
#: Types that no literal is mistaken for, and what may stand around a type's name.
TYPE = r"(?:string|str|text|bytes?|char|rune|varchar|nvarchar|any|object|unknown|var|auto|int|long|number|boolean|bool|final|readonly|String|Str|SecretStr|CharSequence|Any|Object|Optional|Option|Final|ClassVar|Union|Vec|List|Array|i8|u8|i32|u32|i64|u64)"
MARKS = r"(?:[&*?!]|\[\d*\]|'\w++[ \t]|(?:readonly|const|mut|dyn|static)[ \t])*+"
BEHIND = r"(?:\(\d+\)|[<\[][\w.$<>\[\], \t|&?*]*+)?+[?!*]?(?:[ \t]*+\|[ \t]*+[\w.$\[\]]++)*+"
#: The same with a type between name and operator: name: type = value, name type = value, name[8] = value.
DECLARED = re.compile(
    rf"[\"'\]]{{0,2}}(?:(?P<colon>[?!]?:)?(?P<blank>[ \t]*+)(?P<type>{MARKS}(?P<head>(?:\w++(?:\.|::))*+[A-Za-z_$][\w$]*+){BEHIND})|(?P<bounds>\[\d*\]))[ \t]*+(?P<op>:?=)(?![=>])[ \t]*+" + VALUE, re.A
)
KNOWN = re.compile(rf"(?:\w+(?:\.|::))*{TYPE}", re.A)
BARE = re.compile(r"[^\s\"'`,;(){}\[\]]++")
IDENTIFIER = re.compile(r"[A-Za-z_$][\w.$]*", re.A)
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: How sensitive a part of a target's name is.
WEIGHTS = {
    "password": 3, "passwd": 3, "pwd": 3, "pass": 2, "passphrase": 3, "secret": 3, "token": 2, "credential": 3, "credentials": 3, "apikey": 3,
    "key": 1, "api": 1, "private": 2, "access": 1, "auth": 2, "bearer": 2, "client": 1, "signing": 1, "encryption": 1, "salt": 1, "dsn": 1, "session": 1,
}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*|%.*%|change_?me|example|none|null|true|false|todo|your[_-].*|test|dummy|password|secret|token)$")
LEAST_SCORE, LEAST_LENGTH, LEAST_ENTROPY = 3.0, 6, 2.0


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in (text.count(x) for x in set(text)))


def name_score(name: str) -> float:
    parts = [p.lower() for p in PART.findall(name.rsplit(".", 1)[-1])]
    return sum(WEIGHTS.get(p, 0) for p in dict.fromkeys(parts)) + (2 if "apikey" in "".join(parts) else 0)


def _declared(text: str, at: int) -> tuple[re.Match, bool] | None:
    """A type and a value behind the name that ends at `at`, and whether the type can be nothing but a type."""
    m = DECLARED.match(text, at)
    if m is None or m["bounds"]:
        return m and (m, True)
    known = bool(KNOWN.fullmatch(m["head"])) or m["type"] != m["head"]
    if not m["colon"] and not (m["blank"] and KNOWN.fullmatch(m["head"])):
        return None  # two words side by side
    return m, known


def _assignments(text: str) -> list[tuple[str, int, int, bool]]:
    """(name, start, end, quoted) of every assignment's literal, which is not copied: bare ones may overlap at length.

    Every word is tried as a name, also those inside another's value, so that a label takes nothing
    from the assignment behind it. A type between name and operator is passed over.
    """
    out = []
    typed = quote = begun = run = compared = -1  # ends of the last type and outer quoted value; the last bare run; start of a value that is compared

    def add(name, m):
        nonlocal quote, begun, run, compared
        if m.lastgroup == "bare":
            a = m.start("bare")
            if not begun <= a < run:
                begun, run = BARE.match(text, a).span()
            b = run
        else:
            a, b = m.span(m.lastgroup)
            quote = b if a > quote else quote
        compared = a if m["op"] == "==" else compared
        out.append((name, a, b, m.lastgroup != "bare"))

    for word in NAME.finditer(text):
        if word.start() < typed:
            continue
        declared = _declared(text, word.end())
        if declared and not (word.start() < quote <= declared[0].start("op")):
            add(word[0], declared[0])
            if declared[1]:
                typed = max(declared[0].end("type"), typed)
                continue
        m = PAIR.match(text, word.end())
        if m and not (word.start() < quote <= m.start("op")) and not (word.start() == compared and m["op"] == ":"):
            add(word[0], m)
    return out


def lex(text: str) -> list[tuple[str, str, int, int, bool]]:
    """(name, literal, start, end, quoted) of every assignment; offsets are of the literal, in code points."""
    return [(name, text[a:b], a, b, quoted) for name, a, b, quoted in _assignments(text)]


def lexed_spans(text: str) -> list[tuple[int, int]]:
    pairs = [(name, a, b, not quoted and IDENTIFIER.fullmatch(text, a, b)) for name, a, b, quoted in _assignments(text)]
    constants: dict[str, list[tuple[int, int]]] = {}
    for name, a, b, named in pairs:
        if not named:
            constants.setdefault(name, []).append((a, b))
    alias = {name: text[a:b] for name, a, b, named in pairs if named}
    found = set()
    for name, a, b, named in pairs:
        if name_score(name) < LEAST_SCORE:
            continue
        values, seen = [(a, b)], set()
        if named:
            target = text[a:b]
            while target in alias and target not in constants and target not in seen:  # through names that name names
                seen.add(target)
                target = alias[target]
            values = constants.get(target, values)
        found |= {(x, y) for x, y in values if y - x >= LEAST_LENGTH and not PLACEHOLDER.match(v := text[x:y]) and entropy(v) >= LEAST_ENTROPY}
    return sorted(found)


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then kind."""
    if not text:
        return []
    spans = [("hex", *m.span()) for m in HEX.finditer(text)]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    if "=" in text or ":" in text:
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_LENGTH]
        base = list(spans)
        spans += [("lexed", a, b) for a, b in lexed_spans(text) if not any(s <= a and b <= e for _, s, e in base)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan_secrets(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with secrets: array of (kind, start, end), offsets in code points, end exclusive.

    Null and empty texts have none. Rows are kept one for one; a column named secrets is replaced.
    """
    docs = without(docs, "secrets")
    schema = docs.withColumn("secrets", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in scan(t.as_py())] for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "secrets"])

    return docs.mapInArrow(run, schema)


def digest(spans):
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = {f"n_{k}": F.size(F.filter("secrets", _is(k))).cast("long") for k in KINDS}
    base = F.filter("secrets", lambda s: s["kind"] != "lexed")
    return found.select("doc_id", *(count[f"n_{k}"].alias(f"n_{k}") for k in KINDS[:3]), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("secrets")).alias("spans"), count["n_lexed"].alias("n_lexed"))
