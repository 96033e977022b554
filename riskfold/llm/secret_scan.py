"""Secret scan over a trigram inverted index (op 10).

From the syntax tree of each rule's regex a Boolean query over trigrams is
derived: strings that every match must contain become ANDs of their trigrams,
alternatives become ORs.  A segment (a slice of a partition, some MB of text)
gets an inverted index from the queried trigrams to its documents; postings are
intersected and united as the query says, and only the documents that remain
are searched with the regex.  A rule whose regex has no mandatory trigram scans
every text.  The index folds A-Z, so it serves rules in either case.

Segments are built where the text lies: nothing is shuffled and no posting
list grows beyond its segment, however common a trigram is.

Defined results: null text is empty; every row is scanned by itself (repeated
rows, null doc_ids); kinds may overlap each other; an empty table gives no
rows; other columns are carried along (a column ``spans`` is replaced).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from riskfold.llm.registry import register
from riskfold.llm.words import documents, slices, texts

EXACT = 64  # strings kept exactly while a query is derived


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0      # characters of ``group`` that a match needs
    group: int = 0
    flags: int = re.ASCII
    span: int = 0       # group whose place is reported

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags)

    def spans(self, regex: re.Pattern, text: str) -> list[tuple[int, int]]:
        return [m.span(self.span) for m in regex.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


# fixed values: the base rules
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # tried once per run of token characters, and only where two more runs follow: linear in the text
    Rule("signed_token", r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]++\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{5})[A-Za-z0-9_-]*?"
                         r"(eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{5,})", span=1),
    Rule("payment_key", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("map_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@"),
)
RULES = BASE_RULES + MORE_RULES

# A query is True (all documents), a trigram, or (op, frozenset of queries).
Query = bool | str | tuple


def both(a: Query, b: Query) -> Query:
    if a is True or b is True:
        return b if a is True else a
    parts = frozenset().union(*(q[1] if isinstance(q, tuple) and q[0] == "and" else {q} for q in (a, b)))
    return ("and", parts) if len(parts) > 1 else next(iter(parts))


def either(queries: Sequence[Query]) -> Query:
    if any(q is True for q in queries):
        return True
    parts = frozenset(queries)
    parts -= {p for p in parts if isinstance(p, tuple) and p[0] == "and" and not parts.isdisjoint(p[1])}
    return ("or", parts) if len(parts) > 1 else next(iter(parts))


def contains(strings: set[str]) -> Query:
    """Some string of the set occurs."""
    def one(s: str) -> Query:
        q: Query = True
        for i in range(len(s) - 2):
            q = both(q, s[i:i + 3])
        return q
    return either([one(s) for s in strings]) if strings else True


def _fold(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def _node(op, arg) -> tuple[set[str] | None, Query]:
    """The exact strings a node matches (None: too many), and a query that
    every text with a match fulfils."""
    if op is C.LITERAL:
        return ({_fold(chr(arg))} if arg < 128 else None), True
    if op is C.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is C.LITERAL and value < 128:
                chars.add(_fold(chr(value)))
            elif kind is C.RANGE and value[1] < 128 and value[1] - value[0] < 8:
                chars |= {_fold(chr(c)) for c in range(value[0], value[1] + 1)}
            else:
                return None, True
        return (chars if len(chars) <= 8 else None), True
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        if all(e is not None for e, _ in parts):
            exact = set().union(*(e for e, _ in parts))
            if len(exact) <= EXACT:
                return exact, True
        return None, either([both(q, contains(e)) if e is not None else q for e, q in parts])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, body = arg
        exact, query = _sequence(body)
        if low == 0:
            return ({""} | exact, True) if high == 1 and exact is not None else (None, True)
        if low == high == 1:
            return exact, query
        return None, both(query, contains(exact)) if exact is not None else query
    if op is C.AT:
        return {""}, True
    return None, True


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    exact: set[str] = {""}
    query: Query = True
    whole = True
    for op, arg in nodes:
        strings, inner = _node(op, arg)
        query = both(query, inner)
        if strings is not None and len(exact) * len(strings) <= EXACT:
            exact = {a + b for a in exact for b in strings}
            continue
        query = both(query, contains(exact))
        whole = False
        exact = strings if strings is not None and len(strings) <= EXACT else {""}
    return (exact, query) if whole else (None, both(query, contains(exact)))


def trigram_query(pattern: str, flags: int = 0) -> Query:
    exact, query = _sequence(parser.parse(pattern, flags))
    return both(query, contains(exact)) if exact is not None else query


def trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


class Segment:
    """Inverted index of one slice: queried trigram -> documents, as bits."""

    _fold_table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

    def __init__(self, wanted: Sequence[str], codes: np.ndarray, rows: list[bytes]):
        data = np.frombuffer(b"\n".join(rows).translate(self._fold_table) + b"\n\n\n", dtype=np.uint8).astype(np.int32)
        gram = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        at = np.flatnonzero(codes[gram])
        row = np.searchsorted(np.cumsum([len(r) + 1 for r in rows]), at, side="right")
        self.postings = np.zeros((len(wanted) + 1, len(rows) + 1), dtype=bool)
        self.postings[codes[gram[at]], row] = True
        self.number = {t: i + 1 for i, t in enumerate(wanted)}
        self.size = len(rows)

    def matching(self, query: Query) -> np.ndarray:
        if query is True:
            return np.ones(self.size, dtype=bool)
        if isinstance(query, str):
            return self.postings[self.number[query], :self.size]
        parts = [self.matching(q) for q in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


def trigram_codes(wanted: Sequence[str]) -> np.ndarray:
    codes = np.zeros(1 << 24, dtype=np.uint16)
    for i, t in enumerate(wanted):
        a, b, c = t.encode("latin-1")
        codes[a << 16 | b << 8 | c] = i + 1
    return codes


def scanner(rules: Sequence[Rule]) -> Callable[[list[str]], list[list[tuple[int, int, int]]]]:
    """Rows of (start, rule number, end), sorted, for each text of a slice."""
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    wanted = sorted(set().union(*map(trigrams, queries)))
    codes = trigram_codes(wanted)
    regexes = [r.compiled() for r in rules]

    def scan(rows: list[str]) -> list[list[tuple[int, int, int]]]:
        found: list[list[tuple[int, int, int]]] = [[] for _ in rows]
        segment = Segment(wanted, codes, [t.encode() for t in rows])
        for k, (rule, regex, query) in enumerate(zip(rules, regexes, queries)):
            for i in np.flatnonzero(segment.matching(query)).tolist():
                found[i] += [(a, k, b) for a, b in rule.spans(regex, rows[i])]
        for f in found:
            f.sort()
        return found

    return scan


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` plus spans, by start and then in the order of the rules."""
    docs = docs.drop("spans")
    columns = docs.columns
    inner = [f"c{i}" for i in range(len(columns))]
    text = inner[columns.index("text")]
    kinds = [r.kind for r in rules]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        for part in slices(batches, text):
            found = [[{"kind": kinds[k], "start": a, "end": b} for a, k, b in f] for f in scan(texts(part, text))]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, span)], names=[*inner, "spans"])

    renamed = docs.toDF(*inner)
    schema = StructType(list(renamed.schema.fields)).add("spans", ArrayType(
        StructType().add("kind", StringType()).add("start", LongType()).add("end", LongType())))
    out = renamed.mapInArrow(run, schema)
    return out.select(*(F.col(i).alias(c) for i, c in zip(inner, columns)), "spans")


def joined(spans: str, kinds: Sequence[str] | None = None):
    """kind:start:end of the spans (of ``kinds``), comma-joined."""
    col = F.col(spans)
    if kinds is not None:
        col = F.filter(col, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: str, kind: str):
    return F.size(F.filter(F.col(spans), lambda s: s["kind"] == kind)).cast("long")


@register("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [r.kind for r in BASE_RULES]
    found = find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", *(counted("spans", k).alias(f"n_{k}") for k in base),
                        F.sha2(joined("spans", base), 256).alias("base_sha256"), joined("spans").alias("spans"))
