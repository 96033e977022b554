"""Personal data by weak supervision (op 9).

Candidates are the base spans (strict regexes and checks) and looser ones of
the same kinds (spelt-out addresses, numbers without a plus, card-like digits).
Labelers vote on each candidate - yes, no or nothing:

* shape      the strict regex
* gazetteer  known top-level domains, address ranges, country codes, issuers
* context    words close before it that speak for or against the kind
* checksum   check digits, digit counts, even grouping

Expectation-maximisation (a two-class model with one reliability pair for each
kind and labeler) is run on the table of vote patterns, counted over all
candidates of all documents: at most 3**4 patterns a kind, so it is exact and
small.  Its posteriors are the soft labels of a final span classifier, a
logistic regression over votes, length and layout, trained on the counted
feature patterns (bounded as well, no sampling).  Candidates it accepts become
spans unless they overlap a base span or an accepted one before them; base spans always stay.

Defined results: null text is empty; each row is judged by itself (repeated
rows, null doc_ids); without candidates there is nothing to learn and only
empty results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.llm.registry import register
from riskfold.llm.secret_scan import counted, joined
from riskfold.llm.words import documents, slices, texts
from riskfold.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("shape", "gazetteer", "context", "checksum")
YES, NO, NOTHING = 1, 0, 2
ACCEPT = 0.9
CONTEXT = 40  # characters before a candidate

# fixed values: the base regexes (that of emails stands at its function)
BASE = {
    # a match can only begin where a run of digits does: linear on any text
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?:(?: ?[(\[]dot[)\]] ?| dot |\.)[A-Za-z0-9-]{2,63}){1,4}"
                        r"|[A-Za-z0-9._%+-]{1,64} at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{2,63}){1,4}", re.I),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{4}[ .-]){3}[0-9]{2,7}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z.+-])(?:00 ?[1-9][0-9]{0,2}(?:[ ./-][0-9](?=[ ./-]))?|\(?0?[1-9][0-9]{1,3}\)?)[ ./-]?[0-9]{2,4}(?:[ ./-][0-9]{2,4}){1,3}(?![0-9A-Za-z])"),
}
TOP_DOMAINS = frozenset("com org net edu gov info io de fr es it uk eu us ca ch at nl be pl ru jp cn in br au".split())
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "82", "86", "90", "91")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35")
FOR = {
    "email": re.compile(r"(e-?mail|mailto|contact|kontakt|correo|courriel|write to|reach)", re.I),
    "ip": re.compile(r"(\bip\b|addr|host|server|from|login|subnet|ping)", re.I),
    "card": re.compile(r"(card|visa|master|amex|credit|debit|karte|carte|tarjeta)", re.I),
    "phone": re.compile(r"(phone|tel\b|tel[.:]|call|mobile|cell|fax|telefon|t[ée]l[ée]phone|tel[ée]fono|whatsapp)", re.I),
}
AGAINST = re.compile(r"(version|release|isbn|issn|order|invoice|page|chapter|section|figure|table|room|line|build|ref|total|[$€£%])[^a-z]*$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found
    from each @ outwards: linear on any text."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    return out


def base_ok(kind: str, span: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in span.split("."))
    if kind == "card":
        d = _digits(span)
        return 14 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(_digits(span)) <= 15
    return True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), by start and kind."""
    out = []
    for k, kind in enumerate(KINDS):
        if kind == "email":
            out += [(a, k, b) for a, b in emails(text)]
            continue
        out += [(m.start(), k, m.end()) for m in BASE[kind].finditer(text) if base_ok(kind, m[0])]
    return sorted(out)


def votes(kind: str, text: str, start: int, end: int, strict: bool) -> tuple[int, int, int, int]:
    span = text[start:end]
    digits = _digits(span)
    before = text[max(0, start - CONTEXT):start]
    gazetteer = checksum = NOTHING
    if kind == "email":
        gazetteer = YES if re.split(r"\W+", span.lower())[-1] in TOP_DOMAINS else NO
        checksum = YES if strict or re.search(r"[(\[](at|dot)[)\]]", span, re.I) else NOTHING
    elif kind == "ip":
        parts = span.split(".")
        gazetteer = NO if ":" not in span and (parts[0] in ("0", "") or int(parts[0][:4]) >= 240) else YES
        checksum = YES if ":" in span or all(p == str(int(p[:9])) for p in parts) else NO
    elif kind == "card":
        gazetteer = YES if digits.startswith(ISSUERS) else NO
        checksum = YES if 14 <= len(digits) <= 19 and luhn(digits) else NO
    else:
        code = digits[2:] if span.startswith("00") else digits if span.startswith("+") else None
        if code is not None:
            gazetteer = YES if code.startswith(COUNTRY_CODES) else NO
        else:  # a number of the same country opens with a trunk 0 or an area code in brackets
            gazetteer = NOTHING if span.startswith(("0", "(")) else NO
        checksum = YES if 10 <= len(digits) <= 15 else NO
    context = NO if AGAINST.search(before) else YES if FOR[kind].search(before) else NOTHING
    return YES if strict else NOTHING, gazetteer, context, checksum


def layout(span: str) -> int:
    """Length in steps, kinds of separators: a small number of patterns."""
    return min(len(span) // 8, 4) * 4 + 2 * (" " in span) + ("-" in span or "(" in span)


def candidates(text: str) -> list[tuple[int, int, int, bool, int]]:
    """(start, kind, end, is base, pattern number) by start and kind."""
    if "@" not in text and not _ANY.search(text):
        return []
    out = []
    base = base_spans(text)
    taken = {(k, a) for a, k, _ in base}
    found = [(a, k, b, True) for a, k, b in base]
    for k, kind in enumerate(KINDS):
        for m in LOOSE[kind].finditer(text):
            if (k, m.start()) not in taken and not any(a < m.end() and m.start() < b for a, _, b in base):
                found.append((m.start(), k, m.end(), False))
    for a, k, b, strict in sorted(found):
        v = votes(KINDS[k], text, a, b, strict)
        number = k
        for x in v:
            number = number * 3 + x
        out.append((a, k, b, strict, number * 20 + layout(text[a:b])))
    return out


_ANY = re.compile(r"[0-9]| dot |[(\[]at[)\]]", re.I)


def unpack(pattern: int) -> tuple[int, tuple[int, ...], int]:
    pattern, lay = divmod(pattern, 20)
    v = []
    for _ in LABELERS:
        pattern, x = divmod(pattern, 3)
        v.append(x)
    return pattern, tuple(reversed(v)), lay


def em(kinds: np.ndarray, vote: np.ndarray, count: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of "personal" for each pattern, and the reliabilities
    (kind, labeler, class): how often a labeler that votes says yes."""
    n = len(KINDS)
    weight = count.astype(float)
    yes, no = vote == YES, vote == NO
    start = yes.sum(axis=1) - no.sum(axis=1)
    post = 1 / (1 + np.exp(-start.astype(float)))
    rate = np.zeros((n, len(LABELERS), 2))
    for _ in range(rounds):
        prior = np.zeros(n)
        for k in range(n):
            w = weight * (kinds == k)
            prior[k] = ((w * post).sum() + 1) / (w.sum() + 2)
            for c, p in enumerate((1 - post, post)):
                # the prior counts say that a labeler is right rather than wrong
                good = np.array([1.0, 4.0]) if c else np.array([4.0, 1.0])
                says_no, says_yes = (w * p) @ no + good[0], (w * p) @ yes + good[1]
                rate[k, :, c] = says_yes / (says_yes + says_no)
        r = rate[kinds]
        like = [np.log(np.where(yes, r[:, :, c], np.where(no, 1 - r[:, :, c], 1.0))).sum(axis=1) for c in (0, 1)]
        score = np.log(prior[kinds]) + like[1] - np.log(1 - prior[kinds]) - like[0]
        new = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return post, rate


def _features(patterns: list[int]) -> np.ndarray:
    rows = []
    for p in patterns:
        kind, vote, lay = unpack(p)
        x = [1.0]
        for k in range(len(KINDS)):
            for v in vote:
                x += [float(k == kind and v == YES), float(k == kind and v == NO)]
            x.append(float(k == kind))
        rows.append(x + [lay // 4 / 4.0, float(lay >> 1 & 1), float(lay & 1)])
    return np.array(rows)


def span_classifier(patterns: list[int], count: np.ndarray, soft: np.ndarray, steps: int = 50) -> dict[int, float]:
    """Logistic regression on soft labels (Newton steps, ridge 1); score of
    each feature pattern."""
    x = _features(patterns)
    w = np.zeros(x.shape[1])
    scale = count / count.sum() * min(count.sum(), 1e6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (scale * (soft - p)) - w
        bend = (x.T * (scale * p * (1 - p))) @ x + np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return dict(zip(patterns, p.tolist()))


def learn(rows: list[tuple[int, int]]) -> dict[int, float]:
    """(pattern, count) of all candidates -> pattern -> probability."""
    if not rows:
        return {}
    rows = sorted(rows)
    patterns, count = [p for p, _ in rows], np.array([c for _, c in rows], dtype=float)
    parts = [unpack(p) for p in patterns]
    soft, _ = em(np.array([k for k, _, _ in parts]), np.array([v for _, v, _ in parts]), count)
    return span_classifier(patterns, count, soft)


def resolve(found: list[tuple[int, int, int, bool, int]], odds: dict[int, float], accept: float) -> list[tuple[int, int, int, bool]]:
    out, reach = [], -1
    for a, k, b, strict, pattern in found:
        if strict:
            out.append((a, k, b, True))
        elif a >= reach and odds.get(pattern, 0.0) >= accept:
            out.append((a, k, b, False))
            reach = b
    return out


CANDIDATE = "array<struct<start:int,kind:int,end:int,base:boolean,pattern:int>>"


def find_personal(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, base), by start and kind."""
    candidate = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("pattern", pa.int32())]))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    names = ("start", "kind", "end", "base", "pattern")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [[dict(zip(names, c)) for c in candidates(t)] for t in texts(part)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, candidate)], names=["doc_id", "found"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = cut_lineage(docs.select("doc_id", "text").mapInArrow(extract, f"doc_id {id_type}, found {CANDIDATE}"))
    counts = rows.select(F.explode("found.pattern").alias("pattern")).groupBy("pattern").count().collect()
    odds = learn([(r["pattern"], r["count"]) for r in counts])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.column("found").to_pylist():
                kept = resolve([tuple(c[n] for n in names) for c in found], odds, accept)
                out.append([{"kind": KINDS[k], "start": a, "end": b, "base": s} for a, k, b, s in kept])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, span)], names=["doc_id", "spans"])

    return rows.mapInArrow(decide, f"doc_id {id_type}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


@register("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(documents(spark, sf_dir)).withColumn("base", F.filter("spans", lambda s: s["base"]))
    return found.select("doc_id", *(counted("base", k).alias(f"n_{k}") for k in KINDS),
                        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
