import hashlib
import re

import numpy as np

from riskfold.llm import pii as P
from riskfold.llm.words import documents
from conftest import SF_SMALL
from llm.planted import planted


def luhn(d):
    s = [int(c) for c in d[::-1]]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def brute(text):
    """Base spans by the plain regexes."""
    t, out = text or "", []
    for k, (kind, pattern) in enumerate([
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(int(x.lstrip("0")[:5] or 0) for x in m[0].split(".")) > 255 or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) \
                    or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


TEXTS = ["Mail to anna.b@mail.example.com or call +49 30 1234 5678 now.", "host 10.1.2.3 and 300.1.2.3 and 1.2.3.4.5", "card 4111 1111 1111 1111 ok",
         "card 4111 1111 1111 1112 bad", "é語 x@y.de +1 (555) 010-9999.", "plain words only", "+12 3", "1-2-3 4 5 6 7 8 9 0 1 2 3 4 5",
         "write bob (at) example (dot) com please", "tel: 030 1234 5678 and fax 0049 30 123 456 78", "version 1.2.3.4", "2001:0db8:0000:0000:0000:ff00:0042:8329 addr",
         "4111111111111111+4930123456789@x.y.z", "000.000.000.255 0001.1.1.1", "", None, "a@b", "@", "+", "9" * 20,
         "0" * 5000 + ".1.1.1 " + "1" * 5000, "a@b.c-d%e@f.g @x.y a@@b.c a@b@c.d", "x" * 3000 + " @ y", "1.2.3.4.5.6.7.8.9 1..2.3.4.5"]


def test_base_spans_and_overlaps():
    for t in TEXTS:
        found = P.candidates(t or "")
        assert [(P.KINDS[k], a, b) for a, k, b, base, _ in found if base] == brute(t), t
        assert all(p // 20 < 4 * 81 for *_, p in found)


def test_patterns_round_trip():
    for a, k, b, base, p in P.candidates(" ".join(t for t in TEXTS if t)):
        kind, vote, lay = P.unpack(p)
        assert kind == k and vote[0] == (P.YES if base else P.NOTHING) and 0 <= lay < 20


def test_em_recovers_reliabilities():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.4
    right = np.array([0.95, 0.8, 0.7, 0.9])
    vote = np.where(rng.random((20000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    vote[rng.random((20000, 4)) < 0.2] = P.NOTHING
    rows, count = np.unique(vote, axis=0, return_counts=True)
    post, rate = P.em(np.zeros(len(rows), int), rows, count)
    assert np.abs(rate[0, :, 1] - right).max() < 0.03
    assert np.abs(rate[0, :, 0] - (1 - right)).max() < 0.03
    by = {tuple(r): p for r, p in zip(rows, post)}
    told = np.array([by[tuple(v)] > 0.5 for v in vote])
    assert (told == truth).mean() > 0.94


def run(df):
    return [(r.doc_id, [tuple(s) for s in r.spans]) for r in P.find_personal(df).collect()]


def test_method_adds_spans_and_base_ones_stay(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, TEXTS[0]), (7, TEXTS[0]), (99, "word " * 40000 + "mail x@y.com")]
    df = spark.createDataFrame([(a, b, "q", 1) for a, b in rows], "doc_id long, text string, spans string, found int")
    out = run(df)
    for (i, t), (j, spans) in zip(rows, out):
        assert i == j
        assert [s[:3] for s in spans if s[3]] == brute(t)
        assert spans == sorted(spans, key=lambda s: (s[1], P.KINDS.index(s[0])))
        added = [s for s in spans if not s[3]]
        for _, a, b, _ in added:
            assert not any(x < b and a < y for _, x, y, s in spans if (x, y) != (a, b) and (s or x < a))
    assert {s[0] for _, spans in out for s in spans if not s[3]}
    assert run(df.limit(0)) == []
    assert run(df.where("text = 'plain words only'").limit(1)) == [(5, [])]


def test_query_equals_brute_force(spark):
    docs = {}
    for d in documents(spark, SF_SMALL).collect():
        docs.setdefault(d.doc_id, []).append(d.text)
    total = 0
    for r in P.op9_pii(spark, SF_SMALL).collect():
        if len(docs[r.doc_id]) > 1:
            continue
        want = brute(docs[r.doc_id][0])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in P.KINDS]
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))
        total += len(want)
    assert total > 0


def test_added_spans_against_planted_truth(spark):
    """Spelt-out addresses, dotted cards, national and 00 phone numbers and
    IPv6 beside decoys, some of them with nothing before them that tells."""
    texts, truth = planted(1500, 7)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    added = {(i, k, a, b) for i, spans in run(df) for k, a, b, base in spans if not base}
    for kind in P.KINDS:
        real, got = {t for t in truth if t[1] == kind}, {t for t in added if t[1] == kind}
        assert len(real & got) >= 0.9 * len(real) > 200, kind
        assert len(real & got) >= 0.95 * len(got), kind


def _pattern(kind, vote, lay=6):
    for v in vote:
        kind = kind * 3 + v
    return kind * 20 + lay


def test_reliabilities_learnt_from_the_corpus_decide():
    """The same candidate, heard by a labeler that agrees with the others in
    one corpus and contradicts them in the other."""
    yes, no, nothing = P.YES, P.NO, P.NOTHING
    target = _pattern(3, (nothing, yes, nothing, nothing))
    agrees = P.learn([(_pattern(3, (yes, yes, yes, yes)), 1000), (_pattern(3, (nothing, no, no, no)), 1000), (target, 50)])
    contradicts = P.learn([(_pattern(3, (yes, no, yes, yes)), 1000), (_pattern(3, (nothing, yes, no, no)), 1000), (target, 50)])
    found = [(0, 3, 12, False, target)]
    assert len(P.resolve(found, agrees, P.ACCEPT)) == 1
    assert P.resolve(found, contradicts, P.ACCEPT) == []
