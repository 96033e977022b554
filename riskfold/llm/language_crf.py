"""Language of every word and document by a linear-chain CRF (op 4).

Words are runs of ASCII letters and non-ASCII characters, lower-cased in A-Z.
A word's features are its affixes (1 to 4 bytes at either end), the byte
bigrams and trigrams of its whole length with end marks, and its entry in the
learned lexicon (or a mark for words outside).  A state is a language; the learned
transition matrix scores a change from one word to the next, so a switch of
language inside a text costs evidence.  Forward-backward gives each word's
marginal; a document's language has the largest share of its marginals.

Training fits feature weights and transitions together by gradient ascent on
the log-likelihood of labelled passages, some joined to code-switched ones.  It
uses a bounded sample (parameters SAMPLE_DOCS documents a language by id hash,
SAMPLE_RUNS passages of RUN_WORDS words from places spread over each whole
text); prediction reads every text whole.  The model is 64k x languages
floats and travels with the function.  In scripts without blanks a paragraph is
one word; the sample cuts words of over PIECE characters into pieces.

Defined results: null text or no letter -> ``und`` with score 0; equal shares
-> the language first in code point order; a null doc_id counts as held out;
without any labelled row there is no language to predict and every document
gets ``und``; empty table -> no rows; extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskfold.llm.registry import register
from riskfold.llm.words import U64, documents, mix, slices, span_hashes, spans_of, texts

FEATURES = 1 << 16
SAMPLE_DOCS = 250
SAMPLE_RUNS = 4
RUN_WORDS = 30
PIECE = 100
LEXICON_COUNT = 4
STEPS = 60
UND = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


class Tokens:
    """Words of a slice, with one entry for each different word."""

    def __init__(self, rows: list[str]):
        raw = [t.encode() for t in rows]
        data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8).copy()
        data[(data >= 65) & (data <= 90)] += 32
        starts, ends = spans_of(~_LETTER[data])
        row_start = np.concatenate(([0], np.cumsum([len(t) + 1 for t in raw])))
        self.first = np.searchsorted(starts, row_start)
        self.hashes, at, self.word = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        self.data, self.starts, self.ends = data, starts[at], ends[at]


@dataclass
class Features:
    ids: np.ndarray    # feature numbers from 1 on; 0 where a slot is empty
    first: np.ndarray  # word w has ids[first[w]:first[w + 1]]

    def __iter__(self) -> Iterator[np.ndarray]:
        return (self.ids[a:b] for a, b in zip(self.first[:-1], self.first[1:]))


def feature_ids(tokens: Tokens) -> Features:
    """Affixes, then the bigram and trigram from each byte of the marked word."""
    n = len(tokens.starts)
    length = tokens.ends - tokens.starts

    def number(value: np.ndarray, kind: int, there: np.ndarray) -> np.ndarray:
        h = (value * np.uint32(2654435761) + np.uint32(kind * 40503 + 7)) * np.uint32(2246822519)
        return np.where(there, 1 + ((h >> np.uint32(15)) % np.uint32(FEATURES - 1)), 0)

    # the words one after the other, each between a start mark 1 and an end mark 2
    begin = np.concatenate(([0], np.cumsum(length + 2)))
    word = np.repeat(np.arange(n), length + 2)
    marked = tokens.data[np.arange(begin[-1]) + (tokens.starts - 1 - begin[:-1])[word]].astype(np.uint32)
    marked[begin[:-1]] = 1
    marked[begin[1:] - 1] = 2
    left = begin[1:][word] - np.arange(begin[-1])
    ahead = np.concatenate((marked, np.zeros(2, dtype=np.uint32)))
    pair = marked << np.uint32(8) | ahead[1:-1]
    ids = np.zeros(2 * begin[-1] + 8 * n, dtype=np.int32)
    place = 2 * np.arange(begin[-1]) + 8 * (word + 1)
    ids[place] = number(pair, 1, left > 1)
    ids[place + 1] = number(pair << np.uint32(8) | ahead[2:], 2, left > 2)
    first = 2 * begin + 8 * np.arange(n + 1)
    inside = np.arange(4) < length[:, None]
    head = np.where(inside, tokens.data[np.minimum(tokens.starts[:, None] + np.arange(4), len(tokens.data) - 1)], 0).astype(np.uint32)
    tail = np.where(inside, tokens.data[np.maximum(tokens.ends[:, None] - 1 - np.arange(4), 0)], 0).astype(np.uint32)
    for k in range(1, 5):
        prefix = sum(head[:, i] << np.uint32(8 * i) for i in range(k))
        ids[first[:-1] + k - 1] = number(prefix, 10 + k, length >= k)
        suffix = sum(tail[:, i] << np.uint32(8 * i) for i in range(k))
        ids[first[:-1] + k + 3] = number(suffix, 20 + k, length >= k)
    return Features(ids, first)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray      # (FEATURES, langs); row 0 stays zero
    lexicon: np.ndarray      # sorted word hashes
    entries: np.ndarray      # (lexicon + 1, langs); the last row is the outsiders'
    moves: np.ndarray        # (langs, langs) log weights of a step

    def emissions(self, tokens: Tokens) -> np.ndarray:
        """(different words, langs) scores."""
        return self.scores(feature_ids(tokens), entry_ids(tokens.hashes, self.lexicon))

    def scores(self, features: Features, entry: np.ndarray) -> np.ndarray:
        out = self.entries[entry]
        if len(entry):
            for j in range(len(self.langs)):
                weight = np.ascontiguousarray(self.weights[:, j])[features.ids]
                out[:, j] += np.add.reduceat(weight, features.first[:-1], dtype=np.float64)
        return out


def entry_ids(hashes: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    if not len(lexicon):
        return np.zeros(len(hashes), dtype=np.int64)
    at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
    return np.where(lexicon[at] == hashes, at, len(lexicon))


def marginals(score: np.ndarray, first: np.ndarray, moves: np.ndarray, expected: bool = False):
    """Forward-backward over many chains at once: chain r has the rows
    first[r]:first[r + 1] of ``score``.  Chains run side by side, longest
    first, so step t only touches chains that have a word t.  Returns word
    marginals (and, for training, the expected number of each move and the
    log partition sum)."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    begin, count = first[:-1][order], length[order]
    peak = score.max(axis=1, keepdims=True) if len(score) else score
    e = np.exp(score - peak)
    step = np.exp(moves - moves.max())
    alpha = np.empty_like(e)
    scale = np.empty(len(e), dtype=e.dtype)
    longest = int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(longest), side="left")  # chains with a word t
    for t in range(longest):
        at = begin[:active[t]] + t
        a = e[at] if t == 0 else (alpha[at - 1] @ step) * e[at]
        s = a.sum(axis=1)
        scale[at] = s
        alpha[at] = a / s[:, None]
    beta = np.ones_like(e)
    taken = np.zeros_like(moves)
    for t in range(longest - 1, 0, -1):
        at = begin[:active[t]] + t
        back = (e[at] * beta[at]) / scale[at][:, None]
        beta[at - 1] = back @ step.T
        if expected:
            taken += step * (alpha[at - 1].T @ back)
    p = alpha * beta
    p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-30)
    if not expected:
        return p
    return p, taken, float(np.log(scale).sum() + peak.sum() + moves.max() * (len(e) - len(count)))


def train(passages: list[tuple[str, str]], steps: int = STEPS, rate: float = 0.25) -> Model:
    """Fit on (text, language) passages.  Chains are made of up to three of
    them; half of the chains change language at the seams."""
    langs = sorted({g for _, g in passages})
    tokens = Tokens([t for t, _ in passages])
    spans = np.diff(tokens.first)
    label = np.repeat([langs.index(g) for _, g in passages], spans)
    rng = np.random.default_rng(7)
    by_lang = {g: [i for i, (_, h) in enumerate(passages) if h == g] for g in langs}
    # every passage is used once, in a chain of its own kind or in a mixed one
    mixed = [i for g in langs for i in by_lang[g][::2]]
    rng.shuffle(mixed)
    chains = [mixed[i:i + 3] for i in range(0, len(mixed), 3)]
    for g in langs:
        pure = by_lang[g][1::2]
        chains += [pure[i:i + 3] for i in range(0, len(pure), 3)]
    rows = [np.concatenate([np.arange(tokens.first[i], tokens.first[i + 1]) for i in c]) for c in chains]
    rows = [r for r in rows if len(r)]
    at = np.concatenate(rows)
    first = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    word, label = tokens.word[at], label[at]
    n, k = len(at), len(langs)

    counts = np.bincount(tokens.word, minlength=len(tokens.hashes))
    lexicon = tokens.hashes[counts >= LEXICON_COUNT]
    features, entry = feature_ids(tokens), entry_ids(tokens.hashes, lexicon)
    model = Model(langs, np.zeros((FEATURES, k), np.float32), lexicon, np.zeros((len(lexicon) + 1, k), np.float32), np.zeros((k, k)))
    truth = np.zeros((n, k))
    truth[np.arange(n), label] = 1
    seen_moves = np.zeros((k, k))
    inner = np.ones(n, dtype=bool)
    inner[first[:-1]] = False
    np.add.at(seen_moves, (label[:-1][inner[1:]], label[1:][inner[1:]]), 1)
    balance = 1 / np.maximum(np.bincount(label, minlength=k), 1)
    weight = (balance / balance.max())[label]  # a large language does not crowd out a small one
    squares = [np.full_like(p, 1e-8, dtype=np.float64) for p in (model.weights, model.entries, model.moves)]
    for _ in range(steps):
        score = model.scores(features, entry)[word].astype(np.float64)
        p, taken, _total = marginals(score, first, model.moves, expected=True)
        wrong = (truth - p) * weight[:, None]
        per_word = np.stack([np.bincount(word, wrong[:, j], len(tokens.hashes)) for j in range(k)], axis=1)
        slope_w = np.zeros((FEATURES, k))
        for j in range(k):
            slope_w[:, j] = np.bincount(features.ids, np.repeat(per_word[:, j], np.diff(features.first)), FEATURES)
        slope_w[0] = 0
        slope_e = np.stack([np.bincount(entry, per_word[:, j], len(lexicon) + 1) for j in range(k)], axis=1)
        slopes = (slope_w - 0.05 * model.weights, slope_e - 0.05 * model.entries, seen_moves - taken - 0.05 * model.moves)
        for param, slope, square in zip((model.weights, model.entries, model.moves), slopes, squares):
            square += slope * slope
            param += (rate * slope / np.sqrt(square)).astype(param.dtype)
    return model


def _place(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return _place(F.col(doc_id) if isinstance(doc_id, str) else doc_id) % 5 == 0


def sample_passages(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """Passages of about ``sample_docs`` documents a language (at most twice as
    many), chosen by id hash among the labelled documents not held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = known.groupBy("lang").count()
    odds = F.least(F.lit(1.0), F.lit(1.5 * sample_docs) / F.col("count"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 20)) / float(1 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out, langs, draws = [], [], []
            for t, g, d in zip(texts(part), part.column("lang").to_pylist(), part.column("draw").to_pylist()):
                # a "word" can be of any length: the sample takes it in pieces
                words = [w[i:i + PIECE] for w in t.split() for i in range(0, len(w), PIECE)]
                runs = max(1, min(SAMPLE_RUNS, len(words) // RUN_WORDS))
                for r in range(runs):
                    a = (len(words) - RUN_WORDS) * (2 * r + 1) // (2 * runs) if len(words) > RUN_WORDS else 0
                    out.append(" ".join(words[a:a + RUN_WORDS]))
                    langs.append(g)
                    draws.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(langs, pa.string()), pa.array(draws, pa.float64())],
                                             names=["passage", "lang", "draw"])

    picked = known.join(F.broadcast(sizes), "lang").withColumn("draw", draw).where(F.col("draw") < odds).select("text", "lang", "draw")
    rows = picked.mapInArrow(run, "passage string, lang string, draw double")
    n = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "passage"))
    rows = rows.withColumn("n", n).where(F.col("n") <= 2 * sample_docs * SAMPLE_RUNS).orderBy("lang", "n")
    return [(r.passage, r.lang) for r in rows.collect()]


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    passages = sample_passages(docs, sample_docs)
    return train(passages) if passages else None


def word_marginals(model: Model, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all words of ``rows`` and the first word of each row."""
    tokens = Tokens(rows)
    score = model.emissions(tokens)[tokens.word]
    return marginals(score, tokens.first, model.moves.astype(np.float32)), tokens.first


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Model | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` plus lang_pred, score (columns of these names are replaced)."""
    docs = docs.drop(*names)
    columns = docs.columns
    inner = [f"c{i}" for i in range(len(columns))]
    text = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, inner[text]):
            rows = texts(part, inner[text])
            pred, score = [UND] * len(rows), [0.0] * len(rows)
            if model is not None:
                p, first = word_marginals(model, rows)
                sums = np.concatenate((np.zeros((1, p.shape[1])), np.cumsum(p, axis=0, dtype=np.float64)))
                share = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1)[:, None]
                for r, t in enumerate(rows):
                    if first[r + 1] > first[r] and has_letter(t):
                        best = int(share[r].argmax())
                        pred[r], score[r] = model.langs[best], min(1.0, float(share[r, best]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             names=[*inner, "lang_pred", "score"])

    schema = docs.toDF(*inner).schema.add("lang_pred", "string").add("score", "double")
    out = docs.toDF(*inner).mapInArrow(run, schema)
    return out.select(*(F.col(i).alias(c) for i, c in zip(inner, columns)),
                      F.col("lang_pred").alias(names[0]), F.col("score").alias(names[1]))


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told: those with a word that has a
    letter.  Code-switched documents stay, however even their languages' shares
    are.  Without a labelled document nothing can be learned and every document
    stays."""
    model = fit(docs)
    if model is None:
        return docs
    told = predict(docs, model, ("__lang_pred", "__score"))
    return told.where(F.col("__lang_pred") != UND).select(*docs.columns)


@register("op4_language_crf")
def op4_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return predict(docs.select("doc_id", "text"), fit(docs)).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")
