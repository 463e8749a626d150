"""Quality: a weak-label model over overlapping heuristics, and a hashed linear scorer trained on it.

Each heuristic labeller votes good, bad or nothing on every document. Votes are counted per pattern
over the whole corpus, and expectation-maximisation on the pattern counts (a table bounded by the
number of patterns, whatever the corpus) estimates the share of good documents and each labeller's
rates of voting good, bad and nothing on good and on bad documents. Its posterior is the weak label.
A logistic scorer over hashed features (byte 4-grams and the labellers' measures in steps) is then
fitted to the posteriors of a bounded sample and scores every document, so the result also tells
documents apart on which few labellers speak. No hand label is used.

``sample`` bounds the fit: that many documents whose posterior says bad and as many that say good,
those with the smallest hashed ids; corpus counts, posteriors and scores cover all documents.

Defined results: null texts count as empty; a text without words gets the votes that
measures of 0 give; repeated rows are each scored; a corpus whose documents all get one weak label is scored by
the posterior alone; an empty table gives an empty result."""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

BAD, NONE, GOOD = 0, 1, 2
SLOT_BITS = 14
SAMPLE = 3000
ROUNDS, PRIOR_GOOD, PRIOR_WEIGHT = 200, 0.85, 0.02
EXPECTED = ((0.2, 0.1, 0.7), (0.01, 0.1, 0.89))      # votes bad, nothing, good on bad and on good documents
KEEP = 0.35

_MARKS = re.compile(r"[^\w\s]")
_LETTERS = re.compile(r"[^\W\d_]")
# (measure, bad below, good from, good to, bad above): between the limits a labeller is silent
LABELLERS = (
    ("words", -1, 40, np.inf, np.inf),
    ("mean_word", 2.0, 3.0, 12.0, 20.0),
    ("marks_per_word", -1, 0.0, 0.3, 0.45),
    ("capitals", -1, 0.0, 0.2, 0.5),
    ("distinct_words", 0.08, 0.3, 1.0, 2.0),
    ("repeated_neighbours", -1, 0.0, 0.05, 0.2),
    ("top_word", -1, 0.0, 0.15, 0.3),
    ("repeated_lines", -1, 0.0, 0.2, 0.5),
    ("plain_words", 0.65, 0.8, 1.0, 2.0),
    ("words_per_stop", 1.2, 3.0, 40.0, 200.0),
)
NAMES = tuple(n for n, *_ in LABELLERS)


def measures(text: str) -> list[float]:
    """What the labellers look at, in their order."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(LABELLERS)
    marks = len(_MARKS.findall(text))
    letters = len(_LETTERS.findall(text)) or 1
    capitals = sum(map(str.isupper, text))
    counts = Counter(words)
    repeated = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    plain = sum(map(str.isalpha, (w[:-1] if len(w) > 1 else w for w in words)))
    stops = sum(text.count(c) for c in ".!?") or 0.5
    few = n < 10          # too few for shares to mean anything
    return [n, sum(map(len, words)) / n, 0.1 if few else marks / n, 0.0 if few else capitals / letters,
            len(counts) / n if n >= 50 else 1.0, repeated / n, max(counts.values()) / n if n >= 20 else 0.0,
            1 - len(set(lines)) / len(lines) if len(lines) > 3 else 0.0, 1.0 if few else plain / n,
            10.0 if few else n / stops]


def votes(values: list[float]) -> list[int]:
    out = []
    for v, (_, low, good_from, good_to, high) in zip(values, LABELLERS):
        out.append(BAD if v < low or v > high else GOOD if good_from <= v <= good_to else NONE)
    return out


def pattern_of(v: list[int]) -> int:
    out = 0
    for x in v:
        out = out * 3 + x
    return out


def features(text: str, values: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashed slots and weights: byte 4-grams by square-root frequency, measures in steps."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    slots = 1 << SLOT_BITS
    if len(raw) >= 4:
        h = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
        grams = (h * np.uint32(2654435761)) >> np.uint32(32 - SLOT_BITS)
        count = np.bincount(grams, minlength=slots).astype(np.float32)
    else:
        count = np.zeros(slots, np.float32)
    x = np.sqrt(count)
    norm = float(np.sqrt((x * x).sum()))
    x = x / norm if norm else x
    for k, v in enumerate(values):
        step = int(np.clip(np.log2(max(v, 2.0 ** -8)) * 2, -16, 24)) + 16
        x[(k * 64 + step) * 2654435761 % (1 << 32) >> (32 - SLOT_BITS)] += 1.0
    at = np.flatnonzero(x)
    return at, x[at]


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pattern): every document's votes, in one narrow pass over whole texts."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [pattern_of(votes(measures(t))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.int32())], names=["id", "pattern"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, pattern int")


def estimate(patterns: np.ndarray, counts: np.ndarray, n_labellers: int, rounds: int = ROUNDS) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation: (share of good documents, rates[labeller, class, vote], posterior of
    good for each pattern). ``EXPECTED`` rates start it and weigh in as PRIOR_WEIGHT of the documents:
    a labeller is expected to speak up against few bad documents, those of its own kind, and against
    hardly any good one."""
    v = np.stack([patterns // 3 ** (n_labellers - 1 - k) % 3 for k in range(n_labellers)], axis=1)
    counts = counts.astype(np.float64)
    share = PRIOR_GOOD
    expected = np.array(EXPECTED)
    rates = np.repeat(expected[None], n_labellers, axis=0)
    extra = 1 + PRIOR_WEIGHT * counts.sum()
    post = np.full(len(patterns), share)
    for _ in range(rounds):
        log1, log0 = np.full(len(v), np.log(share)), np.full(len(v), np.log(1 - share))
        for k in range(n_labellers):
            log0 += np.log(rates[k, 0, v[:, k]])
            log1 += np.log(rates[k, 1, v[:, k]])
        new = 1 / (1 + np.exp(np.clip(log0 - log1, -700, 700)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
        share = float(np.clip((counts * post).sum() / max(counts.sum(), 1), 1e-4, 1 - 1e-4))
        for k in range(n_labellers):
            for y, weight in ((0, counts * (1 - post)), (1, counts * post)):
                seen = np.bincount(v[:, k], weight, minlength=3) + extra * expected[y]
                rates[k, y] = seen / seen.sum()
    return share, rates, post


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = 60, rate: float = 0.5,
               ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """A logistic scorer for soft targets by full-batch adaptive gradient steps."""
    at = np.concatenate([a for a, _ in rows])
    x = np.concatenate([w for _, w in rows])
    starts = np.cumsum([0, *(len(a) for a, _ in rows)])[:-1]
    owner = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    w, b = np.zeros(1 << SLOT_BITS), 0.0
    g2, gb2 = np.full(1 << SLOT_BITS, 1e-8), 1e-8
    for _ in range(epochs):
        z = np.add.reduceat(w[at] * x, starts) + b
        err = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target) / len(rows)
        g = np.bincount(at, err[owner] * x, minlength=len(w)) + ridge * w
        gb = err.sum()
        g2 += g * g
        gb2 += gb * gb
        w -= rate * g / np.sqrt(g2)
        b -= rate * gb / np.sqrt(gb2)
    return w, b


@dataclass
class Scorer:
    weights: np.ndarray | None
    bias: float
    posterior: dict[int, float]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Scorer:
    """Weak labels from all documents, the scorer from a bounded sample of them."""
    marked = cut(measured(docs, id_col, text_col))
    table_ = marked.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    patterns = np.array([r[0] for r in table_], np.int64)
    _, _, post = estimate(patterns, np.array([r[1] for r in table_]), len(LABELLERS))
    posterior = dict(zip(patterns.tolist(), post.tolist()))
    good = [p for p, q in posterior.items() if q >= 0.5]
    bad = [p for p, q in posterior.items() if q < 0.5]
    if not good or not bad:
        return Scorer(None, 0.0, posterior)
    ids = marked.where(F.col("id").isNotNull()).withColumn("h", F.xxhash64("id"))
    some = lambda side: ids.where(F.col("pattern").isin(side)).orderBy("h", "id").limit(sample)
    chosen = some(good).unionByName(some(bad)).select(F.col("id").alias("sample_id")).distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("sample_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t in b.column("text").to_pylist():
                m = measures(t)
                at, x = features(t, m)
                found.append((pattern_of(votes(m)), at.astype("<i2").tobytes(), x.astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary()),
                 pa.array([f[2] for f in found], pa.binary())], names=["pattern", "at", "x"])

    rows = texts.select("text").mapInArrow(run, "pattern int, at binary, x binary").limit(4 * sample).collect()
    target = np.array([posterior[r[0]] for r in rows])
    weights, bias = fit_linear([(np.frombuffer(r[1], "<i2").astype(np.int64), np.frombuffer(r[2], "<f4").astype(np.float64))
                                for r in rows], target)
    return Scorer(weights, bias, posterior)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, weak_label, score): the weak label's posterior and the linear score, both 0 to 1."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weak, out = [], []
            for t in b.column("text").to_pylist():
                m = measures(t)
                weak.append(scorer.posterior.get(pattern_of(votes(m)), PRIOR_GOOD))
                if scorer.weights is None:
                    out.append(weak[-1])
                else:
                    at, x = features(t, m)
                    out.append(float(1 / (1 + np.exp(-np.clip(scorer.weights[at] @ x + scorer.bias, -500, 500)))))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(weak, pa.float64()), pa.array(out, pa.float64())],
                                             names=["id", "weak_label", "score"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, weak_label double, score double")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, weak_label, score, keep of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs))
    return scored.withColumnRenamed("id", "doc_id").withColumn("keep", F.col("score") >= KEEP)
