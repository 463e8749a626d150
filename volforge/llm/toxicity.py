"""Toxicity: a subsequence string-kernel support vector machine on Nystrom landmarks.

A unit is a white-space token (lower case, marks stripped at its ends; long tokens in overlapping
windows; runs of spelled-out single letters joined). The kernel of two units sums over their common
subsequences of three characters, each weighted by DECAY for every character it skips (at most
GAP a step), normalised to one, so an insult with characters inserted, or built into a longer word,
stays close to the plain one. Landmarks are strings that tell toxic from clean training documents,
and clean units, among them those that come closest; the Nystrom map sends a unit to its kernel values at the
landmarks, whitened, and a squared-hinge support vector machine is fitted there. Its decision
function is one vector over subsequences, so scoring a unit is a table look-up, and workers remember
the units they have seen. A text is scored by its worst unit and by the most units on the toxic side
among any SPAN units in a row (one word that resembles an insult by chance is not many), on a
logistic scale fitted to the training documents. Neither falls, nor does the score, when text is
added before or after: a long clean text does not hide an insult.

Training looks at a bounded sample: of the rows that may be learned from, up to ``sample`` toxic and
twice as many clean ones, those with the smallest hashed ids. Their sentences carry the document's
label; as most sentences of a toxic document are clean, instances are the units that hold a string
seen in toxic sample documents far more often than in clean ones. Near copies in the sample count
once. Everything that reaches the driver is bounded by the sample or by a top-k. All texts are
scored whole, in one narrow pass.

Defined results: null and empty texts have the score of a text without any unit, the lowest one;
null labels teach nothing; of several labels of one id the toxic one counts; repeated rows are each
scored; without both classes to learn from, the score is the share of toxic training rows (0 if there
are none) for every text; an empty table gives an empty result."""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, table

DECAY, GAP, WIDTH = 0.5, 2, 24           # kernel; longest unit
SLOTS = 1 << 18                          # hashed subsequences
SAMPLE = 2000                            # toxic training documents; twice as many clean ones
GRAMS, GRAM_SIZES = 4000, (4, 5, 6)       # contrasting strings
LANDMARKS_TOXIC, LANDMARKS_CLEAN = 96, 64
HARD, PLAIN, TOXIC_UNITS = 3000, 1500, 600
MIN_RATIO, MIN_SEEN, MIN_GAIN = 4.0, 3, 25.0    # a telling string: how much more often, in how many documents, and documents x log of the ratio
PENALTY = 10.0                          # of a violated margin, for a unit seen once
CACHE = 250_000                          # remembered units of a worker
BATCH_CHARS = 1 << 21
THRESHOLD = 0.3
SPAN, FLOOR = 48, 0.1                    # units in a row among which toxic ones are counted; added to the count

_MARKS = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_SPELLED = re.compile(r"(?<!\S)(?:\S\s+){3,}\S(?!\S)")


def unit_sequence(text: str) -> list[str]:
    """The units of a text in their order, before their marks are stripped."""
    low, found, at = text.lower(), [], 0
    for run in _SPELLED.finditer(low):
        found += low[at:run.start()].split()
        found.append("".join(run.group().split()))
        at = run.end()
    return found + low[at:].split()


def raw_units(text: str) -> set[str]:
    """The distinct units of a text before their marks are stripped."""
    return set(unit_sequence(text))


def _windows(unit: str) -> list[str]:
    """What of a unit is compared: ``^unit$``, also without the marks inside it, in windows if long."""
    unit = _MARKS.sub("", unit)
    if not unit:
        return []
    forms = [f"^{unit}$"] if unit.isalnum() else [f"^{unit}$", f"^{_INNER.sub('', unit)}$"]
    step = WIDTH // 2
    return [f if len(f) <= WIDTH else f[s:s + WIDTH] for f in forms
            for s in range(0, max(1, len(f) - step), step if len(f) > WIDTH else len(f))]


def _disguised(unit: str) -> list[str]:
    """A unit (``^unit$``) with a character doubled, and with one inserted."""
    k = len(unit) // 2
    return [unit[:k] + unit[k] + unit[k:], unit[:k] + "x" + unit[k:], unit[:k + 1] + "e" + unit[k + 1:]]


def _codes(strings: list[str], width: int) -> np.ndarray:
    """Code points in rows, padded with zeros."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.zeros((len(strings), width), np.uint32)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def subsequences(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed three-character subsequences of each string (slot 0: none) and the weight of each column."""
    width = max(3, max(map(len, strings), default=3))
    c = _codes(strings, width)
    slots, weights = [], []
    for g1 in range(GAP + 1):
        for g2 in range(GAP + 1):
            n = width - 2 - g1 - g2
            if n > 0:
                a, b, d = c[:, :n], c[:, 1 + g1:1 + g1 + n], c[:, 2 + g1 + g2:]
                h = (a * np.uint32(73856093)) ^ (b * np.uint32(19349663)) ^ (d * np.uint32(83492791))
                h = (h ^ (h >> np.uint32(15))) % np.uint32(SLOTS - 1) + np.uint32(1)
                slots.append(np.where(d > 0, h, 0).astype(np.int32))
                weights.append(np.full(n, DECAY ** (g1 + g2), np.float32))
    return np.concatenate(slots, axis=1), np.concatenate(weights)


def norms(slots: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The kernel norm of each row: equal subsequences add up before they are squared."""
    order = np.argsort(slots, axis=1, kind="stable")
    s = np.take_along_axis(slots, order, axis=1)
    w = np.where(s > 0, weights[order], 0).astype(np.float64)
    first = np.ones(s.shape, bool)
    first[:, 1:] = s[:, 1:] != s[:, :-1]
    starts = np.flatnonzero(first.ravel())
    sums = np.add.reduceat(w.ravel(), starts) if len(starts) else np.zeros(0)
    return np.sqrt(np.bincount(starts // s.shape[1], sums * sums, minlength=len(s)))


@dataclass
class Model:
    """Weights over subsequence slots and bias; logistic weights of a text's features and their shift;
    ``constant`` if nothing could be learned."""
    vector: np.ndarray | None
    bias: float = 0.0
    slopes: tuple[float, ...] = (1.0, 0.0)
    shift: float = 0.0
    constant: float | None = None

    def margins(self, units: list[str]) -> np.ndarray:
        """The decision value of each raw unit: bias plus its similarity to what is toxic, not below 0."""
        parts, owner = [], []
        for i, u in enumerate(units):
            for p in _windows(u):
                if len(p) > 4:            # of three characters at least
                    parts.append(p)
                    owner.append(i)
        out = np.zeros(len(units))
        if parts:
            owner, sizes = np.array(owner), np.fromiter(map(len, parts), np.int64, len(parts))
            for low, high in ((5, 8), (9, 11), (12, 15), (16, WIDTH)):     # little padding
                at = np.flatnonzero((sizes >= low) & (sizes <= high))
                if len(at):
                    slots, weights = subsequences([parts[i] for i in at])
                    dot = self.vector[slots] @ weights
                    up = np.flatnonzero(dot > 0)
                    if len(up):
                        np.maximum.at(out, owner[at[up]], dot[up] / norms(slots[up], weights))
        return out + self.bias

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.slopes) + self.shift, -500, 500)))


class Scorer:
    """Scores texts with a model, remembering units."""

    def __init__(self, model: Model):
        self.model, self.seen = model, {}

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Of each text: the largest margin of its units (the bias where there are none), and the
        logarithm of the (smoothed) most units with a positive one among SPAN in a row."""
        out = np.tile([self.model.bias, math.log(FLOOR)], (len(texts), 1))
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end] or "") <= BATCH_CHARS):
                size += len(texts[end] or "")
                end += 1
            units = [unit_sequence(t) if t else [] for t in texts[start:end]]
            if len(self.seen) > CACHE:
                self.seen.clear()
            new = list(set().union(*units).difference(self.seen))
            for s in range(0, len(new), 1 << 15):
                chunk = new[s:s + (1 << 15)]
                self.seen.update(zip(chunk, self.model.margins(chunk).tolist()))
            get = self.seen.__getitem__
            for i, u in enumerate(units):
                if u:
                    m = np.fromiter(map(get, u), np.float64, len(u))
                    at = np.flatnonzero(m > 0)
                    near = np.searchsorted(at, at + SPAN) - np.arange(len(at))
                    out[start + i] = m.max(), math.log(FLOOR + near.max(initial=0))
            start = end
        return out


def kernel(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values, a row for each string."""
    ls, lw = subsequences(landmarks)
    used, compact = np.unique(ls, return_inverse=True)
    compact = compact.reshape(ls.shape)
    place = np.zeros(SLOTS, np.int32)
    place[used] = np.arange(1, len(used) + 1)
    side = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    np.add.at(side, (compact + 1, np.arange(len(landmarks))[:, None]), np.where(ls > 0, lw, 0))
    side /= np.maximum(norms(ls, lw), 1e-12)[None, :]
    out = np.zeros((len(strings), len(landmarks)), np.float32)
    for s in range(0, len(strings), 2048):
        slots, weights = subsequences(strings[s:s + 2048])
        block = out[s:s + 2048]
        for k in range(slots.shape[1]):
            at = place[slots[:, k]]
            at[slots[:, k] == 0] = 0
            block += weights[k] * side[at]
        block /= np.maximum(norms(slots, weights), 1e-12)[:, None]
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias of a support vector machine (y in -1, 1): damped Newton steps on the violators."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3

    def loss(w):
        gap = np.maximum(0, 1 - y * (z @ w))
        return 0.5 * w @ ridge @ w + 0.5 * (weight * gap * gap).sum()

    w = np.zeros(z.shape[1])
    now = loss(w)
    for _ in range(rounds):
        out = y * (z @ w) < 1
        zw = z[out] * weight[out, None]
        step = np.linalg.solve(ridge + zw.T @ z[out], zw.T @ y[out]) - w
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > now:
            size /= 2
        new = loss(w + size * step)
        if new >= now * (1 - 1e-9):
            break
        w, now = w + size * step, new
    return w[:-1], float(w[-1])


def _logistic_scale(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Weights and shift of a logistic fit, with smoothed targets so that separable classes stay finite."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])

    def loss(w):
        o = np.clip(z @ w, -500, 500)
        return (np.logaddexp(0, o) - t * o).sum() + 0.005 * w @ w

    now = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(len(w)), z.T @ (t - p) - 0.01 * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        new = loss(w + size * step)
        if new >= now - 1e-9:
            break
        w, now = w + size * step, new
    return tuple(map(float, w[:-1])), float(w[-1])


def rising_scale(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], float]:
    """The logistic scale without the features whose weight would be negative: no score falls as one rises."""
    used = np.ones(x.shape[1], bool)
    while True:
        slopes, shift = _logistic_scale(x * used, y)
        if min(slopes) >= 0:
            return slopes, shift
        used &= np.array(slopes) >= 0


def held_out(id_col) -> Column:
    """Whether a row must not be learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sketch(text: str) -> int:
    """The least hash of three words in a row: near copies mostly share it."""
    from xxhash import xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").split()
    return min(map(xxh64_intdigest, map(b" ".join, zip(words, words[1:], words[2:]))), default=len(words)) >> 1


def _cuts(part: str) -> Iterator[str]:
    return (part[i:i + k] for k in GRAM_SIZES for i in range(len(part) - k + 1))


def _grams(units: Iterable[str]) -> set[str]:
    return {g for u in units for p in _windows(u) for g in _cuts(p)}


def _counted(sample: DataFrame, parts) -> DataFrame:
    """(part, t, c): in how many toxic and clean sample documents each part occurs. Tasks add up their
    own documents first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic, clean = Counter(), Counter()
            for y, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist()):
                (toxic if y else clean).update(parts(raw_units(text)))
            names = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()),
                 pa.array([clean[n] for n in names], pa.int64())], names=["part", "t", "c"])

    return sample.select("toxic", "text").mapInArrow(run, "part string, t long, c long").groupBy("part").agg(
        F.sum("t").alias("t"), F.sum("c").alias("c"))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(toxic, text): the bounded training sample, one row for each sketch."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    known = known.withColumn("h", F.xxhash64("label_id"))
    ids = known.where("toxic = 1").orderBy("h", "label_id").limit(sample).unionByName(
        known.where("toxic = 0").orderBy("h", "label_id").limit(2 * sample)).select("label_id", "toxic")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("label_id"), text.alias("text")).join(F.broadcast(ids), "label_id").select("toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sketches = pa.array([_sketch(t) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([sketches, b.column("toxic"), b.column("text")], names=["sketch", "toxic", "text"])

    named = rows.mapInArrow(run, "sketch long, toxic int, text string")
    return cut(named.groupBy("sketch", "toxic").agg(F.min("text").alias("text")).select("toxic", "text"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample: int = SAMPLE) -> Model:
    """Fit on the bounded training sample."""
    rows = training_sample(docs, labels, id_col, text_col, label_col, sample)
    n1, n = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    n0 = n - n1
    if not n1 or not n0:
        return Model(None, constant=n1 / n if n else 0.0)
    ratio = ((F.col("t") + 0.5) / (n1 + 1.0)) / ((F.col("c") + 0.5) / (n0 + 1.0))
    telling = _counted(rows, _grams).withColumn("ratio", ratio).withColumn("gain", F.col("t") * F.log("ratio"))
    telling = telling.where((F.col("t") >= MIN_SEEN) & (F.col("ratio") >= MIN_RATIO) & (F.col("gain") >= MIN_GAIN))
    grams = {r[0] for r in telling.orderBy(F.desc("gain"), "part").limit(GRAMS).collect()}
    if not grams:
        return Model(None, constant=n1 / n)
    units = cut(_counted(rows, lambda found: {p for u in found for p in _windows(u) if len(p) > 4}))

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not grams.isdisjoint(_cuts(p)) for p in b.column("part").to_pylist()], pa.bool_()))

    suspects = units.where(F.col("t") > 3 * F.col("c")).mapInArrow(holding, "part string, t long, c long")
    bad = [(r[0], r[1]) for r in suspects.orderBy(F.desc("t"), "part").limit(TOXIC_UNITS).select("part", "t").collect()]
    toxic_marks = [b for b, _ in bad[:LANDMARKS_TOXIC]]
    if not toxic_marks:
        return Model(None, constant=n1 / n)

    def closeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = b.column("part").to_pylist()
            near = kernel(parts, toxic_marks).max(axis=1) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("c"), pa.array(near.astype(np.float64))], names=["part", "c", "near"])

    clean = units.where((F.col("c") > 0) & (F.col("t") <= 3 * F.col("c")))
    near = clean.select("part", "c").mapInArrow(closeness, "part string, c long, near double")
    hard = near.orderBy(F.desc(F.col("near") * F.log1p("c")), "part").limit(HARD).select("part", "c").collect()
    plain = clean.orderBy(F.xxhash64("part"), "part").limit(PLAIN).select("part", "c").collect()
    good = dict(map(tuple, [*hard, *plain]))
    if not good:
        return Model(None, constant=n1 / n)
    marks = toxic_marks + [g for g, _ in (*hard[:LANDMARKS_CLEAN // 2], *plain[:LANDMARKS_CLEAN // 2])]
    marks = list(dict.fromkeys(marks))
    value, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    kept = value > 1e-4 * value.max()
    whiten = vectors[:, kept] / np.sqrt(value[kept])
    hidden = [(v, t / 9) for b, t in bad for v in _disguised(b) if v not in good]
    toxic = bad + hidden
    x = kernel([b for b, _ in toxic] + list(good), marks).astype(np.float64) @ whiten
    y = np.concatenate([np.ones(len(toxic)), -np.ones(len(good))])
    weight = PENALTY * np.sqrt(np.array([t for _, t in toxic] + list(good.values()), np.float64))
    w, bias = squared_hinge(x, y, weight)
    beta = whiten @ w
    slots, lw = subsequences(marks)
    vector = np.zeros(SLOTS, np.float32)
    np.add.at(vector, slots, lw[None, :] * (beta / np.maximum(norms(slots, lw), 1e-12))[:, None])
    vector[0] = 0
    model = Model(vector, bias)
    known = np.array(sample_features(rows, model).collect(), np.float64).reshape(-1, 3)
    model.slopes, model.shift = rising_scale(known[:, 1:], known[:, 0])
    return model


def sample_features(sample: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            x = scorer.features(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *(pa.array(x[:, k]) for k in range(2))],
                                             names=["toxic", "worst", "near"])

    return sample.select("toxic", "text").mapInArrow(run, "toxic int, worst double, near double")


def score(text: Column, model: Model) -> Column:
    """The toxicity of a text column, 0 to 1."""
    if model.constant is not None:
        return F.lit(float(model.constant))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.Series(model.probability(scorer.features(texts.tolist())), dtype="float64")
        pa.default_memory_pool().release_unused()

    return F.pandas_udf(run, "double")(F.coalesce(text.cast("string"), F.lit("")))


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose score stays below ``threshold``."""
    model = fit(docs, labels, id_col, text_col, sample=sample)
    at = fresh(docs, "toxicity")
    return docs.withColumn(at, score(F.col(text_col), model)).where(F.col(at) < threshold).select(*docs.columns)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
