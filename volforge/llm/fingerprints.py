"""Document fingerprints: a digest of a text's improbable byte windows in chained Bloom filters.

Every window of WINDOW bytes has an entropy; how rare a class of entropies is, is counted over the
windows of all documents (``window_rarity``: one counter for each of CLASSES classes). Of every
NEIGHBOURS windows in a row the rarest (the first of equals) gains a point, and windows with POPULAR
points are the text's features; a text under SHORT bytes also has all its windows of SHORT_WINDOW bytes,
so that short texts can be told apart by degrees. Features, each counted once, are hashed into Bloom filters in the order of
the text; a filter that has FILTER_FEATURES features is closed and the next one of the chain begun.

Two fingerprints are compared filter by filter: common bits beyond what chance gives (with a margin of
three standard deviations), as a share of the most there can be. Each filter of the fingerprint with
fewer features counts with its best partner, weighted by its features. Equal fingerprints have likeness 1.

Texts are worked off whole, many short ones or a stretch of a long one at a time; a class's counts are all
that leaves the first pass. For ``against_next`` documents are dealt to ranges of ids, each in order and
with the first document of the following range at its end, so that every one meets its successor in one
shuffle of the texts.

Defined results: a null text is an empty one; an empty text has no filter (fingerprint ``""``), likeness 1
to another empty one and 0 to others; a text without any feature has one, itself; ids may be null (first in order) or repeated (then in order of the text; equal rows give
equal results); the only document is its own successor; very long texts make long chains; an empty table
gives an empty result; other columns and their names do not matter."""
from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

WINDOW, CLASSES, NEIGHBOURS, POPULAR = 32, 256, 32, 8        # NEIGHBOURS at most WINDOW
SHORT, SHORT_WINDOW = 128, 8
FILTER_BYTES, PROBES, FILTER_FEATURES = 256, 5, 128
STRETCH, GROUP_BYTES = 1 << 16, 1 << 20
RANGE_ROWS, RANGES_PER_TASK = 512, 16
_PLACE_BITS = 18                    # of a window in a stretch
_FAR = np.iinfo(np.int32).max


# ---------------------------------------------------------------- features

def _entropy_steps() -> tuple[np.ndarray, np.ndarray]:
    """Fixed-point c log2 c, and the class of each of its possible sums over a window."""
    c = np.arange(WINDOW + 1)
    parts = np.round(c * np.log2(np.maximum(c, 1)) * 256).astype(np.int32)
    most = WINDOW * math.log2(WINDOW) * 256
    classes = ((1 - np.arange(int(most) + WINDOW + 2) / most).clip(0, 1) * (CLASSES - 1)).astype(np.int16)
    return parts, classes


_PARTS, _CLASS_OF_SUM = _entropy_steps()
_GAIN = np.diff(_PARTS)             # of one more equal byte in a window


def entropy_classes(x: np.ndarray) -> np.ndarray:
    """The entropy class of each window of ``x`` (bytes); equal windows have equal classes."""
    n = len(x) - WINDOW + 1
    before = np.zeros(len(x), np.uint8)              # equal bytes among the WINDOW - 1 before, and after
    after = np.zeros(len(x), np.uint8)
    for d in range(1, WINDOW):
        same = (x[d:] == x[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    sums = np.empty(n, np.int32)
    sums[0] = _PARTS[np.bincount(x[:WINDOW], minlength=1)].sum()
    if n > 1:
        np.cumsum(_GAIN[before[WINDOW:]] - _GAIN[after[:n - 1]], out=sums[1:])
        sums[1:] += sums[0]
    return _CLASS_OF_SUM[sums]


def _stretches(x: np.ndarray, margin: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(first window, end, offset, classes): classes from ``offset`` on, with ``margin`` windows around."""
    windows = len(x) - WINDOW + 1
    for s in range(0, windows, STRETCH):
        e = min(windows, s + STRETCH)
        lo, hi = max(0, s - margin), min(windows, e + margin)
        yield s, e, lo, entropy_classes(x[lo:hi + WINDOW - 1])


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts in a row, where each begins, and how many windows lie in each."""
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, np.maximum(sizes - WINDOW + 1, 0)


def _inside(starts: np.ndarray, windows: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Whether each window from ``lo`` to ``hi`` lies within one text."""
    edge = np.zeros(hi - lo + 1, np.int32)
    some = windows > 0
    a, b = starts[some].clip(lo, hi) - lo, (starts + windows)[some].clip(lo, hi) - lo
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    return np.cumsum(edge[:-1]) > 0


def count_classes(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each entropy class."""
    x, starts, windows = _joined(texts)
    out = np.zeros(CLASSES, np.int64)
    for s, e, _, classes in _stretches(x, 0):
        out += np.bincount(classes[_inside(starts, windows, s, e)], minlength=CLASSES)
    return out


def popular_windows(x: np.ndarray, starts: np.ndarray, windows: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Positions of the windows that gain enough points (a quarter of a short text's windows suffices)."""
    out = []
    need = np.minimum(POPULAR, np.maximum(1, windows // 4))
    for s, e, lo, classes in _stretches(x, NEIGHBOURS - 1):
        inside = _inside(starts, windows, lo, lo + len(classes))
        low = np.where(inside, (rank[classes] << _PLACE_BITS) | np.arange(len(classes)), _FAR).astype(np.int32)
        span = 1
        while span < NEIGHBOURS:                     # least key of ``span`` windows in a row, doubled
            step = min(span, NEIGHBOURS - span)
            wider = low.copy()
            np.minimum(low[:-step], low[step:], out=wider[:-step])
            low, span = wider, span + step
        won = low[:e - lo][inside[:e - lo]] & ((1 << _PLACE_BITS) - 1)       # one for each window, in order
        head = np.flatnonzero(np.concatenate(([True], won[1:] != won[:-1])))[:len(won)]
        at, points = won[head] + lo, np.diff(np.concatenate((head, [len(won)])))
        mine = (at >= s) & (at < e)
        at, points = at[mine], points[mine]
        out.append(at[points >= need[np.searchsorted(starts, at, side="right") - 1]])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _mixed(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of 64-bit words."""
    h = np.full(len(words), 0x243F6A8885A308D3, np.uint64)
    for c in range(words.shape[1]):
        h = (h ^ words[:, c]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Digest:
    """A chain of Bloom filters and the number of features in each."""

    def __init__(self, filters: np.ndarray, features: np.ndarray):
        self.filters, self.features = filters, features

    def __str__(self) -> str:
        rows = np.concatenate([self.features.astype(np.uint8)[:, None], self.filters], axis=1)
        return base64.b64encode(rows.tobytes()).decode()

    @staticmethod
    def parse(text: str) -> Digest:
        rows = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, FILTER_BYTES + 1)
        return Digest(rows[:, 1:], rows[:, 0].astype(np.int64))


def digests(texts: list[bytes], rank: np.ndarray) -> list[Digest]:
    """The digest of each text, given the rank of each entropy class (0: the rarest)."""
    x, starts, windows = _joined(texts)
    at = popular_windows(x, starts, windows, rank)
    owner = np.searchsorted(starts, at, side="right") - 1
    if len(at):
        rows = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[at]
        hashes = _mixed(np.ascontiguousarray(rows).view("<u8").astype(np.uint64))
    else:
        hashes = np.zeros(0, np.uint64)
    # short texts: all windows of a few bytes as well; and whatever has no feature so far is one itself
    short = [i for i, t in enumerate(texts) if SHORT_WINDOW <= len(t) < SHORT]
    if short:
        rows = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(texts[i], np.uint8), SHORT_WINDOW) for i in short]
        owner = np.concatenate((owner, np.repeat(short, [len(r) for r in rows])))
        hashes = np.concatenate((hashes, _mixed(np.concatenate(rows).view("<u8").astype(np.uint64))))
    bare = np.flatnonzero((np.bincount(owner, minlength=len(texts)) == 0) & (np.array([len(t) for t in texts]) > 0))
    whole = [int.from_bytes(hashlib.blake2b(texts[i], digest_size=8).digest(), "little") for i in bare]
    owner = np.concatenate((owner, bare))
    hashes = np.concatenate((hashes, np.array(whole, np.uint64)))
    # each feature of a text once, in the order of its first place
    order = np.lexsort((np.arange(len(owner)), hashes, owner))
    o, h = owner[order], hashes[order]
    once = np.sort(order[np.concatenate(([True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])))[:len(order)]])
    once = once[np.argsort(owner[once], kind="stable")]
    owner, hashes = owner[once], hashes[once]
    per = np.bincount(owner, minlength=len(texts))
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    chain = -(-per // FILTER_FEATURES)
    first = np.cumsum(chain) - chain
    place = first[owner] + number // FILTER_FEATURES
    bits = np.zeros((int(chain.sum()), FILTER_BYTES * 8), np.uint8)
    width = (FILTER_BYTES * 8).bit_length() - 1
    for i in range(PROBES):
        bits[place, ((hashes >> np.uint64(width * i)) & np.uint64(FILTER_BYTES * 8 - 1)).astype(np.int64)] = 1
    filters, features = np.packbits(bits, axis=1), np.bincount(place, minlength=len(bits))
    return [Digest(filters[f:f + c], features[f:f + c]) for f, c in zip(first, chain)]


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1; symmetric."""
    if len(a.filters) == len(b.filters) and np.array_equal(a.filters, b.filters):
        return 1.0
    if not len(a.filters) or not len(b.filters):
        return 0.0
    sizes = int(a.features.sum()), int(b.features.sum())
    if sizes[0] == sizes[1]:
        return (_held(a, b) + _held(b, a)) / 2
    return _held(a, b) if sizes[0] < sizes[1] else _held(b, a)


def _held(a: Digest, b: Digest) -> float:
    """How much of ``a`` the filters of ``b`` hold."""
    m = FILTER_BYTES * 8
    right, in_right = b.filters.view("<u8"), np.bitwise_count(b.filters).sum(axis=1, dtype=np.int64)
    total = 0.0
    for one, weight in zip(a.filters, a.features):
        left = one.view("<u8")
        n = int(np.bitwise_count(one).sum())
        common = np.bitwise_count(right & left).sum(axis=1, dtype=np.int64)
        chance = n * in_right / m
        spread = np.sqrt(n * in_right * float(m - n) * (m - in_right) / (float(m) * m * (m - 1)))
        least, most = chance + 3 * spread, np.minimum(n, in_right)
        room = np.maximum(most - least, 1e-9)
        score = np.where(most > least, (common - least) / room, np.where(common == most, 1.0, 0.0) * (n == in_right))
        total += float(weight) * float(score.clip(0, 1).max())
    return total / float(a.features.sum())


# ---------------------------------------------------------------- tables

def _groups(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[list[bytes]]:
    for b in batches:
        group, held = [], 0
        for t in b.column(text_col).cast(pa.binary()):
            group.append(t.as_py())
            held += len(group[-1])
            if held >= GROUP_BYTES:
                yield group
                group, held = [], 0
        if group:
            yield group


def window_rarity(documents: DataFrame, text_col: str = "text") -> np.ndarray:
    """The rank of each entropy class by its windows in all documents, the rarest first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES, np.int64)
        for group in _groups(batches, "text"):
            counts += count_classes(group)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen])], names=["class", "n"])

    texts = documents.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = np.zeros(CLASSES, np.int64)
    for r in texts.mapInArrow(run, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():     # CLASSES rows
        counts[r["class"]] = r.n
    rank = np.empty(CLASSES, np.int64)
    rank[np.lexsort((np.arange(CLASSES), counts))] = np.arange(CLASSES)
    return rank


def _in_order(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, ahead, id, text): ranges of ids, each in order in one partition and followed by the rows
    of the next range's first id (``ahead``); the last range is followed by the first."""
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = rows.count()
    ranges = max(1, min(-(-n // RANGE_ROWS), tasks * RANGES_PER_TASK))
    shares = [i / ranges for i in range(ranges)]
    found = rows.agg(F.percentile_approx("id", F.array(*map(F.lit, shares)), F.lit(max(10_000, 10 * ranges))).alias("at"), F.min("id").alias("low")).first()
    bounds = sorted({*(found.at or []), found.low} - {None}) or [0]
    known = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    upto = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.coalesce(F.get(known, at + s - 1) <= F.col("id"), F.lit(False)), at + s).otherwise(at))
    rows = rows.withColumn("own", F.greatest(upto - 1, F.lit(0)))
    leads = F.col("id").isNull() | (F.col("id") == F.get(known, F.col("own")))
    here = F.struct(F.col("own").alias("part"), F.lit(False).alias("ahead"))
    before = F.struct(F.pmod(F.col("own") - 1, F.lit(len(bounds))).alias("part"), F.lit(True).alias("ahead"))
    rows = rows.select("id", "text", F.explode(F.when(leads, F.array(here, before)).otherwise(F.array(here))).alias("to"))
    rows = rows.select("to.part", "to.ahead", "id", "text")
    return rows.repartition(tasks, "part").sortWithinPartitions("part", "ahead", F.asc_nulls_first("id"), "text")


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank: np.ndarray | None = None) -> DataFrame:
    """(id, fingerprint) of every document. ``rank``: that of the corpus the fingerprints are to be
    compared in, by default these documents."""
    rank = window_rarity(documents, text_col) if rank is None else rank
    src = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [str(d) for group in _groups(iter([b]), "text") for d in digests(group, rank)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(made, pa.string())], names=["id", "fingerprint"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as much of the beginning of ``following`` as there is."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def against_next(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of every document:
    compared with its successor in order of the id (the last one's is the first) and with its text
    half of which the successor's beginning replaces."""
    rank = window_rarity(documents, text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, int | None, bytes]]:
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            for part, ahead, i, t in zip(b.column("part").to_pylist(), b.column("ahead").to_pylist(), b.column("id").to_pylist(), texts):
                yield part, ahead, i, t.as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list = []                           # rows whose successor has come, and the last one
        held = 0
        carried: Digest | None = None                # digest of the first of them, if it is known

        def flush() -> pa.RecordBatch | None:
            nonlocal waiting, held, carried
            pairs = [(a, b) for a, b in zip(waiting, waiting[1:]) if not a[1] and a[0] == b[0]]
            out = None
            if pairs:
                texts = [a[3].decode() for a, _ in pairs]
                new = [edited(t, b[3].decode()) for t, (_, b) in zip(texts, pairs)]
                own = {id(r): None for p in pairs for r in p}
                plain = list({id(r): r for p in pairs for r in p if not (r is waiting[0] and carried is not None)}.values())
                made = digests([r[3] for r in plain] + [t.encode() for t in new], rank)
                own.update({id(r): d for r, d in zip(plain, made)})
                if carried is not None:
                    own[id(waiting[0])] = carried
                half = made[len(plain):]
                out = pa.RecordBatch.from_arrays(
                    [pa.array([a[2] for a, _ in pairs], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(new, pa.string()),
                     pa.array([str(own[id(a)]) for a, _ in pairs]), pa.array([str(d) for d in half]),
                     pa.array([likeness(own[id(a)], d) for (a, _), d in zip(pairs, half)], pa.float64()),
                     pa.array([likeness(own[id(a)], own[id(b)]) for a, b in pairs], pa.float64())], names=names)
                carried = own.get(id(waiting[-1]))
            else:
                carried = carried if len(waiting) == 1 else None
            waiting, held = waiting[-1:], len(waiting[-1][3]) if waiting else 0
            return out

        for row in rows(batches):
            if waiting and row[1] and waiting[-1][1] and waiting[-1][0] == row[0]:
                continue                             # further rows of the next range's first id
            waiting.append(row)
            held += len(row[3])
            if held >= GROUP_BYTES and len(waiting) > 1:
                out = flush()
                if out is not None:
                    yield out
        out = flush() if waiting else None
        if out is not None:
            yield out

    names = ["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return _in_order(documents, id_col, text_col).mapInArrow(
        run, "id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op12_fingerprints(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    out = against_next(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                      "fingerprint", "edited_fingerprint", "near_edited", "near_next")
