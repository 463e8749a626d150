"""Phrase collocation mining: an FM-index per shard over word ids, extended in both directions.

Texts are cut into pieces and words; runs of pieces of one language form shards of about
``shard_words`` words, each a sequence of word ids with a separator between pieces. A shard's index
holds the Burrows-Wheeler transform of the sequence and of its reverse. A phrase is an interval of
rows in both; extending an interval by one word to the left or to the right gives the intervals and
counts of all its extensions at once. Rows are ordered by their first ``max_words`` symbols, which is
all that phrases of that length need.

Counts are summed across shards, one length after the other: words first (rarer words than
``min_count`` become separators), then phrases of two words, and longer ones only where both phrases
of one word less may be frequent. "May be" is asked of a bit filter of the frequent phrases, broadcast
and at most ``FILTER_BYTES`` large at any size; what it lets through by mistake is removed by the exact
sums, so a full filter costs rows, not correctness. Sequences are written once to the shared folder
and never shuffled after that; a task holds one shard, or one bucket of about BUCKET_WORDS phrases.

A phrase of k words has k - 1 cuts; the lowest score floor(scale * a / (l + r)) counts, ties to the
smallest first part. Parts of a frequent phrase are frequent, so all counts are at hand. A phrase is
subsumed if an extension by one word keeps enough of its count: a longer phrase that holds it and
keeps enough has such an extension of at least the same count. Sums are 64-bit, products decimal.

Defined results: a null text is an empty one, which has no words; a null language is ``und``; ids and
other columns are not read, so null ids, repeated rows and clashing names do not matter (each row
counts); ties are settled by count and phrase; a text of any length is read whole (shards end between
pieces, so a piece longer than a shard makes a larger shard); an empty table gives an empty result."""
from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import checked_broadcast
from .common import ASCII_UPPER, cut, drop_stored, key_groups, store, table

MIN_COUNT, MAX_WORDS, SUBSUMED_PCT, FIRST, SCORE_SCALE = 30, 4, 80, 2000, 2_000_000
SHARD_WORDS = 1 << 20
BUCKET_WORDS = 1 << 20              # of text, for each bucket that phrases are summed in
FILTER_BYTES, FILTER_BITS_EACH, FILTER_PROBES = 32 << 20, 16, 2
_BUCKET = 4096                     # bytes of a piece of the filter, as bitmap_or_agg takes them
# Piece separators, blanks.
SEPARATORS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_FOLD = bytes.maketrans(ASCII_UPPER.encode() + SEPARATORS + BLANKS,
                        ASCII_UPPER.lower().encode() + b"\n" * len(SEPARATORS) + b" " * len(BLANKS))


def _packed(columns: list[np.ndarray]) -> bytes:
    """Integer columns, compressed."""
    wide = max((int(c.max()) for c in columns if len(c)), default=0) >= 2 ** 31
    raw = b"".join(c.astype("<i8" if wide else "<i4").tobytes() for c in columns)
    return bytes([8 if wide else 4]) + zstandard.ZstdCompressor(level=3).compress(raw)


def _unpacked(blob: bytes, columns: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob[1:])
    return np.frombuffer(raw, f"<i{blob[0]}").reshape(columns, -1)


# ---------------------------------------------------------------- shards of word ids

class _OpenShard:
    def __init__(self):
        self.vocabulary: dict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = lambda: len(self.vocabulary) + 1
        self.ids = array("i", [0])
        self.pieces = 1

    @property
    def words(self) -> int:
        return len(self.ids) - self.pieces

    def add(self, piece: list[bytes]) -> None:
        self.ids.extend(map(self.vocabulary.__getitem__, piece))
        self.ids.append(0)
        self.pieces += 1

    def row(self, shard: int, lang: str) -> pa.RecordBatch:
        ids = np.frombuffer(self.ids, np.int32)
        counts = np.bincount(ids, minlength=len(self.vocabulary) + 1)[1:]
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([lang]), pa.array([self.words], pa.int64()),
             pa.array([[w.decode() for w in self.vocabulary]], pa.list_(pa.string())),
             pa.array([counts], pa.list_(pa.int64())), pa.array([_packed([ids])], pa.binary())],
            names=["shard", "lang", "n_words", "vocabulary", "counts", "ids"])


def word_shards(documents: DataFrame, text_col: str, lang_col: str, shard_words: int) -> DataFrame:
    """(shard, lang, n_words, vocabulary, counts, ids) per shard; ``ids`` are positions in ``vocabulary``
    from 1, and 0 between pieces, compressed."""
    src = documents.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                           F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        shards: dict[str, _OpenShard] = defaultdict(_OpenShard)
        held = 0
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary())):
                for piece in text.as_py().translate(_FOLD).split(b"\n"):
                    words = piece.split(b" ")
                    if b"" in words:
                        words = [w for w in words if w]
                    if not words:
                        continue
                    shard = shards[lang]
                    shard.add(words)
                    held += len(words)
                    full = lang if shard.words >= shard_words else None
                    if full is None and held >= 4 * shard_words:
                        full = max(shards, key=lambda k: shards[k].words)
                    if full is not None:
                        done = shards.pop(full)
                        held -= done.words
                        yield done.row(number, full)
                        number += 1
        for lang, shard in shards.items():
            yield shard.row(number, lang)
            number += 1

    return src.mapInArrow(run, "shard long, lang string, n_words long, vocabulary array<string>, counts array<long>, ids binary")


def frequent_words(shards: DataFrame, min_count: int) -> DataFrame:
    """(lang, word, gid, f) of the words that occur ``min_count`` times in their language; gids are
    numbers from 0 without gaps."""
    words = shards.select("lang", F.explode(F.arrays_zip("vocabulary", "counts")).alias("w"))
    f = words.groupBy("lang", F.col("w.vocabulary").alias("word")).agg(F.sum("w.counts").alias("f")).where(F.col("f") >= min_count)
    f = cut(f.withColumn("gid", F.monotonically_increasing_id()))
    sizes = f.groupBy(F.shiftright("gid", 33).alias("part")).count().orderBy("part").collect()        # a row for each partition
    starts, total = {}, 0
    for r in sizes:
        starts[r.part] = total
        total += r["count"]
    if not starts:
        return f
    return f.withColumn("gid", F.get(F.array(*[F.lit(starts.get(i, 0)).cast("long") for i in range(max(starts) + 1)]), F.shiftright("gid", 33).cast("int"))
                        + F.col("gid").bitwiseAND(F.lit((1 << 33) - 1)))


def coded_shards(shards: DataFrame, frequent: DataFrame) -> DataFrame:
    """(gids, ids) per shard with frequent words: positions in ``gids`` from 1, in order of gid, and one
    0 for every run of separators and rarer words; words that stand alone are left out."""
    at = shards.select("shard", "lang", F.posexplode("vocabulary").alias("at", "word"))
    known = at.join(checked_broadcast(frequent.select("lang", "word", "gid"), row_bytes=96), ["lang", "word"])
    known = known.groupBy("shard").agg(F.collect_list(F.struct("at", "gid")).alias("known"))
    joined = shards.select("shard", "ids").join(known, "shard").select(
        F.col("known.at").alias("at"), F.col("known.gid").alias("gid"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                at, gid = (b.column(c)[r].values.to_numpy() for c in ("at", "gid"))
                order = np.argsort(gid)
                code = np.zeros(int(at.max()) + 2, np.int32)
                code[at[order] + 1] = np.arange(1, len(order) + 1)
                ids = _unpacked(b.column("ids")[r].as_py(), 1)[0]
                ids = np.where(ids < len(code), code[np.minimum(ids, len(code) - 1)], 0)
                word = np.concatenate(([False], ids > 0, [False]))
                keep = word[1:-1] & (word[:-2] | word[2:])                   # next to another frequent word
                keep = keep | np.concatenate(([True], keep[:-1]))            # and one separator after them
                ids = np.where(word[1:-1], ids, 0)[keep].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([gid[order]], pa.list_(pa.int64())), pa.array([_packed([ids])], pa.binary())],
                                                 names=["gids", "ids"])

    return joined.mapInArrow(run, "gids array<long>, ids binary")


# ---------------------------------------------------------------- the index of a shard

def _order_by_prefix(text: np.ndarray, depth: int) -> np.ndarray:
    """Rows of the (cyclic) suffixes ordered by at least their first ``depth`` symbols: ranks of prefixes
    whose length doubles. Pairs of ranks and the position fit one 64-bit word unless a shard is huge."""
    n, rank, length = len(text), text.astype(np.int64), 1
    while True:
        second = np.roll(rank, -length)
        bits, pos_bits = int(rank.max()).bit_length(), int(n).bit_length()
        if 2 * bits + pos_bits < 63:
            key = np.sort((((rank << bits) | second) << pos_bits) | np.arange(n))
            order, key = key & ((1 << pos_bits) - 1), key >> pos_bits
            new = np.concatenate(([False], key[1:] != key[:-1]))
        else:
            order = np.lexsort((second, rank))
            a, b = rank[order], second[order]
            new = np.concatenate(([False], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        length *= 2
        if length >= depth:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)


class _Bwt:
    """Burrows-Wheeler transform: the symbol before each row's suffix, and the row of the suffix that
    begins with it (LF mapping)."""

    def __init__(self, text: np.ndarray, depth: int):
        order = _order_by_prefix(text, depth)
        self.symbols = np.roll(text, 1)[order].astype(np.int64)
        row = np.empty(len(text), np.int64)
        row[order] = np.arange(len(text))
        self.lf = np.roll(row, 1)[order]


@dataclass
class Phrases:
    """Intervals of equally long phrases: their words, first row in the index of the sequence and in
    that of its reverse, and size (the count)."""
    words: np.ndarray
    row: np.ndarray
    reverse_row: np.ndarray
    size: np.ndarray

    def where(self, keep: np.ndarray) -> Phrases:
        return Phrases(self.words[keep], self.row[keep], self.reverse_row[keep], self.size[keep])


class ShardIndex:
    """Bidirectional FM-index of ``ids``, in which 0 separates and is part of no phrase."""

    def __init__(self, ids: np.ndarray, depth: int):
        self.text, self.depth = np.concatenate((ids, [0])), depth
        self.counts = np.bincount(self.text)

    @cached_property
    def forward(self) -> _Bwt:
        return _Bwt(self.text, self.depth)

    @cached_property
    def reverse(self) -> _Bwt:
        return _Bwt(self.text[::-1], self.depth)

    def single_words(self) -> Phrases:
        first = np.concatenate(([0], np.cumsum(self.counts)[:-1]))
        seen = np.flatnonzero(self.counts[1:]) + 1
        return Phrases(seen[:, None], first[seen], first[seen], self.counts[seen])

    def _extend(self, bwt: _Bwt, rows: np.ndarray, other: np.ndarray, size: np.ndarray):
        """For each interval of ``bwt`` and each symbol before it: parent, symbol, first row, first row
        in the other index, size. In the other index the symbol follows, so smaller ones come first."""
        total = int(size.sum())
        starts = np.cumsum(size) - size
        parent = np.repeat(np.arange(len(size)), size)
        at = np.arange(total) - starts[parent] + rows[parent]
        symbol = bwt.symbols[at]
        sym_bits, pos_bits = max(1, len(self.counts).bit_length()), max(1, total.bit_length())
        if len(size).bit_length() + sym_bits + pos_bits < 63:
            key = np.sort((((parent << sym_bits) | symbol) << pos_bits) | np.arange(total))
            order, key = key & ((1 << pos_bits) - 1), key >> pos_bits
            head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[:total]
        else:
            order = np.lexsort((symbol, parent))
            p, s = parent[order], symbol[order]
            head = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (s[1:] != s[:-1]))))[:total]
        count = np.diff(np.concatenate((head, [total])))
        # an extension's rows are one interval again: the lowest one that its rows lead to comes first
        row = np.minimum.reduceat(bwt.lf[at[order]], head) if total else head
        parent, symbol = parent[order[head]], symbol[order[head]]
        real = symbol > 0
        parent, head = parent[real], head[real]
        return parent, symbol[real], row[real], other[parent] + head - starts[parent], count[real]

    def extend_left(self, p: Phrases) -> Phrases:
        parent, symbol, row, reverse_row, size = self._extend(self.forward, p.row, p.reverse_row, p.size)
        return Phrases(np.column_stack((symbol, p.words[parent])), row, reverse_row, size)

    def extend_right(self, p: Phrases) -> Phrases:
        parent, symbol, reverse_row, row, size = self._extend(self.reverse, p.reverse_row, p.row, p.size)
        return Phrases(np.column_stack((p.words[parent], symbol)), row, reverse_row, size)


def shard_phrases(index: ShardIndex, words: int, may_be_frequent: Callable[[np.ndarray], np.ndarray]) -> Phrases:
    """The shard's phrases of ``words`` words whose parts of one word less may be frequent (a function
    of rows of word ids), extended to the left and to the right by turns."""
    p = index.single_words()
    for k in range(2, words + 1):
        p = index.extend_left(p) if k % 2 == 0 else index.extend_right(p)
        if k > 2:
            p = p.where(may_be_frequent(p.words[:, :-1]) & may_be_frequent(p.words[:, 1:]))
        if k < words:
            p = p.where(may_be_frequent(p.words))
    return p


# ---------------------------------------------------------------- the filter of frequent phrases

def _probes(gids: np.ndarray, n_bits: int) -> np.ndarray:
    """Bits of each row of word ids: FILTER_PROBES columns."""
    h = np.full(len(gids), gids.shape[1], np.uint64)
    for c in range(gids.shape[1]):
        h = (h ^ gids[:, c].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    step = (h >> np.uint64(17)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) % np.uint64(n_bits) for i in range(FILTER_PROBES)], axis=1).astype(np.int64)


def phrase_filter(frequent: DataFrame, words: int, limit_bytes: int = FILTER_BYTES) -> bytes:
    """Bit filter of the frequent phrases (columns g0, g1, ...): a power of two of at most
    ``limit_bytes``, merged from the tasks' pieces."""
    wanted = max(1, frequent.count()) * FILTER_BITS_EACH // 8
    n_bytes = min(limit_bytes, max(_BUCKET, 1 << (wanted - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(n_bytes, np.uint8)
        for b in batches:
            at = _probes(np.column_stack([b.column(c).to_numpy() for c in range(words)]), n_bytes * 8).ravel()
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        pieces = bits.reshape(-1, _BUCKET)
        used = np.flatnonzero(pieces.any(axis=1))
        for s in range(0, len(used), 1024):
            some = used[s:s + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pieces[i].tobytes() for i in some], pa.binary())],
                                             names=["bucket", "bits"])

    parts = frequent.select(*[f"g{i}" for i in range(words)]).mapInArrow(run, "bucket int, bits binary")
    out = bytearray(n_bytes)
    for r in parts.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")).collect():    # at most limit_bytes
        out[r.bucket * _BUCKET:(r.bucket + 1) * _BUCKET] = r.bits
    return bytes(out)


def _holds(bits: np.ndarray, gids: np.ndarray) -> np.ndarray:
    at = _probes(gids, len(bits) * 8)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


# ---------------------------------------------------------------- phrases of all shards

def _summed(columns: np.ndarray) -> np.ndarray:
    """Columns of word ids and, last, counts: equal phrases as one, sorted."""
    order = np.lexsort(columns[-2::-1])
    columns = columns[:, order]
    head = np.flatnonzero(np.concatenate(([True], (columns[:-1, 1:] != columns[:-1, :-1]).any(axis=0)))[:columns.shape[1]])
    return np.vstack((columns[:-1, head], np.add.reduceat(columns[-1], head)[None, :])) if len(head) else columns


def phrase_counts(coded: DataFrame, words: int, depth: int, filters: dict[int, bytes], min_count: int, buckets: int) -> DataFrame:
    """(g0, g1, ..., f): phrases of ``words`` words that occur ``min_count`` times over all shards.
    ``filters`` holds the filter of each shorter length from two words on. A shard sends one compressed
    block to each of ``buckets`` (a hash of the phrase), and a bucket adds its blocks up: a phrase is
    in a shard's block once, however frequent it is."""
    spark = coded.sparkSession
    shared = {k: spark.sparkContext.broadcast(v) for k, v in filters.items()}
    names = [f"g{i}" for i in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {k: np.frombuffer(v.value, np.uint8) for k, v in shared.items()}
        for b in batches:
            for r in range(b.num_rows):
                gids = np.concatenate(([-1], b.column("gids")[r].values.to_numpy()))
                ids = _unpacked(b.column("ids")[r].as_py(), 1)[0]
                if not len(ids):
                    continue
                found = shard_phrases(ShardIndex(ids, depth), words, lambda w: _holds(bits[w.shape[1]], gids[w]))
                rows = gids[found.words]
                bucket = _probes(rows, buckets)[:, 0]
                order = np.lexsort((*rows.T[::-1], bucket))
                columns, bucket = np.vstack((rows[order].T, found.size[order][None, :])), bucket[order]
                used, starts = np.unique(bucket, return_index=True)
                blocks = [_packed(list(c)) for c in np.split(columns, starts[1:], axis=1)] if len(used) else []
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(blocks, pa.binary())], names=["bucket", "block"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in key_groups(batches, ["bucket"]):
            total = _summed(np.concatenate([_unpacked(v, words + 1).astype(np.int64) for v in rows.column("block").to_pylist()], axis=1))
            total = total[:, total[-1] >= min_count]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in total], names=[*names, "f"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = coded.mapInArrow(run, "bucket long, block binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    return blocks.mapInArrow(add, ", ".join(f"{c} long" for c in [*names, "f"]))


def collocations(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                 max_words: int = MAX_WORDS, subsumed_pct: int = SUBSUMED_PCT, scale: int = SCORE_SCALE,
                 shard_words: int = SHARD_WORDS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Every phrase of 2 to ``max_words`` words with ``min_count`` occurrences: lang, phrase, words, a (count),
    cut (words of the first part of its lowest-scoring cut), l, r, score, n (words of the language),
    extended_left and extended_right (count of the most frequent extension by one word to that side
    that is itself frequent, else null) and subsumed (an extension keeps ``subsumed_pct`` per cent)."""
    made = []
    shards = store(word_shards(documents, text_col, lang_col, shard_words), made)
    totals = cut(shards.groupBy("lang").agg(F.sum("n_words").alias("n")))
    all_words = totals.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-all_words // BUCKET_WORDS))
    frequent = frequent_words(shards, min_count)
    coded = store(coded_shards(shards, frequent), made)
    grams = frequent.select(F.array("gid").alias("g"), "f")
    found, filters = None, {}
    for k in range(2, max_words + 1):
        some = cut(phrase_counts(coded, k, max_words, filters, min_count, buckets))
        if k < max_words:
            filters[k] = phrase_filter(some, k, filter_bytes)
        some = some.select(F.array(*[f"g{i}" for i in range(k)]).alias("g"), "f")
        found = some if found is None else found.unionByName(some)
    drop_stored(documents.sparkSession, made)
    grams = grams.unionByName(found)

    cuts = found.select("g", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("g") - 1)).alias("cut"))
    cuts = cuts.withColumn("first", F.slice("g", 1, F.col("cut"))).withColumn("rest", F.slice("g", F.col("cut") + 1, F.size("g") - F.col("cut")))
    cuts = cuts.join(grams.select(F.col("g").alias("first"), F.col("f").alias("l")), "first")
    cuts = cuts.join(grams.select(F.col("g").alias("rest"), F.col("f").alias("r")), "rest")
    score = F.expr(f"(CAST({int(scale)} AS DECIMAL(18,0)) * CAST(a AS DECIMAL(20,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = cuts.groupBy("g", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))

    longer = found.where(F.size("g") > 2)
    held = longer.select(F.slice("g", 1, F.size("g") - 1).alias("g"), F.lit(None).cast("long").alias("left"), F.col("f").alias("right")).unionByName(
        longer.select(F.slice("g", 2, F.size("g") - 1).alias("g"), F.col("f").alias("left"), F.lit(None).cast("long").alias("right")))
    held = held.groupBy("g").agg(F.max("left").alias("extended_left"), F.max("right").alias("extended_right"))
    kept = F.greatest("extended_left", "extended_right").cast("decimal(20,0)") * F.lit(100) >= F.col("a").cast("decimal(20,0)") * F.lit(int(subsumed_pct))
    out = best.join(held, "g", "left").withColumn("subsumed", F.coalesce(kept, F.lit(False)))

    spelled = out.select("g", F.posexplode("g").alias("at", "gid")).join(frequent.select("gid", "lang", "word"), "gid")
    spelled = spelled.groupBy("g").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    spelled = spelled.select("g", "lang", F.col("w.word").alias("w"))
    out = out.join(spelled, "g").join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang")
    return out.select("lang", F.array_join("w", " ").alias("phrase"), F.size("g").alias("words"), "a", F.col("best.cut").alias("cut"),
                      F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"),
                      "extended_left", "extended_right", "subsumed")


def top_phrases(phrases: DataFrame, first: int = FIRST) -> DataFrame:
    """The first phrases of each language that no extension subsumes: lang, rank, phrase, a, l, r, n, score."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = phrases.where(~F.col("subsumed")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first 2,000 phrases of 2 to 4 words."""
    return top_phrases(collocations(table(spark, sf_dir, "documents")))


ORACLE = {
    "op13_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM worded, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
cand AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 30),
parts AS MATERIALIZED (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand)),
cuts AS (
  SELECT p.lang, p.phrase, p.a, p.cut, l.a AS l, r.a AS r, 2000000::HUGEINT * p.a // (l.a + r.a) AS score
  FROM parts p JOIN f l ON l.lang = p.lang AND l.phrase = p.first JOIN f r ON r.lang = p.lang AND r.phrase = p.rest),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS MATERIALIZED (
  SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2),
         lambda i: array_to_string(w[i:i + m - 1], ' '))))) AS phrase FROM cand),
held AS (SELECT lang, phrase, max(a) AS longest FROM inside GROUP BY ALL),
dropped AS (SELECT b.lang, b.phrase FROM best b JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase WHERE 100 * h.longest >= 80 * b.a),
ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, b.score
  FROM best b ANTI JOIN dropped d ON d.lang = b.lang AND d.phrase = b.phrase)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n AS n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""",
}
