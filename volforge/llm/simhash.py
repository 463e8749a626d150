"""SimHash near-duplicate groups: exact over all fingerprints, by tiled comparison.

A document's fingerprint has a bit set where more than half of its shingles' XXH64 hashes have it.
Fingerprints that differ in at most ``max_bits`` bits are linked; groups are the connected
components. Equal fingerprints are one node from the start, so exact copies cost nothing.

The comparison is exact: two fingerprints within ``max_bits`` bits agree on at least one of
``max_bits + 1`` blocks of bits, so fingerprints meet in the group of each of their block values.
Each group is worked off in tiles of fingerprints sorted by population count: numpy exclusive-or and
bit counts over a pair of tiles at a time, and a pair of tiles whose population counts lie further
apart than the radius is skipped unread, because the counts of two fingerprints differ by no more
than the fingerprints do. Large groups are dealt to several tasks (``tiles.deal``).

Words are runs of anything but ASCII white space, A-Z lower-cased; shingles keep repeats. Defined
results: null text counts as empty; a document without words has fingerprint zero and is linked like
any other; a document shorter than a shingle has its whole word sequence as its one shingle;
documents that repeat are rows of one group; rows with a null id are grouped too, and a group's
component id is the smallest id in it that is not null; an empty table gives an empty result."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, key_groups, table
from .graph import components
from .tiles import TILE_ROWS, deal, gather, smallest_reachable

SHINGLE, MAX_BITS, SEED = 3, 2, 42
HASH_CHUNK = 1 << 16      # shingles hashed and counted at a time
COMPARE_TILE = 256        # fingerprints on a side of one numpy comparison


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one whole text."""
    from xxhash import xxh64_intdigest
    words = text.lower().split()   # on bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for s in range(0, n, HASH_CHUNK):
        e = min(n, s + HASH_CHUNK)
        runs = zip(*(words[s + k:e + k] for k in range(shingle)))
        h = np.fromiter((xxh64_intdigest(b" ".join(r), seed) for r in runs), np.uint64, e - s)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, row_hash, fp): one narrow pass over whole texts; ``fp`` is signed, ``row_hash`` tells
    rows of one id with different texts apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row_hash"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row_hash"), pa.array(fp.view(np.int64))],
                                             names=["id", "row_hash", "fp"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, row_hash long, fp long")


def close_pairs(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of fingerprints within ``radius`` bits, of one array (i < j) or between two."""
    lp = np.argsort(lc := np.bitwise_count(left), kind="stable")
    rp, rc = (lp, lc) if right is None else (np.argsort(c := np.bitwise_count(right), kind="stable"), c)
    other = left if right is None else right
    found_i, found_j = [], []
    for s in range(0, len(lp), COMPARE_TILE):
        a = lp[s:s + COMPARE_TILE]
        lo, hi = int(lc[a[0]]), int(lc[a[-1]])
        for t in range(s if right is None else 0, len(rp), COMPARE_TILE):
            b = rp[t:t + COMPARE_TILE]
            if int(rc[b[0]]) - hi > radius:
                break                                   # sorted: all later tiles are further away
            if lo - int(rc[b[-1]]) > radius:
                continue
            near = np.bitwise_count(left[a][:, None] ^ other[b][None, :]) <= radius
            if right is None and s == t:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            found_i.append(a[i])
            found_j.append(b[j])
    none = np.empty(0, np.int64)
    return (np.concatenate(found_i) if found_i else none), (np.concatenate(found_j) if found_j else none)


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of max_bits + 1 blocks that cover 64 bits."""
    n = max_bits + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(s, e - s) for s, e in zip(edges, edges[1:])]


def links(prints: DataFrame, max_bits: int = MAX_BITS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints (column fp) within ``max_bits``."""
    keys = ["block", "value"]
    values = F.array(*(F.struct(F.lit(k).alias("block"),
                                F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)).alias("value"))
                       for k, (s, w) in enumerate(_blocks(max_bits))))
    rows = prints.select("fp", F.explode(values).alias("at")).select("at.block", "at.value", "fp")
    units = gather(deal(rows, keys, "fp", tile_rows).select(*keys, "ta", "tb", "tile", "fp"), [*keys, "ta", "tb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, ta, tb), unit in key_groups(batches, [*keys, "ta", "tb"]):
            fp = unit.column("fp").to_numpy()
            u = fp.view(np.uint64)
            if ta == tb:
                i, j = close_pairs(u, None, max_bits)
            else:
                left = np.flatnonzero(unit.column("tile").to_numpy() == ta)
                right = np.flatnonzero(unit.column("tile").to_numpy() == tb)
                i, j = close_pairs(u[left], u[right], max_bits)
                i, j = left[i], right[j]
            low = smallest_reachable(len(fp), i, j)
            moved = np.flatnonzero(low != np.arange(len(fp)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[low[moved]])], names=["a", "b"])

    return units.mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                   max_bits: int = MAX_BITS, seed: int = SEED, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(id, row_hash, fp, root, component_id) of every row: ``root`` names the group, ``component_id``
    is the smallest id in it."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle, seed))
    distinct = rows.groupBy("fp").agg(F.min("id").alias("first_id"))
    comp = components(links(distinct.select("fp"), max_bits, tile_rows)).withColumnRenamed("node", "fp")
    linked = distinct.join(comp, "fp")
    ids = linked.groupBy("root").agg(F.min("first_id").alias("group_id"))
    named = distinct.join(comp.join(ids, "root"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("group_id", "first_id").alias("component_id"))
    return rows.join(named, "fp").select("id", "row_hash", "fp", "root", "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, one for each group: that with the smallest id (of repeated rows, one).
    Texts are shuffled once, by (id, row hash), a key that spreads evenly."""
    groups = simhash_groups(docs, id_col, text_col, shingle, max_bits, seed)
    kept = groups.groupBy("root").agg(F.min_by(F.struct("id", "row_hash"), F.struct(F.col("id").isNull(), "id", "row_hash")).alias("k"))
    k_id, k_hash, rank = (fresh(docs, c) for c in ("kept_id", "kept_hash", "kept_rank"))
    kept = kept.select(F.col("k.id").alias(k_id), F.col("k.row_hash").alias(k_hash))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    found = docs.join(kept, docs[id_col].eqNullSafe(kept[k_id]) & (F.xxhash64(text) == kept[k_hash]))
    w = Window.partitionBy(k_id, k_hash).orderBy(F.lit(1))
    return found.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).select(*docs.columns)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
