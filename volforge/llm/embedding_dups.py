"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosine
verification, distributed connected components.

Every vector gets ``tables`` codes of ``bits`` signs each against (blockwise orthogonalised) random
hyperplanes; vectors of one label that share a code in any table are verified exactly, in double
precision, and linked if their cosine reaches the threshold. Vectors at angle t agree on a sign with
probability 1 - t / pi, so at the threshold 0.93 a pair is found with probability
1 - (1 - 0.88 ** 16) ** 32 > 0.98, and at 0.95 with 0.998; tests measure recall against brute force.

Equal vectors of a label are one node with a weight, so a hot vector costs one comparison. A bucket
of any size is worked off in units of at most two tiles (``tiles.deal``), which return a row per
vector: the number of links found there, and the smallest vector it connects to. A pair that shares
several tables is counted in the first one only, which each unit decides from the codes alone, so
link counts need no list of pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those
without a label, link with nothing; vectors of different lengths do not link; copies link with each
other; a null id takes part, is never a component id, and counts as kept when its group has no id
at all; repeated rows are vectors of their own; an empty table gives an empty result."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, key_groups, table
from .graph import components
from .tiles import TILE_ROWS, deal, gather, smallest_reachable

BITS, TABLES, THRESHOLD, SEED = 16, 32, 0.93, 7
VERIFY_BLOCK = 512


def clean_vectors(src: DataFrame) -> DataFrame:
    """(id, label, dim, vec): column ``embedding`` as little-endian doubles; dim and vec are null
    for vectors that take no part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column("embedding").to_pylist():
                ok = bool(v) and None not in v
                x = np.array(v, np.float64) if ok else None
                out.append(x.tobytes() if ok and np.isfinite(x).all() and x.any() else None)
            dim = [None if x is None else len(x) // 8 for x in out]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(dim, pa.int32()), pa.array(out, pa.binary())],
                                             names=["id", "label", "dim", "vec"])

    types = {f: src.schema[f].dataType.simpleString() for f in ("id", "label")}
    return src.select("id", "label", "embedding").mapInArrow(
        run, f"id {types['id']}, label {types['label']}, dim int, vec binary")


def hyperplanes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    """tables * bits rows; runs of up to ``dim`` rows are orthogonal, which evens out the angles."""
    rng = np.random.default_rng([seed, dim])
    rows = []
    while sum(map(len, rows)) < bits * tables:
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        rows.append((q * np.sign(np.diag(r))).T)
    return np.concatenate(rows)[:bits * tables]


def _unit(blobs: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), "<f8").reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)        # first, so that no square over- or underflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def with_codes(reps: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """``reps`` (first_id, label, dim, vec, weight) with ``codes``: one integer for each table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(bits)).astype(np.int32)
        for b in batches:
            dims, blobs = b.column("dim").to_numpy(), b.column("vec").to_pylist()
            codes = np.zeros((len(dims), tables), np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                h = planes.setdefault(int(d), hyperplanes(int(d), bits, tables, seed))
                signs = _unit([blobs[i] for i in at], int(d)) @ h.T >= 0
                codes[at] = signs.reshape(len(at), tables, bits).astype(np.int32) @ weights
            flat = pa.array(codes.ravel())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(dims) + 1) * tables, pa.int32()), flat)],
                names=[*b.schema.names, "codes"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema)
    return reps.mapInArrow(run, f"{kinds}, codes array<int>")


def _verified(x: np.ndarray, left: np.ndarray, right: np.ndarray | None, threshold: float):
    """Position pairs (i, j) with cosine >= threshold among ``left`` (i < j) or between the two, block by block."""
    cols = left if right is None else right
    for s in range(0, len(left), VERIFY_BLOCK):
        a = left[s:s + VERIFY_BLOCK]
        for t in range(s if right is None else 0, len(cols), VERIFY_BLOCK):
            b = cols[t:t + VERIFY_BLOCK]
            near = x[a] @ x[b].T >= threshold
            if right is None and s == t:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            if len(i):
                yield a[i], b[j]


def verified_links(reps: DataFrame, threshold: float, tile_rows: int) -> DataFrame:
    """(rid, links, low) per unit and vector that has links there: weighted link count, and the
    smallest rid it connects to. A pair adds to ``links`` in the first table it shares only."""
    keys = ["group", "t", "code"]
    rows = reps.select("rid", "group", F.posexplode("codes").alias("t", "code"))
    dealt = deal(rows, keys, "rid", tile_rows)
    dealt = dealt.join(reps.select("rid", "dim", "vec", "weight", "codes"), "rid")
    unit = [*keys, "ta", "tb"]
    units = gather(dealt.select(*unit, "tile", "rid", "dim", "vec", "weight", "codes"), unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, t, _, ta, tb), rows in key_groups(batches, unit):
            rows = rows.sort_by("rid")
            x = _unit(rows.column("vec").to_pylist(), rows.column("dim")[0].as_py())
            rid, w = rows.column("rid").to_numpy(), rows.column("weight").to_numpy()
            codes = np.array(rows.column("codes").combine_chunks().flatten()).reshape(len(rid), -1)
            tile = rows.column("tile").to_numpy()
            left = np.flatnonzero(tile == ta)
            right = None if ta == tb else np.flatnonzero(tile == tb)
            count, at_i, at_j = np.zeros(len(rid), np.int64), [], []
            for i, j in _verified(x, left, right, threshold):
                first = ~(codes[i, :t] == codes[j, :t]).any(axis=1)
                np.add.at(count, i[first], w[j[first]])
                np.add.at(count, j[first], w[i[first]])
                at_i.append(i)
                at_j.append(j)
            if at_i:
                low = smallest_reachable(len(rid), np.concatenate(at_i), np.concatenate(at_j))
                found = np.flatnonzero((count > 0) | (low != np.arange(len(rid))))
                yield pa.RecordBatch.from_arrays([pa.array(rid[found]), pa.array(count[found]), pa.array(rid[low[found]])],
                                                 names=["rid", "links", "low"])

    return units.mapInArrow(run, "rid long, links long, low long")


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                     threshold: float = THRESHOLD, bits: int = BITS, tables: int = TABLES, seed: int = SEED,
                     tile_rows: int = TILE_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept) of every row of ``vectors``."""
    src = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("embedding"))
    rows = clean_vectors(src)
    rows = cut(rows.withColumn("vec", F.when(F.col("label").isNotNull(), F.col("vec"))))
    reps = rows.where(F.col("vec").isNotNull()).groupBy("label", "dim", "vec").agg(
        F.min("id").alias("first_id"), F.count(F.lit(1)).alias("weight"))
    reps = with_codes(reps, bits, tables, seed).withColumn("rid", F.monotonically_increasing_id())
    reps = cut(reps.withColumn("group", F.xxhash64("label", "dim")))
    found = cut(verified_links(reps, threshold, tile_rows))
    n_links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("rid").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "rid")
    ids = reps.select("rid", "first_id").join(comp, "rid").groupBy("root").agg(F.min("first_id").alias("group_id"))
    named = (reps.select("rid", "label", "dim", "vec", "weight", "first_id").join(n_links, "rid", "left")
             .join(comp.join(ids, "root"), "rid", "left")
             .select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                     F.coalesce("group_id", "first_id").alias("component_id")))
    alone = rows.where(F.col("vec").isNull()).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    grouped = rows.where(F.col("vec").isNotNull()).join(named, ["label", "vec"]).select("id", "n_links", "component_id")
    return grouped.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()))


def op7_embedding_dups(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every embedding."""
    out = embedding_groups(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").cast("long").alias("vec_id"), "n_links", F.col("component_id").cast("long").alias("component_id"), "kept")
