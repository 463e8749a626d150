"""Hard-negative mining by exact scores from a residue-number-system matrix product.

Scores are inner products of integer components floor(scale * x). A unit of work multiplies a shard of
vectors with blocks of anchors: both matrices are reduced modulo several small primes, multiplied in
float32 (symmetric residues, and so few dimensions at a time that every sum stays below 2^24, hence
exact), and the signed scores are put together again by Chinese remaindering. The number of primes
follows from the largest vector norms (Cauchy-Schwarz), so no score can wrap around.

Two passes: an anchor first meets the shards of its own label, which gives its positives, then all
shards for the windows around those positives' scores, and each shard keeps the best few of another
label in each window. Shards are dealt by a hash of the row, within a label in the first pass, so a
label of any size is many shards; a task holds one shard and one block of anchors, and a window's
best few of each shard are all that leaves it.

Defined results: rows with a null id, label or vector, an empty vector or null or non-finite components
take no part; an anchor is no candidate of its own, other rows with its id are; repeated ids are rows
of their own (as anchors each is ranked alone), ties go to the smaller id; vectors of different lengths
do not meet; anchors without another row of their label, and windows without a row, give no row; an
empty table gives an empty result; names of other columns do not matter. Labels are integers. Scores
that may need more than 62 bits are an error before any work: use a smaller scale."""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, key_groups, table

SCALE, POSITIVES, NEGATIVES, LOW_PCT, HIGH_PCT = 256, 5, 5, 80, 100
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
SHARD_ROWS, LARGEST_SHARD, ANCHOR_ROWS = 4096, 1 << 17, 1024
SCORES_AT_ONCE = 1 << 21            # of one matrix product
SALTS = 16                          # parts of a label where rows look up its size
_UNIT = ["dim", "part", "shard"]


# ---------------------------------------------------------------- residues

def primes_for(bound: int, dim: int) -> tuple[list[int], int]:
    """Primes whose product exceeds 2 * bound + 1, and how many dimensions may be summed in float32:
    dimensions * ((p - 1) / 2)^2 < 2^24 for each prime p."""
    width = min(dim, 256)
    largest = 2 * math.isqrt((2 ** 24 - 1) // width) + 1
    primes, product = [], 1
    for p in range(largest, 2, -1):
        if product > 2 * bound + 1:
            break
        if all(p % q for q in range(2, math.isqrt(p) + 1)):
            primes.append(p)
            product *= p
    return primes, width


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """The residues of integers modulo ``p`` that are nearest to zero, as float32."""
    r = np.fmod(x, p)
    half = (p - 1) // 2
    return (r - p * (r > half) + p * (r < -half)).astype(np.float32)


class ResidueMatrix:
    """Rows of integers held as residues, and exact products with other rows."""

    def __init__(self, x: np.ndarray, primes: list[int], width: int):
        self.primes, self.width = primes, width
        self.parts = [residues(x, p) for p in primes]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Exact inner products of ``rows`` with the held rows, as 64-bit integers."""
        total, product = None, 1
        for p, held in zip(self.primes, self.parts):
            r = residues(rows, p)
            s = np.zeros((len(rows), len(held)), np.int64)
            for d in range(0, rows.shape[1], self.width):
                s += (r[:, d:d + self.width] @ held[:, d:d + self.width].T).astype(np.int64)
            if total is None:
                total = s % p
            else:                   # the digit that makes the sum so far agree modulo p as well
                total += product * ((s - total) % p * pow(product, -1, p) % p)
            product *= p
        return np.where(total > product // 2, total - product, total)


def best(scores: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The first k of the positions ``at`` by score descending, id ascending."""
    if len(at) > k:
        s = scores[at]
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


# ---------------------------------------------------------------- units of work

def integer_vectors(vectors: DataFrame, label: Column, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, label, dim, norm2, vec) of the rows that take part; vec holds floor(scale * x) as 16-bit
    integers where all of a row's fit, else as doubles."""
    src = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).alias("v"))
    src = src.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, dims, norms, blobs = [], [], [], []
            for n, v in enumerate(b.column("v")):
                v = v.values
                x = np.floor(scale * v.to_numpy(zero_copy_only=False).astype(np.float64)) if len(v) and not v.null_count else None
                if x is None or not np.isfinite(x).all():
                    continue
                keep.append(n)
                dims.append(len(x))
                norms.append(float(x @ x))
                blobs.append((x.astype("<i2") if np.abs(x).max() < 2 ** 15 else x).tobytes())
            chosen = b.select(["id", "label"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(blobs, pa.binary())],
                                             names=["id", "label", "dim", "norm2", "vec"])

    return src.mapInArrow(run, "id long, label long, dim int, norm2 double, vec binary")


def _matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    if all(len(v) == 2 * dim for v in blobs):
        return np.frombuffer(b"".join(blobs), "<i2").reshape(-1, dim).astype(np.float64)
    return np.stack([np.frombuffer(v, "<i2" if len(v) == 2 * dim else "<f8").astype(np.float64) for v in blobs])


def _meet(stored: DataFrame, asked: DataFrame, primes: list[int], width: int,
          pick: Callable[[np.ndarray, pa.Table, np.ndarray, np.ndarray, np.ndarray, int], Iterator[tuple]], schema: str, names: list[str]) -> DataFrame:
    """Bring each shard's vectors (block 0) and its blocks of anchors (from 1) to one task, and
    ``pick`` rows of the result from the scores of each anchor."""
    n = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*_UNIT, "block"]
    units = stored.withColumn("block", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    units = units.repartition(n, *_UNIT).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, unit = None, None
        for (*at, block), rows in key_groups(batches, keys):
            x = _matrix(rows.column("vec").to_pylist(), at[0])
            if block == 0:
                unit = at
                held = ResidueMatrix(x, primes, width), *(rows.column(c).to_numpy() for c in ("row", "id", "label"))
                continue
            if unit != at:
                continue                                   # anchors of a shard without vectors
            matrix, row, ids, labels = held
            step = max(1, SCORES_AT_ONCE // len(row))
            out = []
            for s in range(0, len(x), step):
                for n, scores in enumerate(matrix.scores(x[s:s + step]), s):
                    out.extend(pick(scores, rows, row, ids, labels, n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return units.mapInArrow(run, schema)


def mine_hard_negatives(vectors: DataFrame, is_anchor: Callable[[Column], Column], label: Column | None = None, id_col: str = "vec_id",
                        vec_col: str = "embedding", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES,
                        low_pct: int = LOW_PCT, high_pct: int = HIGH_PCT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank) of the rows whose
    id satisfies ``is_anchor``: for each anchor and each of its first positives the first rows of another
    label with low_pct * positive_score <= 100 * negative_score <= high_pct * positive_score."""
    rows = integer_vectors(vectors, F.col("label") if label is None else label, id_col, vec_col, scale)
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("ask", is_anchor(F.col("id"))))
    spark = vectors.sparkSession
    n, longest, dim = rows.agg(F.count(F.lit(1)), F.max("norm2"), F.max("dim")).first()
    anchor_norm, n_ask = rows.where("ask").agg(F.max("norm2"), F.count(F.lit(1))).first()
    reach = math.sqrt(longest or 0) * math.sqrt(anchor_norm or 0) * (1 + 1e-9)
    if reach >= 2.0 ** 61:
        raise OverflowError("an inner product may exceed 62 bits; use a smaller scale")
    primes, width = primes_for(int(reach) + 1, dim or 1)

    # shards: as many as keep all tasks busy, of at most LARGEST_SHARD rows, and not below shard_rows
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(shard_rows, min(LARGEST_SHARD, -(-n // tasks)))
    spread = lambda of, what: F.pmod(F.xxhash64(F.lit(what), "row"), of).cast("int")
    vec = ["dim", "row", "id", "label", "vec"]
    blocks = lambda m: (F.lit(1) + F.pmod(F.xxhash64(F.lit("block"), "row"), F.lit(max(1, -(-m // ANCHOR_ROWS))))).cast("int")

    # positives: the anchors meet the shards of their own label
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("of"))
    sizes = sizes.select("label", F.ceil(F.col("of") / F.lit(size)).cast("int").alias("shards"),
                         F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    placed = rows.withColumn("salt", spread(F.lit(SALTS), "salt")).join(sizes, ["label", "salt"]).withColumn("part", F.col("label"))
    stored = placed.select(*vec, "part", spread(F.col("shards"), "own").alias("shard"))
    asked = placed.where("ask").select(*vec, "part", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), blocks(n_ask).alias("block"))

    def own_label(scores, asked_rows, row, ids, labels, n):
        anchor = asked_rows.column("row")[n].as_py()
        for i in best(scores, ids, np.flatnonzero(row != anchor), positives):
            yield anchor, int(ids[i]), int(row[i]), int(scores[i])

    names = ["anchor", "positive_id", "positive_row", "positive_score"]
    found = _meet(stored, asked, primes, width, own_label, ", ".join(f"{c} long" for c in names), names)
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    found = cut(found.withColumn("positive_rank", F.row_number().over(order)).where(F.col("positive_rank") <= positives))

    # negatives: the anchors meet every shard, with the scores of their positives
    shards = max(1, -(-n // size))
    stored = rows.select(*vec, F.lit(0).cast("long").alias("part"), spread(F.lit(shards), "all").alias("shard"))
    windows = found.groupBy("anchor").agg(F.collect_set("positive_score").alias("windows"))     # at most ``positives`` of them
    asked = rows.where("ask").join(windows, F.col("row") == F.col("anchor")).select(
        *vec, F.lit(0).cast("long").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), blocks(n_ask).alias("block"), "windows")

    def other_label(scores, asked_rows, row, ids, labels, n):
        anchor, own = asked_rows.column("row")[n].as_py(), asked_rows.column("label")[n].as_py()
        at = np.flatnonzero(labels != own)
        other = scores[at]
        for p in asked_rows.column("windows")[n].as_py():
            low, high = -(-low_pct * p // 100), high_pct * p // 100
            inside = at[(other >= max(low, -(1 << 62))) & (other <= min(high, 1 << 62))]
            for i in best(scores, ids, inside, negatives):
                yield anchor, p, int(ids[i]), int(row[i]), int(scores[i])

    names = ["anchor", "positive_score", "negative_id", "negative_row", "negative_score"]
    near = _meet(stored, asked, primes, width, other_label, ", ".join(f"{c} long" for c in names), names)
    order = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    ids = rows.where("ask").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return found.join(near, ["anchor", "positive_score"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: of every vector whose id
    is divisible by 100. Where the id is divisible by 7, the label first becomes (label + 1) % 10."""
    moved = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label").cast("long") + 1) % LABELS).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"), lambda i: i % ANCHOR_EVERY == 0, moved).drop("positive_rank")


ORACLE = {
    "op11_hard_negatives": """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
scored AS MATERIALIZED (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, c.r, c.vec_id, a.label = c.label AS own, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.r <> a.r AND len(a.v) = len(c.v)),
positives AS (SELECT * FROM scored WHERE own QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, r) <= 5),
near AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, c.vec_id AS negative_id, c.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY c.score DESC, c.vec_id, c.r) AS rank
  FROM positives p JOIN scored c ON c.anchor = p.anchor AND NOT c.own AND 80 * p.score <= 100 * c.score AND 100 * c.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM near WHERE rank <= 5
""",
}
