"""Exact top-k inner-product search: a ball tree per shard, branch and bound, shared k-th scores.

Vectors are dealt to shards of about ``shard_rows`` by a hash of their row, and each shard's task
builds a ball tree over its rows (nodes halve along the direction of their widest spread). A query
visits a shard's nodes in the order of the inner-product upper bound q.c + |q| r and stops at the
first bound below its k-th score so far. That score is shared: each query first searches the shard
it lives in, and carries the k-th score found there into all other shards, where it prunes from the
first node on (a shard whose root cannot reach it is not searched at all).

Queries meet the other shards in blocks of at most about ``query_rows``; a task holds one shard and
one block, whatever the number of queries or vectors. At most k candidates per query and shard
leave a task, and only those that reach the carried score.

Scores are exact integers: inner products of floor(scale * x). Ties go to the smaller id. Defined
results: a vector that is null, empty or holds null or non-finite components takes no part, nor does
one whose id is null; vectors of different lengths do not meet; of rows that share an id only the
smallest vector counts, or with ``every_row`` (the registered query) all are searched, each a result
of its own; a query row is no candidate of its own, other rows with its id are, and each query row is
ranked alone; a query with fewer than k candidates returns all of them; an empty table
gives an empty result. A product beyond the range of a 64-bit integer is an error."""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, key_groups, table

K, SCALE, QUERY_EVERY = 10, 1024, 100
SHARD_ROWS, QUERY_ROWS, LEAF_ROWS = 8192, 1024, 64
_UNIT = ["dim", "shard", "block"]
_OUT = "query_row long, query_id long, vec_id long, score long"
_LOWEST = -(1 << 63)


class BallTree:
    """Nodes over rows reordered so that each node is one range; bounds are safe against rounding. ``rows``:
    the rows' numbers, where ids repeat."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rows: np.ndarray | None = None):
        rows = ids if rows is None else rows
        self.x, self.order = x, np.arange(len(x))
        self.exact = bool(len(x)) and float(np.abs(x).max()) ** 2 * x.shape[1] < 2.0 ** 52
        self.ranges: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        self.centers, self.radii = [], []
        if len(x):
            self._build(0, len(x))
        self.ids, self.rows, self.x = ids[self.order], rows[self.order], x[self.order]
        self.centers, self.radii = np.array(self.centers), np.array(self.radii)

    def _build(self, s: int, e: int) -> int:
        rows = self.x[self.order[s:e]]
        center = rows.mean(axis=0)
        gap = rows - center
        far = (gap * gap).sum(axis=1)
        node = len(self.ranges)
        self.ranges.append((s, e))
        self.children.append(None)
        self.centers.append(center)
        self.radii.append(float(np.sqrt(far.max())))
        if e - s > LEAF_ROWS and self.radii[node] > 0:
            axis = gap[int(far.argmax())]
            along = gap @ axis
            half = (e - s) // 2
            self.order[s:e] = self.order[s:e][np.argpartition(along, half)]
            self.children[node] = (self._build(s, s + half), self._build(s + half, e))
        return node

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner product of each query row with any row of each node."""
        norm = np.sqrt((q * q).sum(axis=1))[:, None]
        size = norm * (np.sqrt((self.centers ** 2).sum(axis=1)) + self.radii)[None, :]
        return q @ self.centers.T + norm * self.radii[None, :] + 1e-9 * size + 1e-6

    def scores(self, q: np.ndarray, s: int, e: int) -> list[int]:
        if self.exact and float(np.abs(q).max()) * float(np.abs(self.x[s:e]).max()) * len(q) < 2.0 ** 52:
            return (self.x[s:e] @ q).astype(np.int64).tolist()
        exact = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in self.x[s:e]]
        if any(abs(v) >= 1 << 63 for v in exact):
            raise OverflowError("an inner product exceeds 64 bits; use a smaller scale")
        return exact

    def search(self, q: np.ndarray, bound: np.ndarray, own: int, k: int, least: int) -> list[tuple[int, int]]:
        """The best k (score, -id) of rows other than row ``own`` that reach ``least``."""
        best: list[tuple[int, int]] = []
        open_nodes = [(-bound[0], 0)]
        while open_nodes:
            reach, node = heapq.heappop(open_nodes)
            if -reach < (best[0][0] if len(best) == k else least):
                break
            if self.children[node] is None:
                s, e = self.ranges[node]
                for score, i, row in zip(self.scores(q, s, e), self.ids[s:e].tolist(), self.rows[s:e].tolist()):
                    if row != own and score >= least:
                        if len(best) < k:
                            heapq.heappush(best, (score, -i))
                        elif (score, -i) > best[0]:
                            heapq.heapreplace(best, (score, -i))
            else:
                for child in self.children[node]:
                    heapq.heappush(open_nodes, (-bound[child], child))
        return best


def _search_units(units: DataFrame, k: int) -> DataFrame:
    """Search each unit (vectors of a shard, with ``is_query`` false, and a block of queries)."""
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.select(*_UNIT, "is_query", "row", "id", "vec", "least").repartition(n, *_UNIT).sortWithinPartitions(*_UNIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, _, _), rows in key_groups(batches, _UNIT):
            x = np.frombuffer(b"".join(rows.column("vec").to_pylist()), "<f8").reshape(-1, dim)
            number, ids, ask = rows.column("row").to_numpy(), rows.column("id").to_numpy(), rows.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
            least = rows.column("least").to_numpy()
            tree = BallTree(ids[~ask], x[~ask], number[~ask])
            asked = np.flatnonzero(ask)
            if not len(tree.ids) or not len(asked):
                continue
            bound = tree.bounds(x[asked])
            out = [(int(number[r]), int(ids[r]), -neg, score) for n, r in enumerate(asked)
                   for score, neg in tree.search(x[r], bound[n], int(number[r]), k, int(least[r]))]
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(4)],
                                             names=["query_row", "query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, _OUT)


def scaled_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, dim, vec) of the rows that take part: floor(scale * x) as little-endian doubles."""
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, dims, blobs = [], [], []
            for i, v in zip(b.column("id").to_pylist(), b.column("v").to_pylist()):
                if v and None not in v:
                    x = np.floor(scale * np.array(v, np.float64))
                    if np.isfinite(x).all():
                        ids.append(i)
                        dims.append(len(x))
                        blobs.append((x + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())],
                                             names=["id", "dim", "vec"])

    return src.mapInArrow(run, "id long, dim int, vec binary")


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, scale: int = SCALE,
          shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, every_row: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id satisfies ``is_query`` (a function
    of the id column) its k best other vectors."""
    rows = scaled_vectors(vectors, id_col, vec_col, scale)
    if not every_row:
        rows = rows.groupBy("id").agg(F.min(F.struct("dim", "vec")).alias("v")).select("id", "v.dim", "v.vec")
    rows = rows.withColumn("ask", is_query(F.col("id"))).withColumn("row", F.monotonically_increasing_id())
    rows = cut(rows)
    n, n_ask = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("ask").cast("int")), F.lit(0))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_ask // query_rows))
    at = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    rows = rows.withColumn("home", at)
    asked = rows.where("ask")
    lowest = F.lit(_LOWEST).cast("long")

    # home shards: a shard's queries are few of its rows, so they all meet it in one unit
    stored = rows.select("dim", F.col("home").alias("shard"), F.lit(0).alias("block"), F.lit(False).alias("is_query"), "row", "id", "vec", lowest.alias("least"))
    home = _search_units(stored.unionByName(
        asked.select("dim", F.col("home").alias("shard"), F.lit(0).alias("block"), F.lit(True).alias("is_query"), "row", "id", "vec", lowest.alias("least"))), k)
    home = cut(home)
    if shards > 1:
        reached = home.groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
        asked = asked.join(reached, asked.row == reached.query_row, "left").withColumn(
            "least", F.when(F.col("n") >= k, F.col("kth")).otherwise(lowest))
        asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), F.col("row")), F.lit(blocks)).cast("int"))
        visits = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home")
        meet = stored.drop("block").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        away = _search_units(meet.unionByName(visits.select("dim", "shard", "block", F.lit(True).alias("is_query"), "row", "id", "vec", "least")), k)
        home = home.unionByName(away)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc("vec_id"))
    return home.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_topk(spark, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: ten best others of every vector whose id is divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % QUERY_EVERY == 0, every_row=True)


ORACLE = {
    "op5_exact_topk": """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.r <> q.r AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 10
""",
}
