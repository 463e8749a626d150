"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

A source's weight is its share of all tokens raised to an exponent between 0 (uniform) and 1
(natural), normalised. The exponent is bisected on the per-source table until the weights reach a
target entropy (as a fraction of the uniform one), or until no source is repeated more often than a
limit. Sixteen sections are evaluated per pass, which is four halvings, and a pass sends sixteen
numbers to the driver.

A weight times the budget is a source's quota of tokens. It is realised in blocks: a block is one
permutation of the source's documents, whole blocks are taken while the quota lasts, and the last,
partial block takes the documents of its permutation until their tokens would exceed what is left.
Without a budget the least repeated source is taken exactly once, so no document is left out.

A permutation orders documents by ``md5(seed:block:id)``. Where the partial block ends is found
without ordering a whole source in one task: tokens are summed per source and 1/4096 of the
permutation (combined map-side), the running sum over these sections finds the one in which the
quota ends, and only its documents are ordered. The answer is one key per source; documents compare
their own key with it. The table of sources is broadcast when its counted rows are few and joined
with salted keys otherwise, so a source with a third of all rows is never one task.

Everything is DataFrame functions; there is no Python on the executors. Defined results: null
sources are one source of their own; null or empty texts have 0 tokens; a source without tokens is
taken once per whole block and has no weight; documents that repeat an id within a source stand or
fall together in the partial block; an empty table gives an empty result."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, table

SEED, SECTIONS, PASSES, DIGITS = 11, 16, 10, 6
FEW_SOURCES = 20_000          # rows of the source table up to which it is broadcast
SALTS = 64
ROUNDING = 1e-6              # of a token: a quota that is a whole number stays one
PREFIX = 3                    # hex digits of a section: 4096 sections
TARGET_ENTROPY = 0.99


def estimated_tokens(text):
    """Tokens of a text for weighing: a quarter of its UTF-8 bytes, rounded up."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("long")


def permutation_key(id_col, seed: int, block: int):
    return F.md5(F.concat(F.lit(f"{seed}:{block}:"), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"))


def _too_low(alphas: DataFrame, goal: str, target: float, budget: float | None):
    """Rows (alpha, low): whether the exponent must rise. ``alphas`` has alpha, p, tokens per source."""
    z = F.sum(F.exp(F.col("alpha") * F.log("p")))
    by = alphas.groupBy("alpha")
    if goal == "entropy":
        tilted = F.sum(F.exp(F.col("alpha") * F.log("p")) * F.log("p"))
        return by.agg((F.log(z) - F.col("alpha") * tilted / z >= F.lit(target)).alias("low"))
    if budget is None:
        return by.agg((F.exp((F.lit(1.0) - F.col("alpha")) * (F.max(F.log("p")) - F.min(F.log("p")))) > F.lit(target)).alias("low"))
    most = F.max(F.exp(F.col("alpha") * F.log("p")) / F.col("tokens"))
    return by.agg((most * F.lit(budget) / z > F.lit(target)).alias("low"))


def bisect_exponent(sizes: DataFrame, goal: str, target: float, budget: float | None = None) -> float:
    """The exponent in [0, 1] for ``sizes`` (tokens, p; sources with tokens): with goal "entropy" the
    largest whose entropy (nats) still reaches ``target``, with goal "repeats" the smallest at which
    no source is taken more than ``target`` times. A goal out of reach gives the nearer end."""
    def low(points):
        grid = sizes.withColumn("alpha", F.explode(F.array(*map(F.lit, points))))
        return dict(map(tuple, _too_low(grid, goal, target, budget).collect()))

    ends = low([0.0, 1.0])
    if not ends or ends[1.0]:
        return 1.0
    if not ends[0.0]:
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(PASSES):
        points = [lo + (hi - lo) * i / SECTIONS for i in range(1, SECTIONS)]
        if hi - lo < 1e-12:
            break
        said = low(points)
        lo = max([lo, *(x for x in points if said[x])])
        hi = min([hi, *(x for x in points if not said[x])])
    return round(lo if goal == "entropy" else hi, DIGITS)


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None,
                cover: bool = False, seed: int = SEED) -> DataFrame:
    """One row per source: (source, tokens, weight, quota, full, cutoff). ``full`` blocks are taken
    whole; of the partial block, the documents whose key does not exceed ``cutoff``. The budget is
    ``budget`` tokens, all tokens of ``docs`` if not given, or with ``cover`` what takes the least
    repeated source exactly once."""
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give either target_entropy or max_repeats")
    key = permutation_key(F.col(id_col), seed, 0)
    rows = docs.select(F.col(source_col).alias("source"), estimated_tokens(F.col(text_col)).alias("tokens"), key.alias("key"))
    rows = rows.withColumn("section", F.substring("key", 1, PREFIX))
    sections = cut(rows.groupBy("source", "section").agg(F.sum("tokens").alias("tokens")))
    sizes = sections.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    total, most, n = sizes.where("tokens > 0").agg(
        F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.max("tokens"), F.lit(0)), F.count(F.lit(1))).first()
    spend = None if cover else total if budget is None else budget
    p = F.col("tokens") / F.lit(float(max(total, 1)))
    shares = sizes.where("tokens > 0").select("tokens", p.alias("p"))
    if target_entropy is not None:
        alpha = bisect_exponent(shares, "entropy", target_entropy * math.log(max(n, 1)))
    else:
        alpha = bisect_exponent(shares, "repeats", float(max_repeats), None if spend is None else float(spend))
    powered = F.exp(F.lit(alpha) * F.log(p))
    z = shares.agg(F.sum(F.exp(F.lit(alpha) * F.log("p")))).first()[0] or 1.0
    weight = F.when(F.col("tokens") > 0, powered / F.lit(z)).otherwise(F.lit(0.0))
    if spend is None:
        quota = F.round(F.col("tokens") * F.exp(F.lit(1.0 - alpha) * (F.log(F.lit(float(max(most, 1)))) - F.log("tokens"))))
    else:
        quota = F.floor(weight * F.lit(float(spend)) + F.lit(ROUNDING))
    plan = sizes.withColumn("weight", weight).withColumn("quota", F.when(F.col("tokens") > 0, quota.cast("long")).otherwise(F.lit(0).cast("long")))
    plan = plan.withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens")).cast("long")).otherwise(F.lit(1).cast("long")))
    plan = plan.withColumn("rest", F.col("quota") - F.when(F.col("tokens") > 0, F.col("full") * F.col("tokens")).otherwise(F.col("quota")))

    # where the partial block ends: first the section, then the documents of that section only
    running = sections.withColumn("upto", F.sum("tokens").over(
        Window.partitionBy("source").orderBy("section").rowsBetween(Window.unboundedPreceding, 0)))
    s, r = running.alias("s"), plan.alias("r")
    last = (s.join(r, F.col("s.source").eqNullSafe(F.col("r.source"))).where(F.col("s.upto") > F.col("r.rest"))
            .groupBy(F.col("s.source").alias("source"))
            .agg(F.min_by(F.struct(F.col("s.section").alias("section"), (F.col("r.rest") - F.col("s.upto") + F.col("s.tokens")).alias("left")),
                          F.col("s.section")).alias("end")))
    last = cut(last.select("source", "end.section", "end.left"))
    d, e = rows.alias("d"), last.alias("e")
    inside = d.join(e, F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.section") == F.col("e.section"))).select(
        F.col("d.source").alias("source"), "key", "tokens", "left")
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("key"))     # peers of a key together
    ends = inside.withColumn("upto", upto).where(F.col("upto") <= F.col("left")).groupBy("source").agg(F.max("key").alias("last_key"))
    cutoffs = last.alias("e").join(ends.alias("k"), F.col("e.source").eqNullSafe(F.col("k.source")), "left").select(
        F.col("e.source").alias("source"), F.coalesce("last_key", F.col("e.section")).alias("cutoff"))
    return plan.alias("r").join(cutoffs.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")), "left").select(
        "r.source", "r.tokens", "r.weight", "r.quota", "r.full", F.col("c.cutoff").alias("cutoff"))


def with_copies(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED,
                out_col: str = "copies") -> DataFrame:
    """``docs`` with the number of times the mix takes each."""
    plan = cut(plan)
    s, full, cutoff, salt = (fresh(docs, c) for c in ("mix_source", "mix_full", "mix_cutoff", "mix_salt"))
    side = plan.select(F.col("source").alias(s), F.col("full").alias(full), F.col("cutoff").alias(cutoff))
    if plan.count() <= FEW_SOURCES:
        joined = docs.join(F.broadcast(side), docs[source_col].eqNullSafe(side[s]))
    else:
        side = side.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = docs.withColumn(salt + "_d", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
        joined = salted.join(side, salted[source_col].eqNullSafe(side[s]) & (salted[salt + "_d"] == side[salt]))
    key = permutation_key(F.col(id_col), seed, 0)
    copies = F.col(full) + F.coalesce(key <= F.col(cutoff), F.lit(False)).cast("long")
    return joined.select(*(c for c in docs.columns if c.lower() != out_col.lower()), copies.alias(out_col))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", out_col: str = "copies",
        seed: int = SEED, **goal) -> DataFrame:
    """``docs`` with ``out_col``, the number of copies of each document in the mix; see mixing_plan. A column
    of that name is replaced."""
    plan = mixing_plan(docs, id_col, source_col, text_col, seed=seed, **goal)
    return with_copies(docs, plan, id_col, source_col, seed, out_col)


def realise(mixed: DataFrame, copies_col: str = "copies", id_col: str = "doc_id", seed: int = SEED, block_col: str | None = None,
            order_col: str | None = None) -> DataFrame:
    """One row for each copy. ``block_col`` numbers a document's copies (its blocks), ``order_col``
    is the document's place in that block's permutation: sorted by the two, sources interleave."""
    block = fresh(mixed, "block") if block_col is None else block_col
    out = mixed.where(F.col(copies_col) > 0).withColumn(block, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies_col))))
    if order_col:
        name = F.concat_ws(":", F.lit(str(seed)), F.col(block).cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
        out = out.withColumn(order_col, F.md5(name.cast("binary")))
    return out.drop(copies_col, *([] if block_col else [block]))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, copies of every document in a mix of the corpus's own size whose
    source weights reach 0.99 of the uniform entropy."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix(docs, target_entropy=TARGET_ENTROPY)
    return mixed.select("doc_id", "source", estimated_tokens(F.col("text")).alias("n_tokens"), "copies")


ORACLE = {
    "op8_mixing": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST((coalesce(strlen(text), 0) + 3) // 4 AS BIGINT) AS tokens,
    md5('{SEED}:0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
sizes AS (SELECT source, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY source),
shares AS (SELECT tokens, tokens / sum(tokens) OVER () AS p FROM sizes WHERE tokens > 0),
goal AS (SELECT {TARGET_ENTROPY} * ln(count(*)) AS h, CAST(sum(tokens) AS DOUBLE) AS total FROM shares),
halving(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, (SELECT ln(sum(exp((lo + hi) / 2 * ln(p))))
          - (lo + hi) / 2 * sum(exp((lo + hi) / 2 * ln(p)) * ln(p)) / sum(exp((lo + hi) / 2 * ln(p))) FROM shares) >= (SELECT h FROM goal) AS up
        FROM halving WHERE i < 40)),
found AS (
  SELECT CASE WHEN (SELECT -sum(p * ln(p)) FROM shares) >= (SELECT h FROM goal) THEN 1.0
    ELSE round((SELECT lo FROM halving WHERE i = 40), {DIGITS}) END AS alpha),
weights AS (
  SELECT source, tokens, CASE WHEN tokens > 0 THEN exp(alpha * ln(tokens / total)) ELSE 0 END AS u, total
  FROM sizes, found, goal),
quotas AS (SELECT source, tokens, floor(u / (SELECT sum(u) FROM weights) * total + {ROUNDING}) AS quota FROM weights),
blocks AS (
  SELECT source, CASE WHEN tokens > 0 THEN floor(quota / tokens) ELSE 1 END AS full_blocks,
    CASE WHEN tokens > 0 THEN quota - floor(quota / tokens) * tokens ELSE -1 END AS rest FROM quotas)
SELECT d.doc_id, d.source, d.tokens AS n_tokens,
  CAST(b.full_blocks + CASE WHEN sum(d.tokens) OVER (PARTITION BY d.source ORDER BY d.key) <= b.rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM d JOIN blocks b ON d.source IS NOT DISTINCT FROM b.source
""",
}
