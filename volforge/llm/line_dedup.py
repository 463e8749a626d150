"""Line dedup: lines that many documents share are dropped everywhere but in one of them.

Lines are exploded with their position, normalised (ASCII white space stripped at both ends, A-Z
lower-cased) and hashed to 128 bits inside an Arrow map task; lines of fewer than ``min_chars`` code
points never leave it. Per hash the distinct documents are counted (by partial aggregates, so a line
that a third of all documents hold is no hot group), hashes over the threshold are joined back to
the line positions, and each text is reassembled from the positions that remain. Whole texts are
shuffled once, by (id, text hash); line texts never are.

A dropped line survives in the largest document id that holds it. Defined results: null and empty
texts are one empty line; documents that repeat (same id and text) count once and are treated alike;
rows of one id with different texts are one document for the count, and each keeps its line if the
id is the largest; a null id counts as one document and is smaller than any other; an empty table
gives an empty result."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, cut, fresh, table

MIN_CHARS, MIN_DOCS = 40, 5
_SPACE = ASCII_SPACE.encode()


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, row_hash, pos, h1, h2): the hashed key of every line of at least ``min_chars`` code points."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row_hash"), text.cast("binary").alias("text"))
    id_type = src.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest
        half, sign = (1 << 64) - 1, 1 << 63
        for b in batches:
            row, pos, h1, h2 = [], [], [], []
            for r, t in enumerate(b.column("text")):
                for p, line in enumerate(t.as_py().split(b"\n")):
                    key = line.strip(_SPACE)
                    if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                        h = xxh3_128_intdigest(key.lower())
                        row.append(r)
                        pos.append(p)
                        h1.append(((h >> 64) ^ sign) - sign)
                        h2.append(((h & half) ^ sign) - sign)
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(at), b.column("row_hash").take(at), pa.array(pos, pa.int32()),
                 pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], names=["id", "row_hash", "pos", "h1", "h2"])

    return src.mapInArrow(run, f"id {id_type.simpleString()}, row_hash long, pos int, h1 long, h2 long")


def shared_positions(lines: DataFrame, min_docs: int) -> DataFrame:
    """(id, row_hash, drops): sorted positions (from 1) of the lines each row loses."""
    shared = lines.groupBy("h1", "h2").agg(
        (F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))).alias("n_docs"), F.max("id").alias("keeper"))
    shared = shared.where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper")
    lost = lines.join(shared, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("id", "row_hash").agg(F.collect_set(F.col("pos") + 1).alias("drops"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS, out_col: str = "lines") -> DataFrame:
    """``docs`` with ``out_col``: struct(n_lines, n_dropped, text) of each row after the dedup; a column of
    that name is replaced."""
    drops = shared_positions(cut(line_hashes(docs, id_col, text_col, min_chars)), min_docs)
    d_id, d_hash, d_pos = (fresh(docs, c) for c in ("lost_id", "lost_hash", "lost_lines"))
    drops = drops.select(F.col("id").alias(d_id), F.col("row_hash").alias(d_hash), F.col("drops").alias(d_pos))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    joined = docs.join(drops, docs[id_col].eqNullSafe(drops[d_id]) & (F.xxhash64(text) == drops[d_hash]), "left")
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(1), F.size(lines)), F.col(d_pos))
    rebuilt = F.when(F.col(d_pos).isNull(), text).otherwise(
        F.array_join(F.transform(kept, lambda p: F.element_at(lines, p)), "\n"))
    made = F.struct(F.size(lines).cast("long").alias("n_lines"),
                    F.when(F.col(d_pos).isNull(), F.lit(0)).otherwise(F.size(d_pos)).cast("long").alias("n_dropped"),
                    rebuilt.alias("text"))
    return joined.select(*(docs[c] for c in docs.columns if c.lower() != out_col.lower()), made.alias(out_col))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.text").cast("binary"), 256).alias("kept_sha256"))


_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = {
    "op6_line_dedup": f"""
WITH exploded AS (
  SELECT doc_id, k, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, row_number() OVER () AS k, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, {_STRIP}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM exploded),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT e.*, s.key IS NOT NULL AND e.doc_id <> s.keeper AS lost FROM keyed e LEFT JOIN shared s ON e.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id, k
""",
}
