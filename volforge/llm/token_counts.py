"""Token counts: lengths of a byte-level BPE encoding, computed by the tokenizer library inside
Arrow map tasks that return the lengths only.

Texts are split at safe boundaries, into words with the white space before them, and the parts that a
worker has not met yet are handed to the library in batches of about ``batch_bytes``; a text's count
is the sum of its parts' counts, which the worker remembers. So neither one long document nor many
documents at once decide how much memory a task needs, and a frequent word is encoded once.

A boundary is safe between a character that is not white space and a space, tab or line end. The
byte-level pre-tokenizer starts a new pre-token at such a place whatever follows (its look-ahead
only concerns runs of white space, which stay whole on the right side), and merges never cross
pre-tokens. Special strings hold no white space; for a tokenizer whose special strings do, or which
normalises or prefixes its input, texts are encoded whole.

Defined results: null text counts as the empty text (0 bytes, 0 tokens); null ids are kept; rows
that repeat are each counted; an empty table gives an empty result. A text without white space is
encoded whole."""
from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

TOKENIZER = "byte_bpe_50k.json"
BATCH_BYTES = 1 << 20
OVER_LIMIT = 1024

MEMORY, REMEMBERED_CHARS = 1_400_000, 48    # parts that a worker remembers

_EDGE = re.compile(r"(?<=\S)(?=[ \n\t\r])")
_PARTS = re.compile(r"\s*[^ \n\t\r]+|\s+")
_UNSAFE = -(1 << 50)      # the length of a part that ends in rarer white space: its end is no safe boundary


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


@functools.lru_cache(maxsize=4)
def _load(path: str):
    """The library's tokenizer and whether texts may be cut for it (once per worker)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark runs one task per core already
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    spec = json.loads(tok.to_str())
    pre = spec.get("pre_tokenizer") or {}
    cuttable = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                and not pre.get("add_prefix_space") and spec.get("normalizer") is None
                and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"])
                            for a in spec.get("added_tokens", [])))
    tok.no_truncation()
    tok.no_padding()
    return tok, cuttable


def _balanced(parts: list[str], batch_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``parts`` of about ``batch_bytes`` each."""
    start = size = 0
    for i, p in enumerate(parts):
        if size and size + len(p) > batch_bytes:
            yield start, i
            start, size = i, 0
        size += len(p)
    if start < len(parts):
        yield start, len(parts)


class Counter:
    """Token counts of texts; remembers the counts of their parts in two generations."""

    def __init__(self, path: str, batch_bytes: int = BATCH_BYTES):
        self.tok, self.cuttable = _load(path)
        self.batch_bytes = batch_bytes
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def _encoded(self, parts: list[str]) -> list[int]:
        out = []
        for s, e in _balanced(parts, self.batch_bytes):
            out += map(len, self.tok.encode_batch_fast(parts[s:e], add_special_tokens=False))
        return out

    def _sums(self, split: list[list[str]]) -> list[int]:
        """The summed counts of each text's parts."""
        if len(self.young) > MEMORY // 2:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        unmet = set().union(*split).difference(young)
        new = {p: old[p] for p in unmet.intersection(old)}
        ask = list(unmet.difference(old))
        new.update(zip(ask, self._encoded(ask)))
        new.update((p, _UNSAFE) for p in ask if p[-1].isspace() and p[-1] not in " \n\t\r")
        young.update(new)
        out = [sum(map(young.__getitem__, parts)) for parts in split]
        for p in new:
            if len(p) > REMEMBERED_CHARS:
                del young[p]
        return out

    def __call__(self, texts: list[str | None]) -> list[int]:
        out: list[int] = []
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end] or "") <= 4 * self.batch_bytes):
                size += len(texts[end] or "")
                end += 1
            some = [t or "" for t in texts[start:end]]
            if not self.cuttable:
                out += self._encoded(some)
            else:
                counts = self._sums([_PARTS.findall(t) for t in some])
                out += [n if n >= 0 else sum(self._encoded(_EDGE.split(t))) for n, t in zip(counts, some)]
            start = end
        return out


@functools.lru_cache(maxsize=2)
def _counter(path: str, batch_bytes: int) -> Counter:
    """The counter of this worker, kept from task to task."""
    return Counter(path, batch_bytes)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                 batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(id_col, n_bytes, n_tokens) for every row of ``docs``. One narrow pass, no shuffle."""
    path = path or tokenizer_path(TOKENIZER)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = src.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path, batch_bytes)
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array(count(texts), pa.int64())],
                names=["id", "n_bytes", "n_tokens"])

    out = src.mapInArrow(run, f"id {id_type.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", id_col)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > 1024) of every document."""
    counted = count_tokens(table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > OVER_LIMIT)
