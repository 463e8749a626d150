"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled into three transducers, built once per worker and composed lazily with
each input: the normaliser (dummy prefix, white-space rules, escape mark), the pieces (an arc for
every piece, reading its characters and writing its id), and the byte fallback (for a character that
no piece holds, an arc that writes its UTF-8 bytes). The encoding is the shortest path in the
tropical semiring (costs add along a path, the least cost wins).

For a unigram model a piece's arc costs minus its score. For a BPE model the scores only order
merges, and the cheapest sum of scores is not the BPE encoding, so piece arcs are gated instead: an
arc may follow another at cost 0 if merging the two pieces' characters by priority gives back just
these two pieces, and at infinite cost otherwise. Byte-pair encodings are characterised by this
condition on neighbours: were a merge to cross a boundary in the whole input, the first one to do so
would cross it in the two pieces alone. So exactly one path has finite cost, and every position of
the input keeps one live state. Gates are decided when an input first needs them and remembered.

An input is cut where no piece can cross (between two characters that are adjacent in no piece, in
particular before a space that follows a word), which changes no path; the parts are remembered, so
a frequent word costs a look-up. Long texts need no more memory than their ids.

Defined results: null and empty texts have no ids and decode to the empty text; ids out of range are
an error; bytes that are not UTF-8 decode to U+FFFD; repeated rows and null ids are kept; an empty
table gives an empty result."""
from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .token_counts import tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE, CACHED_CHARS = 400_000, 48      # remembered parts of a worker
OUT_ROWS = 256
_INF = float("inf")
_APART = b"\xff"            # no UTF-8: ids that stand for no text of their own take the careful way


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; fixed-width values as bytes."""
    at, n = 0, len(data)

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind in (1, 2, 5):
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at:at + size]
            at += size
        else:
            raise ValueError("not a SentencePiece model file")


class PieceTransducer:
    """The compiled model: ``encode`` a text to ids, ``decode`` ids to a text."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, fallback, suffix = UNIGRAM, 0, 0
        self.prefix, self.collapse, self.escape = True, True, True
        for number, value in _fields(data):
            if number == 1:
                one = dict(_fields(value))
                self.pieces.append(one.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
                self.types.append(one.get(3, NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                self.kind, fallback, suffix = spec.get(3, UNIGRAM), spec.get(35, 0), spec.get(24, 0)
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("this normaliser has a character map; only white-space normalisers are compiled")
                self.prefix, self.collapse, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if self.kind not in (UNIGRAM, BPE) or suffix or not fallback or not self.escape or USER_DEFINED in self.types:
            raise ValueError("only unigram and BPE models with byte fallback and escaped white space are compiled")
        # inside, the escape mark is a plain space: one-byte strings take half the memory
        self.pieces = [p.replace(MARK, " ") for p in self.pieces]
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        if len(self.byte_ids) != 256:
            raise ValueError("byte fallback needs all 256 bytes")
        self.longest = max(map(len, self.ids), default=1)
        self.adjacent = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        # parts: a run of spaces with the word after it, if no piece crosses from a word to a space
        free = not any(a[1] == " " and a[0] != " " for a in self.adjacent)
        lines = not any("\n" in a for a in self.adjacent)
        word = r"[^ \n]" if lines else "[^ ]"
        self.part = re.compile(f" *{word}+| +|\n+" if free else r"(?s).+")
        raw = []
        for p, t in zip(self.pieces, self.types):
            raw.append(bytes([int(p[3:5], 16)]) if t == BYTE else _APART if t in (CONTROL, UNKNOWN)
                       else p.encode())
        self.raw = raw
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.gates: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}

    # -- normaliser ---------------------------------------------------------------------------
    def normalise(self, text: str) -> str:
        if self.collapse:
            text = re.sub(" +", " ", text.strip(" "))
        return (" " if self.prefix and text else "") + text.replace(MARK, " ")

    # -- gates of a BPE model -------------------------------------------------------------------
    def _merged(self, text: str) -> list[str]:
        """Characters of ``text`` merged by priority: best score first, of equal ones the leftmost."""
        parts = list(text)
        ids, scores = self.ids, self.scores
        while len(parts) > 1:
            best, at = -_INF, -1
            for i in range(len(parts) - 1):
                t = ids.get(parts[i] + parts[i + 1])
                if t is not None and scores[t] > best:
                    best, at = scores[t], i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stands(self, t: int) -> bool:
        ok = self.alone.get(t)
        if ok is None:
            ok = self.alone[t] = len(self._merged(self.pieces[t])) == 1
        return ok

    def _follows(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a at a finite cost."""
        left, right = self.pieces[a], self.pieces[b]
        if left[-1] + right[0] not in self.adjacent:
            return self._stands(b)
        return self._merged(left + right) == [left, right]

    # -- shortest paths -------------------------------------------------------------------------
    def _bpe_path(self, text: str) -> list[int]:
        """The one path of finite cost: at each position the piece that ends its prefix's path."""
        n, ids, gates, longest = len(text), self.ids, self.gates, self.longest
        last = [-1] * (n + 1)
        size = len(self.pieces)
        for end in range(1, n + 1):
            for start in range(end - 1, max(0, end - longest) - 1, -1):
                t = ids.get(text[start:end])
                if t is None:
                    continue
                if not start:
                    if self._stands(t):
                        last[end] = t
                        break
                    continue
                a = last[start]
                if a < 0:
                    continue
                gate = a * size + t
                ok = gates.get(gate)
                if ok is None:
                    ok = gates[gate] = self._follows(a, t)
                if ok:
                    last[end] = t
                    break
        out, end = [], n
        while end:
            t = last[end]
            if t < 0:
                raise ValueError("no path: the model's single characters are incomplete")
            out.append(t)
            end -= len(self.pieces[t])
        return out[::-1]

    def _unigram_path(self, text: str) -> list[int]:
        n, ids, scores = len(text), self.ids, self.scores
        floor = min(s for s, t in zip(scores, self.types) if t == NORMAL) - 10.0
        cost, back = [0.0] + [_INF] * n, [None] * (n + 1)
        for start in range(n):
            for end in range(start + 1, min(n, start + self.longest) + 1):
                t = ids.get(text[start:end])
                if t is not None and cost[start] - scores[t] < cost[end]:
                    cost[end], back[end] = cost[start] - scores[t], (start, [t])
            if cost[start] - floor < cost[start + 1]:
                cost[start + 1], back[start + 1] = cost[start] - floor, (start, self._bytes(text[start]))
        out, end = [], n
        while end:
            start, arc = back[end]
            out.append(arc)
            end = start
        return [t for arc in reversed(out) for t in arc]

    def _bytes(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    def _part(self, text: str) -> bytes:
        """Ids (little-endian int32) of a part, cut further where no piece crosses."""
        cuts = [i for i in range(1, len(text)) if text[i - 1:i + 1] not in self.adjacent]
        if cuts:
            return b"".join(map(self._remembered, map(text.__getitem__, map(slice, [0, *cuts], [*cuts, len(text)]))))
        if len(text) == 1 and text not in self.ids:
            path = self._bytes(text)
        else:
            path = self._bpe_path(text) if self.kind == BPE else self._unigram_path(text)
        return struct.pack(f"<{len(path)}i", *path)

    def _remembered(self, text: str) -> bytes:
        """The ids of a part from the younger or the older half of the memory, or computed."""
        got = self.known.get(text)
        if got is None:
            got = self.older.get(text) or self._part(text)
            if len(text) <= CACHED_CHARS:
                if len(self.known) >= CACHE // 2:
                    self.older, self.known = self.known, {}
                self.known[text] = got
        return got

    def encode_bytes(self, text: str) -> bytes:
        get, other = self.known.get, self._remembered
        return b"".join([get(p) or other(p) for p in self.part.findall(self.normalise(text))])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        if ids and min(ids) < 0:
            raise IndexError("a piece id is negative")
        out = b"".join(map(self.raw.__getitem__, ids))
        try:
            text = out.decode()
        except UnicodeDecodeError:
            text = self._decode_runs(ids)
        first = next((i for i in ids if self.types[i] != CONTROL), None)
        return text[1:] if self.prefix and first is not None and self.pieces[first].startswith(" ") and self.types[first] == NORMAL else text

    def _decode_runs(self, ids: list[int]) -> str:
        """Runs of byte pieces on their own, with U+FFFD for every byte that is not UTF-8 there."""
        text, run = [], b""
        for i in [*ids, None]:
            if i is not None and self.types[i] == BYTE:
                run += self.raw[i]
                continue
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        text.append(run[at:at + size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    text.append("�")
                    size = 1
                at += size
            run = b""
            if i is not None and self.types[i] != CONTROL:
                text.append(" ⁇ " if self.types[i] == UNKNOWN else self.raw[i].decode())
        return "".join(text)


@functools.lru_cache(maxsize=2)
def load(path: str) -> PieceTransducer:
    """The compiled model of this worker."""
    with open(path, "rb") as f:
        return PieceTransducer(f.read())


def _passing(df: DataFrame, out: str, kind: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` {kind}"])


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None,
           decoded_col: str | None = None) -> DataFrame:
    """``docs`` with ``ids_col``, the piece ids of each whole text, and if asked for with
    ``decoded_col``, the text that these ids decode to; columns of these names are replaced (the text
    column's own name is refused). One narrow pass, in small output batches."""
    path = path or tokenizer_path(MODEL)
    made_cols = [ids_col] + ([decoded_col] if decoded_col else [])
    if text_col.lower() in {c.lower() for c in made_cols}:
        raise ValueError(f"{text_col} is the text's own column; name the result otherwise")
    docs = docs.drop(*made_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = load(path)
        for b in (x.slice(s, OUT_ROWS) for x in batches for s in range(0, x.num_rows, OUT_ROWS)):
            ids = [fst.encode_bytes(t) if t else b"" for t in b.column(text_col).to_pylist()]
            ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            made = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
            names = [ids_col]
            if decoded_col:
                made.append(pa.array([fst.decode(np.frombuffer(i, "<i4").tolist()) for i in ids], pa.string()))
                names.append(decoded_col)
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *names])
        pa.default_memory_pool().release_unused()

    kind = "array<int>" + (f", `{decoded_col}` string" if decoded_col else "")
    return docs.mapInArrow(run, _passing(docs, ids_col, kind))


def decode(coded: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """``coded`` with ``out_col``: the text of each row's ids (null ids: the empty text); a column of that
    name is replaced (the ids column's own name is refused)."""
    path = path or tokenizer_path(MODEL)
    if out_col.lower() == ids_col.lower():
        raise ValueError(f"{ids_col} is the ids' own column; name the result otherwise")
    coded = coded.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = load(path)
        for b in (x.slice(s, OUT_ROWS) for x in batches for s in range(0, x.num_rows, OUT_ROWS)):
            texts = pa.array([fst.decode(i) if i else "" for i in b.column(ids_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*b.schema.names, out_col])

    return coded.mapInArrow(run, _passing(coded, out_col, "string"))


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_hash (xxhash64 of the ids), decoded_sha256, round_trip of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = encode(docs, decoded_col="decoded")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("round_trip"))
