"""op11 hard negatives, op12 fingerprints and op13 phrases against brute force, and their edge cases."""
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volforge.llm import collocations, fingerprints, hard_negatives

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = ("g", "lang2", "shard", "n", "a", "l", "r", "score", "row", "part", "block", "id", "v", "vec", "ask", "own", "to", "ahead",
            "fingerprint", "windows", "anchor", "known", "gid", "word", "at", "Dim")


# ---------------------------------------------------------------- phrases

def phrases_by_hand(rows, least, longest=4, pct=80):
    counts, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(ASCII_LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i:i + k])] += 1
    out = {}
    held = Counter()
    for (lang, w), a in counts.items():
        if len(w) > 1 and a >= least:
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    held[lang, w[i:i + k]] = max(held[lang, w[i:i + k]], a)
    for (lang, w), a in counts.items():
        if len(w) > 1 and a >= least:
            score, cut, l, r = min((2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]])
                                   for k in range(1, len(w)))
            out[lang, " ".join(w)] = (a, cut, l, r, n[lang], score, 100 * held[lang, w] >= pct * a)
    return out


def phrase_rows(df):
    return {(r.lang, r.phrase): (r.a, r.cut, r.l, r.r, r.n, r.score, r.subsumed) for r in df.collect()}


@pytest.fixture(scope="module")
def talk(spark):
    rng = np.random.default_rng(3)
    words = ["of", "the", "House", "a", "é", "x1", "\x00", "tea-time", "zz z", "of"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  ", "\x0b"]) for _ in range(int(rng.integers(0, 120)))),
             [None, "en", "de"][int(rng.integers(3))]) for _ in range(60)]
    rows += [("One two THREE four five. " * 9, "en")] * 3 + [(None, "en"), ("", None), ("...", "fr"), ("lone", "fr")]
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])
    return rows, spark.createDataFrame(rows, schema).repartition(3).select("*", *(F.lit(1).alias(c) for c in CLASHING))


@pytest.mark.parametrize("shard_words, filter_bytes, least", [(40, 4096, 4), (1 << 19, 1 << 20, 9)])
def test_phrases_equal_brute_force(talk, shard_words, filter_bytes, least):
    rows, df = talk
    got = collocations.collocations(df, min_count=least, shard_words=shard_words, filter_bytes=filter_bytes)
    want = phrases_by_hand(rows, least)
    assert len(want) > 50 and any(v[-1] for v in want.values())
    assert phrase_rows(got) == want


def test_full_filter_costs_no_phrase(talk, monkeypatch):
    rows, df = talk
    monkeypatch.setattr(collocations, "phrase_filter", lambda frequent, words, limit=0: b"\xff" * 4096)
    assert phrase_rows(collocations.collocations(df, min_count=6)) == phrases_by_hand(rows, 6)


def test_top_phrases_order_and_ties(talk):
    rows, df = talk
    got = collocations.top_phrases(collocations.collocations(df, min_count=5), 7)
    want, by_hand = [], phrases_by_hand(rows, 5)
    for lang in {k[0] for k in by_hand}:
        kept = sorted((-v[5], -v[0], k[1].encode()) for k, v in by_hand.items() if k[0] == lang and not v[6])[:7]
        want += [(lang, i + 1, p.decode()) for i, (_, _, p) in enumerate(kept)]
    assert sorted((r.lang, r["rank"], r.phrase) for r in got.collect()) == sorted(want)


def test_extensions_of_a_phrase(spark):
    df = spark.createDataFrame([("a b c. " * 5 + "x b c. " * 3 + "b c d. " * 4, "en")], ["text", "lang"])
    r = collocations.collocations(df, min_count=3).where("phrase = 'b c'").first()
    assert (r.a, r.extended_left, r.extended_right, r.subsumed) == (12, 5, 4, False)


def test_no_phrases(spark, nothing):
    assert collocations.top_phrases(collocations.collocations(nothing)).collect() == []
    short = spark.createDataFrame([("one two three", "en")], ["text", "lang"])
    assert collocations.collocations(short).collect() == []


def test_order_of_a_shard_too_wide_for_packed_keys():
    """The general path of the suffix order and of the extension agrees with the packed one."""
    ids = np.concatenate([[0], np.random.default_rng(0).integers(0, 6, 400)]).astype(np.int32)
    plain = collocations.ShardIndex(ids, 4)
    wide = collocations.ShardIndex(np.where(ids > 0, ids + (1 << 21), 0), 4)
    some = lambda index, off: sorted((tuple((w - off).tolist()), int(n)) for p in [collocations.shard_phrases(index, 3, lambda w: np.ones(len(w), bool))]
                                     for w, n in zip(p.words, p.size))
    assert some(plain, 0) == some(wide, 1 << 21)


# ---------------------------------------------------------------- hard negatives

def negatives_by_hand(rows, every=100):
    v = [(n, i, lab, [int(np.floor(256 * float(c))) for c in x]) for n, (i, lab, x) in enumerate(rows)
         if i is not None and lab is not None and x and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for n, i, lab, x in v:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j, m, other) for m, j, other, y in v if m != n and len(x) == len(y))
        for s, j, _, _ in [r for r in scored if r[3] == lab][:5]:
            near = [r for r in scored if r[3] != lab and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(i, j, k + 1, r[1], -s, -r[0]) for k, r in enumerate(near)]
    return sorted(out)


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", T.IntegerType()),
                        T.StructField("embedding", T.ArrayType(T.FloatType()))])
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(4, 8))
    rows = [(n, int(n % 4), [float(np.float32(c)) for c in centre[n % 2] + rng.normal(size=8) * .4]) for n in range(420)]
    rows += [rows[100], rows[100], rows[100], (200, 1, rows[3][2]), (200, 2, rows[4][2]), (None, 1, rows[5][2]), (900, None, rows[5][2]),
             (901, 1, None), (902, 1, []), (1000, 1, [float("nan")] * 8), (1100, 1, [None] * 8), (1200, 7, [1.0] * 8), (1300, 1, [2.0, 1.0]), (5, 2, [2.0, 1.0])]
    rows += [(2000 + n, 3, rows[0][2]) for n in range(60)]
    return rows, spark.createDataFrame(rows, VECTORS).repartition(4)


@pytest.mark.parametrize("shard_rows", [16, 4096])
def test_negatives_equal_brute_force(vectors, shard_rows):
    rows, df = vectors
    df = df.select("*", *(F.lit(1).alias(c) for c in CLASHING))
    got = hard_negatives.mine_hard_negatives(df, lambda i: i % 100 == 0, shard_rows=shard_rows)
    want = negatives_by_hand(rows)
    assert len(want) > 100
    assert sorted(tuple(r) for r in got.select(*COLUMNS).collect()) == want


def test_negatives_of_an_empty_table(spark):
    assert hard_negatives.mine_hard_negatives(spark.createDataFrame([], VECTORS), lambda i: i % 100 == 0).collect() == []


def test_residue_products_are_exact():
    rng = np.random.default_rng(1)
    for dim, size in ((1, 10), (7, 30_000), (64, 1 << 20), (700, 1 << 22), (3, 1 << 29)):
        x, y = (rng.integers(-size, size + 1, (5, dim)).astype(np.float64) for _ in range(2))
        x[0], y[0] = size, -size
        bound = int(np.sqrt((x * x).sum(1).max()) * np.sqrt((y * y).sum(1).max())) + 1
        primes, width = hard_negatives.primes_for(bound, dim)
        assert all(width * ((p - 1) // 2) ** 2 < 2 ** 24 for p in primes)
        want = [[sum(int(a) * int(b) for a, b in zip(q, r)) for r in x] for q in y]
        assert hard_negatives.ResidueMatrix(x, primes, width).scores(y).tolist() == want


def test_scores_beyond_62_bits_are_refused(spark):
    df = spark.createDataFrame([(0, 1, [3e8] * 8), (1, 1, [3e8] * 8)], VECTORS)
    with pytest.raises(OverflowError):
        hard_negatives.mine_hard_negatives(df, lambda i: i % 100 == 0)


# ---------------------------------------------------------------- fingerprints

def popular_by_hand(texts, rank):
    out, base = [], 0
    for t in texts:
        m = max(0, len(t) - fingerprints.WINDOW + 1)
        classes = []
        for i in range(m):
            c = Counter(t[i:i + fingerprints.WINDOW])
            classes.append(int(fingerprints._CLASS_OF_SUM[sum(int(fingerprints._PARTS[v]) for v in c.values())]))
        points = Counter(min(range(s, min(m, s + fingerprints.NEIGHBOURS)), key=lambda i: (rank[classes[i]], i)) for s in range(m))
        out += [base + i for i in range(m) if points[i] >= min(fingerprints.POPULAR, max(1, m // 4))]
        base += len(t)
    return out


@pytest.mark.parametrize("stretch", [40, 1 << 16])
def test_popular_windows_equal_brute_force(monkeypatch, stretch):
    monkeypatch.setattr(fingerprints, "STRETCH", stretch)
    rng = np.random.default_rng(2)
    rank = rng.permutation(fingerprints.CLASSES)
    texts = [rng.integers(97, 109, n).astype(np.uint8).tobytes() for n in (0, 5, 31, 32, 33, 40, 64, 300, 900, 0, 77, 0)] + [b"y" * 200]
    assert fingerprints.popular_windows(*fingerprints._joined(texts), rank).tolist() == popular_by_hand(texts, rank)
    assert fingerprints.count_classes(texts).sum() == sum(max(0, len(t) - fingerprints.WINDOW + 1) for t in texts)


def test_against_next_by_hand(spark, edge):
    rows = [(r.doc_id, r.text or "") for r in edge.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    rank = fingerprints.window_rarity(edge)
    made = [fingerprints.digests([t.encode()], rank)[0] for _, t in rows]
    want = []
    for n, (i, t) in enumerate(rows):
        new = fingerprints.edited(t, rows[(n + 1) % len(rows)][1])
        half = fingerprints.digests([new.encode()], rank)[0]
        want.append((i, len(t), new, str(made[n]), str(half), fingerprints.likeness(made[n], half), fingerprints.likeness(made[n], made[(n + 1) % len(rows)])))
    got = [tuple(r) for r in fingerprints.against_next(edge.select("*", F.lit(1).alias("part"))).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:3])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert all(a == 1.0 for t, a in ((r[2], r[5]) for r in got) if t == "")


def test_many_ranges_and_groups_give_the_same(spark, edge, monkeypatch):
    want = sorted(map(str, fingerprints.against_next(edge).collect()))
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 2)
    monkeypatch.setattr(fingerprints, "GROUP_BYTES", 100)
    assert sorted(map(str, fingerprints.against_next(edge).collect())) == want


def test_one_document_and_none(spark, nothing):
    one = spark.createDataFrame([(4, "the only text")], ["doc_id", "text"])
    r = fingerprints.against_next(one).first()
    assert r.edited == "the only" [:7] + "the on" and r.near_next == 1.0
    assert fingerprints.against_next(nothing).collect() == [] and fingerprints.fingerprints(nothing).collect() == []


def test_likeness_follows_the_common_share(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 9)))) for _ in range(4000)]
    word = lambda n: " ".join(rng.choice(vocabulary, n))
    a, b = word(3000), word(3000)
    rank = rng.permutation(fingerprints.CLASSES)
    near = lambda x, y: fingerprints.likeness(*fingerprints.digests([x.encode(), y.encode()], rank))
    assert near(a, a) == 1.0 and near(a, b) < 0.05 and near(a, b) == near(b, a)
    assert 0.35 < near(a, a[:len(a) // 2] + b[:len(a) // 2]) < 0.65
    assert near(a, "a new beginning " + a) > 0.5 and near(a, a[:-10]) > 0.9
    made = fingerprints.digests([a.encode()], rank)[0]
    again = fingerprints.Digest.parse(str(made))
    assert np.array_equal(made.filters, again.filters) and np.array_equal(made.features, again.features)


def test_query_columns(spark):
    from conftest import SF
    got = fingerprints.op12_fingerprints(spark, SF).toPandas().sort_values("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    texts = docs.text.tolist()
    edits = [fingerprints.edited(t, n) for t, n in zip(texts, texts[1:] + texts[:1])]
    assert got.doc_id.tolist() == docs.doc_id.tolist()
    assert got.edited_sha256.tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in edits]
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    long = got[got.n_chars >= 200]
    assert long.near_edited.quantile(.05) > 0.2 and long.near_next.quantile(.95) < 0.1
