"""Operators on texts against the libraries, brute force and SQL."""
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import EDGE_ROWS, SF
from pyspark.sql import functions as F

from volforge.llm import line_dedup, mixing, quality, sentencepiece_fst, simhash, token_counts, toxicity
from volforge.llm.common import table

ODD = ["a", "b", "'s", "é", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\u3000", "\xa0", "\x85", "\u200b", "1", "23", "!", "中", "文",
       "😀", "\x00", "the", "ing", "\x0b", "ß", "ﬁ", "▁", "<|endoftext|>", "<s>", "."]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


def real_texts(spark):
    return [r[0] or "" for r in table(spark, SF, "documents").select("text").collect()]


# -- token counts ------------------------------------------------------------------------------
def test_token_counts_are_the_library_s(spark):
    from tokenizers import Tokenizer
    path = token_counts.tokenizer_path(token_counts.TOKENIZER)
    texts = real_texts(spark) + odd_texts(5000)
    want = [len(e) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.Counter(path)(texts) == want
    assert token_counts.Counter(path, batch_bytes=64)(texts[-500:]) == want[-500:]


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenizers_are_encoded_whole(spark, name):
    from tokenizers import Tokenizer
    path = token_counts.tokenizer_path(name)
    texts = odd_texts(300)
    want = [len(e) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.Counter(path)(texts) == want


def test_token_counts_edge_cases(edge, nothing):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(token_counts.tokenizer_path(token_counts.TOKENIZER))
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(edge).collect())
    assert got == Counter((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False))) for i, t, *_ in EDGE_ROWS)
    assert token_counts.count_tokens(nothing).count() == 0


# -- SentencePiece -----------------------------------------------------------------------------
def test_sentencepiece_ids_and_texts_are_the_library_s(spark):
    import sentencepiece
    path = token_counts.tokenizer_path(sentencepiece_fst.MODEL)
    lib, fst = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_fst.load(path)
    texts = real_texts(spark) + odd_texts(5000)
    ids = lib.encode(texts)
    assert [fst.encode(t) for t in texts] == ids
    assert [fst.decode(i) for i in ids] == [lib.decode(i) for i in ids]
    rng = random.Random(5)
    for _ in range(3000):
        some = [rng.randrange(0, 400) for _ in range(6)]
        assert fst.decode(some) == lib.decode(some)


def test_sentencepiece_remembers_without_changing_results(spark, monkeypatch):
    monkeypatch.setattr(sentencepiece_fst, "CACHE", 50)
    path = token_counts.tokenizer_path(sentencepiece_fst.MODEL)
    with open(path, "rb") as f:
        small = sentencepiece_fst.PieceTransducer(f.read())
    texts = real_texts(spark)[:60]
    assert [small.encode(t) for t in texts] == [sentencepiece_fst.load(path).encode(t) for t in texts]


def test_sentencepiece_edge_cases(edge, nothing):
    docs = edge.drop("ids")
    both = sentencepiece_fst.decode(sentencepiece_fst.encode(docs))
    assert all(r.decoded == (r.text or "") for r in both.collect())
    assert both.count() == len(EDGE_ROWS) and set(docs.columns) < set(both.columns)
    assert sentencepiece_fst.encode(nothing, decoded_col="decoded").count() == 0


def test_unigram_paths_are_cheapest():
    """A small unigram model: the transducer's path has the best total score of all segmentations."""
    def field(n, data):
        out, size = bytes([n << 3 | 2]), len(data)
        while size >= 128:
            out, size = out + bytes([size & 127 | 128]), size >> 7
        return out + bytes([size]) + data
    pieces = [("<unk>", 0.0, 2)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.1, 1), ("ba", -4.2, 1), ("▁a", -3.5, 1), ("aba", -4.0, 1)]
    data = b"".join(field(1, field(1, p.encode()) + b"\x15" + np.float32(s).tobytes() + b"\x18" + bytes([t])) for p, s, t in pieces)
    data += field(2, b"\x18\x01" + bytes([35 << 3 & 127 | 128, 35 >> 4, 1])) + field(3, field(1, b"identity") + b"\x18\x01\x20\x00")
    fst = sentencepiece_fst.PieceTransducer(data)
    score = {p.replace("▁", " "): s for p, s, t in pieces if t == 1}

    def best(t):
        return 0.0 if not t else max((score[t[:k]] + best(t[k:]) for k in range(1, len(t) + 1) if t[:k] in score), default=-1e9)
    for text in ("abab", "a ba", "abba aab", "aba"):
        ids = fst.encode(text)
        assert "".join(fst.pieces[i] for i in ids) == " " + text
        assert abs(sum(fst.scores[i] for i in ids) - best(" " + text)) < 1e-5
    assert fst.decode(fst.encode("aéb")) == "aéb"


# -- SimHash -----------------------------------------------------------------------------------
def naive_fingerprint(text):
    from xxhash import xxh64_intdigest
    import re
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def naive_components(ids, linked):
    """Smallest reachable id by depth-first search over an n x n link test."""
    seen, out = set(), {}
    for a in sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0)):
        if a in seen:
            continue
        stack, group = [a], []
        seen.add(a)
        while stack:
            x = stack.pop()
            group.append(x)
            for y in range(len(ids)):
                if y not in seen and linked(x, y):
                    seen.add(y)
                    stack.append(y)
        known = [ids[k] for k in group if ids[k] is not None]
        out.update({k: min(known, default=None) for k in group})
    return out


def test_simhash_fixture_against_brute_force(edge, nothing):
    prints = [naive_fingerprint(t) for _, t, *_ in EDGE_ROWS]
    comp = naive_components([r[0] for r in EDGE_ROWS], lambda x, y: (prints[x] ^ prints[y]).bit_count() <= 2)
    want = Counter((EDGE_ROWS[k][0], prints[k], comp[k]) for k in range(len(EDGE_ROWS)))
    got = Counter((r.id, r.fp % (1 << 64), r.component_id) for r in simhash.simhash_groups(edge).collect())
    assert got == want
    assert simhash.simhash_groups(nothing).count() == 0


@pytest.mark.parametrize("tile_rows", [1024, 8])
def test_simhash_whole_table_against_brute_force(spark, tile_rows):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    prints = np.array([naive_fingerprint(t) for _, t in docs], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    comp = naive_components([i for i, _ in docs], lambda x, y: near[x, y])
    got = {r.id: (r.fp % (1 << 64), r.component_id) for r in simhash.simhash_groups(table(spark, SF, "documents"), tile_rows=tile_rows).collect()}
    assert got == {docs[k][0]: (int(prints[k]), comp[k]) for k in range(len(docs))}


def test_simhash_links_dense_clusters_and_any_bits(spark):
    """Chains, dense balls around one print, and every pair of bit positions; small tiles deal them out."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [np.uint64(1) << np.uint64(i) for i in range(64)]
    prints = {int(b) for b in base} | {int(base[0] ^ f) for f in flips} | {int(base[1] ^ flips[i] ^ flips[(i * 7 + 3) % 64]) for i in range(64)}
    chain = base[2]
    for i in range(0, 60, 2):
        chain = chain ^ flips[i] ^ flips[i + 1]
        prints.add(int(chain))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = naive_components(signed, lambda x, y: (prints[x] ^ prints[y]).bit_count() <= 2)
    from volforge.llm.graph import components
    for tile_rows in (1024, 5):
        roots = {r.node: r.root for r in components(simhash.links(df, 2, tile_rows)).collect()}
        assert {p: roots.get(p, p) for p in signed} == {signed[k]: v for k, v in want.items()}


def test_keep_one_per_group(edge):
    kept = simhash.keep_one_per_group(edge)
    assert kept.columns == edge.columns
    groups = defaultdict(set)
    for r in simhash.simhash_groups(edge).collect():
        groups[r.root].add(r.id)
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(groups)
    assert Counter(ids) == Counter(min((i for i in g if i is not None), default=None) for g in groups.values())


# -- line dedup --------------------------------------------------------------------------------
def naive_line_dedup(rows):
    import re
    lower = lambda s: re.sub("[A-Z]", lambda m: m.group().lower(), s)
    key = lambda line: lower(line.strip(" \t\n\x0b\f\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    shared = {k: max(v, key=lambda i: -1 if i is None else i) for k, v in holders.items() if len(v) >= 5}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in shared or shared[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_line_dedup_edge_cases(edge, nothing):
    out = line_dedup.dedup_lines(edge, out_col="made")
    assert out.columns == [*edge.columns, "made"]
    got = Counter((r.doc_id, r.made.n_lines, r.made.n_dropped, hashlib.sha256(r.made.text.encode()).hexdigest()) for r in out.collect())
    assert got == naive_line_dedup([(i, t) for i, t, *_ in EDGE_ROWS])
    assert sum(n for (_, _, dropped, _), n in got.items() if dropped) > 3
    assert line_dedup.dedup_lines(nothing).count() == 0


# -- mixing ------------------------------------------------------------------------------------
def naive_copies(rows, alpha, budget):
    """Copies per row by whole permutations of each source, in plain Python."""
    size = lambda t: -(-len((t or "").encode()) // 4)
    total = Counter()
    for i, s, t in rows:
        total[s] += size(t)
    z = sum((n / sum(total.values())) ** alpha for n in total.values() if n)
    out = Counter()
    for s, n in total.items():
        quota = int(np.floor((n / sum(total.values())) ** alpha / z * budget + 1e-6)) if n else 0
        full, rest = (quota // n, quota % n) if n else (1, -1)
        mine = sorted((hashlib.md5(f"11:0:{'null' if i is None else i}".encode()).hexdigest(), size(t), i) for i, x, t in rows if x == s)
        keys = sorted({k for k, _, _ in mine})
        upto, last = 0, ""
        for k in keys:
            upto += sum(m for kk, m, _ in mine if kk == k)
            if upto > rest:
                break
            last = k
        for k, _, i in mine:
            out[(i, s, full + (k <= last))] += 1
    return out


@pytest.mark.parametrize("budget", [None, 100_000, 1000])
def test_mixing_against_plain_python(edge, budget):
    rows = [(r[0], r[3], r[1]) for r in EDGE_ROWS]
    docs = edge.drop("copies")
    spend = budget or sum(-(-len((t or "").encode()) // 4) for _, _, t in rows)
    sizes = mixing.mixing_plan(docs, target_entropy=0.8, budget=budget)
    shares = sizes.where("tokens > 0").withColumn("p", F.col("tokens") / F.sum("tokens").over(__import__("pyspark").sql.Window.partitionBy()))
    alpha = mixing.bisect_exponent(shares.select("tokens", "p"), "entropy", 0.8 * np.log(shares.count()))
    mixed = mixing.mix(docs, target_entropy=0.8, budget=budget)
    assert mixed.columns == [*docs.columns, "copies"]
    got = Counter((r.doc_id, r.source, r.copies) for r in mixed.collect())
    assert got == naive_copies(rows, alpha, spend)
    p = np.array([r.p for r in shares.collect()])
    w = p ** alpha / (p ** alpha).sum()
    assert -(w * np.log(w)).sum() >= 0.8 * np.log(len(p)) - 1e-4


def test_mixing_limits_repeats_and_covers(spark, nothing):
    docs = table(spark, SF, "documents").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    mixed = mixing.mix(docs, max_repeats=1.5, cover=True)
    plan = mixing.mixing_plan(docs, max_repeats=1.5, cover=True).collect()
    reps = {r.source: r.quota / r.tokens for r in plan}
    assert reps["hot"] == 1.0 and 1.45 < max(reps.values()) <= 1.5 + 1e-3
    rows = mixed.select("source", "copies", mixing.estimated_tokens(F.col("text")).alias("n")).collect()
    assert min(r.copies for r in rows) == 1 and max(r.copies for r in rows) == 2
    for r in plan:
        taken = sum(x.copies * x.n for x in rows if x.source == r.source)
        assert r.quota - max(x.n for x in rows if x.source == r.source) < taken <= r.quota
    made = mixing.realise(mixed, order_col="place", block_col="block")
    assert made.count() == sum(r.copies for r in rows)
    assert made.select("block", "place").distinct().count() == made.count()
    assert mixing.mix(nothing, max_repeats=2.0, cover=True).count() == 0
    assert mixing.mix(nothing, target_entropy=0.9).count() == 0


def test_mixing_salted_join_agrees_with_broadcast(edge, monkeypatch):
    docs = edge.drop("copies")
    plain = Counter(map(tuple, mixing.mix(docs, target_entropy=0.9).collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert Counter(map(tuple, mixing.mix(docs, target_entropy=0.9).collect())) == plain


def test_mixing_runs_no_python(spark):
    plan = mixing.op8_mixing(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# -- toxicity and quality ----------------------------------------------------------------------
def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    scored = toxicity.op10_toxicity(spark, sf)
    assert scored.count() == table(spark, sf, "documents").count()
    rows = scored.join(table(spark, sf, "labels"), "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    bad, good = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in bad) >= 0.92 * len(bad) > 20
    assert sum(r.predicted for r in good) <= 0.015 * len(good)
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_sees_through_gaps_and_insertions(spark):
    model = toxicity.fit(table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels"))
    worst = lambda t: float(model.probability(toxicity.Scorer(model).features([t]))[0])
    plain = worst("the reed of stupid thandst ones")
    assert plain > 2 * toxicity.THRESHOLD
    for hidden in ("s-t-u-p-i-d", "stu.pid", "s t u p i d", "stuupid", "STUPID!!", "(stupid)"):
        assert worst(f"the reed of {hidden} thandst ones") > 0.3, hidden
    assert worst("the reed of ones thandst on") < 0.1 and worst("") < 0.1 and worst(None) < 0.1


def test_toxicity_edge_cases(spark, edge, nothing):
    labels = table(spark, SF, "labels")
    none = labels.limit(0)
    assert toxicity.fit(edge, none).constant == 0.0
    assert toxicity.reject_toxic(edge, none).count() == len(EDGE_ROWS)
    one_class = labels.where("toxic = 1").limit(3)
    assert toxicity.fit(table(spark, SF, "documents"), one_class).constant in (0.0, 1.0)
    assert toxicity.fit(nothing, labels).constant == 0.0
    model = toxicity.fit(table(spark, SF, "documents"), labels)
    kept = edge.where(toxicity.score(F.col("text"), model) < 0.3)
    assert kept.columns == edge.columns and kept.count() == len(EDGE_ROWS)


def test_kernel_is_symmetric_positive_and_normalised():
    words = ["^stupid$", "^stupiid$", "^trash$", "^the$", "^abc$", "^aaaa$"]
    k = toxicity.kernel(words, words)
    assert np.allclose(np.diag(k), 1, atol=1e-5) and np.allclose(k, k.T, atol=1e-5)
    assert np.linalg.eigvalsh(k.astype(float)).min() > -1e-5
    assert k[0, 1] > 0.6 > 0.2 > k[0, 2]


def test_quality_against_hand_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality.op9_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").select("quality", "keep").collect()
    bad, good = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1]
    assert sum(not r.keep for r in bad) >= 0.9 * len(bad) and sum(r.keep for r in good) >= 0.99 * len(good)


def test_quality_edge_cases(edge, nothing):
    rows = quality.score(edge, quality.fit(edge)).collect()
    assert len(rows) == len(EDGE_ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(nothing, quality.fit(nothing)).count() == 0


def test_em_recovers_labellers():
    rng = np.random.default_rng(2)
    n, k = 20000, 6
    good = rng.random(n) < 0.8
    rates = rng.uniform(0.1, 0.3, k)
    votes = np.where(good[:, None], np.where(rng.random((n, k)) < 0.01, 0, 2), np.where(rng.random((n, k)) < rates + 0.3, 0, 2))
    pattern = (votes * 3 ** np.arange(k)[::-1]).sum(axis=1)
    at, count = np.unique(pattern, return_counts=True)
    share, found, post = quality.estimate(at, count, k)
    assert abs(share - 0.8) < 0.03
    assert np.abs(found[:, 0, 0] - rates - 0.3).max() < 0.06
    assert ((post[np.searchsorted(at, pattern)] >= 0.5) == good).mean() > 0.95
