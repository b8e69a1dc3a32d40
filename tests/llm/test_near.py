"""The near_duplicates stage against brute force over five-word shingles."""

import random

import corpus_pipeline
import numpy as np
from freshet.llm import shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def jaccard(a, b):
    sets = []
    for text in (a, b):
        w = text.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def brute(texts):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard(texts[i], texts[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_near_copies_of_five_words_are_joined(spark):
    rng = random.Random(1)
    texts = []
    for n in (20, 60, 300):
        for _ in range(6):
            base = words(rng, n)
            texts.append(" ".join(base))
            for changes in (0.01, 0.02, 0.03, 0.05):  # similarities about 0.8
                for _ in range(3):
                    texts.append(" ".join("x%d" % rng.randrange(10**6) if rng.random() < changes else w for w in base))
    chain = words(rng, 200)  # neighbours are alike, the ends aren't
    for k in range(12):
        texts.append(" ".join(chain[k * 15 :] + [f"t{i}" for i in range(k * 15)]))
    texts += ["", "a b", "A  b", "c d e f g"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    want = sorted(set(brute(texts)))
    for block_rows in (1024, 3):
        assert sorted(r.doc_id for r in shingles.one_of_each(df, block_rows=block_rows).collect()) == want


def test_near_duplicates_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert 255 not in kept and 944 not in kept and 875 not in kept and 770 not in kept  # 7 to 9 bits from their copies
    assert {452, 4} <= kept and len(kept) == 922


def test_rows_without_an_id_of_their_own_are_kept(spark):
    rng = random.Random(2)
    a, b, c, d = (" ".join(words(rng, 60)) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (7, a), (7, c), (8, d), (8, d), (9, c)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()), key=str)
    assert got == sorted([(7, a), (None, b), (7, c), (8, d)], key=str)
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), "").count() == 0


def near_copies(rng):
    texts = []
    for n in (12, 40, 200):
        for _ in range(8):
            base = words(rng, n)
            texts += [" ".join("x%d" % rng.randrange(10**6) if rng.random() < changes else w for w in base) for changes in (0, 0, 0.01, 0.02, 0.03, 0.1)]
    return texts


def test_pairs_meet_by_fingerprints_in_the_leaves_of_trees(spark):
    texts = near_copies(random.Random(5))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    segments, width, depth = shingles.layout(len(texts), 8)
    assert depth > 2 and segments > 10
    marked = shingles.shingle_sets(df, "doc_id", "text", 5, max(4, -(-segments * width // 64))).cache()
    fp = {r.key: r.fp for r in marked.collect()}
    distinct = marked.groupBy("fp").agg({"sig": "first"}).toDF("fp", "sig")
    buckets = {}
    for leaf_rows in (8192, 5):  # also by blocks of leaves
        for r in shingles.near_sets(distinct, segments, width, depth, leaf_rows).collect():
            buckets.setdefault(r.fp, set()).add((leaf_rows, r.band))
            assert r.least <= r.fp
        alike = [(fp[i], fp[j]) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
        assert alike and all(u == v or any(n == leaf_rows for n, _ in buckets[u] & buckets[v]) for u, v in alike)
    kept = sorted(r.doc_id for r in shingles.one_of_each(df, leaf_rows=5, aim=8).collect())
    assert kept == sorted(set(brute(texts)))


def test_fingerprints_are_majorities_and_near_ones_are_joined():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 300, 1001):
        hashes = np.unique(rng.integers(0, 2**64, size=n, dtype=np.uint64))
        mixed = [shingles.signature(h[None], 4).tolist() for h in hashes]
        want = [sum((2 * sum(m[w] >> b & 1 for m in mixed) > len(mixed)) << b for b in range(64)) for w in range(4)]
        assert shingles.signature(hashes, 4).tolist() == want
    base = rng.integers(0, 2**64, size=(12, 4), dtype=np.uint64)
    flips = np.packbits(rng.random((120, 256)) < rng.choice([0.02, 0.15, 0.3], size=(120, 1)), axis=1).view("<u8")
    rows = base[rng.integers(0, 12, size=120)] ^ flips
    first, other = np.arange(0, 70), np.arange(40, 120)
    root = list(range(120))
    for i in first.tolist():
        for j in other.tolist():
            bits = [int(x).bit_count() for x in rows[i] ^ rows[j]]
            if sum(bits[:2]) <= shingles.FIRST_BITS and sum(bits) <= shingles.BITS and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    for step in (1, 1 << 20):
        assert shingles.joined_near(rows, first, other, step).tolist() == root


def test_small_sets_at_the_similarity_meet():
    rng = np.random.default_rng(5)
    segments, width, _ = shingles.layout(15_000_000, 512)
    words = -(-segments * width // 64)
    for _ in range(6000):
        shared = int(rng.integers(8, 60))
        own = int(rng.integers(0, shared // 4 + 1))
        x = rng.integers(0, 2**64, size=shared + shared // 4, dtype=np.uint64)
        x[shared:] >>= np.uint64(12)  # the least hashes are not the shared ones
        a, b = np.unique(x[: shared + own]), np.unique(np.r_[x[:shared], x[shared + own :]])
        assert shingles.alike(a, b)
        apart = shingles.signature(a, words) ^ shingles.signature(b, words)
        bits = np.unpackbits(apart.view(np.uint8), count=segments * width, bitorder="little").reshape(segments, width).sum(axis=1)
        assert bits.min() <= 1 and np.bitwise_count(apart[:2]).sum() <= shingles.FIRST_BITS and np.bitwise_count(apart[:4]).sum() <= shingles.BITS
