"""The genetic packing against best fit and against the least number of bins."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from freshet.llm import packing


def whole(p, lengths, most):
    assert sorted(x for b in p.bins for x in b) == list(range(len(lengths)))
    assert all(sum(lengths[x] for x in b) + space == most and space >= 0 for b, space in zip(p.bins, p.left))


def triplets(seed, n=300, most=1024):
    """Lengths that fill ``n`` bins exactly, three to a bin."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        a = int(rng.integers(380, 500))
        b = int(rng.integers(250, (most - a) // 2))
        out += [a, b, most - a - b]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_evolution_beats_best_fit(seed):
    lengths, rng = triplets(seed), np.random.default_rng(seed)
    base = packing.best_fit(packing.Packing([], []), list(range(len(lengths))), lengths, 1024)
    assert len(base.bins) > 330  # 300 is the least
    people = packing.evolve([base, *[packing.mutate(base, lengths, 1024, rng, 0.2) for _ in range(5)]], lengths, 1024, 80, rng)
    for p in people:
        whole(p, lengths, 1024)
    assert min(len(p.bins) for p in people) <= 310
    people = packing.evolve(packing.first_generation(lengths, 1024, rng, 6), lengths, 1024, 80, rng)
    assert min(len(p.bins) for p in people) <= 302


def test_crossover_injects_whole_bins():
    lengths, rng = triplets(9, 40), np.random.default_rng(1)
    mother, father = packing.tight_bins(lengths, 1024, rng), packing.tight_bins(lengths, 1024, rng)
    child = packing.crossover(mother, father, lengths, 1024, rng, 0.5)
    whole(child, lengths, 1024)
    kept = {tuple(sorted(b)) for b in child.bins}
    assert len(kept & {tuple(sorted(b)) for b in father.bins}) >= 10


def test_few_and_equal_lengths():
    rng = np.random.default_rng(0)
    for lengths in ([], [5], [1023] * 7, [1] * 3000, [512] * 9):
        people = packing.evolve(packing.first_generation(lengths, 1024, rng, 6), lengths, 1024, 5, rng)
        for p in people:
            whole(p, lengths, 1024)
        assert min(len(p.bins) for p in people) == (len(lengths) if lengths and lengths[0] > 512 else -(-sum(lengths) // 1024))


def test_documents_take_as_few_sequences_as_their_tokens_allow(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    rows = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert len(rows) == -(-sum(r.n for r in rows) // 1024)
