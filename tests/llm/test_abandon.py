"""Bit-sliced comparison: blocks of unrelated fingerprints are abandoned, and results are those of all pairs."""

import itertools

import numpy as np
import pytest

from unskew.llm import simhash


def pairs_within(fps, radius):
    return {(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (int(fps[a]) ^ int(fps[b])).bit_count() <= radius}


def table(n, seed, copies=30):
    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 2**64, n, dtype=np.uint64)
    for i in range(copies):  # some near others
        fps[n - 1 - i] = fps[i] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, i % 7, replace=False)))
    return fps


@pytest.mark.parametrize("radius", [0, 3, 4, 24])
def test_within_matches_all_pairs(radius):
    fps = table(400, radius)
    hit = simhash.within(fps[:150], simhash.planes(fps), radius)
    bits = np.unpackbits(hit.view(np.uint8).reshape(150, -1), axis=1, bitorder="little")[:, :400].astype(bool)
    want = np.array([[(int(a) ^ int(b)).bit_count() <= radius for b in fps] for a in fps[:150]])
    assert (bits == want).all()


def test_most_words_of_unrelated_fingerprints_are_abandoned():
    fps, seen = table(6000, 1, 0), []
    block = simhash.planes(fps[:4096])
    assert simhash.within(fps[4096:4608], block, 4, open_=seen) is None
    total = 512 * block.shape[1]
    assert seen[1] < 0.1 * total and seen[2] < 0.01 * total and seen[-1] == 0
    # a block against itself: only later lanes matter, and no row meets itself
    seen = []
    assert simhash.within(fps[:512], block, 4, simhash._passed(512, 0, np.arange(4096), 64), seen) is None
    assert seen[1] < 0.1 * total and seen[-1] == 0


@pytest.mark.parametrize("radius", [4, 24])
def test_forests_join_what_all_pairs_join(radius):
    fps = np.unique(table(700, 9))

    def roots(edges):
        label = list(range(len(fps)))
        for a, b in edges:
            x, y = label[a], label[b]
            label = [min(x, y) if v in (x, y) else v for v in label]
        return label

    assert roots(simhash.forest(fps, radius)) == roots(sorted(pairs_within(fps, radius)))
