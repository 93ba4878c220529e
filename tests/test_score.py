"""The matrix part of scoring against a plain sort, on awkward numbers."""

import numpy as np
import pytest

from ranksmith.operators.score import _best, _block_scores, _tiling


def plain(sources, candidates, ids, k, hidden=()):
    scores = (sources.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.float32)
    return [
        sorted((-s, i) for j, (s, i) in enumerate(zip(row, ids)) if (r, j) not in hidden)[:k]
        for r, row in enumerate(scores)
    ]


def blockwise(sources, candidates, ids, k, cuts, seen=None):
    held = None
    source_ids = np.arange(100, 100 + len(sources), dtype=np.int32)
    for part in np.array_split(np.arange(len(ids)), cuts):
        new = _block_scores(sources, candidates[part], source_ids, ids[part], seen, held, k)
        held = new if held is None else _best(*[np.concatenate(p) for p in zip(held, new)], k)
    rows, found, scores = held
    return [[(-s, i) for s, i in zip(scores[rows == r], found[rows == r])] for r in range(len(sources))]


CASES = {
    "random": lambda rng, shape: rng.normal(size=shape),
    "ties": lambda rng, shape: rng.integers(-2, 3, size=shape),
    "zeros": lambda rng, shape: np.zeros(shape),
    "nearly equal": lambda rng, shape: 1000 + rng.normal(size=shape) * 1e-4,
    "cancelling": lambda rng, shape: rng.choice([-1e4, 1e4], size=shape) + rng.normal(size=shape),
}


@pytest.mark.parametrize("kind", CASES)
@pytest.mark.parametrize("k", [1, 7, 100, 900])
@pytest.mark.parametrize("cuts", [1, 2, 7])
def test_block_scores(kind, k, cuts):
    rng = np.random.default_rng(3)
    sources = CASES[kind](rng, (9, 10)).astype(np.float32)
    candidates = CASES[kind](rng, (800, 10)).astype(np.float32)
    ids = rng.permutation(5000)[:800].astype(np.int32)
    assert blockwise(sources, candidates, ids, k, cuts) == plain(sources, candidates, ids, k)


@pytest.mark.parametrize("share", [0.05, 0.9, 1.0])
def test_hidden_candidates(share):
    rng = np.random.default_rng(4)
    sources = rng.integers(-2, 3, size=(5, 4)).astype(np.float32)
    candidates = rng.integers(-2, 3, size=(300, 4)).astype(np.float32)
    ids = rng.permutation(900)[:300].astype(np.int32)
    hidden = {(r, j) for r in range(5) for j in range(300) if rng.random() < share}
    pairs = np.array(sorted(hidden))
    seen = (100 + pairs[:, 0]).astype(np.int32), ids[pairs[:, 1]]
    # Pairs of other blocks travel along and must be ignored.
    seen = np.r_[seen[0], [7, 100]].astype(np.int32), np.r_[seen[1], [ids[0], 10_000]].astype(np.int32)
    for cuts in (1, 4):
        assert blockwise(sources, candidates, ids, 6, cuts, seen) == plain(sources, candidates, ids, 6, hidden)


@pytest.mark.parametrize(
    "sizes,expected",
    [
        ((400, 10**9, 10**7, 4_000_000, 611), (200, 2)),
        ((400, 10**7, 10**9, 40_000, 61_000), (2, 200)),
        ((600, 3, 10**9, 1, 61_000), (1, 600)),
        ((4, 10**6, 10**6, 4_000, 62), (2, 2)),
    ],
)
def test_tiles_follow_the_table_sizes(sizes, expected):
    assert _tiling(*sizes) == expected
