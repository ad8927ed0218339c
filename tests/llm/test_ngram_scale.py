"""The n-gram join's candidates grow with the documents, not with their square."""

import random

import numpy as np
import pytest
from test_llm import brute_components, frame

from quillspark.llm import jaccard

NUM, DEN = 4, 5


def unrelated(count, least, most, seed=0):
    r = np.random.default_rng(seed)
    return [np.unique(r.integers(0, 2**63, r.integers(least, most + 1)).astype(np.uint64) * np.uint64(2)) for _ in range(count)]


def test_unrelated_sets_share_no_frequent_key():
    """Empty parts were keys of three sets in four: each was shared by a fixed share of all documents."""
    _, often = np.unique(np.concatenate([np.unique(jaccard.tile_keys(s, NUM, DEN)) for s in unrelated(4000, 60, 240)]), return_counts=True)
    assert often.max() <= jaccard.SMALL


def test_bitmaps_tell_unrelated_sets_apart():
    """With 128 bits for 213 shingles about one pair in sixty of like size passed, so that groups grew together."""
    for least, most in ((45, 55), (100, 110), (200, 213)):
        sets = unrelated(300, least, most)
        maps, sizes = jaccard.Bitmaps([jaccard.bitmap(s, NUM, DEN).tobytes() for s in sets]), np.array([len(s) for s in sets])
        i, j = np.triu_indices(len(sets), 1)
        both = sizes[i] + sizes[j]
        assert not ((both - maps.differ(i, j)) * (NUM + DEN) >= 2 * NUM * both).any()


@pytest.mark.parametrize(("num", "den"), [(4, 5), (9, 10)])
def test_linked_sets_share_more_keys_than_either_can_spare(num, den):
    r = np.random.default_rng(3)
    for s in unrelated(150, 1, 900, 4):
        n = len(s)
        lost = int(r.integers(0, n - -(-n * num // den) + 1))  # a subset at the threshold or above
        swap = min(lost, (den - num) * n // (den + num))  # as many swapped
        fresh = r.integers(0, 2**63, swap).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        for t in (np.sort(r.permutation(s)[lost:]), np.unique(np.concatenate([r.permutation(s)[swap:], fresh]))):
            common = len(np.intersect1d(s, t))
            if den * common < num * (n + len(t) - common):
                continue
            band = next(b for b, (lo, hi) in enumerate(jaccard.bands(2 * n)) if lo <= n <= hi) % jaccard.BANDS
            (a, more_a), (b, more_b) = (jaccard.keys_and_spare(x, num, den) for x in (s, t))
            shared = np.intersect1d(a, b) >> jaccard._LOW
            assert (shared % np.uint64(jaccard.BANDS) == band).sum() > max(more_a[band], more_b[band])


def test_frequent_keys_are_left_out_without_losing_a_link(spark, monkeypatch):
    """A passage that all documents share makes keys of all of them; near copies stay linked."""
    monkeypatch.setattr(jaccard, "SMALL", 2)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 8)
    r = random.Random(11)
    word = lambda: f"w{r.randrange(10**6)}"
    passage = [word() for _ in range(90)]
    some = []
    for _ in range(40):
        base = passage + [word() for _ in range(r.choice((60, 90, 120)))]
        some.append(" ".join(base))
        for k in range(r.randrange(4)):
            near = list(base)
            for _ in range(k):
                near[r.randrange(len(near))] = word()
            some.append(" ".join(near))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(frame(spark, some), 5, 0.8).collect()}
    assert got == brute_components(some, 5, 0.8)
