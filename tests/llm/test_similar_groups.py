"""Groups of similar texts: recall whatever the table's size, and the exact measure."""

import random

import numpy as np
import pytest

from tessera.llm import simhash


def _pair(rng, n, changed):
    """Two texts of n words, the second with another word at `changed` places that share no shingle of 5."""
    a = ["".join(rng.choice("etaoinshrdlu") for _ in range(8)) for _ in range(n)]
    b = list(a)
    for i in range(changed):
        b[10 + i * 5] = f"other{i}"
    return " ".join(a), " ".join(b)


def _jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def _together(spark, pairs, **options):
    rows = [(2 * i + side, p[side]) for i, p in enumerate(pairs) for side in (0, 1)]
    groups = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}
    assert len(groups) == len(rows) and all(groups[2 * i] == 2 * i for i in range(len(pairs)))
    return [groups[2 * i + 1] == 2 * i for i in range(len(pairs))]


def test_recall_at_the_threshold():
    """Sets of a similarity of 0.8 share a band's key: no part of it depends on the number of texts."""
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2**64, (3000, 225), np.uint64)
    other = hashes.copy()
    other[:, :25] = rng.integers(0, 2**64, (3000, 25), np.uint64)
    off = np.arange(0, 3000 * 225 + 1, 225)
    same = (simhash.bands(hashes.ravel(), off) == simhash.bands(other.ravel(), off)).any(1)
    assert same.mean() >= 0.997 and simhash.recall(0.8) >= 0.999
    assert not (simhash.bands(hashes[:1500].ravel(), off[:1501]) == simhash.bands(hashes[1500:].ravel(), off[:1501])).any()


def test_pairs_just_above_the_threshold_are_found(spark):
    rng = random.Random(8)
    pairs = [_pair(rng, 229, rng.choice([4, 5])) for _ in range(150)]
    assert all(0.8 <= _jaccard(*p) < 0.85 for p in pairs)
    assert all(_together(spark, pairs))


@pytest.mark.parametrize("limit", [simhash.SET_HASHES, 300])
def test_similarity_is_measured_exactly(spark, limit):
    rng = random.Random(9)
    pairs = [_pair(rng, 229, changed) for changed in (2, 3, 4, 5, 6, 7, 8) for _ in range(25)]
    similar = [_jaccard(*p) >= 0.8 for p in pairs]
    assert 0.68 < min(map(lambda p: _jaccard(*p), pairs)) and 0 < sum(similar) < len(similar)
    assert _together(spark, pairs, limit=limit) == similar


def test_repeated_shingles_count_once():
    hashes = np.array([1, 2, 3, 4, 5, 1, 1, 1, 1, 2, 3, 4], np.uint64)
    sets = simhash._sets(hashes, np.array([0, 5, 12, 12]))
    assert sets[0].tolist() == [1, 2, 3, 4, 5, 1, 2, 3, 4] and sets[1].tolist() == [0, 5, 9, 9]
    assert simhash.similar_links(*sets, 0.8) == [(0, 1)] and simhash.similar_links(*sets, 0.81) == []


def _sets_of(rng, n, size, changed):
    """n pairs of random sets that differ in `changed` of `size` hashes."""
    hashes = rng.integers(0, 2**64, (n, size), np.uint64)
    other = hashes.copy()
    other[:, :changed] = rng.integers(0, 2**64, (n, changed), np.uint64)
    return hashes.ravel(), other.ravel(), np.arange(0, n * size + 1, size)


@pytest.mark.parametrize("n_texts", [1_000, 10_000_000, 10_000_000_000])
def test_segments_keep_recall_at_any_size(n_texts):
    """SimHash segments of the width for a table of that size: similar sets share one and are close in whole."""
    width = simhash.width_for(n_texts)
    assert n_texts / 2**width <= simhash.FILL and simhash.recall(0.8, width) >= 0.9999
    a, b, off = _sets_of(np.random.default_rng(5), 1000, 225, 25)
    words = max(simhash.COMPARED, -(-simhash.segments(width, 0.8) * width // 64))
    x, y = simhash.majority(a, off, words), simhash.majority(b, off, words)
    shared = (simhash.bands(a, off, width, 0.8, x) == simhash.bands(b, off, width, 0.8, y)).any(1)
    bits = simhash._distance(x[:, : simhash.COMPARED], y[:, : simhash.COMPARED])
    assert (shared & (bits <= simhash.radius_for(0.8))).mean() >= 0.998
    assert abs(bits.mean() / 256 - simhash.differing(0.8)) < 0.005


def test_near_prints_against_all_pairs():
    rng = np.random.default_rng(6)
    fp = rng.integers(0, 2**64, (40, 4), np.uint64)[rng.integers(0, 40, 3000)]
    for _ in range(9):
        fp[np.arange(3000), rng.integers(0, 4, 3000)] ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    links = simhash.near_prints(fp, 12, 12)
    want, got = simhash.Forest(3000), simhash.Forest(3000)
    for i in range(3000):
        for j in np.flatnonzero(simhash._distance(fp[i + 1 :], fp[i]) <= 12).tolist():
            want.join(i, i + 1 + j)
    for i, j in links.tolist():
        assert simhash._distance(fp[i], fp[j]) <= 12
        got.join(i, j)
    assert len(links) == len(got.links) == len(want.links) > 100
    assert all(got.find(i) == want.find(i) for i in range(3000))


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 10])
def test_narrow_buckets_and_chunks_find_the_same(spark, bucket):
    rng = random.Random(10)
    pairs = [_pair(rng, 229, changed) for changed in (0, 1, 4, 5, 7, 8) for _ in range(20)]
    assert _together(spark, pairs, fill=1, bucket=bucket) == [_jaccard(*p) >= 0.8 for p in pairs]
