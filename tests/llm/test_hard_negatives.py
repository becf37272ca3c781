"""Hard negatives against brute force, and how much the coordinate ranges leave to verify."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationlake.llm import hard_negatives as mining

SCHEMA = "vec_id long, label int, vector array<long>, probe string, rank int"


def brute(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    found = set()
    rows = [r for r in rows if None not in r[:3]]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    for anchor, label, vector in rows:
        if not is_anchor(anchor):
            continue
        same = sorted((-score(vector, v), i) for i, k, v in rows if k == label and i != anchor)[:positives]
        others = sorted((-score(vector, v), i) for i, k, v in rows if k != label)
        for minus, positive in same:
            fit = [(s, i) for s, i in others if low * -minus <= 100 * -s <= high * -minus][:negatives]
            found |= {(anchor, positive, rank, i, -minus, -s) for rank, (s, i) in enumerate(fit, 1)}
    return found


def mined(spark, rows, every):
    frame = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    result = mining.mine(frame, F.expr(f"vec_id % {every} = 0"))
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    listed = [tuple(r) for r in result.select(names).collect()]
    assert len(listed) == len(set(listed))
    return set(listed)


@pytest.fixture
def small(monkeypatch):
    """Buckets and shards so small that a few hundred rows fill many of them."""
    monkeypatch.setattr(mining, "BUCKET_ROWS", 16)
    monkeypatch.setattr(mining, "FEWEST_SHARD_ROWS", 48)


def test_random_rows_of_many_lengths(corpus, small):
    rng = np.random.default_rng(12)
    rows = []
    for n in range(400):
        vector = rng.normal(size=6) * 10 ** rng.uniform(0, 3)
        rows.append((n, int(rng.integers(4)), np.floor(vector).astype(int).tolist()))
    assert mined(corpus, rows, 10) == brute(rows, lambda i: i % 10 == 0)


def test_ties_hot_vector_and_hot_label(corpus, small):
    rng = np.random.default_rng(5)
    rows = [(n, 0 if n % 3 else 1 + n % 4, [3, 4, 0] if n % 3 == 1 else rng.integers(-4, 5, 3).tolist()) for n in range(300)]
    found = mined(corpus, rows, 25)
    assert found and found == brute(rows, lambda i: i % 25 == 0)


def test_nulls_zero_vectors_short_vectors_and_single_labels(corpus, small):
    rows = [
        (0, 1, [5, 0]), (1, 1, [4, 1, 9]), (2, 2, [2, 2]), (3, 2, [3]), (4, None, [5, 5]), (5, 2, None), (None, 2, [4, 0]),
        (6, 3, [0, 0]), (8, 3, [0, 0]), (10, 1, []), (12, 9, [7, 7]), (14, 1, [-5, 0]), (16, 3, [0, 1]), (18, 2, [0, 0]),
    ]
    assert mined(corpus, rows, 2) == brute(rows, lambda i: i % 2 == 0)


def test_empty_table(corpus):
    assert mined(corpus, [], 2) == set()
    assert mined(corpus, [(1, 1, [1, 2])], 2) == set()


def test_rows_that_repeat_an_id_are_no_positives_of_each_other(corpus):
    rows = [(2, 1, [4, 4]), (2, 1, [4, 4]), (3, 1, [4, 3]), (5, 2, [3, 3]), (7, 2, [2, 2])]
    frame = corpus.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    found = mining.mine(frame, F.expr("vec_id % 2 = 0")).collect()
    assert {r.positive_id for r in found} == {3} and len(found) == 4


def test_large_components_are_exact_or_an_error(corpus, small):
    rng = np.random.default_rng(8)
    rows = [(n, n % 2, (rng.integers(-(1 << 26), 1 << 26, 4)).tolist()) for n in range(60)]
    assert mined(corpus, rows, 6) == brute(rows, lambda i: i % 6 == 0)
    with pytest.raises(Exception, match="too large"):
        mined(corpus, [(0, 1, [1 << 40]), (1, 1, [1 << 40])], 2)


def test_rows_with_bad_components_take_no_part(corpus):
    rows = [(1, 1, [0.5, None]), (2, 1, [math.nan]), (3, 1, [math.inf]), (4, 1, [0.5, -0.25]), (5, None, [0.1]), (6, 2, None), (7, 3, [1e-9])]
    frame = corpus.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert {r.vec_id: r.vector for r in mining.integer_vectors(frame).collect()} == {4: [128, -64], 7: [0]}


def test_ranges_leave_few_rows_of_clustered_vectors():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    vectors = np.floor(1024 * (centres[np.arange(4000) % 40] + 0.02 * rng.normal(size=(4000, 16)))).astype(np.int64)
    labels = [int(n) // 40 % 2 for n in range(4000)]
    shard = mining.Shard(vectors, labels, np.arange(4000))
    for at in range(0, 4000, 100):
        own = int(vectors[at] @ vectors[at])
        found = shard.search(vectors[at], labels[at], at, [(own * 9 // 10, own)], 3, same=False)
        scores = vectors @ vectors[at]
        right = sorted((-int(scores[i]), i) for i in range(4000) if labels[i] != labels[at] and own * 9 // 10 <= scores[i] <= own)
        assert found == [right[:3]]
    assert shard.verified < 0.2 * shard.seen
