"""MinHash near-dedup against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationlake.llm import minhash as mh
from stationlake.llm.components import connected
from tests.llm.conftest import make_docs

WORDS = [f"w{n}" for n in range(3000)]


def family(chance, base, copies, edits):
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(chance.randint(0, edits)):
            words[chance.randrange(len(words))] = chance.choice(WORDS)
        out.append(" ".join(words))
    return out


def make_texts():
    chance = random.Random(11)
    texts = ["", None, " \t", "one", "One", "two words", "a b c d", "a b c d e"]
    for size, edits in ((120, 4), (60, 3), (200, 12), (40, 2)):
        base = chance.choices(WORDS, k=size)
        texts += family(chance, base, 25, edits)
    texts += [" ".join(chance.choices(WORDS, k=80)) for _ in range(40)]
    chance.shuffle(texts)
    return texts


def brute(texts, width, percent):
    sets = []
    for text in texts:
        words = (text or "").encode().lower().split()
        width_here = min(width, len(words))
        sets.append({tuple(words[n : n + width_here]) for n in range(len(words) - width_here + 1)} if words else set())
    parent = list(range(len(texts)))

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                one, two = sorted((top(a), top(b)))
                parent[two] = one
    return [len(s) for s in sets], [top(n) for n in range(len(texts))]


@pytest.mark.parametrize(("width", "rounds"), [(4, 2), (5, 0)])
def test_equals_all_pairs(corpus, monkeypatch, width, rounds):
    """Also without leader rounds, when the last round alone has to find everything."""
    monkeypatch.setattr(mh, "LEADER_ROUNDS", rounds)
    texts = make_texts()
    docs = make_docs(corpus, texts).selectExpr("*", "'x' as band", "1 as component").repartition(4)
    rows = {r.doc_id: r for r in mh.groups(docs, width, 80).collect()}
    sizes, tops = brute(texts, width, 80)
    assert [rows[n].n_shingles for n in range(len(texts))] == sizes
    assert [rows[n].component_id for n in range(len(texts))] == tops


def test_estimate_is_near_similarity(corpus):
    chance = random.Random(4)
    base = chance.choices(WORDS, k=2000)
    texts = [" ".join(base), " ".join(base[:1700] + chance.choices(WORDS, k=300))]
    one, two = (mh.shingles(t, 1) for t in texts)
    both = len(np.intersect1d(one, two))
    true = both / (len(one) + len(two) - both)
    sketches = [[int(v) for v in mh.sketch(mh.minima(s))[1]] for s in (one, two)]
    frame = corpus.createDataFrame([tuple(sketches)], "a array<long>, b array<long>")
    assert abs(frame.select(mh.estimate(F.col("a"), F.col("b")).alias("e")).first().e - true) < 0.15


def test_nulls_and_repeats(corpus):
    rows = mh.groups(make_docs(corpus, [(None, "a b c"), (None, None), (7, "a b c"), (7, "a b c"), (5, "A  b\nc")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [
        ("5", "5"), ("7", "5"), ("7", "5"), ("None", "None"), ("None", "None"),
    ]
    assert mh.groups(make_docs(corpus, [])).count() == 0


def test_components_of_chains(corpus):
    edges = [(n, n + 1) for n in range(40)] + [(100, 90), (95, 90), (100, 95)] + [(7, 7)]
    found = {r.node: r.component for r in connected(corpus.createDataFrame(edges, "low long, high long")).collect()}
    assert found == {**{n: 0 for n in range(41)}, 90: 90, 95: 90, 100: 90}
    assert connected(corpus.createDataFrame([], "low long, high long")).count() == 0
