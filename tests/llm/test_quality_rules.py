"""Quality rules: counts by brute force, trees and their monotone bounds."""

from __future__ import annotations

import random
import re

import numpy as np

from stationlake.llm import quality_rules as qr
from tests.llm.conftest import make_docs, make_labels


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[n : n + 3]) for n in range(len(words) - 2)]
    inside = {n + k for n, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(inside)]


def test_counts():
    chance = random.Random(2)
    texts = ["", " ", "a a a", "a a a a", "x\nx\n\n \nx", "é\xa0b c # <|>", "a b c a b c a"]
    texts += ["".join(chance.choices("ab \n#", k=chance.randint(1, 120))) for _ in range(300)]
    for text in texts:
        assert qr.statistics(text)[0] == plain_counts(text), text


def test_trees_keep_directions():
    chance = np.random.RandomState(0)
    values = chance.rand(1500, len(qr.FEATURES))
    symbols = qr.FEATURES.index("symbol_share")
    good = ((values[:, symbols] < 0.5) ^ (chance.rand(1500) < 0.1)) & (values[:, 0] > 0.2)
    # Noise that speaks for more symbols in one corner must not turn the direction.
    good |= (values[:, symbols] > 0.9) & (values[:, 3] > 0.5)
    trees = qr.fit(values, good.astype(float))
    assert ((trees.score(values) > 0) == good).mean() > 0.8
    grid = np.repeat(values[:50], 21, 0)
    grid[:, symbols] = np.tile(np.linspace(0, 1, 21), 50)
    steps = np.diff(trees.score(grid).reshape(50, 21), axis=1)
    assert steps.max() <= 1e-9
    single = [trees.score(row[None])[0] for row in values[:20]]
    assert np.allclose(single, trees.score(values[:20]))


def test_verdicts_and_edges(corpus):
    chance = random.Random(3)
    good = [" ".join(f"w{chance.randint(0, 999)}" for _ in range(100)) for _ in range(60)]
    bad = [" | ".join(f"W{chance.randint(0, 999)}" for _ in range(100)) for _ in range(60)]
    docs = make_docs(corpus, [*good, *bad, None, "", "word " * 200]).selectExpr("*", "'x' as kept", "1 as n_words")
    labels = make_labels(corpus, [(n, int(n < 60), 0) for n in range(0, 120, 2)] + [(None, 1, 0), (5, None, 0)])
    trees = qr.fit_on_labels(docs, labels)
    rows = {r.doc_id: r for r in qr.judge(docs, trees).collect()}
    assert [rows[n].kept for n in range(120)] == [True] * 60 + [False] * 60
    assert all(rows[n].base_failed and not rows[n].kept for n in (120, 121, 122))
    assert qr.judge(make_docs(corpus, []), qr.fit_on_labels(docs, make_labels(corpus, []))).count() == 0
    alone = qr.judge(docs, qr.fit_on_labels(docs, make_labels(corpus, [(0, 1, 0)])))
    assert alone.where("kept = base_failed").count() == 0
