"""The n-gram model against a plain computation, and its verdicts."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np

from stationlake.llm import language_model as lm
from tests.llm.conftest import make_docs, make_labels


def plain_surprise(texts, tested):
    """Interpolated modified Kneser-Ney over folded symbols, from dictionaries."""
    grams = Counter()
    for text in texts:
        symbols = [lm._BLANK] * 3 + [int(lm._SYMBOL_OF[ord(c)]) for c in text]
        grams.update(tuple(symbols[n : n + 4]) for n in range(len(symbols) - 3))
    counts = {4: grams}
    for order in (3, 2, 1):
        counts[order] = Counter(g[1:] for g in counts[order + 1])

    def chance(gram):
        if not gram:
            return 1 / lm.SYMBOLS
        table = counts[len(gram)]
        times = Counter(table.values())
        y = times[1] / (times[1] + 2 * times[2]) if times[1] + 2 * times[2] else 0
        cuts = [0.0] + [
            min(max(n - (n + 1) * y * times[n + 1] / max(times[n], 1), 0), n) for n in (1, 2, 3)
        ]
        follow = {g: n for g, n in table.items() if g[:-1] == gram[:-1]}
        lower = chance(gram[1:])
        if not follow:
            return lower
        total = sum(follow.values())
        left = sum(cuts[min(n, 3)] for n in follow.values()) / total
        own = follow.get(gram, 0)
        return max(own - cuts[min(own, 3)], 0) / total + left * lower

    return [-math.log(chance(tuple(tested[n : n + 4]))) for n in range(len(tested) - 3)]


def test_probabilities(corpus):
    texts = ["the cat sat on the mat.", "A dog, the hog!", "the end | 12", "œuvre de l'été"]
    model = lm.train(make_docs(corpus, texts).repartition(3))
    surprises = model.surprises()
    sums = np.exp(-surprises.astype(float)).reshape(-1, lm.SYMBOLS).sum(1)
    assert np.abs(sums - 1).max() < 1e-4
    tested = [lm._BLANK] * 3 + [int(lm._SYMBOL_OF[ord(c)]) for c in "the rat, 7 é"]
    assert np.allclose(surprises[lm.codes("the rat, 7 é")], plain_surprise(texts, tested), atol=1e-4)


def prose(chance, n):
    return " ".join(chance.choices(["the", "of", "and", "house", "water", "little", "garden", "stone"], k=n)) + "."


def test_verdicts(corpus):
    chance = random.Random(5)
    texts = [prose(chance, chance.randint(30, 90)) for _ in range(200)]
    bad = ["".join(chance.choices("XQZ#|9", k=300)) for _ in range(20)] + [None, ""]
    docs = make_docs(corpus, texts + bad).selectExpr("*", "'x' as kept", "1 as own", "2 as median", "3 as _own", "4 as language", "5 as limits", "6 as Limits_")
    labels = make_labels(corpus, [(n, 1, 0) for n in range(150)] + [(n, 0, 0) for n in range(200, 222)] + [(None, 1, 0), (3, None, None)])
    rows = {r.doc_id: r for r in lm.classify(docs, labels).collect()}
    assert len(rows) == 222
    assert sum(rows[n].kept for n in range(200)) >= 195
    assert not any(rows[n].kept for n in range(200, 222))
    assert rows[220].surprise is None


def test_edges(corpus):
    docs = make_docs(corpus, ["text", None])
    assert [r.kept for r in lm.classify(docs, make_labels(corpus, [])).orderBy("doc_id").collect()] == [True, False]
    assert lm.classify(make_docs(corpus, []), make_labels(corpus, [(1, 1, 0)])).count() == 0
    few = lm.classify(make_docs(corpus, [(None, "ab"), (1, "ab"), (1, "ab"), (2, "cd")]), make_labels(corpus, [(1, 1, None), (2, 1, 0)]))
    assert few.count() == 4


def test_perplexity_covers_the_whole_text(corpus):
    chance = random.Random(7)
    texts = [prose(chance, 60) for _ in range(80)]
    clean = prose(chance, 200)
    docs = make_docs(corpus, [*texts, clean, clean + "".join(chance.choices("XQZ#|9", k=len(clean) // 15))])
    trusted = lm.trusted_ids(make_labels(corpus, [(n, 1, 0) for n in range(80)])).where("NOT _held")
    model = lm.train(docs.join(trusted, docs.doc_id == trusted._trusted))
    rows = {r.doc_id: r for r in lm.classify(docs, make_labels(corpus, [(n, 1, 0) for n in range(80)])).collect()}
    for n in (80, 81):
        whole = model.surprises()[lm.codes(rows[n].text)].astype(float).mean()
        assert math.isclose(rows[n].perplexity, math.exp(whole), rel_tol=1e-6)
    assert rows[81].perplexity > 1.1 * rows[80].perplexity
    assert rows[80].kept and not rows[81].kept


def plain_byte_surprise(texts, tested):
    """The same model over unfolded bytes, from dictionaries that hold the followers of every context."""
    order = lm.BYTE_ORDER
    pad = b" " * (order - 1)
    counts = {order: Counter()}
    for text in texts:
        raw = pad + text.encode()
        counts[order].update(raw[n : n + order] for n in range(len(raw) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(gram[1:] for gram in counts[k + 1])

    def chance(gram):
        if not gram:
            return 1 / 256
        table = counts[len(gram)]
        times = Counter(table.values())
        y = times[1] / (times[1] + 2 * times[2]) if times[1] + 2 * times[2] else 0
        cuts = [0.0] + [min(max(n - (n + 1) * y * times[n + 1] / max(times[n], 1), 0), n) for n in (1, 2, 3)]
        follow = {g: n for g, n in table.items() if g[:-1] == gram[:-1]}
        lower = chance(gram[1:])
        if not follow:
            return lower
        total, own = sum(follow.values()), follow.get(gram, 0)
        return max(own - cuts[min(own, 3)], 0) / total + sum(cuts[min(n, 3)] for n in follow.values()) / total * lower

    raw = pad + tested.encode()
    return [-math.log(chance(raw[n : n + order])) for n in range(len(raw) - order + 1)]


def test_documents_are_scored_by_joins_with_the_tables(corpus):
    texts = ["the cat sat on the mat.", "A dog, the hog!", "the end | 12", "œuvre de l'été", "кот и пёс, кот"]
    tested = ["the rat, 7 é", "THE CAT 12", "пёс и кит", "日本 a", None, "", "the cat"]
    docs = make_docs(corpus, tested).repartition(3)
    model = lm.train(make_docs(corpus, texts).repartition(3))
    surprises = lm.surprises_of(lm.ngrams(docs), model)
    frame = lm.score(docs, surprises)
    plan = frame._jdf.queryExecution().toString()
    assert "CoGroup" in plan and "SortMergeJoin [salt" in plan
    rows = {r.doc_id: r for r in frame.collect()}
    assert len(rows) == len(tested)
    for n, text in enumerate(tested):
        assert rows[n].text == text
        assert (rows[n].n_symbols, rows[n].n_bytes) == (len(text or ""), len((text or "").encode()))
        if not text:
            assert rows[n].surprise is None and rows[n].byte_surprise is None
            continue
        symbols = [lm._BLANK] * 3 + [int(lm._SYMBOL_OF[ord(c)]) for c in text]
        assert math.isclose(rows[n].surprise, np.mean(plain_surprise(texts, symbols)), rel_tol=1e-5)
        assert math.isclose(rows[n].byte_surprise, np.mean(plain_byte_surprise(texts, text)), rel_tol=1e-5)


def test_letters_of_one_class_are_told_apart(corpus):
    chance = random.Random(9)
    usual = ["вода", "дом", "сад", "река", "камень", "после", "долго", "и", "в", "на"]
    texts = [" ".join(chance.choices(usual, k=chance.randint(40, 80))) for _ in range(200)]
    # Eight code points on: the same class for the folded model, other letters in fact.
    strange = ["".join(chr(ord(c) + 8) if c.isalpha() else c for c in text) for text in texts[150:170]]
    labels = make_labels(corpus, [(n, 1, 0) for n in range(150)])
    rows = {r.doc_id: r for r in lm.classify(make_docs(corpus, texts + strange), labels).collect()}
    assert all(math.isclose(rows[200 + n].surprise, rows[150 + n].surprise, rel_tol=1e-9) for n in range(20))
    assert all(rows[200 + n].byte_perplexity > 2 * rows[150 + n].byte_perplexity for n in range(20))
    assert not any(rows[200 + n].kept for n in range(20))
    assert sum(rows[n].kept for n in range(200)) >= 195


def test_partitions_of_several_chunks(corpus):
    texts = [f"text number {n} of many, " * (30_000 + n) for n in range(30)] + [None]
    docs = make_docs(corpus, texts).repartition(1)
    assert sum(len(text or "") for text in texts) > lm.CHUNK
    grams = lm.ngrams(docs).selectExpr("gram", "cast(gram % 1009 as float) as surprise")
    rows = lm.score(docs, grams, keep_text=False).collect()
    assert sorted(r.doc_id for r in rows) == list(range(31))
    for row in rows:
        text = texts[row.doc_id]
        for alphabet, mean in zip(lm.ALPHABETS, (row.surprise, row.byte_surprise), strict=True):
            found = lm.codes(text or "", alphabet) + alphabet.first
            assert mean is None if text is None else math.isclose(mean, (found % 1009).mean(), rel_tol=1e-6)
