"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from stationlake.llm import spelling
from tests.llm.conftest import make_docs

FOLDER = "/root/testdata/sf0.01"


def words_of(docs):
    """Counts by the letter of the contract, one occurrence after the other."""
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            check = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if check % 199 == 0:
                at = check % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {word: n for word, n in counts.items() if len(word) >= 6 and n >= 5}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def near_by_masks(words):
    """Near words by what is left without one code point, then held against the plain rule."""
    left = defaultdict(set)
    for word in words:
        left[word].add(word)
        for at in range(len(word)):
            left[word[:at] + word[at + 1 :]].add(word)
    near = defaultdict(set)
    for group in left.values():
        for a in group:
            near[a] |= {b for b in group if is_near(a, b)}
    return near


def brute(counts, near):
    rows, form = set(), {}
    for word in counts:
        best = min(near[word], key=lambda w: (-counts[w], w), default=None)
        if best is not None and counts[best] >= 5 * counts[word]:
            form[word] = best
    for word, n in counts.items():
        root = word
        while root in form:
            root = form[root]
        rows.add((word, form.get(word), root, n, len(near[word]), counts[form[word]] if word in form else None))
    return rows


def result(frame):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def variants(rng, alphabet, count):
    words = set()
    while len(words) < count:
        word = "".join(rng.choice(alphabet) for _ in range(rng.randrange(6, 12)))
        for _ in range(rng.randrange(1, 6)):
            words.add(word)
            at, sign = rng.randrange(len(word)), rng.choice(alphabet)
            word = rng.choice([word[:at] + word[at + 1 :], word[:at] + sign + word[at:], word[:at] + sign + word[at + 1 :]])
            if len(word) < 6:
                break
    return sorted(words)


@pytest.mark.parametrize("alphabet", ["ab", "abc", "etaoinsh", "aéàüzÿ÷", "日本語のa"])
def test_near_words_of_small_alphabets(corpus, alphabet):
    rng = random.Random(alphabet)
    words = variants(rng, alphabet, 500)
    counts = {word: rng.choice([5, 6, 30, 31, 200, 1200]) for word in words}
    frame = corpus.createDataFrame(list(counts.items()), "word string, n long")
    near = {a: {b for b in words if is_near(a, b)} for a in words}
    assert result(spelling.group_variants(frame)) == brute(counts, near)


def test_pivots_are_disjoint_and_cheapest():
    rng = random.Random(4)
    for _ in range(500):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(4, 14)))
        order = np.array([rng.randrange(50) * spelling.BUCKETS + n for n in range(spelling.BUCKETS)])
        prefix = spelling.prefix_of(word, order)
        chosen = spelling.pivots_of(prefix)
        costs = [
            a[0] // spelling.BUCKETS + b[0] // spelling.BUCKETS for a in prefix for b in prefix if b[1] - a[1] >= 2
        ]
        assert len(chosen) == 2 and chosen[1][1] - chosen[0][1] >= 2
        assert sum(place // spelling.BUCKETS for place, _ in chosen) == min(costs)


def test_chains_of_forms_are_followed_to_the_end(corpus):
    words = {"aaaaaaaa"[:n] + "b" * (8 - n): 5 * 6**n for n in range(9)}
    frame = corpus.createDataFrame(list(words.items()), "word string, n long")
    found = {r.word: r for r in spelling.group_variants(frame).collect()}
    assert {r.root for r in found.values()} == {"aaaaaaaa"} and found["aaaaaaaa"].form is None
    assert found["bbbbbbbb"].form == "abbbbbbb"


def test_defined_cases(corpus, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    long = " ".join(["Garden", "gardÉn", "GARDEN's", "jardin×", "l'été"] * 4000)
    texts = [(1, None), (2, ""), (None, "garden gardem " * 9), (3, "garden"), (3, "garden"), (4, long), (5, "gardens" * 3000), (6, "- 12 łł")]
    docs = make_docs(corpus, texts).withColumns({"word": F.lit("clash"), "n": F.lit(1), "key": F.lit(2)})
    counts = words_of(texts)
    found = spelling.group_variants(spelling.count_words(docs, change=spelling.with_slips))
    assert result(found) == brute(counts, near_by_masks(counts))
    assert result(spelling.group_variants(spelling.count_words(docs.where("false")))) == set()
    plain = spelling.count_words(docs)
    assert {r.word for r in plain.collect()} >= {"garden", "gardÉn", "jardin×"}


def test_short_words_are_an_error(corpus):
    with pytest.raises(ValueError, match="four"):
        spelling.near_pairs(corpus.createDataFrame([("abc", 9)], "word string, n long"))


def test_query_against_brute_force(corpus):
    docs = [(r.doc_id, r.text) for r in corpus.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    counts = words_of(docs)
    found = result(entry_point.queries()["op13_spelling_variants"](corpus, FOLDER))
    assert found == brute(counts, near_by_masks(counts))
    assert any(row[1] for row in found)
