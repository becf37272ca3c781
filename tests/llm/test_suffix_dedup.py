"""Suffix dedup against all strings of 100 bytes."""

from __future__ import annotations

import random

import numpy as np

from stationlake.llm import suffix_dedup as sd
from tests.llm.conftest import make_docs


def brute(texts):
    seen, out = set(), {}
    for doc_id, text in texts:
        content = (text or "").encode()
        gone = np.zeros(len(content), bool)
        own = [content[at : at + 100] for at in range(len(content) - 99)]
        for at, string in enumerate(own):
            if string in seen:
                gone[at : at + 100] = True
            seen.add(string)
        out[doc_id] = bytes(np.frombuffer(content, np.uint8)[~gone])
    return out


def make_texts():
    chance = random.Random(7)
    words = ["".join(chance.choices("abcdé", k=chance.randint(2, 7))) for _ in range(400)]
    sentence = lambda n: " ".join(chance.choices(words, k=n))
    passage, line = sentence(60), sentence(9)
    texts = ["", None, "a" * 99, "a" * 100, "a" * 700, "ab" * 300, passage, sentence(20) + passage[:300] + sentence(20)]
    for n in range(60):
        base = sentence(chance.randint(5, 120))
        if n % 3 == 0:
            base = line + "\n" + base
        if n % 4 == 0:
            base = base[: len(base) // 2] + passage[chance.randint(0, 80) : 300] + base[len(base) // 2 :]
        texts.append(base)
        if n % 5 == 0:
            texts.append(base[:200] + "X" + base[201:])
            texts.append(base)
    return texts


def test_equals_brute_force(corpus):
    texts = list(enumerate(make_texts()))
    docs = make_docs(corpus, texts).selectExpr("*", "'x' as kept", "2 as place").repartition(5)
    rows = {r.doc_id: r for r in sd.remove_repeats(docs).collect()}
    for doc_id, kept in brute(texts).items():
        row, content = rows[doc_id], (dict(texts)[doc_id] or "").encode()
        assert bytes(row.kept) == kept
        assert row.n_bytes == len(content)
        assert sum(s.after - s.first for s in row.spans) == len(content) - len(kept)
        assert all(a.after < b.first for a, b in zip(row.spans, row.spans[1:], strict=False))


def test_many_runs_of_one_speaker(corpus, monkeypatch):
    monkeypatch.setattr(sd, "MANY_RUNS", 1)
    texts = list(enumerate(make_texts()))
    rows = {r.doc_id: bytes(r.kept) for r in sd.remove_repeats(make_docs(corpus, texts)).collect()}
    assert rows == brute(texts)


def test_pieces_of_long_texts(monkeypatch):
    chance = np.random.RandomState(2)
    content = chance.randint(97, 100, 5000).astype(np.uint8)
    whole = sd.runs(content, 100, 32)
    monkeypatch.setattr(sd, "PIECE", 512)
    parts = sd.runs(content, 100, 32)
    assert set(whole[0].tolist()) == set(parts[0].tolist())
    assert int(whole[3].sum()) == int(parts[3].sum()) == 4901


def test_null_ids_and_repeated_rows(corpus):
    text = "some words " * 20
    rows = sd.remove_repeats(make_docs(corpus, [(None, text), (None, text), (4, "x" + text), (4, "x" + text)])).collect()
    kept = sorted((str(r.doc_id), bytes(r.kept)) for r in rows)
    alone = brute([(4, "x" + text)])[4]
    assert kept == sorted([("None", text.encode())] * 2 + [("4", alone)] * 2)
    assert sd.remove_repeats(make_docs(corpus, [])).count() == 0


def test_rows_that_share_an_id_keep_their_own_texts(corpus):
    chance = random.Random(3)
    one, two, three = ("".join(chance.choices("abcdef ", k=300)) for _ in range(3))
    rows = [(1, one), (2, one), (2, two), (2, two), (2, three + one[:150]), (3, two[:120])]
    found = sorted((r.doc_id, bytes(r.kept).decode()) for r in sd.remove_repeats(make_docs(corpus, rows)).collect())
    assert found == sorted([(1, one), (2, ""), (2, two), (2, two), (2, three), (3, "")])


def test_very_long_texts(corpus):
    chance = random.Random(4)
    long = "".join(chance.choices("abcdefgh", k=300_000))
    found = {r.doc_id: r.n_bytes - len(r.kept) for r in sd.remove_repeats(make_docs(corpus, [long, long[1000:200_000], "z" * 200_000])).collect()}
    assert found == {0: 0, 1: 199_000, 2: 199_999}
