"""Token counts against the vocabulary's library."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from stationlake.llm import token_counts
from tests.llm.conftest import make_docs

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.VOCABULARY))


def test_units_merge_like_the_library(library):
    with open(public_tokenizers.path(token_counts.VOCABULARY), "rb") as file:
        counter = token_counts.Counter(file.read())
    rng = random.Random(11)
    alphabets = ["ab", " ab", "\n\t a▁", "theran ing\n", "éàçß ñ", "日本語の、 ", "กขค ①😀", "<s>/0x41 ", "01 23.,-_=", "\x00\x7f́ e"]
    for _ in range(3000):
        alphabet = "".join(rng.sample(alphabets, 2))
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert counter.count(text) == len(library.encode(text)), repr(text)


def test_very_long_texts(library):
    with open(public_tokenizers.path(token_counts.VOCABULARY), "rb") as file:
        counter = token_counts.Counter(file.read())
    rng = random.Random(3)
    for text in ("a" * 50_000, " " * 30_001, "the end\n" * 20_000, "".join(rng.choice("etaoins") for _ in range(60_000)), "本" * 20_000):
        assert counter.count(text) == len(library.encode(text))


def test_memo_is_bounded_and_right(library, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_ENTRIES", 7)
    with open(public_tokenizers.path(token_counts.VOCABULARY), "rb") as file:
        counter = token_counts.Counter(file.read())
    text = " ".join(f"word{n % 13} other{n % 5}" for n in range(300))
    assert counter.count(text) == len(library.encode(text))
    assert len(counter.memo) <= 7 and len(counter.memo.older) <= 7


def test_defined_cases(corpus, library):
    texts = [None, "", " ", "twice", "twice", "<s>hello</s> <unk>", "x " * 4096]
    docs = make_docs(corpus, [(n if n else None, text) for n, text in enumerate(texts)])
    docs = docs.withColumn("n_tokens", F.lit("clash")).withColumn("extra", F.lit(1))
    found = token_counts.count_tokens(docs)
    assert set(found.columns) == set(docs.columns)
    rows = sorted((r.text or "", r.n_tokens) for r in found.collect())
    assert rows == sorted((t or "", len(library.encode(t or ""))) for t in texts)
    lengths = {r.doc_id: r for r in token_counts.document_lengths(docs).collect()}
    assert lengths[6].over_limit == (lengths[6].n_tokens > 4096) and lengths[1].n_bytes == 0
    assert token_counts.document_lengths(docs.where("false")).collect() == []


def test_limit_is_exclusive(corpus, library):
    docs = make_docs(corpus, ["one two three"])
    exact = len(library.encode("one two three"))
    assert [token_counts.document_lengths(docs, limit).first().over_limit for limit in (exact - 1, exact)] == [True, False]


def test_query_against_the_library(corpus, library):
    found = {r.doc_id: r for r in entry_point.queries()["op11_token_counts"](corpus, FOLDER).collect()}
    docs = corpus.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(found) == len(docs)
    for doc in docs:
        row = found[doc.doc_id]
        count = len(library.encode(doc.text or ""))
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len((doc.text or "").encode()), count, count > 4096)
