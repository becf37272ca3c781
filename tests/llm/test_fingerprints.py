"""Fingerprints: successors and edits by brute force, and the sum of paragraphs."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from stationlake.llm import fingerprints as fp
from tests.llm.conftest import make_docs

WORDS = [f"w{n}" for n in range(500)]


def corpus_texts():
    chance = random.Random(1)
    texts = ["\n".join(" ".join(chance.choices(WORDS, k=30)) for _ in range(chance.randint(1, 6))) for _ in range(150)]
    return [*texts, "", None, texts[3], "é🙂x", " "]


def test_edits_and_likeness(corpus):
    texts = corpus_texts()
    docs = make_docs(corpus, texts).selectExpr("*", "'x' as fingerprint", "1 as range")
    rows = {r.doc_id: r for r in fp.compare_with_edits(docs).collect()}
    assert len(rows) == len(texts)
    printed = {}
    order = sorted(range(len(texts)), reverse=True)
    for place, doc_id in enumerate(order):
        text, following = texts[doc_id] or "", texts[order[(place + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = rows[doc_id]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert printed.setdefault(text, row.fingerprint) == row.fingerprint
        assert printed.setdefault(edited, row.edited_fingerprint) == row.edited_fingerprint
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
    assert len(set(printed.values())) == len(printed)
    long = [rows[n] for n in range(1, 150)]
    assert sum(r.near_edited > r.near_next for r in long) > 0.97 * len(long)


def test_sum_of_paragraphs(corpus):
    """Order does not matter, and adding or taking away a paragraph is adding or subtracting lanes."""
    frame = corpus.createDataFrame([("a b c\nd e f\ng h", "g h\na b c\nd e f", "a b c\nd e f", "g h")], "x string, y string, z string, w string")
    sums = {}
    for name in "xyzw":
        row = fp.sums(frame.withColumn("k", F.lit(1)), ["k"], name)
        sums[name] = row.select("k", F.concat("exact", "lanes").alias(name))
    joined = sums["x"].join(sums["y"], "k").join(sums["z"], "k").join(sums["w"], "k")
    row = joined.select("x", "y", "z", fp.combine(F.col("z"), F.col("w")).alias("more"), fp.combine(F.col("x"), F.col("w"), -1).alias("less")).first()
    assert row.x == row.y == row.more
    assert row.less == row.z


def test_few_documents(corpus):
    assert fp.compare_with_edits(make_docs(corpus, [])).count() == 0
    only = fp.compare_with_edits(make_docs(corpus, ["abcd"])).first()
    assert only.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    rows = fp.compare_with_edits(make_docs(corpus, [(None, "a b"), (None, "a b"), (3, "c"), (3, None)])).collect()
    assert len(rows) == 4
