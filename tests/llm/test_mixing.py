"""Mixing: posteriors, targets and what rates do to documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from stationlake.llm import mixing as mx
from tests.llm.conftest import make_docs, make_labels


def make_corpus(spark):
    chance = random.Random(9)
    usual, rude = [f"w{n}" for n in range(60)], ["dolt", "oaf"]
    rows, labels = [], []
    for n in range(300):
        kind = ("good", "good", "good", "poor", "toxic")[n % 5]
        words = chance.choices(usual, k=chance.randint(20, 80))
        if kind == "poor":
            words = [f"{w}!!" for w in words]
        if kind == "toxic":
            words[3:3] = chance.choices(rude, k=3)
        rows.append((n, " ".join(words)))
        if n % 2:
            labels.append((n, int(kind != "poor"), int(kind == "toxic")))
    return make_docs(spark, rows), make_labels(spark, labels)


def test_targets_are_met(corpus):
    docs, labels = make_corpus(corpus)
    wanted = {"good": 1.1, "poor": 0.3, "toxic": 0.2}
    rows = mx.mix(docs.selectExpr("*", "1 as rate", "'x' as domain"), labels, wanted).collect()
    assert len(rows) == 300
    for domain, share in wanted.items():
        tokens = np.array([r.n_tokens * r[f"p_{domain}"] for r in rows])
        assert abs((tokens * [r.rate for r in rows]).sum() / tokens.sum() - share) < 1e-3
    assert min(r.rate for r in rows) >= 0
    kinds = ("good", "good", "good", "poor", "toxic")
    right = sum(max(mx.DOMAINS, key=lambda d: r[f"p_{d}"]) == kinds[r.doc_id % 5] for r in rows if r.doc_id % 2 == 0)
    assert right >= 145
    assert all(abs(sum(r[f"p_{d}"] for d in mx.DOMAINS) - 1) < 1e-9 for r in rows)


def plain_bucket(word, bits):
    number = xxhash.xxh64_intdigest(word.encode(), seed=42)
    number -= (number >> 63) << 64
    return (number >> bits) % mx.BUCKETS


def plain_words(text):
    return [w for w in re.split("[ \t\n\x0b\f\r]+", (text or "").lower()) if w]


def plain_posteriors(docs, labels):
    """Naive Bayes by the letter of the module, one document after the other."""
    domain = {i: "toxic" if t else "good" if q else "poor" for i, q, t in labels}
    counts = {d: Counter() for d in mx.DOMAINS}
    keys = {i: [b for w in plain_words(text) for b in (plain_bucket(w, 0), plain_bucket(w[-2:], 24))] for i, text in docs}
    for i, found in keys.items():
        if i in domain:
            counts[domain[i]].update(found)
    sums = {d: sum(c.values()) for d, c in counts.items()}
    total = sum(sums.values()) or 1.0
    evidence = {}
    for bucket in set().union(*counts.values()):
        share = sum(c[bucket] for c in counts.values()) / total
        if any(abs(counts[d][bucket] - share * sums[d]) > mx.CLEAR * math.sqrt(share * sums[d]) for d in mx.DOMAINS):
            evidence[bucket] = {
                d: math.log((counts[d][bucket] + mx.PRIOR_WORDS * share) / ((sums[d] + mx.PRIOR_WORDS) * share)) for d in mx.DOMAINS
            }
    said, leads = {}, {}
    for i, found in keys.items():
        hits = [evidence[b] for b in found if b in evidence]
        scale = math.sqrt(mx.EVIDENCE / len(hits)) if len(hits) > mx.EVIDENCE else 1.0
        said[i] = {d: scale * math.fsum(h[d] for h in hits) for d in mx.DOMAINS}
        leads[i] = max(mx.DOMAINS, key=lambda d: said[i][d])
        if said[i]["good"] >= max(said[i].values()):
            leads[i] = "good"
    result = {}
    for i in keys:
        seen = Counter(domain[j] for j in domain if j in leads and leads[j] == leads[i])
        scores = {}
        for d in mx.DOMAINS:
            prior = (seen[d] + 0.5 * (d == leads[i])) / (sum(seen.values()) + 0.5)
            scores[d] = math.log(max(prior, 1e-6)) + said[i][d]
        weights = {d: math.exp(v - max(scores.values())) for d, v in scores.items()}
        result[i] = {d: w / sum(weights.values()) for d, w in weights.items()}
    return result


def test_posteriors_and_rates_equal_a_plain_computation(corpus):
    docs, labels = make_corpus(corpus)
    extra = make_docs(corpus, [(900, None), (901, ""), (902, "dolt " * 30_000), (903, "W1\tw2\x0bw3  w4\n\rw5 éÉ x")])
    docs = docs.unionByName(extra)
    rows = {r.doc_id: r for r in mx.mix(docs, labels).collect()}
    right = plain_posteriors([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    for doc_id, row in rows.items():
        for domain in mx.DOMAINS:
            assert abs(row[f"p_{domain}"] - right[doc_id][domain]) < 1e-9
    assert rows[902].n_tokens == 30_000 and rows[903].n_tokens == 7 and rows[900].n_tokens == rows[901].n_tokens == 0
    # The rates are those of projected steps from 1 that end where the targets are met: no step leads further.
    tokens = np.array([r.n_tokens for r in rows.values()], float)
    soft = np.array([[right[i][d] for d in mx.DOMAINS] for i in rows])
    natural = tokens @ soft
    rate = np.ones(len(rows))
    for _ in range(500):
        misses = (tokens * rate) @ soft - natural * [mx.TARGETS[d] for d in mx.DOMAINS]
        overlap = (soft * (tokens * (rate > 0))[:, None]).T @ soft
        rate = np.maximum(rate - soft @ np.linalg.solve(overlap + np.eye(3) * (1e-6 * np.trace(overlap) + 1e-9), misses), 0)
    assert np.allclose([r.rate for r in rows.values()], rate, atol=1e-3)


def test_only_the_sample_of_labels_is_counted(corpus):
    docs, labels = make_corpus(corpus)
    few = {r.bucket for r in mx.fit_classifier(docs, labels, rows=40).collect()}
    many = {r.bucket for r in mx.fit_classifier(docs, labels).collect()}
    assert few != many and mx.fit_classifier(docs.repartition(7), labels.repartition(3), rows=40).count() == len(few)


def test_clashing_columns_come_back(corpus):
    docs = make_docs(corpus, ["a b", "c d"]).selectExpr("*", "1 as rate", "2 as _rate", "3 as copies", "4 as row", "5 as `a.b`", "6 as col")
    rates = docs.select("doc_id", F.lit(2.0).alias("rate"))
    rows = mx.apply_rates(docs, rates)
    assert rows.columns == docs.columns and rows.count() == 4
    assert {tuple(r)[5:] for r in rows.collect()} == {(1, 2, 3, 4, 5, 6)}


def test_rates_take_effect(corpus):
    docs = make_docs(corpus, ["a"] * 1000 + [(None, "b")])
    rates = docs.select("doc_id", F.when(F.col("doc_id") < 500, 0.25).otherwise(1.5).alias("rate"))
    count = {r.doc_id: r["count"] for r in mx.apply_rates(docs, rates).groupBy("doc_id").count().collect()}
    assert 80 < sum(count.get(n, 0) for n in range(500)) < 170
    assert 690 < sum(count[n] for n in range(500, 1000)) < 810
    assert mx.apply_rates(docs, rates).columns == docs.columns


def test_edges(corpus):
    docs = make_docs(corpus, [(1, "a b"), (1, "a b"), (None, None), (2, "")])
    rows = mx.mix(docs, make_labels(corpus, [])).collect()
    assert len(rows) == 4 and all(r.p_good > 0.99 for r in rows)
    assert mx.mix(make_docs(corpus, []), make_labels(corpus, [(1, 1, 0)])).count() == 0
    assert mx.mix(docs, make_labels(corpus, [(1, 0, None), (1, 1, 1), (None, 1, 1)])).count() == 4


def test_misses_are_returned(corpus):
    assert mx.TARGETS["poor"] <= 0.25 and mx.TARGETS["toxic"] <= 0.1
    docs, labels = make_corpus(corpus)
    met = mx.mix(docs, labels).first()
    assert all(abs(met[f"miss_{d}"]) < 1e-3 for d in mx.DOMAINS)
    # One posterior for all documents: one rate cannot meet three targets.
    soft = corpus.createDataFrame([(n, 10, 0.5, 0.3, 0.2) for n in range(4)], "doc_id long, n_tokens long, p_good double, p_poor double, p_toxic double")
    rows = mx.fit_rates(soft, {"good": 1.0, "poor": 0.25, "toxic": 0.1}).collect()
    for domain, target in (("good", 1.0), ("poor", 0.25), ("toxic", 0.1)):
        assert abs(rows[0][f"miss_{domain}"] - (rows[0].rate - target)) < 1e-6
    assert max(abs(rows[0][f"miss_{d}"]) for d in mx.DOMAINS) > 0.1


def test_evidence_by_language_equals_a_plain_computation(corpus):
    chance = random.Random(4)
    own = {"en": [f"e{n}" for n in range(30)], "de": [f"d{n}" for n in range(30)], None: ["e1", "d1", "x"]}
    rows, labels, kinds = [], [], {}
    for n in range(240):
        lang = ("en", "en", "de", None)[n % 4]
        # Most toxic documents are in one language.
        kinds[n] = "poor" if n % 9 == 4 else "toxic" if chance.random() < (0.6 if lang == "de" else 0.1) else "good"
        words = chance.choices(own[lang] + ["both"], k=40) + {"toxic": ["dolt"] * 3, "poor": ["!!"] * 3, "good": []}[kinds[n]]
        rows.append((n, " ".join(words), lang))
        labels.append((n, int(kinds[n] != "poor"), int(kinds[n] == "toxic")))
    docs, known = corpus.createDataFrame(rows, "doc_id long, text string, lang string"), make_labels(corpus, labels)
    counts, kept = Counter(), {}
    for n, text, lang in rows:
        counts.update((b, lang, kinds[n]) for w in plain_words(text) for b in (plain_bucket(w, 0), plain_bucket(w[-2:], 24)))
    of = {(lang, d): sum(c for (_, at, e), c in counts.items() if (at, e) == (lang, d)) for lang in own for d in mx.DOMAINS}
    size = {lang: sum(of[lang, d] for d in mx.DOMAINS) for lang in own}
    for bucket in {b for b, _, _ in counts}:
        seen = {lang: sum(counts[bucket, lang, d] for d in mx.DOMAINS) for lang in own}
        prior = mx.PRIOR_WORDS * sum(seen.values()) / sum(size.values())
        held = {d: sum(counts[bucket, lang, d] for lang in own) for d in mx.DOMAINS}
        expected = {d: sum(seen[lang] / size[lang] * of[lang, d] for lang in own) for d in mx.DOMAINS}
        if any(abs(held[d] - expected[d]) > mx.CLEAR * math.sqrt(expected[d]) for d in mx.DOMAINS):
            kept[bucket] = {d: math.log((held[d] + prior) / (expected[d] + prior)) for d in mx.DOMAINS}
    found = {r.bucket: r for r in mx.fit_classifier(docs, known, by="lang").collect()}
    assert found.keys() == kept.keys() and all(abs(found[b][d] - kept[b][d]) < 1e-9 for b in kept for d in mx.DOMAINS)
    words = {plain_bucket(w, 0) for w in own["de"]}
    assert not words & found.keys() and len(words & {r.bucket for r in mx.fit_classifier(docs, known).collect()}) > 20
    assert {plain_bucket("dolt", 0), plain_bucket("!!", 0)} <= found.keys()
