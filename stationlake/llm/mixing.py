"""Mixing sources to target weights with soft membership.

A naive Bayes classifier over hashed words and word endings is counted from the labelled documents of
the ``labels`` table (a bounded sample, ``FIT_ROWS``); its domains are ``good``, ``poor`` (by quality) and ``toxic``.  It gives
every document a posterior over the domains instead of one label.  Rates by document, not below zero, are then
fitted so that the expected tokens of each domain, the sum of rate times tokens times posterior,
meet the targets: projected gradient descent on the squared misses from rate 1.
Every step is one aggregate of a few numbers over the stored posteriors; a document's rate is an
expression of its posterior and the steps so far.  Among all rates that meet the targets, those near 1 are reached.

Only DataFrame functions are used.  The classifier keeps words whose share in some domain differs clearly from their
share overall, out of 2^18 hash buckets: at most so many rows, which is the bound on what is broadcast.

Defined cases: null or empty text has no tokens, no evidence, and the rate that follows from that;
labels that repeat an id count by their worst values, null labels are not used; without labels all documents belong
to ``good``; null and repeated ids are rows of their own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.llm.registry import query, table
from stationlake.session import stored

DOMAINS = ("good", "poor", "toxic")
# Tokens wanted of each domain, as shares of what the corpus is expected to have of it.
TARGETS = {"good": 1.02, "poor": 0.25, "toxic": 0.1}
# Labelled documents that the classifier is counted from at most: those with the smallest hashes of their ids.
FIT_ROWS = 20_000
BUCKETS = 1 << 18
PRIOR_WORDS = 50.0
CLEAR = 4.0  # standard deviations between a word's share in a domain and overall
EVIDENCE = 60  # words of full weight; more count by the root of their number
STEPS_STORED = 12
MOST_STEPS = 240
CLOSE = 1e-5
STILL = 1e-9


def words(text: Column) -> Column:
    """Words in lower case, cut at ASCII white space."""
    spaced = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\f\r", "     ")
    return F.array_remove(F.split(spaced, " ", -1), "")


def _word_bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _ending_bucket(word: Column) -> Column:
    """The bucket of a word's last two characters, by other bits of the hash than a word of two."""
    return F.pmod(F.shiftright(F.xxhash64(F.substring(word, -2, 2)), 24), F.lit(BUCKETS)).cast("int")


def labelled_domains(labels: DataFrame) -> DataFrame:
    """Id and domain of the labelled documents."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    domain = F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") > 0, "good").otherwise("poor")
    return known.select(F.col("doc_id").alias("_id"), domain.alias("domain"))


def fit_classifier(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, by: str | None = None) -> DataFrame:
    """Evidence for each domain by bucket, at most ``BUCKETS`` rows, from at most ``rows`` labelled ids.

    ``by`` names a column whose values (null is one) differ in their words, such as the language: what is expected of
    a bucket is then summed over them, so that a word is no evidence for the domain that its language has more of.
    """
    chosen = labelled_domains(labels).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    kind = (F.lit(None) if by is None else F.col(by)).cast("string")
    # The sample is bounded by ``rows``, so it can be broadcast whatever the size of the input.
    known = docs.select("doc_id", kind.alias("_kind"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    found = known.select("domain", "_kind", F.explode(words(F.col("text"))).alias("_word"))
    both = F.array(_word_bucket(F.col("_word")), _ending_bucket(F.col("_word")))
    found = found.select("domain", "_kind", F.explode(both).alias("bucket"))
    counted = stored(
        found.groupBy("bucket", "_kind").agg(*(F.count(F.when(F.col("domain") == d, 1)).alias(d) for d in DOMAINS)), "mix-counts"
    )
    seen = sum((F.col(d) for d in DOMAINS[1:]), F.col(DOMAINS[0]))
    sums = counted.groupBy(F.col("_kind").alias("_of")).agg(*(F.sum(d).alias(f"all_{d}") for d in DOMAINS), F.sum(seen).alias("all"))
    everything = counted.agg(F.sum(seen)).first()[0] or 1.0
    # What a domain would hold of a bucket, were its words in each kind those of all documents of the kind.
    parts = counted.join(sums, F.col("_kind").eqNullSafe(F.col("_of")))
    compared = parts.groupBy("bucket").agg(
        *(F.sum(d).alias(d) for d in DOMAINS), (F.sum(seen) / float(everything)).alias("share"),
        *(F.sum(seen / F.col("all") * F.col(f"all_{d}")).alias(f"expected_{d}") for d in DOMAINS),
    )
    evidence, clear = {}, F.lit(False)
    for domain in DOMAINS:
        expected, prior = F.col(f"expected_{domain}"), PRIOR_WORDS * F.col("share")
        clear = clear | (F.abs(F.col(domain) - expected) > CLEAR * F.sqrt(expected))
        evidence[domain] = F.log((F.col(domain) + prior) / (expected + prior))
    return compared.where(clear).select("bucket", *(e.alias(d) for d, e in evidence.items()))


def posteriors(docs: DataFrame, labels: DataFrame, evidence: DataFrame) -> DataFrame:
    """doc_id, n_tokens and a posterior ``p_<domain>`` per row of the documents.

    The prior of a document is the share of the domains among the labelled documents for which its
    evidence, too, speaks most: a document without a toxic word is not as likely toxic as any.
    """
    # Rows are numbered before words become rows.
    found = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", words(F.col("text")).alias("_words"))
    found = found.select("_row", "doc_id", F.size("_words").cast("long").alias("n_tokens"), F.explode_outer("_words").alias("_word"))
    keyed = found.select(
        "_row", "doc_id", "n_tokens", _word_bucket(F.col("_word")).alias("_by_word"), _ending_bucket(F.col("_word")).alias("_by_ending")
    )
    # Evidence has at most one row per hash bucket: a size that no corpus exceeds.
    for key in ("_by_word", "_by_ending"):
        side = evidence.select(F.col("bucket").alias(key), *(F.col(d).alias(f"{key}_{d}") for d in DOMAINS))
        keyed = keyed.join(F.broadcast(side), key, "left")

    def total(domain: str) -> Column:
        parts = [F.coalesce(f"{key}_{domain}", F.lit(0.0)) for key in ("_by_word", "_by_ending")]
        return F.sum(parts[0] + parts[1]).alias(domain)

    hits = F.count(f"_by_word_{DOMAINS[0]}") + F.count(f"_by_ending_{DOMAINS[0]}")
    sums = keyed.groupBy("_row", "doc_id", "n_tokens").agg(hits.alias("n"), *(total(d) for d in DOMAINS))
    # Words are not independent: beyond some evidence, more of it counts by its root only.
    scale = F.when(F.col("n") > EVIDENCE, F.sqrt(EVIDENCE / F.col("n"))).otherwise(1.0)
    largest = F.greatest(*DOMAINS)
    lead = F.lit(DOMAINS[0])
    for domain in DOMAINS[1:]:
        lead = F.when((F.col(domain) == largest) & (F.col(DOMAINS[0]) < largest), domain).otherwise(lead)
    known = stored(sums.select("doc_id", "n_tokens", lead.alias("lead"), *((F.col(d) * scale).alias(d) for d in DOMAINS)), "mix-evidence")
    labelled = known.select("doc_id", "lead").join(labelled_domains(labels), F.col("doc_id") == F.col("_id"))
    shares = {(r["lead"], r["domain"]): r["count"] for r in labelled.groupBy("lead", "domain").count().collect()}
    scores = []
    for domain in DOMAINS:
        prior = F.lit(None).cast("double")
        for seen in DOMAINS:
            total = sum(shares.get((seen, d), 0) for d in DOMAINS)
            share = (shares.get((seen, domain), 0) + 0.5 * (domain == seen)) / (total + 0.5)
            prior = F.when(F.col("lead") == seen, math.log(max(share, 1e-6))).otherwise(prior)
        scores.append(prior + F.col(domain))
    highest = F.greatest(*scores)
    weights = known.select("doc_id", "n_tokens", *(F.exp(s - highest).alias(d) for s, d in zip(scores, DOMAINS, strict=True)))
    total = sum((F.col(d) for d in DOMAINS[1:]), F.col(DOMAINS[0]))
    return weights.select("doc_id", "n_tokens", *((F.col(d) / total).alias(f"p_{d}") for d in DOMAINS))


def fit_rates(soft: DataFrame, targets: dict[str, float]) -> DataFrame:
    """The rows with ``rate`` and ``miss_<domain>``; ``targets`` are shares of each domain's expected tokens.

    The misses, the same in all rows, are what the rates give of a domain's tokens above (or below) its target, as shares
    of the tokens expected of it: near 0 where the targets are met, and not where no rates meet them or the steps ran out.

    A step's gradient is scaled by the domains' overlap among the documents whose rate is not yet 0,
    so a few steps suffice also where posteriors are not sharp.
    """
    tokens = F.col("n_tokens").cast("double")
    pairs = [(a, b) for a in DOMAINS for b in DOMAINS if a <= b]

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(tokens * value), F.lit(0.0))

    current = stored(soft, "mix-posteriors").withColumn("rate", F.lit(1.0))
    natural = current.agg(*(total(F.col(f"p_{d}")).alias(d) for d in DOMAINS)).first()
    rate, pending = F.col("rate"), 0
    before: list[float] = []
    for step in range(MOST_STEPS + 1):
        active = F.when(rate > 0, 1.0).otherwise(0.0)
        now = current.agg(
            *(total(F.col(f"p_{d}") * rate).alias(d) for d in DOMAINS),
            *(total(F.col(f"p_{a}") * F.col(f"p_{b}") * active).alias(f"{a}_{b}") for a, b in pairs),
        ).first()
        misses = [now[d] - targets[d] * natural[d] for d in DOMAINS]
        if step == MOST_STEPS or all(abs(m) <= CLOSE * (natural[d] + 1) for m, d in zip(misses, DOMAINS, strict=True)):
            break
        # A step that moves no miss has arrived: no rates come closer to targets that cannot be met.
        if before and all(abs(m - b) <= STILL * (natural[d] + 1) for m, b, d in zip(misses, before, DOMAINS, strict=True)):
            break
        before = misses
        overlap = np.array([[now[f"{min(a, b)}_{max(a, b)}"] for b in DOMAINS] for a in DOMAINS])
        slopes = np.linalg.solve(overlap + np.eye(len(DOMAINS)) * (1e-6 * np.trace(overlap) + 1e-9), misses)
        fall = sum((F.col(f"p_{d}") * float(s) for d, s in list(zip(DOMAINS, slopes, strict=True))[1:]), F.col(f"p_{DOMAINS[0]}") * float(slopes[0]))
        rate, pending = F.greatest(rate - fall, F.lit(0.0)), pending + 1
        if pending == STEPS_STORED:
            current = stored(current.withColumn("rate", rate), "mix-rates")
            rate, pending = F.col("rate"), 0
    shares = {f"miss_{d}": F.lit(m / natural[d] if natural[d] else 0.0) for m, d in zip(misses, DOMAINS, strict=True)}
    return current.withColumns({"rate": rate, **shares})


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, n_tokens, posteriors and the fitted rate of every document, and the remaining miss of each domain."""
    return fit_rates(posteriors(docs, labels, fit_classifier(docs, labels)), targets)


def apply_rates(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """Documents repeated or left out by their rates; the part of a rate below one is decided by a hash of the id.

    All columns of the documents come back, whatever their names.
    """
    whole = F.struct(*(F.col(f"`{name}`") for name in docs.columns)).alias("row")
    known = docs.select(F.col("doc_id").alias("own_id"), whole)
    by_id = rates.groupBy(F.col("doc_id").alias("rate_id")).agg(F.avg("rate").alias("rate"))
    chance = F.pmod(F.xxhash64(F.lit("mix"), "own_id"), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(F.col("rate") + chance).cast("int")
    joined = known.join(by_id, F.col("own_id").eqNullSafe(F.col("rate_id"))).withColumn("copies", copies)
    repeated = joined.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select("row.*")


@query("op6_mix_sources")
def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "labels"))
