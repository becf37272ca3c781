"""Quality rules: statistics of every document, fixed base rules, and boosted trees for the rest.

Statistics are computed per document in Arrow batches (no shuffle).  The trees are fitted on
the driver from a bounded sample of labelled rows (``FIT_ROWS``, those with the smallest
hashes of their ids, so that the choice does not depend on the layout of the input) and
then flattened into numpy node arrays that every task walks level by level for a whole batch.
On the features in ``DIRECTIONS`` the score cannot rise (-1) or fall (+1): a split that breaks
the order of its two sides is not taken, and children inherit the middle as a bound.

Defined cases: null text has no words and fails the base rules; labels with a null id or
quality are not used; without labels of both kinds the trees are empty and every document
that passes the base rules stays; an empty table gives an empty table; other columns are ignored
and repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.llm.arrow import texts
from stationlake.llm.registry import query, table

FIT_ROWS = 20_000
SYMBOLS = b"#*$%&|<>"
MINIMUM_WORDS = 50
REPEAT_PERCENT = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "n_words", "word_chars_mean", "symbol_share", "dup_line_share", "repeat_share", "distinct_share",
    "upper_share", "digit_share", "punctuation_share", "line_words", "adjacent_share", "top_word_share",
    "lone_symbol_share",
)
# The score may only fall as these grow.
DIRECTIONS = {"symbol_share": -1, "repeat_share": -1, "dup_line_share": -1, "adjacent_share": -1, "upper_share": -1}

_SPACES = b" \t\n\x0b\x0c\r"
_ALL_BYTES = bytes(range(256))
_NOT_SYMBOLS = bytes(set(_ALL_BYTES) - set(SYMBOLS))
_NOT_UPPER = bytes(set(_ALL_BYTES) - set(range(65, 91)))
_NOT_DIGITS = bytes(set(_ALL_BYTES) - set(range(48, 58)))
_NOT_PUNCTUATION = bytes(set(_ALL_BYTES) - set(b"!?.,;:-()[]{}'\"/"))


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Each word as the number of its first occurrence among the distinct words."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def repeated_words(numbers: np.ndarray) -> int:
    """Words that lie in a window of three words found at least twice in the text."""
    if len(numbers) < 4:
        return 0
    pairs = numbers[:-1] * (int(numbers.max()) + 1) + numbers[1:]
    _, pairs = np.unique(pairs, return_inverse=True)
    windows = pairs[:-1] * (int(numbers.max()) + 1) + numbers[2:]
    _, which, count = np.unique(windows, return_inverse=True, return_counts=True)
    again = count[which] > 1
    inside = np.zeros(len(numbers), bool)
    for shift in range(3):
        inside[shift : shift + len(again)] |= again
    return int(inside.sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The counts of ``COUNTS`` and the values of ``FEATURES`` of one text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, _SPACES))
    chars = len(text) - spaces
    symbols = len(raw.translate(None, _NOT_SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeats = len(lines) - len(set(lines))
    numbers = word_numbers(words)
    inside = repeated_words(numbers)
    counts = [n, chars, symbols, repeats, inside]
    if not n:
        return counts, [0.0] * len(FEATURES)
    uses = np.bincount(numbers)
    return counts, [
        float(n), chars / n, symbols / chars, repeats / len(lines), inside / n, len(uses) / n,
        len(raw.translate(None, _NOT_UPPER)) / chars, len(raw.translate(None, _NOT_DIGITS)) / chars,
        len(raw.translate(None, _NOT_PUNCTUATION)) / chars, n / len(lines),
        float(np.count_nonzero(numbers[1:] == numbers[:-1])) / n, float(uses.max()) / n,
        sum(map(words.count, (b"|", b"-", b"*"))) / n,
    ]


@dataclass
class Trees:
    """Boosted trees as node arrays: one row per tree, one column per node of a full binary tree."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, values: np.ndarray) -> np.ndarray:
        """Log-odds of good quality for a matrix of features."""
        total = np.full(len(values), self.base)
        rows = np.arange(len(values))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(values), np.int64)
            for _ in range(int(np.log2(len(value) + 1)) - 1):
                node = 2 * node + 1 + (values[rows, feature[node]] > threshold[node])
            total += value[node]
        return total


def fit(
    values: np.ndarray, good: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2,
    directions: dict[str, int] = DIRECTIONS, least: float = 5.0, ridge: float = 1.0, bins: int = 64,
) -> Trees:
    """Gradient-boosted trees on the logistic loss with monotone bounds."""
    size = 2 ** (depth + 1) - 1
    share = float(good.mean()) if len(good) else 1.0
    empty = Trees(9.0 if share >= 0.5 else -9.0, *(np.zeros((0, size)) for _ in range(3)))
    if not len(good) or share in (0.0, 1.0):
        return empty
    sign = np.array([directions.get(name, 0) for name in FEATURES])
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in values.T]
    binned = np.stack([np.searchsorted(c, column) for c, column in zip(cuts, values.T, strict=True)], 1)
    made = Trees(float(np.log(share / (1 - share))), np.zeros((trees, size), np.int64),
                 np.full((trees, size), np.inf), np.zeros((trees, size)))
    score = np.full(len(good), made.base)
    for number in range(trees):
        chance = 1 / (1 + np.exp(-score))
        gradient, weight = good - chance, chance * (1 - chance)
        node = np.zeros(len(good), np.int64)
        low, high = np.full(size, -np.inf), np.full(size, np.inf)
        weights = np.zeros(size)
        for at in range(size):
            here = node == at
            weights[at] = np.clip(gradient[here].sum() / (weight[here].sum() + ridge), low[at], high[at])
            if at >= size // 2:
                continue
            split = _best_split(binned[here], gradient[here], weight[here], sign, low[at], high[at], least, ridge, bins)
            left, right = 2 * at + 1, 2 * at + 2
            low[left], high[left], low[right], high[right] = low[at], high[at], low[at], high[at]
            if split is None:
                node[here] = left
                continue
            column, cut, left_value, right_value = split
            made.feature[number, at] = column
            made.threshold[number, at] = cuts[column][cut]
            node[here] = np.where(binned[here, column] <= cut, left, right)
            middle = (left_value + right_value) / 2
            if sign[column] > 0:
                high[left], low[right] = min(high[left], middle), max(low[right], middle)
            elif sign[column] < 0:
                low[left], high[right] = max(low[left], middle), min(high[right], middle)
        made.value[number] = rate * weights
        score += made.value[number][node]
    return made


def _best_split(binned, gradient, weight, sign, low, high, least, ridge, bins):
    """Column, bin and side values of the split with the largest gain, or None."""
    best, total_g, total_w = None, gradient.sum(), weight.sum()
    most = total_g**2 / (total_w + ridge) + 1e-6
    for column in range(binned.shape[1]):
        g = np.cumsum(np.bincount(binned[:, column], gradient, bins))[:-1]
        w = np.cumsum(np.bincount(binned[:, column], weight, bins))[:-1]
        left, right = g / (w + ridge), (total_g - g) / (total_w - w + ridge)
        left, right = np.clip(left, low, high), np.clip(right, low, high)
        gain = g**2 / (w + ridge) + (total_g - g) ** 2 / (total_w - w + ridge)
        fair = (w >= least / 4) & (total_w - w >= least / 4) & (sign[column] * (right - left) >= 0)
        gain = np.where(fair, gain, -np.inf)
        cut = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[cut] > most:
            most, best = gain[cut], (column, cut, left[cut], right[cut])
    return best


def fit_on_labels(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Trees:
    """Trees fitted on at most ``rows`` labelled documents; only their features reach the driver."""
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # The sample is bounded by ``rows``, so it can be broadcast whatever the size of the input.
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(text)[1] for text in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.float64()))],
                names=["doc_id", "quality", "features"],
            )

    kind = chosen.schema["quality"].dataType.simpleString()
    table_ = known.mapInArrow(run, f"doc_id bigint, quality {kind}, features array<double>").toArrow()
    table_ = table_.sort_by("doc_id")
    values = np.array(table_["features"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(values, np.array(table_["quality"].to_pylist(), float))


def judge(docs: DataFrame, trees: Trees, least_score: float = 0.0) -> DataFrame:
    """Counts, base verdict, score and final verdict of every document."""
    content = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(text) for text in texts(batch.column(1))]
            if not found:
                continue
            counts = np.array([c for c, _ in found], np.int64)
            score = content.value.score(np.array([v for _, v in found]))
            n, inside = counts[:, 0], counts[:, 4]
            failed = (n < MINIMUM_WORDS) | (100 * inside > REPEAT_PERCENT * n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(score),
                 pa.array(~failed & (score >= least_score))],
                names=["doc_id", *COUNTS, "base_failed", "score", "kept"],
            )

    schema = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)
    needed = docs.select(F.col("doc_id").cast("bigint"), "text")
    return needed.mapInArrow(run, f"{schema}, base_failed boolean, score double, kept boolean")


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return judge(docs, fit_on_labels(docs, table(spark, folder, "labels")))
