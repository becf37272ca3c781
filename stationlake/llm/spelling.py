"""Spelling variant grouping: words within one edit of each other by pivotal grams.

Words are counted over all texts (combined per task), and their bigrams are ordered by how rare they are among the words.
A word's prefix is its three rarest bigrams, and all others as rare as the third.  Of the prefix, dynamic programming chooses two
disjoint bigrams of the smallest total frequency, the pivots.  One edit leaves one of two disjoint bigrams whole, so of two
near words, a pivot of the one whose prefix ends earlier in the order is in the prefix of the other.

A pivot that survives has the edit on one side of it, so on its other side both words agree: that fixes its
position, from the start or from the end, and what is between it and that end.  Where this is little, the
other side is cut in two, of which the edit leaves one whole.  Prefixes are indexed by these agreed parts and the word's length; pivots look them up for
lengths of one less, the same and one more.  What meets is verified by the edit distance within the join, so only near pairs leave it.

A word's form is the most frequent of its near words if that is frequent enough; forms are followed to the last
one, its root, by pointer jumping over stored tables: each round doubles how far every word has come, and frequency grows
by a factor with every form, so a few rounds do.

Only counts of bigrams by hash (2^16) reach the driver and the tasks, whatever the alphabet; words, pairs and forms stay in
tables.  The lookups of a word are some thirty rows; a part that very many words share is split by the engine's skew joins.

Defined cases: null and empty texts have no words; a null id counts as an empty one; rows that repeat count each; ties go to the
smallest word in code-point order; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.llm.arrow import texts
from stationlake.llm.registry import query, table
from stationlake.session import stored

MIN_LENGTH, MIN_COUNT = 6, 5
# How many times more frequent a form is than the word.
FORM_FACTOR = 5
# One edit destroys bigrams around one place: two disjoint ones are needed, and three always hold two.
PIVOTS, PREFIX = 2, 3
BUCKETS = 1 << 16
# Code points that both words must be known to share before the rest is not cut in two.
LONG_PART = 5
# Different words that a task counts before it passes them on.
HELD_WORDS = 400_000
DROPPED = 199

_run = re.compile("[A-Za-zÀ-ÿ]+")
_lower = bytes(code + 32 if 65 <= code <= 90 else code for code in range(256))


def lowered(text: str) -> str:
    """A-Z in lower case and nothing else changed; no byte of other UTF-8 signs is in that range."""
    return text.encode().translate(_lower).decode()


def with_slips(doc_id: str) -> Callable[[str], str]:
    """The changed form of a document's runs: those whose checksum says so lose a letter."""
    start = zlib.crc32(f"{doc_id}:".encode())

    def change(run: str) -> str:
        check = zlib.crc32(run.encode(), start)
        if check % DROPPED:
            return run
        at = check % len(run)
        return run[:at] + run[at + 1 :]

    return change


def count_words(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
    change: Callable[[str], Callable[[str], str]] | None = None,
) -> DataFrame:
    """word and n: letter runs of all texts that are long and frequent enough.

    ``change`` gives for a document's id a function of its runs, and must not make them longer.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def passed_on() -> pa.RecordBatch:
            columns = [pa.array(held.keys(), pa.string(), size=len(held)), pa.array(held.values(), pa.int64(), size=len(held))]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                own = Counter(found for found in _run.findall(lowered(text)) if len(found) >= min_length)
                if change is None:
                    held.update(own)
                else:
                    changed = change("" if doc_id is None else str(doc_id))
                    for found, n in own.items():
                        word = changed(found)
                        if len(word) >= min_length:
                            held[word] += n
                if len(held) > HELD_WORDS:
                    yield passed_on()
        if held:
            yield passed_on()

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def gram_order(words: DataFrame) -> np.ndarray:
    """Place of every bucket of bigrams in the order, the rarest first."""
    grams = F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda at: F.substring(F.col("word"), at, F.lit(2)))
    numbers = F.transform(grams, lambda gram: F.pmod(F.crc32(gram), F.lit(BUCKETS)).cast("int"))
    counted = words.where("char_length(word) > 1").select(F.explode(numbers).alias("bucket")).groupBy("bucket").count()
    found = np.zeros(BUCKETS, np.int64)
    for row in counted.collect():
        found[row["bucket"]] = row["count"]
    return found * BUCKETS + np.arange(BUCKETS)


def prefix_of(word: str, order: np.ndarray) -> list[tuple[int, int]]:
    """(Order, position) of the bigrams up to the third rarest and its equals, by position."""
    places = [(int(order[bucket(word[at : at + 2])]), at) for at in range(len(word) - 1)]
    if len(places) <= PREFIX:
        return places
    last = sorted(places)[PREFIX - 1][0]
    return [place for place in places if place[0] <= last]


def pivots_of(prefix: list[tuple[int, int]], count: int = PIVOTS) -> list[tuple[int, int]]:
    """Disjoint bigrams of a prefix with the smallest sum of frequencies; all that fit, if fewer than ``count``."""
    # best[k] after a place: cheapest k disjoint bigrams up to it; ``ended`` keeps the row two positions back.
    rows: list[tuple[int, list[tuple[int, tuple[tuple[int, int], ...]] | None]]] = [(-2, [(0, ())] + [None] * count)]
    for place, at in prefix:
        best = list(rows[-1][1])
        apart = next(row for position, row in reversed(rows) if position <= at - 2)
        for k in range(1, count + 1):
            if apart[k - 1] is not None:
                cost, chosen = apart[k - 1]
                option = (cost + place // BUCKETS, (*chosen, (place, at)))
                if best[k] is None or option < best[k]:
                    best[k] = option
        rows.append((at, best))
    return list(next(found[1] for found in reversed(rows[-1][1]) if found is not None))


def agreed_parts(word: str, at: int, length: int) -> list[str]:
    """What a word of ``length`` must share with this one if the bigram at a position survives in both.

    Each part tells where it lies, so that equal parts mean equal positions.
    """
    n, parts = len(word), []
    # The edit is behind the bigram: everything up to its end agrees.
    rest = length - at - 2
    if at + 2 >= LONG_PART or rest < 2:
        if rest >= 0:
            parts.append(f"{length} {word[: at + 2]}")
    else:
        half = rest // 2
        parts.append(f"{length} {at}a{word[: at + 2 + half]}")
        parts.append(f"{length} {at}b{word[: at + 2]} {word[n - (rest - half) :]}")
    # The edit is before the bigram: everything from its start on agrees.
    rest = length - (n - at)
    if n - at >= LONG_PART or rest < 2:
        if rest >= 0:
            parts.append(f"{length}-{word[at:]}")
    else:
        half = rest // 2
        parts.append(f"{length}-{n - at}a{word[at:]} {word[:half]}")
        parts.append(f"{length}-{n - at}b{word[at - (rest - half) :]}")
    return parts


def _lookups(words: DataFrame, order, pivots: bool) -> DataFrame:
    """Keys of the agreed parts: of prefixes for the own length, or of pivots for all lengths within one edit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = order.value
        for batch in batches:
            for start in range(0, batch.num_rows, 4000):
                part = batch.slice(start, 4000)
                keys, lasts, rows = [], [], []
                for row, word in enumerate(part.column(0).to_pylist()):
                    prefix = prefix_of(word, places)
                    last = max((place for place, _ in prefix), default=0)
                    grams, lengths = prefix, (len(word),)
                    if pivots:
                        grams, lengths = pivots_of(prefix), (len(word) - 1, len(word), len(word) + 1)
                    own = {xxhash.xxh64_intdigest(p.encode()) for _, at in grams for m in lengths for p in agreed_parts(word, at, m)}
                    keys += own
                    lasts += [last] * len(own)
                    rows += [row] * len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(keys, np.uint64).view(np.int64)), part.column(0).take(pa.array(rows, pa.int64())), pa.array(lasts, pa.int64())],
                    names=["key", "word", "last"],
                )

    return words.select("word").mapInArrow(run, "key long, word string, last long")


def near_pairs(words: DataFrame) -> DataFrame:
    """word and other, both ways: all words that differ by one inserted, deleted or replaced code point.

    Words have at least four code points, so that their three rarest bigrams hold two disjoint ones.
    """
    if words.where("char_length(word) < 4").take(1):
        raise ValueError("Words of fewer than four code points have no two disjoint bigrams in every prefix")
    order = words.sparkSession.sparkContext.broadcast(gram_order(words))
    asked = _lookups(words, order, pivots=True)
    held = _lookups(words, order, pivots=False).select("key", F.col("word").alias("other"), F.col("last").alias("other_last"))
    # Distinct words are at least one edit apart, and those within it exactly one.
    near = asked.join(
        held.hint("merge"),
        (asked["key"] == held["key"]) & (F.col("last") <= F.col("other_last")) & (F.col("word") != F.col("other"))
        & (F.levenshtein("word", "other", 1) == 1),
    ).select("word", "other")
    return near.unionByName(near.select(F.col("other").alias("word"), F.col("word").alias("other"))).distinct()


def forms(words: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """word, form, n, n_near and form_n for words with their counts."""
    pairs = near_pairs(words)
    sizes = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = pairs.join(sizes, "other").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    joined = words.select("word", "n").join(best, "word", "left")
    enough = -F.col("best.less") >= factor * F.col("n")
    return joined.select(
        "word", F.when(enough, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )


def roots(formed: DataFrame) -> DataFrame:
    """word and root of all words that have a form: the end of their forms."""
    steps = stored(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while steps.where("moved").take(1):
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = steps.select("word", "root").join(further, "root", "left")
        steps = stored(
            joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots"
        )
    return steps.select("word", "root")


def group_variants(words: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    formed = stored(forms(words, factor), "spelling-forms")
    joined = formed.join(roots(formed), "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = stored(count_words(table(spark, folder, "documents"), change=with_slips), "spelling-words")
    return group_variants(words)
