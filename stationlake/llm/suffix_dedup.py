"""Removal of repeated byte strings by prefix doubling over sampled suffixes.

A suffix's rank at depth 2k is that of the pair (rank at k here, rank at k further on).  Ranks are
taken as 64-bit names of the content, which are the same in every task, so the first doublings up to
depth 32 need no exchange.  At depth 32, Spark sorts for the first time, but not every position: of the 69
strings of 32 bytes in a string of 100, the smallest name (the leftmost of equals) speaks for it.
Equal strings have the same speaker at the same distance, so strings of 100 bytes that start next to each other
and share a speaker form a run, and runs can be compared instead of positions (one per 35 bytes).

Sorted by speaker, a run whose speaker is unique is done: none of its strings occurs elsewhere.  A run that is
equal to an earlier one is done too: all its strings occur earlier.  What is left are runs with a known speaker
but other bytes around it.  They are doubled to depth 64 and sorted again in the same way, with speakers of 64
bytes.  What is still left is ranked by pairs of names of depth 64 at distance 36: the rank at depth 100, the
threshold.  Spark sorts these pairs, and every position but the first of a rank starts a string that occurs earlier.

Each task sends one row per different run and batch; equal runs of the same batch are decided there.  A
speaker with very many different runs in a batch (a common line) sends one row, and its runs go
straight to the next depth.  So no key gathers more than a few rows per batch.  The text is exchanged by id once, and that
exchange serves the doublings and the removal.

Names are 64 bits at depth 32 and pairs of 64 bits at depth 100; the chance of a wrong one
grows with the square of the compared runs, 2e-5 for 20 million.

Defined cases: null text is empty; texts of fewer than ``DEPTH`` bytes are kept; rows with a null id stay whole and
count for nobody; rows that repeat an id and its text count as one occurrence and are treated alike; rows that repeat an id with
another text are texts of their own, in the order of a digest; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stationlake.llm.arrow import slices
from stationlake.llm.registry import query, table
from stationlake.session import stored

DEPTH = 100
# Depths of the first two sorts.
SPEAKERS = (32, 64)
# Different runs of one speaker in a batch beyond which they go to the next depth at once.
MANY_RUNS = 32
# Strings handled at a time, so that memory does not grow with the length of a text.
PIECE = 1 << 20

_BYTES = np.random.RandomState(5).randint(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# A run's text among those of one id (a digest), first position and length (under 128) travel as one number.
LENGTH_BITS, FIRST_BITS, TWIN_BITS = 7, 31, 25
LENGTHS, FIRSTS = (1 << LENGTH_BITS) - 1, (1 << FIRST_BITS) - 1
TWIN_SHIFT = LENGTH_BITS + FIRST_BITS

_ODD, _MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def pair(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    mixed = one * _ODD + two
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MORE
    mixed ^= mixed >> np.uint64(32)
    return mixed


def names(content: np.ndarray, depth: int) -> np.ndarray:
    """Names of the strings of ``depth`` bytes (a power of two) from every position on."""
    found = _BYTES[content]
    step = 1
    while step < depth:
        found = pair(found[:-step], found[step:])
        step *= 2
    return found


def runs(
    content: np.ndarray, depth: int, speaker: int, wanted: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Speaker names, content names, first positions and lengths of the runs of a text (at wanted positions)."""
    parts = []
    for at in range(0, max(1, len(content) - depth + 1), PIECE):
        here = None if wanted is None else wanted[at : at + PIECE]
        parts.append(_piece_runs(content[at : at + PIECE + depth - 1], at, depth, speaker, here))
    return tuple(np.concatenate(columns) for columns in zip(*parts, strict=True))


def _piece_runs(content: np.ndarray, offset: int, depth: int, speaker: int, wanted: np.ndarray | None):
    strings = len(content) - depth + 1
    if strings < 1:
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, np.int64), np.zeros(0, np.int64)
    half = names(content, speaker // 2)
    at_speaker = pair(half[: -(speaker // 2)], half[speaker // 2 :])
    # High halves of the names with the position below them: the smallest is the leftmost of the smallest.
    least = (at_speaker & ~np.uint64(0xFFFFFFFF)) | np.arange(len(at_speaker), dtype=np.uint64)
    width, reach = depth - speaker + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: reach - width], least[width - reach :])
    speakers = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    places = np.arange(strings) if wanted is None else np.flatnonzero(wanted)
    new = np.ones(len(places), bool)
    new[1:] = (speakers[places[1:]] != speakers[places[:-1]]) | (places[1:] != places[:-1] + 1)
    starts = np.flatnonzero(new)
    first, last = places[starts], places[np.append(starts[1:], len(places))[: len(starts)] - 1]
    # First and last string cover the run; with their distance they name its content.
    longer = at_speaker if speaker == 64 else pair(at_speaker[:-32], at_speaker[32:])
    ends = depth - 64
    whole = pair(pair(longer[first], longer[first + ends]), pair(longer[last], longer[last + ends]))
    whole = pair(whole, (last - first).astype(np.uint64))
    return at_speaker[speakers[first]], whole, first + offset, last - first + 1


def positions(own: list[int], strings: int) -> np.ndarray:
    """Which positions lie in some runs, given as places (first position and length in one number)."""
    wanted = np.zeros(max(0, strings), bool)
    for place in own:
        first = place >> LENGTH_BITS & FIRSTS
        wanted[first : first + (place & LENGTHS)] = True
    return wanted


def twin() -> Column:
    """Digest of a text that tells rows of one id apart; two texts of one id share it with a chance of 3e-8."""
    return F.shiftrightunsigned(F.xxhash64("text"), 64 - TWIN_BITS)


def _contents(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each text."""
    column = column.cast(pa.large_binary())
    for value in column:
        buffer = value.as_buffer() if value.is_valid else None
        yield np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)


def _first_rows(keys: list[np.ndarray], doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a row is the earliest (by document and position) of its keys; equal rows are all the earliest."""
    order = np.lexsort((at, doc, *keys))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    leader = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    first = np.empty(len(order), bool)
    first[order] = (doc[order] == doc[leader]) & (at[order] == at[leader])
    return first


def sampled_runs(docs: DataFrame, depth: int, speaker: int, within: bool = False) -> DataFrame:
    """Runs of all texts: speaker, whole, doc_id, place, and what the batch knows already.

    ``docs`` has doc_id, text, twin, and ``within`` is for runs besides: only positions in these count.  ``state`` is 0 for a row to
    compare, 1 for a run equal to an earlier one of its batch, 2 for a run to look at more
    deeply, and 3 for a row that only tells that its speaker has many runs.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            lists = batch.column(3).to_pylist() if within else [None] * batch.num_rows
            parts = [
                runs(content, depth, speaker, positions(own, len(content) - depth + 1) if within else None)
                for content, own in zip(_contents(batch.column(1)), lists, strict=True)
            ]
            said, whole, first, length = (np.concatenate(columns) for columns in zip(*parts, strict=True))
            counts = [len(part[0]) for part in parts]
            doc = np.repeat(batch.column(0).to_numpy(), counts)
            first = first | np.repeat(batch.column(2).to_numpy(), counts) << FIRST_BITS
            state = np.where(_first_rows([whole, said], doc, first), 0, 1).astype(np.int8)
            sent = np.flatnonzero(state == 0)
            found, which, count = np.unique(said[sent], return_inverse=True, return_counts=True)
            many = count > MANY_RUNS
            state[sent[many[which]]] = 2
            # One row per such speaker tells the others of it.
            extra = sent[np.unique(which, return_index=True)[1][many]]
            rows = np.concatenate([np.arange(len(state)), extra])
            states = np.concatenate([state, np.full(len(extra), 3, np.int8)])
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(said.view(np.int64)[rows]), pa.array(whole.view(np.int64)[rows]), pa.array(doc[rows]),
                     pa.array((first << LENGTH_BITS | length)[rows]), pa.array(states)],
                    names=["speaker", "whole", "doc_id", "place", "state"],
                )

    return docs.mapInArrow(run, "speaker long, whole long, doc_id long, place long, state tinyint")


def judged_runs(found: DataFrame) -> DataFrame:
    """Runs (doc_id, place, later): equal to an earlier run, or else to be checked at full depth."""
    # Rows that are decided keep out of the way of their speaker's others.
    key = F.when(F.col("state").isin(0, 3), F.col("speaker")).otherwise(F.xxhash64("doc_id", "place"))
    keyed = found.withColumns({"key": key, "open": F.col("state").isin(0, 3)}).repartition("key")
    same_speaker = Window.partitionBy("key", "open")
    same_run = Window.partitionBy("key", "open", "whole", "state").orderBy("doc_id", "place")
    marked = keyed.withColumns({
        "several": (F.min("whole").over(same_speaker) != F.max("whole").over(same_speaker))
        | (F.max("state").over(same_speaker) == 3),
        "rank": F.rank().over(same_run),
    })
    later = (F.col("state") == 1) | ((F.col("state") == 0) & (F.col("rank") > 1))
    check = (F.col("state") == 2) | ((F.col("state") == 0) & F.col("several"))
    return marked.where("state <> 3").where(later | check).select("doc_id", "place", later.alias("later"))


def later_strings(with_runs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Places (doc_id, place) of checked strings that occur earlier, from texts with their runs to check."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for doc_id, content, own_twin, own in zip(
                batch.column(0).to_pylist(), _contents(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True
            ):
                at = np.flatnonzero(positions(own, len(content) - depth + 1))
                for start in range(0, len(content) - depth + 1, PIECE):
                    here = at[(at >= start) & (at < start + PIECE)]
                    if len(here):
                        longer = names(content[start : start + PIECE + depth - 1], 64)
                        one, two = longer[here - start], longer[here - start + depth - 64]
                        place = here | own_twin << FIRST_BITS
                        for column, value in zip(columns, (one, two, np.full(len(here), doc_id), place), strict=True):
                            column.append(value)
            if not columns[0]:
                continue
            one, two, doc, at = map(np.concatenate, columns)
            sent = _first_rows([one, two], doc, at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(doc.astype(np.int64)),
                 pa.array(at << LENGTH_BITS | 1), pa.array(sent)],
                names=["one", "two", "doc_id", "place", "sent"],
            )

    pairs = with_runs.mapInArrow(run, "one long, two long, doc_id long, place long, sent boolean")
    apart = F.when(F.col("sent"), F.col("one")).otherwise(F.xxhash64("doc_id", "place"))
    same = Window.partitionBy("key", "two", "sent").orderBy("doc_id", "place")
    ranked = pairs.select("two", "doc_id", "place", "sent", apart.alias("key")).withColumn("rank", F.rank().over(same))
    return ranked.where("NOT sent OR rank > 1").select("doc_id", "place")


def remove_repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_bytes, kept bytes and removed byte spans of every document."""
    needed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", twin().alias("twin"))
    known = needed.where("doc_id IS NOT NULL")
    judged = stored(judged_runs(sampled_runs(known, depth, SPEAKERS[0])), "repeated-runs")
    by_id = known.repartition("doc_id", "twin")

    def lists(rows: DataFrame) -> DataFrame:
        own = F.shiftright("place", TWIN_SHIFT).alias("twin")
        return rows.groupBy("doc_id", own).agg(F.collect_list("place").alias("runs"))

    def at(rows: DataFrame) -> DataFrame:
        return by_id.join(lists(rows), ["doc_id", "twin"]).select("doc_id", "text", "twin", "runs")

    # Both what is decided and what is not are needed, so the second sort is kept, too.
    deeper = stored(judged_runs(sampled_runs(at(judged.where("NOT later")), depth, SPEAKERS[1], within=True)), "deeper-runs")
    strings = later_strings(at(deeper.where("NOT later")), depth)
    found = judged.where("later").drop("later").unionByName(deeper.where("later").drop("later")).unionByName(strings)
    gone = lists(found)
    joined = by_id.join(gone, ["doc_id", "twin"], "left").select("doc_id", "text", "runs")
    nobody = needed.where("doc_id IS NULL").select("doc_id", "text", F.lit(None).cast(gone.schema["runs"].dataType).alias("runs"))
    span = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept, spans = [], [], []
            for content, own in zip(_contents(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                sizes.append(len(content))
                if not own:
                    kept.append(content.tobytes())
                    spans.append([])
                    continue
                change = np.zeros(len(content) + 1, np.int32)
                places = np.array(own, np.int64)
                first = places >> LENGTH_BITS & FIRSTS
                after = first + (places & LENGTHS) - 1 + depth
                np.add.at(change, first, 1)
                np.add.at(change, after, -1)
                inside = np.cumsum(change[:-1]) > 0
                kept.append(content[~inside].tobytes())
                edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
                spans.append([{"first": int(a), "after": int(b)} for a, b in edges.reshape(-1, 2)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, span)],
                names=["doc_id", "n_bytes", "kept", "spans"],
            )

    return joined.unionByName(nobody).mapInArrow(
        run, "doc_id long, n_bytes long, kept binary, spans array<struct<first: int, after: int>>"
    )


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = remove_repeats(table(spark, folder, "documents"))
    return done.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
