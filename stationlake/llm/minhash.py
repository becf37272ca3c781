"""MinHash near-dedup with b-bit signatures.

Words are runs without ASCII white space, A-Z in lower case; a document's set are the hashes of its
distinct runs of ``width`` words.  Documents with the same set are one class and go on once.  Of each
set, minima under 128 permutations are taken: runs of four are hashed to 32 bands, and the low
four bits of every minimum are packed into a signature of eight longs.

Rows that share a band are candidates.  A candidate's similarity is estimated from its signatures by bit
counts, corrected for chance collisions of the low bits; what lies clearly below the
threshold (over six standard errors) is set aside and the rest is confirmed on the full sets.  A pair at the threshold
misses all bands with a chance of 5e-8.

A band's rows are never paired with each other outright.  First, rounds compare every row with one
leader of its band, and confirmed links are joined to components.  Bands whose rows are all in one component
are finished.  Only in the others are the rows of different components compared, each pair once, so no
link between components is lost: their longer signatures are estimated inside the join, and pairs that cannot reach the threshold, since too many of their shingles are in no
other set that is left, are passed over unseen.  Exact copies and families of close copies cost one comparison per row and band.

Defined cases: a text without words has an empty set, and is linked with nothing (also not with other empty
texts); fewer words than ``width`` are one shingle; null texts are empty; null ids are kept as documents without
links; each repeated row gets the component of its own text; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.llm.arrow import slices, texts
from stationlake.llm.components import connected
from stationlake.llm.registry import query, table
from stationlake.session import stored

WIDTH = 5
PERCENT = 80
BANDS, ROWS = 32, 4
BITS = 4
# Estimates this far below the threshold are set aside: over six standard errors of 128 minima.
SLACK = 0.25
LEADER_ROUNDS = 2
# Minima of the longer signatures that the last round compares, and how far below the threshold they may lie.
FINE = 1024
FINE_ERRORS = 6

_random = np.random.RandomState(20)
_FACTORS = (_random.randint(0, 2**32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_SHIFTS = _random.randint(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_ODD = [np.uint64(n) for n in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a text."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    runs = len(words) - width + 1
    total = np.full(runs, np.uint64(width))
    for at in range(width):
        total = _mix(total * _ODD[at % 4] + hashes[at : at + runs])
    return np.unique(total)


def minima(hashes: np.ndarray, factors: np.ndarray = _FACTORS, shifts: np.ndarray = _SHIFTS) -> np.ndarray:
    """The smallest value of a non-empty set under each permutation."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 512):
        block = low[start : start + 512, None] * factors + shifts
        np.minimum(least, block.min(0), out=least)
    return least


def sketch(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (64 bits) and the packed low bits of the minima, as signed longs."""
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    keys = np.arange(BANDS, dtype=np.uint64)
    for at in range(ROWS):
        keys = _mix(keys * _ODD[at] + rows[:, at])
    return keys.view(np.int64), packed_bits(least)


def packed_bits(least: np.ndarray) -> np.ndarray:
    """The low bits of minima, packed into signed longs."""
    mixed = _mix(least.astype(np.uint64)) & np.uint64(2**BITS - 1)
    per_long = 64 // BITS
    places = np.uint64(BITS) * np.arange(per_long, dtype=np.uint64)
    return (mixed.reshape(-1, per_long) << places).sum(1, dtype=np.uint64).view(np.int64)


def _digest(hashes: bytes) -> bytes | None:
    return hashlib.blake2b(hashes, digest_size=16).digest() if hashes else None


SKETCH_SCHEMA = "doc_id long, n_shingles long, digest binary, bands array<long>, signature array<long>"


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Set size, digest of the set, band keys and signature of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for text in texts(batch.column(1)):
                found = shingles(text, width)
                empty = not len(found)
                keys, packed = (None, None) if empty else sketch(minima(found))
                digest = _digest(found.tobytes())
                for column, value in zip(columns, (len(found), digest, keys, packed), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *arrays], names=["doc_id", "n_shingles", "digest", "bands", "signature"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SKETCH_SCHEMA)


def _equal_minima(one: Column, other: Column) -> Column:
    """How many of the packed low bits of two longs are equal."""
    differing = one.bitwiseXOR(other)
    for shift in (1, 2):
        differing = differing.bitwiseOR(F.shiftrightunsigned(differing, shift))
    first_bits = sum(1 << BITS * n for n in range(64 // BITS))
    return F.lit(64 // BITS) - F.bit_count(differing.bitwiseAND(F.lit(first_bits)))


def _corrected(same: Column, number: int) -> Column:
    chance = 1 / 2**BITS
    return (same / number - chance) / (1 - chance)


def estimate(one: Column, other: Column) -> Column:
    """Similarity from two signatures: the share of equal low bits, less what chance makes equal."""
    longs = BANDS * ROWS * BITS // 64
    same = sum((_equal_minima(one[n], other[n]) for n in range(1, longs)), _equal_minima(one[0], other[0]))
    return _corrected(same, BANDS * ROWS)


def fine_estimate(one: Column, other: Column) -> Column:
    """The same from two longer signatures."""
    same = F.aggregate(F.zip_with(one, other, _equal_minima), F.lit(0), lambda total, value: total + value)
    return _corrected(same, FINE)


def fine_signatures(sets: DataFrame) -> DataFrame:
    """Longer signatures (digest, fine) of full sets, by permutations of their own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.RandomState(21)
        factors = (random.randint(0, 2**32, FINE, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        shifts = random.randint(0, 2**32, FINE, dtype=np.uint64).astype(np.uint32)
        for batch in batches:
            found = [packed_bits(minima(np.frombuffer(v.as_buffer(), np.uint64), factors, shifts)) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["digest", "fine"])

    return sets.select("digest", "hashes").mapInArrow(run, "digest binary, fine array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """The full sets (doc_id, digest, hashes: sorted 64-bit hashes one after the other)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(text, width).tobytes() for text in texts(batch.column(1))]
            digests = [_digest(hashes) for hashes in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(found, pa.binary())],
                names=["doc_id", "digest", "hashes"],
            )

    return docs.mapInArrow(run, "doc_id long, digest binary, hashes binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (low, high) whose full sets are similar enough."""
    one = sets.select(F.col("doc_id").alias("high"), F.col("hashes").alias("high_set"))
    two = sets.select(F.col("doc_id").alias("low"), F.col("hashes").alias("low_set"))
    with_sets = pairs.join(one, "high").join(two, "low").select("low", "high", "low_set", "high_set")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for low, high in zip(batch.column(2), batch.column(3), strict=True):
                one, two = (np.frombuffer(value.as_buffer(), np.uint64) for value in (low, high))
                small, large = (one, two) if len(one) < len(two) else (two, one)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int(np.count_nonzero(large[at] == small))
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return with_sets.mapInArrow(run, "low long, high long")


def own_shingles(sets: DataFrame) -> DataFrame:
    """By digest, how many shingles no other of the sets has (rows only for sets that have some)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            found = [np.frombuffer(value.as_buffer(), np.int64) for value in batch.column(1)]
            digests = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(digests), pa.array(np.concatenate(found))], names=["digest", "shingle"]
            )

    rows = sets.select("digest", "hashes").mapInArrow(run, "digest binary, shingle long")
    alone = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.first("digest").alias("digest")).where("n = 1")
    return alone.groupBy("digest").agg(F.count("*").alias("own"))


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest linked id) of every document."""
    base = stored(sketches(docs, width), "minhash-sketches")
    own = base.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = stored(own.groupBy("digest").agg(F.min("doc_id").alias("class_id")), "minhash-classes")
    # The smallest document of a class stands for it.
    chosen = own.join(classes, "digest").where("doc_id = class_id")
    bands = chosen.select("doc_id", F.posexplode("bands").alias("band", "key"))
    shared = bands.groupBy("band", "key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b")
    members = stored(bands.join(shared, ["band", "key"], "left_semi").distinct(), "minhash-bands")
    involved = members.select("doc_id").distinct()
    signatures = stored(
        chosen.join(involved, "doc_id", "left_semi")
        .select("doc_id", "digest", "n_shingles", "bands", "signature").distinct(), "minhash-signatures"
    )
    all_texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    sets = stored(full_sets(all_texts.join(involved.hint("merge"), "doc_id", "left_semi"), width).distinct(), "minhash-sets")

    def close(one: str, other: str) -> Column:
        return estimate(F.col(one), F.col(other)) >= percent / 100 - SLACK

    links, labels, left = None, involved.withColumn("component", F.col("doc_id")), members
    for number in range(LEADER_ROUNDS + 1):
        current = left.join(labels, "doc_id")
        if number < LEADER_ROUNDS:
            # The leader changes with the round: the smallest id, then the largest.
            leader = F.min if number == 0 else F.max
            leaders = current.groupBy("band", "key").agg(leader(F.struct("doc_id", "component")).alias("leader"))
            met = current.join(leaders, ["band", "key"]).where("component <> leader.component")
            pairs = met.select(
                F.least("doc_id", "leader.doc_id").alias("low"), F.greatest("doc_id", "leader.doc_id").alias("high")
            ).distinct()
            one = signatures.select(F.col("doc_id").alias("low"), F.col("signature").alias("_low"))
            two = signatures.select(F.col("doc_id").alias("high"), F.col("signature").alias("_high"))
            near = pairs.join(one, "low").join(two, "high").where(close("_low", "_high")).select("low", "high")
        else:
            # What is left meets in its first common band only, and only close pairs leave the join.  Shingles
            # that no other set left has are missing in any intersection and are in every union.
            left_sets = sets.join(left.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["digest"])
            alone = stored(own_shingles(left_sets), "minhash-own")
            fine = stored(fine_signatures(left_sets), "minhash-fine")
            known = signatures.join(fine, "digest").join(alone, "digest", "left").na.fill(0, ["own"])
            wide = current.join(known, "doc_id")
            columns = ("doc_id", "component", "bands", "signature", "n_shingles", "own", "fine")
            chance = percent / 100 + (1 - percent / 100) / 2**BITS
            error = math.sqrt(chance * (1 - chance) / FINE) / (1 - 1 / 2**BITS)
            least_fine = percent / 100 - FINE_ERRORS * error
            one = wide.select("band", "key", *(F.col(c).alias(f"_low_{c}") for c in columns))
            two = wide.select(
                F.col("band").alias("_band"), F.col("key").alias("_key"), *(F.col(c).alias(f"_high_{c}") for c in columns)
            )
            common = F.array_position(F.zip_with("_low_bands", "_high_bands", lambda a, b: a == b), True)
            most = F.least(*(F.col(f"_{s}_n_shingles") - F.col(f"_{s}_own") for s in ("low", "high")))
            union = F.greatest(
                F.col("_low_n_shingles") + F.col("_high_own"), F.col("_high_n_shingles") + F.col("_low_own")
            )
            near = one.join(
                two, (F.col("band") == F.col("_band")) & (F.col("key") == F.col("_key"))
                & (F.col("_low_doc_id") < F.col("_high_doc_id")) & (F.col("_low_component") != F.col("_high_component"))
                & (100 * most >= percent * union) & close("_low_signature", "_high_signature")
                & (common == F.col("band") + 1) & (fine_estimate(F.col("_low_fine"), F.col("_high_fine")) >= least_fine),
            ).select(F.col("_low_doc_id").alias("low"), F.col("_high_doc_id").alias("high")).distinct()
        new = stored(confirmed(near, sets, percent).distinct(), f"minhash-links-{number}")
        if new.take(1):
            links = new if links is None else links.unionByName(new)
            joined = connected(links).select(F.col("node").alias("doc_id"), F.col("component").alias("smallest"))
            labels = stored(
                involved.join(joined, "doc_id", "left")
                .select("doc_id", F.coalesce("smallest", "doc_id").alias("component")), f"minhash-labels-{number}",
            )
        if number < LEADER_ROUNDS:
            several = left.join(labels, "doc_id").groupBy("band", "key").agg(
                F.min("component").alias("a"), F.max("component").alias("b")
            ).where("a <> b")
            left = stored(left.join(several, ["band", "key"], "left_semi"), f"minhash-left-{number}")
            if not left.take(1):
                break
    # One row for each class, so that the join below cannot repeat documents.
    found = classes.join(labels.withColumnRenamed("doc_id", "class_id"), "class_id", "left").select(
        "digest", F.coalesce("component", "class_id").alias("found")
    )
    return base.join(found, "digest", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id")
    )


@query("op1_minhash_near_dedup")
def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = groups(table(spark, folder, "documents"), width=4, percent=80)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
