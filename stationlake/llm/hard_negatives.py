"""Hard-negative mining by exact inner-product search with coordinate pruning in length buckets.

Rows are dealt to shards by their length class, longest first, and by a hash within a class; a shard holds a few buckets of
rows of similar length.  A bucket keeps, for every coordinate, its unit vectors' values as a sorted list.
A search for scores of at least t over a bucket whose longest row is l needs a cosine of at least t / (|q| l) with an anchor
q.  That limits every coordinate of a row to a range of values around the anchor's own (as angles: no farther
from it than the angle of the needed cosine).  The anchor's ``FOCUS`` largest coordinates are looked up in the sorted lists, the
shortest slice is intersected with the other ranges, and what is left is verified with exact integer products.  The best
results so far raise t from bucket to bucket, and a bucket too short for t is passed over whole.

Mining is two such searches: an anchor's first rows of its own label (positives), then for every positive the first rows of other
labels whose score lies between two shares of the positive's.  The lower share is known before the second search, so
anchors are sent only to shards long enough for it.

Anchors are a stated part of the rows and go to all shards in blocks: rows are shuffled once per search, anchors once per shard,
and a task holds one shard and one Arrow batch of anchors.  Neither a label nor a vector with very many rows matters to
the sizes of shards, since they are dealt by row.  Only counts per length class (at most 128) reach the driver.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part; missing components of
shorter vectors count as zero; rows that repeat an id are rows of their own but no positives of each other; equal scores go by the smaller
id; anchors without another row of their label, or whose positives' scores are negative, have no negatives; an empty
table gives an empty table; other columns are ignored.  Components so large that a score might exceed 2^56 are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stationlake.llm.registry import query, table
from stationlake.session import stored

POSITIVES, NEGATIVES = 5, 3
# Shares of a positive's score, in hundredths, between which its negatives lie.
LOW, HIGH = 50, 95
FOCUS = 6
BUCKET_ROWS = 2048
# A shard's rows: a 64th of the table within these bounds, so that there are tasks for small tables too.
FEWEST_SHARD_ROWS, MOST_SHARD_ROWS = BUCKET_ROWS, 32 * BUCKET_ROWS
MOST_PARTITIONS = 20_000
LARGEST_SCORE = 1 << 56
ANY = 1 << 62
# Ranges are wider by this than the angles say, more than rounding can matter.
SLACK = 1e-7


class Bucket:
    """Rows of similar length with a sorted list per coordinate."""

    def __init__(self, vectors: np.ndarray, lengths: np.ndarray, codes: np.ndarray, ids: np.ndarray):
        self.exact = vectors
        self.floats = vectors.astype(np.float64)
        self.codes, self.ids = codes, ids
        self.longest = float(lengths.max())
        self.unit = np.asfortranarray(self.floats / np.maximum(lengths, 1.0)[:, None])
        self.order = np.argsort(self.unit, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(self.unit.T, self.order, axis=1)
        self.largest = float(np.abs(self.floats).max(initial=0))

    def candidates(self, probe: Probe, least: int) -> np.ndarray | None:
        """Rows whose focus coordinates allow a score of ``least``; None stands for all of them."""
        reach = probe.length * self.longest
        if least <= 0 or not reach:
            return None if least <= 0 else np.zeros(0, np.int32)
        cosine = least / reach * (1 - 1e-12)
        if cosine > 1:
            return np.zeros(0, np.int32)
        angle = math.acos(cosine)
        low = np.cos(np.minimum(probe.angles + angle, math.pi)) - SLACK
        high = np.cos(np.maximum(probe.angles - angle, 0.0)) + SLACK
        slices = []
        for at, coordinate in enumerate(probe.focus):
            values = self.sorted[coordinate]
            first, after = values.searchsorted(low[at], "left"), values.searchsorted(high[at], "right")
            if after - first < len(values):
                slices.append((after - first, coordinate, first, after, low[at], high[at]))
        if not slices:
            return None
        _, coordinate, first, after, _, _ = shortest = min(slices)
        rows = self.order[coordinate, first:after]
        for other in slices:
            if other is not shortest and len(rows):
                values = self.unit[rows, other[1]]
                rows = rows[(values >= other[4]) & (values <= other[5])]
        return rows

    def scores(self, probe: Probe, rows: np.ndarray) -> np.ndarray:
        """Exact products of some rows; floating point only where it is exact, too."""
        if probe.largest * self.largest * len(probe.vector) < 1 << 53:
            return (self.floats[rows] @ probe.floats).astype(np.int64)
        return self.exact[rows] @ probe.vector


class Probe:
    """An anchor ready to search, with its largest coordinates as angles."""

    def __init__(self, vector: np.ndarray):
        self.vector = vector
        self.floats = vector.astype(np.float64)
        self.largest = float(np.abs(self.floats).max(initial=0))
        self.length = math.sqrt(float(self.floats @ self.floats))
        self.focus = np.argsort(-np.abs(self.floats), kind="stable")[:FOCUS]
        self.angles = np.arccos(np.clip(self.floats[self.focus] / max(self.length, 1.0), -1, 1))


class Shard:
    """The buckets of a shard, longest rows first."""

    def __init__(self, vectors: np.ndarray, labels: list, ids: np.ndarray):
        self.width = vectors.shape[1]
        self.code = {label: at for at, label in enumerate(dict.fromkeys(labels))}
        codes = np.array([self.code[label] for label in labels], np.int64)
        lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        self.buckets = [
            Bucket(vectors[part], lengths[part], codes[part], ids[part])
            for part in (order[at : at + BUCKET_ROWS] for at in range(0, len(order), BUCKET_ROWS))
        ]
        self.verified = self.seen = 0

    def search(
        self, vector: np.ndarray, label, own: int, wants: list[tuple[int, int]], count: int, same: bool
    ) -> list[list[tuple[int, int]]]:
        """For each (least, most) wanted, the first ``count`` (-score, id) of rows of the same label, or of others."""
        width = max(self.width, len(vector))
        if len(vector) < width:
            vector = np.concatenate([vector, np.zeros(width - len(vector), np.int64)])
        elif self.width < width:
            # Components that no row of the shard has meet zeros only.
            vector = vector[: self.width]
        probe = Probe(vector)
        code = self.code.get(label, -1)
        found: list[list[tuple[int, int]]] = [[] for _ in wants]
        floors = [least for least, _ in wants]
        for bucket in self.buckets:
            if probe.largest * bucket.largest * max(1, len(vector)) >= LARGEST_SCORE:
                raise ValueError("Components are too large: scores might exceed 2^56")
            allowed = bucket.codes == code
            if same:
                allowed &= bucket.ids != own
            else:
                allowed = ~allowed
            least = min(floors)
            rows = bucket.candidates(probe, least)
            rows = np.flatnonzero(allowed) if rows is None else rows[allowed[rows]]
            self.seen += int(allowed.sum())
            self.verified += len(rows)
            if not len(rows):
                continue
            scores = bucket.scores(probe, rows)
            good = scores >= least
            scores, ids = scores[good], bucket.ids[rows[good]]
            order = np.lexsort((ids, -scores))
            scores, ids = scores[order], ids[order]
            for at, (least, most) in enumerate(wants):
                first = int(np.searchsorted(-scores, -most, "left"))
                best = [
                    (-int(s), int(i))
                    for s, i in zip(scores[first : first + count], ids[first : first + count], strict=True)
                    if s >= least
                ]
                if best:
                    found[at] = sorted(found[at] + best)[:count]
                    if len(found[at]) == count:
                        floors[at] = max(floors[at], -found[at][-1][0])
        return found


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of a batch as one matrix; shorter ones are filled up with zeros."""
    flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
    sizes = np.diff(ends)
    width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        return flat[ends[0] : ends[-1]].reshape(len(sizes), width).astype(np.int64)
    made = np.zeros((len(sizes), width), np.int64)
    for at, size in enumerate(sizes):
        made[at, :size] = flat[ends[at] : ends[at] + size]
    return made


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and end of the stretches of equal values."""
    edges = np.flatnonzero(np.diff(values)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(values)], strict=True)


def searched(rows: DataFrame, probes: DataFrame, shards: int, count: int, same: bool) -> DataFrame:
    """Per shard the first results (probe, want, id, score) of all probes that were sent to it.

    ``rows`` has shard, row, vec_id, label, vector; ``probes`` the same with an array ``wants`` of (least, most).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, shard = None, [], None
        for batch in batches:
            for first, after in _runs(batch.column(0).to_numpy()):
                part = batch.slice(first, after - first)
                number = part.column(0)[0].as_py()
                if number != held:
                    held, parts, shard = number, [], None
                kinds = part.column(1).to_numpy()
                # Within a shard all rows come before the first probe.
                n = int(np.searchsorted(kinds, 1, "left"))
                if n:
                    parts.append((_matrix(part.column(5).slice(0, n)), part.column(4).slice(0, n).to_pylist(), part.column(3).slice(0, n).to_numpy()))
                if n == part.num_rows or not parts:
                    continue
                if shard is None:
                    width = max(vectors.shape[1] for vectors, _, _ in parts)
                    vectors = np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v, _, _ in parts])
                    shard = Shard(vectors, [label for _, labels, _ in parts for label in labels], np.concatenate([i for _, _, i in parts]))
                asked = part.slice(n)
                columns: list[list[int]] = [[], [], [], []]
                vectors = _matrix(asked.column(5))
                for at, (row, own, label, wants) in enumerate(zip(*(asked.column(k).to_pylist() for k in (2, 3, 4, 6)), strict=True)):
                    limits = [(want["least"], want["most"]) for want in wants]
                    for place, best in enumerate(shard.search(vectors[at], label, own, limits, count, same)):
                        for score, partner in best:
                            for column, value in zip(columns, (row, place, partner, -score), strict=True):
                                column.append(value)
                if columns[0]:
                    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["probe", "want", "id", "score"]
                    )

    nothing = F.lit(None).cast("array<struct<least: bigint, most: bigint>>")
    held = rows.select("shard", F.lit(0).alias("kind"), "row", "vec_id", "label", "vector", nothing.alias("wants"))
    asked = probes.select("shard", F.lit(1).alias("kind"), "row", "vec_id", "label", "vector", "wants")
    parts = max(1, min(shards, MOST_PARTITIONS))
    dealt = held.unionByName(asked).repartitionById(parts, F.pmod(F.col("shard"), F.lit(parts)).cast("int"))
    return dealt.sortWithinPartitions("shard", "kind").mapInArrow(run, "probe long, want int, id long, score long")


def _first(found: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The first results of each key over all shards, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def _class(length2: Column) -> Column:
    """Length class of a squared length: two per doubling of the square; 0 for the null vector."""
    return F.when(length2 < 1, 0).otherwise(F.floor(2 * F.log2(F.greatest(length2, F.lit(1.0)))) + 1).cast("int")


def mine(
    rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, from vec_id, label and an integer ``vector``.

    ``anchors`` is a condition on the rows, such as ids divisible by some number.
    """
    length2 = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    known = stored(
        rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").select(
            F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), "label",
            F.col("vector").cast("array<bigint>").alias("vector"), length2.alias("length2"),
            F.coalesce(anchors, F.lit(False)).alias("is_anchor"),
        ).withColumn("class", _class(F.col("length2"))), "mining-rows",
    )
    counts = {r["class"]: r["count"] for r in known.groupBy("class").count().collect()}
    size = min(max(sum(counts.values()) // 64, FEWEST_SHARD_ROWS), MOST_SHARD_ROWS)
    top = max(counts, default=0)
    starts, pieces, shards = [0] * (top + 1), [1] * (top + 1), 0
    for level in range(top, -1, -1):
        starts[level] = shards
        pieces[level] = max(1, math.ceil(counts.get(level, 0) / size))
        shards += pieces[level] if counts.get(level) else 0
    of_level = lambda values, level: F.get(F.lit(values), level)
    within = F.pmod(F.xxhash64("row"), of_level(pieces, F.col("class")))
    dealt = known.withColumn("shard", (of_level(starts, F.col("class")) + within).cast("int"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(max(shards - 1, 0)))).alias("shard")
    any_score = F.array(F.struct(F.lit(-ANY).alias("least"), F.lit(ANY).alias("most")))
    chosen = known.where("is_anchor")
    asked = chosen.select("row", "vec_id", "label", "vector", any_score.alias("wants"), everywhere)
    first = _first(searched(dealt, asked, shards, positives, same=True), ["probe"], positives)
    # Integers only: the least score is rounded up, the most down.
    least, most = F.expr(f"({low} * score + 99) div 100"), F.expr(f"({high} * score) div 100")
    pairs = stored(
        first.where("score >= 0").select("probe", "rank", F.col("id").alias("positive_id"), "score", least.alias("least"), most.alias("most")),
        "mining-positives",
    )
    listed = pairs.groupBy("probe").agg(
        F.sort_array(F.collect_list(F.struct("rank", "least", "most"))).alias("wants"), F.min("least").alias("lowest")
    )
    # A shard whose rows are too short for the lowest score that an anchor looks for is not asked.
    needed = _class(F.when(F.col("lowest") > 0, F.pow(F.col("lowest") * (1 - 1e-9), F.lit(2.0)) / F.col("length2")).otherwise(0.0))
    ends = [starts[level] + (pieces[level] if counts.get(level) else 0) for level in range(top + 1)]
    last = F.when(needed > top, 0).otherwise(of_level(ends, F.least(needed, F.lit(top))))
    deeper = chosen.join(listed, F.col("row") == F.col("probe")).select(
        "row", "vec_id", "label", "vector", F.transform("wants", lambda w: F.struct(w["least"].alias("least"), w["most"].alias("most"))).alias("wants"),
        last.alias("last"),
    ).where("last > 0").select("row", "vec_id", "label", "vector", "wants", F.explode(F.sequence(F.lit(0), F.col("last") - 1)).alias("shard"))
    found = _first(searched(dealt, deeper, shards, negatives, same=False), ["probe", "want"], negatives)
    named = pairs.join(chosen.select(F.col("row").alias("probe"), F.col("vec_id").alias("anchor_id")), "probe").select(
        "anchor_id", "probe", "positive_id", F.col("score").alias("positive_score"),
        (F.row_number().over(Window.partitionBy("probe").orderBy("rank")) - 1).alias("want"),
    )
    return named.join(found, ["probe", "want"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """Rows that take part, with ``vector`` in whole steps of a scale."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    known = embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(finite)
    return known.select("vec_id", "label", whole.alias("vector"))


ORACLE = f"""
WITH known AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
        CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
    FROM known a JOIN known r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}
), ranked AS (
    SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS place
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
        AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE place <= {NEGATIVES}
"""


@query("op12_hard_negatives", ORACLE)
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = integer_vectors(table(spark, folder, "embeddings"))
    noisy = F.when(F.expr("vec_id % 7 = 0"), F.expr("(label + 1) % 10")).otherwise(F.col("label"))
    return mine(rows.withColumn("label", noisy), F.expr("vec_id % 50 = 0"))
