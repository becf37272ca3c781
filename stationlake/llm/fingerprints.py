"""Homomorphic document fingerprints: wide vectors hashed from paragraphs, added up.

A paragraph (a line) has a vector of two parts.  The exact part is eight 32-bit lanes hashed from
its whole text.  The likeness part comes from its word triples: each triple's 64-bit hash
adds one to the lanes of its set bits, and one to a lane that counts triples.  The fingerprint
of a document is the sum of its paragraphs' vectors, every lane modulo 2^32.  So equal texts have equal
fingerprints, the order of paragraphs does not matter, and inserting or deleting a paragraph
adds or subtracts its vector (``combine``), without the rest of the text.

Seen around the middle, the lanes of the second part are a random projection of the
counts of triples; the likeness of two fingerprints is the cosine of these lanes, not below 0.
It estimates the cosine of the triple counts with an error of about 1/8.

Everything is DataFrame expressions.  To find each document's successor, documents are dealt by ranges
of their ids: the ranges come from approximate quantiles, which are ids of the table, so the first
row of the next range is known and is dealt to both.  The text is shuffled once, and the
sums and comparisons that follow keep that partitioning.

Defined cases: null text is empty (one empty paragraph); null ids come after all others, equal
ids are ordered by text, and equal rows stay rows of their own; a single document is its own
successor; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stationlake.llm.registry import query, table

EXACT = 4  # longs with two 32-bit lanes each
PAIRS = 32  # longs with two lanes each for the set bits of a triple's hash
LOW = 0xFFFFFFFF
RANGE_ROWS = 20_000
MOST_RANGES = 65_536


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _triples(paragraph: Column) -> Column:
    """Hashes of three words in a row from every word on; at the end of two words and one."""
    words = F.split(paragraph, " ", -1)
    pairs = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.xxhash64(a, b))
    return F.zip_with(pairs, F.slice(words, 3, F.size(words)), lambda pair, word: F.xxhash64(pair, word))


def _exact(text: Column) -> Column:
    """Array of longs: for each two lanes the sums of 32-bit hashes of the paragraphs."""
    def lane(number: int) -> Column:
        total = F.aggregate(
            paragraphs(text), F.lit(0).cast("long"),
            lambda so_far, p: so_far + F.xxhash64(p, F.lit(number)).bitwiseAND(F.lit(LOW)),
        )
        return total.bitwiseAND(F.lit(LOW))

    return F.array(*(
        F.shiftleft(lane(2 * n), 32).bitwiseOR(lane(2 * n + 1)) for n in range(EXACT)
    ))


def _bits(gram: Column, number: int) -> Column:
    """Two bits of a hash, each at the low end of a 32-bit lane."""
    return F.shiftrightunsigned(gram, number).bitwiseAND(F.lit(1 | 1 << 32))


def _hex(lanes: Column) -> Column:
    return F.array_join(F.transform(lanes, lambda lane: F.lpad(F.hex(lane), 16, "0")), "")


def sums(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Per key the exact lanes and the likeness lanes (the triples' count first) of a text column."""
    grams = F.flatten(F.transform(paragraphs(F.col(text)), _triples))
    # Exact lanes are computed below the explode, or they would be computed for every triple.
    wide = rows.select(*keys, _exact(F.col(text)).alias("_exact"), grams.alias("_grams"))
    units = wide.select(*keys, "_exact", F.explode_outer("_grams").alias("_gram"))
    added = [F.sum(_bits(F.col("_gram"), n)).alias(f"_lane{n}") for n in range(PAIRS)]
    found = units.groupBy(*keys, "_exact").agg(F.count("_gram").alias("_count"), *added)
    lanes = [F.coalesce(F.col(f"_lane{n}"), F.lit(0)) for n in range(PAIRS)]
    return found.select(*keys, F.col("_exact").alias("exact"), F.array("_count", *lanes).alias("lanes"))


def printed(exact: Column, lanes: Column) -> Column:
    """The fingerprint as hexadecimal text."""
    return _hex(F.concat(exact, lanes))


def combine(one: Column, other: Column, sign: int = 1) -> Column:
    """The sum of two lane arrays (or the difference), each 32-bit lane on its own modulo 2^32."""
    def lane(a: Column, b: Column) -> Column:
        high = F.shiftrightunsigned(a, 32) + F.lit(sign) * F.shiftrightunsigned(b, 32)
        low = a.bitwiseAND(F.lit(LOW)) + F.lit(sign) * b.bitwiseAND(F.lit(LOW))
        return F.shiftleft(high.bitwiseAND(F.lit(LOW)), 32).bitwiseOR(low.bitwiseAND(F.lit(LOW)))

    return F.zip_with(one, other, lane)


def likeness(one: Column, other: Column, equal: Column) -> Column:
    """Cosine of two arrays of likeness lanes around their middle, in 0 to 1; 1 for equal fingerprints."""
    def centred(lanes: Column, high: bool) -> Column:
        count = lanes[0].cast("double")
        part = (lambda x: F.shiftrightunsigned(x, 32)) if high else (lambda x: x.bitwiseAND(F.lit(LOW)))
        return F.transform(F.slice(lanes, 2, PAIRS), lambda x: 2 * part(x).cast("double") - count)

    def dot(a: Column, b: Column) -> Column:
        parts = F.zip_with(F.concat(centred(a, True), centred(a, False)), F.concat(centred(b, True), centred(b, False)), lambda x, y: x * y)
        return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)

    norms = F.sqrt(dot(one, one) * dot(other, other))
    cosine = F.when(norms > 0, F.least(F.greatest(dot(one, other) / norms, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.when(equal, F.lit(1.0)).otherwise(cosine)


def _ranges(docs: DataFrame) -> tuple[list[int], int | None]:
    """Upper ends of id ranges (ids of the table, at most ``MOST_RANGES``) and the largest id."""
    known = docs.where(F.col("doc_id").isNotNull())
    rows, largest = known.agg(F.count("*"), F.max("doc_id")).first()
    number = min(max(64, math.ceil(rows / RANGE_ROWS)), MOST_RANGES)
    steps = [n / number for n in range(1, number)]
    ends = known.agg(F.percentile_approx("doc_id", steps, 100 * number)).first()[0]
    return sorted(set(ends or [])), largest


def _place(ends: list[int], value: Column) -> Column:
    """How many ends are smaller than the value, counted over two levels of the sorted list."""
    if not ends:
        return F.lit(0)
    width = math.isqrt(len(ends)) + 1
    blocks = [ends[n : n + width] for n in range(0, len(ends), width)]
    block = F.lit([b[-1] for b in blocks])
    full = F.size(F.filter(block, lambda end: end < value))
    inner = F.array(*(F.lit(b) for b in blocks))
    rest = F.coalesce(F.size(F.filter(F.try_element_at(inner, full + 1), lambda end: end < value)), F.lit(0))
    return F.when(value.isNull(), 0).otherwise(F.least(full * width, F.lit(len(ends))) + F.greatest(rest, F.lit(0)))


def with_successors(docs: DataFrame) -> DataFrame:
    """Rows (range, halo, doc_id, text, place, next_text): the next document in descending order of ids.

    A row with ``halo`` is the copy of a range's successor; it ends the range and is no row of the answer.
    """
    needed = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ends, largest = _ranges(needed)
    own = needed.select(_place(ends, F.col("doc_id")).alias("range"), F.lit(0).alias("halo"), "doc_id", "text")
    # A range's smallest id is followed by the end of the range below; the very last document by the first.
    below = needed.where(F.col("doc_id").isin(ends)) if ends else needed.limit(0)
    below = below.select((_place(ends, F.col("doc_id")) + 1).alias("range"), F.lit(1).alias("halo"), "doc_id", "text")
    top = needed.where(F.col("doc_id").isNull() if largest is None else F.col("doc_id") == largest)
    top = top.select(F.lit(0).alias("range"), F.lit(1).alias("halo"), "doc_id", "text")
    first = Window.partitionBy("range").orderBy("text")
    halo = below.unionByName(top).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    order = Window.partitionBy("range").orderBy("halo", F.col("doc_id").desc_nulls_last(), "text")
    return own.unionByName(halo).withColumns(
        {"place": F.row_number().over(order), "next_text": F.lead("text").over(order)}
    )


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike they are."""
    rows = with_successors(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)
    )
    both = rows.select(
        "range", "halo", "doc_id", "place", F.length("text").cast("long").alias("n_chars"),
        F.posexplode(F.when(F.col("halo") == 1, F.array("text")).otherwise(F.array(F.col("text"), edited))).alias("kind", "version"),
    ).withColumn("digest", F.when(F.col("kind") == 1, F.unhex(F.sha2("version", 256))))
    found = sums(both, ["range", "place", "kind", "halo", "doc_id", "n_chars", "digest"], "version")
    order = Window.partitionBy("range").orderBy("place", "kind")
    side = found.withColumns({
        "edited_exact": F.lead("exact", 1).over(order), "edited_lanes": F.lead("lanes", 1).over(order),
        "edited_digest": F.lead("digest", 1).over(order),
        "next_exact": F.lead("exact", 2).over(order), "next_lanes": F.lead("lanes", 2).over(order),
    }).where("halo = 0 AND kind = 0")

    def same(what: str) -> Column:
        return (F.col("exact") == F.col(f"{what}_exact")) & (F.col("lanes") == F.col(f"{what}_lanes"))

    return side.select(
        "doc_id", "n_chars", F.lower(F.hex("edited_digest")).alias("edited_sha256"),
        F.lower(printed(F.col("exact"), F.col("lanes"))).alias("fingerprint"),
        F.lower(printed(F.col("edited_exact"), F.col("edited_lanes"))).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes"), same("edited")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes"), same("next")).alias("near_next"),
    )


@query("op4_multiset_fingerprint")
def op4_multiset_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return compare_with_edits(table(spark, folder, "documents"))
