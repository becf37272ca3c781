"""Substring dedup by hashing lines, and sentences within them.

A text is cut at line breaks into lines, and a line behind every sentence mark that blanks follow (or that needs none)
into sentences.  Lines and sentences of at least ``MIN_CHARS`` code points, whatever their case and script, are the units.  They are normalised
(A-Z lower, single spaces), hashed to 128 bits and grouped by digest over the whole corpus; the occurrence of the
smallest document and place stays, the others go, and nothing else does: all text that goes stands in an earlier unit.
A line of which no sentence is left goes with its line break.  What goes is returned as spans of the original text, in code points.

Not found: a passage within a line that no sentence mark sets apart, and shorter units.

Each task sends one row per digest and batch to the grouping, and of digests that it has met repeatedly only
those that may come first.  So a line that a third of all documents hold is a few rows per task, and no
group is gathered.  Texts are shuffled once, to meet the list of their own places.

Defined cases: null text is empty; rows with a null id stay whole and count for nobody; rows that repeat an id and its
text count as one occurrence and are treated alike; rows that repeat an id with another text are texts of their own, in the
order of a digest of them; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stationlake.llm.arrow import slices, texts
from stationlake.llm.registry import query, table

MIN_CHARS = 80
# Digests met repeatedly that a task remembers; when there are more, it starts anew.
COMMON = 200_000
# Fixed classes, so that Python and RE2 agree.
BLANK = " \\t\\x0b\\f\\r"
CLOSING = "\"')\\]»”’」』）"
MARK = f"[.!?…][{CLOSING}]*[{BLANK}]+|[。！？][{CLOSING}]*[{BLANK}]*"

_mark = re.compile(MARK)
_blanks = re.compile(f"[{BLANK}]+")
_strip = " \t\x0b\f\r"
_lower = bytes(code + 32 if 65 <= code <= 90 else code for code in range(256))


def pieces_of(text: str) -> list[list[tuple[int, int]]]:
    """The sentences of every line, as (first code point, end) with the blanks behind them."""
    lines, at = [], 0
    for line in text.split("\n"):
        ends = [match.end() for match in _mark.finditer(line)]
        if line and (not ends or ends[-1] < len(line)):
            ends.append(len(line))
        lines.append([(at + first, at + after) for first, after in zip([0, *ends[:-1]], ends, strict=True)] if ends else [])
        at += len(line) + 1
    return lines


def digest_of(unit: str, min_chars: int) -> bytes | None:
    """Digest of a unit, or None where it is too short to be looked up."""
    unit = unit.strip(_strip)
    if len(unit) < min_chars:
        return None
    unit = _blanks.sub(" ", unit)
    if len(unit) < min_chars:
        return None
    return hashlib.md5(unit.encode().translate(_lower), usedforsecurity=False).digest()


def units_of(text: str, min_chars: int) -> list[tuple[int, int, int, bytes]]:
    """(Line, first piece, end, digest) of the lines and sentences that are long enough, in order."""
    found = []
    for line, pieces in enumerate(pieces_of(text)):
        if not pieces or pieces[-1][1] - pieces[0][0] < min_chars:
            continue
        whole = digest_of(text[pieces[0][0] : pieces[-1][1]], min_chars)
        if whole is not None:
            found.append((line, 0, len(pieces), whole))
        if len(pieces) > 1:
            for n, (first, after) in enumerate(pieces):
                if after - first >= min_chars and (digest := digest_of(text[first:after], min_chars)) is not None:
                    found.append((line, n, n + 1, digest))
    return found


def cut(text: str, places: set[int], min_chars: int) -> tuple[str, list[tuple[int, int]], int]:
    """What is left of a text without some of its units, the spans that went, and the number of sentences in them."""
    lines = pieces_of(text)
    gone = [[False] * len(pieces) for pieces in lines]
    for place, (line, first, after, _) in enumerate(units_of(text, min_chars)):
        if place in places:
            gone[line][first:after] = [True] * (after - first)
    stays = [not flags or not all(flags) for flags in gone]
    last = max((n for n, kept in enumerate(stays) if kept), default=-1)
    spans: list[tuple[int, int]] = []

    def remove(first: int, after: int) -> None:
        if spans and spans[-1][1] == first:
            spans[-1] = (spans[-1][0], after)
        elif first < after:
            spans.append((first, after))

    at = 0
    for n, (pieces, flags) in enumerate(zip(lines, gone, strict=True)):
        end = pieces[-1][1] if pieces else at
        for (first, after), is_gone in zip(pieces, flags, strict=True):
            if is_gone:
                remove(first, after)
        # A line break goes with the line before it, and all behind the last line that stays.
        if n + 1 < len(lines) and (not stays[n] or n >= last):
            remove(end, end + 1)
        at = end + 1
    parts, at = [], 0
    for first, after in spans:
        parts.append(text[at:first])
        at = after
    return "".join(parts) + text[at:], spans, sum(map(sum, gone))


def _identified(docs: DataFrame) -> DataFrame:
    """Id, digest of the text (rows that share both are one text) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("twin"), "text")


def later_places(identified: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, twin and place of every unit that occurs earlier, in a smaller document or before it."""
    schema = "doc_id long, twin long, place int, digest binary, sent boolean"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common: dict[bytes, tuple[int, int, int]] = {}
        for batch in slices(batches, 2000):
            least: dict[bytes, tuple[int, int, int]] = {}
            rows: list[tuple[tuple[int, int, int], bytes]] = []
            for doc_id, twin, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                for place, (_, _, _, digest) in enumerate(units_of(text, min_chars)):
                    key = (doc_id, twin, place)
                    rows.append((key, digest))
                    seen = least.get(digest)
                    if seen is None:
                        least[digest] = min(key, common.get(digest, key))
                        continue
                    least[digest] = min(key, seen)
                    common[digest] = min(least[digest], common.get(digest, key))
            if len(common) > COMMON:
                common.clear()
            if rows:
                ids, twins, places = zip(*(key for key, _ in rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()), pa.array(twins, pa.int64()), pa.array(places, pa.int32()),
                        pa.array([digest for _, digest in rows], pa.binary()), pa.array([key == least[digest] for key, digest in rows]),
                    ],
                    names=["doc_id", "twin", "place", "digest", "sent"],
                )

    rows = identified.where("doc_id IS NOT NULL").mapInArrow(run, schema)
    # Rows that are known to be later keep a key of their own, so they do not gather with the digest's first ones.
    key = F.when(F.col("sent"), F.col("digest")).otherwise(F.unhex(F.md5(F.concat_ws(",", "doc_id", "twin", "place"))))
    order = Window.partitionBy("key", "sent").orderBy("doc_id", "twin", "place")
    ranked = rows.select("doc_id", "twin", "place", "sent", key.alias("key")).withColumn("rank", F.rank().over(order))
    return ranked.where("NOT sent OR rank > 1").select("doc_id", "twin", "place")


def dedup_units(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, kept text, removed spans of the original text, and the number of sentences in them, one row per row."""
    identified = _identified(docs)
    places = later_places(identified, min_chars).groupBy("doc_id", "twin").agg(F.collect_set("place").alias("places"))
    joined = identified.join(places, ["doc_id", "twin"], "left").select("doc_id", "text", "places")
    span = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans, removed = [], [], []
            for text, own in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                left, gone, count = cut(text, set(own), min_chars) if own else (text, [], 0)
                kept.append(left)
                spans.append([{"first": first, "after": after} for first, after in gone])
                removed.append(count)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.string()), pa.array(spans, span), pa.array(removed, pa.int64())],
                names=["doc_id", "kept", "spans", "n_units_removed"],
            )

    return joined.mapInArrow(
        run, "doc_id long, kept string, spans array<struct<first: int, after: int>>, n_units_removed long"
    )


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SIGNS = "chr(32) || chr(9) || chr(11) || chr(12) || chr(13)"
_RE2_MARK = MARK.replace("\\x0b", "\\v").replace("'", "''")
_KEY = "translate(regexp_replace(trim({text}, " + _SIGNS + "), '[ \\t\\v\\f\\r]+', ' ', 'g'), '" + UPPER + "', '" + LOWER + "')"

# Sentences by lazy matches up to a mark; units are lines, and sentences of lines that have several.
ORACLE = f"""
WITH lines AS (
    SELECT doc_id, unnest(found) AS line, unnest(range(len(found))) AS line_no
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS found FROM documents)
), pieces AS (
    SELECT doc_id, line_no, line, len(found) AS n_pieces, unnest(found) AS piece, unnest(range(len(found))) AS place
    FROM (SELECT *, regexp_extract_all(line, '(?s).*?(?:{_RE2_MARK})|(?s).+') AS found FROM lines)
), units AS (
    SELECT doc_id, line_no, -1 AS place, {_KEY.format(text="line")} AS key FROM lines
    UNION ALL
    SELECT doc_id, line_no, place, {_KEY.format(text="piece")} FROM pieces WHERE n_pieces > 1
), later AS (
    SELECT doc_id, line_no, place FROM units WHERE length(key) >= {MIN_CHARS}
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, line_no, place) > 1
), decided AS (
    SELECT p.doc_id, p.line_no, p.place, p.piece, l.doc_id IS NOT NULL OR s.doc_id IS NOT NULL AS gone
    FROM pieces p
    LEFT JOIN later l ON l.doc_id = p.doc_id AND l.line_no = p.line_no AND l.place = -1
    LEFT JOIN later s ON s.doc_id = p.doc_id AND s.line_no = p.line_no AND s.place = p.place
), stays AS (
    SELECT l.doc_id, l.line_no, NOT coalesce(bool_and(d.gone), false) AS stays
    FROM lines l LEFT JOIN decided d ON d.doc_id = l.doc_id AND d.line_no = l.line_no GROUP BY ALL
), breaks AS (
    SELECT doc_id, line_no, NOT stays OR line_no >= coalesce(max(line_no) FILTER (stays) OVER w, -1) AS gone,
        max(line_no) OVER w AS last_no
    FROM stays WINDOW w AS (PARTITION BY doc_id)
), tokens AS (
    SELECT doc_id, line_no, place, piece, gone FROM decided
    UNION ALL
    SELECT doc_id, line_no, 1000000000, chr(10), gone FROM breaks WHERE line_no < last_no
), runs AS (
    SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY line_no, place), false) AS gone_before FROM tokens
), done AS (
    SELECT doc_id, coalesce(string_agg(piece, '' ORDER BY line_no, place) FILTER (NOT gone), '') AS kept,
        count(*) FILTER (gone AND place < 1000000000) AS n_units_removed, count(*) FILTER (gone AND NOT gone_before) AS n_spans
    FROM runs GROUP BY doc_id
)
SELECT d.doc_id, coalesce(t.n_units_removed, 0) AS n_units_removed, coalesce(t.n_spans, 0) AS n_spans,
    length(coalesce(d.text, '')) - length(coalesce(t.kept, '')) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN done t ON d.doc_id = t.doc_id
"""


@query("op8_substring_dedup", ORACLE)
def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = dedup_units(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["after"] - span["first"])
    return done.select(
        "doc_id", "n_units_removed", F.size("spans").cast("long").alias("n_spans"),
        removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"),
    )
