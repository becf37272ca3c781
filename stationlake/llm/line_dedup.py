"""Line dedup that can be taken back: exact reference counts with sharded cuckoo filters in front.

State.  ``counts`` is the exact table: for each line key its digest, the number of documents
that hold it and the largest of their ids.  Keys held by at least ``least`` documents are
repeated.  ``filters`` has one row per shard of the digests: a cuckoo filter of the shard's
repeated keys.  Filters only save work: a line that its shard's filter does not know
goes no further, and what it knows is confirmed against ``counts``, so that a false positive
costs one lookup and nothing else.

``insert`` and ``delete`` take documents in and out.  They add to or subtract from the counts,
and put the keys that became repeated into the filters of their shards, or take those out that
no longer are, so that inserting documents and deleting them again gives the state from before.
The largest id of a key needs the references themselves (``refs``: one row per key and document).

A key that very many documents hold is combined before shuffles.  Lines are dealt to filters
by shard and a salt (a filter is repeated per salt), so a hot shard is split.  A filter that
cannot place a key is built anew, larger; no key is ever left out.

Defined cases: null or empty text is one empty line; null ids are documents of their own only
in the answer (they are never counted and lose no line); repeated rows of one id count as one
document, and each loses the same lines; empty tables give empty tables; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.llm.registry import query, table
from stationlake.session import stored

LEAST_CHARS = 40
LEAST_DOCS = 5
# A shard holds about this many repeated keys; their number grows with the corpus, in powers of two.
SHARD_KEYS = 100_000
SALTS = 8
SLOTS = 4
KICKS = 500

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Cuckoo:
    """Cuckoo filter of 64-bit digests: 16-bit marks in buckets of four; zero is an empty slot."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks

    @classmethod
    def for_keys(cls, count: int) -> Cuckoo:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, count) / (SLOTS * 0.8)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def load(cls, content: bytes) -> Cuckoo:
        return cls(np.frombuffer(content, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.marks.tobytes()

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marks and both buckets of some keys; either bucket follows from the other and the mark."""
        keys = keys.astype(np.uint64)
        last = np.uint64(len(self.marks) - 1)
        marks = (keys >> np.uint64(48)).astype(np.uint16)
        marks[marks == 0] = 1
        first = (keys & last).astype(np.int64)
        return marks, first, first ^ self.shift(marks)

    def shift(self, marks: np.ndarray) -> np.ndarray:
        mixed = marks.astype(np.uint64) * np.uint64(0x5BD1E995)
        return ((mixed ^ (mixed >> np.uint64(15))) & np.uint64(len(self.marks) - 1)).astype(np.int64)

    def known(self, keys: np.ndarray) -> np.ndarray:
        marks, first, second = self.places(keys)
        return (self.marks[first] == marks[:, None]).any(1) | (self.marks[second] == marks[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """Place all keys; False if one finds no place (the filter is then to be built anew, larger)."""
        for mark, first, second in zip(*self.places(keys), strict=True):
            at = int(first)
            for bucket in (int(first), int(second)):
                free = np.flatnonzero(self.marks[bucket] == 0)
                if len(free):
                    self.marks[bucket, free[0]] = mark
                    break
            else:
                for kick in range(KICKS):
                    slot = kick % SLOTS
                    mark, self.marks[at, slot] = self.marks[at, slot].copy(), mark
                    at ^= int(self.shift(np.array([mark]))[0])
                    free = np.flatnonzero(self.marks[at] == 0)
                    if len(free):
                        self.marks[at, free[0]] = mark
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted."""
        for mark, first, second in zip(*self.places(keys), strict=True):
            for bucket in (int(first), int(second)):
                found = np.flatnonzero(self.marks[bucket] == mark)
                if len(found):
                    self.marks[bucket, found[0]] = 0
                    break


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit("\t\n\x0b\f\r "))


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, with A-Z in lower case."""
    return F.translate(_trimmed(line), UPPER, LOWER)


def _digest(key: Column) -> Column:
    return F.unhex(F.md5(key))


def _number(digest: Column) -> Column:
    """The first 64 bits of a digest, what the filters work on."""
    return F.xxhash64(digest)


def _shard(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit("shard")), F.lit(shards)).cast("int")


def shards_for(keys: int) -> int:
    return 1 << max(4, int(np.ceil(np.log2(max(1, keys) / SHARD_KEYS))))


def _lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """Key digests of all long lines with their documents."""
    line = F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    lines = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), line.alias("line"))
    # Lower case keeps the length, so the key itself is only made for lines that are long enough.
    long = lines.where((F.length("line") >= least_chars) & (F.length(_trimmed(F.col("line"))) >= least_chars))
    return long.select("doc_id", _digest(line_key(F.col("line"))).alias("digest"))


def refs(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row for each long line key and document that holds it."""
    return _lines(docs, least_chars).distinct()


def counts(references: DataFrame) -> DataFrame:
    """Exact reference counts: documents and largest id by key."""
    return references.groupBy("digest").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("largest"))


def filters(repeated: DataFrame, shards: int) -> DataFrame:
    """One cuckoo filter per shard over the given keys."""
    empty = repeated.sparkSession.range(shards).select(
        F.col("id").cast("int").alias("shard"), F.lit(b"").alias("content")
    )
    return change_filters(empty, repeated, repeated.limit(0), shards)


def change_filters(filter_table: DataFrame, added: DataFrame, removed: DataFrame, shards: int) -> DataFrame:
    """The filters after insertion and deletion of keys; each shard is one row and a small group.

    A shard that cannot place a new key gets a null content: marks cannot be dealt anew without
    their keys, so the caller has to build the filters again.
    """
    changes = added.select("digest", F.lit(True).alias("add")).unionByName(
        removed.select("digest", F.lit(False).alias("add"))
    )
    numbered = changes.select(
        _shard(F.col("digest"), shards).alias("shard"), _number(F.col("digest")).alias("number"), "add",
        F.lit(None).cast("binary").alias("content"),
    )
    kept = filter_table.select(
        "shard", F.lit(None).cast("long").alias("number"), F.lit(None).cast("boolean").alias("add"), "content"
    )

    def run(part: pa.Table) -> pa.Table:
        columns = part.to_pydict()
        content = next(c for c in columns["content"] if c is not None)
        pairs = [(n, a) for n, a in zip(columns["number"], columns["add"], strict=True) if n is not None]
        new = np.array(sorted(n for n, a in pairs if a), np.int64)
        old = np.array(sorted(n for n, a in pairs if not a), np.int64)
        if content:
            found = Cuckoo.load(content)
            found.delete(old)
            done = found.insert(new)
        else:
            room = len(new)
            while not (done := (found := Cuckoo.for_keys(room)).insert(new)):
                room = 2 * max(room, 8)
        result = found.dump() if done else None
        return pa.table({"shard": pa.array(columns["shard"][:1], pa.int32()), "content": pa.array([result], pa.binary())})

    return numbered.unionByName(kept).groupBy("shard").applyInArrow(run, "shard int, content binary")


def repeated_lines(
    lines: DataFrame, filter_table: DataFrame, count_table: DataFrame, shards: int, least: int = LEAST_DOCS
) -> DataFrame:
    """The lines (doc_id, digest) whose key is repeated, with the key's largest id."""
    probes = lines.select(
        _shard(F.col("digest"), shards).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
        F.lit(1).alias("kind"), "doc_id", "digest", _number(F.col("digest")).alias("number"),
        F.lit(None).cast("binary").alias("content"),
    )
    salts = F.explode(F.array(*(F.lit(n) for n in range(SALTS))))
    copies = filter_table.select(
        "shard", salts.alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"),
        F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("number"), "content",
    )
    dealt = probes.unionByName(copies).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    needed = dealt.select("kind", "doc_id", "digest", "number", "shard", "content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: Cuckoo | None = None
        for batch in batches:
            kind = batch.column(0).to_numpy()
            starts = [*np.flatnonzero(kind == 0).tolist(), batch.num_rows]
            keep = np.zeros(batch.num_rows, bool)
            numbers = batch.column(3).fill_null(0).to_numpy()
            done = 0
            for start in starts:
                if start > done:
                    keep[done:start] = current.known(numbers[done:start])
                if start < batch.num_rows:
                    current = Cuckoo.load(batch.column(5)[start].as_py())
                    done = start + 1
            chosen = pa.array(np.flatnonzero(keep))
            if len(chosen):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(chosen), batch.column(2).take(chosen)], names=["doc_id", "digest"]
                )

    maybe = needed.mapInArrow(run, "doc_id long, digest binary")
    surely = count_table.where(F.col("n_docs") >= least).select("digest", "largest")
    return maybe.join(surely, "digest")


def drop_lines(docs: DataFrame, drops: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The documents without the lines whose keys ``drops`` (doc_id, digest) lists for them.

    New columns: n_lines (before), n_dropped, and ``text`` holds the lines that stay.
    """
    own = [name for name in docs.columns if name not in ("n_lines", "n_dropped")]
    # Texts travel once, beside the other columns.
    others = F.struct(*(F.col(f"`{name}`") for name in own if name != "text")).alias("row")
    known = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.coalesce("text", F.lit("")).alias("own_text"), others)
    per_doc = drops.groupBy(F.col("doc_id").alias("drop_id")).agg(F.collect_set("digest").alias("drops"))
    joined = known.join(per_doc, F.col("own_id") == F.col("drop_id"), "left")
    lines = F.split("own_text", "\n", -1)
    kept = F.when(F.col("drops").isNull(), lines).otherwise(F.filter(
        lines,
        lambda line: (F.length(line) < least_chars) | ~F.coalesce(F.array_contains("drops", _digest(line_key(line))), F.lit(False)),
    ))
    counted = joined.select("row", F.size(lines).cast("long").alias("n_lines"), kept.alias("kept"))
    fields = [F.array_join("kept", "\n").alias("text") if name == "text" else F.col("row")[name].alias(name) for name in own]
    return counted.select(*fields, "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"))


class LineIndex:
    """References, counts and filters of a corpus, stored in the shared folder."""

    def __init__(
        self, references: DataFrame, count_table: DataFrame, least: int, filter_table: DataFrame | None = None,
        shards: int = 0,
    ):
        self.refs, self.counts, self.least, self.filters, self.shards = references, count_table, least, filter_table, shards
        if filter_table is None:
            self.shards = shards_for(self.repeated().count())
            self.filters = stored(filters(self.repeated(), self.shards), "line-filters")

    def repeated(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.least)

    @classmethod
    def build(cls, docs: DataFrame, least: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, keep_refs: bool = True) -> LineIndex:
        """``keep_refs`` off saves the references, which only later insertions and deletions need."""
        references = refs(docs, least_chars)
        if keep_refs:
            references = stored(references, "line-refs")
            count_table = stored(counts(references), "line-counts")
        else:
            # Only repeated keys matter for dropping; the rest of the exact table is not written.
            count_table = stored(counts(references).where(F.col("n_docs") >= least), "line-counts")
        return cls(references, count_table, least)

    def insert(self, docs: DataFrame, least_chars: int = LEAST_CHARS) -> LineIndex:
        """The index with more documents; those that it holds already are not counted again."""
        more = refs(docs, least_chars).join(self.refs, ["doc_id", "digest"], "left_anti")
        return self._changed(stored(more, "line-refs-more"), adding=True)

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents of these ids."""
        gone = self.refs.join(ids.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
        return self._changed(stored(gone, "line-refs-less"), adding=False)

    def _changed(self, references: DataFrame, adding: bool) -> LineIndex:
        if adding:
            all_refs = stored(self.refs.unionByName(references), "line-refs")
        else:
            all_refs = stored(self.refs.join(references, ["doc_id", "digest"], "left_anti"), "line-refs")
        touched = references.select("digest").distinct()
        before = self.counts.join(touched, "digest", "left_semi")
        after = counts(all_refs.join(touched, "digest", "left_semi"))
        count_table = stored(self.counts.join(touched, "digest", "left_anti").unionByName(after), "line-counts")
        was, now = (t.where(F.col("n_docs") >= self.least).select("digest") for t in (before, after))
        changed = stored(
            change_filters(self.filters, now.join(was, "digest", "left_anti"), was.join(now, "digest", "left_anti"), self.shards),
            "line-filters",
        )
        whole = not changed.where("content IS NULL").take(1)
        return LineIndex(all_refs, count_table, self.least, changed if whole else None, self.shards)

    def drops(self, docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
        """Keys to drop by document: the repeated ones, except in the largest id that holds them."""
        found = repeated_lines(_lines(docs, least_chars), self.filters, self.counts, self.shards, self.least)
        return found.where(F.col("doc_id") != F.col("largest")).select("doc_id", "digest").distinct()


def dedup_lines(docs: DataFrame, least: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The documents without repeated long lines; see ``drop_lines`` for the columns."""
    index = LineIndex.build(docs, least, least_chars, keep_refs=False)
    return drop_lines(docs, index.drops(docs, least_chars), least_chars)


_STRIP = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE = f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, {_STRIP}), '{UPPER}', '{LOWER}') AS key FROM lines
), repeated AS (
    SELECT key, max(doc_id) AS largest FROM keyed WHERE length(key) >= {LEAST_CHARS}
    GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}
), marked AS (
    SELECT k.doc_id, k.place, k.line, r.key IS NOT NULL AND r.largest <> k.doc_id AS gone
    FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op7_line_dedup", ORACLE)
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
