"""Raw archives: discovery, header probing, digests and staging as text rows."""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationlake.functions import values
from stationlake.operators.selection import periods_overlap
from stationlake.sources.files import list_files, open_stream

CHUNK_BYTES = 1 << 20
# Bytes that windows-1252 leaves undefined, as ISO-8859-1 reads them.
UNDEFINED = "[\\x81\\x8d\\x8f\\x90\\x9d]"
MOST_TASKS = 10_000
DELIMITERS = ";,\t|"
# The charset names Spark and Python use for the two encodings archives have.
ENCODINGS = {"utf-8-sig": "UTF-8", "cp1252": "windows-1252"}
ARCHIVE_SCHEMA = (
    "path string, filename string, department string, period_start int, period_end int, "
    "size bigint, mtime_ns bigint"
)
# A quoted field that is still open after so many bytes was no quoted field.
MOST_RECORD_BYTES = 1 << 18


def discover_archives(
    spark: SparkSession, root: str, departments: Iterable[str] | None = None,
    start_year: int | None = None, end_year: int | None = None,
) -> DataFrame:
    """Archives in a folder whose name fits, by department and period."""
    return select_archives(list_files(spark, root, "*.csv.gz"), departments, start_year, end_year)


def select_archives(
    listing: DataFrame, departments: Iterable[str] | None = None,
    start_year: int | None = None, end_year: int | None = None,
) -> DataFrame:
    """Name parts of listed files; other names and periods outside are left out."""
    name = F.col("filename")
    archives = listing.withColumns(
        {
            "department": F.upper(values.archive_department(name)),
            "period_start": values.archive_start(name),
            "period_end": values.archive_end(name),
        }
    ).where(F.col("department").isNotNull())
    if departments:
        archives = archives.where(F.col("department").isin(sorted({d.upper() for d in departments})))
    return archives.where(
        periods_overlap(F.col("period_start"), F.col("period_end"), start_year, end_year)
    ).orderBy("department", "period_start", "filename")


def _layout(header: bytes | None, utf8: bool) -> dict:
    """Encoding, delimiter and columns from the first record of an archive."""
    encoding = "utf-8-sig" if utf8 else "cp1252"
    line = (header or b"").decode(encoding)
    if not line.strip():
        raise ValueError("no header line in the archive")
    delimiter = max(DELIMITERS, key=line.count)
    if delimiter not in line:
        raise ValueError(f"no delimiter in the header line (none of {DELIMITERS!r})")
    columns = [field.strip('"') for field in line.split(delimiter)]
    if not all(columns):
        raise ValueError("the header line has an unnamed column")
    return {"encoding": encoding, "delimiter": delimiter, "columns": columns}


def _describe_header(path: str) -> dict:
    decoder, header, ended, utf8 = codecs.getincrementaldecoder("utf-8")(), b"", False, True
    with open_stream(path, "gzip") as stream:
        more = True
        while more and (utf8 or not ended):
            chunk = stream.read(CHUNK_BYTES)
            more = bool(chunk)
            if not ended:
                end = re.search(rb"[\r\n]", chunk)
                header, ended = header + chunk[: end.start() if end else None], end is not None
            try:
                decoder.decode(chunk, not chunk)
            except UnicodeDecodeError:
                utf8 = False
    return _layout(header, utf8)


def _probe_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for path in batch["path"]:
            row = {"encoding": None, "delimiter": None, "columns": None, "inspection_error": None}
            try:
                row.update(_describe_header(path))
            except Exception as error:  # one unreadable archive must not stop the report
                row["inspection_error"] = f"{type(error).__name__}: {error}"
            found.append(row)
        yield batch.assign(**{name: [row[name] for row in found] for name in found[0]} if found else {})


def probe_headers(archives: DataFrame) -> DataFrame:
    """Encoding, delimiter and header of each archive, where its rows are not wanted.

    An archive is UTF-8 if all its bytes are, and windows-1252 otherwise; it streams through a task in
    chunks up to the first byte that decides.  A job that also needs rows takes :func:`read_archives`, which
    opens every archive once.
    """
    listed = archives.select(
        "path", "filename", "department", "period_start", "period_end", "size", "mtime_ns"
    )
    schema = ARCHIVE_SCHEMA + (
        ", encoding string, delimiter string, columns array<string>, inspection_error string"
    )
    return _spread(listed).mapInPandas(_probe_batches, schema)


def _spread(listed: DataFrame) -> DataFrame:
    """A task for every file, or, of very many, for files of all sizes: the largest are dealt first, in turns."""
    files = listed.count()
    tasks = max(1, min(files, MOST_TASKS))
    # The listing holds names and sizes only.
    place = F.row_number().over(Window.orderBy(F.desc("size"), "path")) - 1
    dealt = listed.withColumn("task", F.pmod(place, F.lit(tasks)))
    return dealt.repartitionById(tasks, F.col("task")).drop("task")


def _hash_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        digests = []
        for path in batch["path"]:
            digest = hashlib.sha256()
            with open_stream(path) as stream:
                while chunk := stream.read(1 << 20):
                    digest.update(chunk)
            digests.append(digest.hexdigest())
        yield batch.assign(sha256=digests)


def fingerprint_archives(archives: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """SHA-256 per archive; files with known size and time keep their digest.

    Files stream through a task in small chunks, whatever their size.
    """
    listed = archives.select(
        "path", "filename", "department", "period_start", "period_end", "size", "mtime_ns"
    )
    schema = ARCHIVE_SCHEMA + ", sha256 string"
    if previous is None:
        return _spread(listed).mapInPandas(_hash_batches, schema)
    known = listed.join(
        previous.select("filename", "size", "mtime_ns", "sha256"), ["filename", "size", "mtime_ns"], "left"
    ).select(*listed.columns, "sha256")
    fresh = known.where(F.col("sha256").isNull()).drop("sha256")
    hashed = _spread(fresh).mapInPandas(_hash_batches, schema)
    return known.where(F.col("sha256").isNotNull()).unionByName(hashed)


# --------------------------------------------------------------------- records
class RecordSplitter:
    """Records of a byte stream that comes in chunks: lines, but for line breaks within quotes.

    A quote opens a field only where the field begins, and two quotes in it stand for one.  A quote that
    nothing closes within ``MOST_RECORD_BYTES`` (or the archive) makes its own line a broken record; the
    lines behind it are read as if it were not there.
    """

    def __init__(self) -> None:
        self.carry, self.delimiter = b"", b""
        self.line = self.number = 0
        self.held: list[bytes] = []
        self.held_from = self.held_bytes = 0
        self.made: list[tuple[int, int, bytes, bool]] = []

    def feed(self, chunk: bytes, last: bool = False) -> list[tuple[int, int, bytes, bool]]:
        """(Record number, its first line, content, broken) of the records that a chunk completes."""
        lines = (self.carry + chunk).splitlines(keepends=True)
        self.carry = b""
        # A return at the end may be followed by a line feed in the next chunk.
        if not last and lines and not lines[-1].endswith(b"\n"):
            self.carry = lines.pop()
        if lines and not self.line:
            lines[0] = lines[0].removeprefix(codecs.BOM_UTF8)
            self.delimiter = max((d.encode() for d in DELIMITERS), key=lines[0].count)
        for line in lines:
            self.line += 1
            self._take(line, self.line)
        while last and self.held:
            self._give_up()
        made, self.made = self.made, []
        return made

    def _take(self, line: bytes, number: int) -> None:
        if not self.held and b'"' not in line:
            self._emit(line, number)
            return
        opened = self._opened(line.rstrip(b"\r\n"), bool(self.held))
        if not self.held and not opened:
            self._emit(line, number)
            return
        if not self.held:
            self.held_from, self.held_bytes = number, 0
        self.held.append(line)
        self.held_bytes += len(line)
        if not opened:
            record, self.held = b"".join(self.held), []
            self._emit(record, self.held_from)
        elif self.held_bytes > MOST_RECORD_BYTES:
            self._give_up()

    def _emit(self, record: bytes, line: int, broken: bool = False) -> None:
        self.number += 1
        self.made.append((self.number, line, record.rstrip(b"\r\n"), broken))

    def _give_up(self) -> None:
        lines, first, self.held = self.held, self.held_from, []
        self._emit(lines[0], first, broken=True)
        for n, line in enumerate(lines[1:], first + 1):
            self._take(line, n)

    def _opened(self, line: bytes, opened: bool) -> bool:
        """Whether a quoted field is open behind a line, given whether one was before it."""
        at = 0
        while True:
            if not opened and line[at : at + 1] == b'"':
                opened, at = True, at + 1
            while opened:
                end = line.find(b'"', at)
                if end < 0:
                    return True
                doubled = line[end + 1 : end + 2] == b'"'
                opened, at = doubled, end + 1 + doubled
            at = line.find(self.delimiter, at)
            if at < 0:
                return False
            at += 1


def _record_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives (filename, path) to their records; a failure to read is a row of its own."""

    def made(name: str, rows: list[tuple[int, int, bytes, bool]], error: str | None = None) -> pa.RecordBatch:
        numbers, lines, records, broken = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(numbers, pa.int64()), pa.array(lines, pa.int64()), pa.array(records, pa.binary()),
                pa.array(broken, pa.bool_()), pa.array([error] * len(rows), pa.string()), pa.array([name] * len(rows), pa.string()),
            ],
            names=["record_number", "line_number", "record", "broken", "read_error", "source_file"],
        )

    for batch in batches:
        for name, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            splitter = RecordSplitter()
            try:
                with open_stream(path, "gzip") as stream:
                    while chunk := stream.read(CHUNK_BYTES):
                        if rows := splitter.feed(chunk):
                            yield made(name, rows)
                if rows := splitter.feed(b"", last=True):
                    yield made(name, rows)
            except (OSError, EOFError, ValueError) as error:
                yield made(name, [(0, 0, None, True)], f"{type(error).__name__}: {error}")


RECORD_FIELDS = "record_number bigint, line_number bigint, record binary, broken boolean, read_error string, source_file string"


def stage_records(spark: SparkSession, archives: DataFrame, folder: str) -> DataFrame:
    """Records of archives as bytes, in one folder per archive; every archive streams through one task, once.

    Nothing is decoded yet.  A record has its number in the archive (the header is 1) and that of its first line.
    """
    listed = _spread(archives.select("filename", "path", "size")).select("filename", "path")
    records = listed.mapInArrow(_record_batches, RECORD_FIELDS)
    records.write.mode("overwrite").option("compression", "zstd").partitionBy("source_file").parquet(folder)
    return spark.read.schema(RECORD_FIELDS).parquet(folder)


def _describe_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for header, utf8, error in zip(batch.pop("header"), batch.pop("utf8"), batch.pop("read_error"), strict=True):
            row = {"encoding": None, "delimiter": None, "columns": None, "inspection_error": error}
            if error is None:
                try:
                    row.update(_layout(header, utf8 is None or bool(utf8)))
                except ValueError as problem:
                    row["inspection_error"] = f"ValueError: {problem}"
            found.append(row)
        yield batch.assign(**{name: [row[name] for row in found] for name in found[0]} if found else {})


def describe_records(archives: DataFrame, records: DataFrame) -> DataFrame:
    """Encoding, delimiter and header of each archive from its staged records.

    An archive is UTF-8 if all its records are: one aggregate per archive, combined before the shuffle.
    """
    text = F.col("record").cast("string")
    first = F.col("record_number") == 1
    known = records.groupBy("source_file").agg(
        F.bool_and(F.is_valid_utf8(text)).alias("utf8"),
        F.max(F.when(first, F.col("record"))).alias("header"),
        F.max("read_error").alias("read_error"),
    )
    listed = archives.select("path", "filename", "department", "period_start", "period_end", "size", "mtime_ns")
    joined = listed.join(known, listed["filename"] == known["source_file"], "left").drop("source_file")
    schema = ARCHIVE_SCHEMA + ", encoding string, delimiter string, columns array<string>, inspection_error string"
    return joined.mapInPandas(_describe_batches, schema)


def _text_rows(records: DataFrame, encoding: str, delimiter: str, columns: list[str]) -> DataFrame:
    """Numbered rows of archives that share encoding, delimiter and header."""
    content, undecodable = F.col("record"), F.lit(False)
    text = content.cast("string")
    if encoding != "utf-8-sig":
        latin = F.decode(content, "ISO-8859-1")
        undecodable = latin.rlike(UNDEFINED)
        text = F.when(undecodable, latin).otherwise(F.decode(F.when(~undecodable, content), ENCODINGS[encoding]))
    lines = records.where("record_number > 1").select(
        "source_file", F.col("record_number").alias("source_row_number"), text.alias("value"),
        (undecodable | F.col("broken")).alias("unreadable"),
    )
    fields = [f"c{n}" for n in range(len(columns))]
    options = {
        "sep": delimiter, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt", "escape": '"', "multiLine": "true",
    }
    layout = ", ".join(f"{field} string" for field in fields) + ", corrupt string"
    parsed = lines.withColumn("row", F.from_csv("value", layout, options))
    # A repeated column name means its last occurrence.
    position = {name: n for n, name in enumerate(columns)}
    return parsed.select(
        "source_file",
        "source_row_number",
        (F.col("unreadable") | F.col("row.corrupt").isNotNull() | (F.trim("value") == "")).alias("is_malformed"),
        *[F.col(f"row.c{n}").alias(name) for name, n in position.items()],
    )


def parse_records(spark: SparkSession, records: DataFrame, headers: DataFrame, folder: str) -> DataFrame:
    """Text rows of the readable archives as a Parquet table.

    Later steps read the few columns they need from splittable files instead of decompressing
    whole archives again, and a lost executor costs only its own tasks.
    """
    readable = headers.where(F.col("inspection_error").isNull())
    # One row per distinct layout; the lists hold file names, not data.
    layouts = (
        readable.groupBy("encoding", "delimiter", "columns")
        .agg(F.sort_array(F.collect_list("filename")).alias("names"))
        .collect()
    )
    if not layouts:
        raise ValueError("No readable archives")
    parts = [
        _text_rows(records.where(F.col("source_file").isin(l.names)), l.encoding, l.delimiter, l.columns) for l in layouts
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    name = F.col("source_file")
    described = rows.withColumns(
        {
            "department": F.upper(values.archive_department(name)),
            "period_start": values.archive_start(name),
            "period_end": values.archive_end(name),
        }
    )
    described.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return spark.read.schema(described.schema).parquet(folder)


def read_archives(spark: SparkSession, archives: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Headers of archives and their staged records: every archive is decompressed once."""
    records = stage_records(spark, archives, f"{folder}/records")
    describe_records(archives, records).write.mode("overwrite").parquet(f"{folder}/headers")
    return spark.read.parquet(f"{folder}/headers"), records


def stage_archives(spark: SparkSession, headers: DataFrame, folder: str) -> DataFrame:
    """Text rows of archives whose headers are known already."""
    readable = headers.where(F.col("inspection_error").isNull())
    if not readable.take(1):
        raise ValueError("No readable archives")
    return parse_records(spark, stage_records(spark, readable, f"{folder}.records"), headers, folder)
