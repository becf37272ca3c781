"""Quality classifier: perplexity under interpolated modified Kneser-Ney models of trusted text.

Two models of one form look at every text: one over characters folded to ``SYMBOLS`` classes, four at a time, and one
over the unfolded UTF-8 bytes, ``BYTE_ORDER`` at a time, whose tables grow with the trusted text in any script.  Counts are
taken from all trusted documents (labelled good and not toxic, but for a share held out), combined per
batch and summed by n-gram over shards.  Lower orders are continuation counts of the order above.
Discounts come from the counts of counts.  Probabilities are joins of the sharded counts with the
totals of their contexts and with the probabilities of the order below.

Scoring is by joins as well; no table is sent to all tasks or passes through the driver.  The different n-grams of
the corpus are joined, order by order, with the sharded probabilities and with the weights that contexts leave.  Documents are
put into chunks of some ``CHUNK`` bytes; the different n-grams of a chunk are joined with their surprises, and a chunk then meets
the rows of its own n-grams.  An n-gram has at most ``size`` followers and predecessors, so tables have no hot keys; one that
most chunks hold is joined by salts of ``PER_SALT`` input partitions, whose number grows with the corpus.
Chunks travel packed and once.  Texts without a label do not travel for training: a bitmap of fixed size leaves out most of
them, the join with the labels decides.

A document's score is its mean surprise (log-perplexity) over all its characters, or bytes, so that ``perplexity`` is the
document's (``byte_perplexity`` that under the model of bytes).  Each is compared with documents of its language: the distance to
their median times the root of its length is on one scale for all lengths.  The threshold of a
language lies ``REACH`` times as far above the median as the 95 % quantile of held-out trusted documents
(and ``LOW_REACH`` times as far below as the 5 % quantile: text that surprises far too little repeats itself);
languages with few of these take the quantiles of all languages.  A document is kept if both scores lie within.

Defined cases: null or empty text has no score and is rejected; null language is a language of its own; labels
that repeat an id count by their smallest quality; without trusted documents every document with text is kept;
null ids are scored like others; repeated rows are judged one by one; an empty table gives an empty
table; other columns stay, and columns named like an output are replaced; rows that change between two
readings of the input are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from stationlake.llm.arrow import texts
from stationlake.llm.registry import query, table
from stationlake.session import stored

SYMBOLS = 48
ORDER = 4
BYTE_ORDER = 4
CHUNK = 16 << 20  # bytes of text that one task scores at once
PIECE = 1 << 20  # characters that are looked up at once
CHUNKS = 1 << 20  # most chunks of one input partition
PER_SALT = 1024
FILTER_BITS = 1 << 26
DENSE = 1 << 23  # alphabets of at most so many n-grams are looked up in arrays
SLOT_BITS = 21
HELD_OUT = 4  # every fourth trusted document sets thresholds and does not train
REACH = 2.0
LOW_REACH = 3.0
FEW = 30
LONGEST = 20_000  # beyond so many symbols a document's mean is no longer taken to get surer
_BLANK = 29


def _fold() -> np.ndarray:
    """Symbol of every code point below 65536; what lies above is folded by its last bits."""
    found = np.zeros(65536, np.int64)
    for code in range(65536):
        sign = chr(code)
        if "a" <= sign <= "z":
            found[code] = code - 97
        elif sign.isupper():
            found[code] = 26
        elif sign.isdigit():
            found[code] = 27
        elif sign in "\n\r":
            found[code] = 28
        elif sign.isspace():
            found[code] = _BLANK
        elif sign in ".,!?|#*$%&<>":
            found[code] = {".": 30, ",": 31, "!": 32, "?": 32, "|": 33}.get(sign, 34)
        elif sign.isalpha():
            found[code] = 36 + code % 8
        else:
            found[code] = 35 if code < 256 else 44 + code % 4
    return found


_SYMBOL_OF = _fold()


def _classes(text: str) -> np.ndarray:
    return _SYMBOL_OF[np.frombuffer(text.encode("utf-32-le"), np.uint32) & 0xFFFF]


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8).astype(np.int64)


@dataclass(frozen=True)
class Alphabet:
    """What a model reads: its signs, how many it takes at a time, and the names of its columns."""

    prefix: str
    length: str
    size: int
    order: int
    blank: int
    first: int  # n-grams of all alphabets share a column: those of this one start here
    signs: Callable[[str], np.ndarray]

    @property
    def last(self) -> int:
        return self.first + self.size**self.order

    @property
    def dense(self) -> bool:
        return self.size**self.order <= DENSE


CLASSES = Alphabet("", "n_symbols", SYMBOLS, ORDER, _BLANK, 0, _classes)
BYTES = Alphabet("byte_", "n_bytes", 256, BYTE_ORDER, 32, 1 << 60, _bytes)
ALPHABETS = (CLASSES, BYTES)


def codes(text: str, alphabet: Alphabet = CLASSES) -> np.ndarray:
    """The n-gram that ends at each sign, as one number; before the text there are blanks."""
    return codes_of([text], alphabet)[0]


def codes_of(some: list[str], alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of several texts one after the other, and how many each text has."""
    pad = " " * (alphabet.order - 1)
    signs = alphabet.signs("".join(pad + text for text in some))
    lengths = np.array([len(text.encode()) if alphabet is BYTES else len(text) for text in some])
    found = signs[: len(signs) - alphabet.order + 1]
    for at in range(1, alphabet.order):
        found = found * alphabet.size + signs[at : at + len(found)]
    inside = np.ones(len(found), bool)
    # Where the blanks before a text have not been read in full, an n-gram belongs to two texts.
    ends = np.cumsum(lengths + alphabet.order - 1)[:-1] - (alphabet.order - 1)
    inside[(ends[:, None] + np.arange(alphabet.order - 1)).ravel()] = False
    return found[inside], lengths


def pieces(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column, some ``PIECE`` characters at a time."""
    held, size = [], 0
    for text in texts(column):
        held.append(text)
        size += len(text) + 1
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _slots(grams: np.ndarray) -> np.ndarray:
    return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Different:
    """The different n-grams of many texts: one in each slot of an array, and sorted ones that found theirs taken."""

    def __init__(self, alphabet: Alphabet) -> None:
        self.alphabet = alphabet
        self.slots = np.zeros(alphabet.last - alphabet.first, bool) if alphabet.dense else np.full(1 << SLOT_BITS, -1)
        self.others = np.zeros(0, np.int64)

    def add(self, grams: np.ndarray) -> None:
        if self.alphabet.dense:
            self.slots[grams] = True
            return
        at = _slots(grams)
        free = self.slots[at] == -1
        self.slots[at[free]] = grams[free]
        other = grams[self.slots[at] != grams]
        if len(other):
            self.others = np.union1d(self.others, other)

    def grams(self) -> np.ndarray:
        """All of them, sorted, as numbers that tell alphabets apart."""
        found = np.flatnonzero(self.slots) if self.alphabet.dense else np.union1d(self.slots[self.slots >= 0], self.others)
        return found + self.alphabet.first


def _different(columns: list[pa.Array]) -> np.ndarray:
    """The different n-grams of all alphabets in text columns, sorted."""
    found = []
    for alphabet in ALPHABETS:
        seen = Different(alphabet)
        for column in columns:
            for some in pieces(column):
                seen.add(codes_of(some, alphabet)[0])
        found.append(seen.grams())
    return np.concatenate(found)


def ngram_counts(trusted: DataFrame) -> DataFrame:
    """n-grams of all texts with their counts; pieces are combined before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch.column(0)):
                for alphabet in ALPHABETS:
                    grams, count = np.unique(codes_of(some, alphabet)[0], return_counts=True)
                    made = [pa.array(grams + alphabet.first), pa.array(count.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(made, names=["gram", "n"])

    return trusted.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def ngrams(docs: DataFrame) -> DataFrame:
    """The different n-grams of all texts; those of a batch are combined before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_different([batch.column(0)]))], names=["gram"])

    return docs.select("text").mapInArrow(run, "gram long").distinct()


def discounts(count_table: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more."""
    times = count_table.agg(*(F.count(F.when(F.col("n") == n, 1)) for n in (1, 2, 3, 4))).first()
    once, twice, thrice, four = (float(t) for t in times)
    share = once / (once + 2 * twice) if once + twice else 0.0
    raw = (
        1 - 2 * share * twice / max(once, 1.0), 2 - 3 * share * thrice / max(twice, 1.0),
        3 - 4 * share * four / max(thrice, 1.0),
    )
    return [min(max(value, 0.0), float(most)) for value, most in zip(raw, (1, 2, 3), strict=True)]


@dataclass
class Order:
    """One order of a model: probabilities of seen n-grams, and what seen contexts leave to the order below."""

    chances: DataFrame  # gram, chance
    contexts: DataFrame  # context, left


@dataclass
class Model:
    """The sharded tables of every alphabet, lowest order first."""

    orders: dict[str, list[Order]]

    def surprises(self) -> np.ndarray:
        """Minus the log-probability of every n-gram of classes, to look into the model; scoring does not use it."""
        chance = np.full(1, 1 / SYMBOLS)
        for order in self.orders[CLASSES.prefix]:
            lower = np.tile(chance, SYMBOLS) if len(chance) > 1 else np.full(SYMBOLS, chance[0])
            rows = len(lower) // SYMBOLS
            weight = np.ones(rows)
            left, seen = order.contexts.toArrow(), order.chances.toArrow()
            weight[left["context"].to_numpy()] = left["left"].to_numpy()
            chance = (lower.reshape(rows, SYMBOLS) * weight[:, None]).ravel()
            chance[seen["gram"].to_numpy()] = seen["chance"].to_numpy()
        return -np.log(np.maximum(chance, 1e-12)).astype(np.float32)


def train(trusted: DataFrame) -> Model | None:
    """The model of all given texts, or None where they have no character."""
    counts = stored(ngram_counts(trusted), "lm-counts")
    if counts.isEmpty():
        return None
    return Model({alphabet.prefix: _orders(_own(counts, alphabet), alphabet) for alphabet in ALPHABETS})


def _own(grams: DataFrame, alphabet: Alphabet) -> DataFrame:
    """The rows of one alphabet, their n-grams counted from 0."""
    own = grams.where(F.col("gram").between(alphabet.first, alphabet.last - 1))
    return own.withColumn("gram", F.col("gram") - F.lit(alphabet.first))


def _orders(counts: DataFrame, alphabet: Alphabet) -> list[Order]:
    by_order = {alphabet.order: counts}
    for order in range(alphabet.order - 1, 0, -1):
        # An n-gram counts once for each sign that precedes it.
        shorter = (F.col("gram") % alphabet.size**order).alias("gram")
        by_order[order] = stored(
            by_order[order + 1].select(shorter).groupBy("gram").agg(F.count("*").alias("n")), "lm-counts"
        )
    found, below = [], None
    for order in range(1, alphabet.order + 1):
        one, two, more = discounts(by_order[order])
        cut = F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)
        counted = by_order[order].select("gram", "n", F.expr(f"gram div {alphabet.size}").alias("context"), cut.alias("cut"))
        contexts = counted.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("cuts"))
        contexts = stored(contexts.select("context", "total", (F.col("cuts") / F.col("total")).alias("left")), "lm-contexts")
        joined = counted.join(contexts, "context")
        if below is None:
            joined = joined.withColumn("lower", F.lit(1 / alphabet.size))
        else:
            suffix = F.col("gram") % alphabet.size ** (order - 1)
            joined = joined.withColumn("suffix", suffix).join(
                below.select(F.col("gram").alias("suffix"), F.col("chance").alias("lower")), "suffix"
            )
        own = F.greatest(F.col("n") - F.col("cut"), F.lit(0.0)) / F.col("total")
        below = stored(joined.select("gram", (own + F.col("left") * F.col("lower")).alias("chance")), "lm-chances")
        found.append(Order(below, contexts.select("context", "left")))
    return found


def surprises_of(grams: DataFrame, model: Model) -> DataFrame:
    """Minus the log-probability of every given n-gram, joined from the sharded tables order by order."""
    found = None
    for alphabet in ALPHABETS:
        wanted = {alphabet.order: _own(grams, alphabet)}
        for order in range(alphabet.order - 1, 0, -1):
            shorter = (F.col("gram") % alphabet.size**order).alias("gram")
            wanted[order] = stored(wanted[order + 1].select(shorter).distinct(), "lm-wanted")
        below = None
        for order, tables in enumerate(model.orders[alphabet.prefix], 1):
            rows = wanted[order].withColumn("context", F.expr(f"gram div {alphabet.size}"))
            rows = rows.join(tables.chances, "gram", "left").join(tables.contexts, "context", "left")
            if below is None:
                rows = rows.withColumn("lower", F.lit(1 / alphabet.size))
            else:
                suffix = F.col("gram") % alphabet.size ** (order - 1)
                rows = rows.withColumn("suffix", suffix).join(
                    below.select(F.col("gram").alias("suffix"), F.col("chance").alias("lower")), "suffix"
                )
            weight = F.coalesce("left", F.lit(1.0))
            below = stored(rows.select("gram", F.coalesce("chance", weight * F.col("lower")).alias("chance")), "lm-wanted")
        surprise = (-F.log(F.greatest("chance", F.lit(1e-12)))).cast("float").alias("surprise")
        below = below.select((F.col("gram") + F.lit(alphabet.first)).alias("gram"), surprise)
        found = below if found is None else found.unionAll(below)
    return found


def _to_bytes(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    with pa.ipc.new_stream(sink, batches[0].schema, options=options) as stream:
        for batch in batches:
            stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _cuts(column: pa.Array, room: int) -> Iterator[tuple[int, int]]:
    """First row and number of rows of stretches of ``CHUNK`` bytes, the first one of ``room`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    start, before = 0, 0
    while start < len(ends):
        end = max(int(np.searchsorted(ends, before + room, side="right")), start + 1)
        yield start, end - start
        start, before, room = end, int(ends[end - 1]), CHUNK


def _packed(docs: DataFrame) -> DataFrame:
    """The documents in chunks: all their rows, and the different n-grams of their texts as steps from one to the next."""
    place = docs.columns.index("text")

    def row(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        steps = np.diff(_different([batch.column(place) for batch in held]), prepend=0)
        grams = pa.RecordBatch.from_arrays([pa.array(steps)], names=["step"])
        return pa.RecordBatch.from_pydict({
            "chunk": pa.array([number], pa.int64()), "rows": pa.array([_to_bytes(held)], pa.binary()),
            "grams": pa.array([_to_bytes([grams])], pa.binary()),
        })

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() * CHUNKS, [], 0
        for batch in batches:
            for start, rows in _cuts(batch.column(place), max(CHUNK - size, 0)):
                part = batch.slice(start, rows)
                added = (pc.sum(pc.binary_length(part.column(place))).as_py() or 0) + 64 * rows
                if held and size + added > CHUNK:
                    yield row(number, held)
                    number, held, size = number + 1, [], 0
                held.append(part)
                size += added
        if held:
            yield row(number, held)

    return docs.mapInArrow(run, "chunk long, rows binary, grams binary").repartition("chunk")


def _unpacked_grams(packed: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, grams in zip(batch.column("chunk"), batch.column("grams"), strict=True):
                steps = pa.ipc.open_stream(grams.as_buffer()).read_all()["step"].to_numpy()
                chunks = pa.array(np.full(len(steps), chunk.as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([chunks, pa.array(np.cumsum(steps))], names=["chunk", "gram"])

    return packed.mapInArrow(run, "chunk long, gram long")


def score(docs: DataFrame, surprises: DataFrame, keep_text: bool = True) -> DataFrame:
    """The documents with the mean surprise (null without text) and length of every alphabet.

    ``surprises`` has a row for every n-gram of the documents.
    """
    fields = [
        found for alphabet in ALPHABETS
        for found in (StructField(f"{alphabet.prefix}surprise", DoubleType()), StructField(alphabet.length, LongType()))
    ]
    base = docs.drop(*(f.name for f in fields))
    place = base.columns.index("text")
    back = [at for at in range(len(base.columns)) if keep_text or at != place]
    schema = StructType([base.schema.fields[at] for at in back] + fields)
    names = schema.names

    def finish(chunk: pa.Table, rows: pa.Table) -> pa.Table:
        known = {alphabet: Known(alphabet, rows["gram"].to_numpy(), rows["surprise"].to_numpy()) for alphabet in ALPHABETS}
        done = []
        for batch in pa.ipc.open_stream(chunk["rows"].chunk(0)[0].as_buffer()):
            made = [array for alphabet in ALPHABETS for array in means(batch.column(place), alphabet, known[alphabet])]
            done.append(pa.RecordBatch.from_arrays([batch.column(at) for at in back] + made, names=names))
        return pa.Table.from_batches(done)

    packed = _packed(base)
    salted = _unpacked_grams(packed).withColumn("salt", F.expr(f"chunk div {CHUNKS * PER_SALT}"))
    copies = salted.select("salt", "gram").distinct().join(surprises.hint("merge"), "gram")
    known = salted.join(copies, ["salt", "gram"]).select("chunk", "gram", "surprise")
    return packed.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(finish, schema)


class Known:
    """Surprises by n-gram: one in each slot of an array, all of them sorted."""

    def __init__(self, alphabet: Alphabet, grams: np.ndarray, surprises: np.ndarray) -> None:
        own = (grams >= alphabet.first) & (grams < alphabet.last)
        grams, surprises = grams[own] - alphabet.first, surprises[own]
        by = np.argsort(grams)
        self.grams, self.surprises = grams[by], surprises[by]
        if alphabet.dense:
            self.slots, self.values = None, np.full(alphabet.size**alphabet.order, np.nan, np.float32)
            self.values[grams] = surprises
        else:
            self.slots, self.values = np.full(1 << SLOT_BITS, -1), np.zeros(1 << SLOT_BITS, np.float32)
            at, first = np.unique(_slots(self.grams), return_index=True)
            self.slots[at], self.values[at] = self.grams[first], self.surprises[first]

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """Surprises of n-grams, all of which must be known."""
        if self.slots is None:
            found = self.values[wanted]
            strange = np.isnan(found).any()
        else:
            at = _slots(wanted)
            found = self.values[at]
            rest = np.flatnonzero(self.slots[at] != wanted)
            place = np.searchsorted(self.grams, wanted[rest])
            strange = len(rest) and (place.max() == len(self.grams) or (self.grams[place] != wanted[rest]).any())
            if not strange:
                found[rest] = self.surprises[place]
        if strange:
            raise ValueError("the documents changed while they were scored")
        return found


def means(column: pa.Array, alphabet: Alphabet, known: Known) -> list[pa.Array]:
    """Mean surprise of every text (null without signs) and its number of signs."""
    found, sizes = [], []
    for some in pieces(column):
        grams, lengths = codes_of(some, alphabet)
        full = lengths > 0
        mean = np.zeros(len(some))
        if len(grams):
            starts = (np.cumsum(lengths) - lengths)[full]
            mean[full] = np.add.reduceat(known.of(grams), starts, dtype=np.float64) / lengths[full]
        found.append(pa.array(mean, mask=~full))
        sizes.append(pa.array(lengths.astype(np.int64)))
    return [pa.concat_arrays(found), pa.concat_arrays(sizes)] if found else [pa.array([], pa.float64()), pa.array([], pa.int64())]


def _held_out(doc_id: Column) -> Column:
    """Whether a document would be held out of training; known without its label."""
    return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(HELD_OUT)) == 0


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that are labelled good and not toxic, and whether they are held out."""
    worst = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    good = worst.where("quality = 1 AND toxic = 0")
    return good.select(F.col("doc_id").alias("_trusted"), _held_out(F.col("doc_id")).alias("_held"))


def likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents but for most of those whose id is not in ``_trusted``: only a bitmap of 8 MB goes to the tasks."""
    place = F.pmod(F.xxhash64(F.col("_id").cast("long"), F.lit(1)), F.lit(FILTER_BITS))
    bits = ids.select(F.col("_trusted").alias("_id")).select(place.alias("place")).select(
        F.expr("place div 32768").alias("_bucket"), (F.col("place") % 32768).alias("bit")
    ).groupBy("_bucket").agg(F.bitmap_construct_agg("bit").alias("_bits"))
    byte = F.expr("cast(conv(hex(substring(_bits, cast(_place % 32768 div 8 + 1 as int), 1)), 16, 10) as int)")
    placed = docs.withColumn("_id", F.col("doc_id")).withColumn("_place", place)
    found = placed.join(F.broadcast(bits), F.expr("_place div 32768") == F.col("_bucket"))
    return found.where(F.getbit(byte, (F.col("_place") % 8).cast("int")) == 1).select(*docs.columns)


def _distance(median: Column, surprise: str, length: str) -> Column:
    return (F.col(surprise) - median) * F.sqrt(F.least(F.col(length), F.lit(LONGEST)).cast("double"))


def limits(scored: DataFrame, trusted: DataFrame, reach: float = REACH) -> DataFrame:
    """Median and limits of the distance by alphabet and language (null for all languages together)."""
    measures = F.array(*(
        F.struct(
            F.lit(alphabet.prefix).alias("prefix"), F.col(f"{alphabet.prefix}surprise").alias("surprise"),
            F.col(alphabet.length).alias("length"),
        )
        for alphabet in ALPHABETS
    ))
    held = scored.join(trusted.where("_held"), F.col("doc_id") == F.col("_trusted")).where("surprise IS NOT NULL")
    held = held.select("lang", F.explode(measures).alias("measure")).select("lang", "measure.*")
    held = held.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn(
        "lang", F.when(F.col("own"), F.col("lang"))
    )
    middles = held.groupBy("prefix", "own", "lang").agg(
        F.percentile_approx("surprise", 0.5, 10_000).alias("median"), F.count("*").alias("n")
    )
    middles = middles.withColumnsRenamed({"prefix": "_prefix", "own": "_own", "lang": "_lang"})
    same = (F.col("prefix") == F.col("_prefix")) & (F.col("own") == F.col("_own"))
    far = held.join(middles, same & F.col("lang").eqNullSafe(F.col("_lang"))).select(
        "prefix", "own", "lang", "median", "n", _distance(F.col("median"), "surprise", "length").alias("distance")
    )
    return far.groupBy("prefix", "own", "lang", "median", "n").agg(
        F.percentile_approx("distance", [0.05, 0.5, 0.95], 10_000).alias("q")
    ).select(
        "prefix", "own", "lang", "median", "n",
        (F.col("q")[1] + reach * (F.col("q")[2] - F.col("q")[1])).alias("limit"),
        (F.col("q")[1] - LOW_REACH * (F.col("q")[1] - F.col("q")[0])).alias("low_limit"),
    )


def judge(scored: DataFrame, limit_table: DataFrame) -> DataFrame:
    """The scored documents with the perplexity of every alphabet and ``kept``."""
    lang, limits_of = _free_names(scored, "language", "limits")
    # One row for all languages and each alphabet; none where no trusted document was held out.
    common = {row.prefix: row for row in limit_table.where("NOT own").collect()}
    joined, inside, perplexities = scored, F.lit(True), {}
    for alphabet in ALPHABETS:
        rules = limit_table.where((F.col("prefix") == alphabet.prefix) & F.col("own") & (F.col("n") >= FEW))
        rules = rules.select(F.col("lang").alias(lang), F.struct("median", "limit", "low_limit").alias(limits_of))
        row = common.get(alphabet.prefix)
        everywhere = F.struct(*(
            F.lit(row[name] if row else None).cast("double").alias(name) for name in ("median", "limit", "low_limit")
        ))
        [verdict] = _free_names(joined, f"{alphabet.prefix}inside")
        joined = joined.join(rules, F.col("lang").eqNullSafe(F.col(lang)), "left")
        rule = F.coalesce(limits_of, everywhere)
        distance = _distance(rule["median"], f"{alphabet.prefix}surprise", alphabet.length)
        within = F.coalesce((distance <= rule["limit"]) & (distance >= rule["low_limit"]), F.lit(True))
        joined = joined.withColumn(verdict, within).drop(lang, limits_of)
        inside &= F.col(verdict)
        perplexities[f"{alphabet.prefix}perplexity"] = F.exp(f"{alphabet.prefix}surprise")
    verdicts = [name for name in joined.columns if name not in scored.columns]
    return joined.withColumns(perplexities | {"kept": F.col("surprise").isNotNull() & inside}).drop(*verdicts)


def _free_names(frame: DataFrame, *names: str) -> list[str]:
    """Names that the frame does not have, made of the given ones."""
    taken = {name.lower() for name in frame.columns}
    return [next(free for free in (name + "_" * n for n in range(len(taken) + 1)) if free not in taken) for name in names]


def classify(docs: DataFrame, labels: DataFrame, reach: float = REACH, keep_text: bool = True) -> DataFrame:
    """The documents with surprise, length and perplexity of every alphabet, and kept."""
    trusted = stored(trusted_ids(labels), "lm-trusted")
    # Labels grow with the corpus, so the texts go to them in the same way at every size.
    taught, held = trusted.where("NOT _held"), trusted.where("_held")
    training = likely(docs.select("doc_id", "text"), taught).join(taught.hint("merge"), F.col("doc_id") == F.col("_trusted"))
    model = train(training)
    if model is None:
        text = F.coalesce("text", F.lit(""))
        found = docs.withColumns({
            "surprise": F.lit(None).cast("double"), "n_symbols": F.length(text).cast("long"),
            "byte_surprise": F.lit(None).cast("double"), "n_bytes": F.octet_length(text).cast("long"),
            "perplexity": F.lit(None).cast("double"), "byte_perplexity": F.lit(None).cast("double"),
            "kept": F.length(text) > 0,
        })
        return found if keep_text else found.drop("text")
    surprises = stored(surprises_of(stored(ngrams(docs), "lm-ngrams"), model), "lm-surprises")
    # Limits come from held-out documents alone, and whether one is held out shows in its id.
    aside = score(likely(docs.select("doc_id", "lang", "text"), held), surprises, keep_text=False)
    known = stored(aside, "lm-held-out")
    return judge(score(docs, surprises, keep_text), stored(limits(known, trusted, reach), "lm-limits"))


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    return classify(docs, table(spark, folder, "labels"), keep_text=False)
