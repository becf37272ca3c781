"""Token counts of a piece vocabulary by heap-and-linked-list merging; no identifiers are made.

Blanks are written as the vocabulary's own blank sign, one stands before every text that is not empty, and the text's
code points are the first symbols, linked to their neighbours.  A heap holds the adjacent pairs that form a piece by
rank and place; the best one, leftmost of equals, is popped and merged again and again.  An entry whose pair has
changed since it was pushed is passed over.  A text's count is its first symbols minus its merges, where
a code point outside the vocabulary, which never merges, is as many symbols as it has bytes.

A unit is what no merge can cross: no piece has a blank sign behind another sign, which is checked when a vocabulary is
read, so text is cut before blanks (and at line breaks, if no piece holds one).  Units are counted once and remembered in a bounded memo;
one of n code points costs n log n steps however long it is.

The operator is narrow: no shuffle, and memory for one Arrow batch and the memo.  The vocabulary file is read once by the
driver and broadcast; its size is that of the file, whatever the corpus.

Defined cases: a null or empty text has no tokens; strings such as ``<s>`` inside texts are ordinary text; rows may repeat and
ids are not used; other columns stay, and a column named like the output is replaced; an empty table gives an
empty table.  A vocabulary of another kind (its library counts probe texts otherwise) is an error.
"""

from __future__ import annotations

import heapq
import re

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from stationlake.llm.arrow import add_columns, texts
from stationlake.llm.registry import query, table

VOCABULARY = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
# Units remembered per Python worker in each of two generations; a full one replaces the older.
MEMO_ENTRIES = 300_000
MEMO_LENGTH = 64
BLANK = "▁"
PROBES = ("", " ", "a", "two  words\n\n next", "<s> <0x41> \x00", "Ünïcödé 日本語 ก\U0001f600", "aaaaaaaaaaaa bbbbbbbb")


def symbols_minus_merges(unit: str, ranks: dict[str, int]) -> int:
    """Tokens of one unit: its first symbols less the merges it allows."""
    n = len(unit)
    count = sum(1 if sign in ranks else len(sign.encode()) for sign in unit)
    get = ranks.get
    bits = n.bit_length()
    mask = (1 << bits) - 1
    # A live symbol at ``i`` reaches to ``after[i]`` and follows the one at ``before[i]``; ``pair[i]`` is the rank of its pair.
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    pair: list[int | None] = [get(unit[at : at + 2]) for at in range(n - 1)] + [None]
    heap = [rank << bits | at for at, rank in enumerate(pair) if rank is not None]
    heapq.heapify(heap)
    push, pop = heapq.heappush, heapq.heappop
    while heap:
        top = pop(heap)
        at = top & mask
        if pair[at] != top >> bits:
            continue
        count -= 1
        gone = after[at]
        pair[gone] = None
        after[at] = end = after[gone]
        rank = None
        if end < n:
            before[end] = at
            rank = get(unit[at : after[end]])
            if rank is not None:
                push(heap, rank << bits | at)
        pair[at] = rank
        left = before[at]
        if left >= 0:
            rank = get(unit[left:end])
            pair[left] = rank
            if rank is not None:
                push(heap, rank << bits | left)
    return count


class Memo(dict):
    """Counts of units, computed when missing, in two generations of bounded size."""

    def __init__(self, ranks: dict[str, int]):
        super().__init__()
        self.ranks = ranks
        self.older: dict[str, int] = {}

    def __missing__(self, unit: str) -> int:
        found = self.older.get(unit)
        if found is None:
            found = symbols_minus_merges(unit, self.ranks)
        if len(unit) <= MEMO_LENGTH:
            if len(self) >= MEMO_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[unit] = found
        return found


class Counter:
    """Pieces of a vocabulary by rank and a memo of units; one per Python worker and vocabulary."""

    kept: dict[int, Counter] = {}

    def __init__(self, content: bytes):
        library = sentencepiece.SentencePieceProcessor(model_proto=content)
        scores = {
            library.id_to_piece(at): library.get_score(at)
            for at in range(library.get_piece_size())
            if not (library.is_control(at) or library.is_unknown(at) or library.is_byte(at))
        }
        # Equal scores are one rank, so that the leftmost of their pairs goes first.
        order = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {piece: order[score] for piece, score in scores.items()}
        if any(BLANK in piece.lstrip(BLANK) for piece in self.ranks):
            self.unit = re.compile("(?s:.+)")
        elif any("\n" in piece for piece in self.ranks):
            self.unit = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        else:
            self.unit = re.compile(f"{BLANK}*[^{BLANK}\\n]+|{BLANK}+|\\n")
        self.memo = Memo(self.ranks)
        for probe in PROBES:
            if self.count(probe) != len(library.encode(probe)):
                raise ValueError("The vocabulary is not one of merged pieces with bytes for what is unknown")

    @classmethod
    def of(cls, content: bytes) -> Counter:
        key = hash(content)
        if key not in cls.kept:
            cls.kept[key] = cls(content)
        return cls.kept[key]

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.memo.__getitem__, self.unit.findall(BLANK + text.replace(" ", BLANK))))


def _vocabulary(spark: SparkSession, path: str | None):
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        content = file.read()
    Counter.of(content)
    return spark.sparkContext.broadcast(content)


def count_tokens(
    frame: DataFrame, text: str = "text", output: str = "n_tokens", path: str | None = None, keep_text: bool = True
) -> DataFrame:
    """The frame with the number of tokens of a text column; without ``keep_text`` the text does not come back."""
    content = _vocabulary(frame.sparkSession, path)

    def compute(column: pa.Array) -> list[pa.Array]:
        counter = Counter.of(content.value)
        return [pa.array(map(counter.count, texts(column)), pa.int64(), size=len(column))]

    return add_columns(frame, [text], [StructField(output, LongType())], compute, keep_inputs=keep_text)


def document_lengths(docs: DataFrame, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether a document exceeds a limit of tokens, one row per document."""
    sized = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    counted = count_tokens(sized, keep_text=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


@query("op11_token_counts")
def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return document_lengths(table(spark, folder, "documents"))
