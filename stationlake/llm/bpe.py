"""Byte-level BPE: encode texts with the ranks of a public vocabulary, and decode the ids again.

A text is split by the vocabulary's pattern and every match is merged on its own.  A
segment tree over the byte positions of a match holds, for each live position, the rank
of the pair it starts, and gives the leftmost smallest one at its root; a merge is a few
point updates, so a match of n bytes costs n log n steps however long it is.

Both operators are narrow: no shuffle, and memory for one Arrow batch and a bounded memo
of matches.  The vocabulary file is read once by the driver and broadcast; its size is
that of the file, whatever the corpus.

Defined cases: a null or empty text has no ids; a null id list decodes to null; rows may
repeat and ids of documents are not used; other columns stay, and a column named like an
output is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from functools import cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField

from stationlake.llm.arrow import add_columns, texts
from stationlake.llm.registry import query, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Matches remembered per Python worker in each of two generations; a full one replaces the older.
MEMO_ENTRIES = 300_000
NOTHING = 1 << 62

# The public pattern with its classes spelled out for texts of code points below 256, which the
# standard library splits about twice as fast.
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r\\x20\\x85\\xa0"
LATIN_PATTERN = (
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+"
    f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks by token bytes from the lines "base64 rank" of a vocabulary file."""
    pairs = (line.split() for line in content.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merge_match(match: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one match: always the leftmost pair with the smallest rank merges next."""
    whole = ranks.get(match)
    if whole is not None:
        return [whole]
    n = len(match)
    bits = n.bit_length()
    mask = (1 << bits) - 1
    leaves = 1
    while leaves < n - 1:
        leaves *= 2
    tree = [NOTHING] * (2 * leaves)
    get = ranks.get
    for at in range(n - 1):
        rank = get(match[at : at + 2])
        if rank is not None:
            tree[leaves + at] = rank << bits | at
    below = tree[leaves:]
    while len(below) > 1:
        below = list(map(min, below[::2], below[1::2]))
        tree[len(below) : 2 * len(below)] = below
    # ``after[i]`` is where the live piece starting at i ends; ``before[i]`` starts the piece left of it.
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    while (root := tree[1]) < NOTHING:
        at = root & mask
        gone = after[at]
        after[at] = end = after[gone]
        left, changes = before[at], []
        if gone < n - 1:
            changes.append((gone, NOTHING))
        rank = None
        if end < n:
            before[end] = at
            rank = get(match[at : after[end]])
        changes.append((at, NOTHING if rank is None else rank << bits | at))
        if left >= 0:
            rank = get(match[left:end])
            changes.append((left, NOTHING if rank is None else rank << bits | left))
        for place, value in changes:
            node = leaves + place
            # Up to the node whose minimum stays as it is.
            while tree[node] != value:
                tree[node] = value
                other = tree[node ^ 1]
                if other < value:
                    value = other
                node >>= 1
                if not node:
                    break
    ids, at = [], 0
    while at < n:
        ids.append(ranks[match[at : after[at]]])
        at = after[at]
    return ids


class Memo(dict):
    """Ids of matches, packed as 32-bit numbers; an unknown match is merged when it is looked up.

    Short matches are remembered in two generations: a full one replaces the older.
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.older: dict[str, bytes] = {}

    def __missing__(self, match: str) -> bytes:
        found = self.older.get(match)
        if found is None:
            found = np.array(merge_match(match.encode(), self.ranks), np.int32).tobytes()
        if len(match) <= 64:
            if len(self) >= MEMO_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[match] = found
        return found


class Codec:
    """Ranks, split pattern and a memo of matches; one per Python worker and vocabulary."""

    kept: dict[tuple[int, str], Codec] = {}

    def __init__(self, content: bytes, pattern: str):
        self.ranks = parse_ranks(content)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.latin = re.compile(LATIN_PATTERN) if pattern == public_tokenizers.PATTERN else None
        self.memo = Memo(self.ranks)

    @classmethod
    def of(cls, content: bytes, pattern: str) -> Codec:
        key = (hash(content), pattern)
        if key not in cls.kept:
            cls.kept[key] = cls(content, pattern)
        return cls.kept[key]

    def split(self, text: str) -> list[str]:
        if self.latin is not None:
            try:
                text.encode("latin-1")
                return self.latin.findall(text)
            except UnicodeEncodeError:
                pass
        return self.pattern.findall(text)

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers."""
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    @cached_property
    def token_bytes(self) -> pa.Array:
        """The bytes of every id, by id; null where there is none."""
        return pa.array([self.tokens.get(rank) for rank in range(max(self.tokens, default=-1) + 1)], pa.binary())

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _vocabulary(spark: SparkSession, path: str | None):
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(
    frame: DataFrame, text: str = "text", ids: str = "token_ids", path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """The frame with the token ids of a text column; special tokens are never produced."""
    content = _vocabulary(frame.sparkSession, path)

    def compute(column: pa.Array) -> list[pa.Array]:
        codec = Codec.of(content.value, pattern)
        parts = [codec.packed(value) for value in texts(column)]
        ends = np.cumsum([0, *map(len, parts)]) // 4
        values = pa.array(np.frombuffer(b"".join(parts), np.int32))
        return [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)]

    return add_columns(frame, [text], [StructField(ids, ArrayType(IntegerType()))], compute)


def decode(
    frame: DataFrame, ids: str = "token_ids", output: str = "decoded", path: str | None = None
) -> DataFrame:
    """The frame with the bytes that its token ids stand for; an unknown id is an error."""
    content = _vocabulary(frame.sparkSession, path)

    def compute(column: pa.Array) -> list[pa.Array]:
        codec = Codec.of(content.value, public_tokenizers.PATTERN)
        ends = column.offsets.to_numpy()
        # The tokens of a document lie behind each other, so its bytes begin where its first token does.
        taken = codec.token_bytes.take(column.values.slice(ends[0], ends[-1] - ends[0]))
        if taken.null_count:
            raise KeyError("an id that the vocabulary does not have")
        _, starts, data = taken.buffers()
        at = np.frombuffer(starts, np.int32)[taken.offset :][ends - ends[0]] if len(taken) else np.zeros(len(ends), np.int32)
        whole = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(at.astype(np.int32).tobytes()), data])
        return [pc.if_else(column.is_valid(), whole, None)]

    return add_columns(frame, [ids], [StructField(output, BinaryType())], compute)


def round_trip_digests(docs: DataFrame) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to, one row per document."""
    coded = decode(encode(docs.select("doc_id", "text")).drop("text"))
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip_digests(table(spark, folder, "documents"))
