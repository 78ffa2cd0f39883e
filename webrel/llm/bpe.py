"""Byte-level BPE encoding and decoding (operator 1).

Method: contiguous rank array.  A word is held as one list of part ids (the
boundaries) and one list with the merge rank of every adjacent pair.  The
smallest rank (leftmost on ties) is searched by scanning the array, its
boundary is deleted and the two neighbouring ranks are refreshed.  Words
longer than ``SHORT`` parts keep the same rule with the ranks in a heap, so
one endless word costs ``n log n`` instead of ``n * n``.

The vocabulary file is read once on the driver and broadcast; its size is fixed
by the tokenizer (50,257 entries), never by the data.  Encoding and decoding are
Arrow column functions: no shuffle, rows stay where they are, a lost executor
only repeats its own batches.  Texts are worked off in blocks of pieces, so
memory beyond the text and its ids does not depend on the text's length.

Defined results: null text is empty; empty text gives an empty id list and
decodes to the empty text; repeated rows give repeated results.  Special-token
strings inside a text become their special id, as the file's tokenizer does.  An empty
table gives no rows.  The operators are columns, so names of other columns do not matter.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SHORT = 128       # parts in a word that the rank array handles
BLOCK = 100_000   # pieces of a text worked off at a time
ROWS = 1_000      # texts whose ids and decoded texts are held at once
CACHE = 200_000   # words remembered by one Python worker
NO_RANK = 1 << 60

# --- fixed values -----------------------------------------------------------
# Word pattern of the byte-level pre-tokenizer.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# ---------------------------------------------------------------------------


class Vocabulary(NamedTuple):
    """What encoding and decoding need of a tokenizer file."""
    merges: dict[tuple[int, int], tuple[int, int]]  # pair of ids -> (rank, merged id)
    first: list[int]                                # byte -> id
    spelled: list[bytes]                            # id -> bytes
    special: dict[str, int]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: the
    printable Latin-1 characters for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocab, letters = file["model"]["vocab"], byte_letters()
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    spelled = [b""] * (max(max(vocab.values()), *special.values()) + 1)
    for token, i in vocab.items():
        spelled[i] = bytes(letters[ch] for ch in token) if all(ch in letters for ch in token) else token.encode()
    for token, i in special.items():
        spelled[i] = token.encode()
    first = [0] * 256
    for ch, b in letters.items():
        first[b] = vocab[ch]
    merges = {}
    for rank, (a, b) in enumerate(file["model"]["merges"]):
        merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
    return Vocabulary(merges, first, spelled, special)


def merge_word(parts: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Ids of one word from its byte ids."""
    if len(parts) > SHORT:
        return _merge_long(parts, merges)
    none = (NO_RANK, 0)
    ranks = [merges.get(pair, none)[0] for pair in zip(parts, parts[1:], strict=False)]
    while ranks:
        low = min(ranks)
        if low == NO_RANK:
            break
        at = ranks.index(low)
        parts[at] = merges[parts[at], parts[at + 1]][1]
        del parts[at + 1], ranks[at]          # the boundary between the two goes
        if at < len(ranks):
            ranks[at] = merges.get((parts[at], parts[at + 1]), none)[0]
        if at:
            ranks[at - 1] = merges.get((parts[at - 1], parts[at]), none)[0]
    return parts


def _merge_long(parts: list[int], merges: dict) -> list[int]:
    """The same order of merges with a heap of (rank, place) and linked places."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(merges[p][0], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in merges]
    heapify(heap)
    gone = -1
    while heap:
        rank, i = heappop(heap)
        j = after[i] if parts[i] != gone else n
        if j >= n or (found := merges.get((parts[i], parts[j]))) is None or found[0] != rank:
            continue  # an entry from before a neighbour changed
        parts[i], parts[j] = found[1], gone
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (found := merges.get((parts[i], parts[k]))) is not None:
                heappush(heap, (found[0], i))
        if (h := before[i]) >= 0 and (found := merges.get((parts[h], parts[i]))) is not None:
            heappush(heap, (found[0], h))
    return [p for p in parts if p != gone]


class Coder:
    """Encoder and decoder of one Python worker; remembers frequent words."""

    def __init__(self, vocabulary: Vocabulary):
        self.merges, self.first, self.spelled, self.special = vocabulary
        self.pieces = regex.compile(PIECES)
        self.splitter = regex.compile("(" + "|".join(
            regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.seen: dict[str, tuple[int, ...]] = {}

    def word(self, piece: str) -> tuple[int, ...]:
        ids = tuple(merge_word([self.first[b] for b in piece.encode("utf-8", "replace")], self.merges))
        if len(piece) <= 64:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            self.seen[piece] = ids
        return ids

    def blocks(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, a block of pieces at a time."""
        seen, word = self.seen, self.word
        parts = self.splitter.split(text) if self.splitter and any(s in text for s in self.special) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield [self.special[part]]
                continue
            found = iter(self.pieces.findall(part)) if len(part) < 1_000_000 else (m[0] for m in self.pieces.finditer(part))
            while block := list(islice(found, BLOCK)):
                yield list(chain.from_iterable([seen.get(p) or word(p) for p in block]))

    def decode(self, ids) -> str:
        return b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")


def round_trip(spark: SparkSession, text: Column | str, path: str) -> Column:
    """``struct<ids array<int>, decoded string>``: ``encode`` of a text column and ``decode`` of its ids in one Python
    worker a task; as two functions they would keep two, each with a vocabulary, and send the ids out and back."""
    shared = spark.sparkContext.broadcast(tuple(read_vocabulary(path)))

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = Coder(Vocabulary(*shared.value))
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                ids, ends, out = array("i"), array("i", [0]), []
                for text in batch.slice(at, ROWS):
                    for block in coder.blocks(text.as_py() or ""):
                        ids.extend(block)
                    out.append(coder.decode(ids[ends[-1]:]))
                    ends.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(
                    pa.int32(), len(ids), [None, pa.py_buffer(ids)]))
                yield pa.StructArray.from_arrays([lists, pa.array(out, pa.string())], ["ids", "decoded"])

    return both(text)


def _columns(spark: SparkSession, path: str):
    shared = spark.sparkContext.broadcast(tuple(read_vocabulary(path)))

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = Coder(Vocabulary(*shared.value))
        for batch in batches:
            ids, ends = array("i"), array("i", [0])
            for text in batch:
                for block in coder.blocks(text.as_py() or ""):
                    ids.extend(block)
                ends.append(len(ids))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(
                pa.int32(), len(ids), [None, pa.py_buffer(ids)]))

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = Coder(Vocabulary(*shared.value))
        for batch in batches:
            out = [coder.decode(row.values.to_numpy(zero_copy_only=False).tolist()) if row.is_valid else "" for row in batch]
            yield pa.array(out, pa.string())

    return encode, decode


def encode(spark: SparkSession, text: Column | str, path: str) -> Column:
    """``array<int>`` of token ids of a text column; ``path``: tokenizer file."""
    return _columns(spark, path)[0](text)


def decode(spark: SparkSession, ids: Column | str, path: str) -> Column:
    """The text of an id column; bytes that are not UTF-8 become U+FFFD, null is empty."""
    return _columns(spark, path)[1](ids)
