"""BPE encoding and decoding with the vocabulary of a byte-level tokenizer file.

A text is cut at the strings of the file's added tokens, the rest into pieces (words with their
leading space, numbers, punctuation, white space).  Each piece becomes a doubly linked list of its
bytes' symbols.  A heap holds the possible merges by rank, then position; an entry whose symbols
have changed since it was pushed is stale and skipped.  Decoding concatenates the byte strings of
the ids.  Nothing is shuffled, a task keeps a bounded cache of pieces, and a long text is worked on
in parts cut where a piece must end, so memory depends only on the batch.

Defined results: a NULL text counts as empty and gives no ids; ids that are NULL give an empty text;
repeated rows and all other columns are kept as they are (a column that has the output's name is
replaced); an id outside the vocabulary raises; bytes that are not UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointlake.llm.common import map_column

#: Fixed value: how the byte-level tokenizers cut a text into pieces.  Words stand first, as most
#: pieces are words and no contraction begins like one.
PIECE = r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CACHE = 200_000
PART = 500_000


def printable_bytes() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable bytes stand for
    themselves, the others for 256 and up in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Merge ranks and byte strings of a tokenizer file's JSON text."""

    def __init__(self, source: str | bytes):
        spec = json.loads(source)
        model, byte = spec["model"], printable_bytes()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE tokenizer without normalizer is needed")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        ids = model["vocab"]
        self.strings = {i: bytes(byte[c] for c in token) for token, i in ids.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: token.encode() for token, i in self.added.items()}
        self.symbol = [0] * 256
        for char, b in byte.items():
            self.symbol[b] = ids[char]
        self.pairs, self.ids = model["merges"], ids

    @cached_property
    def merges(self) -> tuple[list[Callable[[int], int | None]], list[int]]:
        """By the left id, the lookup of a pair's rank by its right id; and the joined id by rank."""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in self.pairs]
        ids = self.ids
        del self.pairs, self.ids
        after: dict[int, dict[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            after.setdefault(ids[a], {})[ids[b]] = rank
        none: dict[int, int] = {}
        return [after.get(i, none).get for i in range(max(self.strings) + 1)], [ids[a + b] for a, b in pairs]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece.  Heap entries are ``rank << shift | position``, small integers for a short piece."""
        rank_of, joined = self.merges
        pop, push = heapq.heappop, heapq.heappush
        symbols = list(map(self.symbol.__getitem__, piece))
        n = len(symbols)
        shift = n.bit_length()
        low = (1 << shift) - 1
        heap = []
        for i in range(n - 1):
            rank = rank_of[symbols[i]](symbols[i + 1])
            if rank is not None:
                heap.append(rank << shift | i)
        if not heap:
            return symbols
        heapq.heapify(heap)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        while heap:
            entry = pop(heap)
            i, rank = entry & low, entry >> shift
            j, own = right[i], symbols[i]
            if own < 0 or j < 0 or rank_of[own](symbols[j]) != rank:
                continue  # stale
            own = symbols[i] = joined[rank]
            symbols[j] = -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                rank = rank_of[own](symbols[k])
                if rank is not None:
                    push(heap, rank << shift | i)
            h = left[i]
            if h >= 0:
                rank = rank_of[symbols[h]](own)
                if rank is not None:
                    push(heap, rank << shift | h)
        return [s for s in symbols if s >= 0]


class PieceCache(dict):
    """Ids of a piece as little-endian bytes; long pieces are not kept.  A full cache becomes the old half, from which
    pieces that come again move over, so common pieces outlive rare ones."""

    def __init__(self, vocabulary: Vocabulary, limit: int = CACHE):
        super().__init__()
        self.vocabulary, self.limit, self.old = vocabulary, limit // 2, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = np.array(self.vocabulary.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def parts(text: str, size: int = PART) -> Iterator[str]:
    """A long text cut before spaces that follow a non-space: no piece reaches over such a place."""
    lo = 0
    while len(text) - lo > size:
        cut = text.find(" ", lo + size)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[lo:cut]
        lo = cut
    yield text[lo:]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.cache = PieceCache(vocabulary)
        self.pieces = regex.compile(PIECE).findall
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in vocabulary.added.items()}
        names = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else lambda text: [text]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for k, run in enumerate(self.cut(text)):
            if k % 2:
                out.append(self.added[run])
            else:
                out += [b"".join(map(self.cache.__getitem__, self.pieces(p))) for p in parts(run)]
        return b"".join(out)


def _shared(df: DataFrame, vocabulary: str):
    """The tokenizer file, read once by the driver (its size is that of a vocabulary, not of data)."""
    return df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())


def _encoder(vocabulary: Vocabulary):
    coder = Encoder(vocabulary)
    return lambda texts: [coder.encode(t or "") for t in texts]


def _decoder(vocabulary: Vocabulary):
    word = vocabulary.strings.__getitem__
    return lambda rows: [b"".join(map(word, np.frombuffer(r or b"", "<u4").tolist())).decode("utf-8", "replace") for r in rows]


def encode(df: DataFrame, vocabulary: str, text: str = "text", out: str = "ids", keep: bool = True) -> DataFrame:
    """Add the ids of ``text`` as binary: little-endian unsigned 32-bit integers."""
    source = _shared(df, vocabulary)

    def start():
        coded = _encoder(Vocabulary(source.value))
        return lambda texts: [pa.array(coded(texts), pa.binary())]

    return map_column(df, text, [(out, T.BinaryType())], start, keep)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded", keep: bool = True) -> DataFrame:
    """Add the text of binary ``ids``."""
    source = _shared(df, vocabulary)

    def start():
        texts = _decoder(Vocabulary(source.value))
        return lambda rows: [pa.array(texts(rows), pa.string())]

    return map_column(df, ids, [(out, T.StringType())], start, keep)


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", out: str = "decoded", keep: bool = True) -> DataFrame:
    """Add the ids of ``text`` and the text they decode to, in one pass of one worker per task."""
    source = _shared(df, vocabulary)

    def start():
        own = Vocabulary(source.value)
        coded, texts = _encoder(own), _decoder(own)

        def both(rows):
            found = coded(rows)
            return [pa.array(found, pa.binary()), pa.array(texts(found), pa.string())]
        return both

    return map_column(df, text, [(ids, T.BinaryType()), (out, T.StringType())], start, keep)


def n_ids(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("bigint")
