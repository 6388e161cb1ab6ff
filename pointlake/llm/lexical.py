"""Ranked lexical search by an Aho-Corasick scan of the documents.

The terms of all items form one automaton.  Every term is guarded by a boundary sign on both sides and every
other sign of a text is turned into that boundary, so a match is a whole term and one pass over the text counts
the frequencies of all item terms; there is no index of documents.  An automaton output is a term number,
and a table of (item, repeats) per term maps it to items.

1. *Blocks.*  Items are dealt by a hash of their id into blocks whose texts hold at most about ``BLOCK_BYTES``;
   a block's automaton is what is broadcast.  There are as many blocks as needed, each with its own scans.
2. *First scan.*  Every task counts documents, terms and documents per item term, and returns sums only.
3. *Second scan.*  Every task scores its documents and keeps the k best per item; the k best of all tasks
   follow in two steps, by (item, salt) and by item.

Scores are integers (see ``search``).  Defined results: a NULL text has no terms; equal rows of items count once,
and texts of one item id (NULL too) are read together; items without a term give no rows; every row of
documents is a document of its own; equal scores are ordered by id, a NULL id last; other columns play no
part; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointlake.llm.common import store, text_slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of item text behind one automaton.
BLOCK_BYTES = 8 << 20
#: Cells of the (document, item) score matrix and rows of (document, term, item) held at a time.
CELLS = 1 << 20
SALTS = 64
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


class Block:
    """Terms of some items: their spellings, and per term the items with their repeats."""

    def __init__(self, rows: list, item_type: pa.DataType):
        """``rows`` are (item_id, term, repeats)."""
        items = {i: k for k, i in enumerate(dict.fromkeys(r[0] for r in rows))}
        terms = {t: k for k, t in enumerate(dict.fromkeys(r[1] for r in rows))}
        self.items, self.terms = pa.array(list(items), item_type), list(terms)
        at = np.array([terms[r[1]] for r in rows], np.int64)
        order = np.argsort(at, kind="stable")
        self.item = np.array([items[r[0]] for r in rows], np.int64)[order]
        self.repeats = np.array([r[2] for r in rows], np.int64)[order]
        self.first = np.searchsorted(at[order], np.arange(len(terms) + 1))

    def automaton(self) -> ahocorasick.Automaton:
        """Boundary-guarded automaton whose outputs are term numbers."""
        found = ahocorasick.Automaton()
        for k, term in enumerate(self.terms):
            found.add_word(f" {term} ", k)
        found.make_automaton()
        return found


def counted(automaton: ahocorasick.Automaton, text: str | None) -> tuple[int, Counter]:
    """Number of terms of a text, and the frequency of every item term in it."""
    folded = b" " + (text or "").encode().translate(_FOLD) + b" "
    blank = np.frombuffer(folded, np.uint8) == 32
    n = int(np.count_nonzero(blank[:-1] & ~blank[1:]))
    return n, Counter(map(itemgetter(1), automaton.iter(folded.decode()))) if n else Counter()


def statistics(docs: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and documents per item term."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, size = shared.value.automaton(), len(shared.value.terms)
        held = np.zeros(size + 2, np.int64)
        for _, texts in text_slices(batches):
            for text in texts:
                n, found = counted(automaton, text)
                held[size:] += (n > 0, n)
                held[np.fromiter(found, np.int64, len(found))] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["term", "n"])

    sums = docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()  # one row per item term
    shared.unpersist()
    held = np.zeros(len(block.terms) + 2, np.int64)
    for r in sums:
        held[r["term"]] = r["n"]
    return int(held[-2]), int(held[-1]), held[:-2]


class Best:
    """The k best documents per item so far: highest score first, then smallest id, NULL ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.bar = k, np.ones(items, np.int64)
        self.held, self.new, self.size = np.zeros((4, 0), np.int64), [], 0

    def offer(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        """A matrix of scores: documents by items."""
        doc, item = np.nonzero(scores >= self.bar)
        self.new.append(np.stack([item, -scores[doc, item], missing[doc], ids[doc]]))
        self.size += len(doc)
        if self.size > max(2 * self.k * len(self.bar), 1 << 16):
            self.settle()

    def settle(self) -> np.ndarray:
        rows = np.concatenate([self.held, *self.new], 1)
        rows = rows[:, np.lexsort(rows[::-1])]
        start = np.searchsorted(rows[0], np.arange(len(self.bar)))
        place = np.arange(rows.shape[1]) - start[rows[0]]
        full = rows[:, place == self.k - 1]
        self.bar[full[0]] = -full[1]
        self.held, self.new, self.size = rows[:, place < self.k], [], 0
        return self.held


def scores(block: Block, weights: np.ndarray, found: list[tuple[int, Counter]], n_docs: int, n_terms: int) -> np.ndarray:
    """Scores of some documents (rows) for all items of the block (columns)."""
    term = np.concatenate([np.fromiter(c, np.int64, len(c)) for _, c in found])
    tf = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for _, c in found])
    doc = np.repeat(np.arange(len(found)), [len(c) for _, c in found])
    m = np.array([25 + 75 * n * n_docs // n_terms for n, _ in found], np.int64)
    part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
    size = block.first[term + 1] - block.first[term]
    each = np.repeat(np.arange(len(term)), size)
    at = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size) + block.first[term][each]
    out = np.zeros((len(found), len(block.items)), np.int64)
    np.add.at(out.reshape(-1), doc[each] * len(block.items) + block.item[at], part[each] * block.repeats[at])
    return out


def best_documents(docs: DataFrame, block: Block, weights: np.ndarray, n_docs: int, n_terms: int, k: int, item_type: T.DataType) -> DataFrame:
    """``(item_id, doc_id, score)``: the k best documents of every task."""
    shared = docs.sparkSession.sparkContext.broadcast((block, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights = shared.value
        automaton, best = block.automaton(), Best(len(block.items), k)
        spread = np.diff(block.first)
        for piece, texts in text_slices(batches, 1):
            column = piece.column(0)
            missing, ids = np.array(column.is_null()).astype(np.int64), np.array(column.fill_null(0))
            found, rows, cells = [], [], 0
            for r, text in enumerate(texts):
                n, hits = counted(automaton, text)
                if hits:
                    found.append((n, hits))
                    rows.append(r)
                    cells += max(len(block.items), int(spread[np.fromiter(hits, np.int64, len(hits))].sum()))
                if found and (cells >= CELLS or r == len(texts) - 1):
                    best.offer(scores(block, weights, found, n_docs, n_terms), ids[rows], missing[rows])
                    found, rows, cells = [], [], 0
        item, low, missing, ids = best.settle()
        yield pa.RecordBatch.from_arrays([block.items.take(pa.array(item)), pa.array(ids, mask=missing > 0), pa.array(-low)], names=["item_id", "doc_id", "score"])

    schema = T.StructType([T.StructField("item_id", item_type), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """``rank`` of the k best rows per item; a salt first keeps what all tasks return from meeting in one."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    some = hits.withColumn("salt", salt).withColumn("rank", F.row_number().over(W.partitionBy("item_id", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)


def item_blocks(spark: SparkSession, items: DataFrame, limit: int) -> Iterator[Block]:
    """Blocks of items; an item longer than ``limit`` may be alone in its block."""
    rows = items.distinct().withColumn("u", F.explode(terms_of(F.col("text")))).groupBy("item_id", F.col("u").alias("term")).agg(F.count(F.lit(1)).alias("repeats"))
    pairs = store(rows, "item-terms")
    weight = F.octet_length("term") + 16
    per_item = pairs.groupBy("item_id").agg(F.sum(weight).alias("bytes"))
    total = per_item.agg(F.sum("bytes")).first()[0] or 0
    n = max(1, -(-total // limit))

    def place(n: int) -> Column:
        return F.pmod(F.xxhash64("item_id"), F.lit(n))
    while n > 1 and per_item.groupBy(place(n).alias("b")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).filter((F.col("bytes") > 2 * limit) & (F.col("n") > 1)).limit(1).count():
        n *= 2
    kind = pa.schema(items.select("item_id").limit(0).toArrow().schema).field(0).type
    for b in sorted(r["b"] for r in per_item.select(place(n).alias("b")).distinct().collect()):
        held = pairs.filter(place(n) == b).orderBy("item_id", "term").collect()  # at most about 2 * limit bytes
        yield Block([tuple(r) for r in held], kind)


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k documents of highest score above 0 per item.

    A term's weight is ``floor(1000 ln((2N + 2) / (2 df + 1)))``; a document of n terms has length
    ``m = 25 + 75 n N div L`` and adds ``weight * (10^9 tf div (1000 tf + 8 m))`` for each of the item's terms, repeats
    included (N documents with a term, L their terms)."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    asked = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    kind = asked.schema["item_id"].dataType
    spark, parts = docs.sparkSession, []
    for block in item_blocks(spark, asked, block_bytes):
        n_docs, n_terms, df = statistics(rows, block)
        if n_docs:
            weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
            parts.append(ranked(best_documents(rows, block, weights, n_docs, n_terms, k, kind), k))
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    out = spark.createDataFrame([], schema)
    for part in parts:
        out = out.unionByName(part.select("item_id", "rank", "doc_id", "score"))
    return out
