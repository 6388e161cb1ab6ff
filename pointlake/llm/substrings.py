"""Substring deduplication by prefix-partitioned suffix trees.

A window of ``window`` consecutive words is removed from a document when the same word sequence also
starts in a document with a smaller id.

1. *Copies.*  Texts that are equal as a whole are represented by their smallest id; the other rows lose
   every word (if they have a window at all) without taking part in what follows.
2. *Prefixes.*  Suffixes are grouped by a prefix of eight words.  Only sampled suffixes are prefixes:
   of the eight-word sequences inside a window the one with the least hash (the first on a tie) is the
   window's anchor, so equal windows have equal anchors and a run of windows with one anchor is
   shipped as one piece of text.  Prefixes that occur in one text only are dropped, which loses nothing.
3. *Subtrees.*  Prefixes are dealt to groups that fit into memory.  A group's suffix tree is built as a
   suffix array with the longest common prefixes of its neighbours; the nodes at depth ``window`` or
   more are its maximal repeats, and the smallest id below a node decides about its leaves.
4. *Crowded prefixes.*  A prefix found in more than ``crowd`` texts is lengthened until its group is one
   node: to the whole window, told apart by the SHA-256 of its words.  The smallest id per node is then an
   aggregate that combines before the shuffle, so a passage shared by any number of documents never meets in
   one task.  Both ways decide by the words themselves, so ``crowd`` changes the work and not the result.

The text is shuffled up to three times: to find the spans of uncrowded and of crowded prefixes, for the texts
that have such prefixes, and to remove what was found.  Defined results: a NULL text counts as empty; a NULL id counts
as larger than any id; rows with equal id and text get equal results, and rows with equal ids never
remove each other's words; texts shorter than a window stay as they are; other columns are kept and
outputs replace columns of the same name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointlake.llm import suffixes
from pointlake.llm.common import store, text_slices

WINDOW = 50
PREFIX = 8
CROWD = 2000
GROUP = 20_000
_LAST = (1 << 63) - 1
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of ``values[start:end]`` for every range, from one running sum (modulo 2**64)."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(base, n)[:n], out=total[1:])
    return _mix((total[ends] - total[starts]) * _powers(pow(base, -1, 1 << 64), n)[starts])


class Words:
    """Words of several texts: document, range and hash of each."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode() for t in texts]
        data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        inside = ~_SPACE[data]
        step = np.diff(inside.astype(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        offsets = np.cumsum([len(r) + 1 for r in raw])
        self.doc = np.searchsorted(offsets, starts, "right")
        self.counts = np.bincount(self.doc, minlength=len(raw))
        self.ends = np.cumsum(self.counts)
        table = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD[0]))
        self.hash = _range_hash(table[data], starts, ends, _ODD[0] | 1)

    def grams(self) -> np.ndarray:
        out = np.zeros(max(0, len(self.hash) - PREFIX + 1), np.uint64)
        for j in range(PREFIX):
            out = out * np.uint64(_ODD[1]) + self.hash[j:j + len(out)]
        return _mix(out)


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Position of the first least value among each ``span`` consecutive ones."""
    at, size = np.arange(len(values)), 1
    while size < span:
        shift = min(size, span - size)
        a, b = at[:-shift], at[shift:]
        at, size = np.where(values[b] < values[a], b, a), size + shift
    return at


class Anchors:
    """Anchors of the windows of several texts: key, document, first window and number of windows."""

    def __init__(self, words: Words, window: int):
        n = len(words.hash) - window + 1
        none = np.zeros(0, np.int64)
        self.key = self.doc = self.first = self.size = none
        if n <= 0:
            return
        grams = words.grams()
        at = _least(grams, window - PREFIX + 1)
        whole = np.flatnonzero(np.arange(n) + window <= words.ends[words.doc[:n]])
        if not len(whole):
            return
        at = at[whole]
        new = np.ones(len(whole), bool)
        new[1:] = (at[1:] != at[:-1]) | (words.doc[whole[1:]] != words.doc[whole[:-1]])
        head = np.flatnonzero(new)
        self.first, self.size = whole[head], np.diff(np.r_[head, len(whole)])
        self.key, self.doc = grams[at[head]].view(np.int64), words.doc[self.first]


def document_keys(docs: DataFrame, window: int) -> DataFrame:
    """``(ord_id, k64, whole, keys)`` per row: the text's identity and its distinct prefixes."""
    kept = docs.select("ord_id", "k64", F.sha2("text", 256).alias("whole"), "text")
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_slices(batches):
            anchors = Anchors(Words(texts), window)
            cuts = np.searchsorted(anchors.doc, np.arange(len(texts) + 1))
            keys = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(anchors.key, pa.int64()))
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], keys], names=schema.names)

    return kept.mapInArrow(run, schema).withColumn("keys", F.array_distinct("keys"))


def _chosen(anchors: Anchors, n: int, keys: list) -> np.ndarray:
    """Places of the anchors whose key is wanted in its document."""
    cuts = np.searchsorted(anchors.doc, np.arange(n + 1))
    parts = [lo + np.flatnonzero(np.isin(anchors.key[lo:hi], np.array(k, np.int64))) for lo, hi, k in zip(cuts[:-1], cuts[1:], keys, strict=True)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def pieces(candidates: DataFrame, window: int, groups: int) -> DataFrame:
    """Runs of windows with a shared, uncrowded prefix: text and the places where it starts.  Equal runs
    of one document are one row."""
    kept = candidates.select("ord_id", "k64", "keys", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_slices(batches):
            words = Words(texts)
            anchors = Anchors(words, window)
            split = [t.encode().split() for t in texts]
            base = words.ends - words.counts
            found: dict[tuple, list[int]] = {}
            for a in _chosen(anchors, len(texts), piece.column(2).to_pylist()).tolist():
                d = int(anchors.doc[a])
                lo = int(anchors.first[a] - base[d])
                text = b" ".join(split[d][lo:lo + int(anchors.size[a]) + window - 1])
                found.setdefault((int(anchors.key[a]) % groups, d, text), []).append(lo)
            rows = list(found)
            at = pa.array([r[1] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), piece.column(0).take(at), piece.column(1).take(at),
                                              pa.array(list(found.values()), pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.binary())],
                                             names=["part", "ord_id", "k64", "starts", "piece"])

    return kept.mapInArrow(run, "part bigint, ord_id bigint, k64 bigint, starts array<int>, piece binary")


def _runs(flags: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of set flags inside equal blocks."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (block[at[1:]] != block[at[:-1]])
    head = np.flatnonzero(new)
    return at[head], at[np.r_[head[1:], len(at)] - 1]


def subtree(rows: pa.Table, window: int) -> pa.Table:
    """Spans ``[first, last)`` of words to remove, from one memory-sized group of suffixes."""
    ids, starts = rows.column("ord_id").to_numpy(), rows.column("starts").to_pylist()
    split = [p.split(b" ") for p in rows.column("piece").to_pylist()]
    counts = np.array([len(s) for s in split])
    codes = pd.factorize(np.array([w for s in split for w in s], object))[0].astype(np.int64)
    ends, owner = np.repeat(np.cumsum(counts), counts), np.repeat(np.arange(len(split)), counts)
    order, levels = suffixes.suffix_array(codes, ends, window)
    at, _ = suffixes.neighbour_lcp(order, ends, levels, window)
    joined = np.zeros(len(codes), bool)
    joined[at + 1] = True  # same node as the suffix before
    head = np.flatnonzero(~joined)
    least = np.minimum.reduceat(ids[owner[order]], head)[np.cumsum(~joined) - 1]
    later = np.zeros(len(codes), bool)
    later[order] = least < ids[owner[order]]
    first, last = _runs(later, owner)
    own = owner[first]
    base = (np.cumsum(counts) - counts)[own]
    repeats = np.array([len(starts[o]) for o in own], np.int64)
    shift = np.array([s for o in own for s in starts[o]], np.int64)
    k64 = rows.column("k64").to_numpy()
    return pa.table({"ord_id": np.repeat(ids[own], repeats), "k64": np.repeat(k64[own], repeats),
                     "first": np.repeat(first - base, repeats) + shift, "last": np.repeat(last - base, repeats) + shift + window})


def crowded_windows(candidates: DataFrame, window: int) -> DataFrame:
    """One row per window with a crowded prefix: SHA-256 of its words joined by a space, text and place."""
    kept = candidates.select("ord_id", "k64", "keys", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_slices(batches):
            words = Words(texts)
            anchors = Anchors(words, window)
            at = _chosen(anchors, len(texts), piece.column(2).to_pylist())
            size = anchors.size[at]
            place = np.repeat(anchors.first[at] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum())) if len(at) else at
            doc = words.doc[place]
            first = place - (words.ends - words.counts)[doc]
            split = {d: texts[d].encode().split() for d in np.unique(doc).tolist()}
            digests = [hashlib.sha256(b" ".join(split[d][lo:lo + window])).digest() for d, lo in zip(doc.tolist(), first.tolist(), strict=True)]
            rows = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column(0).take(rows), piece.column(1).take(rows), pa.array(first, pa.int64()), pa.array(digests, pa.binary())],
                                             names=["ord_id", "k64", "first", "digest"])

    return kept.mapInArrow(run, "ord_id bigint, k64 bigint, first bigint, digest binary")


def repeated_spans(docs: DataFrame, keyed: DataFrame, window: int = WINDOW, crowd: int = CROWD, group: int = GROUP) -> DataFrame:
    """``(ord_id, k64, first, last)``: spans of words that representatives must lose."""
    least = keyed.groupBy("whole").agg(F.min(F.struct("ord_id", "k64")).alias("least"))
    texts = keyed.join(least, (keyed["whole"] == least["whole"]) & (keyed["ord_id"] == F.col("least.ord_id"))).select("ord_id", "k64", "keys").dropDuplicates(["ord_id", "k64"])
    prefixes = texts.select("ord_id", "k64", F.explode("keys").alias("key"))
    seen = Observation()
    shared = store(prefixes.groupBy("key").count().filter(F.col("count") > 1).withColumn("crowded", F.col("count") > crowd).observe(
        seen, F.sum(F.when(~F.col("crowded"), F.col("count"))).alias("small"), F.count(F.when(F.col("crowded"), 1)).alias("crowded")), "shared-prefixes")
    groups = max(1, math.ceil((seen.get["small"] or 0) / group))
    wanted = store(prefixes.join(shared, "key").groupBy("ord_id", "k64").agg(
        F.collect_list(F.when(~F.col("crowded"), F.col("key"))).alias("small"), F.collect_list(F.when(F.col("crowded"), F.col("key"))).alias("large")), "wanted-prefixes")
    joined = docs.join(wanted, ["ord_id", "k64"])
    names = ["ord_id", "k64", "first", "last"]

    def tree(rows: pa.Table) -> pa.Table:
        return subtree(rows, window)

    small = pieces(joined.filter(F.size("small") > 0).withColumn("keys", F.col("small")).dropDuplicates(["ord_id", "k64"]), window, groups)
    spans = small.groupBy("part").applyInArrow(tree, "ord_id bigint, k64 bigint, first bigint, last bigint")
    if seen.get["crowded"]:
        single = store(crowded_windows(joined.filter(F.size("large") > 0).withColumn("keys", F.col("large")).dropDuplicates(["ord_id", "k64"]), window), "crowded-windows")
        node = single.groupBy("digest").agg(F.min("ord_id").alias("least"))
        later = single.join(node, "digest").filter("least < ord_id")
        spans = spans.unionByName(later.select("ord_id", "k64", "first", (F.col("first") + window).alias("last")).select(*names))
    return spans


def remove_spans(rows: DataFrame, window: int) -> DataFrame:
    """Replace ``text``, ``spans`` and ``copy`` by word counts and the kept words."""
    kept = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in ("text", "spans", "copy")], "copy", "spans", "text")
    schema = T.StructType([*kept.schema.fields[:-3], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_slices(batches):
            out = []
            for text, copy, spans in zip(texts, piece.column("copy").to_pylist(), piece.column("spans").to_pylist(), strict=True):
                words = (text or "").encode().split()
                n = len(words)
                if copy and n >= window:
                    words = []
                elif spans:
                    first, last = np.array([(s["first"], s["last"]) for s in spans], np.int64).T
                    gone = suffixes.covered(n, first, last - first)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((n, n - len(words), b" ".join(words).decode()))
            cols = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*piece.columns[:-3], *cols], names=schema.names)

    return kept.mapInArrow(run, schema)


def deduplicate(df: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = WINDOW, crowd: int = CROWD, group: int = GROUP) -> DataFrame:
    """Every row with ``n_words``, ``n_removed`` and ``kept_text`` (its kept words, joined by a space)
    instead of ``text``."""
    if window < PREFIX:
        raise ValueError(f"a window has {PREFIX} words at least")
    outputs = ("n_words", "n_removed", "kept_text")
    rest = [c for c in df.columns if c not in (*outputs, text)]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(_LAST)).alias("ord_id"),
                     F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("k64", F.xxhash64("text"))
    keyed = store(document_keys(rows, window), "document-keys")
    spans = repeated_spans(rows, keyed, window, crowd, group)
    least = keyed.groupBy("whole").agg(F.min("ord_id").alias("least"))
    copies = keyed.join(least, "whole").filter("ord_id > least").select("ord_id", "k64", F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("last"))
    fate = spans.unionByName(copies).groupBy("ord_id", "k64").agg(
        F.collect_set(F.when(F.col("first").isNotNull(), F.struct("first", "last"))).alias("spans"), F.max(F.col("first").isNull()).alias("copy"))
    out = remove_spans(rows.join(fate, ["ord_id", "k64"], "left").drop("ord_id", "k64"), window)
    return out.select("rest.*", *outputs)
