"""SimHash near-duplicates by anchor-point covering.

*Fingerprints.*  A bit of a text's 64-bit fingerprint is the majority of that bit over the XXH64 hashes
of its three-word shingles.

*Covering.*  Two fingerprints that differ in at most 3 bits differ in at most one bit of the low or
of the high half.  The lower 31 bits of a half carry the perfect Hamming code, whose code words are the
anchors: every value lies within the covering radius 1 of exactly one anchor.  A fingerprint is at home
at that anchor and visits all anchors within radius + threshold = 2 (16 of 2^26 at most), so each
close pair meets where one of the two is at home.  An anchor then compares its home members with its
visitors.

*Hot groups.*  Only distinct fingerprints are compared, so copies of a text cost one row.  An anchor
reports a spanning forest of its links, not the links.  An anchor with more than ``crowd`` rows is covered
again by anchors of the other half (visits within 1 + 3 bits), after which a group holds a number
of fingerprints that does not depend on the data's size.  Links are joined to components by the star
contraction of ``operators.components``, which writes each round to the shared folder.

Defined results: NULL and empty texts (and texts without words) have fingerprint zero and are linked
like any other; repeated rows share a fingerprint and so a component; a component's id is its
smallest non-NULL id, NULL if it has none; an empty table gives an empty result; other columns are kept,
outputs replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointlake.llm.common import map_column, store
from pointlake.operators.components import star_components

THRESHOLD = 3
SHINGLE = 3
SEED = 42
CROWD = 50_000
PER_TASK = 100_000
_CODE_BITS = 31
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of a text; shingles are slices of the words joined by one space."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = memoryview(b" ".join(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    spans = zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64)


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """Majority of each bit over the shingles, as signed 64-bit integers."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        hashes = shingle_hashes(text or "")
        if len(hashes):
            ones = np.zeros(64, np.int64)
            for lo in range(0, len(hashes), 65536):
                bits = np.unpackbits(hashes[lo:lo + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                ones += bits.sum(0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > len(hashes)).view(">u8")[0]
    return out.view(np.int64)


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp", keep: bool = True) -> DataFrame:
    """Add the fingerprint as a long; ``keep=False`` leaves the text out."""
    return map_column(df, text, [(out, T.LongType())], lambda: lambda texts: [pa.array(fingerprints(texts), pa.int64())], keep)


def flips(radius: int) -> list[list[int]]:
    """By syndrome: the bit patterns of at most ``radius`` ones that lead to a code word.  Position p of
    the code (1 to 31) has syndrome p, and the syndrome of a pattern is the XOR of its positions."""
    found: list[list[int]] = [[] for _ in range(_CODE_BITS + 1)]

    def grow(first: int, syndrome: int, pattern: int, left: int) -> None:
        found[syndrome].append(pattern)
        for p in range(first, _CODE_BITS + 1) if left else ():
            grow(p + 1, syndrome ^ p, pattern | 1 << (p - 1), left - 1)
    grow(1, 0, 0, radius)
    return found


def _half(fp: Column, side: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * side).bitwiseAND(F.lit((1 << _CODE_BITS) - 1))


def _syndrome(value: Column) -> Column:
    out = F.lit(0)
    for j in range(5):
        mask = sum(1 << (p - 1) for p in range(1, _CODE_BITS + 1) if p >> j & 1)
        out = out + F.bit_count(value.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)) * (1 << j)
    return out


def _anchors(fp: Column, side: int, radius: int) -> Column:
    """Anchors of one half within ``radius`` of a fingerprint, the side in bit 31."""
    value = _half(fp, side)
    table = F.array(*[F.array(*[F.lit(m).cast("bigint") for m in row]) for row in flips(radius)])
    own = F.element_at(table, _syndrome(value) + 1)
    return F.transform(own, lambda m: value.bitwiseXOR(m).bitwiseOR(F.lit(side << _CODE_BITS).cast("bigint")))


def cover(prints: DataFrame) -> DataFrame:
    """``(anchor, fp, home)`` for distinct fingerprints: where each is at home and where it visits."""
    def side(k: int) -> Column:
        home = F.element_at(_anchors(F.col("fp"), k, 1), 1)
        return F.transform(_anchors(F.col("fp"), k, 1 + THRESHOLD // 2), lambda a: F.struct(a.alias("anchor"), (a == home).alias("home")))
    return prints.select("fp", F.explode(F.concat(side(0), side(1))).alias("x")).select("x.anchor", "fp", "x.home")


def cover_again(crowded: DataFrame) -> DataFrame:
    """The rows of crowded anchors dealt to pairs of anchors, one for each half.  The table of flips has a
    fixed size (about 36,500 rows), so it is broadcast."""
    spark = crowded.sparkSession
    rows = [(s, m) for s, row in enumerate(flips(1 + THRESHOLD)) for m in row]
    far = F.broadcast(spark.createDataFrame(pd.DataFrame(rows, columns=["syndrome", "mask"])).select(F.col("syndrome").cast("int"), "mask"))
    side = F.shiftright("anchor", _CODE_BITS)
    value = F.when(side == 0, _half(F.col("fp"), 1)).otherwise(_half(F.col("fp"), 0))
    met = crowded.withColumn("value", value).withColumn("syndrome", _syndrome(F.col("value")).cast("int")).join(far, "syndrome")
    near = F.bit_count("mask") <= 1
    return met.select(F.struct("anchor", F.col("value").bitwiseXOR(F.col("mask")).alias("other")).alias("anchor"), "fp", (F.col("home") & near).alias("home"))


def forest(keys: np.ndarray, prints: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest ``(u, v)`` of the links inside each anchor, for rows sorted by key."""
    edges_u, edges_v = [], []
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = home[lo:hi]
        if hi - lo < 2 or not own.any():
            continue
        values = prints[lo:hi]
        label = np.arange(hi - lo)
        homes = np.flatnonzero(own)
        for h0 in range(0, len(homes), 256):
            block = homes[h0:h0 + 256]
            for v0 in range(0, hi - lo, 16384):
                close = np.bitwise_count(values[block, None] ^ values[None, v0:v0 + 16384]) <= THRESHOLD
                a, b = np.nonzero(close)
                a, b = block[a], b + v0
                while True:
                    la, lb = label[a], label[b]
                    if np.array_equal(la, lb):
                        break
                    np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
                    while not np.array_equal(label, label[label]):
                        label = label[label]
        child = np.flatnonzero(label != np.arange(hi - lo))
        edges_u.append(values[child])
        edges_v.append(values[label[child]])
    if not edges_u:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(edges_u), np.concatenate(edges_v)


def _compare(covered: DataFrame) -> DataFrame:
    """Links ``(u, v)`` found at the anchors.  Rows are dealt to tasks by anchor and sorted there, so an
    anchor's rows arrive together; a task holds one run of anchors at a time."""
    keyed = covered.select(F.xxhash64("anchor").alias("key"), "fp", "home").repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush(rows: np.ndarray) -> pa.RecordBatch:
            u, v = forest(rows[0], rows[1].view(np.uint64), rows[2].astype(bool))
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])
        for batch in batches:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)]))
            size += batch.num_rows
            if size >= PER_TASK:
                rows = np.concatenate(held, axis=1)
                done = int(np.searchsorted(rows[0], rows[0, -1]))  # the last anchor may go on
                if done:
                    yield flush(rows[:, :done])
                held, size = [rows[:, done:]], rows.shape[1] - done
        if size:
            yield flush(np.concatenate(held, axis=1))

    return keyed.mapInArrow(run, "u bigint, v bigint")


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links between distinct fingerprints that connect all pairs within the threshold."""
    covered = cover(prints)
    sizes = covered.groupBy("anchor").count().filter(F.col("count") > crowd).select("anchor")
    crowded = store(sizes, "crowded-anchors")
    if crowded.isEmpty():
        return _compare(covered)
    rest = covered.join(crowded, "anchor", "left_anti")
    return _compare(rest).unionByName(_compare(cover_again(covered.join(crowded, "anchor", "left_semi"))))


def components(rows: DataFrame, id_col: str = "doc_id", crowd: int = CROWD, group_col: str | None = None) -> DataFrame:
    """``(fp, component_id)`` for rows with an id and a fingerprint ``fp``; or ``(fp, group_col)`` with the
    component named by its least fingerprint."""
    prints = store(rows.groupBy("fp").agg(F.min(F.col(f"`{id_col}`")).alias("least")), "fingerprints")
    edges = links(prints.select("fp"), crowd).filter("u <> v")
    labels = star_components(edges, [])
    named = prints.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    if group_col:
        return named.select("fp", F.col("label").alias(group_col))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return named.join(least, "label").select("fp", "component_id")


def near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", crowd: int = CROWD, keep: bool = True) -> DataFrame:
    """Add ``fingerprint`` (16 hex digits) and ``component_id`` to every row; ``keep=False`` leaves the text
    out."""
    rest = [c for c in df.columns if c not in ("fingerprint", "component_id", "fp")]
    small = store(with_fingerprint(df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").alias("_t")), "_t", keep=False), "prints")
    named = components(small, "_id", crowd)
    if set(rest) <= {text, id_col} and not keep:  # nothing else to carry: the stored ids serve
        rows, rest = small.withColumnRenamed("_id", id_col), [id_col]
    else:
        rows = with_fingerprint(df.select(*[F.col(f"`{c}`") for c in rest]), text)
    return rows.join(named, "fp").select(*[F.col(f"`{c}`") for c in rest if keep or c != text], F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
