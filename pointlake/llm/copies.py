"""Near copies of texts: five-word shingles in common, Jaccard similarity 0.8 or more, confirmed exactly.

*Candidates.*  Texts meet in the groups of SimHash: 64-bit fingerprints of three-word shingles, covered by anchors and
linked at 3 or fewer differing bits (``simhash.components``).  These groups miss pairs of more bits, so texts also meet by
bands of minhash.  A text's signature is 96 minima of seeded hashes over its set of shingles, in 24 bands of four.
Texts that agree in a band meet.  A pair of similarity s misses with probability ``(1 - s^4)^24``: 3e-6
at 0.8, less above.  Equal texts are one row; groups with the same members are looked at once.

*Confirmation.*  Where texts meet, their whole sets are compared, so a link is never a guess.  Only a
spanning forest of the links is reported.

*Crowded groups.*  A group of more than ``crowd`` texts is first dealt into parts of that size, differently
in each band, and linked inside the parts.  Texts that are then not in the group's largest component
are compared with all of the group, in cells of bounded size.  Pairs left out are connected already.

*Identity.*  A text is its SHA-256; the 64-bit number by which tasks compare is made unique (``numbered``), so no
text is taken for another.

Defined results: words are separated by ASCII white space, upper-case ASCII letters count as lower-case; a text of
fewer than five words is one shingle; NULL and texts without words have the empty set and are linked; of
equal rows one stays; other columns are kept; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointlake.llm import simhash
from pointlake.llm.common import map_column, store
from pointlake.operators.components import star_components

SHINGLE = 5
BANDS, ROWS = 24, 4
CROWD = 256
PER_TASK = 4_000_000  # shingles held by a task, unless one cell has more
_RNG = np.random.default_rng(7)
_MIX = _RNG.integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) << np.uint64(1) | np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(simhash.shingle_hashes(text or "", SHINGLE))


def bands(shingles: np.ndarray) -> np.ndarray:
    """One number per band, as signed 64-bit integers."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for lo in range(0, len(shingles), 2048):
        np.minimum(low, ((shingles[lo:lo + 2048, None] ^ _MIX[0]) * _MIX[1]).min(0), out=low)
    out = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        out = (out ^ column) * _MIX[1, 0]
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *[r.view(np.int64) for r in rows]])))


def with_bands(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by its ``bands``."""
    return map_column(df, text, [("bands", T.ArrayType(T.LongType()))], lambda: lambda texts: [_lists([bands(shingle_set(t)) for t in texts])], keep=False)


def with_set(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by its set of shingles, ``shingles``."""
    return map_column(df, text, [("shingles", T.ArrayType(T.LongType()))], lambda: lambda texts: [_lists([shingle_set(t) for t in texts])], keep=False)


def forest(ids: np.ndarray, home: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest ``(u, v)`` of the links of one cell; pairs are looked at if one of the two is at
    home.  ``values`` holds the sets one after the other."""
    m = len(ids)
    codes = np.unique(values, return_inverse=True)[1]
    owners = np.repeat(np.arange(m), sizes)[np.argsort(codes, kind="stable")]
    counts = np.bincount(codes)
    starts, ends = np.cumsum(counts) - counts, np.cumsum(sizes)
    label = np.arange(m)
    edges: list[tuple[int, int]] = []
    for h in np.flatnonzero(home).tolist():
        if (label == label[h]).all():
            continue
        own = codes[ends[h] - sizes[h]:ends[h]]
        n = counts[own]
        places = np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(owners[places], minlength=m)
        near = 9 * common >= 4 * (sizes + sizes[h])  # common / union >= 4 / 5, in whole numbers
        for x in np.unique(label[near]).tolist():
            if x != label[h]:
                edges.append((h, int(np.flatnonzero(near & (label == x))[0])))
                label[label == x] = label[h]
    pairs = np.array(edges, np.int64).reshape(-1, 2)
    return ids[pairs[:, 0]], ids[pairs[:, 1]]


def _compare(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``(u, v)`` inside the cells of ``(cell, id, home)``."""
    rows = cells.join(sets, "id").select("cell", "id", "home", "shingles").repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(parts: list[tuple[np.ndarray, ...]], last: bool) -> Iterator[pa.RecordBatch]:
            cell, ids, home, sizes, values = (np.concatenate(x) for x in zip(*parts, strict=True))
            ends = np.cumsum(sizes)
            cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            upto = len(cuts) - 1 if last else len(cuts) - 2  # the last cell may go on
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi in zip(cuts[:upto].tolist(), cuts[1:upto + 1].tolist(), strict=True):
                a, b = forest(ids[lo:hi], home[lo:hi], values[ends[lo] - sizes[lo]:ends[hi - 1]], sizes[lo:hi])
                u.append(a)
                v.append(b)
            at = int(cuts[upto])
            held[:] = [] if last else [(cell[at:], ids[at:], home[at:], sizes[at:], values[ends[at] - sizes[at]:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy()
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False),
                         np.diff(offsets).astype(np.int64), lists.values.to_numpy()[offsets[0]:offsets[-1]]))
            size += len(held[-1][4])
            if size >= PER_TASK:
                yield from flush(held, False)
                size = 0
        if held:
            yield from flush(held, True)

    return rows.mapInArrow(run, "u bigint, v bigint").filter("u <> v")


def _part(seed: Column | str, rows: Column | str, size: int) -> Column:
    """One of as many parts as ``rows`` rows fill, by a draw of the id."""
    return F.pmod(F.xxhash64(seed, "id", F.lit(1)), F.ceil(F.col(rows) / size).cast("bigint"))


def simhash_groups(prints: DataFrame) -> DataFrame:
    """``(id, key)``: the group of near fingerprints of each text, for ``(id, fp)``."""
    texts = prints.select("id", "fp").distinct()
    near = simhash.components(texts, "id", group_col="near")
    return texts.join(near, "fp").select("id", F.xxhash64(F.lit("simhash"), "near").alias("key"))


def meetings(prints: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """``(key, id, n)``: groups of the ``n`` texts that agree in a band or share a group of ``groups(id, key)``; of groups
    with the same members one stays."""
    members = prints.select("id", F.explode("bands").alias("key")).distinct()
    members = store(members.unionByName(groups) if groups is not None else members, "band-members")
    groups = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64("id", F.lit(1)).bitwiseAND(F.lit((1 << 32) - 1))).alias("y"))
    return store(members.join(groups.filter("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"), "key"), "meetings")


def components(met: DataFrame, sets: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``(id, label)`` of the texts that have a near copy, for groups ``met`` and ``(id, shingles)``."""
    dealt = met.select(F.xxhash64("key", _part("key", "n", crowd)).alias("cell"), "id", F.lit(True).alias("home"))
    links = store(_compare(dealt, sets), "copy-links")
    labels = store(star_components(links, []).withColumnRenamed("node", "id"), "copy-labels")
    crowded = met.filter(F.col("n") > crowd)
    if crowded.isEmpty():
        return labels
    named = store(crowded.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "crowded-copies")
    most = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("s"), F.sum("c").alias("all"))
    most = most.select("key", F.col("s.label").alias("main"), (F.col("all") - F.col("s.c")).alias("open")).filter("open > 0")
    left = named.join(most, "key")
    homes = left.filter("label <> main").withColumn("a", _part("key", "open", crowd)).select(
        "key", "id", "a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / crowd).cast("bigint") - 1)).alias("c"), F.lit(True).alias("home"))
    guests = left.withColumn("c", _part("key", "n", crowd)).select(
        "key", "id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("open") / crowd).cast("bigint") - 1)).alias("a"), "c", F.lit(False).alias("home"))
    cells = homes.unionByName(guests.select(*homes.columns)).select(F.xxhash64("key", "a", "c").alias("cell"), "id", "home")
    return star_components(links.unionByName(_compare(cells, sets)), []).withColumnRenamed("node", "id")


def numbered(texts: DataFrame) -> DataFrame:
    """Add ``id`` to distinct texts ``(digest, k64)``: ``k64``, and another hash where it is taken already."""
    place = F.row_number().over(W.partitionBy("k64").orderBy("digest"))
    return texts.withColumn("id", F.when(place == 1, F.col("k64")).otherwise(F.xxhash64("digest", place)))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group of near copies: the smallest ``doc_id`` (then the least digest, then the first of
    equal rows by its other columns)."""
    digest = F.unhex(F.sha2(F.coalesce(F.concat(F.lit("+"), text), F.lit("")), 256))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), digest.alias("digest"))
    rows = rows.withColumn("k64", F.xxhash64("digest"))
    # two passes over the text: in one, a task would run two Python workers at a time
    marks = store(simhash.with_fingerprint(rows.select("digest", "k64", "text"), keep=False), "copy-marks")
    prints = store(with_bands(rows), "copy-prints")
    texts = prints.groupBy("digest", "k64").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("s"))
    least = store(numbered(texts), "copy-texts")
    clash = least.filter("id <> k64").select("digest", F.col("id").alias("other"))
    if not clash.isEmpty():
        marks, prints = (x.join(clash, "digest", "left").withColumn("k64", F.coalesce("other", "k64")) for x in (marks, prints))
    marks, prints = marks.select(F.col("k64").alias("id"), "fp"), prints.select(F.col("k64").alias("id"), "bands")
    met = meetings(prints, simhash_groups(marks))
    # the text of the least row of each candidate; equal rows give it once
    asked = least.join(met.select("id").distinct(), "id").select(F.col("s.doc_id").alias("d"), F.col("digest").alias("k"), "id")
    found = rows.join(asked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("k"))).select("id", "text")
    sets = store(with_set(found.dropDuplicates(["id"])), "copy-sets")
    named = least.join(components(met, sets), "id", "left").withColumn("label", F.coalesce("label", "id"))
    first = named.groupBy("label").agg(F.min("s").alias("s")).select(F.col("s.doc_id").alias("d"), F.col("s.digest").alias("k"))
    kept = docs.withColumn("_digest", digest).join(first, F.col(doc_id).eqNullSafe(F.col("d")) & (F.col("_digest") == F.col("k")), "left_semi")
    one = W.partitionBy(doc_id, "_digest").orderBy(*[c for c in docs.columns if c not in (doc_id, text)] or [F.lit(0)])
    return kept.withColumn("_r", F.row_number().over(one)).filter("_r = 1").select(*docs.columns)
