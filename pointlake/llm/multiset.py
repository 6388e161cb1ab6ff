"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (the pieces between line feeds, as they are).  A paragraph's hash is a
wide vector: 256 counters, the sum of vectors of +1 and -1 taken from the SHA-256 of the whole paragraph
and of its phrases (runs of words that end after a word whose checksum is a multiple of ``PHRASE``).  The
fingerprint is the sum over all paragraphs modulo 2**16 per counter.  So

* equal multisets of paragraphs have equal fingerprints, whatever the order, and others differ (a difference of
  two texts is a non-zero sum of 256-bit digests);
* a paragraph is inserted or deleted by adding or subtracting its vector, and the fingerprint of joined
  texts is the sum of theirs, without reading the texts again (``combined``, ``updated``);
* vectors of different phrases are nearly orthogonal, so ``likeness``, 2 a.b / (a.a + b.b) cut to 0..1, estimates
  the shared part of two texts' paragraphs and phrases, with a standard error of about 1/16.

``compare_with_next`` orders documents by id.  Ids are cut into ranges of about equal numbers of rows, one per
shuffle partition (an id that fills several ranges is cut by a digest of the text); the text is shuffled once,
each range ends with a copy of the first document of the next, and a task walks through its sorted range.

Defined results: a NULL text counts as empty (one empty paragraph); documents with equal ids are ordered by
the hash of their text, NULL ids come last; rows equal in id and text are neighbours; the only document follows
itself; other columns are kept by ``fingerprints`` (outputs replace columns of the same name) and play no
part in ``compare_with_next``; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointlake.llm.common import map_column, text_slices

WIDTH = 256
PHRASE = 4
SALTS = 64
#: Digests unpacked at a time.
_BATCH = 4096
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
                     ("near_edited", pa.float64()), ("near_next", pa.float64())])


def vector(paragraphs: Iterable[str]) -> np.ndarray:
    """Sum of the vectors of some paragraphs."""
    total, digests = np.zeros(WIDTH, np.uint16), []

    def settle() -> None:
        bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8)).reshape(-1, WIDTH)
        total[:] += (2 * bits.sum(0, dtype=np.int64) - len(digests)).astype(np.uint16)
        digests.clear()

    for paragraph in paragraphs:
        data = paragraph.encode()
        digests.append(hashlib.sha256(b"paragraph " + data).digest())
        phrase: list[bytes] = []
        for word in data.split():
            phrase.append(word)
            if crc32(word) % PHRASE == 0:
                digests.append(hashlib.sha256(b"phrase " + b" ".join(phrase)).digest())
                phrase = []
                if len(digests) >= _BATCH:
                    settle()
        if phrase:
            digests.append(hashlib.sha256(b"phrase " + b" ".join(phrase)).digest())
        if len(digests) >= _BATCH:
            settle()
    settle()
    return total


def packed(v: np.ndarray) -> bytes:
    return v.astype("<u2").tobytes()


def unpacked(fingerprint: bytes) -> np.ndarray:
    return np.frombuffer(fingerprint, "<u2").astype(np.uint16)


def inserted(fingerprint: bytes, paragraphs: Iterable[str]) -> bytes:
    return packed(unpacked(fingerprint) + vector(paragraphs))


def deleted(fingerprint: bytes, paragraphs: Iterable[str]) -> bytes:
    return packed(unpacked(fingerprint) - vector(paragraphs))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; 1 for equal vectors."""
    if (a == b).all():
        return 1.0
    x, y = a.astype(np.int16).astype(np.int64), b.astype(np.int16).astype(np.int64)
    return min(1.0, max(0.0, 2 * int(x @ y) / max(1, int(x @ x) + int(y @ y))))


def fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of ``text`` in the binary column ``name``."""
    def start():
        return lambda texts: [pa.array([packed(vector((t or "").split("\n"))) for t in texts], pa.binary())]
    return map_column(df, text, [(name, T.BinaryType())], start)


def combined(prints: DataFrame, key: str = "doc_id", name: str = "fingerprint") -> DataFrame:
    """``(key, name)``: the sum of all fingerprints of each key.  Every task adds up what it reads, then
    (key, salt) and key are added up, so a key with very many rows is spread."""
    rows = prints.select(F.col(f"`{key}`").alias(key), F.col(f"`{name}`").alias(name))
    schema = rows.schema

    def added(keys: list, values: list, sums: dict) -> dict:
        for k, v in zip(keys, values, strict=True):
            if v is not None:
                sums[k] = sums[k] + unpacked(v) if k in sums else unpacked(v)
        return sums

    def table(sums: dict, kind: pa.DataType) -> dict:
        return {key: pa.array(list(sums), kind), name: pa.array([packed(v) for v in sums.values()], pa.binary())}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict(table(added(batch.column(0).to_pylist(), batch.column(1).to_pylist(), {}), batch.schema.field(0).type))

    def merged(rows: pa.Table) -> pa.Table:
        return pa.table(table(added(rows.column(key).to_pylist(), rows.column(name).to_pylist(), {}), rows.schema.field(key).type))

    salted = rows.mapInArrow(partial, schema).withColumn("_salt", F.pmod(F.xxhash64(name), F.lit(SALTS)))
    return salted.groupBy(key, "_salt").applyInArrow(merged, schema).groupBy(key).applyInArrow(merged, schema)


def updated(prints: DataFrame, edits: DataFrame, key: str = "doc_id", name: str = "fingerprint", paragraph: str = "paragraph", sign: str = "sign") -> DataFrame:
    """Fingerprints after ``edits`` ``(key, paragraph, sign)``: +1 inserts a paragraph, -1 deletes one.  Keys
    without a fingerprint start at zero."""
    def start():
        return lambda texts: [pa.array([packed(vector([t or ""])) for t in texts], pa.binary())]
    moved = map_column(edits.select(key, sign, paragraph), paragraph, [(name, T.BinaryType())], start, keep=False)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [packed(unpacked(v) if s > 0 else np.uint16(0) - unpacked(v)) for s, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.binary())], names=[key, name])

    return combined(prints.select(key, name).unionByName(moved.mapInArrow(signed, prints.select(key, name).schema)), key, name)


def _slots(rows: DataFrame) -> tuple[Column, list[float], int]:
    """Number of a row's range in the order of (id, text hash), from columns ``doc_id``, ``_bucket`` (its
    place between the edges) and ``h``; the edges; and how many ranges there are.  The driver sees one id per range."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known")).first()
    number = F.col("doc_id").cast("double")
    cuts = rows.select(number.alias("d")).approxQuantile("d", [k / parts for k in range(1, parts)], 1 / (2 * parts)) if total["known"] and parts > 1 else []
    heavy = {c: 1 + cuts.count(c) for c in set(cuts) if cuts.count(c) > 1 and abs(c) < 2 ** 53}  # one id fills several ranges
    edges = sorted({*cuts, *(math.nextafter(c, math.inf) for c in heavy)})
    widths = [1, *[heavy.get(c, 1) for c in edges], max(1, math.ceil(parts * (total["n"] - total["known"]) / max(1, total["n"])))]
    first = [0, *accumulate(widths)]

    def listed(values: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    bucket = F.when(F.col("doc_id").isNull(), len(edges) + 1).otherwise(F.col("_bucket").cast("int")) + 1
    inside = F.floor((F.col("h") / F.lit(2.0 ** 64) + 0.5) * F.element_at(listed(widths), bucket))
    return F.element_at(listed(first), bucket) + F.least(inside, F.element_at(listed(widths), bucket) - 1), edges, first[-1]


def ranges(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(slot, extra, doc_id, text)``: rows sorted by id and dealt to tasks by range; an ``extra`` row
    ends each range and is the first of the next (after the last, of the first)."""
    rows = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    slot, edges, n = _slots(rows)
    number = rows.withColumn("_d", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)))
    if edges:
        number = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="_d", outputCol="_bucket").transform(number)
    else:
        number = number.withColumn("_bucket", F.lit(0.0))
    placed = number.withColumn("h", F.xxhash64("text")).withColumn("slot", slot.cast("bigint")).select("slot", "doc_id", "h", "text")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    heads = sorted(placed.groupBy("slot").agg(F.min(order).alias("o")).select("slot", "o.doc_id", "o.h").collect())  # one row per range
    copies = [(heads[k - 1][0], s, d, h) for k, (s, d, h) in enumerate(heads)]
    known = F.broadcast(df.sparkSession.createDataFrame(copies, "before bigint, s bigint, d bigint, k bigint"))
    same = (F.col("slot") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k"))
    extra = placed.join(known, same).groupBy("before").agg(F.first(F.struct("doc_id", "h", "text")).alias("r"))
    both = placed.withColumn("extra", F.lit(False)).unionByName(extra.select(F.col("before").alias("slot"), "r.doc_id", "r.h", "r.text", F.lit(True).alias("extra")))
    dealt = both.repartitionById(n, F.col("slot").cast("int"))
    return dealt.sortWithinPartitions("slot", "extra", F.asc_nulls_last("doc_id"), "h").select("slot", "extra", "doc_id", "text")


def compare_with_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``n_chars``, the digest of its edited text (the last half replaced by the first code points
    of the next document, as many or all of them), both fingerprints, and the likeness of its fingerprint to the
    edited text's and to the next document's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for piece, texts in text_slices([batch], 3):
                out = []
                for extra, key, text in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), texts, strict=True):
                    kept = text[:len(text) - len(text) // 2]
                    shared, paragraphs = kept.count("\n"), text.split("\n")
                    start = vector(paragraphs[:shared])
                    whole = start + vector(paragraphs[shared:])
                    if held is not None:
                        out.append(_edited(*held, text, whole))
                    held = None if extra else (key, len(text), kept, shared, start, whole)
                columns = list(zip(*out, strict=True)) or [()] * len(_RESULT)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT, strict=True)], schema=_RESULT)

    return ranges(df, doc_id, text).mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double")


def _edited(key: int | None, n: int, kept: str, shared: int, start: np.ndarray, whole: np.ndarray, following: str, other: np.ndarray) -> tuple:
    """The edited text's fingerprint is the original's with its later paragraphs exchanged."""
    text = kept + following[:n // 2]
    changed = start + vector(text.split("\n")[shared:])
    return key, n, hashlib.sha256(text.encode()).hexdigest(), packed(whole), packed(changed), likeness(whole, changed), likeness(whole, other)
