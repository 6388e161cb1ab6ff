"""Pieces shared by the text operators: words, bounded batches, tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointlake.session import use_checkpoint_dir

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of text that a task turns into Python objects at a time.
SLICE = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{use_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends at files that
    survive the loss of executors, and later readers scan only the columns they need."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Number of words; NULL counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def slices(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes add up to at most ``limit`` (a larger single item stays alone)."""
    lo, held = 0, 0
    for i, size in enumerate(sizes):
        if i > lo and held + size > limit:
            yield lo, i
            lo, held = i, 0
        held += size
    if lo < len(sizes):
        yield lo, len(sizes)


def text_slices(batches: Iterator[pa.RecordBatch], text: str | int = "text", limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Split Arrow batches so that a slice holds about ``limit`` bytes of text, whatever the length of
    the documents; yields the slice and its texts (None where NULL)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        for lo, hi in slices([max(n, 100) for n in sizes], limit):
            piece = batch.slice(lo, hi - lo)
            yield piece, piece.column(text).to_pylist()
            del piece
        # the next batch is read when this one is gone
        del batch, sizes
        pa.default_memory_pool().release_unused()


def map_column(df: DataFrame, source: str, outs: Sequence[tuple[str, T.DataType]], start: Callable[[], Callable[[list], list[pa.Array]]],
               keep: bool = True, limit: int = SLICE) -> DataFrame:
    """Append columns computed from ``source``.  ``start()`` is called once per task; what it returns gets
    the values of a slice of rows and gives one array per new column.  Other columns pass through
    untouched (replaced if they have a new column's name); ``keep=False`` leaves ``source`` out of the result,
    so that long texts do not travel back."""
    names = [n for n, _ in outs]
    rest = [c for c in df.columns if c not in (*names, source)]
    back = keep and source not in names
    kept = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{source}`"))
    fields = kept.schema.fields[:len(rest) + back]
    schema = T.StructType([*fields, *[T.StructField(n, t) for n, t in outs]])
    labels = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = start()
        for piece, values in text_slices(batches, len(labels) - len(names) - back, limit):
            yield pa.RecordBatch.from_arrays([*piece.columns[:len(labels) - len(names)], *apply(values)], names=labels)
            del piece, values

    return kept.mapInArrow(run, schema)
