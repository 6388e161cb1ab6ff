"""Vector expressions on ARRAY columns, and the Arrow matrix product."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; a column used inside a lambda is otherwise
    computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """M7: inner product in double."""
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    """M7: unit vector; a zero vector stays zero."""
    return let(F.greatest(norm(a), F.lit(1e-12)), lambda n: F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def exp_shifted(a: Column) -> Column:
    """``exp(x - max)`` of every component."""
    return let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top)))


def normalise_sum(a: Column) -> Column:
    """Components divided by their sum."""
    return let(a, lambda v: let(total(v), lambda t: F.transform(v, lambda x: x / t)))


def softmax(a: Column) -> Column:
    """M7: stable softmax."""
    return normalise_sum(exp_shifted(a))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.exp(-x) + 1.0)


def argmax(a: Column) -> Column:
    """First position of the largest value."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("bigint")


def mean_vector(rows: DataFrame, group: Sequence[str], vec: str, dim: int, out: str = "pooled") -> DataFrame:
    """A3/A4: component-wise mean per group with the number of vectors.

    One ``avg`` per component, combined map-side: a hot group ships one partial row per task.  A NULL
    vector does not count; a group of NULL vectors stays with a NULL mean and 0 rows; a vector of
    another length than ``dim`` raises."""
    v = F.col(vec)
    wrong = F.raise_error(F.concat(F.lit(f"expected {dim} components, found "), F.size(v).cast("string"))).cast(rows.schema[vec].dataType)
    checked = rows.select(*group, F.when(v.isNull() | (F.size(v) == dim), v).otherwise(wrong).alias("_vec"))
    n = F.count("_vec")
    means = F.array(*[F.avg(F.get(F.col("_vec"), F.lit(i)).cast("double")) for i in range(dim)])
    return checked.groupBy(*group).agg(F.when(n > 0, means).alias(out), n.alias("n_rows"))


def score_matrix(rows: DataFrame, feat: str, weights: np.ndarray, normalise: bool, scale: float,
                 out: str = "logits") -> DataFrame:
    """``feature . class vector * scale`` for every class as one Arrow-batched matrix product.

    ``weights`` (classes x dim) is the text embedding of a class vocabulary, a few hundred short
    vectors; it travels inside the function."""
    w = np.asarray(weights, dtype=np.float64).T * scale

    @F.pandas_udf("array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = np.stack(s.to_numpy()).astype(np.float64) if len(s) else np.zeros((0, w.shape[0]))
            if normalise:
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            yield pd.Series(list(x @ w))

    return rows.withColumn(out, project(F.col(feat)))


def best_class(rows: DataFrame, key: Sequence[str], feat: str, classes: DataFrame, scale: float = 1.0, class_block: int = 4096,
               row_block: int = 1 << 16, cell: int = 1 << 16) -> DataFrame:
    """C1 and T1 for a vocabulary of any size: ``(key, pred, score)``, the class of the largest ``scale * cosine`` per row
    (scores equal to 9 digits: the lowest id).

    ``classes(class_id, embedding)`` stays a table.  Rows and classes are dealt by hash into cells of about
    ``row_block`` rows and ``cell`` classes, so a row is copied once per cell of classes and a class once per cell
    of rows.  Where two cells meet, a task multiplies 1024 rows with ``class_block`` classes at a time, a row keeps its best
    class, and the bests of a row are merged map-side.  Neither
    vocabulary nor scores are gathered anywhere.  Rows without a vector have no class."""
    key = list(key)
    known = classes.filter(F.col("class_id").isNotNull())
    parts, cells = [max(1, -(-df.count() // size)) for df, size in ((rows, row_block), (known, cell))]

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    left = rows.filter(F.col(feat).isNotNull()).select(*key, F.col(feat).cast("array<double>").alias("_v"), F.pmod(F.xxhash64(*key), F.lit(parts)).alias("_r"), each(cells).alias("_c"))
    right = known.select(F.col("class_id").cast("bigint").alias("class_id"), F.col("embedding").cast("array<double>").alias("_e"),
                         F.pmod(F.xxhash64("class_id"), F.lit(cells)).alias("_c"), each(parts).alias("_r"))
    schema = ", ".join([*[f"{c} {rows.schema[c].dataType.simpleString()}" for c in key], "score double", "pred bigint"])

    def stack(t: pa.Table, c: str) -> np.ndarray:
        return t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.select(key).slice(0, 0).append_column("score", pa.array([], pa.float64())).append_column("pred", pa.array([], pa.int64()))
        right = right.sort_by("class_id")
        x, w = unit(stack(left, "_v")), unit(stack(right, "_e")).T * scale
        at, top = np.zeros(len(x), np.int64), np.full(len(x), -np.inf)
        for lo in range(0, len(x), 1024):
            for c in range(0, w.shape[1], class_block):
                scores = (x[lo:lo + 1024] @ w[:, c:c + class_block]).round(9)
                best = scores.argmax(1)
                score = scores[np.arange(len(best)), best]
                held = top[lo:lo + 1024]
                better = (score > held) | (np.isnan(score) & ~np.isnan(held))  # an equal score of a later class loses
                at[lo:lo + 1024][better] = best[better] + c
                top[lo:lo + 1024][better] = score[better]
        best = right.column("class_id").combine_chunks().take(pa.array(at))
        return left.select(key).append_column("score", pa.array(top)).append_column("pred", best)

    met = left.groupBy("_r", "_c").cogroup(right.groupBy("_r", "_c")).applyInArrow(meet, schema)
    top = F.max(F.struct("score", (-F.col("pred")).alias("neg"))).alias("_t")
    return met.groupBy(*key).agg(top).select(*key, (-F.col("_t.neg")).alias("pred"), F.col("_t.score").alias("score"))
