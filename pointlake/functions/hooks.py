"""User functions over batches of rows, and step lists."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_batches(rows: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """F8: run a user function (a captioner, say) over Arrow batches of rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)
    return rows.mapInPandas(run, schema)


def encode_texts(rows: DataFrame, text: str, encoder: Callable[[list[str]], Sequence[Sequence[float]]],
                 out: str = "embedding") -> DataFrame:
    """F8: add a vector per text from a user encoder called once per batch."""
    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[float(v) for v in vec] for vec in encoder(texts.tolist())])
    return rows.withColumn(out, encode(F.col(text)))


Step = Callable[[DataFrame], DataFrame]


def run_steps(df: DataFrame, steps: Iterable[Step]) -> DataFrame:
    """apply table transforms in order."""
    for step in steps:
        df = df.transform(step)
    return df


def configured_steps(registry: Mapping[str, Callable[..., Step]], config: Sequence[Mapping]) -> list[Step]:
    """steps named by a config list ``[{"name": ..., other arguments}]``."""
    return [registry[c["name"]](**{k: v for k, v in c.items() if k != "name"}) for c in config]
