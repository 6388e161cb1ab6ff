"""Registry of checked queries: a Spark plan, its result columns and (where SQL can say it) the
equivalent SQL over the base tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.plans.fixtures import Tables, with_clause


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    columns: tuple[tuple[str, str], ...]
    sql: str | None
    uses: tuple[str, ...]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Tables(spark, sf_dir))
        return df.select(*[self._shape(F.col(c), t).alias(c) for c, t in self.columns])

    @staticmethod
    def _shape(col, kind):
        # doubles are reported at 6 decimals, and -0.0 as 0.0
        return F.round(col.cast("double"), 6) + F.lit(0.0) if kind == "double" else col.cast(kind)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        out = ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0e0 AS {c}" if t == "double"
                        else f"CAST({c} AS {'VARCHAR' if t == 'string' else t.upper()}) AS {c}"
                        for c, t in self.columns)
        return f"{with_clause(self.uses)}SELECT {out} FROM ({self.sql}) q_"


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register the decorated plan under ``name``; ``columns`` reads ``"a bigint, b double"``."""
    cols = tuple((c.split()[0], c.split()[1]) for c in columns.split(","))

    def register(build):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, build, cols, sql, uses)
        return build

    return register
