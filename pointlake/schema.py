"""Table schemas and the class partition.  ``IGNORE`` marks a missing label."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

IGNORE = -100

POINTS = T.StructType([
    T.StructField("scene_id", T.StringType()),
    T.StructField("point_idx", T.LongType()),
    *[T.StructField(c, T.DoubleType()) for c in ("x", "y", "z", "r", "g", "b")],
    T.StructField("sem_label", T.IntegerType()),
    T.StructField("inst_label", T.IntegerType()),
])
FRAMES = T.StructType([
    T.StructField("scene_id", T.StringType()),
    T.StructField("image", T.StringType()),
    T.StructField("pose", T.ArrayType(T.DoubleType())),
    *[T.StructField(c, T.DoubleType()) for c in ("fx", "fy", "cx", "cy", "bx", "by")],
    T.StructField("h", T.IntegerType()),
    T.StructField("w", T.IntegerType()),
])
DEPTH = T.StructType([
    T.StructField("scene_id", T.StringType()),
    T.StructField("image", T.StringType()),
    T.StructField("u", T.IntegerType()),
    T.StructField("v", T.IntegerType()),
    T.StructField("depth", T.DoubleType()),
])
CAPTIONS = T.StructType([
    T.StructField("scene_id", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("image", T.StringType()),
    T.StructField("caption", T.StringType()),
])
CORR = T.StructType([
    T.StructField("scene_id", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("image", T.StringType()),
    T.StructField("point_idx", T.LongType()),
])


@dataclass(frozen=True)
class ClassSplit:
    """Class ids by role.  A vocabulary has at most a few hundred entries, so it lives in the
    plan as literals instead of as a joined table."""

    n_classes: int
    novel: tuple[int, ...] = ()
    ignored: tuple[int, ...] = ()
    base: tuple[int, ...] = field(default=())

    def __post_init__(self):
        if not self.base:
            rest = set(self.novel) | set(self.ignored)
            object.__setattr__(self, "base", tuple(c for c in range(self.n_classes) if c not in rest))

    @property
    def valid(self) -> tuple[int, ...]:
        """All classes but the ignored ones, in id order."""
        return tuple(c for c in range(self.n_classes) if c not in set(self.ignored))

    def role(self, class_id: Column) -> Column:
        return (F.when(class_id.isin(*self.base), F.lit("base"))
                .when(class_id.isin(*self.novel), F.lit("novel"))
                .when(class_id.isin(*self.ignored), F.lit("ignored")))
