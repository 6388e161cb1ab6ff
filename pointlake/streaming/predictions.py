"""Metrics of prediction files as they arrive, per run and epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pointlake.operators.metrics import EPS
from pointlake.schema import IGNORE

PREDICTIONS = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("epoch", T.IntegerType()),
    T.StructField("scene_id", T.LongType()), T.StructField("point_idx", T.LongType()),
    T.StructField("gt", T.LongType()), T.StructField("pred", T.LongType()),
])


def watch_predictions(spark: SparkSession, folder: str, counts_path: str, checkpoint: str,
                      min_epoch: int = 0, max_files: int = 1000, available_now: bool = True) -> StreamingQuery:
    """Write the confusion counts of new prediction files, per run and epoch.  Counts add up, so the
    metrics (``run_metrics``) do not depend on how files fall into batches.

    The streaming checkpoint remembers which files were read; the batch number names the output
    folder, so a batch that is run again after a failure replaces its own result."""
    stream = (spark.readStream.schema(PREDICTIONS).option("maxFilesPerTrigger", max_files).parquet(folder)
              .filter(F.col("epoch") >= min_epoch))

    def evaluate(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("run", "epoch", "gt", "pred").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{counts_path.rstrip('/')}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(evaluate).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def run_metrics(spark: SparkSession, counts_path: str, n_classes: int) -> DataFrame:
    """A6 and the number of points of every run and epoch, from all counts written so far."""
    counts = spark.read.parquet(counts_path).groupBy("run", "epoch", "gt", "pred").agg(F.sum("n").alias("n"))
    points = counts.groupBy("run", "epoch").agg(F.sum("n").alias("n_points"))
    seen = counts.filter(F.col("gt") != IGNORE)
    zero = F.lit(0).cast("bigint")
    sides = seen.select("run", "epoch", F.explode(F.array(
        F.struct(F.col("pred").alias("class_id"), F.when(F.col("pred") == F.col("gt"), F.col("n")).otherwise(zero).alias("i"), F.col("n").alias("o"), zero.alias("t")),
        F.struct(F.col("gt").alias("class_id"), zero.alias("i"), zero.alias("o"), F.col("n").alias("t")))).alias("s")).select("run", "epoch", "s.*")
    each = sides.filter(F.col("class_id").between(0, n_classes - 1)).groupBy("run", "epoch", "class_id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.sum("t").alias("t"))

    def mean(x):  # classes without points count as 0
        return F.sum(x) / float(n_classes)
    i, o, t = F.col("i"), F.col("o"), F.col("t")
    sums = each.groupBy("run", "epoch").agg(
        mean(i / (o + t - i + EPS)).alias("miou"), mean(i / (o + EPS)).alias("mpre"), mean(i / (t + EPS)).alias("macc"),
        (F.sum(i) / (F.sum(o) + EPS)).alias("all_pre"), (F.sum(i) / (F.sum(t) + EPS)).alias("all_acc"))
    return points.join(sums, ["run", "epoch"], "left")
