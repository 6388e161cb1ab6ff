"""Sinks (K1-K7).  Folders hold one part per task; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointlake.functions.blocks import ordinal, with_stats
from pointlake.operators.labels import CODE_BASE, code_class, lookup
from pointlake.operators.masks import dense_runs, mask_runs
from pointlake.operators.overlap import mask_key
from pointlake.sources.named_files import write_named_files


def write_scene_arrays(rows: DataFrame, path: str, columns: Sequence[str], rows_per_file: int = 5_000_000) -> None:
    """K1: per-scene columns, partitioned by scene.  Rows are spread by scene and index block, so a
    huge scene becomes several files."""
    out = rows.select("scene_id", "point_idx", *columns)
    spread = out.repartition(F.col("scene_id"), F.floor(F.col("point_idx") / rows_per_file))
    spread.sortWithinPartitions("scene_id", "point_idx").write.mode("overwrite").partitionBy("scene_id").parquet(path)


def pred_manifest(meta: DataFrame, eval_ids: Sequence[int] | None = None) -> DataFrame:
    """K2: ``predicted_masks/<scene>_<iii>.txt label conf`` lines; labels optionally become evaluation
    ids by position.  Predictions that share a mask (``mask_id``) name one file, that of the first of them."""
    label = F.col("label_id")
    if eval_ids is not None:
        label = lookup(label, {i + 1: v for i, v in enumerate(eval_ids)}, 0)
    numbered = ordinal(meta, ["scene_id"], ["pred_id"], "_i", F.shiftright("pred_id", 16))
    part = mask_key(meta)
    # a mask has one prediction per class at most
    first = F.min("_i").over(W.partitionBy("scene_id", "mask_id")) if part == "mask_id" else F.col("_i")
    numbered = numbered.withColumn("_f", first)
    name = F.when(F.col("_f") < 1000, F.lpad(F.col("_f").cast("string"), 3, "0")).otherwise(F.col("_f").cast("string"))
    mask = F.concat(F.lit("predicted_masks/"), F.col("scene_id").cast("string"), F.lit("_"), name, F.lit(".txt"))
    line = F.concat(mask, F.lit(" "), label.cast("string"), F.lit(" "), F.format_string("%.4f", F.col("conf").cast("double")))
    return numbered.select("scene_id", *dict.fromkeys(["pred_id", part]), F.col("_i").alias("position"), mask.alias("mask_path"), line.alias("line"))


def dense_mask(mask: DataFrame, points: DataFrame) -> DataFrame:
    """K2: every predicted instance as runs of 0 and 1 over all points of its scene."""
    lengths = points.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_points"))
    key = ["scene_id", mask_key(mask)]
    return dense_runs(mask_runs(mask, key), lengths, key)


def write_pred_instances(meta: DataFrame, mask: DataFrame, path: str, eval_ids: Sequence[int] | None = None) -> None:
    """K2: manifest lines as text and masks as columns sorted by point index.  The files of a scene's
    manifest, in name order, hold its lines in order."""
    # all tasks write: left to adaptive execution, these few bytes would meet in one task, which would write a file per scene
    tasks = int(meta.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = pred_manifest(meta, eval_ids).repartitionByRange(tasks, "scene_id", "position").sortWithinPartitions("scene_id", "position")
    lines.select("scene_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("scene_id").text(f"{path}/manifest")
    part = mask_key(mask)
    spread = mask.select("scene_id", part, "point_idx").repartition("scene_id", part, F.shiftright("point_idx", 22))
    spread.sortWithinPartitions("scene_id", part, "point_idx").write.mode("overwrite").parquet(f"{path}/masks")


def write_mask_files(meta: DataFrame, mask: DataFrame, points: DataFrame, path: str) -> None:
    """K2: the files that the manifest names, below ``path``: a line 0 or 1 per point of the scene.

    Masks travel as runs; the runs of a file reach one task in order and leave it as they come, so a task holds a
    run at a time.  Files appear together when all tasks are done (``named_files``)."""
    part = mask_key(mask)
    files = pred_manifest(meta).select("scene_id", part, "mask_path").distinct()
    rows = dense_mask(mask, points).join(files, ["scene_id", part])
    write_named_files(rows.select(F.col("mask_path").alias("path"), F.col("start").alias("place"), F.col("value").cast("string").alias("line"), F.col("length").alias("times")), path)


def remap_gt_codes(codes: DataFrame, eval_ids: Sequence[int]) -> DataFrame:
    """K3: class part of ``class * 1000 + instance`` through the id list; class 0 stays 0."""
    cls = lookup(code_class(F.col("code")), {0: 0} | {i + 1: v for i, v in enumerate(eval_ids)}, 0)
    return codes.withColumn("code", (cls * CODE_BASE + F.col("code") % CODE_BASE).cast("bigint"))


def export_instances(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K4: an entry per distinct non-zero instance with the label of its first point and confidence
    1, and its mask."""
    used = points.filter("inst_label <> 0")
    first = F.min(F.struct("point_idx", "sem_label"))["sem_label"]
    meta = used.groupBy("scene_id", F.col("inst_label").alias("pred_id")).agg(first.alias("label_id"), F.count(F.lit(1)).alias("n_points"))
    mask = used.select("scene_id", F.col("inst_label").alias("pred_id"), "point_idx")
    return meta.withColumn("conf", F.lit(1.0)), mask


def write_metric_csv(class_avgs: DataFrame, path: str) -> None:
    """K5: ``class, class_id, ap, ap50, ap25``."""
    class_avgs.select("class", "class_id", "ap", "ap50", "ap25").write.mode("overwrite").csv(path, header=True)


def captions_json(captions: DataFrame, image: str = "image", per_line: int = 1 << 16) -> DataFrame:
    """K6: JSON lines ``{scene: {image: text}}``, one per scene; a scene with more than ``per_line``
    captions takes several lines."""
    keyed = captions.withColumn("_h", F.pmod(F.xxhash64(image), F.lit(1 << 26)))
    keyed = with_stats(keyed, ["scene_id"], key="_h", _n=("count",))
    keyed = keyed.withColumn("_part", F.col("_h") % F.ceil(F.col("_n") / per_line))
    images = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(image).cast("string"), "caption"))))
    rows = keyed.groupBy("scene_id", "_part").agg(images.alias("m"))
    return rows.select(F.to_json(F.create_map(F.col("scene_id").cast("string"), F.col("m"))).alias("value"))


def write_correspondence(corr: DataFrame, path: str) -> None:
    """K6: long-form index partitioned by level and sorted by point, so runs compress."""
    spread = corr.repartition("level", "scene_id", "image", F.shiftright("point_idx", 22))
    spread.sortWithinPartitions("scene_id", "image", "point_idx").write.mode("overwrite").partitionBy("level").parquet(path)


def merge_indexes(spark: SparkSession, glob: str, path: str, folder_key: str | None = None) -> None:
    """K7: per-scene index files as one table keyed by file stem, or by the ``key=value`` folder the
    files lie in."""
    file = F.col("_metadata.file_path")
    scene = (F.regexp_extract(file, rf"/{folder_key}=([^/]+)/", 1) if folder_key
             else F.regexp_replace("_metadata.file_name", r"\.[^.]*$", ""))
    rows = spark.read.parquet(glob).withColumn("scene_id", scene)
    rows.repartition("scene_id", "image", F.shiftright("point_idx", 22)).sortWithinPartitions("scene_id", "image", "point_idx").write.mode("overwrite").parquet(path)
