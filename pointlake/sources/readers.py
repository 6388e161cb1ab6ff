"""Sources (S1-S12)."""

from __future__ import annotations

import io
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointlake.functions.blocks import attach, ordinal
from pointlake.functions.text import area_of, file_stem, image_key
from pointlake.operators.labels import lookup
from pointlake.operators.projection import invert_rigid, rescale_intrinsics
from pointlake.schema import IGNORE
from pointlake.session import cut_lineage


def read_object_files(spark: SparkSession, root: str, classes: Sequence[str], fallback: str = "clutter") -> DataFrame:
    """``<area>/<room>/Annotations/<class>_<k>.txt`` files of ``x y z r g b`` lines.

    Unknown classes become ``fallback``; instances are numbered from 1 in file-name order per room, the
    points of a room follow each other by file and line, and the room is moved to the origin.

    The text is read twice: once for the size and the least coordinates of each split of a file (the
    windows over a room see one row per split), once for the points, which join their split."""
    names = [*"xyz", *"rgb"]
    split = ["path", "_start"]
    lines = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root)
             .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"),
                     F.monotonically_increasing_id().alias("_seq"), "value").filter(F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+")

    def number(word: Column) -> Column:
        return F.coalesce(word.try_cast("double"), F.raise_error(F.concat(F.lit("not a point: "), "value", F.lit(" in "), "path")).cast("double"))
    rows = lines.select(*split, "_seq", *[number(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(names)])
    pieces = cut_lineage(rows.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(f"_m{c}") for c in "xyz"]))
    bits = F.split("path", "/")
    known = {c: i for i, c in enumerate(classes)}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    file = F.element_at(bits, -1)
    label = F.coalesce(F.try_element_at(table, F.element_at(F.split(file, "_"), 1)), F.lit(known[fallback]))
    pieces = pieces.withColumns({"scene_id": F.concat_ws("_", F.element_at(bits, -4), F.element_at(bits, -3)), "_file": file, "sem_label": label})
    room = W.partitionBy("scene_id")
    by_file = room.orderBy("_file", "path")
    earlier = room.orderBy("_file", *split).rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select(*split, "scene_id", "sem_label", F.dense_rank().over(by_file).cast("bigint").alias("inst_label"),
                           F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), *[F.min(f"_m{c}").over(room).alias(f"_m{c}") for c in "xyz"])
    rows = rows.withColumn("_in", F.row_number().over(W.partitionBy(*split).orderBy("_seq"))).join(pieces, split)
    return rows.select("scene_id", (F.col("_before") + F.col("_in") - 1).alias("point_idx"),
                       *[(F.col(c) - F.col(f"_m{c}")).alias(c) for c in "xyz"], *"rgb", "sem_label", "inst_label")


def read_numeric_scenes(spark: SparkSession, glob: str, columns: Sequence[str], rows_per_batch: int = 1 << 16) -> DataFrame:
    """S3: ``.npy`` arrays with one row per point; the scene is the file stem.  Each file is decoded
    by the task that read it and leaves it in batches of rows.  Pickled arrays and arrays of another
    width than ``columns`` are refused."""
    files = spark.read.format("binaryFile").load(glob).select(file_stem(F.col("path")).alias("scene_id"), "content")
    names = list(columns)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for scene, raw in zip(batch["scene_id"], batch["content"]):
                arr = np.load(io.BytesIO(raw), allow_pickle=False)
                if arr.ndim != 2 or arr.shape[1] != len(names):
                    raise ValueError(f"scene {scene}: shape {arr.shape}, expected {len(names)} columns")
                for lo in range(0, len(arr), rows_per_batch):
                    part = pd.DataFrame(arr[lo:lo + rows_per_batch, :len(names)].astype(np.float64), columns=names)
                    part.insert(0, "point_idx", np.arange(lo, lo + len(part), dtype=np.int64))
                    part.insert(0, "scene_id", scene)
                    yield part

    return files.mapInPandas(decode, "scene_id string, point_idx bigint, " + ", ".join(f"{n} double" for n in names))


def read_scene_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """K1 read back.  The schema is given, so scene names that look like numbers stay as written."""
    return spark.read.schema(schema).parquet(path)


def list_scenes(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """Scenes of a split by file suffix; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), F.lit(f"\\Q{suffix}\\E$"), F.lit("")).alias("scene_id"))


def split_by_area(scenes: DataFrame, test_area: int, scene: str = "scene_id") -> DataFrame:
    """Rooms of the held-out area are the test split."""
    return scenes.withColumn("split", F.when(area_of(F.col(scene)) == test_area, "test").otherwise("train"))


def read_scene_list(spark: SparkSession, path: str) -> DataFrame:
    """One scene per line, trimmed; blank lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("scene_id")).filter("scene_id <> ''").distinct()


def restrict_to_scenes(rows: DataFrame, scenes: DataFrame) -> DataFrame:
    """Rows of the listed scenes."""
    return rows.join(scenes.select("scene_id").distinct(), "scene_id", "left_semi")


def fill_missing_labels(points: DataFrame) -> DataFrame:
    """Unlabelled splits get IGNORE as labels."""
    for c in ("sem_label", "inst_label"):
        label = F.coalesce(F.col(c), F.lit(IGNORE)) if c in points.columns else F.lit(IGNORE)
        points = points.withColumn(c, label.cast("bigint"))
    return points


def read_captions(spark: SparkSession, path: str, level: str, per_line: bool = False) -> DataFrame:
    """``{scene: {image: text}}`` files, or ``{scene: text}`` at scene level (image NULL).
    ``per_line`` reads files with one such object per line, which split over tasks.  Broken JSON raises."""
    strict = {"mode": "FAILFAST"}
    raw = spark.read.text(path, wholetext=not per_line)
    if level == "scene":
        scenes = raw.select(F.explode(F.from_json("value", "map<string,string>", strict)).alias("scene_id", "caption"))
        return scenes.select("scene_id", F.lit(level).alias("level"), F.lit(None).cast("string").alias("image"), "caption")
    scenes = raw.select(F.explode(F.from_json("value", "map<string,map<string,string>>", strict)).alias("scene_id", "images"))
    return (scenes.select("scene_id", F.explode("images").alias("image", "caption"))
            .select("scene_id", F.lit(level).alias("level"), image_key(F.col("image")).alias("image"), "caption"))


def read_correspondence(spark: SparkSession, path: str, level: str | None = None) -> DataFrame:
    """Long-form correspondence, partitioned by level; a scene without rows has none."""
    corr = spark.read.parquet(path)
    return corr if level is None else corr.filter(F.col("level") == level)


def _matrix(text: Column, path: Column, sizes: Sequence[int]) -> Column:
    """Numbers between white space, ``inf`` and ``nan`` included; other words and other counts raise."""
    bad = F.raise_error(F.concat(F.lit("not a matrix: "), path))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    cells = F.transform(words, lambda w: F.coalesce(w.try_cast("double"), bad.cast("double")))
    return F.when(F.size(words).isin(*sizes), cells).otherwise(bad.cast("array<double>"))


def _finite(cells: Column) -> Column:
    return F.forall(cells, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))


def read_pose_texts(spark: SparkSession, glob: str) -> DataFrame:
    """4x4 matrices as text, one file per image: ``(scene_id, image, pose)``.  Paths end in
    ``<scene>/pose/<image>.txt``.  A pose with a number that is not finite marks a frame whose camera was
    lost; it sees no point and is left out."""
    raw = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    poses = raw.select(F.element_at(F.split("path", "/"), -3).alias("scene_id"), image_key(file_stem(F.col("path"))).alias("image"),
                       _matrix(F.col("value"), F.col("path"), [16]).alias("pose"))
    return poses.filter(_finite(F.col("pose")))


def read_pose_json(spark: SparkSession, glob: str) -> DataFrame:
    """JSON poses with ``camera_rt_matrix`` (world -> camera) and ``camera_k_matrix``."""
    schema = "camera_rt_matrix array<array<double>>, camera_k_matrix array<array<double>>"
    raw = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("j"))
    k = F.col("j.camera_k_matrix")
    return raw.select(F.element_at(F.split("path", "/"), -3).alias("scene_id"), image_key(file_stem(F.col("path"))).alias("image"),
                      F.flatten("j.camera_rt_matrix").alias("pose"), k[0][0].alias("fx"), k[1][1].alias("fy"), k[0][2].alias("cx"), k[1][2].alias("cy"))


def read_intrinsics(spark: SparkSession, glob: str) -> DataFrame:
    """One intrinsic matrix (3x3 or 4x4 text) per scene folder."""
    path = F.col("_metadata.file_path")
    raw = spark.read.text(glob, wholetext=True).select(F.element_at(F.split(path, "/"), -2).alias("scene_id"), _matrix(F.col("value"), path, [9, 16]).alias("k"))
    side = F.when(F.size("k") == 9, 3).otherwise(4)
    shift = [F.when(side == 4, F.get("k", i * 4 + F.lit(3))).otherwise(0.0) for i in range(2)]
    return raw.select("scene_id", F.col("k")[0].alias("fx"), F.get("k", side + 1).alias("fy"), F.col("k")[2].alias("cx"),
                      F.get("k", side + 2).alias("cy"), shift[0].alias("bx"), shift[1].alias("by"))


def list_room_images(spark: SparkSession, root: str) -> DataFrame:
    """Image files ``area_<a>/data/<kind>/*_<room>_<n>_*`` of the office set with their scene and
    kind.  The key of an image is its name up to ``_domain_`` in lower case; contents are not read."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    name = file_stem(F.col("path"))
    where = r"/area_(\w+)/data/(\w+)/[^/]+$"
    room = r"_([A-Za-z]+_\d+)_"
    rows = paths.filter(F.col("path").rlike(where) & name.rlike(room))
    kind = F.regexp_extract("path", where, 2)
    return rows.select(F.concat_ws("_", F.lit("Area"), F.regexp_extract("path", where, 1), F.regexp_extract(name, room, 1)).alias("scene_id"),
                       F.when(kind == "rgb", "color").otherwise(kind).alias("kind"),
                       image_key(F.regexp_replace(name, "_domain_.*$", "")).alias("image"), "path")


def list_scan_images(spark: SparkSession, root: str, kinds: Sequence[str] = ("pose", "depth", "color")) -> DataFrame:
    """Files ``<scene>/<kind>/<image>.<suffix>`` of the scanner set: ``(scene_id, kind, image)``; contents are not
    read."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    bits = F.split("path", "/")
    rows = paths.select(F.element_at(bits, -3).alias("scene_id"), F.element_at(bits, -2).alias("kind"), image_key(file_stem(F.col("path"))).alias("image"))
    return rows.filter(F.col("kind").isin(*kinds))


def assemble_frames(files: DataFrame, poses: DataFrame, sizes: DataFrame, intrinsics: DataFrame | None = None, to_world: bool = True,
                    strict: bool = True, native_height: int = 480, kinds: Sequence[str] = ("pose", "depth", "color")) -> DataFrame:
    """One FRAMES table ``(scene_id, frame, image, pose, fx, fy, cx, cy, bx, by, h, w)`` for J1.

    * ``files(scene_id, kind, image)``: scenes with unequal counts raise, or have no frames if not ``strict``.  The
      images of the first kind are the frames, numbered from 0 by image number, names without one last.
    * ``poses(scene_id, image, pose)`` of 12 or 16 numbers, camera -> world (``to_world``) or world -> camera, and
      maybe intrinsics of their own.  A frame without a pose (a lost camera) keeps its number and is left out.
    * ``intrinsics(scene_id, fx, ...)`` per scene fill what the poses do not say; a frame without any raises.
    * ``sizes(scene_id, image, h, w)``: intrinsics are rescaled where the height is not the native one (J3); a frame
      without a size raises."""
    lens = ["fx", "fy", "cx", "cy", "bx", "by"]
    whole = complete_scenes(files, kinds, strict).select("scene_id")
    images = files.filter(F.col("kind") == kinds[0]).select("scene_id", "image").join(whole, "scene_id", "left_semi")
    number = F.col("image").cast("string").try_cast("bigint")
    images = images.withColumn("_n", F.coalesce(number, F.lit((1 << 63) - 1)))
    out = ordinal(images, ["scene_id"], ["_n", "image"], "frame", F.shiftright("_n", 16)).drop("_n")
    own = [c for c in lens if c in poses.columns]
    out = out.join(poses.select("scene_id", "image", "pose", *[F.col(c).alias(f"_p{c}") for c in own]), ["scene_id", "image"])
    out = out.join(sizes.select("scene_id", "image", "h", "w"), ["scene_id", "image"], "left")
    shared = [] if intrinsics is None else [c for c in lens if c in intrinsics.columns]
    if intrinsics is not None:
        out = out.join(intrinsics.select("scene_id", *[F.col(c).alias(f"_s{c}") for c in shared]), "scene_id", "left")

    def known(c: str) -> Column:
        name = F.concat_ws("/", F.col("scene_id").cast("string"), F.col("image").cast("string"))
        last = F.lit(0.0) if c in ("bx", "by") else F.raise_error(F.concat(F.lit(f"no {c} for image "), name)).cast("double")
        return F.coalesce(*[F.col(f"_p{c}").cast("double")] * (c in own), *[F.col(f"_s{c}").cast("double")] * (c in shared), *[F.col(c).cast("double")] * (c in ("h", "w")), last)
    last_row = F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])
    full = F.when(F.size("pose") == 12, F.concat(F.col("pose"), last_row)).otherwise(F.col("pose"))
    out = out.withColumn("pose", full)
    pose = invert_rigid(F.col("pose")) if to_world else F.col("pose")
    rows = out.select("scene_id", "frame", "image", pose.alias("pose"), *[known(c).alias(c) for c in lens], *[known(c).cast("bigint").alias(c) for c in ("h", "w")])
    return rescale_intrinsics(rows, native_height)


def complete_scenes(files: DataFrame, kinds: Sequence[str] = ("pose", "depth", "color"), strict: bool = True) -> DataFrame:
    """Scenes whose file counts agree over all kinds.  ``files(scene_id, kind)`` holds one row per
    file.  ``strict`` raises on a mismatch, else the scene gets no images."""
    counts = files.groupBy("scene_id").agg(*[F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(k) for k in kinds])
    same = F.lit(True)
    for k in kinds[1:]:
        same = same & (F.col(k) == F.col(kinds[0]))
    if strict:
        same = F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("file counts differ in scene "), F.col("scene_id").cast("string"))).cast("boolean"))
    return counts.filter(same).select("scene_id", F.col(kinds[0]).alias("n_images"))


def read_id_lists(spark: SparkSession, glob: str) -> DataFrame:
    """One id per line and file; ``point_idx`` is the line number from 0.

    The folder of ``glob`` is listed as a whole and its files are chosen by name: a path per file would be listed by a
    task each.  A file may be read in several splits.  Lines are numbered inside a split (a task reads its lines in order)
    and shifted by the line counts of the earlier splits of the file."""
    folder, _, name = glob.rpartition("/")
    files = spark.read.option("pathGlobFilter", name).text(folder or ".")
    if files.isEmpty():
        files = spark.read.text(glob)  # folders of that name; raises where nothing has it
    lines = files.select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"), "value").filter(F.trim("value") != "")
    out = ordinal(lines, ["_path"], ["_seq"], "point_idx", F.col("_start"))
    return out.select(file_stem(F.col("_path")).alias("scene_id"), "point_idx", F.trim("value").cast("bigint").alias("id"))


def read_instance_manifests(spark: SparkSession, glob: str) -> DataFrame:
    """``mask_path label conf`` lines.  ``valid`` is false for lines without three fields, with an
    absolute path, or with a path that leaves the prediction folder."""
    raw = spark.read.text(glob).select(file_stem(F.col("_metadata.file_path")).alias("scene_id"), "value")
    parts = F.split("value", " ")
    path = F.get(parts, F.lit(0))
    ups = F.aggregate(F.split(path, "/"), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
                      lambda s, p: F.struct((s["d"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("d"),
                                            F.least(s["low"], s["d"] + F.when(p == "..", -1).otherwise(0)).alias("low")))
    rows = raw.select("scene_id", path.alias("mask_path"), F.get(parts, F.lit(1)).try_cast("double").cast("bigint").alias("label_id"),
                      F.get(parts, F.lit(2)).try_cast("double").alias("conf"), F.size(parts).alias("_n"), ups["low"].alias("_low"))
    ok = (F.col("_n") == 3) & ~F.col("mask_path").startswith("/") & (F.col("_low") >= 0) & F.col("label_id").isNotNull() & F.col("conf").isNotNull()
    return rows.withColumn("valid", ok).drop("_n", "_low")


def read_scene_offsets(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """``{scene: [x, y, z]}`` JSON, one object per file, or per line with ``per_line``.  Broken JSON raises."""
    raw = spark.read.text(path, wholetext=not per_line)
    rows = raw.select(F.explode(F.from_json("value", "map<string,array<double>>", {"mode": "FAILFAST"})).alias("scene_id", "o"))
    return rows.select("scene_id", *[F.col("o")[i].alias(f"off_{c}") for i, c in enumerate("xyz")])


def add_scene_offsets(points: DataFrame, offsets: DataFrame) -> DataFrame:
    """Back to the coordinates the cameras use.  A scene without an offset raises."""
    out = attach(points, offsets, ["scene_id"], how="left")
    missing = F.raise_error(F.concat(F.lit("no offset for scene "), F.col("scene_id").cast("string"))).cast("double")
    for c in "xyz":
        out = out.withColumn(c, F.col(c) + F.coalesce(F.col(f"off_{c}"), missing))
    return out.drop("off_x", "off_y", "off_z")


def name_classes(label: Column, names: Sequence[str]) -> Column:
    """Class names by id."""
    return lookup(label, dict(enumerate(names)), "unknown")


def map_ids(label: Column, ids: Mapping[int, int]) -> Column:
    """Evaluation ids by label; unmapped labels become 0."""
    return lookup(label, ids, 0)
