"""Whole jobs: what a user runs, as compositions of the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointlake.functions.hooks import Step, run_steps
from pointlake.functions.vectors import softmax
from pointlake.operators import captions as CP
from pointlake.operators import components, coords, instance_ap, instances, labels, metrics, overlap, projection
from pointlake.operators import proposals as PR
from pointlake.operators import voxel as V
from pointlake.schema import ClassSplit
from pointlake.session import cut_lineage
from pointlake.sources import writers


def evaluate_semantic(preds: DataFrame, split: ClassSplit, train_only: Sequence[int] = ()) -> dict[str, DataFrame]:
    """Semantic evaluation of ``preds(scene_id, point_idx, gt, pred)``: the points are read once into
    class areas; the four reports come from those few rows."""
    areas = cut_lineage(metrics.class_areas(preds, split.n_classes))
    classes = metrics.semantic_class_metrics(areas)
    return {"classes": classes, "summary": metrics.semantic_summary(areas),
            "iou": metrics.open_vocab(classes, split, "iou", train_only),
            "acc": metrics.open_vocab(classes, split, "acc", train_only)}


def evaluate_instances(mask: DataFrame, meta: DataFrame, codes: DataFrame, split: ClassSplit,
                       min_points: int = 100) -> dict[str, DataFrame]:
    """Instance evaluation: AP per class and threshold, its averages and the base/novel report."""
    valid = [c + 1 for c in split.valid]
    preds, gts, pairs = overlap.evaluation_pairs(mask, meta, codes, valid, min_points)
    ap = cut_lineage(instance_ap.average_precision(preds, gts, pairs, valid, min_points))
    classes = instance_ap.class_averages(ap)
    return {"ap": ap, "classes": classes, "overall": instance_ap.overall_averages(ap),
            "open_vocab": instance_ap.open_vocab_ap(classes, split)}


def instances_from_proposals(proposals: DataFrame, masks: DataFrame, semantic: DataFrame, codes: DataFrame, split: ClassSplit,
                             stuff: Sequence[int] = (), min_points: int = 100, path: str | None = None, **options) -> dict[str, DataFrame]:
    """From scored proposals to instance AP: predicted instances, whose classes share masks, their overlaps
    with the ground truth (``codes``, counted once per mask), and the reports of ``evaluate_instances``.

    ``proposals`` and ``masks`` as in ``predicted_instances``, which also takes ``options``.  With a ``path`` the manifest,
    the masks and the mask files are written there."""
    meta, mask = PR.predicted_instances(proposals, masks, semantic, split.valid, stuff, min_points=min_points, **options)
    meta, mask = cut_lineage(meta), cut_lineage(mask)
    if path is not None:
        writers.write_pred_instances(meta, mask, path)
        writers.write_mask_files(meta, mask, codes, path)
    return {"meta": meta, "mask": mask} | evaluate_instances(mask, meta, codes, split, min_points)


def group_instances(points: DataFrame, n_classes: int, radius: float, min_size: Column | int, score: float = 0.2,
                    ignored: Sequence[int] = (), min_points: int = 100, probs: str | None = None,
                    label_shift: int = 0) -> tuple[DataFrame, DataFrame]:
    """Points with ``logits`` and ``pred_off_x..z`` to proposals: candidates per class, shifted to their
    centres, clustered, numbered.  Returns ``members`` and mean class scores per proposal."""
    rows = points if probs else points.withColumn("probs", softmax(F.col("logits")))
    cand = PR.class_candidates(rows, probs or "probs", score, ignored, min_points)
    moved = PR.shift_by_offset(cand).select("scene_id", "class_id", "point_idx", "x", "y", "z")
    members = PR.number_proposals(components.cluster_points(cut_lineage(moved), radius, min_size))
    members = cut_lineage(members.select("scene_id", "proposal_id", "class_id", "point_idx", "size"))
    return members, PR.proposal_scores(members, points, n_classes, label_shift)


def index_captions(points: DataFrame, frames: DataFrame, depth: DataFrame, path: str, level: str = "view",
                   image: str = "image") -> None:
    """Which points each image shows, written as the correspondence index.  ``frames`` hold world ->
    camera poses, intrinsics and image sizes; ``depth`` is in metres: a row per pixel, or per image with an array
    (``h``, ``w`` and ``depth``), which is cheaper."""
    bias = ("bx", "by") if {"bx", "by"} <= set(frames.columns) else None
    cam = projection.world_to_camera(projection.visible_pairs(points.select("scene_id", "point_idx", "x", "y", "z"), frames, bias=bias))
    pixels, key = projection.inside_image(projection.to_pixels(cam, bias)), ("scene_id", image)
    if isinstance(depth.schema["depth"].dataType, T.ArrayType):
        seen = projection.depth_consistent_tiled(pixels, projection.depth_tiles(depth, image=key), image=key)
    else:
        seen = projection.depth_consistent(pixels, depth, image=key)
    corr = seen.select(F.lit(level).alias("level"), "scene_id", F.col(image).alias("image"), "point_idx", "flat")
    writers.write_correspondence(corr, path)


def entity_captions(captions: DataFrame, corr: DataFrame, lexicon: DataFrame, min_points: int = 100,
                    ratio: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Noun phrases shared or kept apart by pairs of views, and their points."""
    nouns = CP.caption_nouns(captions, lexicon).select("scene_id", "frame", F.col("nouns").alias("caption"))
    found = cut_lineage(CP.entities(nouns, corr, min_points, ratio))
    return found, CP.entity_points(found, corr)


def clean_captions(captions: DataFrame, corr: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captions without points and points without caption are dropped."""
    keys = captions.select("scene_id", "frame").distinct()
    return CP.captions_with_points(captions, corr), corr.join(keys, ["scene_id", "frame"], "left_semi")


def training_points(points: DataFrame, split: ClassSplit, steps: Sequence[Step] = (), voxel_scale: float = 50.0,
                    features: Mapping[str, bool] | None = None) -> tuple[DataFrame, DataFrame]:
    """Training input: base labels, hidden novel instances, augmentation ``steps``, instance centres, and
    the voxel table.  Scenes left without instances are dropped.

    A step with statistics reads its input twice, so a chain of steps would read the points more often with
    each step; the points are written after the augmentation and after the relabelling instead."""
    use = {"use_rgb": True, "use_xyz": True} | dict(features or {})
    rows = labels.hide_novel_instances(labels.apply_label_mode(points, split, "base"))
    rows = cut_lineage(run_steps(rows, steps)) if steps else rows
    rows = cut_lineage(labels.drop_scenes_without_instances(labels.densify_instances(rows, F.col("inst_label") >= 0)))
    rows = instances.centre_offsets(rows)
    rows = coords.to_voxel_scale(rows, voxel_scale).withColumn("feats", coords.point_features(**use))
    rows = cut_lineage(V.with_cells(rows, 1.0, ("sx", "sy", "sz")))
    vox = V.voxel_table(rows)
    return V.point_voxels(rows, vox), vox
