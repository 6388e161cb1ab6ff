"""Captions and their point sets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointlake.functions.blocks import attach, block_of, ordinal
from pointlake.functions.text import drop_first, needs_summary, words_of
from pointlake.functions.vectors import dot, l2_normalise, mean_vector

IMAGE = ["scene_id", "frame"]
CHUNK_BITS = 16


def caption_points(captions: DataFrame, corr: DataFrame, on: Sequence[str] = IMAGE) -> DataFrame:
    """Captions with their points; captions without points and scenes without captions drop out."""
    return attach(corr, captions, on)


def captions_with_points(captions: DataFrame, corr: DataFrame, on: Sequence[str] = IMAGE) -> DataFrame:
    """Captions that have at least one point."""
    return captions.join(corr.select(*on).distinct(), list(on), "left_semi")


def captions_without_points(captions: DataFrame, corr: DataFrame, on: Sequence[str] = IMAGE) -> DataFrame:
    """The captions dropped by :func:`captions_with_points`."""
    return captions.join(corr.select(*on).distinct(), list(on), "left_anti")


def surviving_points(corr: DataFrame, points: DataFrame) -> DataFrame:
    """A caption's points after cropping or sampling, through ``origin_idx``; gives the new
    ``point_idx``."""
    kept = points.select("scene_id", "origin_idx", F.col("point_idx").alias("new_idx"))
    hit = corr.join(kept, (corr["scene_id"] == kept["scene_id"]) & (corr["point_idx"] == kept["origin_idx"]))
    return hit.select(corr["scene_id"], corr["frame"], F.col("new_idx").alias("point_idx"))


def frame_pair_counts(corr: DataFrame, min_size: int = 0) -> DataFrame:
    """Points shared by each pair of frames ``a < b`` of a scene (pairs that share none are
    absent).

    64 neighbouring points form a word in which each frame has one bit per point, so frames meet once per
    word and shared points are counted as common bits.  A hot scene is spread over its words.
    Frames of fewer than ``min_size`` points are left out."""
    rows = corr.select("scene_id", "frame", "point_idx")
    if min_size > 0:
        sizes = rows.groupBy(*IMAGE).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_size).drop("_n")
        rows = attach(rows, sizes, IMAGE)
    bit = F.expr("shiftleft(1L, CAST(point_idx & 63 AS INT))")
    words = rows.groupBy(*IMAGE, F.shiftright("point_idx", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    first = words.select("scene_id", "word", F.col("frame").alias("a"), F.col("bits").alias("bits_a"))
    later = words.select("scene_id", "word", F.col("frame").alias("b"), F.col("bits").alias("bits_b"))
    met = first.join(later, ["scene_id", "word"]).filter("a < b AND bits_a & bits_b <> 0")
    shared = F.sum(F.bit_count(F.col("bits_a").bitwiseAND(F.col("bits_b"))))
    return met.groupBy("scene_id", "a", "b").agg(shared.alias("n_both"))


def entities(captions: DataFrame, corr: DataFrame, min_points: int = 100, ratio: float = 0.3) -> DataFrame:
    """Parts of frame pairs that one phrase describes.

    For frames a < b: the shared points with the shared words, a's rest with a's own words and
    b's rest with b's own words; kept with more than ``min_points`` points, at least one word
    and a share of at most ``ratio`` (of the smaller frame, of a, of b).  ``ratio < 1`` makes pairs
    that share no point impossible, so counting shared points is exact.  Entities are numbered per
    scene in pair order.  Words are sorted; one ``room`` is dropped from each caption first."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    # a rest of more than min_points that is at most `ratio` of its frame leaves this many shared points
    floor = int(min(min_points, min_points * (1 - ratio) / ratio))
    sizes = corr.groupBy(*IMAGE).agg(F.count(F.lit(1)).alias("n"))
    info = captions.select(*IMAGE, F.array_distinct(drop_first(words_of(F.col("caption")), "room")).alias("w")).join(sizes, IMAGE)
    pairs = frame_pair_counts(corr, floor)
    for s in "ab":
        pairs = pairs.join(info.select("scene_id", F.col("frame").alias(s), F.col("w").alias(f"w{s}"), F.col("n").alias(f"n{s}")), ["scene_id", s])

    def part(kind: int, n: Column, words: Column, of: Column):
        return F.struct(F.lit(kind).alias("kind"), n.cast("bigint").alias("n_points"), F.sort_array(words).alias("words"),
                        (n / of.cast("double")).alias("share"))

    both = F.col("n_both")
    parts = F.array(part(0, both, F.array_intersect("wa", "wb"), F.least("na", "nb")),
                    part(1, F.col("na") - both, F.array_except("wa", "wb"), F.col("na")),
                    part(2, F.col("nb") - both, F.array_except("wb", "wa"), F.col("nb")))
    ok = F.filter(parts, lambda p: (p["n_points"] > min_points) & (F.size(p["words"]) > 0) & (p["share"] <= ratio))
    found = pairs.select("scene_id", "a", "b", F.explode(ok).alias("p"))
    found = found.select("scene_id", "a", "b", F.col("p.kind").alias("kind"), F.col("p.n_points").alias("n_points"),
                         F.array_join("p.words", " ").alias("caption"))
    return ordinal(found, ["scene_id"], ["a", "b", "kind"], "entity", F.col("a"), store=True)


def entity_points(found: DataFrame, corr: DataFrame) -> DataFrame:
    """The points of each entity, formed only for the pairs that were kept."""
    rows = corr.select("scene_id", "frame", "point_idx")
    ent = found.select("scene_id", "entity", "a", "b", "kind")
    # side to read, and the other frame whose points must be present (kind 0) or absent
    ent = ent.select("scene_id", "entity", "kind", F.when(F.col("kind") == 2, F.col("b")).otherwise(F.col("a")).alias("frame"),
                     F.when(F.col("kind") == 2, F.col("a")).otherwise(F.col("b")).alias("other"))
    own = attach(rows, ent, IMAGE)
    other = rows.select("scene_id", F.col("frame").alias("other"), "point_idx", F.lit(True).alias("_hit"))
    own = own.join(other, ["scene_id", "other", "point_idx"], "left")
    return own.filter(F.coalesce("_hit", F.lit(False)) == (F.col("kind") == 0)).select("scene_id", "entity", "point_idx")


def compare_sets(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every key of two point sets, marked ``both``, ``left`` or ``right``."""
    a = left.select(*on).distinct().withColumn("_a", F.lit(True))
    b = right.select(*on).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "left").otherwise("right")
    return a.join(b, list(on), "full").select(*on, side.alias("side"))


def compare_words(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Words only in a, only in b, and in both."""
    return F.array_except(a, b), F.array_except(b, a), F.array_intersect(a, b)


def merge_captions(tables: Sequence[DataFrame], rank: str = "frame") -> DataFrame:
    """Captions of several producers in one numbering per scene: those of later tables follow
    those of earlier ones."""
    stacked = tables[0].withColumn("file_rank", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        stacked = stacked.unionByName(t.withColumn("file_rank", F.lit(i)))
    block = F.shiftleft(F.col("file_rank").cast("bigint"), 44) + F.shiftright(F.col(rank), 16)
    return ordinal(stacked, ["scene_id"], ["file_rank", rank], "image", block)


def merge_indexes(merged: DataFrame, indexes: Sequence[DataFrame], rank: str = "frame") -> DataFrame:
    """The points of the same producers' captions, in the numbering of :func:`merge_captions`."""
    stacked = None
    for i, index in enumerate(indexes):
        rows = index.select("scene_id", rank, "point_idx").withColumn("file_rank", F.lit(i))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    numbers = merged.select("scene_id", "file_rank", rank, "image")
    return attach(stacked, numbers, ["scene_id", "file_rank", rank]).select("scene_id", "image", "point_idx")


def scene_captions(captions: DataFrame, rank: str = "frame", bits: int = CHUNK_BITS) -> DataFrame:
    """view captions of a scene as one text joined by ``". "``, and whether it needs a summary.

    A scene of more than 65536 captions is written as several chunks, to be read in order."""
    chunk = block_of(F.col(rank), bits)
    parts = F.sort_array(F.collect_list(F.struct(rank, "caption")))
    rows = (captions.withColumn("chunk", chunk).groupBy("scene_id", "chunk")
            .agg(F.array_join(F.transform(parts, lambda s: s["caption"]), ". ").alias("text")))
    chunks = F.count(F.lit(1)).over(W.partitionBy("scene_id"))
    return rows.withColumn("needs_summary", needs_summary(F.col("text")) | (chunks > 1))


def caption_nouns(captions: DataFrame, lexicon: DataFrame, salts: int = 64) -> DataFrame:
    """words whose tag starts with ``NN``, in order, joined by a space; captions without nouns
    keep an empty text.

    Common words are frequent keys, so a word is looked up once per group of captions, not once
    per occurrence in one task."""
    tokens = captions.select(*IMAGE, F.posexplode(F.regexp_extract_all("caption", F.lit(r"[\p{L}\p{N}'-]+"), F.lit(0))).alias("pos", "word"))
    tokens = tokens.withColumn("_k", F.shiftleft(F.pmod(F.xxhash64(*IMAGE), F.lit(salts)), 16))
    nouns = lexicon.filter(F.col("tag").startswith("NN")).select("word").distinct()
    found = attach(tokens, nouns, ["word"], key="_k")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]), " ")
    named = found.groupBy(*IMAGE).agg(text.alias("nouns"))
    return captions.join(named, IMAGE, "left").withColumn("nouns", F.coalesce("nouns", F.lit("")))


def distinct_vectors(rows: DataFrame, vec: str) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors in lexicographic order with a dense id, and the id of every row.

    Distinct vectors are sorted into ranges of the whole vector, whose bounds Spark samples, and written with the
    number of their range; an id is the place in the range plus the sizes of the earlier ranges.  Vectors
    that share first components are spread like others, and only the counts of ranges meet in one task."""
    unique = rows.select(vec).distinct().repartitionByRange(vec).withColumn("_range", F.spark_partition_id().cast("bigint"))
    table = ordinal(unique, [], [vec], "distinct_id", F.col("_range"), store=True).drop("_range")
    salted = rows.withColumn("_k", F.shiftleft(F.pmod(F.xxhash64(*[c for c in rows.columns if c != vec]), F.lit(64)), 16))
    return table, attach(salted, table, [vec], key="_k").drop("_k")


def captions_per_scene(captions: DataFrame) -> DataFrame:
    """Number of captions, scenes and the average."""
    per = captions.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("n_captions"), F.count(F.lit(1)).alias("n_scenes"), F.avg("n").alias("per_scene"))


def pool_captions(captions: DataFrame, corr: DataFrame, feats: DataFrame, vec: str, dim: int) -> DataFrame:
    """Mean feature of each caption's surviving points, their number and a flag."""
    rows = corr.select(*IMAGE, "point_idx").join(feats.select("scene_id", "point_idx", vec), ["scene_id", "point_idx"])
    pooled = mean_vector(rows, IMAGE, vec, dim)
    out = captions.join(pooled, IMAGE, "left")
    return (out.withColumn("n_points", F.coalesce("n_rows", F.lit(0).cast("bigint"))).drop("n_rows")
            .withColumn("has_points", F.col("n_points") > 0))


def pool_scenes(feats: DataFrame, captions: DataFrame, vec: str, dim: int) -> DataFrame:
    """Mean feature of each scene that has a caption."""
    pooled = mean_vector(feats, ["scene_id"], vec, dim)
    return pooled.join(captions.select("scene_id").distinct(), "scene_id", "left_semi")


def caption_similarity(regions: DataFrame, captions: DataFrame, region_vec: str, caption_vec: str,
                       scale: float = 1.0) -> DataFrame:
    """C4: scaled cosine of each region with the distinct captions of its batch, and the position of
    its own caption among them.

    A batch is a fixed number of scenes; its caption list travels as one array per batch, so no
    region x caption rows are formed.  An id that comes with several vectors counts once, with the least."""
    one = captions.filter(F.col("caption_id").isNotNull()).groupBy("batch_id", F.col("caption_id").alias("id")).agg(F.min(caption_vec).alias("v"))
    caps = F.sort_array(F.collect_list(F.struct("id", l2_normalise(F.col("v")).alias("v"))))
    table = one.groupBy("batch_id").agg(caps.alias("caps")).withColumn("ids", F.transform("caps", lambda c: c["id"]))
    unit = regions.withColumn("_u", l2_normalise(F.col(region_vec))).join(table, "batch_id")
    sims = F.transform("caps", lambda c: dot(F.col("_u"), c["v"]) * scale)
    label = F.array_position(F.col("ids"), F.col("caption_id")) - 1
    return unit.withColumn("logits", sims).withColumn("label", label).drop("_u", "caps")


def caption_scores(regions: DataFrame, captions: DataFrame, key: Sequence[str], region_vec: str, caption_vec: str, scale: float = 1.0,
                   caption_block: int = 2048, region_block: int = 8192) -> DataFrame:
    """C4 for batches of any size: per region ``(key, label, own, lse, best, top)``, what losses and matching need of its row
    of ``caption_similarity``: the place of its caption among the batch's distinct ones (-1: not there, NULL: no
    caption), that caption's score, the log of the sum of all exponentials, and the first place of the highest score.

    Blocks of a batch's regions meet blocks of its captions; a meeting is one matrix product, of which each region
    keeps a maximum, a sum of exponentials and its own score, and these are merged over the blocks.  No row
    holds the scores of a batch.  ``key`` names a region; regions without a vector have no row."""
    key = list(key)
    one = captions.filter(F.col("caption_id").isNotNull() & F.col(caption_vec).isNotNull())
    one = one.groupBy("batch_id", "caption_id").agg(F.min(caption_vec).cast("array<double>").alias("_e"))
    spread = one.repartitionByRange("batch_id", "caption_id").withColumn("_range", F.spark_partition_id().cast("bigint"))
    placed = ordinal(spread, ["batch_id"], ["caption_id"], "_pos", F.col("_range"), store=True).drop("_range")
    rows = regions.filter(F.col(region_vec).isNotNull())
    sizes = placed.groupBy("batch_id").agg((F.floor(F.max("_pos") / caption_block)).cast("bigint").alias("_nc"))
    counts = rows.groupBy("batch_id").agg(F.floor(F.count(F.lit(1)) / region_block).cast("bigint").alias("_nr"))
    sizes = sizes.join(counts, "batch_id")
    zero = F.lit(0).cast("bigint")
    own = placed.select("batch_id", "caption_id", "_pos")
    left = (rows.select("batch_id", "caption_id", *[c for c in key if c != "batch_id"], F.col(region_vec).cast("array<double>").alias("_v"))
            .join(sizes, "batch_id").join(own, ["batch_id", "caption_id"], "left")
            .withColumn("_label", F.coalesce("_pos", F.when(F.col("caption_id").isNotNull(), F.lit(-1)))))
    left = left.select(*key, "_label", "_v", F.col("batch_id").alias("_b"), F.pmod(F.xxhash64(*key), F.col("_nr") + 1).alias("_r"), F.explode(F.sequence(zero, "_nc")).alias("_c"))
    right = (placed.join(sizes, "batch_id").withColumn("_c", F.floor(F.col("_pos") / caption_block).cast("bigint"))
             .select(F.col("batch_id").alias("_b"), "_pos", "_e", F.explode(F.sequence(zero, "_nr")).alias("_r"), "_c"))
    types = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    schema = ", ".join([*[f"{c} {types[c]}" for c in key], "_label bigint, _own double, _top double, _sum double, _best bigint"])

    def stack(t: pa.Table, c: str) -> np.ndarray:
        x = t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c: np.zeros(0) for c in ("_own", "_top", "_sum")} | {"_best": np.zeros(0, np.int64)}
        if not left.num_rows or not right.num_rows:
            left = left.slice(0, 0)
        else:
            right = right.sort_by("_pos")
            first = right.column("_pos")[0].as_py()
            x, w = stack(left, "_v"), stack(right, "_e").T * scale
            label = left.column("_label").to_pandas().fillna(-1).to_numpy(np.int64) - first
            parts = []
            for lo in range(0, len(x), 1024):
                s = x[lo:lo + 1024] @ w
                mine = label[lo:lo + 1024]
                here = (mine >= 0) & (mine < s.shape[1])
                top = s.max(1)
                parts.append((np.where(here, s[np.arange(len(s)), np.where(here, mine, 0)], np.nan), top, np.exp(s - top[:, None]).sum(1), first + s.round(9).argmax(1)))
            out = dict(zip(out, (np.concatenate(p) for p in zip(*parts))))
        res = left.select([*key, "_label"])
        for c, v in out.items():
            res = res.append_column(c, pa.array(v, from_pandas=True))
        return res

    met = left.groupBy("_b", "_r", "_c").cogroup(right.groupBy("_b", "_r", "_c")).applyInArrow(meet, schema)
    parts = F.sort_array(F.collect_list(F.struct("_top", "_sum")))  # one entry per block of captions
    best = F.max(F.struct(F.round("_top", 9).alias("s"), (-F.col("_best")).alias("neg")))
    merged = met.groupBy(*key).agg(F.max("_label").alias("label"), F.max("_own").alias("own"), F.max("_top").alias("top"), parts.alias("_parts"), best.alias("_first"))
    lse = F.col("top") + F.log(F.aggregate("_parts", F.lit(0.0), lambda a, p: a + p["_sum"] * F.exp(p["_top"] - F.col("top"))))
    return merged.select(*key, "label", "own", lse.alias("lse"), (-F.col("_first.neg")).alias("best"), "top")


def caption_loss(scores: DataFrame) -> DataFrame:
    """Mean cross-entropy of regions against the captions of their batch, over regions whose caption is there."""
    return scores.agg(F.avg(F.col("lse") - F.col("own")).alias("loss"))
