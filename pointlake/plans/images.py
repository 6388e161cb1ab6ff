"""Checked queries: projection to images and captions."""

from pyspark.sql import functions as F

from pointlake.functions import hooks, text as TX
from pointlake.operators import captions as CP
from pointlake.operators import labels, metrics, projection as P
from pointlake.plans.registry import query

PT = "scene_id bigint, point_idx bigint, "
FR = "scene_id bigint, frame bigint, "
N_VECS = "(SELECT count(*) FROM embeddings)"


@query("j1_projection", FR + "point_idx bigint, u bigint, v bigint, d double",
       "SELECT scene_id, frame, point_idx, u, v, d FROM proj WHERE d >= 0 AND u >= 0 AND u < w AND v >= 0 AND v < h", ("proj",))
def _(t):
    return P.inside_image(t.camera_points)


BOXES = """SELECT scene_id, floor(x/5e-1) AS bx, floor(y/5e-1) AS by, floor(z/5e-1) AS bz, count(*) AS n, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, max(z) AS hz
 FROM pm GROUP BY scene_id, floor(x/5e-1), floor(y/5e-1), floor(z/5e-1)"""


@query("j1_culled_pairs", FR + "n_pairs bigint", f"""SELECT b.scene_id, f.frame, sum(n) AS n_pairs FROM ({BOXES}) b JOIN frames f ON f.scene_id = b.scene_id
 WHERE 30*(hx - tx_mm/1e3) + 175e-1*(hz + 2) > -1e-9 AND -30*(lx - tx_mm/1e3) + 155e-1*(hz + 2) > -1e-9 AND 30*(hy - 5e-1) + 135e-1*(hz + 2) > -1e-9 AND -30*(ly - 5e-1) + 115e-1*(hz + 2) > -1e-9
 GROUP BY b.scene_id, f.frame""", ("pm", "frames"))
def _(t):
    """How many points meet each frame after boxes were culled."""
    pairs = P.visible_pairs(t.points_m.select("scene_id", "point_idx", *"xyz"), t.posed_frames, 0.5)
    return pairs.groupBy("scene_id", "frame").agg(F.count("*").alias("n_pairs"))


@query("j1_camera_to_world_pose", FR + "point_idx bigint, xc double, yc double, d double",
       """SELECT p.scene_id, f.frame, p.point_idx, cos(frame/3e0)*(x - frame) + sin(frame/3e0)*(y - 5e-1) AS xc, -sin(frame/3e0)*(x - frame) + cos(frame/3e0)*(y - 5e-1) AS yc, z + 2 AS d
       FROM pm p JOIN frames f ON f.scene_id = p.scene_id""", ("pm", "frames"))
def _(t):
    c, s = F.cos(F.col("frame") / 3.0), F.sin(F.col("frame") / 3.0)
    zero, one = F.lit(0.0), F.lit(1.0)
    to_world = F.array(c, -s, zero, F.col("frame").cast("double"), s, c, zero, F.lit(0.5), zero, zero, one, F.lit(-2.0), zero, zero, zero, one)
    frames = t.frames.select("scene_id", "frame", P.invert_rigid(to_world).alias("pose"))
    return P.world_to_camera(P.pair_with_frames(t.points_m.select("scene_id", "point_idx", *"xyz"), frames))


@query("j2_depth_consistent", FR + "point_idx bigint, flat bigint, u bigint, v bigint",
       "SELECT scene_id, frame, point_idx, v*32 + u AS flat, u, v FROM corr", ("corr",))
def _(t):
    out = P.depth_consistent(P.inside_image(t.camera_points), t.depth)
    u, v = P.unflatten(F.col("flat"), F.col("w"))
    return out.select("scene_id", "frame", "point_idx", "flat", u.alias("u"), v.alias("v"))


@query("j2_tiled_depth", FR + "point_idx bigint, flat bigint", "SELECT scene_id, frame, point_idx, v*32 + u AS flat FROM corr", ("corr",))
def _(t):
    tiles = P.depth_tiles(t.depth_images, 10)  # the last tiles of an image are smaller
    return P.depth_consistent_tiled(P.inside_image(t.camera_points), tiles, 10)


@query("j3_rescale_intrinsics", FR + "fx double, fy double, cx double, cy double",
       "SELECT scene_id, frame, fx/(479e0/(h - 1)) AS fx, fy/(479e0/(h - 1)) AS fy, cx/(479e0/(h - 1)) AS cx, cy/(479e0/(h - 1)) AS cy FROM frames", ("frames",))
def _(t):
    return P.rescale_intrinsics(t.frames)


@query("j5_caption_points", FR + "point_idx bigint, caption string",
       "SELECT c.scene_id, c.frame, c.point_idx, k.caption FROM corr c JOIN captions k ON k.scene_id = c.scene_id AND k.frame = c.frame", ("corr", "captions"))
def _(t):
    return CP.caption_points(t.captions, t.corr)




@query("j6_captions_with_points", FR + "has_points boolean",
       "SELECT k.scene_id, k.frame, EXISTS (SELECT 1 FROM corr c WHERE c.scene_id = k.scene_id AND c.frame = k.frame) AS has_points FROM captions k", ("corr", "captions"))
def _(t):
    edge = t.corr_index
    a = CP.captions_with_points(t.captions, edge).withColumn("has_points", F.lit(True))
    return a.unionByName(CP.captions_without_points(t.captions, edge).withColumn("has_points", F.lit(False)))


@query("j7_surviving_points", FR + "point_idx bigint",
       "SELECT c.scene_id, c.frame, p.point_idx*2 + 1 AS point_idx FROM corr c JOIN points p ON p.scene_id = c.scene_id AND p.point_idx = c.point_idx WHERE p.x_mm >= 1000", ("corr", "points"))
def _(t):
    kept = t.points.filter("x_mm >= 1000").selectExpr("scene_id", "point_idx AS origin_idx", "point_idx*2 + 1 AS point_idx")
    return CP.surviving_points(t.corr, kept)


PAIRS = "SELECT p.scene_id, p.frame AS a, q.frame AS b, count(*) AS n_both FROM corr p JOIN corr q ON q.scene_id = p.scene_id AND q.point_idx = p.point_idx AND p.frame < q.frame GROUP BY p.scene_id, p.frame, q.frame"


@query("j8_frame_pairs", "scene_id bigint, a bigint, b bigint, n_both bigint", PAIRS, ("corr",))
def _(t):
    return CP.frame_pair_counts(t.corr)


@query("u2_compare_point_sets", "scene_id bigint, side string, n bigint",
       """SELECT scene_id, side, count(*) AS n FROM (SELECT coalesce(a.scene_id, b.scene_id) AS scene_id, CASE WHEN b.point_idx IS NULL THEN 'left' WHEN a.point_idx IS NULL THEN 'right' ELSE 'both' END AS side
       FROM (SELECT DISTINCT scene_id, point_idx FROM corr) a FULL JOIN pred_inst b ON b.scene_id = a.scene_id AND b.point_idx = a.point_idx) u GROUP BY scene_id, side""", ("corr", "pred_inst"))
def _(t):
    return CP.compare_sets(t.corr, t.pred_inst, ["scene_id", "point_idx"]).groupBy("scene_id", "side").agg(F.count("*").alias("n"))


W = "list_distinct(string_split({c}, ' '))"


def minus(a, b):
    return f"list_sort(list_filter({a}, lambda x: NOT list_contains({b}, x)))"


@query("u2_compare_words", FR + "only_a string, only_b string, shared string",
       f"""SELECT scene_id, frame, array_to_string({minus('wa', 'wb')}, ' ') AS only_a, array_to_string({minus('wb', 'wa')}, ' ') AS only_b, array_to_string(list_sort(list_intersect(wa, wb)), ' ') AS shared FROM (
       SELECT a.scene_id, a.frame, {W.format(c='a.caption')} AS wa, {W.format(c='b.caption')} AS wb FROM captions a JOIN captions b ON b.scene_id = a.scene_id AND b.frame = a.frame + 1) q""", ("captions",))
def _(t):
    nxt = t.captions.selectExpr("scene_id", "frame - 1 AS frame", "caption AS next")
    a, b = (F.array_distinct(TX.words_of(F.col(c))) for c in ("caption", "next"))
    parts = CP.compare_words(a, b)
    return t.captions.join(nxt, ["scene_id", "frame"]).select(
        "scene_id", "frame", *[F.array_join(F.sort_array(p), " ").alias(n) for p, n in zip(parts, ("only_a", "only_b", "shared"))])


MIN, RATIO = 20, 0.3
ENTITIES = f"""SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY a, b, kind) - 1 AS entity, array_to_string(words, ' ') AS caption FROM (
 SELECT scene_id, a, b, 0 AS kind, n_both AS n_points, list_sort(list_intersect(wa, wb)) AS words, n_both/CAST(least(na, nb) AS DOUBLE) AS share FROM ep
 UNION ALL SELECT scene_id, a, b, 1, na - n_both, {minus('wa', 'wb')}, (na - n_both)/CAST(na AS DOUBLE) FROM ep
 UNION ALL SELECT scene_id, a, b, 2, nb - n_both, {minus('wb', 'wa')}, (nb - n_both)/CAST(nb AS DOUBLE) FROM ep) k WHERE n_points > {MIN} AND len(words) > 0 AND share <= {RATIO}e0"""
INFO = f"SELECT c.scene_id, c.frame, {W.format(c='c.caption')} AS w, s.n FROM captions c JOIN (SELECT scene_id, frame, count(*) AS n FROM corr GROUP BY scene_id, frame) s ON s.scene_id = c.scene_id AND s.frame = c.frame"
EP = f"WITH info AS ({INFO}), ep AS (SELECT p.*, i.w AS wa, j.w AS wb, i.n AS na, j.n AS nb FROM ({PAIRS}) p JOIN info i ON i.scene_id = p.scene_id AND i.frame = p.a JOIN info j ON j.scene_id = p.scene_id AND j.frame = p.b) "


def found_entities(t):
    with_room = t.captions.withColumn("caption", F.concat(F.lit("room "), "caption"))
    return CP.entities(with_room, t.corr_index, MIN, RATIO)


@query("u3_entities", "scene_id bigint, a bigint, b bigint, kind bigint, n_points bigint, entity bigint, caption string",
       EP + ENTITIES, ("corr", "captions"))
def _(t):
    return found_entities(t)


@query("u3_entity_points", "scene_id bigint, entity bigint, point_idx bigint",
       EP + f""", en AS ({ENTITIES}) SELECT e.scene_id, e.entity, c.point_idx FROM en e JOIN corr c ON c.scene_id = e.scene_id AND c.frame = CASE WHEN kind = 2 THEN b ELSE a END
       WHERE EXISTS (SELECT 1 FROM corr o WHERE o.scene_id = e.scene_id AND o.point_idx = c.point_idx AND o.frame = CASE WHEN kind = 2 THEN a ELSE b END) = (kind = 0)""", ("corr", "captions"))
def _(t):
    return CP.entity_points(found_entities(t), t.corr_index)


@query("w6_merge_captions", "scene_id bigint, image bigint, caption string",
       "SELECT conv_id AS scene_id, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END, turn) - 1 AS image, text AS caption FROM conversations")
def _(t):
    turns = t.base("conversations").selectExpr("conv_id AS scene_id", "turn AS frame", "text AS caption", "role")
    who = F.col("role")
    parts = [turns.filter(c).drop("role") for c in (who == "user", who == "assistant", ~who.isin("user", "assistant"))]
    return CP.merge_captions(parts)


@query("u4_merge_producers", "scene_id bigint, image bigint, caption string",
       "SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY k, frame) - 1 AS image, caption FROM (SELECT 0 AS k, scene_id, frame, caption FROM captions UNION ALL SELECT 1, scene_id, 5 - frame, concat('again ', caption) FROM captions) u", ("captions",))
def _(t):
    again = t.captions.selectExpr("scene_id", "5 - frame AS frame", "concat('again ', caption) AS caption")
    return CP.merge_captions([t.captions, again])


@query("w6_merge_indexes", "scene_id bigint, image bigint, point_idx bigint",
       """SELECT c.scene_id, image, point_idx FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY k, frame) - 1 AS image FROM (SELECT 0 AS k, scene_id, frame FROM captions UNION ALL SELECT 1, scene_id, 5 - frame FROM captions) u) n
       JOIN (SELECT 0 AS k, scene_id, frame, point_idx FROM corr UNION ALL SELECT 1, scene_id, 5 - frame, point_idx FROM corr) c ON c.k = n.k AND c.scene_id = n.scene_id AND c.frame = n.frame""", ("captions", "corr"))
def _(t):
    again = t.captions.selectExpr("scene_id", "5 - frame AS frame", "caption")
    return CP.merge_indexes(CP.merge_captions([t.captions, again]), [t.corr_index, t.corr_index.withColumn("frame", 5 - F.col("frame"))])


@query("f1_scene_captions", "scene_id bigint, text string, needs_summary boolean",
       "SELECT scene_id, text, len(string_split(text, ' ')) > 75 AS needs_summary FROM (SELECT scene_id, string_agg(caption, '. ' ORDER BY frame) AS text FROM captions GROUP BY scene_id) s", ("captions",))
def _(t):
    return CP.scene_captions(t.captions)


@query("f1_long_documents", "doc_id bigint, n_words bigint, needs_summary boolean",
       "SELECT doc_id, len(string_split(text, ' ')) AS n_words, len(string_split(text, ' ')) > 75 AS needs_summary FROM documents")
def _(t):
    x = F.col("text")
    return t.base("documents").select("doc_id", TX.word_count(x).alias("n_words"), TX.needs_summary(x).alias("needs_summary"))


@query("f2_caption_nouns", FR + "nouns string",
       """SELECT k.scene_id, k.frame, coalesce(string_agg(t.w, ' ' ORDER BY t.i), '') AS nouns FROM captions k LEFT JOIN (SELECT scene_id, frame, unnest(string_split(caption, ' ')) AS w, unnest(range(4)) AS i FROM captions) t
       ON t.scene_id = k.scene_id AND t.frame = k.frame AND t.w IN (SELECT string_split(p_name, ' ')[2] FROM part) GROUP BY k.scene_id, k.frame""", ("captions",))
def _(t):
    pair = F.split("p_name", " ")
    words = F.array(F.struct(pair[0].alias("word"), F.lit("JJ").alias("tag")), F.struct(pair[1].alias("word"), F.lit("NNS").alias("tag")))
    lexicon = t.base("part").select(F.explode(words).alias("w")).select("w.word", "w.tag").distinct()
    return CP.caption_nouns(t.captions, lexicon)


@query("f3_drop_room", FR + "caption string", "SELECT scene_id, frame, concat(caption, ' room') AS caption FROM captions", ("captions",))
def _(t):
    twice = TX.words_of(F.concat(F.lit("room "), "caption", F.lit(" room")))
    return t.captions.withColumn("caption", F.array_join(TX.drop_first(twice, "room"), " "))


@query("f4_prompts", "p_partkey bigint, lseg string, simple string",
       "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Wall' ELSE concat('a ', p_name, ' in a scene') END AS lseg, concat('a photo of a ', p_name, '.') AS simple FROM part")
def _(t):
    name = F.when(F.col("p_size") % 2 == 0, F.lit("Wall")).otherwise(F.col("p_name"))
    return t.base("part").select("p_partkey", TX.prompt(name, "lseg").alias("lseg"), TX.prompt(F.col("p_name"), "simple").alias("simple"))


@query("f5_parse_names", "scene_id bigint, area bigint, room string, stem string",
       "SELECT DISTINCT scene_id, scene_id % 6 + 1 AS area, concat('office_', scene_id) AS room, concat('scene', scene_id, '_00') AS stem FROM points", ("points",))
def _(t):
    name = F.concat(F.lit("Area_"), F.col("scene_id") % 6 + 1, F.lit("_office_"), F.col("scene_id"))
    path = F.concat(F.lit("/data/train/scene"), F.col("scene_id"), F.lit("_00.pth"))
    return t.scenes.select("scene_id", TX.area_of(name).alias("area"), TX.room_of(name).alias("room"), TX.file_stem(path).alias("stem"))


@query("f6_image_keys", "n_nationkey bigint, image string", "SELECT n_nationkey, lower(n_name) AS image FROM nation")
def _(t):
    return t.base("nation").select("n_nationkey", TX.image_key(F.col("n_name")).alias("image"))


@query("f7_names_of_runs", "event_id bigint, epoch bigint, best_metric double, best_epoch bigint",
       "SELECT event_id, event_id % 100 AS epoch, round(value, 2) AS best_metric, event_id AS best_epoch FROM events")
def _(t):
    ckpt = F.concat(F.lit("checkpoint_epoch_"), F.col("event_id") % 100, F.lit(".pth"))
    metric, epoch = TX.best_of_name(F.concat(F.lit("runs/best_miou_"), F.format_string("%.2f", F.round("value", 2)), F.lit("_epoch_"), F.col("event_id"), F.lit(".txt")))
    return t.base("events").select("event_id", TX.epoch_of(ckpt).alias("epoch"), metric.alias("best_metric"), epoch.alias("best_epoch"))


def count_encoder(texts):
    """A stand-in encoder: characters and words."""
    return [[len(x), len(x.split(" "))] for x in texts]


@query("f8_encoder_hook", "doc_id bigint, chars double, words double",
       "SELECT doc_id, CAST(length(text) AS DOUBLE) AS chars, CAST(len(string_split(text, ' ')) AS DOUBLE) AS words FROM documents")
def _(t):
    out = hooks.encode_texts(t.base("documents").select("doc_id", "text"), "text", count_encoder)
    return out.select("doc_id", F.col("embedding")[0].alias("chars"), F.col("embedding")[1].alias("words"))


@query("f8_captioner_hook", FR + "caption string", "SELECT scene_id, frame, upper(caption) AS caption FROM captions", ("captions",))
def _(t):
    def shout(pdf):
        return pdf.assign(caption=pdf["caption"].str.upper())
    return hooks.map_batches(t.captions, shout, "scene_id bigint, frame bigint, caption string")


@query("f9_step_list", PT + "label bigint, x double",
       f"SELECT scene_id, point_idx, sem_label AS label, x - avg(x) OVER (PARTITION BY scene_id) AS x FROM pm WHERE x BETWEEN 5e-1 AND 25e-1 AND y BETWEEN 0e0 AND 2e0", ("pm",))
def _(t):
    from pointlake.operators.coords import centre_scene
    registry = {"range": lambda box: (lambda df: labels.within_xy(df, box)), "centre": lambda: centre_scene}
    steps = hooks.configured_steps(registry, [{"name": "range", "box": (0.5, 0.0, 0.0, 2.5, 2.0, 9.0)}, {"name": "centre"}])
    return hooks.run_steps(t.points_m, steps).withColumn("label", F.col("sem_label"))


@query("a19_captions_per_scene", "n_captions bigint, n_scenes bigint, per_scene double",
       "SELECT count(*) AS n_captions, count(DISTINCT scene_id) AS n_scenes, count(*)/CAST(count(DISTINCT scene_id) AS DOUBLE) AS per_scene FROM captions", ("captions",))
def _(t):
    return CP.captions_per_scene(t.captions)


POOL = """SELECT scene_id, frame, i AS dim, avg(v) AS v, count(*) AS n_points FROM (SELECT c.scene_id, c.frame, unnest(range(64)) AS i, unnest(CAST(f.embedding AS DOUBLE[])) AS v
 FROM corr c JOIN feats f ON f.scene_id = c.scene_id AND f.point_idx = c.point_idx) u GROUP BY scene_id, frame, i"""


@query("a20_caption_pool", FR + "dim bigint, v double, n_points bigint, has_points boolean",
       f"SELECT *, true AS has_points FROM ({POOL}) p", ("corr", "feats"))
def _(t):
    out = CP.pool_captions(t.captions, t.corr, t.feats, "embedding", 64)
    return out.select("scene_id", "frame", "n_points", "has_points", F.posexplode("pooled").alias("dim", "v"))


@query("a21_scene_pool", "scene_id bigint, dim bigint, v double",
       "SELECT scene_id, i AS dim, avg(v) AS v FROM (SELECT scene_id, unnest(range(64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM feats) u GROUP BY scene_id, i", ("feats",))
def _(t):
    out = CP.pool_scenes(t.feats, t.captions, "embedding", 64)
    return out.select("scene_id", F.posexplode("pooled").alias("dim", "v"))


SIM = f"""WITH reg AS (SELECT scene_id, frame, list(v ORDER BY dim) AS r FROM ({POOL}) p GROUP BY scene_id, frame),
 cap AS (SELECT f.scene_id, f.frame, f.scene_id // 4 AS batch_id, e.vec_id AS caption_id, CAST(e.embedding AS DOUBLE[]) AS c FROM frames f JOIN embeddings e ON e.vec_id = (f.scene_id*6 + f.frame) % {N_VECS}),
 ids AS (SELECT DISTINCT batch_id, caption_id, c FROM cap),
 sim AS (SELECT r.scene_id, r.frame, k.caption_id AS mine, i.caption_id, 10*list_cosine_similarity(r.r, i.c) AS s, dense_rank() OVER (PARTITION BY r.scene_id, r.frame ORDER BY i.caption_id) - 1 AS pos
   FROM reg r JOIN cap k ON k.scene_id = r.scene_id AND k.frame = r.frame JOIN ids i ON i.batch_id = k.batch_id),
 res AS (SELECT scene_id, frame, max(CASE WHEN mine = caption_id THEN pos END) AS label, max(CASE WHEN mine = caption_id THEN s END) AS own, ln(sum(exp(s))) AS lse FROM sim GROUP BY scene_id, frame)"""
SIM_USES = ("corr", "feats", "frames")


def region_inputs(t):
    emb = t.base("embeddings").select(F.col("vec_id").alias("caption_id"), F.col("embedding").alias("text_vec"))
    n = t.base("embeddings").agg(F.count(F.lit(1))).scalar()
    caps = t.frames.select("scene_id", "frame", n.alias("n_vecs")).selectExpr(
        "scene_id", "frame", "scene_id div 4 AS batch_id", "(scene_id*6 + frame) % n_vecs AS caption_id").join(emb, "caption_id")
    regions = CP.pool_captions(caps.drop("text_vec"), t.corr, t.feats, "embedding", 64).filter("has_points")
    return regions, caps, "pooled", "text_vec", 10.0


@query("c4_region_similarity", FR + "label bigint, own double, lse double", f"{SIM} SELECT * FROM res", SIM_USES)
def _(t):
    regions, caps, *how = region_inputs(t)
    return CP.caption_scores(regions, caps, CP.IMAGE, *how).select("scene_id", "frame", "label", "own", "lse")


@query("c4_region_logits", FR + "label bigint, own double, lse double", f"{SIM} SELECT * FROM res", SIM_USES)
def _(t):
    return CP.caption_similarity(*region_inputs(t)).select(
        "scene_id", "frame", "label", F.get("logits", F.col("label").cast("int")).alias("own"), metrics.log_sum_exp(F.col("logits")).alias("lse"))


@query("c4_best_caption", FR + "best bigint, top double",
       f"{SIM} SELECT scene_id, frame, arg_min(pos, (-round(s, 9), pos)) AS best, max(s) AS top FROM sim GROUP BY scene_id, frame", SIM_USES)
def _(t):
    regions, caps, *how = region_inputs(t)
    return CP.caption_scores(regions, caps, CP.IMAGE, *how, caption_block=4, region_block=2).select("scene_id", "frame", "best", "top")


@query("a17_caption_loss", "loss double", f"{SIM} SELECT avg(lse - own) AS loss FROM res", SIM_USES)
def _(t):
    regions, caps, *how = region_inputs(t)
    return CP.caption_loss(CP.caption_scores(regions, caps, CP.IMAGE, *how))
