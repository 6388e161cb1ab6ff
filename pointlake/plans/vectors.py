"""Checked queries: vectors, zero-shot scores and calibration."""

import numpy as np
from pyspark.sql import functions as F

from pointlake.functions import vectors as V
from pointlake.operators import calibrate, captions
from pointlake.plans.fixtures import SPLIT
from pointlake.plans.metrics import CENTROID, with_centroid
from pointlake.plans.registry import query

E64 = "CAST(embedding AS DOUBLE[])"
PT = "scene_id bigint, point_idx bigint, "


@query("m7_norm_and_cosine", "vec_id bigint, n double, d double, c double",
       f"SELECT vec_id, sqrt(list_inner_product({E64}, {E64})) AS n, list_inner_product({E64}, centroid) AS d, list_cosine_similarity({E64}, centroid) AS c FROM embeddings e JOIN ({CENTROID}) k ON k.label = e.label")
def _(t):
    emb = t.base("embeddings")
    pairs = emb.join(V.mean_vector(emb, ["label"], "embedding", 64, "centroid").drop("n_rows"), "label")
    e, c = F.col("embedding"), F.col("centroid")
    return pairs.select("vec_id", V.norm(e).alias("n"), V.dot(e, c).alias("d"), V.cosine(e, c).alias("c"))


@query("m7_softmax_sigmoid", PT + "class_id bigint, p double, s double",
       "SELECT scene_id, point_idx, class_id, exp(logit)/sum(exp(logit)) OVER (PARTITION BY scene_id, point_idx) AS p, 1/(1 + exp(-logit)) AS s FROM logits", ("logits",))
def _(t):
    both = F.arrays_zip(V.softmax(F.col("logits")).alias("p"), F.transform("logits", V.sigmoid).alias("s"))
    return t.logits.select("scene_id", "point_idx", F.posexplode(both).alias("class_id", "z")).select(
        "scene_id", "point_idx", "class_id", F.col("z.p").alias("p"), F.col("z.s").alias("s"))


@query("m7_l2_normalise", "vec_id bigint, dim bigint, v double",
       f"SELECT vec_id, unnest(range(64)) AS dim, unnest(list_transform({E64}, lambda x: x*3/sqrt(9*list_inner_product({E64}, {E64})))) AS v FROM embeddings")
def _(t):
    tripled = F.transform("embedding", lambda x: x * 3)
    return t.base("embeddings").select("vec_id", F.posexplode(V.l2_normalise(tripled)).alias("dim", "v"))


@query("a3_group_pool", "label bigint, dim bigint, v double, n_rows bigint",
       f"SELECT label, i AS dim, avg(v) AS v, count(*) AS n_rows FROM (SELECT label, unnest(range(64)) AS i, unnest({E64}) AS v FROM embeddings) u GROUP BY label, i")
def _(t):
    out = V.mean_vector(t.base("embeddings"), ["label"], "embedding", 64)
    return out.select("label", "n_rows", F.posexplode("pooled").alias("dim", "v"))


@query("a4_scatter_mean", "scene_id bigint, pred_id bigint, class_id bigint, v double",
       "SELECT l.scene_id, q.pred_id, l.class_id, avg(l.logit) AS v FROM logits l JOIN pred_inst q ON q.scene_id = l.scene_id AND q.point_idx = l.point_idx GROUP BY l.scene_id, q.pred_id, l.class_id", ("logits", "pred_inst"))
def _(t):
    rows = t.pred_inst.join(t.logits.select("scene_id", "point_idx", "logits"), ["scene_id", "point_idx"])
    out = V.mean_vector(rows, ["scene_id", "pred_id"], "logits", 20)
    return out.select("scene_id", "pred_id", F.posexplode("pooled").alias("class_id", "v"))


SCORES = f"SELECT e.vec_id, c.label AS class_id, 100*list_inner_product({E64}, c.centroid)/sqrt(list_inner_product({E64}, {E64}))/sqrt(list_inner_product(c.centroid, c.centroid)) AS logit FROM embeddings e CROSS JOIN ({CENTROID}) c"


def class_matrix(t):
    """Class embedding of each label: the mean of its vectors, normalised.  The labels of the
    embeddings table are a vocabulary of ten classes; a larger one is refused."""
    emb = t.base("embeddings")
    means = V.mean_vector(emb, ["label"], "embedding", 64)
    rows = means.select("label", V.l2_normalise(F.col("pooled")).alias("v")).limit(201).collect()
    if len(rows) > 200:
        raise ValueError("a class vocabulary holds at most 200 classes")
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["label"])])


def zero_shot(t):
    return V.score_matrix(t.base("embeddings"), "embedding", class_matrix(t), True, 100.0)


@query("c0_class_embeddings", "label bigint, dim bigint, v double",
       f"SELECT label, unnest(range(64)) AS dim, unnest(list_transform(centroid, lambda x: x/sqrt(list_inner_product(centroid, centroid)))) AS v FROM ({CENTROID}) c")
def _(t):
    means = V.mean_vector(t.base("embeddings"), ["label"], "embedding", 64)
    return means.select("label", F.posexplode(V.l2_normalise(F.col("pooled"))).alias("dim", "v"))


@query("c1_zero_shot_scores", "vec_id bigint, class_id bigint, logit double", SCORES)
def _(t):
    return zero_shot(t).select("vec_id", F.posexplode("logits").alias("class_id", "logit"))


@query("t1_argmax_class", "vec_id bigint, pred bigint",
       f"SELECT vec_id, class_id AS pred FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, class_id) AS k FROM ({SCORES}) s) q WHERE k = 1")
def _(t):
    return zero_shot(t).select("vec_id", V.argmax(F.col("logits")).alias("pred"))


BIN = "((point_idx*37 + scene_id*11) % 41 - 20)/8e0"
NB = f"CASE WHEN class_id IN {SPLIT.base} THEN 'b' WHEN class_id IN {SPLIT.novel} THEN 'n' END"
CAL = f"""SELECT scene_id, point_idx, class_id, CASE WHEN side IS NULL THEN 0e0 ELSE p/sum(CASE WHEN side IS NULL THEN 0e0 ELSE p END) OVER (PARTITION BY scene_id, point_idx) END AS p FROM (
 SELECT *, exp(logit)/sum(exp(logit)) OVER (PARTITION BY scene_id, point_idx, side)*CASE WHEN side = 'b' THEN s ELSE 1 - s END AS p FROM (
 SELECT scene_id, point_idx, class_id, logit, {NB} AS side, 1/(1 + exp(-({BIN}))) AS s FROM logits) a) b"""


@query("c2_calibrate", PT + "class_id bigint, p double", CAL, ("logits",))
def _(t):
    p = calibrate.calibrate(F.col("logits"), F.expr(BIN), SPLIT)
    return t.logits.select("scene_id", "point_idx", F.posexplode(p).alias("class_id", "p"))


@query("c2_calibrated_class", PT + "pred bigint",
       f"SELECT scene_id, point_idx, class_id AS pred FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, point_idx ORDER BY round(p, 12) DESC, class_id) AS k FROM ({CAL}) c) q WHERE k = 1", ("logits",))
def _(t):
    return calibrate.calibrated_class(t.logits.drop("pred"), "logits", F.expr(BIN), SPLIT)


@query("c3_binary_decision", PT + "base boolean", f"SELECT scene_id, point_idx, 1/(1 + exp(-({BIN}))) > 4e-1 AS base FROM points", ("points",))
def _(t):
    return t.points.select("scene_id", "point_idx", calibrate.is_base(F.expr(BIN), 0.4).alias("base"))


VECS = f"SELECT vec_id, {E64} AS v FROM embeddings"


@query("a18_distinct_vectors", "vec_id bigint, distinct_id bigint",
       f"SELECT vec_id, dense_rank() OVER (ORDER BY v) - 1 AS distinct_id FROM ({VECS}) q")
def _(t):
    whole = F.col("embedding").cast("array<double>")
    return captions.distinct_vectors(t.base("embeddings").select("vec_id", whole.alias("v")), "v")[1]


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def count_letters(texts):
    """A deterministic stand-in for a text encoder: how often each letter occurs."""
    return np.array([[text.count(c) for c in LETTERS] for text in texts], dtype=np.float64).reshape(len(texts), len(LETTERS))


UNIT_LETTERS = f"""SELECT class_id, list_transform(n, lambda x: x/sqrt(list_inner_product(n, n))) AS v FROM (
 SELECT p_partkey AS class_id, list_transform(range(1, 27), lambda i: CAST(length(t) - length(replace(t, substr('{LETTERS}', i, 1), '')) AS DOUBLE)) AS n FROM (SELECT p_partkey, concat('a ', p_name, ' in a scene.') AS t FROM part) x) y"""


def part_classes(t):
    """Every part is a class: a vocabulary that grows with the data."""
    names = t.base("part").selectExpr("p_partkey AS class_id", "p_name AS name")
    return calibrate.class_table(t.spark, names, count_letters)


@query("c0_prompt_encoder", "class_id bigint, dim bigint, v double", f"SELECT class_id, unnest(range(26)) AS dim, unnest(v) AS v FROM ({UNIT_LETTERS}) c")
def _(t):
    return part_classes(t).select("class_id", F.posexplode("embedding").alias("dim", "v"))


@query("c1_any_vocabulary", "vec_id bigint, pred bigint, score double",
       f"""SELECT vec_id, class_id AS pred, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class_id) AS k FROM (
       SELECT e.vec_id, c.class_id, round(100*list_inner_product(e.v, c.v)/sqrt(list_inner_product(e.v, e.v)), 9) AS score FROM (SELECT vec_id, CAST(embedding[1:26] AS DOUBLE[]) AS v FROM embeddings) e CROSS JOIN ({UNIT_LETTERS}) c) s) q WHERE k = 1""")
def _(t):
    rows = t.base("embeddings").select("vec_id", F.slice("embedding", 1, 26).alias("v"))
    return V.best_class(rows, ["vec_id"], "v", part_classes(t), 100.0, class_block=128)
