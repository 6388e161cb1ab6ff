"""Checked queries: sampling and augmentation."""

import math

from pyspark.sql import functions as F

from pointlake.operators import augment as G
from pointlake.operators import sampling as S
from pointlake.plans.draws import draw, normal, uniform
from pointlake.plans.registry import query

PT = "scene_id bigint, point_idx bigint, "
XYZ = "x double, y double, z double"
PI2 = f"{2 * math.pi}e0"
PI = f"{math.pi}e0"


def pick(source, k, seed=7, by="scene_id", key="frame", keep="*"):
    return f"SELECT {keep} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {draw(seed, *by.split(', '), key)}, {key}) AS pos, count(*) OVER (PARTITION BY {by}) AS n FROM ({source}) s) q WHERE pos <= {k}"


FRAMES = "SELECT scene_id, frame FROM frames"
POLICIES = {
    "fixed": dict(select="fixed", num=2), "ratio": dict(select="ratio", ratio=0.5),
    "hybrid": dict(select="hybrid", num=1, ratio=0.7), "all": dict(select="all"),
}
TAKE = {"fixed": "least(2, n)", "ratio": "greatest(1, CAST(floor(n*5e-1) AS BIGINT))",
        "hybrid": "least(greatest(1, 1, CAST(floor(n*7e-1) AS BIGINT)), n)", "all": "n"}


@query("t7_select_captions", "policy string, scene_id bigint, frame bigint",
       " UNION ALL ".join(f"SELECT '{p}' AS policy, scene_id, frame FROM ({pick(FRAMES, TAKE[p])}) x" for p in POLICIES), ("frames",))
def _(t):
    parts = [S.select_captions(t.frames, 7, **kw).select(F.lit(p).alias("policy"), "scene_id", "frame") for p, kw in POLICIES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


STRIDED = f"SELECT scene_id, frame FROM frames WHERE frame >= {draw(108, 'scene_id')} % 2 AND (frame - {draw(108, 'scene_id')} % 2) % 2 = 0"


@query("t7_strided_captions", "scene_id bigint, frame bigint", pick(STRIDED, "least(2, n)", keep="scene_id, frame"), ("frames",))
def _(t):
    return S.select_captions(t.frames, 7, "fixed", num=2, stride=2)


@query("t8_subsample", PT + "sem_label bigint",
       pick("SELECT scene_id, point_idx, sem_label FROM points", "n // 3", 21, key="point_idx"), ("points",))
def _(t):
    return S.subsample(t.points, 3, 21)


@query("t8_subsample_per_class", PT + "sem_label bigint",
       pick("SELECT scene_id, point_idx, sem_label FROM points", "n // 4", 22, by="scene_id, sem_label", key="point_idx"), ("points",))
def _(t):
    return S.subsample(t.points, 4, 22, by=["sem_label"])


def fixed_sql(target, far):
    base = f"SELECT scene_id, point_idx, x, y, z, count(*) OVER w AS n, sum(CASE WHEN {{d}} >= {far}e0 THEN 1 ELSE 0 END) OVER w AS nf, {{d}} >= {far}e0 AS isfar FROM pm WINDOW w AS (PARTITION BY scene_id)".format(d="sqrt(x*x + y*y + z*z)")
    pooled = f"SELECT *, CASE WHEN n > {target} AND nf < {target} AND isfar THEN 0 ELSE 1 END AS pool, CASE WHEN n <= {target} THEN {target} - n WHEN nf < {target} THEN {target} - nf ELSE {target} END AS need FROM ({base}) b"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY scene_id, pool ORDER BY {draw(9, 'scene_id', 'point_idx')}, point_idx) AS pos FROM ({pooled}) p"
    return f"SELECT scene_id, point_idx, 0 AS copy FROM ({ranked}) r WHERE pool = 0 OR n <= {target} OR pos <= need UNION ALL SELECT scene_id, point_idx, 1 FROM ({ranked}) r WHERE n <= {target} AND pos <= need"


@query("t9_sample_fixed", PT + "copy bigint", fixed_sql(600, 2.5), ("pm",))
def _(t):
    return S.sample_fixed(t.points_m, 600, 9, far=2.5)


@query("t9_sample_mostly_far", PT + "copy bigint", fixed_sql(450, 1.0), ("pm",))
def _(t):
    return S.sample_fixed(t.points_m, 450, 9, far=1.0)


@query("t11_permute", PT + "origin_idx bigint",
       f"SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY {draw(31, 'scene_id', 'point_idx')}, point_idx) - 1 AS point_idx, point_idx AS origin_idx FROM points", ("points",))
def _(t):
    return S.permute_points(t.points.select("scene_id", "point_idx"), 31)


@query("t12_repeat_scenes", "scene_id bigint, epoch bigint", "SELECT DISTINCT scene_id, r.range AS epoch FROM points CROSS JOIN range(4) r", ("points",))
def _(t):
    return S.repeat_scenes(t.scenes, 4)


S0 = 400
M = {(i, j): f"({1 if i == j else 0} + {normal(S0 + 10 * (3 * i + j), 'scene_id')}*1e-1)" for i in range(3) for j in range(3)}
M[0, 0] = f"(CASE WHEN {uniform(S0 + 100, 'scene_id')} < 5e-1 THEN -{M[0, 0]} ELSE {M[0, 0]} END)"
ANGLE = f"({uniform(S0 + 112, 'scene_id')}*{PI2} - {PI})"
PARAM = "SELECT scene_id, a, " + ", ".join(f"{M[i, j]} AS n{i}{j}" for i in range(3) for j in range(3)) + f" FROM (SELECT DISTINCT scene_id, {ANGLE} AS a FROM points) d"
MATRIX = "SELECT scene_id, " + ", ".join(f"n{i}0*cos(a) - n{i}1*sin(a) AS m{i}0, n{i}0*sin(a) + n{i}1*cos(a) AS m{i}1, n{i}2 AS m{i}2" for i in range(3)) + f" FROM ({PARAM}) p"


@query("g1_affine_parameters", "scene_id bigint, " + ", ".join(f"m{i}{j} double" for i in range(3) for j in range(3)), MATRIX, ("points",))
def _(t):
    return G.affine_parameters(t.scenes, S0)


@query("g1_scene_affine", PT + XYZ,
       "SELECT p.scene_id, point_idx, " + ", ".join(f"x*m0{j} + y*m1{j} + z*m2{j} AS {c}" for j, c in enumerate("xyz")) + f" FROM pm p JOIN ({MATRIX}) m ON m.scene_id = p.scene_id", ("pm",))
def _(t):
    return G.apply_affine(t.points_m, G.affine_parameters(t.scenes, S0))


@query("g2_jitter_points", PT + XYZ,
       "SELECT scene_id, point_idx, " + ", ".join(f"{c} + ({uniform(51 + i, 'scene_id', 'point_idx')} - 5e-1)*w AS {c}" for i, c in enumerate("xyz"))
       + " FROM (SELECT *, (max(x) OVER w - min(x) OVER w + max(y) OVER w - min(y) OVER w + max(z) OVER w - min(z) OVER w)/3*1e-1 AS w FROM pm WINDOW w AS (PARTITION BY scene_id)) q", ("pm",))
def _(t):
    return G.jitter_points(t.points_m, 51)


@query("g3_scale_scene", PT + XYZ,
       "SELECT scene_id, point_idx, " + ", ".join(f"({c} - (max({c}) OVER w + min({c}) OVER w)/2)*({uniform(61, 'scene_id')}*4e-1 + 8e-1) + (max({c}) OVER w + min({c}) OVER w)/2 AS {c}" for c in "xyz") + " FROM pm WINDOW w AS (PARTITION BY scene_id)", ("pm",))
def _(t):
    return G.scale_scene(t.points_m, 61, 0.8, 1.2)


@query("g4_jitter_colour", PT + "r double, g double, b double",
       "SELECT scene_id, point_idx, " + ", ".join(f"{c}/127.5e0 - 1 + {normal(71 + 10 * i, 'scene_id')}*1e-1 AS {c}" for i, c in enumerate("rgb")) + " FROM points", ("points",))
def _(t):
    pts = t.points.selectExpr("scene_id", "point_idx", *[f"{c}/127.5e0 - 1 AS {c}" for c in "rgb"])
    return G.jitter_colour(pts, 71)


def elastic_sql(gran, mag, seed, src):
    ext = "SELECT scene_id, " + ", ".join(f"CAST(floor(max(abs({c}))) AS BIGINT) // {gran} + 3 AS d{c}" for c in "xyz") + f" FROM ({src}) s GROUP BY scene_id"
    grid = f"SELECT e.*, i.range AS i, j.range AS j, k.range AS k FROM ({ext}) e JOIN range(200) i ON i.range < dx JOIN range(200) j ON j.range < dy JOIN range(200) k ON k.range < dz"
    cur = "SELECT *, " + ", ".join(f"{normal(seed + 10 * a, 'scene_id', 'i', 'j', 'k')} AS n{c}" for a, c in enumerate("xyz")) + f" FROM ({grid}) g"
    for axis in "ijkijk":
        rest = ", ".join(a for a in "ijk" if a != axis)
        cur = "SELECT scene_id, i, j, k, " + ", ".join(f"sum(n{c}) OVER w/3 AS n{c}" for c in "xyz") + f" FROM ({cur}) b WINDOW w AS (PARTITION BY scene_id, {rest} ORDER BY {axis} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
    pos = "SELECT s.scene_id, s.point_idx, s.x, s.y, s.z, dx, dy, dz, " + ", ".join(f"({c} + (d{c} - 1)*{gran})/{2 * gran}e0 AS p{i}" for c, i in zip("xyz", "ijk")) + f" FROM ({src}) s JOIN ({ext}) e ON e.scene_id = s.scene_id"
    cell = "SELECT *, " + ", ".join(f"greatest(least(CAST(floor(p{i}) AS BIGINT), d{c} - 2), 0) AS {i}0" for c, i in zip("xyz", "ijk")) + f" FROM ({pos}) p"
    inside = " AND ".join(f"p{i} - {i}0 BETWEEN 0 AND 1" for i in "ijk")
    weight = "*".join(f"(CASE WHEN g.{i} = {i}0 THEN 1 - (p{i} - {i}0) ELSE p{i} - {i}0 END)" for i in "ijk")
    near = " AND ".join(f"g.{i} BETWEEN {i}0 AND {i}0 + 1" for i in "ijk")
    return (f"WITH gr AS ({cur}), ce AS ({cell}) SELECT c.scene_id, c.point_idx, " + ", ".join(f"any_value(c.{c}) + coalesce(sum({weight}*g.n{c}) FILTER (WHERE {inside}), 0)*{mag}e0 AS {c}" for c in "xyz")
            + f" FROM ce c JOIN gr g ON g.scene_id = c.scene_id AND {near} GROUP BY c.scene_id, c.point_idx")


SCALED = "SELECT scene_id, point_idx, x*50 AS x, y*50 AS y, z*50 AS z FROM pm"


@query("g5_elastic", PT + XYZ, elastic_sql(6, 40.0, 81, SCALED), ("pm",))
def _(t):
    pts = t.points_m.selectExpr("scene_id", "point_idx", "x*50 AS x", "y*50 AS y", "z*50 AS z")
    return G.elastic(pts, 6, 40.0, 81)


@query("g5_elastic_twice", PT + XYZ, elastic_sql(20, 160.0, 82, elastic_sql(6, 40.0, 81, SCALED)), ("pm",))
def _(t):
    pts = t.points_m.selectExpr("scene_id", "point_idx", "x*50 AS x", "y*50 AS y", "z*50 AS z")
    return G.elastic(G.elastic(pts, 6, 40.0, 81), 20, 160.0, 82)


CROP = dict(full=160, limit=400, seed=91, step=32, big=700)


def crop_sql(full, limit, seed, step, big):
    steps = math.ceil(full / step) + 1
    side = {"x": f"({full}e0 - m*{step}e0)", "y": f"({full}e0 - m*{step}e0)", "z": f"{full}e0"}
    cur = "SELECT scene_id, -1 AS t, 0 AS m, count(*) AS n, 0 AS used FROM sc GROUP BY scene_id"
    parts, names = [f"s0 AS ({cur})"], ["s0"]
    for t in range(steps):
        moved = {c: f"({c} + least({side[c].replace('m*', 's.m*')} - (h{c} - l{c}) + 1e-3, 0e0)*{uniform(seed + a, 'p.scene_id', str(t))})" for a, c in enumerate("xyz")}
        ok = " AND ".join(f"{moved[c]} >= 0 AND {moved[c]} < {side[c].replace('m*', 's.m*')}" for c in "xyz")
        parts.append(f"s{t + 1} AS (SELECT s.scene_id, CASE WHEN s.n > {limit} THEN {t} ELSE s.t END AS t, CASE WHEN s.n > {limit} THEN s.m + CASE WHEN s.n > {big} THEN 2 ELSE 1 END ELSE s.m END AS m, "
                     f"CASE WHEN s.n > {limit} THEN count(*) FILTER (WHERE {ok}) ELSE s.n END AS n, CASE WHEN s.n > {limit} THEN s.m ELSE s.used END AS used FROM sc p JOIN s{t} s ON s.scene_id = p.scene_id GROUP BY s.scene_id, s.t, s.m, s.n, s.used)")
    last = {c: (f"({c} + least({full}e0 - s.used*{step}e0 - (h{c} - l{c}) + 1e-3, 0e0)*{uniform(seed + a, 'p.scene_id', 's.t')})" if c != "z" else
                f"({c} + least({full}e0 - (h{c} - l{c}) + 1e-3, 0e0)*{uniform(seed + a, 'p.scene_id', 's.t')})") for a, c in enumerate("xyz")}
    lim = {"x": f"{full}e0 - s.used*{step}e0", "y": f"{full}e0 - s.used*{step}e0", "z": f"{full}e0"}
    ok = " AND ".join(f"{last[c]} >= 0 AND {last[c]} < {lim[c]}" for c in "xyz")
    return ("WITH sc AS (SELECT scene_id, point_idx, x*50 AS x, y*50 AS y, z*50 AS z, " + ", ".join(f"min({c}*50) OVER w AS l{c}, max({c}*50) OVER w AS h{c}" for c in "xyz") + " FROM pm WINDOW w AS (PARTITION BY scene_id)), "
            + ", ".join(parts) + f" SELECT p.scene_id, p.point_idx, " + ", ".join(f"CASE WHEN s.t < 0 THEN {c} ELSE {last[c]} END AS {c}" for c in "xyz")
            + f" FROM sc p JOIN s{steps} s ON s.scene_id = p.scene_id WHERE s.t < 0 OR ({ok})")


@query("g6_crop", PT + XYZ, crop_sql(**CROP), ("pm",))
def _(t):
    pts = t.points_m.selectExpr("scene_id", "point_idx", "x*50 AS x", "y*50 AS y", "z*50 AS z")
    return G.crop(pts, CROP["full"], CROP["limit"], CROP["seed"], CROP["step"], CROP["big"])


@query("g7_world_rotation", PT + "x double, y double",
       f"SELECT scene_id, point_idx, x*cos(a) - y*sin(a) AS x, x*sin(a) + y*cos(a) AS y FROM (SELECT *, {uniform(101, 'scene_id')}*{PI2} - {PI} AS a FROM pm) q", ("pm",))
def _(t):
    return G.world_rotation(t.points_m, 101)


@query("g7_world_flip", PT + "x double, y double",
       f"SELECT scene_id, point_idx, CASE WHEN k IN (0, 2) THEN -x ELSE x END AS x, CASE WHEN k IN (1, 2) THEN -y ELSE y END AS y FROM (SELECT *, CAST(floor({uniform(102, 'scene_id')}*4) AS BIGINT) AS k FROM pm) q", ("pm",))
def _(t):
    return G.world_flip(t.points_m, 102)


@query("g7_world_scaling", PT + "x double, y double",
       f"SELECT scene_id, point_idx, x*f AS x, y*f AS y FROM (SELECT *, {uniform(103, 'scene_id')}*1e-1 + 95e-2 AS f FROM pm) q", ("pm",))
def _(t):
    return G.world_scaling(t.points_m, 103, 0.95, 1.05)


@query("g7_world_translation", PT + XYZ,
       "SELECT scene_id, point_idx, " + ", ".join(f"{c} + {normal(104 + 10 * i, 'scene_id')}*{s}e0 AS {c}" for i, (c, s) in enumerate(zip("xyz", (0.5, 0.25, 0.1)))) + " FROM pm", ("pm",))
def _(t):
    return G.world_translation(t.points_m, 104, (0.5, 0.25, 0.1))


@query("g8_gated_step", PT + "x double, y double",
       f"SELECT scene_id, point_idx, CASE WHEN {uniform(7, 'scene_id')} < 5e-1 THEN x*f ELSE x END AS x, CASE WHEN {uniform(7, 'scene_id')} < 5e-1 THEN y*f ELSE y END AS y FROM (SELECT *, {uniform(105, 'scene_id')}*1e-1 + 95e-2 AS f FROM pm) q", ("pm",))
def _(t):
    return G.when_gated(t.points_m, 7, {"enabled": True, "p": 0.5}, lambda df: G.world_scaling(df, 105, 0.95, 1.05))
