"""Times the headline queries and prints one JSON line."""

import json
import os
import time

from pointlake.plans import catalogue
from pointlake.session import build_session

HEADLINE = """a8_open_vocab_iou a6_summary p1_class_mapper p6_densify_instances p11_centre_and_normalise a1_centre_offsets
v1_point_voxel_map v3_pool_mean v6_hard_voxels c1_zero_shot_scores c2_calibrated_class a20_caption_pool j2_depth_consistent
j8_frame_pairs u3_entities j4_radius_neighbours c7_components c9_predicted_instances j9_proposal_iou w8_encode
a14_average_precision t8_subsample t11_permute g1_scene_affine g5_elastic g6_crop""".split()


def scale_of(sf_dir):
    name = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    try:
        return float(name)
    except ValueError:
        return name


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    catalogue()["a8_open_vocab_iou"].run(spark, sf_dir).collect()  # start the JVM's compilers
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalogue()[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": scale_of(sf_dir)}))


if __name__ == "__main__":
    main()
