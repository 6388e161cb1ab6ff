"""Blocked caption scores against whole rows of scores."""

import numpy as np
import pandas as pd
import pytest

from pointlake.operators import captions as CP


@pytest.mark.parametrize("caption_block, region_block", [(1, 1), (3, 2), (2048, 8192)])
def test_caption_scores_agree_with_rows_of_scores(spark, caption_block, region_block):
    r = np.random.default_rng(3)
    caps = pd.DataFrame({"batch_id": [0] * 9 + [1] * 2, "caption_id": [*range(20, 27), 20, 21, 4, 5]})
    caps["text_vec"] = [list(v) for v in r.integers(-3, 4, (11, 5)).astype(float)]
    ids = [20, 21, 22, 26, 20, 99, None, 25, 4, 5, 4, None]
    rows = [(i, 0, i // 8, ids[i], r.integers(-3, 4, 5).astype(float).tolist()) for i in range(12)]
    left = spark.createDataFrame(rows, "scene_id long, frame long, batch_id long, caption_id long, vec array<double>")
    right = spark.createDataFrame(caps)
    want = {x.scene_id: x for x in CP.caption_similarity(left, right, "vec", "text_vec", 7.0).collect()}
    got = CP.caption_scores(left, right, CP.IMAGE, "vec", "text_vec", 7.0, caption_block, region_block).collect()
    assert {x.scene_id for x in got} == set(want) and len(got) == 12
    for x in got:
        logits = np.array(want[x.scene_id].logits)
        assert x.label == want[x.scene_id].label
        assert x.own == (pytest.approx(logits[x.label]) if x.label is not None and x.label >= 0 else None)
        assert x.lse == pytest.approx(np.log(np.exp(logits).sum())) and x.top == pytest.approx(logits.max())
        assert x.best == logits.round(9).argmax()
    empty = CP.caption_scores(left.filter("scene_id < 0"), right, CP.IMAGE, "vec", "text_vec")
    assert empty.count() == 0 and CP.caption_loss(empty).first()[0] is None
