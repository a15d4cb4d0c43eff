"""The approximate index: recall against all vectors, and the cases that must not break it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgrove.operators import search as S
from lexgrove.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_recall_against_all_vectors(spark):
    exact, near = ({(r.qid, r.id) for r in QUERIES[name](spark, SF).collect()} for name in ("dense_topk", "ann_topk"))
    assert len(exact & near) >= 0.9 * len(exact)


def test_every_list_probed_is_the_exact_search(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(6)]) for i in range(200)] + [(200, [0.0] * 6), (201, None), (202, [])]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    asked = spark.createDataFrame([(i, v) for i, v in rows[:9]] + [(99, [0.0] * 6), (98, None)], "qid long, q array<double>")
    centres = S.fit_lists(vectors, 8)
    index = S.ann_index(vectors, centres)
    assert index.count() == 201 and centres.shape == (8, 6) and np.allclose(np.linalg.norm(centres, axis=1), 1)
    found = lambda df: sorted(map(tuple, df.select("qid", "rank", "id", "score").collect()))
    assert found(S.ann_topk(asked, index, centres, 5, 8)) == found(S.dense_topk(asked, vectors, 5))
    few = S.ann_topk(asked, index, centres, 5, 1)
    assert {x.qid for x in few.collect()} <= set(range(9)) | {99}


@pytest.mark.parametrize("empty", ["vectors", "queries"])
def test_empty_tables(spark, empty):
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, q array<double>")
    vectors, asked = (vectors.limit(0), asked) if empty == "vectors" else (vectors, asked.limit(0))
    centres = S.fit_lists(vectors, 4)
    assert S.ann_topk(asked, S.ann_index(vectors, centres), centres, 3, 2).where(F.col("rank") > 0).count() == 0
