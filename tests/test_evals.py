from lexgrove.operators.evals import expected_ranks, metrics_by_split


def test_recall_tells_several_expected_ids_and_ranks_up_to_ten_apart(spark):
    items = spark.createDataFrame([(1, "dev"), (2, "dev"), (3, "holdout"), (4, "holdout")], "item_id long, split string")
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (1, "never"), (1, "late"), (2, "c"), (3, "d")], "item_id long, id string")
    ranked = [(1, "a", 1), (1, "x", 2), (1, "b", 5), (1, "late", 11), (2, "x", 1), (2, "c", 7), (2, "c", 9), (3, "d", 3), (4, "x", 1)]
    out = metrics_by_split(items, expected_ranks(expected, spark.createDataFrame(ranked, "item_id long, id string, rank int")))
    assert out.columns == ["split", "items", "recall1", "recall5", "recall10", "hit1", "hit5", "mrr"]
    got = {r.split: tuple(r)[1:] for r in out.collect()}
    assert got["dev"] == (2, 0.125, 0.25, 0.75, 0.5, 0.5, round((1 + 1 / 7) / 2, 6))
    assert got["holdout"] == (2, 0.0, 1.0, 1.0, 0.0, 0.5, round(1 / 6, 6))
    assert got["all"] == (4, round(0.25 / 3, 6), 0.5, round(2.5 / 3, 6), 0.25, 0.5, round((1 + 1 / 7 + 1 / 3) / 4, 6))
