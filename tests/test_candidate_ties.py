"""Candidates whose scores differ by rounding alone."""

from watchplan.operators import decisions as D


def test_equal_scores_go_by_order_whatever_their_last_digit(spark):
    # 3 * 0.1 + 0.5 * 0.6 and 3 * 0.2 + 0 differ in the last bit alone; the lower price is the first of equals
    df = spark.createDataFrame([(1, 0.3, 0.0, 0.0, 0.0, 5.0), (1, 0.1, 0.0, 1.2, 0.0, 4.0), (1, 0.2, 0.0, 0.6, 0.0, 3.0)], "g int, iou double, dist double, conf double, valid double, price double")
    assert len({3 * a - 2 * b + 0.5 * c + 0.25 * v for a, b, c, v in ((0.3, 0, 0, 0), (0.1, 0, 1.2, 0), (0.2, 0, 0.6, 0))}) > 1
    assert D.best_candidate(df, ["g"], "iou", "dist", "conf", "valid", "price").first()["price"] == 3.0
