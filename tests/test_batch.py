import micro
import pytest

from termspire.operators.batch import timed_batch


def test_totals_and_means_over_answered_queries(spark):
    index = micro.index(spark)
    queries = micro.queries(spark, ["e"], ["c"], ["zz"], ["b"])
    results, report = timed_batch(index, queries, k=2)
    row = report.first()
    assert (row.asked, row.answered, row.skipped, row.hits) == (4, 3, 1, 5)
    assert row.mean_hits == pytest.approx(5 / 3) and results.count() == 5
    best_of_b = max(r.bm25score for r in results.where("qno = 3").collect())
    assert row.mean_best == pytest.approx((micro.E_IN_3 + micro.C_IN_0 + best_of_b) / 3, abs=1e-6)
    assert row.seconds > 0 and row.seconds_per_answered == pytest.approx(row.seconds / 3)


def test_nothing_answered(spark):
    results, report = timed_batch(micro.index(spark), micro.queries(spark, ["zz"], ["yy"]), k=2)
    row = report.first()
    assert (row.asked, row.answered, row.skipped, row.hits) == (2, 0, 2, 0) and results.count() == 0
    assert row.mean_hits is None and row.mean_best is None and row.seconds_per_answered is None
