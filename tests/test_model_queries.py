"""The registered model queries: one model of all rounds, used by each."""

from stromlage.plans.training import Params
from workload import models

SF = "/root/testdata/sf0.001"


def test_reports_of_the_later_rows(spark):
    rows = models.model_evaluation(spark, SF).collect()
    assert {r["at"] for r in rows} == {"default", "tuned"} and len(rows) == 10
    assert len({r.support for r in rows if r["class"] == "accuracy"}) == 1


def test_one_model_of_all_rounds(spark):
    first, again = (models._whole(spark, SF)[0] for _ in range(2))
    assert first is again and len(first.model.trees) == Params().growth.rounds == 300
