"""Counts of prediction problems against the problems themselves, and where ids are held."""

from pyspark.sql import functions as F

from routeloom.operators import metrics
from routeloom.plans import evaluation


def _plain(rows, preds):
    problems = metrics.join_predictions(rows, preds)[1]
    return {tuple(r) for r in problems.groupBy("problem").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids")).collect()}


def test_counts_are_those_of_the_problems(spark):
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id long")
    cases = [([1, 2, 2, 3], [1, 1, 2, 5, 5, 6]), ([1], [1]), ([], [4, 4]), ([1, 2], []), ([1, None], [None, None, 1]), ([3], [None])]
    for rows, preds in cases:
        assert {tuple(r) for r in metrics.problem_counts(ids(rows), ids(preds)).collect()} == _plain(ids(rows), ids(preds)), (rows, preds)


def test_no_ids_are_held_where_files_are_read(spark, tmp_path):
    d = str(tmp_path)
    spark.range(300).selectExpr("id AS o_orderkey").write.parquet(f"{d}/orders.parquet")
    spark.range(1000).selectExpr("id % 400 AS l_orderkey").write.parquet(f"{d}/lineitem.parquet")
    found = evaluation.prediction_problems(spark, d)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the plan reads upwards: below the exchange that deals ids nothing is grouped
    assert plan.count("REPARTITION_BY_NUM") == 1
    assert "Aggregate" not in plan.split("REPARTITION_BY_NUM")[1] and "Join" not in plan
    # 0, 3, ... 297 and 300 to 399 have no row; ids below 200 came three times, the others twice
    assert {tuple(r) for r in found.collect()} == {("repeated", 400, 400), ("unknown", 67 * 3 + 33 * 2 + 100 * 2, 200)}
