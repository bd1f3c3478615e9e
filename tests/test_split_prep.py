"""Split, folds and fitted transforms."""

import pytest
from pyspark.sql import functions as F

from attrix import config as C
from attrix.operators.prep import apply_prep, fit_prep
from attrix.operators.split import stratified_split


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f"C{i:05d}", 1 if i % 4 == 0 else 0) for i in range(2000)]
    return spark.createDataFrame(rows, "CustomerID string, Churn int")


def test_split_is_partition_with_sizes(table):
    s = stratified_split(table)
    assert s.count() == table.count()
    assert s.select("CustomerID").distinct().count() == 2000
    sizes = {(r.Churn, r.split): r.n for r in s.groupBy("Churn", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    for c, n in ((1, 500), (0, 1500)):
        assert abs(sizes[(c, "train")] - 0.70 * n) <= 1
        assert abs(sizes[(c, "val")] - 0.15 * n) <= 1
        assert sizes[(c, "train")] + sizes[(c, "val")] + sizes[(c, "test")] == n


def test_split_is_stable(table):
    a = stratified_split(table).select("CustomerID", "split")
    b = stratified_split(table).select("CustomerID", "split")
    assert a.exceptAll(b).count() == 0


def test_folds_cover_train(table):
    f = stratified_split(table, k=C.N_FOLDS)
    train = f.where("split = 'train'")
    assert train.where("fold IS NULL").count() == 0
    assert f.where("split <> 'train' AND fold IS NOT NULL").count() == 0
    counts = [r.n for r in train.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(counts) == C.N_FOLDS and sum(counts) == train.count() and max(counts) - min(counts) <= 2


def test_prep_fit_apply(spark):
    cfg = C.FeatureConfig(numeric_cols=("x", "z"), categorical_cols=("c",), binary_cols=("b",))
    train = spark.createDataFrame([(1.0, 5.0, "a", 1), (2.0, 5.0, "b", 0), (3.0, 5.0, "a", 1), (4.0, 5.0, None, 0)],
                                  "x double, z double, c string, b int")
    p = fit_prep(train, cfg)
    assert p.categories["c"] == ["a", "b"]
    assert p.means["x"] == 2.5
    assert p.stds["x"] == pytest.approx((1.25) ** 0.5)  # population std
    other = spark.createDataFrame([(2.5, 7.0, "zzz", 1)], "x double, z double, c string, b int")
    f = apply_prep(other, p).first().features
    assert f[0] == 0.0
    assert f[1] == 2.0  # zero variance -> divide by 1
    assert f[2:4] == [0.0, 0.0]  # unseen category -> all zeros
    assert f[4] == 1.0
    assert [n for _, n, _ in p.feature_names()] == ["x", "z", "c_a", "c_b", "b"]


def test_exact_median_and_mode(spark):
    cfg = C.FeatureConfig(numeric_cols=("x",), categorical_cols=("c",), binary_cols=())
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (4.0, "b"), (10.0, "a"), (None, None)], "x double, c string")
    p = fit_prep(df, cfg, impute=True)
    assert p.medians["x"] == 3.0  # exact interpolated, not approximate
    assert p.modes["c"] == "a"  # tie -> smallest value


def test_split_plan_has_no_single_partition_exchange(table):
    # the rank runs per (class, hash bucket); only bounded count tables are windowed globally per class
    plan = stratified_split(table, k=5)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_split_with_folds_in_one_pass(table):
    s = stratified_split(table, k=5)
    train = s.where("split = 'train'")
    assert s.where("split <> 'train' AND fold IS NOT NULL").count() == 0
    per = {(r.Churn, r.fold): r.n for r in train.groupBy("Churn", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    for c in (0, 1):
        sizes = [per[(c, f)] for f in range(5)]
        assert max(sizes) - min(sizes) <= 1  # round robin inside each class


def test_split_keeps_null_labels_and_keys(spark):
    rows = [(f"C{i:03d}", i % 2) for i in range(100)] + [("N1", None), ("N2", None), (None, 0), (None, 1)]
    s = stratified_split(spark.createDataFrame(rows, "CustomerID string, Churn int"), k=5)
    assert s.count() == 104
    assert s.where("Churn IS NULL").count() == 2 and s.where("CustomerID IS NULL").count() == 2
    assert s.where("split IS NULL").count() == 0


def test_split_takes_any_number_of_strata(spark):
    df = spark.range(400).select(F.col("id").cast("string").alias("CustomerID"), (F.col("id") % 100).alias("Churn"))
    s = stratified_split(df)
    assert s.count() == 400 and s.select("Churn").distinct().count() == 100
