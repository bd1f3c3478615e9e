"""Plan-shape guards: pushdown, pruning and partition pruning that the design relies on."""

from pyspark.sql import functions as F

from attrix.plans import common
from attrix.sources.snapshot import snapshot_wide

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_snapshot_scans_are_pruned_and_filtered(spark):
    plan = _plan(snapshot_wide(spark, SF))
    assert "EqualTo(l_returnflag,R)" in plan  # returned line items filtered at the scan
    assert "In(p_brand" in plan  # only the seven add-on brands are read
    assert "LessThan(o_orderdate" in plan  # history orders filtered at the scan
    assert "l_extendedprice" not in plan and "p_retailprice" not in plan  # unused columns never read
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_prepared_split_reads_one_partition(spark):
    test = common.prepared_splits(spark, SF).where(F.col("split") == "test")
    plan = _plan(test)
    assert "PartitionFilters: [isnotnull(split" in plan
    assert test.count() > 0


def test_scoring_is_one_narrow_stage(spark):
    _, bundle = common.fitted(spark, SF)
    from attrix.operators.scoring import score_records
    plan = _plan(score_records(common.serving_records(spark, SF), bundle))
    assert "Exchange" not in plan  # no shuffle on the scoring path
