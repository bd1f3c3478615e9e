"""Evaluation report (E17): the evaluation operators assembled into one nested record, as one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from . import common

SCALARS = ("test_samples", "churn_count", "churn_rate", "roc_auc", "pr_auc", "brier_score", "log_loss", "optimal_threshold",
           "recommended_threshold")


def report_parts(scored: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The headline row and the small tables of the report; thresholds are scalar subqueries, no value passes the driver."""
    val, test = scored.where(F.col("split") == "val"), scored.where(F.col("split") == "test")
    picked = E.pick_threshold(E.threshold_sweep(val)).select(F.col("threshold").alias("optimal_threshold"))
    comp = E.threshold_comparison(test, E.candidate_thresholds(picked.scalar()))
    chosen = E.recommend_threshold(comp).select("recommended_threshold")
    fair = E.subgroup_fairness(test, chosen.scalar())
    parts = {
        "threshold_comparison": comp.drop("idx"),
        "subgroup_fairness": fair,
        "disparities": E.disparity_flags(fair),
        "assessment": E.assessment_flags(comp.where(F.col("threshold") == chosen.scalar())),
    }
    base = test.agg(F.count(F.lit(1)).alias("test_samples"), F.sum("y").cast("bigint").alias("churn_count"),
                    F.avg(F.col("y").cast("double")).alias("churn_rate"))
    head = reduce(DataFrame.crossJoin, [base, E.probability_scores(test).drop("n"), picked, chosen])  # one row each
    return head.select(*[F.col(c).cast("double").alias(c) for c in SCALARS]), parts


def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: headline scores, and the comparison, fairness and flags as arrays of structs; ``report_json`` has all of it."""
    head, parts = report_parts(common.scored_splits(spark, sf_dir))
    # every part is a small table: one row per threshold, subgroup or attribute
    listed = [v.agg(F.collect_list(F.struct(*v.columns)).alias(k)) for k, v in parts.items()]
    row = reduce(DataFrame.crossJoin, [head, *listed])  # one row each
    return row.withColumn("report_json", F.to_json(F.struct(*row.columns)))


def report_rows(reports: DataFrame) -> DataFrame:
    """(section, item, metric, value) of reports in JSON, read with a fixed schema."""
    schema = ", ".join(f"{c} double" for c in SCALARS) + (
        ", threshold_comparison array<struct<threshold: double, recall: double, precision: double, f1: double, net_savings: double, kpi_passes: int>>"
        ", subgroup_fairness array<struct<subgroup_category: string, subgroup_value: string, sample_size: long, recall: double, selection_rate: double>>"
        ", disparities array<struct<subgroup_category: string, recall_range: double, selection_range: double>>"
        ", assessment array<struct<threshold: double, fp_share_pct: double>>")
    doc = reports.select(F.from_json("report_json", schema).alias("d")).select("d.*")

    def rows(section: str, frame: DataFrame, item, metrics: list[str]) -> DataFrame:
        return frame.select(F.explode(F.array(*[F.struct(
            F.lit(section).alias("section"), item.cast("string").alias("item"), F.lit(m).alias("metric"),
            F.col(m).cast("double").alias("value")) for m in metrics])).alias("r")).select("r.*")

    inner = lambda c: doc.select(F.explode(c).alias("e")).select("e.*")
    percent = F.round(F.col("threshold") * 100, 0).cast("int")
    return reduce(DataFrame.unionByName, [
        rows("headline", doc, F.lit(""), list(SCALARS)),
        rows("threshold", inner("threshold_comparison"), percent, ["recall", "precision", "f1", "net_savings", "kpi_passes"]),
        rows("fairness", inner("subgroup_fairness"), F.concat_ws("=", "subgroup_category", "subgroup_value"),
             ["sample_size", "recall", "selection_rate"]),
        rows("disparity", inner("disparities"), F.col("subgroup_category"), ["recall_range", "selection_range"]),
        rows("assessment", inner("assessment"), percent, ["fp_share_pct"])])
