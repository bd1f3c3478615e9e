"""EDA report (A22): the profiling sections as one long table.

The joined table is scanned once, into its value counts; every section is read off these, and the
sections are ``unionByName``-ed in the long form ``(section, item, metric, value)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import to_number
from ..operators import profile as A
from ..operators.value_table import ValueTable, value_table

NUMERIC = ["Tenure", "SeniorCitizen", "MonthlyCharges", "TotalCharges", "Churn_Flag"]
OUTLIER_COLS = ["Tenure", "MonthlyCharges", "TotalCharges"]


def eda_table(joined: DataFrame) -> DataFrame:
    """Joined sources with TotalCharges coerced and a 0/1 label column added."""
    return joined.withColumns({
        "TotalCharges": to_number("TotalCharges"),
        "Churn_Flag": F.col(C.TARGET_COL).eqNullSafe("Yes").cast("int"),  # X2: NULL counts as 0
    })


def _section(df: DataFrame, section: str, item, metrics: list[str]) -> DataFrame:
    item_col = item if not isinstance(item, str) else F.col(item)
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(section).alias("section"), item_col.cast("string").alias("item"),
                 F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        for m in metrics
    ])).alias("s")).select("s.*")


def _insights(t: ValueTable) -> list[DataFrame]:
    """Overall rate, the two charted correlations and the contract types of the highest and lowest rate."""
    label, n = F.col("class").cast("double"), F.col("n")
    overall = t.of(["Churn_Flag"]).agg((F.sum(label * n) / F.sum(n)).alias("churn_rate"))
    r = t.class_correlation(["Tenure", "MonthlyCharges"]).withColumn(
        "metric", F.when(F.col("column") == "Tenure", "r_tenure").otherwise("r_monthly_charges"))
    rates = t.rates(["ContractType"]).withColumnRenamed("value", "ContractType")  # a few types
    top = rates.orderBy(F.col("rate").desc(), "ContractType").limit(1).withColumnRenamed("rate", "highest_rate")
    low = rates.orderBy(F.col("rate").asc(), "ContractType").limit(1).withColumnRenamed("rate", "lowest_rate")
    return [_section(overall, "insights", F.lit(""), ["churn_rate"]),
            r.select(F.lit("insights").alias("section"), F.lit("").alias("item"), "metric", F.col("r").alias("value")),
            _section(top, "insights", "ContractType", ["highest_rate"]),
            _section(low, "insights", "ContractType", ["lowest_rate"])]


def eda_report(joined: DataFrame) -> DataFrame:
    """All sections from the value counts of the joined table, which is scanned once."""
    table = eda_table(joined)
    t = value_table(table, target="Churn_Flag", rows=True)
    cats = [c for c in A.string_columns(table) if c not in (C.KEY_COL, C.TARGET_COL)]
    rates = t.rates(C.PREP_CATEGORICAL_COLS).groupBy("column").agg(
        F.max("rate").alias("highest_rate"), F.min("rate").alias("lowest_rate"))
    parts = [
        _section(t.size().withColumn("n_columns", F.lit(len(table.columns))), "overview", F.lit(""), ["n_rows", "n_columns"]),
        _section(t.nulls(), "missing", "column", ["null_count", "null_pct"]),
        _section(t.duplicates(C.KEY_COL), "duplicates", F.lit(C.KEY_COL), ["duplicate_keys", "duplicate_rows"]),
        _section(t.describe(NUMERIC), "summary", "column", ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]),
        _section(t.value_counts(cats), "categorical", F.concat_ws("=", "column", "value"), ["count", "pct"]),
        _section(t.outliers(OUTLIER_COLS), "outliers", "column", ["q1", "q3", "lower", "upper", "outliers"]),
        _section(t.value_counts([C.TARGET_COL]), "target", "value", ["count", "pct"]),
        _section(t.class_correlation(["Tenure", "SeniorCitizen", "MonthlyCharges", "TotalCharges"]), "correlation", "column", ["r"]),
        _section(rates, "rates", "column", ["highest_rate", "lowest_rate"]),
        *_insights(t),
    ]
    return reduce(DataFrame.unionByName, parts)
