"""Profiling aggregations.

Each profile is one ``agg`` over the table (one scan, partial aggregation
map-side) whose single wide result row is reshaped with ``stack``/``unpivot``
into long rows. Group-level reports use one ``groupBy`` after ``unpivot`` of
the columns, instead of one pass per column; quantiles, outliers, histograms,
box statistics and duplicates are read off one ``ValueTable``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from .. import config as C
from ..functions.columns import half_even_round
from .value_table import value_table


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """P10: numeric columns by schema."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in exclude]


def _long(row_df: DataFrame, names: Sequence[str], value_cols: Sequence[str], key: str = "column") -> DataFrame:
    """Reshape a 1-row frame with columns ``<name>__<metric>`` into (column, metric...) rows."""
    parts = []
    for n in names:
        parts.append(F.struct(F.lit(n).alias(key), *[F.col(f"{n}__{v}").alias(v) for v in value_cols]))
    return row_df.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


# A1 / A2 / A3 --------------------------------------------------------------
def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"))


def schema_report(df: DataFrame) -> DataFrame:
    """A2: (position, column, dtype) rows built from the schema, no data scan."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string")


def total_nulls(df: DataFrame) -> DataFrame:
    terms = [F.count_if(F.col(c).isNull()) for c in df.columns]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.agg(total.cast("bigint").alias("total_nulls"))


# A4 ------------------------------------------------------------------------
def null_profile(df: DataFrame, nonzero_only: bool = True) -> DataFrame:
    """Per column: NULL count and share of rows in % (2 decimals); only columns with NULLs."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(f"{c}__null_count") for c in cols])
    long = _long(wide.withColumns({f"{c}__n": F.col("__n") for c in cols}), cols, ["null_count", "n"])
    out = long.select(
        "column",
        F.col("null_count").cast("bigint").alias("null_count"),
        half_even_round(F.lit(100.0) * F.col("null_count") / F.col("n"), 2).alias("null_pct"),
    )
    return out.where("null_count > 0") if nonzero_only else out  # P6


# A5 ------------------------------------------------------------------------
def blank_strings(df: DataFrame, col: str = "TotalCharges", by: str = "Tenure") -> DataFrame:
    """Blank (whitespace-only) values by the value of ``by`` in their rows."""
    return df.where(F.trim(F.col(col)) == "").groupBy(by).agg(F.count(F.lit(1)).alias("blank_count"))


# A6 / A7 -------------------------------------------------------------------
def duplicate_report(df: DataFrame, key: str = C.KEY_COL) -> DataFrame:
    """Duplicate keys and fully duplicate rows, both excluding the first occurrence; a NULL key is a value of its own."""
    return value_table(df, [key], rows=True).duplicates(key)


# A8 ------------------------------------------------------------------------
def describe(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 % (linear interpolation), max per numeric column."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    return value_table(df, cols).describe(cols, digits)


# A9 / A10 ------------------------------------------------------------------
def value_counts(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    """Per categorical column: count and % of all rows per value, NULL values dropped.

    The columns are unpivoted into (column, value) pairs and counted in one
    ``groupBy`` (partial aggregation before the shuffle), not one job per column.
    """
    cols = list(cols) if cols is not None else string_columns(df, exclude=(C.KEY_COL, C.TARGET_COL))
    n_total = df.count()
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("kv")).select("kv.*").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    return counts.select(
        "column", "value", "count",
        half_even_round(F.lit(100.0) * F.col("count") / F.lit(n_total), digits).alias("pct"),
    )


def class_distribution(df: DataFrame, target: str = C.TARGET_COL) -> DataFrame:
    """A10: count and % per label value."""
    return value_counts(df, [target]).drop("column").withColumnRenamed("value", target)


# A11 -----------------------------------------------------------------------
def iqr_outliers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Q1, Q3, the 1.5 IQR fences and the number of values strictly outside them."""
    return value_table(df, cols).outliers(cols)


# A12 / A13 -----------------------------------------------------------------
def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r for every ordered pair in one aggregation (pairwise-complete rows)."""
    aggs = []
    pairs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i:
                continue
            aggs.append(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r_{i}_{j}"))
            pairs.append((i, j))
    wide = df.agg(*aggs)
    rows = []
    for i, j in pairs:
        rows.append(F.struct(F.lit(cols[i]).alias("column_a"), F.lit(cols[j]).alias("column_b"), F.col(f"r_{i}_{j}").alias("r")))
        if i != j:
            rows.append(F.struct(F.lit(cols[j]).alias("column_a"), F.lit(cols[i]).alias("column_b"), F.col(f"r_{i}_{j}").alias("r")))
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def target_correlation(df: DataFrame, cols: Sequence[str], target: str = C.TARGET_COL) -> DataFrame:
    """R of each numeric column with the label, largest |r| first."""
    wide = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(f"r_{i}") for i, c in enumerate(cols)])
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"r_{i}").alias("r")) for i, c in enumerate(cols)
    ])).alias("x")).select("x.*")
    return long.orderBy(F.abs(F.col("r")).desc_nulls_last(), F.col("column"))


# A14 / A15 / A16 -----------------------------------------------------------
def rate_by(df: DataFrame, by: str, target: str = C.TARGET_COL, extra: dict[str, Column] | None = None) -> DataFrame:
    """Label rate per category value (plus optional extra aggregates)."""
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(F.col(target).cast("double")).alias("churn_rate")]
    if extra:
        aggs += [v.alias(k) for k, v in extra.items()]
    return df.groupBy(by).agg(*aggs)


def rate_extremes(df: DataFrame, cols: Sequence[str], target: str = C.TARGET_COL) -> DataFrame:
    """Per category column, the highest- and lowest-rate value (ties -> smallest value)."""
    long = df.select(F.col(target).cast("double").alias("y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("kv")).select("kv.*", "y").where(F.col("value").isNotNull())
    rates = long.groupBy("column", "value").agg(F.avg("y").alias("rate"))
    # rates has one row per (column, value): ties resolve to the smallest value
    return rates.groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("rate")).alias("nr"), F.col("value").alias("v"))).alias("highest_value"),
        F.max("rate").alias("highest_rate"),
        F.min_by("value", F.struct(F.col("rate").alias("r"), F.col("value").alias("v"))).alias("lowest_value"),
        F.min("rate").alias("lowest_rate"),
    )


def key_insights(df: DataFrame, target: str = C.TARGET_COL, tenure: str = "Tenure",
                 monthly: str = "MonthlyCharges", group_col: str = "ContractType") -> DataFrame:
    """Overall rate, r(tenure), r(monthly) and the best/worst group of ``group_col``."""
    y = F.col(target).cast("double")
    overall = df.agg(
        F.avg(y).alias("overall_rate"),
        F.corr(F.col(tenure).cast("double"), y).alias("r_tenure"),
        F.corr(F.col(monthly).cast("double"), y).alias("r_monthly"),
    )
    rates = df.groupBy(group_col).agg(F.avg(y).alias("rate"))
    ext = rates.agg(
        F.min_by(F.col(group_col), F.struct((-F.col("rate")).alias("nr"), F.col(group_col).alias("v"))).alias("highest_group"),
        F.max("rate").alias("highest_rate"),
        F.min_by(F.col(group_col), F.struct(F.col("rate").alias("r"), F.col(group_col).alias("v"))).alias("lowest_group"),
        F.min("rate").alias("lowest_rate"),
    )
    return overall.crossJoin(ext)  # one row each


# A17 -----------------------------------------------------------------------
def class_histogram(df: DataFrame, col: str, target: str = C.TARGET_COL, bins: int = 30) -> DataFrame:
    """Equal-width histogram per class over that class's own min-max range."""
    return value_table(df, [col], target).class_histogram(col, bins).withColumnRenamed("class", target)


# A18 -----------------------------------------------------------------------
def box_stats(df: DataFrame, cols: Sequence[str], target: str = C.TARGET_COL) -> DataFrame:
    """Per class and column: Q1, median, Q3, whiskers (extreme values inside 1.5 IQR) and flier count."""
    return value_table(df, cols, target).box_stats(cols).withColumnRenamed("class", target)


# A19 / A20 -----------------------------------------------------------------
def class_balance(df: DataFrame, target: str = C.TARGET_COL) -> DataFrame:
    y = F.col(target)
    return df.agg(F.count_if(y == 0).alias("n_negative"), F.count_if(y == 1).alias("n_positive")).select(
        "n_negative", "n_positive",
        F.try_divide(F.col("n_negative").cast("double"), F.col("n_positive").cast("double")).alias("imbalance_ratio"))


def split_summary(df: DataFrame, split_col: str = "split", target: str = C.TARGET_COL) -> DataFrame:
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(target).cast("double")).alias("churn_rate"))


# A21 -----------------------------------------------------------------------
def exploration_report(raw: DataFrame, target: str = C.TARGET_COL, blank_col: str = "TotalCharges") -> DataFrame:
    """A1 + A3 + A5 + A10 as long (metric, value) rows from ONE aggregation."""
    cols = raw.columns
    null_total = None
    for c in cols:
        t = F.count_if(F.col(c).isNull())
        null_total = t if null_total is None else null_total + t
    blank = F.trim(F.col(blank_col)) == ""
    one = raw.agg(
        F.count(F.lit(1)).alias("n_rows"),
        null_total.alias("total_nulls"),
        F.count_if(blank).alias("blank_count"),
        F.count_if(F.col(target) == "Yes").alias("n_yes"),
        F.count_if(F.col(target) == "No").alias("n_no"),
    )
    items = [
        ("rows", F.col("n_rows")),
        ("columns", F.lit(len(cols))),
        ("total_nulls", F.col("total_nulls")),
        ("blank_" + blank_col, F.col("blank_count")),
        (target + "_Yes", F.col("n_yes")),
        (target + "_No", F.col("n_no")),
        (target + "_Yes_pct", half_even_round(F.lit(100.0) * F.col("n_yes") / F.col("n_rows"), 2)),
    ]
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in items
    ])).alias("m")).select("m.*")
