"""Registered profiling queries (A1-A22) with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import profile as A
from ..sqlcheck.parts import joined_ctes, split_ctes, with_ctes
from . import common
from .catalog import register
from .eda import NUMERIC as EDA_NUMERIC
from .eda import OUTLIER_COLS, eda_report

JOINED_COLS = ["CustomerID"] + C.CONTRACT_COLS[1:] + C.DEMOGRAPHIC_COLS[1:] + C.USAGE_COLS[1:]
CLEAN_NUMERIC = ["Tenure", "PaperlessBilling", "Churn", "Gender", "SeniorCitizen", "Dependents", "Partner",
                 "MonthlyCharges", "TotalCharges", "PhoneService"]
JOINED_STRINGS = [c for c in JOINED_COLS if c not in ("CustomerID", "Churn", "Tenure", "SeniorCitizen",
                                                      "MonthlyCharges", "TotalCharges")]
IQR_COLS = ["Tenure", "MonthlyCharges", "TotalCharges"]
CORR_COLS = ["Tenure", "MonthlyCharges", "TotalCharges", "Churn"]
D = "CAST(100 AS DOUBLE)"
W = with_ctes(joined_ctes())


def hround(expr: str, digits: int = 2) -> str:
    s = f"CAST({10 ** digits} AS DOUBLE)"
    return f"round_even(CAST({expr} AS DOUBLE) * {s}, 0) / {s}"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# A1 ------------------------------------------------------------------------
@register("a01_shape", sql=W + f"\nSELECT count(*) AS n_rows, CAST({len(JOINED_COLS)} AS BIGINT) AS n_columns FROM joined")
def a01(spark, sf_dir):
    return A.shape(common.joined(spark, sf_dir))


# A2 ------------------------------------------------------------------------
_CLEAN_TYPES = {"Tenure": "int", "MonthlyCharges": "double", "TotalCharges": "double", "SeniorCitizen": "int",
                "Churn": "int", **{c: "int" for c in C.BINARY_MAP_COLS}}


@register("a02_schema_report", sql=W + "\n" + union([
    f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", '{_CLEAN_TYPES.get(c, 'string')}' AS dtype, "
    f"count({c}) AS non_null FROM cleaned" for i, c in enumerate(JOINED_COLS)]))
def a02(spark, sf_dir):
    t = common.cleaned(spark, sf_dir)
    schema = A.schema_report(t)
    counts = t.agg(*[F.count(F.col(c)).alias(c) for c in t.columns])
    long = counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("non_null")) for c in t.columns])).alias("x")).select("x.*")
    # both sides have one row per column: the join is bounded by the schema width
    return schema.join(F.broadcast(long), "column").select("position", "column", "dtype", "non_null")


# A3 ------------------------------------------------------------------------
@register("a03_total_nulls", sql=W + "\nSELECT CAST(" + " + ".join(
    f"count(*) FILTER (WHERE {c} IS NULL)" for c in JOINED_COLS) + " AS BIGINT) AS total_nulls FROM cleaned")
def a03(spark, sf_dir):
    return A.total_nulls(common.cleaned(spark, sf_dir))


# A4 / P6 ---------------------------------------------------------------------
@register("a04_null_profile", sql=W + "\nSELECT * FROM (\n" + union([
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
    f"{hround(f'{D} * count(*) FILTER (WHERE {c} IS NULL) / count(*)')} AS null_pct FROM cleaned"
    for c in JOINED_COLS]) + "\n) WHERE null_count > 0", doubles=("null_pct",))
def a04(spark, sf_dir):
    return A.null_profile(common.cleaned(spark, sf_dir))


# A5 ------------------------------------------------------------------------
@register("a05_blank_strings", sql=W + """
SELECT Tenure, count(*) AS blank_count FROM joined WHERE trim(TotalCharges) = '' GROUP BY Tenure""")
def a05(spark, sf_dir):
    return A.blank_strings(common.joined(spark, sf_dir))


# A6 / A7 -------------------------------------------------------------------
@register("a06_duplicates", sql=W + f"""
SELECT CAST(count(*) - count(DISTINCT CustomerID) - CASE WHEN count(*) FILTER (WHERE CustomerID IS NULL) > 0 THEN 1 ELSE 0 END AS BIGINT) AS duplicate_keys,
       (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM joined GROUP BY ALL_COLS)) AS duplicate_rows
FROM joined""".replace("GROUP BY ALL_COLS", "GROUP BY " + ", ".join(JOINED_COLS)))
def a06(spark, sf_dir):
    return A.duplicate_report(common.joined(spark, sf_dir))


# A8 ------------------------------------------------------------------------
def _describe_sql(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", count({x}) AS count, {hround(f'avg({x})')} AS mean, "
            f"{hround(f'stddev_samp({x})')} AS std, {hround(f'min({x})')} AS min, "
            f"{hround(f'quantile_cont({x}, 0.25)')} AS p25, {hround(f'quantile_cont({x}, 0.5)')} AS p50, "
            f"{hround(f'quantile_cont({x}, 0.75)')} AS p75, {hround(f'max({x})')} AS max FROM {table}")
    return union(parts)


@register("a08_describe", sql=W + "\n" + _describe_sql("cleaned", CLEAN_NUMERIC),
          doubles=("mean", "std", "min", "p25", "p50", "p75", "max"))
def a08(spark, sf_dir):
    return A.describe(common.cleaned(spark, sf_dir), CLEAN_NUMERIC)


# A9 / A10 ------------------------------------------------------------------
def _value_counts_sql(table: str, cols: list[str]) -> str:
    return union([
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS count, "
        f"{hround(f'{D} * count(*) / (SELECT count(*) FROM {table})')} AS pct FROM {table} "
        f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in cols])


@register("a09_value_counts", sql=W + "\n" + _value_counts_sql("joined", JOINED_STRINGS), doubles=("pct",))
def a09(spark, sf_dir):
    return A.value_counts(common.joined(spark, sf_dir), JOINED_STRINGS)


@register("a10_class_distribution", sql=W + f"""
SELECT Churn, count(*) AS count, {hround(f'{D} * count(*) / (SELECT count(*) FROM joined)')} AS pct
FROM joined WHERE Churn IS NOT NULL GROUP BY Churn""", doubles=("pct",))
def a10(spark, sf_dir):
    return A.class_distribution(common.joined(spark, sf_dir))


# A11 -----------------------------------------------------------------------
def _iqr_sql(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS "column", b.q1, b.q3, b.lower, b.upper,
  (SELECT count(*) FROM {table} t WHERE {x} < b.lower OR {x} > b.upper) AS outliers
FROM (SELECT q1, q3, q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) AS lower, q3 + CAST(1.5 AS DOUBLE) * (q3 - q1) AS upper
      FROM (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {table})) b""")
    return union(parts)


@register("a11_iqr_outliers", sql=W + "\n" + _iqr_sql("cleaned", IQR_COLS), doubles=("q1", "q3", "lower", "upper"))
def a11(spark, sf_dir):
    return A.iqr_outliers(common.cleaned(spark, sf_dir), IQR_COLS)


# A12 / A13 -----------------------------------------------------------------
@register("a12_correlation_matrix", sql=W + "\n" + union([
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM cleaned"
    for a in CORR_COLS for b in CORR_COLS]), doubles=("r",))
def a12(spark, sf_dir):
    return A.correlation_matrix(common.cleaned(spark, sf_dir), CORR_COLS)


@register("a13_target_correlation", sql=W + "\n" + union([
    f"SELECT '{a}' AS \"column\", corr(CAST({a} AS DOUBLE), CAST(Churn AS DOUBLE)) AS r FROM cleaned"
    for a in CORR_COLS[:-1]]), doubles=("r",))
def a13(spark, sf_dir):
    return A.target_correlation(common.cleaned(spark, sf_dir), CORR_COLS[:-1])


# A15 -----------------------------------------------------------------------
@register("a15_rate_extremes", sql=W + "\n" + union([f"""SELECT '{c}' AS "column",
  first(value ORDER BY rate DESC, value) AS highest_value, max(rate) AS highest_rate,
  first(value ORDER BY rate ASC, value) AS lowest_value, min(rate) AS lowest_rate
FROM (SELECT CAST({c} AS VARCHAR) AS value, avg(CAST(Churn AS DOUBLE)) AS rate FROM cleaned WHERE {c} IS NOT NULL GROUP BY {c})"""
    for c in C.PREP_CATEGORICAL_COLS]), doubles=("highest_rate", "lowest_rate"))
def a15(spark, sf_dir):
    return A.rate_extremes(common.cleaned(spark, sf_dir), C.PREP_CATEGORICAL_COLS)


# A16 -----------------------------------------------------------------------
@register("a16_key_insights", sql=W + """
SELECT o.overall_rate, o.r_tenure, o.r_monthly, e.highest_group, e.highest_rate, e.lowest_group, e.lowest_rate
FROM (SELECT avg(CAST(Churn AS DOUBLE)) AS overall_rate,
             corr(CAST(Tenure AS DOUBLE), CAST(Churn AS DOUBLE)) AS r_tenure,
             corr(CAST(MonthlyCharges AS DOUBLE), CAST(Churn AS DOUBLE)) AS r_monthly FROM cleaned) o,
     (SELECT first(ContractType ORDER BY rate DESC, ContractType) AS highest_group, max(rate) AS highest_rate,
             first(ContractType ORDER BY rate ASC, ContractType) AS lowest_group, min(rate) AS lowest_rate
      FROM (SELECT ContractType, avg(CAST(Churn AS DOUBLE)) AS rate FROM cleaned GROUP BY ContractType)) e""",
          doubles=("overall_rate", "r_tenure", "r_monthly", "highest_rate", "lowest_rate"))
def a16(spark, sf_dir):
    return A.key_insights(common.cleaned(spark, sf_dir))


# A17 -----------------------------------------------------------------------
@register("a17_class_histogram", sql=W + """
, rng AS (SELECT Churn, min(MonthlyCharges) AS lo, max(MonthlyCharges) AS hi FROM cleaned GROUP BY Churn),
binned AS (
  SELECT c.Churn, r.lo, r.hi,
    CAST(CASE WHEN r.hi = r.lo THEN 0
         ELSE least(floor((c.MonthlyCharges - r.lo) / ((r.hi - r.lo) / 30)), 29) END AS INTEGER) AS bin
  FROM cleaned c JOIN rng r USING (Churn) WHERE c.MonthlyCharges IS NOT NULL
)
SELECT Churn, bin, lo + bin * (hi - lo) / 30 AS bin_start, lo + (bin + 1) * (hi - lo) / 30 AS bin_end, count(*) AS count
FROM binned GROUP BY Churn, bin, lo, hi""".replace("\n, rng AS", ",\nrng AS"), doubles=("bin_start", "bin_end"))
def a17(spark, sf_dir):
    return A.class_histogram(common.cleaned(spark, sf_dir), "MonthlyCharges")


# A18 -----------------------------------------------------------------------
@register("a18_box_stats", sql=W + """,
long_t AS (
""" + union([f"  SELECT Churn, '{c}' AS \"column\", CAST({c} AS DOUBLE) AS x FROM cleaned WHERE {c} IS NOT NULL"
             for c in IQR_COLS]) + """
),
q AS (SELECT Churn, "column", quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
             quantile_cont(x, 0.75) AS q3 FROM long_t GROUP BY Churn, "column")
SELECT l.Churn, l."column", q.q1, q.median, q.q3,
  min(x) FILTER (WHERE x >= q.q1 - CAST(1.5 AS DOUBLE) * (q.q3 - q.q1) AND x <= q.q3 + CAST(1.5 AS DOUBLE) * (q.q3 - q.q1)) AS whisker_low,
  max(x) FILTER (WHERE x >= q.q1 - CAST(1.5 AS DOUBLE) * (q.q3 - q.q1) AND x <= q.q3 + CAST(1.5 AS DOUBLE) * (q.q3 - q.q1)) AS whisker_high,
  count(*) FILTER (WHERE NOT (x >= q.q1 - CAST(1.5 AS DOUBLE) * (q.q3 - q.q1) AND x <= q.q3 + CAST(1.5 AS DOUBLE) * (q.q3 - q.q1))) AS fliers
FROM long_t l JOIN q USING (Churn, "column")
GROUP BY l.Churn, l."column", q.q1, q.median, q.q3""",
          doubles=("q1", "median", "q3", "whisker_low", "whisker_high"))
def a18(spark, sf_dir):
    return A.box_stats(common.cleaned(spark, sf_dir), IQR_COLS)


# A19 / A20 -----------------------------------------------------------------
WS = with_ctes(joined_ctes(), split_ctes())


@register("a19_class_balance", sql=WS + """
SELECT count(*) FILTER (WHERE Churn = 0) AS n_negative, count(*) FILTER (WHERE Churn = 1) AS n_positive,
  CASE WHEN count(*) FILTER (WHERE Churn = 1) = 0 THEN NULL
       ELSE CAST(count(*) FILTER (WHERE Churn = 0) AS DOUBLE) / count(*) FILTER (WHERE Churn = 1) END AS imbalance_ratio
FROM with_folds WHERE split = 'train'""", doubles=("imbalance_ratio",))
def a19(spark, sf_dir):
    return A.class_balance(common.split_table(spark, sf_dir).where(F.col("split") == "train"))


@register("a20_split_summary", sql=WS + """
SELECT split, count(*) AS n_rows, avg(CAST(Churn AS DOUBLE)) AS churn_rate FROM with_folds GROUP BY split""",
          doubles=("churn_rate",))
def a20(spark, sf_dir):
    return A.split_summary(common.split_table(spark, sf_dir))


# A21 -----------------------------------------------------------------------
@register("a21_exploration_report", sql=W + """,
one AS (
  SELECT count(*) AS n_rows,
    """ + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in JOINED_COLS) + """ AS total_nulls,
    count(*) FILTER (WHERE trim(TotalCharges) = '') AS blank_count,
    count(*) FILTER (WHERE Churn = 'Yes') AS n_yes, count(*) FILTER (WHERE Churn = 'No') AS n_no
  FROM joined
)
""" + union([
    "SELECT 'rows' AS metric, CAST(n_rows AS DOUBLE) AS value FROM one",
    f"SELECT 'columns', CAST({len(JOINED_COLS)} AS DOUBLE) FROM one",
    "SELECT 'total_nulls', CAST(total_nulls AS DOUBLE) FROM one",
    "SELECT 'blank_TotalCharges', CAST(blank_count AS DOUBLE) FROM one",
    "SELECT 'Churn_Yes', CAST(n_yes AS DOUBLE) FROM one",
    "SELECT 'Churn_No', CAST(n_no AS DOUBLE) FROM one",
    f"SELECT 'Churn_Yes_pct', {hround(f'{D} * n_yes / n_rows')} FROM one",
]), doubles=("value",))
def a21(spark, sf_dir):
    return A.exploration_report(common.joined(spark, sf_dir))


# A22 -----------------------------------------------------------------------
def _eda_sql() -> str:
    eda_cols = JOINED_COLS + ["Churn_Flag"]
    cats = [c for c in JOINED_COLS if c not in ("CustomerID", "Churn", "Tenure", "SeniorCitizen", "MonthlyCharges",
                                                "TotalCharges")]

    def sec(section, item, metrics, src):
        return union([f"SELECT '{section}' AS section, CAST({item} AS VARCHAR) AS item, '{m}' AS metric, "
                      f"CAST({m} AS DOUBLE) AS value FROM ({src})" for m in metrics])

    nulls = "SELECT * FROM (" + union([
        f"SELECT '{c}' AS col, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
        f"{hround(f'{D} * count(*) FILTER (WHERE {c} IS NULL) / count(*)')} AS null_pct FROM eda" for c in eda_cols
    ]) + ") WHERE null_count > 0"
    describe = _describe_sql("eda", EDA_NUMERIC).replace('AS "column"', "AS col")
    vc = _value_counts_sql("eda", cats).replace('AS "column"', "AS col")
    vc = f"SELECT col || '=' || value AS item2, * FROM ({vc})"
    iqr = _iqr_sql("eda", OUTLIER_COLS).replace('AS "column"', "AS col")
    target = (f"SELECT Churn AS item2, count(*) AS count, {hround(f'{D} * count(*) / (SELECT count(*) FROM eda)')} AS pct "
              f"FROM eda WHERE Churn IS NOT NULL GROUP BY Churn")
    corr = union([f"SELECT '{a}' AS col, corr(CAST({a} AS DOUBLE), CAST(Churn_Flag AS DOUBLE)) AS r FROM eda"
                  for a in ["Tenure", "SeniorCitizen", "MonthlyCharges", "TotalCharges"]])
    rates = union([f"""SELECT '{c}' AS col, max(rate) AS highest_rate, min(rate) AS lowest_rate
FROM (SELECT {c} AS v, avg(CAST(Churn_Flag AS DOUBLE)) AS rate FROM eda WHERE {c} IS NOT NULL GROUP BY {c})"""
                   for c in C.PREP_CATEGORICAL_COLS])
    y = "CAST(Churn_Flag AS DOUBLE)"
    contracts = f"SELECT ContractType, avg({y}) AS rate FROM eda WHERE ContractType IS NOT NULL GROUP BY ContractType"
    dup = (f"SELECT CAST(count(*) - count(DISTINCT CustomerID) AS BIGINT) AS duplicate_keys, "
           f"(SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM eda GROUP BY "
           f"{', '.join(eda_cols)})) AS duplicate_rows FROM eda")
    body = union([
        sec("overview", "''", ["n_rows", "n_columns"], f"SELECT count(*) AS n_rows, {len(eda_cols)} AS n_columns FROM eda"),
        sec("missing", "col", ["null_count", "null_pct"], nulls),
        sec("duplicates", "'CustomerID'", ["duplicate_keys", "duplicate_rows"], dup),
        sec("summary", "col", ["count", "mean", "std", "min", "p25", "p50", "p75", "max"], describe),
        sec("categorical", "item2", ["count", "pct"], vc),
        sec("outliers", "col", ["q1", "q3", "lower", "upper", "outliers"], iqr),
        sec("target", "item2", ["count", "pct"], target),
        sec("correlation", "col", ["r"], corr),
        sec("rates", "col", ["highest_rate", "lowest_rate"], rates),
        sec("insights", "''", ["churn_rate", "r_tenure", "r_monthly_charges"],
            f"SELECT avg({y}) AS churn_rate, corr(CAST(Tenure AS DOUBLE), {y}) AS r_tenure, "
            f"corr(CAST(MonthlyCharges AS DOUBLE), {y}) AS r_monthly_charges FROM eda"),
        sec("insights", "ContractType", ["highest_rate"],
            f"SELECT ContractType, rate AS highest_rate FROM ({contracts}) ORDER BY rate DESC, ContractType LIMIT 1"),
        sec("insights", "ContractType", ["lowest_rate"],
            f"SELECT ContractType, rate AS lowest_rate FROM ({contracts}) ORDER BY rate, ContractType LIMIT 1"),
    ])
    return W + """,
eda AS (
  SELECT * REPLACE (TRY_CAST(trim(TotalCharges) AS DOUBLE) AS TotalCharges),
         CAST(Churn IS NOT DISTINCT FROM 'Yes' AS INTEGER) AS Churn_Flag
  FROM joined
)
""" + body


@register("a22_eda_report", sql=_eda_sql(), doubles=("value",))
def a22(spark, sf_dir):
    return eda_report(common.joined(spark, sf_dir))
