"""Row-wise operators (X1-X22) as Column expressions.

Everything here is a built-in Catalyst expression, so it stays inside
whole-stage codegen; there is no Python on the row path.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# X1 ------------------------------------------------------------------------
#: A decimal number; a cast alone would also take ``NaN`` and the type suffixes of ``12d`` and ``7f``.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def to_number(c: str | Column) -> Column:
    """Numeric coercion: blank or malformed text, NaN and infinity become NULL (never an error)."""
    text = F.trim(_col(c).cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


# X2 ------------------------------------------------------------------------
def label_flag(c: str | Column, positive: str = "Yes") -> Column:
    """1 when the value equals ``positive``, else 0 (NULL included)."""
    return (F.coalesce(_col(c), F.lit("")) == positive).cast("int")


# X3 ------------------------------------------------------------------------
def strict_map(c: str | Column, mapping: Mapping[str, int] = C.BINARY_VALUE_MAP) -> Column:
    """Dictionary map; values outside the dictionary (and NULL) become NULL."""
    x = _col(c).cast("string")
    expr = None
    for k, v in mapping.items():
        expr = (F.when(x == k, F.lit(v)) if expr is None else expr.when(x == k, F.lit(v)))
    return expr.otherwise(F.lit(None).cast("int"))


# X4 ------------------------------------------------------------------------
def lenient_map(c: str | Column, mapping: Mapping[str, int] = C.BINARY_VALUE_MAP) -> Column:
    """Dictionary map that keeps unmapped values (0/1 pass through as numbers)."""
    x = _col(c).cast("string")
    expr = None
    for k, v in mapping.items():
        expr = (F.when(x == k, F.lit(v)) if expr is None else expr.when(x == k, F.lit(v)))
    return expr.otherwise(x.try_cast("int"))


def lenient_map_columns(df: DataFrame, cols: Sequence[str] = C.BINARY_MAP_COLS,
                        mapping: Mapping[str, int] = C.BINARY_VALUE_MAP) -> DataFrame:
    """X4 applied only to the listed columns that exist in ``df``."""
    present = {c: lenient_map(c, mapping) for c in cols if c in df.columns}
    return df.withColumns(present) if present else df


# X5 ------------------------------------------------------------------------
def fill_null(c: str | Column, value) -> Column:
    return F.coalesce(_col(c), F.lit(value))


# X6 / X7 -------------------------------------------------------------------
def has_internet(internet: str | Column = "InternetService") -> Column:
    """1 unless the value is exactly 'No' (NULL counts as having internet)."""
    return (~_col(internet).eqNullSafe("No")).cast("int")


def total_services(addons: Sequence[str] = C.ADDON_SERVICE_COLS, phone: str = "PhoneService",
                   internet: str = "InternetService") -> Column:
    """Count of 'Yes' add-ons + phone flag + internet flag; a NULL phone flag makes it NULL."""
    total = None
    for a in addons:
        term = _col(a).eqNullSafe("Yes").cast("int")
        total = term if total is None else total + term
    return total + _col(phone) + has_internet(internet)


# X8 / X9 -------------------------------------------------------------------
def avg_monthly_spend(total: str = "TotalCharges", tenure: str = "Tenure") -> Column:
    """total / max(tenure, 1); NULL tenure stays NULL."""
    t = _col(tenure)
    return _col(total) / F.when(t < 1, F.lit(1)).otherwise(t)


def charge_diff(monthly: str = "MonthlyCharges", avg: str | Column = "AvgMonthlySpend") -> Column:
    return _col(monthly) - _col(avg)


# X10 -----------------------------------------------------------------------
def tenure_bucket(tenure: str | Column = "Tenure", edges: Sequence[float] = C.TENURE_EDGES,
                  labels: Sequence[str] = C.TENURE_LABELS, other: str = C.TENURE_OUT_OF_RANGE) -> Column:
    """Right-closed bins (lo, hi]; outside every bin (or NULL) -> ``other``."""
    t = _col(tenure)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (t > lo) & (t <= hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(other))


# X11 -----------------------------------------------------------------------
def engineer_features(df: DataFrame, total_charges_median: float,
                      drop_cols: Sequence[str] = C.DROP_WEAK_COLS) -> DataFrame:
    """Fill TotalCharges with the train median, then derive the five engineered columns."""
    filled = df.withColumn("TotalCharges", fill_null("TotalCharges", float(total_charges_median)))
    avg = avg_monthly_spend()
    out = filled.withColumns({
        "TotalServices": total_services(),
        "HasInternetService": has_internet(),
        "AvgMonthlySpend": avg,
        "ChargeDiff": charge_diff(avg=avg),
        "TenureBucket": tenure_bucket(),
    })
    return out.drop(*drop_cols)


# X12 / X13 -----------------------------------------------------------------
def validation_rules(enums: Mapping[str, Sequence[str]] = C.ENUMS) -> list[tuple[str, Column]]:
    """Rule table for serving records: (rule name, condition that must hold)."""
    rules: list[tuple[str, Column]] = []
    for col, allowed in enums.items():
        rules.append((f"{col}:required", F.col(col).isNotNull()))
        rules.append((f"{col}:enum", F.col(col).isNull() | F.col(col).isin(*allowed)))
    for col in ("SeniorCitizen", "PhoneService"):
        rules.append((f"{col}:required", F.col(col).isNotNull()))
        rules.append((f"{col}:binary", F.col(col).isNull() | F.col(col).isin(0, 1)))
    lo, hi = C.TENURE_RANGE
    rules.append(("Tenure:required", F.col("Tenure").isNotNull()))
    rules.append(("Tenure:range", F.col("Tenure").isNull() | F.col("Tenure").between(lo, hi)))
    lo, hi = C.MONTHLY_RANGE
    rules.append(("MonthlyCharges:required", F.col("MonthlyCharges").isNotNull()))
    rules.append(("MonthlyCharges:range", F.col("MonthlyCharges").isNull() | F.col("MonthlyCharges").between(lo, hi)))
    lo, hi = C.TOTAL_RANGE
    rules.append(("TotalCharges:range", F.col("TotalCharges").isNull() | F.col("TotalCharges").between(lo, hi)))
    return rules


def violations(rules: Sequence[tuple[str, Column]] | None = None) -> Column:
    """Array of the names of the rules a row breaks (empty when valid)."""
    rules = validation_rules() if rules is None else rules
    arr = F.array(*[F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules])
    return F.filter(arr, lambda x: x.isNotNull())


def validate(df: DataFrame, rules=None) -> tuple[DataFrame, DataFrame]:
    """Split into (valid rows, quarantined rows with their ``violations``)."""
    tagged = df.withColumn("violations", violations(rules))
    valid = tagged.where(F.size("violations") == 0).drop("violations")
    rejected = tagged.where(F.size("violations") > 0)
    return valid, rejected


def violation_summary(rejected: DataFrame) -> DataFrame:
    """Number of rows breaking each rule."""
    return (rejected.select(F.explode("violations").alias("rule"))
            .groupBy("rule").agg(F.count(F.lit(1)).alias("n_rows")))


# X14 - X18 -----------------------------------------------------------------
def decision(p: str | Column, threshold: float | Column) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (_col(p) >= t).cast("int")


def label_text(pred: str | Column) -> Column:
    return F.when(_col(pred) == 1, F.lit("Churn")).otherwise(F.lit("No Churn"))


def risk_tier(p: str | Column, threshold: float | Column,
              critical: float = C.CRITICAL_CUTOFF, medium: float = C.MEDIUM_CUTOFF) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pc = _col(p)
    return (F.when(pc >= critical, F.lit("Critical"))
            .when(pc >= t, F.lit("High"))
            .when(pc >= medium, F.lit("Medium"))
            .otherwise(F.lit("Low")))


def round_prob(p: str | Column, digits: int = 4) -> Column:
    return F.round(_col(p), digits)


def half_even_round(c: str | Column, digits: int = 2) -> Column:
    """Round half to even on the scaled binary value (x * 10^d, rint, / 10^d), as array libraries do."""
    scale = float(10 ** digits)
    return F.rint(_col(c).cast("double") * F.lit(scale)) / F.lit(scale)


def default_id(c: str | Column, default: str = "UNKNOWN") -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(default))


# X19 -----------------------------------------------------------------------
def total_charges_fallback(total: str = "TotalCharges", tenure: str = "Tenure",
                           monthly: str = "MonthlyCharges") -> Column:
    """Missing or zero total charges replaced by tenure x monthly."""
    return F.coalesce(F.nullif(_col(total), F.lit(0.0)), _col(tenure) * _col(monthly))


# X20 -----------------------------------------------------------------------
RETENTION_ACTIONS = [
    ("Critical", 1, "Immediate outreach by a retention specialist with a tailored offer"),
    ("High", 2, "Proactive contact with a contract upgrade or loyalty discount"),
    ("Medium", 3, "Targeted engagement campaign and service check-in"),
    ("Low", 4, "Standard relationship nurturing"),
]


def retention_actions(spark) -> DataFrame:
    """Four-row lookup table tier -> (priority, action); joined with a broadcast hint (fixed size)."""
    return spark.createDataFrame(RETENTION_ACTIONS, "risk_tier string, action_priority int, action string")


def with_retention_action(scored: DataFrame, tier_col: str = "risk_tier") -> DataFrame:
    actions = retention_actions(scored.sparkSession)
    return scored.join(F.broadcast(actions), scored[tier_col] == actions["risk_tier"], "left").drop(actions["risk_tier"])


# X21 -----------------------------------------------------------------------
def regularisation_label(l1_ratio: str | Column) -> Column:
    r = _col(l1_ratio)
    return (F.when(r == 0.0, F.lit("L2")).when(r == 1.0, F.lit("L1"))
            .otherwise(F.concat(F.lit("ElasticNet("), r.cast("string"), F.lit(")"))))


# X22 -----------------------------------------------------------------------
def clean(df: DataFrame, cfg: C.FeatureConfig = C.FE_CONFIG, total_col: str = "TotalCharges") -> DataFrame:
    """Typed table: numeric TotalCharges, 0/1 label, strict 0/1 binary columns."""
    updates = {total_col: to_number(total_col), cfg.target: label_flag(cfg.target)}
    for c in cfg.binary_map_cols:
        if c in df.columns:
            updates[c] = strict_map(c, cfg.binary_value_map)
    return df.withColumns(updates)
