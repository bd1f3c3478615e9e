"""Reusable DuckDB CTE texts for the oracle queries (independent of the Spark code)."""

from __future__ import annotations

from .. import config as C
from .snapshot_sql import snapshot_ctes


def binmap(c: str) -> str:
    return f"CASE {c} WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 WHEN 'Male' THEN 1 WHEN 'Female' THEN 0 END"


def joined_ctes() -> str:
    return snapshot_ctes() + """,
joined AS (
  SELECT * FROM contracts JOIN demographics USING (CustomerID) JOIN usage_t USING (CustomerID)
),
cleaned AS (
  SELECT * REPLACE (
    TRY_CAST(trim(TotalCharges) AS DOUBLE) AS TotalCharges,
    CAST(coalesce(Churn, '') = 'Yes' AS INTEGER) AS Churn,
""" + ",\n".join(f"    {binmap(c)} AS {c}" for c in C.BINARY_MAP_COLS) + """
  ) FROM joined
)"""


def total_services_sql() -> str:
    terms = [f"CAST(coalesce({c} = 'Yes', false) AS INTEGER)" for c in C.ADDON_SERVICE_COLS]
    return " + ".join(terms) + " + PhoneService + CAST(NOT (InternetService IS NOT DISTINCT FROM 'No') AS INTEGER)"


def bucket_sql(col: str = "Tenure") -> str:
    parts = [
        f"WHEN {col} > {lo} AND {col} <= {hi} THEN '{lab}'"
        for lo, hi, lab in zip(C.TENURE_EDGES[:-1], C.TENURE_EDGES[1:], C.TENURE_LABELS)
    ]
    return "CASE " + " ".join(parts) + " ELSE 'nan' END"


def fe_ctes(source: str, median_expr: str, name: str = "fe") -> str:
    """Engineered table ``name`` from CTE ``source``; ``median_expr`` is a scalar SQL expression."""
    return f""",
{name}_filled AS (
  SELECT * REPLACE (coalesce(TotalCharges, {median_expr}) AS TotalCharges) FROM {source}
),
{name} AS (
  SELECT * EXCLUDE (PhoneService),
    {total_services_sql()} AS TotalServices,
    TotalCharges / CASE WHEN Tenure < 1 THEN 1 ELSE Tenure END AS AvgMonthlySpend,
    MonthlyCharges - TotalCharges / CASE WHEN Tenure < 1 THEN 1 ELSE Tenure END AS ChargeDiff,
    {bucket_sql()} AS TenureBucket
  FROM {name}_filled
)"""


def hash_sql(expr: str, salt: str) -> str:
    return f"('0x' || substr(md5(CAST({expr} AS VARCHAR) || '-{salt}'), 1, 8))::BIGINT"


def split_ctes(source: str = "cleaned", seed: int = C.RANDOM_STATE, k: int = C.N_FOLDS) -> str:
    """Stratified 70/15/15 split + k folds on the train part, by hash rank inside each class."""
    tr, va, _ = C.SPLIT_FRACTIONS
    a, b = int(round(tr * 100)), int(round((tr + va) * 100))
    return f""",
ranked AS (
  SELECT *,
    row_number() OVER (PARTITION BY Churn ORDER BY {hash_sql('CustomerID', f'split{seed}')}, CustomerID) AS _r,
    count(*) OVER (PARTITION BY Churn) AS _n
  FROM {source}
),
splitted AS (
  SELECT * EXCLUDE (_n),
    CASE WHEN _r <= (({a} * _n + 50) // 100) THEN 'train'
         WHEN _r <= (({b} * _n + 50) // 100) THEN 'val' ELSE 'test' END AS split
  FROM ranked
),
with_folds AS (
  SELECT * EXCLUDE (_r), CAST(CASE WHEN split = 'train' THEN (_r - 1) % {k} END AS INTEGER) AS fold
  FROM splitted
)"""


def with_ctes(*bodies: str) -> str:
    return "WITH " + "".join(bodies)
