"""DuckDB twins of the flawed source tables and serving records (``attrix.sources.dirty``)."""

from __future__ import annotations

from ..sources.dirty import NUMBERS, RECORDS
from .parts import hash_sql
from .snapshot_sql import snapshot_ctes


def _pct(salt: str) -> str:
    return f"{hash_sql('CustomerID', salt)} % 100"


def _lit(v) -> str:
    if v is None:
        return "NULL"
    return f"'{v}'" if isinstance(v, str) else f"CAST('{v!r}' AS DOUBLE)" if isinstance(v, float) else str(v)


def number_sql(col: str) -> str:
    return (f"CASE WHEN regexp_full_match(trim({col}), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') "
            f"THEN TRY_CAST(trim({col}) AS DOUBLE) END")


def dirty_ctes() -> str:
    """dirty_contracts, dirty_demographics, dirty_usage after the snapshot's CTEs."""
    junk = " ".join(f"WHEN u >= {lo} AND u < {hi} THEN {_lit(v)}" for lo, hi, v in reversed(NUMBERS))
    key = "CASE WHEN c >= 18 AND c < 20 THEN NULL ELSE CustomerID END AS CustomerID"
    return snapshot_ctes() + f""",
hashed AS (
  SELECT *, {_pct('contracts')} AS c, {_pct('demographics')} AS d, {_pct('usage')} AS u FROM raw
),
dirty_contracts AS (
  SELECT {key}, Tenure, ContractType, PaymentMethod, PaperlessBilling, Churn FROM hashed WHERE c >= 3
  UNION ALL
  SELECT {key}, Tenure, ContractType, PaymentMethod, PaperlessBilling, Churn FROM hashed WHERE c >= 10 AND c < 15
  UNION ALL
  SELECT {key}, Tenure + 1, ContractType, PaymentMethod, PaperlessBilling, Churn FROM hashed WHERE c >= 15 AND c < 18
),
dirty_demographics AS (
  SELECT CustomerID, Gender, SeniorCitizen, Dependents, Partner FROM hashed WHERE d >= 2
  UNION ALL
  SELECT CustomerID, Gender, SeniorCitizen, Dependents, Partner FROM hashed WHERE d >= 50 AND d < 53
),
dirty_usage AS (
  SELECT CustomerID, MonthlyCharges, CASE {junk} ELSE TotalCharges END AS TotalCharges, PhoneService, MultipleLines, InternetService,
    OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport, StreamingTV, StreamingMovies FROM hashed WHERE u >= 4
)"""


def dirty_records_cte(source: str = "serving", name: str = "dirty") -> str:
    cols: dict[str, str] = {}
    for k, (col, lo, hi, v) in enumerate(RECORDS):
        p = _pct(f"flaw{k}")
        cols[col] = f"CASE WHEN {p} >= {lo} AND {p} < {hi} THEN {_lit(v)} ELSE {cols.get(col, col)} END"
    return f""",
{name} AS (SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in cols.items())}) FROM {source})"""
