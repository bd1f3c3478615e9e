"""DuckDB twin of the customer snapshot, used as a CTE prefix by every oracle query.

Independent SQL text over the same driver views (orders, customer,
lineitem, part); the Spark side is ``attrix.sources.snapshot``.
"""

from __future__ import annotations


def h(salt: str) -> str:
    return f"('0x' || substr(md5(CAST(c.c_custkey AS VARCHAR) || '-{salt}'), 1, 8))::BIGINT"


def _yn(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 'Yes' ELSE 'No' END"


_ADDONS = [
    ("MultipleLines", 1), ("OnlineSecurity", 2), ("OnlineBackup", 3), ("DeviceProtection", 4),
    ("TechSupport", 5), ("StreamingTV", 6), ("StreamingMovies", 7),
]


def snapshot_ctes() -> str:
    """``WITH`` body (no leading WITH) defining raw, contracts, demographics, usage."""
    flag_cols = ",\n    ".join(
        f"max(CASE WHEN p.p_brand = 'Brand#{k}' THEN 1 ELSE 0 END) AS b{k}" for _, k in _ADDONS
    )
    addon_cols = []
    for name, k in _ADDONS:
        if name == "MultipleLines":
            addon_cols.append(
                f"CASE WHEN s.PhoneService = 'No' THEN 'No phone service' "
                f"ELSE {_yn(f'coalesce(s.b{k}, 0) = 1')} END AS {name}"
            )
        else:
            addon_cols.append(
                f"CASE WHEN s.InternetService = 'No' THEN 'No internet service' "
                f"ELSE {_yn(f'coalesce(s.b{k}, 0) = 1')} END AS {name}"
            )
    first_addon = addon_cols[0]
    other_addons = ",\n    ".join(addon_cols[1:])
    return f"""
hist AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderdate < TIMESTAMP '2000-08-01 00:00:00'
),
hist_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM hist
),
hist_agg AS (
  SELECT o_custkey, min(o_orderdate) AS first_dt,
         sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS hist_cents
  FROM hist GROUP BY o_custkey
),
last_order AS (
  SELECT o_custkey, o_orderdate AS last_dt, o_orderpriority AS last_priority,
         o_orderstatus AS last_status, o_totalprice AS last_price
  FROM hist_ranked WHERE rn = 1
),
future AS (
  SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-08-01 00:00:00'
),
brand_flags AS (
  SELECT hh.o_custkey,
    {flag_cols}
  FROM lineitem l
  JOIN part p ON p.p_partkey = l.l_partkey
  JOIN hist hh ON hh.o_orderkey = l.l_orderkey
  WHERE l.l_returnflag = 'R'
  GROUP BY hh.o_custkey
),
snap1 AS (
  SELECT
    c.c_custkey,
    c.c_name AS CustomerID,
    CAST(floor(date_diff('day', CAST(a.first_dt AS DATE), CAST(lo.last_dt AS DATE)) / 30.4375) AS INTEGER) AS Tenure,
    CASE WHEN lo.last_priority IN ('1-URGENT', '2-HIGH') THEN 'Month-to-month'
         WHEN lo.last_priority = '3-MEDIUM' THEN 'One year' ELSE 'Two year' END AS ContractType,
    CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'Electronic check'
         WHEN 'BUILDING' THEN 'Mailed check'
         WHEN 'FURNITURE' THEN 'Bank transfer (automatic)'
         ELSE 'Credit card (automatic)' END AS PaymentMethod,
    CASE WHEN lo.last_status = 'F' THEN 'No' ELSE 'Yes' END AS PaperlessBilling,
    CASE WHEN {h('gender')} % 2 = 0 THEN 'Male' ELSE 'Female' END AS Gender,
    CAST({h('sr')} % 100 < 16 AS INTEGER) AS SeniorCitizen,
    {_yn(h('dep') + ' % 100 < 30')} AS Dependents,
    {_yn(h('partner') + ' % 100 < 48')} AS Partner,
    floor(CAST(round(lo.last_price * 100) AS BIGINT) / 1000.0) / 100.0 AS MonthlyCharges,
    floor(a.hist_cents / 1000.0) / 100.0 AS total_num,
    {_yn(h('phone') + ' % 10 < 9')} AS PhoneService,
    CASE WHEN c.c_nationkey % 5 = 0 THEN 'No' WHEN c.c_nationkey % 5 IN (1, 2) THEN 'DSL'
         ELSE 'Fiber optic' END AS InternetService,
    bf.b1, bf.b2, bf.b3, bf.b4, bf.b5, bf.b6, bf.b7,
    CASE WHEN f.o_custkey IS NULL THEN 'Yes' ELSE 'No' END AS ChurnObserved,
    {h('churn')} / 4294967296.0 AS churn_u
  FROM customer c
  JOIN hist_agg a ON a.o_custkey = c.c_custkey
  JOIN last_order lo ON lo.o_custkey = c.c_custkey
  LEFT JOIN brand_flags bf ON bf.o_custkey = c.c_custkey
  LEFT JOIN future f ON f.o_custkey = c.c_custkey
),
snap2 AS (
  SELECT *,
    1.0 / (1.0 + exp(-(
      -1.6
      + 1.1 * CAST(ContractType = 'Month-to-month' AS INTEGER)
      - 1.0 * CAST(ContractType = 'Two year' AS INTEGER)
      - 0.03 * (Tenure - 48)
      + 0.9 * CAST(InternetService = 'Fiber optic' AS INTEGER)
      + 0.003 * (MonthlyCharges - 250)
      + 0.3 * SeniorCitizen
      - 0.3 * CAST(Dependents = 'Yes' AS INTEGER)
    ))) AS ChurnP
  FROM snap1
),
raw AS (
  SELECT
    s.CustomerID, s.Tenure, s.ContractType, s.PaymentMethod, s.PaperlessBilling,
    s.Gender, s.SeniorCitizen, s.Dependents, s.Partner, s.MonthlyCharges,
    CASE WHEN s.Tenure = 0 THEN ' ' ELSE CAST(s.total_num AS VARCHAR) END AS TotalCharges,
    s.PhoneService,
    {first_addon},
    s.InternetService,
    {other_addons},
    CASE WHEN s.churn_u < s.ChurnP THEN 'Yes' ELSE 'No' END AS Churn,
    s.ChurnP,
    s.ChurnObserved
  FROM snap2 s
),
contracts AS (
  SELECT CustomerID, Tenure, ContractType, PaymentMethod, PaperlessBilling, Churn FROM raw
),
demographics AS (
  SELECT CustomerID, Gender, SeniorCitizen, Dependents, Partner FROM raw
),
usage_t AS (
  SELECT CustomerID, MonthlyCharges, TotalCharges, PhoneService, MultipleLines, InternetService,
         OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport, StreamingTV, StreamingMovies FROM raw
)"""
