"""Customer snapshot derived from the order tables (FIXTURES.md §3).

The attrition tables (contracts, demographics, usage) are not part of the
driver test data, so they are derived with Spark from
``customer ⋈ orders ⋈ lineitem ⋈ part``. The work grows with the order
tables:

* ``orders`` is aggregated per customer in a single ``groupBy`` (partial
  aggregation map-side, one shuffle on the customer key); the "last order" is a
  ``max`` over a struct ordered by (date, key), so every value is valid.
* ``orders`` is scanned a second time, for keys only, for the add-on flags.
* returned line items are filtered at the scan, joined to the seven brands
  that drive the add-on flags and to history orders on the order key, then
  reduced to seven 0/1 flags per customer (again partial aggregation first).
* the per-customer results are joined to ``customer`` on the key; every side
  is one row per customer, so there is no fan-out and no hot key after the
  aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# ---------------------------------------------------------------------------
# Fixed values of the snapshot definition.
# ---------------------------------------------------------------------------
CUTOFF = "2000-08-01 00:00:00"
DAYS_PER_MONTH = 30.4375
ADDON_BRANDS = {
    "MultipleLines": "Brand#1",
    "OnlineSecurity": "Brand#2",
    "OnlineBackup": "Brand#3",
    "DeviceProtection": "Brand#4",
    "TechSupport": "Brand#5",
    "StreamingTV": "Brand#6",
    "StreamingMovies": "Brand#7",
}
PLANTED_LOGIT = {
    "intercept": -1.6,
    "month_to_month": 1.1,
    "two_year": -1.0,
    "tenure": -0.03,
    "tenure_center": 48,
    "fiber": 0.9,
    "monthly": 0.003,
    "monthly_center": 250,
    "senior": 0.3,
    "dependents": -0.3,
}
# ---------------------------------------------------------------------------

WIDE_COLUMNS = [
    "CustomerID", "Tenure", "ContractType", "PaymentMethod", "PaperlessBilling",
    "Gender", "SeniorCitizen", "Dependents", "Partner",
    "MonthlyCharges", "TotalCharges", "PhoneService", "MultipleLines", "InternetService",
    "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
    "StreamingTV", "StreamingMovies", "Churn", "ChurnP", "ChurnObserved",
]


def key_hash(key: Column, salt: str) -> Column:
    """First 8 hex digits of md5(key || '-' || salt) as a bigint."""
    digest = F.md5(F.concat(key.cast("string"), F.lit("-" + salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def _cents(c: Column) -> Column:
    return F.round(c * 100).cast("bigint")


def _last_order() -> Column:
    """Date, key, contract code, billing code and price of an order, ordered by date, then key; any value is valid."""
    priority = F.col("o_orderpriority")
    contract_code = F.when(priority.isin("1-URGENT", "2-HIGH"), 0).when(priority == "3-MEDIUM", 1).otherwise(2)
    return F.struct(
        F.to_date(F.col("o_orderdate")).alias("day"), F.col("o_orderkey").alias("key"),
        contract_code.alias("contract"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("billing"),
        _cents(F.col("o_totalprice")).alias("cents"))


def _yes_no(cond: Column) -> Column:
    return F.when(cond, F.lit("Yes")).otherwise(F.lit("No"))


def snapshot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw 21-column customer table plus the planted probability and the observed label."""
    cutoff = F.lit(CUTOFF).cast("timestamp_ntz")  # order dates are zone-less timestamps
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    in_history = F.col("o_orderdate") < cutoff

    per_customer = (
        orders.groupBy("o_custkey")
        .agg(
            F.min(F.when(in_history, F.col("o_orderdate"))).alias("first_dt"),
            F.max(F.when(in_history, _last_order())).alias("last_order"),
            F.sum(F.when(in_history, _cents(F.col("o_totalprice")))).alias("hist_cents"),
            F.count_if(F.col("o_orderdate") >= cutoff).alias("n_future"),
        )
        .where(F.col("first_dt").isNotNull())
    )

    brands = list(ADDON_BRANDS.values())
    returned = read_table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R").select("l_orderkey", "l_partkey")
    brand_parts = read_table(spark, sf_dir, "part").where(F.col("p_brand").isin(brands)).select("p_partkey", "p_brand")
    hist_orders = orders.where(in_history).select("o_orderkey", "o_custkey")
    flags = (
        returned.join(brand_parts, returned.l_partkey == brand_parts.p_partkey)
        .join(hist_orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey")
        .agg(*[F.max((F.col("p_brand") == b).cast("int")).alias(f"b_{name}") for name, b in ADDON_BRANDS.items()])
        .withColumnRenamed("o_custkey", "f_custkey")
    )

    base = customer.join(per_customer, customer.c_custkey == per_customer.o_custkey).join(
        flags, F.col("c_custkey") == F.col("f_custkey"), "left"
    )

    last = F.col("last_order")
    last_date = last["day"]
    tenure = F.floor(F.datediff(last_date, F.to_date(F.col("first_dt"))) / F.lit(DAYS_PER_MONTH)).cast("int")
    contract_code = last["contract"]
    contract = (
        F.when(contract_code == 0, "Month-to-month")
        .when(contract_code == 1, "One year")
        .otherwise("Two year")
    )
    payment = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "Electronic check")
        .when(F.col("c_mktsegment") == "BUILDING", "Mailed check")
        .when(F.col("c_mktsegment") == "FURNITURE", "Bank transfer (automatic)")
        .otherwise("Credit card (automatic)")
    )
    key = F.col("c_custkey")
    nation_mod = F.col("c_nationkey") % 5
    internet = F.when(nation_mod == 0, "No").when(nation_mod.isin(1, 2), "DSL").otherwise("Fiber optic")
    phone = key_hash(key, "phone") % 10 < 9
    monthly = F.floor(last["cents"] / F.lit(1000.0)) / F.lit(100.0)
    total = F.floor(F.col("hist_cents") / F.lit(1000.0)) / F.lit(100.0)

    step1 = base.select(
        F.col("c_custkey"),
        F.col("c_name").alias("CustomerID"),
        tenure.alias("Tenure"),
        contract.alias("ContractType"),
        payment.alias("PaymentMethod"),
        F.when(last["billing"] == 0, "No").otherwise("Yes").alias("PaperlessBilling"),
        F.when(key_hash(key, "gender") % 2 == 0, "Male").otherwise("Female").alias("Gender"),
        (key_hash(key, "sr") % 100 < 16).cast("int").alias("SeniorCitizen"),
        _yes_no(key_hash(key, "dep") % 100 < 30).alias("Dependents"),
        _yes_no(key_hash(key, "partner") % 100 < 48).alias("Partner"),
        monthly.alias("MonthlyCharges"),
        total.alias("total_num"),
        _yes_no(phone).alias("PhoneService"),
        internet.alias("InternetService"),
        *[F.coalesce(F.col(f"b_{name}"), F.lit(0)).alias(f"b_{name}") for name in ADDON_BRANDS],
        F.when(F.col("n_future") == 0, "Yes").otherwise("No").alias("ChurnObserved"),
    )

    p = PLANTED_LOGIT
    z = (
        F.lit(p["intercept"])
        + F.lit(p["month_to_month"]) * (F.col("ContractType") == "Month-to-month").cast("int")
        + F.lit(p["two_year"]) * (F.col("ContractType") == "Two year").cast("int")
        + F.lit(p["tenure"]) * (F.col("Tenure") - F.lit(p["tenure_center"]))
        + F.lit(p["fiber"]) * (F.col("InternetService") == "Fiber optic").cast("int")
        + F.lit(p["monthly"]) * (F.col("MonthlyCharges") - F.lit(p["monthly_center"]))
        + F.lit(p["senior"]) * F.col("SeniorCitizen")
        + F.lit(p["dependents"]) * (F.col("Dependents") == "Yes").cast("int")
    )
    churn_p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def addon(name: str) -> Column:
        if name == "MultipleLines":
            return F.when(F.col("PhoneService") == "No", "No phone service").otherwise(
                _yes_no(F.col(f"b_{name}") == 1)
            )
        return F.when(F.col("InternetService") == "No", "No internet service").otherwise(
            _yes_no(F.col(f"b_{name}") == 1)
        )

    return step1.select(
        "CustomerID", "Tenure", "ContractType", "PaymentMethod", "PaperlessBilling",
        "Gender", "SeniorCitizen", "Dependents", "Partner", "MonthlyCharges",
        F.when(F.col("Tenure") == 0, F.lit(" ")).otherwise(F.col("total_num").cast("string")).alias("TotalCharges"),
        "PhoneService",
        addon("MultipleLines").alias("MultipleLines"),
        "InternetService",
        *[addon(n).alias(n) for n in list(ADDON_BRANDS)[1:]],
        _yes_no(key_hash(F.col("c_custkey"), "churn") / F.lit(4294967296.0) < churn_p).alias("Churn"),
        churn_p.alias("ChurnP"),
        "ChurnObserved",
    )
