"""Registered queries over flawed tables: duplicates, lost keys, fan-out, rejected records, text that is no number."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as X
from ..operators import profile as A
from ..operators import scoring as I
from ..operators.value_table import value_table
from ..sources.customer import load_joined, multiplicity_audit, snapshot_table
from ..sources.dirty import dirty_records, dirty_sources
from ..sqlcheck.dirty_sql import dirty_ctes, dirty_records_cte, number_sql
from ..sqlcheck.parts import with_ctes
from . import common
from .catalog import register
from .catalog_io import _rules_sql
from .catalog_model import _bundle_and_records, _serving_sql

W = with_ctes(dirty_ctes())
SOURCES = ("contracts", "demographics", "usage")
_SERVED = _serving_sql() + dirty_records_cte()


def _tables(spark, sf_dir):
    return dirty_sources(snapshot_table(spark, sf_dir))


@register("x01_dirty_to_number", sql=W + f"""
SELECT CustomerID, TotalCharges AS TotalCharges_raw, {number_sql('TotalCharges')} AS TotalCharges_num FROM dirty_usage""",
          doubles=("TotalCharges_num",))
def x01_dirty(spark, sf_dir):
    """X1 over text with NaN, suffixes, separators, exponents and blanks."""
    u = _tables(spark, sf_dir)["usage"]
    return u.select(C.KEY_COL, F.col("TotalCharges").alias("TotalCharges_raw"), X.to_number("TotalCharges").alias("TotalCharges_num"))


@register("x12_dirty_validate", sql=_SERVED + "\nSELECT CASE WHEN " + " AND ".join(
    f"coalesce({cond}, false)" for _, cond in _rules_sql()) + " THEN 'valid' ELSE 'rejected' END AS status, count(*) AS n_rows FROM dirty GROUP BY 1")
def x12_dirty(spark, sf_dir):
    """X12 over records of which some break rules."""
    valid, rejected = X.validate(dirty_records(common.serving_records(spark, sf_dir)))
    return valid.select(F.lit("valid").alias("status")).unionByName(rejected.select(F.lit("rejected").alias("status"))) \
        .groupBy("status").agg(F.count(F.lit(1)).alias("n_rows"))


@register("x13_dirty_violations", sql=_SERVED + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{name}' AS rule, count(*) AS n_rows FROM dirty WHERE NOT coalesce({cond}, false) HAVING count(*) > 0"
    for name, cond in _rules_sql()))
def x13_dirty(spark, sf_dir):
    """X13 over records of which some break rules, one or several each."""
    return X.violation_summary(X.validate(dirty_records(common.serving_records(spark, sf_dir)))[1])


@register("x18_dirty_default_id", sql=_SERVED + """
SELECT coalesce(CustomerID, 'UNKNOWN') AS customer_id, count(*) AS n FROM dirty GROUP BY 1""")
def x18_dirty(spark, sf_dir):
    """X18 over scored records of which some have no id."""
    bundle, recs = _bundle_and_records(spark, sf_dir)
    return I.score_records(dirty_records(recs), bundle).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))


@register("a06_dirty_duplicates", sql=W + """
SELECT CAST((SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM dirty_contracts GROUP BY CustomerID)) AS BIGINT) AS duplicate_keys,
  CAST((SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM dirty_contracts GROUP BY ALL)) AS BIGINT) AS duplicate_rows"""
          .replace("GROUP BY ALL", "GROUP BY CustomerID, Tenure, ContractType, PaymentMethod, PaperlessBilling, Churn"))
def a06_dirty(spark, sf_dir):
    """A6 + A7 over a source with repeated keys, repeated rows and missing keys."""
    return A.duplicate_report(_tables(spark, sf_dir)["contracts"])


@register("a04_dirty_nulls", sql=W + "\nSELECT * FROM (\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM {t}"
    for t, c in (("dirty_contracts", "CustomerID"), ("dirty_contracts", "Tenure"), ("dirty_usage", "TotalCharges"))) + "\n) WHERE null_count > 0")
def a04_dirty(spark, sf_dir):
    """A4 from the value-count tables of two flawed sources."""
    t = _tables(spark, sf_dir)
    parts = [value_table(t[s], cols).nulls() for s, cols in (("contracts", ["CustomerID", "Tenure"]), ("usage", ["TotalCharges"]))]
    return parts[0].unionByName(parts[1]).select("column", F.col("null_count").cast("bigint").alias("null_count"))


@register("j01_dirty_join", sql=W + """
SELECT ContractType, count(*) AS n_rows, count(DISTINCT CustomerID) AS n_keys
FROM dirty_contracts JOIN dirty_demographics USING (CustomerID) JOIN dirty_usage USING (CustomerID) GROUP BY ContractType""")
def j01_dirty(spark, sf_dir):
    """J1 with unmatched, missing and repeated keys: rows vanish and multiply."""
    return load_joined(_tables(spark, sf_dir)).groupBy("ContractType").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(C.KEY_COL).alias("n_keys"))


def _audit_sql() -> str:
    joined = "dirty_contracts JOIN dirty_demographics USING (CustomerID) JOIN dirty_usage USING (CustomerID)"
    parts = []
    for s in SOURCES:
        others = " AND ".join(f"CustomerID IN (SELECT CustomerID FROM dirty_{o} WHERE CustomerID IS NOT NULL)" for o in SOURCES if o != s)
        kept = f"(SELECT count(*) FROM dirty_{s} WHERE CustomerID IS NOT NULL AND {others})"
        parts.append(f"""SELECT '{s}' AS source, (SELECT count(*) FROM dirty_{s}) AS n_rows,
  (SELECT count(*) FROM dirty_{s} WHERE CustomerID IS NULL) AS null_key_rows,
  (SELECT count(*) FROM (SELECT CustomerID FROM dirty_{s} WHERE CustomerID IS NOT NULL GROUP BY CustomerID HAVING count(*) > 1)) AS repeated_keys,
  (SELECT count(DISTINCT CustomerID) FROM dirty_{s} WHERE CustomerID IS NOT NULL AND NOT ({others})) AS lost_keys,
  (SELECT count(*) FROM dirty_{s}) - {kept} AS lost_rows, (SELECT count(*) FROM {joined}) - {kept} AS fan_out_rows,
  (SELECT count(DISTINCT CustomerID) FROM {joined}) AS matched_keys""")
    parts.append(f"""SELECT 'joined', (SELECT count(*) FROM {joined}), 0,
  (SELECT count(*) FROM (SELECT CustomerID FROM {joined} GROUP BY CustomerID HAVING count(*) > 1)), 0, 0, 0,
  (SELECT count(DISTINCT CustomerID) FROM {joined})""")
    return "\nUNION ALL\n".join(parts)


@register("j04_dirty_multiplicity", sql=W + "\n" + _audit_sql())
def j04_dirty(spark, sf_dir):
    """J4 over flawed sources: lost rows, repeated keys and the join's rows, told without joining."""
    r = multiplicity_audit(_tables(spark, sf_dir))
    return r.select(F.coalesce("source", F.lit("joined")).alias("source"), F.col("rows").cast("bigint").alias("n_rows"), *[
        F.col(c).cast("bigint").alias(c) for c in ("null_key_rows", "repeated_keys", "lost_keys", "lost_rows", "fan_out_rows", "matched_keys")])
