"""Flawed stand-ins of the source tables and serving records, for the operators that look for flaws.

Derived from the customer snapshot by hashes of the id (fixed values: the shares and the wrong values below), so both the rows
and their flaws grow with the tables: ids that a source lacks or has twice, rows that are there twice, missing ids, text
that is no number, values outside their domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..operators.ranks import hash32
from .customer import split_sources

# Hash percent from (inclusive) and to (exclusive), and what stands there instead.
NUMBERS = [(20, 22, "NaN"), (22, 24, "12d"), (24, 26, "7f"), (26, 28, " 1.5e2 "), (28, 30, "1,000"), (30, 32, ""),
           (32, 33, "inf"), (33, 34, None), (34, 36, ".5"), (36, 37, "-3."), (37, 38, "abc"), (38, 39, "0x1A")]
RECORDS = [("Gender", 0, 2, "Robot"), ("Gender", 2, 3, None), ("ContractType", 3, 5, "Weekly"), ("Tenure", 5, 7, 121),
           ("Tenure", 7, 8, None), ("MonthlyCharges", 8, 10, -100.0), ("TotalCharges", 10, 12, 20000.5),
           ("PhoneService", 12, 14, 2), ("SeniorCitizen", 14, 15, None), ("CustomerID", 15, 18, None), ("Tenure", 0, 1, -1)]


def percent(salt: str) -> Column:
    return hash32(F.col(C.KEY_COL), salt) % 100


def between(p: Column, lo: int, hi: int) -> Column:
    return (p >= lo) & (p < hi)


def dirty_sources(raw: DataFrame) -> dict[str, DataFrame]:
    """contracts, demographics and usage with lost, repeated and missing keys and text that is no number."""
    t = split_sources(raw)
    c, d, u = percent("contracts"), percent("demographics"), percent("usage")
    contracts = t["contracts"].where(c >= 3)
    contracts = contracts.unionAll(contracts.where(between(c, 10, 15))).unionAll(
        contracts.where(between(c, 15, 18)).withColumn("Tenure", F.col("Tenure") + 1))
    contracts = contracts.withColumn(C.KEY_COL, F.when(~between(c, 18, 20), F.col(C.KEY_COL)))
    demographics = t["demographics"].where(d >= 2)
    demographics = demographics.unionAll(demographics.where(between(d, 50, 53)))
    total = F.col("TotalCharges")
    for lo, hi, value in NUMBERS:
        total = F.when(between(u, lo, hi), F.lit(value).cast("string")).otherwise(total)
    usage = t["usage"].where(u >= 4).withColumn("TotalCharges", total)
    return {"contracts": contracts, "demographics": demographics, "usage": usage}


def dirty_records(records: DataFrame) -> DataFrame:
    """Serving records with values outside their domain; a record can have several flaws."""
    out = {}
    for k, (col, lo, hi, value) in enumerate(RECORDS):
        flawed = F.when(between(percent(f"flaw{k}"), lo, hi), F.lit(value).cast(records.schema[col].dataType))
        out[col] = flawed.otherwise(out.get(col, F.col(col)))
    return records.withColumns(out)
