"""Registered queries: one per operator of the inventory, each with its DuckDB oracle text.

Every query reads the driver tables (through the snapshot derived from
them), so its work grows with the data. ``doubles`` lists the floating
columns that both sides round to 6 decimals before hashing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as X
from ..operators import profile as A
from ..sources.snapshot import snapshot_wide
from ..sqlcheck.parts import fe_ctes, joined_ctes, split_ctes, with_ctes
from ..sqlcheck.snapshot_sql import snapshot_ctes
from . import common


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    doubles: list[str] = field(default_factory=list)


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, doubles: tuple[str, ...] = ()):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, list(doubles))
        return fn
    return deco


def final_sql(q: Query) -> str | None:
    if q.sql is None:
        return None
    if not q.doubles:
        return q.sql
    s = "CAST(1000000 AS DOUBLE)"
    rep = ", ".join(f"CAST(floor(CAST({c} AS DOUBLE) * {s} + CAST(0.5 AS DOUBLE)) AS DOUBLE) / {s} AS {c}" for c in q.doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{q.sql}\n) AS q_final"


def spark_query(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return common.round_doubles(q.fn(spark, sf_dir))
    run.__name__ = q.name
    return run


# ---------------------------------------------------------------------------
# Sources and joins
# ---------------------------------------------------------------------------
@register("s04_split_sources_usage", sql=with_ctes(snapshot_ctes()) + "\nSELECT * FROM usage_t",
          doubles=("MonthlyCharges",))
def s4_usage(spark, sf_dir):
    from ..sources.customer import source_tables
    return source_tables(spark, sf_dir)["usage"]


@register("s09_load_joined", sql=with_ctes(joined_ctes()) + "\nSELECT * FROM joined", doubles=("MonthlyCharges",))
def s9_joined(spark, sf_dir):
    return common.joined(spark, sf_dir)


@register("x22_clean", sql=with_ctes(joined_ctes()) + "\nSELECT * FROM cleaned",
          doubles=("MonthlyCharges", "TotalCharges"))
def x22_clean(spark, sf_dir):
    return common.cleaned(spark, sf_dir)


_FE_ALL = fe_ctes("cleaned", "(SELECT median(TotalCharges) FROM cleaned)")


@register("x11_engineer_features", sql=with_ctes(joined_ctes(), _FE_ALL) + "\nSELECT * FROM fe",
          doubles=("MonthlyCharges", "TotalCharges", "AvgMonthlySpend", "ChargeDiff"))
def x11_fe(spark, sf_dir):
    c = common.cleaned(spark, sf_dir)
    return X.engineer_features(c, common.exact_median(c, "TotalCharges"))


@register(
    "a14_rate_by_contract",
    sql=with_ctes(joined_ctes(), _FE_ALL) + """
SELECT ContractType, count(*) AS n, avg(Churn) AS churn_rate, avg(ChargeDiff) AS mean_charge_diff
FROM fe GROUP BY ContractType""",
    doubles=("churn_rate", "mean_charge_diff"),
)
def a14_rate_by_contract(spark, sf_dir):
    c = common.cleaned(spark, sf_dir)
    fe = X.engineer_features(c, common.exact_median(c, "TotalCharges"))
    return A.rate_by(fe, "ContractType", extra={"mean_charge_diff": F.avg("ChargeDiff")})


@register(
    "d01_stratified_split",
    sql=with_ctes(joined_ctes(), split_ctes()) + """
SELECT split, Churn, count(*) AS n_rows FROM with_folds GROUP BY split, Churn""",
)
def d1_split(spark, sf_dir):
    return common.split_table(spark, sf_dir).groupBy("split", C.TARGET_COL).agg(F.count(F.lit(1)).alias("n_rows"))


# Registration of the remaining query groups (import order = registry order).
from . import catalog_profile  # noqa: E402,F401
from . import catalog_model  # noqa: E402,F401
from . import catalog_training  # noqa: E402,F401
from . import catalog_io  # noqa: E402,F401
from . import catalog_dirty  # noqa: E402,F401
