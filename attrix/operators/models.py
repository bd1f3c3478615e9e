"""Model jobs.

Single fits of logistic regression are Spark ML estimators on the ``features`` vector built by
``apply_prep``; searches, folds and boosted trees are the sweeps of ``batched`` and ``boosting``, forests are ``forest``.
``LinearScorer`` is the scoring side with literal coefficients: the
probability is a built-in expression over the feature expressions, which
keeps scoring inside whole-stage codegen and gives an exact SQL twin.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .prep import PrepParams, feature_exprs, to_vector


# M1 / M2 -------------------------------------------------------------------
def balanced_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """w_c = n / (2 n_c): one aggregation, two scalars, then a narrow projection."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("n1")).first()
    n, n1 = int(r["n"]), int(r["n1"])
    n0 = n - n1
    w1 = n / (2.0 * n1) if n1 else 0.0
    w0 = n / (2.0 * n0) if n0 else 0.0
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(w1)).otherwise(F.lit(w0)))


def pos_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """scale_pos_weight = neg/pos on positives, 1 elsewhere."""
    r = df.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).first()
    spw = (r["neg"] / r["pos"]) if r["pos"] else 1.0
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(spw))).otherwise(F.lit(1.0)))


# M3 / M4 / M5 -----------------------------------------------------------
def logistic_regression(C_: float = 1.0, l1_ratio: float = 0.0, max_iter: int = 1000, weight_sum: float | None = None):
    """Weighted LR; the penalty 1/(2C)||w||^2 + sum(w_i loss_i) maps to regParam = 1/(C * sum w)."""
    from pyspark.ml.classification import LogisticRegression

    reg = 1.0 / (C_ * weight_sum) if weight_sum else 1.0 / C_
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                              regParam=reg, elasticNetParam=float(l1_ratio), maxIter=max_iter,
                              standardization=False, fitIntercept=True, tol=1e-6)


def random_forest(n_trees: int = 300, seed: int = C.RANDOM_STATE, max_depth: int = 30):
    """Trees without a depth limit of their own; 30 is the deepest that Spark ML grows.

    Spark ML's forest shuffles a histogram for each of the deep trees' nodes and holds all nodes on the driver.
    """
    from .forest import Forest

    return Forest(n_trees, max_depth, seed)


def model_input(df: DataFrame, params: PrepParams, target: str = C.TARGET_COL, key: str = C.KEY_COL,
                extra: Sequence[str] = ()) -> DataFrame:
    """(key, label, features vector, extra...) for Spark ML; the key travels with the row."""
    arr = F.array(*feature_exprs(params)).alias("features")
    base = df.select(key, F.col(target).cast("double").alias("label"), arr, *extra)
    return to_vector(base)


def probability_col(pred: DataFrame, out: str = "p") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return pred.withColumn(out, vector_to_array(F.col("probability"))[1])


# M7 / M8 -------------------------------------------------------------------
def optional(x) -> float | None:
    """A float, or None where a measure is undefined (an AUC of one class)."""
    return None if x is None else float(x)


def mean(values: Sequence[float | None]) -> float | None:
    """Mean of the defined values."""
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else None


def summarize_folds(folds: DataFrame) -> DataFrame:
    """M7: mean and population std per model and metric; an undefined AUC is left out."""
    aggs = []
    for c in ("recall", "roc_auc", "precision", "f1"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return folds.groupBy("model").agg(*aggs)


def summarize_cv(spark, rows_by_model: Mapping[str, list[dict]]) -> DataFrame:
    """M7 of scores that the driver holds."""
    flat = [(m, int(r["fold"]), float(r["recall"]), optional(r["roc_auc"]), float(r["precision"]), float(r["f1"]))
            for m, rows in rows_by_model.items() for r in rows]
    return summarize_folds(spark.createDataFrame(flat, "model string, fold int, recall double, roc_auc double, precision double, f1 double"))


def model_comparison(cv: DataFrame, validation: DataFrame, metric: str = "recall_mean") -> DataFrame:
    """J2 + M9: CV summary left-joined with validation scores; the model of the highest ``metric`` (first by name) is flagged."""
    val = validation.select("model", *[F.col(c).alias(f"val_{c}") for c in ("recall", "roc_auc", "precision", "f1")])
    comp = cv.join(val, "model", "left")  # both sides: one row per model
    best = cv.orderBy(F.col(metric).desc_nulls_last(), F.col("model")).limit(1).select("model").scalar()
    return comp.withColumn("best_by_cv_recall", F.col("model") == best)


# M10 / M11 / M12 -------------------------------------------------------------
def grid_params(cs: Sequence[float] = C.GRID_C, ratios: Sequence[float] = C.GRID_L1_RATIO) -> list[dict]:
    return [{"C": float(c), "l1_ratio": float(r)} for c in cs for r in ratios]


def random_params(n: int = C.RANDOM_SEARCH_DRAWS, lo_hi=C.RANDOM_C_RANGE, seed: int = C.RANDOM_STATE,
                  ratios: Sequence[float] = C.GRID_L1_RATIO) -> list[dict]:
    """C log-uniform on [lo, hi], penalty drawn uniformly; seeded on the driver."""
    rng = random.Random(seed)
    lo, hi = math.log(lo_hi[0]), math.log(lo_hi[1])
    return [{"C": math.exp(rng.uniform(lo, hi)), "l1_ratio": float(rng.choice(list(ratios)))} for _ in range(n)]


def search_winner(grid: Sequence[dict], rand: Sequence[dict]) -> dict:
    """Best of each search; grid wins ties (>=)."""
    auc = lambda r: -1.0 if r["mean_roc_auc"] is None else r["mean_roc_auc"]
    g = max(grid, key=auc) if grid else None
    r = max(rand, key=auc) if rand else None
    if g is not None and (r is None or auc(g) >= auc(r)):
        return {**g, "search": "grid"}
    return {**r, "search": "random"}


# M14 / M15 -----------------------------------------------------------------
def importance_table(spark, importances: Sequence[float], params: PrepParams) -> DataFrame:
    names = params.feature_names()
    rows = [(i, n, s, float(importances[i])) for i, n, s in names]
    df = spark.createDataFrame(rows, "idx int, feature string, source_column string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("idx"))


def importance_by_source(importance: DataFrame) -> DataFrame:
    """Dummy importances summed back to their source column."""
    return importance.groupBy("source_column").agg(F.sum("importance").alias("importance"))


# M16 -----------------------------------------------------------------------
@dataclass
class LinearScorer:
    """Logistic model with literal coefficients keyed by feature name."""

    intercept: float
    weights: dict[str, float]

    def logit(self, params: PrepParams) -> Column:
        exprs = feature_exprs(params)
        z = F.lit(float(self.intercept))
        for (i, name, _), e in zip(params.feature_names(), exprs):
            w = self.weights.get(name, 0.0)
            if w:
                z = z + F.lit(float(w)) * e
        return z

    def probability(self, params: PrepParams) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.logit(params)))


# A fixed demonstration model over the engineered layout (scaled numerics,
# one-hot categories, 0/1 binaries); literal values chosen by us.
FIXED_MODEL = LinearScorer(
    intercept=-1.2,
    weights={
        "Tenure": -0.8,
        "MonthlyCharges": 0.5,
        "TotalCharges": -0.2,
        "TotalServices": -0.1,
        "AvgMonthlySpend": 0.1,
        "ChargeDiff": 0.05,
        "ContractType_Month-to-month": 0.9,
        "ContractType_Two year": -0.9,
        "InternetService_Fiber optic": 0.7,
        "InternetService_No": -0.4,
        "PaymentMethod_Electronic check": 0.3,
        "TenureBucket_0-12": 0.4,
        "SeniorCitizen": 0.3,
        "Dependents": -0.3,
        "Partner": -0.1,
        "PaperlessBilling": 0.2,
    },
)
