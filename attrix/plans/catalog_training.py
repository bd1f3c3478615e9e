"""Registered model-training queries (rows-only checks: fits are not SQL-expressible)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..operators import evaluate as E
from ..operators import models as M
from ..operators.models import FIXED_MODEL
from ..sqlcheck import eval_sql as ES
from ..sqlcheck.model_sql import scored_ctes
from ..sqlcheck.parts import joined_ctes, split_ctes, with_ctes
from . import common
from . import training as T
from .catalog import register
from .catalog_model import WFE as WFIT
from .catalog_model import _names_sql


def _val_predictions(name: str, prm: dict | None = None):
    def run(spark, sf_dir):
        data, _ = T.model_data(spark, sf_dir)
        model = T.fit(name, data.where(F.col("split") == "train"), prm)
        return T.predictions(model, data.where(F.col("split") == "val")).select(C.KEY_COL, "y", "p")
    return run


register("m03_logistic_regression")(_val_predictions("logistic_regression", {"C": 1.0, "l1_ratio": 0.0}))
register("m04_logistic_l1")(_val_predictions("logistic_regression", {"C": 1.0, "l1_ratio": 1.0, "max_iter": 2000}))
register("m05_random_forest")(_val_predictions("random_forest", {"n_trees": 300}))
register("m06_boosted_trees")(_val_predictions("boosted_trees", {"rounds": 300, "depth": 4, "rate": 0.1}))


@register("m07_cv_scores")
def m07(spark, sf_dir):
    data, _ = T.model_data(spark, sf_dir)
    return T.cv_summary(spark, data)


@register("m08_validation_scores")
def m08(spark, sf_dir):
    data, _ = T.model_data(spark, sf_dir)
    return T.validation_scores(spark, data)


@register("m09_model_comparison")
def m09(spark, sf_dir):
    """J2 + M9: CV summary left-joined with validation scores on ``model``; best by CV recall flagged."""
    data, _ = T.model_data(spark, sf_dir)
    with ThreadPoolExecutor(max_workers=2) as pool:  # folds and refits at once
        cv, val = pool.submit(T.cv_summary, spark, data), pool.submit(T.validation_scores, spark, data)
    return M.model_comparison(cv.result(), val.result())


def _rules(spark, sf_dir):
    """(model, split, fold, y, p): the fixed model and two rules of thumb over every customer."""
    fe, bundle = common.fitted(spark, sf_dir)
    contract = F.col("ContractType")
    scores = {"fixed_model": bundle.scorer.probability(bundle.params), "tenure_rule": 1.0 / (1.0 + F.col("Tenure") / 12.0),
              "contract_rule": F.when(contract == "Month-to-month", 0.6).when(contract == "One year", 0.3).otherwise(0.1)}
    return reduce(DataFrame.unionAll, [fe.select(F.lit(m).alias("model"), "split", "fold", F.col(C.TARGET_COL).alias("y"), p.alias("p"))
                                       for m, p in scores.items()])


def _scores_sql(rows: str, by: str) -> str:
    """Scores at 0.50 of every group, the AUC by average ranks."""
    return f"""SELECT {by}, {ES.div0('tp', 'tp + fn')} AS recall, {ES.div0('tp', 'tp + fp')} AS precision,
  {ES.div0('2 * tp', '2 * tp + fp + fn')} AS f1,
  CASE WHEN P = 0 OR N = 0 THEN NULL ELSE (sum_r - P * (P + 1) / 2.0) / (CAST(P AS DOUBLE) * N) END AS roc_auc
FROM (SELECT {by}, sum(r) FILTER (WHERE y = 1) AS sum_r, count(*) FILTER (WHERE y = 1) AS P, count(*) FILTER (WHERE y <> 1) AS N,
    count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y <> 1) AS fp,
    count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn
  FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY p) + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2.0 AS r FROM {rows})
  GROUP BY {by})"""


_RULES_SQL = with_ctes(joined_ctes(), split_ctes(), scored_ctes()) + """,
rules AS (
  SELECT 'fixed_model' AS model, split, fold, Churn AS y, p FROM scored
  UNION ALL SELECT 'tenure_rule', split, fold, Churn, CAST(1 AS DOUBLE) / (1 + Tenure / CAST(12 AS DOUBLE)) FROM scored
  UNION ALL SELECT 'contract_rule', split, fold, Churn, CAST(CASE ContractType WHEN 'Month-to-month' THEN 0.6 WHEN 'One year' THEN 0.3
    ELSE 0.1 END AS DOUBLE) FROM scored
)"""
_METRICS = ("recall", "roc_auc", "precision", "f1")


@register("m17_rule_comparison", sql=_RULES_SQL + f""",
cv AS (SELECT model, {', '.join(f'avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std' for m in _METRICS)}
  FROM ({_scores_sql("(SELECT * FROM rules WHERE split = 'train')", 'model, fold')}) GROUP BY model),
val AS ({_scores_sql("(SELECT * FROM rules WHERE split = 'val' AND model <> 'tenure_rule')", 'model')})
SELECT cv.*, {', '.join(f'val.{m} AS val_{m}' for m in _METRICS)},
  cv.model = (SELECT model FROM cv ORDER BY recall_mean DESC, model LIMIT 1) AS best_by_cv_recall
FROM cv LEFT JOIN val ON val.model = cv.model""",
          doubles=tuple(f"{m}_{s}" for m in _METRICS for s in ("mean", "std")) + tuple(f"val_{m}" for m in _METRICS))
def m17(spark, sf_dir):
    """M7 + M8 + J2 + M9 on fixed scores; one model was not validated, so its row has no match."""
    rules = _rules(spark, sf_dir)
    cv = M.summarize_folds(E.scores_by(rules.where("split = 'train'"), ["model", "fold"]))
    return M.model_comparison(cv, E.scores_by(rules.where("split = 'val' and model <> 'tenure_rule'"), ["model"]))


@register("m18_weight_by_source", sql=WFIT + f""",
names AS (SELECT * FROM ({_names_sql()})),
weights AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {ES.dl(abs(w))})" for n, w in FIXED_MODEL.weights.items())}) AS w(name, weight))
SELECT source_column, sum(coalesce(weight, 0)) AS importance FROM names LEFT JOIN weights USING (name) GROUP BY source_column""",
          doubles=("importance",))
def m18(spark, sf_dir):
    """M15 on a fixed input: the fixed model's absolute weights summed back to their source columns."""
    _, bundle = common.fitted(spark, sf_dir)
    weights = [abs(FIXED_MODEL.weights.get(n, 0.0)) for _, n, _ in bundle.params.feature_names()]
    return M.importance_by_source(M.importance_table(spark, weights, bundle.params))


@register("m10_grid_search")
def m10(spark, sf_dir):
    data, _ = T.model_data(spark, sf_dir)
    return T.search_table(spark, T.search_results(spark, data, "grid"))


@register("m11_random_search")
def m11(spark, sf_dir):
    data, _ = T.model_data(spark, sf_dir)
    return T.search_table(spark, T.search_results(spark, data, "random"))


@register("m12_tuning_comparison")
def m12(spark, sf_dir):
    data, _ = T.model_data(spark, sf_dir)
    return T.tuning_comparison(spark, data)


@register("m13_untuned_baseline")
def m13(spark, sf_dir):
    data, _ = T.model_data(spark, sf_dir)
    model = T.fit("logistic_regression", data.where(F.col("split") == "train"))
    pred = T.predictions(model, data.where(F.col("split") == "val"))
    s = T.scores(pred)
    return spark.createDataFrame([("untuned_logistic_regression", float(s["recall"]), M.optional(s["roc_auc"]),
                                   float(s["precision"]), float(s["f1"]))],
                                 "model string, recall double, roc_auc double, precision double, f1 double")


@register("m14_feature_importance")
def m14(spark, sf_dir):
    data, bundle = T.model_data(spark, sf_dir)
    return T.feature_importance(spark, data, bundle.params)


@register("m15_importance_by_source")
def m15(spark, sf_dir):
    data, bundle = T.model_data(spark, sf_dir)
    return M.importance_by_source(T.feature_importance(spark, data, bundle.params))
