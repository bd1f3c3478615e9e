"""Training, cross-validation and tuning plans.

The model input (key, label, features, split, fold) is built once from the
prepared split table and its lineage is cut with ``checkpoint()`` in the
shared checkpoint folder; every fit reads it. Searches and folds of logistic
regression are one batched fit, boosted trees of all folds grow together, and
forests grow in ``forest``, several at a time. Held-out predictions of
all folds and models are one table, scored by (model, fold) in one plan.
"""

from __future__ import annotations

import hashlib
import json
import threading
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators import batched, boosting
from ..operators import evaluate as E
from ..operators import models as M
from ..operators.blocks import packed_rows
from ..session import shared_dir
from . import common


def model_data(spark: SparkSession, sf_dir: str):
    """(data, params): checkpointed model input for every customer plus the fitted prep parameters."""
    shared_dir(spark)
    fe, bundle = common.fitted(spark, sf_dir)
    data = M.model_input(fe, bundle.params, extra=["split", "fold", *C.FAIRNESS_COLS])
    return data.checkpoint(), bundle


def _weighted(df: DataFrame) -> DataFrame:
    return M.balanced_weights(df)


def make_estimator(name: str, train: DataFrame, prm: dict | None = None):
    prm = prm or {}
    if name == "logistic_regression":
        ws = train.agg(F.sum("weight")).first()[0]
        return M.logistic_regression(prm.get("C", 1.0), prm.get("l1_ratio", 0.0), prm.get("max_iter", 1000), ws)
    if name == "random_forest":
        return M.random_forest(prm.get("n_trees", 300))
    raise ValueError(name)


MODELS = ("logistic_regression", "random_forest", "boosted_trees")


def fit(name: str, train: DataFrame, prm: dict | None = None, weighted: bool = True):
    """A model fitted on ``train``, with balanced class weights or with all weights 1 (boosted trees weigh the positives)."""
    if name == "boosted_trees":
        return boosted(train, prm or {})[0]
    tr = _weighted(train) if weighted else train.withColumn("weight", F.lit(1.0))
    return make_estimator(name, tr, prm).fit(tr)


def _width(data: DataFrame) -> int:
    row = data.select(F.size(vector_to_array("features")).alias("n")).first()
    return row["n"] if row else 0


def boosted(train: DataFrame, prm: dict, leave_out: Sequence[int | None] = (None,)) -> list[boosting.BoostedModel]:
    """M6: Newton boosting with neg / pos of all rows of ``train`` as the weight of positives."""
    n = train.agg(F.count_if(F.col("label") == 0).alias("neg"), F.count_if(F.col("label") == 1).alias("pos")).first()
    settings = boosting.BoostSettings(prm.get("rounds", 300), prm.get("depth", 4), prm.get("rate", 0.1),
                                      positive_weight=n["neg"] / n["pos"] if n["pos"] else 1.0)
    rows = train.withColumn("x", vector_to_array("features"))
    return boosting.fit_boosted(rows, "x", "label", _width(train), settings, "fold" if "fold" in train.columns else None, leave_out,
                                n["neg"] + n["pos"])


def boosted_kept(data: DataFrame, left_out: Sequence[int | None]) -> dict[int | None, boosting.BoostedModel]:
    """The boosted models of all train rows but those of each fold of ``left_out`` (None: of all train rows), grown once."""
    kept = fitted_once(data.sparkSession, data, f"boosted-{'train' if None in left_out else 'folds'}", list(left_out), lambda: [
        m.to_dict() for m in boosted(_train(data), {}, left_out)])
    return dict(zip(left_out, map(boosting.BoostedModel.from_dict, kept)))


def predictions(model, df: DataFrame) -> DataFrame:
    if isinstance(model, boosting.BoostedModel):
        pred = df.withColumn("p", boosting.boosted_probability(vector_to_array("features"), {0: model}))
    elif isinstance(model, batched.Fitted):
        pred = df.withColumn("p", linear_probability(vector_to_array("features"), {0: model}))
    else:
        pred = M.probability_col(model.transform(df))
    return pred.select(C.KEY_COL, F.col("label").cast("int").alias("y"), "p", *[c for c in C.FAIRNESS_COLS if c in df.columns])


def scores(pred: DataFrame, threshold: float = C.DEFAULT_THRESHOLD) -> dict:
    m = E.threshold_metrics(pred, threshold).first()
    auc = E.roc_auc(pred).first()["roc_auc"]
    return {"recall": m["recall"], "roc_auc": auc, "precision": m["precision"], "f1": m["f1"]}


def linear_probability(features: Column, models: dict[int, batched.Fitted], which: Column | None = None) -> Column:
    """Probability of class 1 under the logistic model with the number ``which`` (the only one, without it)."""
    numbers = list(models)
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in (*models[k].coefficients, models[k].intercept)]) for k in numbers])
    at = F.lit(1) if which is None else F.array_position(F.array(*[F.lit(k) for k in numbers]), which).cast("int")
    of = F.element_at(rows, at)
    products = F.zip_with(F.concat(features, F.array(F.lit(1.0))), of, lambda x, b: x * b)
    return 1.0 / (1.0 + F.exp(-F.aggregate(products, F.lit(0.0), lambda a, v: a + v)))


def _train(data: DataFrame) -> DataFrame:
    return data.where(F.col("split") == "train")


def batch_fit(data: DataFrame, problems: Sequence[batched.Problem]) -> list[batched.Fitted]:
    """Logistic regressions on the train split, all in the same sweeps."""
    train = _train(data).withColumn("x", vector_to_array("features"))
    width = _width(train)
    blocks = packed_rows(train, "x", ["label", "fold"], width, train.count())
    try:
        return batched.fit_batch(blocks, problems, width, C.N_FOLDS)
    finally:
        blocks.unpersist()


def search_predictions(data: DataFrame, fitted: Sequence[batched.Fitted]) -> DataFrame:
    """(params, fold, y, p): every train row under each parameter set's model that left the row's fold out.

    ``fitted`` holds the models by (parameter set, fold); a row gives one row a parameter set.
    """
    by_fold = {}
    for k, f in enumerate(fitted):
        by_fold.setdefault(f.problem.fold, []).append((k // C.N_FOLDS, *f.coefficients, f.intercept))
    matrix = {fold: np.array(rows) for fold, rows in by_fold.items()}

    def score(frames):
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame["x"].to_numpy())
            for fold, rows in frame.groupby("fold"):
                own = matrix[int(fold)]
                p = 1 / (1 + np.exp(-(x[rows.index] @ own[:, 1:-1].T + own[:, -1])))
                yield pd.DataFrame({"params": np.tile(own[:, 0].astype(int), len(rows)), "fold": int(fold),
                                    "y": np.repeat(rows["y"].to_numpy(), len(own)), "p": p.ravel()})

    rows = _train(data).select(vector_to_array("features").alias("x"), "fold", F.col("label").cast("int").alias("y"))
    return rows.mapInPandas(score, "params int, fold int, y int, p double")


def fold_predictions(data: DataFrame, name: str, prm: dict | None = None, parallelism: int = C.N_FOLDS) -> DataFrame:
    """(fold, y, p): every train row under the model that left its fold out."""
    train, folds = _train(data), range(C.N_FOLDS)
    x, keep = vector_to_array("features"), ["fold", F.col("label").cast("int").alias("y")]
    if name == "logistic_regression":
        prm = prm or {}
        models = batch_fit(data, [batched.Problem(prm.get("C", 1.0), prm.get("l1_ratio", 0.0), f) for f in folds])
        return train.select(*keep, linear_probability(x, dict(zip(folds, models)), F.col("fold")).alias("p"))
    if name == "boosted_trees":
        models = boosted_kept(data, list(folds)) if not prm else dict(zip(folds, boosted(train, prm, list(folds))))
        return train.select(*keep, boosting.boosted_probability(x, {f: models[f] for f in folds}, F.col("fold")).alias("p"))

    def one(f: int) -> DataFrame:
        model = fit(name, train.where(F.col("fold") != f), prm)
        return M.probability_col(model.transform(train.where(F.col("fold") == f))).select(*keep, "p")

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, folds))


def data_digest(data: DataFrame) -> str:
    """A digest of every row of the model input (order does not matter)."""
    cols = [F.to_json(F.struct(F.col(c))) if c == "features" else F.col(c).cast("string") for c in data.columns]
    h = F.xxhash64(*[F.coalesce(c, F.lit("")) for c in cols]).cast("decimal(38,0)")
    row = data.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("a"), F.sum(h % 1_000_003).alias("b")).first()
    return f"{row['n']}-{row['a']}-{row['b']}"


#: Raised when fits or scores change, so that results of earlier code are never read.
FIT_VERSION = 6


def fitted_once(spark: SparkSession, data: DataFrame, name: str, settings, build):
    """Results of fits, kept in the shared folder under a digest of the data, the settings and the code version.

    Other data, splits, parameter sets or fits give another key, so a result is only read where the same fit on the
    same rows would be repeated.
    """
    with _LOCKS.setdefault(name, threading.Lock()):  # threads that want the same fit wait for one
        return _fitted_once(spark, data, name, settings, build)


_LOCKS: dict[str, threading.Lock] = {}


def _fitted_once(spark: SparkSession, data: DataFrame, name: str, settings, build):
    text = json.dumps([name, FIT_VERSION, settings, data_digest(data), C.RANDOM_STATE, C.N_FOLDS], sort_keys=True)
    base = shared_dir(spark).rstrip("/")
    path = f"{base}/fits/{name}-{hashlib.sha256(text.encode()).hexdigest()}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        spark.createDataFrame([(json.dumps(build()),)], "value string").write.mode("overwrite").text(path)
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def _plain(scores_: dict) -> dict:
    return {k: M.optional(v) for k, v in scores_.items()}


METRICS = ("recall", "roc_auc", "precision", "f1")


def _fold_scores(data: DataFrame, names: Sequence[str]) -> list[list[dict]]:
    """Scores of every model and fold, from one table of all held-out predictions."""
    with ThreadPoolExecutor(max_workers=len(names)) as pool:
        parts = list(pool.map(lambda n: fold_predictions(data, n), names))
    every = reduce(DataFrame.unionByName, [p.withColumn("model", F.lit(n)) for n, p in zip(names, parts)]).checkpoint()  # scored once
    found = {}
    for r in E.scores_by(every, ["model", "fold"]).collect():  # models x folds rows
        found.setdefault(r["model"], []).append({"fold": r["fold"], **_plain({m: r[m] for m in METRICS})})
    return [sorted(found.get(n, []), key=lambda r: r["fold"]) for n in names]


def cv_summary(spark: SparkSession, data: DataFrame) -> DataFrame:
    """M7: mean and population std of recall / ROC-AUC / precision / F1 per model."""
    res = fitted_once(spark, data, "cv_scores", list(MODELS), lambda: _fold_scores(data, MODELS))
    return M.summarize_cv(spark, dict(zip(MODELS, res)))


def validation_scores(spark: SparkSession, data: DataFrame) -> DataFrame:
    """M8: refit on the whole train split, score validation at 0.50."""
    val = data.where(F.col("split") == "val")

    def build():
        with ThreadPoolExecutor(max_workers=len(MODELS)) as pool:
            forest = pool.submit(fit, "random_forest", _train(data))
            trees = pool.submit(boosted_kept, data, [None])
            models = [batch_fit(data, [batched.Problem(1.0, 0.0)])[0], forest.result(), trees.result()[None]]
        every = reduce(DataFrame.unionByName, [
            predictions(m, val).select(F.lit(n).alias("model"), "y", "p") for n, m in zip(MODELS, models)]).checkpoint()
        found = {r["model"]: r for r in E.scores_by(every, ["model"]).collect()}
        return [{"model": n, **_plain({m: found[n][m] if n in found else None for m in METRICS})} for n in MODELS]

    rows = fitted_once(spark, data, "validation_scores", list(MODELS), build)
    return spark.createDataFrame([(r["model"], *[r[m] for m in METRICS]) for r in rows],
                                 "model string, recall double, roc_auc double, precision double, f1 double")


def search_results(spark: SparkSession, data: DataFrame, kind: str) -> list[dict]:
    """Mean CV ROC-AUC per parameter set (of the folds where it is defined)."""
    params = M.grid_params() if kind == "grid" else M.random_params()

    def build():
        fitted = batch_fit(data, [batched.Problem(p["C"], p["l1_ratio"], f) for p in params for f in range(C.N_FOLDS)])
        found = E.scores_by(search_predictions(data, fitted).checkpoint(), ["params", "fold"])
        by_set = {r["params"]: r for r in found.groupBy("params").agg(
            F.avg("roc_auc").alias("mean"), F.stddev_pop("roc_auc").alias("std")).collect()}
        return [{"C": p["C"], "l1_ratio": p["l1_ratio"], "mean_roc_auc": M.optional(by_set[k]["mean"] if k in by_set else None),
                 "std_roc_auc": M.optional(by_set[k]["std"] if k in by_set else None)} for k, p in enumerate(params)]

    return fitted_once(spark, data, f"search_{kind}", params, build)


def search_table(spark: SparkSession, results: list[dict]) -> DataFrame:
    from ..functions.columns import regularisation_label

    df = spark.createDataFrame([(float(r["C"]), float(r["l1_ratio"]), r["mean_roc_auc"], r["std_roc_auc"])
                                for r in results], "C double, l1_ratio double, mean_roc_auc double, std_roc_auc double")
    return df.withColumn("penalty", regularisation_label("l1_ratio"))


def tuning_comparison(spark: SparkSession, data: DataFrame) -> DataFrame:
    """M12 (+M13): validation recall / ROC-AUC / precision / F1 / savings of the four stages.

    Untuned, best of the grid, best of the random search, and the better one of these at its picked threshold; with the
    parameters of each.
    """
    grid, rand = search_results(spark, data, "grid"), search_results(spark, data, "random")
    best = M.search_winner(grid, rand)["search"]
    val = data.where(F.col("split") == "val")
    won = {"untuned": {"C": 1.0, "l1_ratio": 0.0}, "grid_search": M.search_winner(grid, []), "random_search": M.search_winner(rand, [])}
    fitted = batch_fit(data, [batched.Problem(w["C"], w["l1_ratio"]) for w in won.values()])
    every = reduce(DataFrame.unionByName, [predictions(f, val).select(F.lit(n).alias("stage"), "y", "p") for n, f in zip(won, fitted)])
    every = every.checkpoint()
    own = every.where(F.col("stage") == f"{best}_search")
    picked = E.pick_threshold(E.threshold_sweep(own)).first()["threshold"]
    tuned = E.scores_by(own.withColumn("stage", F.lit("tuned_threshold")), ["stage"], picked)
    found = {r["stage"]: r for r in E.scores_by(every, ["stage"]).unionByName(tuned).collect()}
    won["tuned_threshold"] = won[f"{best}_search"]
    rows = []
    for stage, w in won.items():
        r = found[stage]
        net = r["tp"] * C.RETENTION_RATE * C.CLV - (r["tp"] + r["fp"]) * C.CAMPAIGN_COST_PER_HEAD
        th = picked if stage == "tuned_threshold" else C.DEFAULT_THRESHOLD
        rows.append((stage, float(th), float(w["C"]), float(w["l1_ratio"]), *[M.optional(r[m]) for m in METRICS], float(net)))
    return spark.createDataFrame(rows, "stage string, threshold double, C double, l1_ratio double, recall double, "
                                       "roc_auc double, precision double, f1 double, net_savings double")


def feature_importance(spark: SparkSession, data: DataFrame, params) -> DataFrame:
    """Impurity importances of a 300-tree forest without class weights on the train split, descending."""
    def build():
        model = fit("random_forest", _train(data), {"n_trees": 300}, weighted=False)
        return [float(v) for v in model.featureImportances.toArray().tolist()]

    return M.importance_table(spark, fitted_once(spark, data, "rf_importances", [300, params.feature_names()], build),
                              params)
