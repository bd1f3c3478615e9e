"""Registered queries for splits, fitted transforms, scoring, evaluation and impact (SQL-checked)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..operators import evaluate as E
from ..operators import scoring as I
from ..operators.models import FIXED_MODEL, balanced_weights, pos_weight
from ..operators.dictionary import encode, fit_dictionary
from ..operators.prep import apply_prep, feature_exprs, feature_names_table, fit_prep
from ..sources.customer import snapshot_table
from ..sqlcheck import eval_sql as ES
from ..sqlcheck.model_sql import ONE, logit_sql, scored_ctes
from ..sqlcheck.parts import binmap, fe_ctes, joined_ctes, split_ctes, with_ctes
from . import common
from .catalog import register

WS = with_ctes(joined_ctes(), split_ctes())
WSC = with_ctes(joined_ctes(), split_ctes(), scored_ctes())
TEST = "(SELECT Churn AS y, p FROM scored WHERE split = 'test')"
VAL = "(SELECT Churn AS y, p FROM scored WHERE split = 'val')"
DT = C.DEPLOYED_THRESHOLD


def union(parts):
    return "\nUNION ALL\n".join(parts)


def _train(df):
    return df.where(F.col("split") == "train")


def _test(spark, sf_dir):
    return common.scored_splits(spark, sf_dir).where(F.col("split") == "test")


def _val(spark, sf_dir):
    return common.scored_splits(spark, sf_dir).where(F.col("split") == "val")


# D2 ------------------------------------------------------------------------
@register("d02_stratified_folds", sql=WS + """
SELECT fold, Churn, count(*) AS n_rows FROM with_folds WHERE split = 'train' GROUP BY fold, Churn""")
def d2(spark, sf_dir):
    return _train(common.split_table(spark, sf_dir)).groupBy("fold", C.TARGET_COL).agg(F.count(F.lit(1)).alias("n_rows"))


# F1 / F2 (stage-4 imputers) --------------------------------------------------
@register("f01_median_imputer", sql=WS + "\n" + union([
    f"SELECT '{c}' AS \"column\", median(CAST({c} AS DOUBLE)) AS median FROM with_folds WHERE split = 'train'"
    for c in C.PREP_NUMERIC_COLS]), doubles=("median",))
def f1(spark, sf_dir):
    p = fit_prep(_train(common.split_table(spark, sf_dir)), C.PREP_CONFIG, impute=True)
    return spark.createDataFrame([(c, p.medians[c]) for c in p.numeric_cols], "column string, median double")


@register("f02_mode_imputer", sql=WS + "\n" + union([
    f"""SELECT '{c}' AS "column", (SELECT first(v ORDER BY n DESC, v) FROM
        (SELECT {c} AS v, count(*) AS n FROM with_folds WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c})) AS mode"""
    for c in C.PREP_CATEGORICAL_COLS]))
def f2(spark, sf_dir):
    p = fit_prep(_train(common.split_table(spark, sf_dir)), C.PREP_CONFIG, impute=True)
    return spark.createDataFrame([(c, p.modes[c]) for c in p.categorical_cols], "column string, mode string")


# F3 / F4 / F6 / F8 -----------------------------------------------------------
WFE = WS + fe_ctes("with_folds", "(SELECT median(TotalCharges) FROM with_folds WHERE split = 'train')", name="fe_s")


@register("f03_scaler_params", sql=WFE + "\n" + union([
    f"SELECT '{c}' AS \"column\", avg(CAST({c} AS DOUBLE)) AS mean, stddev_pop(CAST({c} AS DOUBLE)) AS std "
    f"FROM fe_s WHERE split = 'train'" for c in C.FE_NUMERIC_COLS]), doubles=("mean", "std"))
def f3(spark, sf_dir):
    fe, bundle = common.fitted(spark, sf_dir)
    p = bundle.params
    return spark.createDataFrame([(c, p.means[c], p.stds[c]) for c in p.numeric_cols], "column string, mean double, std double")


def _cats_sql(table: str = "fe_s") -> str:
    return union([
        f"SELECT '{c}' AS \"column\", v AS category, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS position, "
        f"{i} AS col_order FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {table} WHERE split = 'train' AND {c} IS NOT NULL)"
        for i, c in enumerate(C.FE_CATEGORICAL_COLS)])


@register("f04_onehot_categories", sql=WFE + f"\nSELECT \"column\", category, position FROM ({_cats_sql()})")
def f4(spark, sf_dir):
    _, bundle = common.fitted(spark, sf_dir)
    p = bundle.params
    rows = [(c, v, i) for c in p.categorical_cols for i, v in enumerate(p.categories[c])]
    return spark.createDataFrame(rows, "column string, category string, position int")


def _names_sql() -> str:
    n_num = len(C.FE_NUMERIC_COLS)
    num = union([f"SELECT CAST({i} AS INTEGER) AS idx, '{c}' AS name, '{c}' AS source_column" for i, c in enumerate(C.FE_NUMERIC_COLS)])
    cats = f"""SELECT CAST({n_num} + (row_number() OVER (ORDER BY col_order, position) - 1) AS INTEGER) AS idx,
       "column" || '_' || category AS name, "column" AS source_column FROM ({_cats_sql()})"""
    nb = union([f"SELECT CAST({n_num} + (SELECT count(*) FROM ({_cats_sql()})) + {j} AS INTEGER) AS idx, '{c}' AS name, "
                f"'{c}' AS source_column" for j, c in enumerate(C.FE_BINARY_COLS)])
    return union([num, cats, nb])


@register("f06_feature_names", sql=WFE + "\n" + _names_sql())
def f6(spark, sf_dir):
    _, bundle = common.fitted(spark, sf_dir)
    return feature_names_table(spark, bundle.params)


@register("f08_median_lookup", sql=WS + f"""
SELECT coalesce(median(TotalCharges), {ES.dl(C.TOTAL_CHARGES_MEDIAN_FALLBACK)}) AS total_charges_median
FROM with_folds WHERE split = 'train'""", doubles=("total_charges_median",))
def f8(spark, sf_dir):
    from ..operators.prep import train_median
    med = train_median(_train(common.split_table(spark, sf_dir)))
    return spark.createDataFrame([(med,)], "total_charges_median double")


# Feature matrix (long form) and train-only fit check ----------------
def _matrix_sql() -> str:
    n_num = len(C.FE_NUMERIC_COLS)
    parts = []
    for i, c in enumerate(C.FE_NUMERIC_COLS):
        sd = f"CASE WHEN s.sd_{c} = 0 OR s.sd_{c} IS NULL THEN {ONE} ELSE s.sd_{c} END"
        parts.append(f"SELECT f.CustomerID, f.split, CAST({i} AS INTEGER) AS idx, "
                     f"(CAST(f.{c} AS DOUBLE) - s.mu_{c}) / {sd} AS value FROM fe_s f CROSS JOIN stats2 s")
    for c in C.FE_CATEGORICAL_COLS:
        parts.append(f"""SELECT f.CustomerID, f.split, CAST({n_num} + k.gpos AS INTEGER) AS idx,
  CAST(coalesce(CAST(f.{c} AS VARCHAR) = k.category, false) AS DOUBLE) AS value
FROM fe_s f CROSS JOIN (SELECT * FROM cats WHERE "column" = '{c}') k""")
    for j, c in enumerate(C.FE_BINARY_COLS):
        parts.append(f"SELECT f.CustomerID, f.split, CAST({n_num} + (SELECT count(*) FROM cats) + {j} AS INTEGER) AS idx, "
                     f"CAST(f.{c} AS DOUBLE) AS value FROM fe_s f")
    stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS mu_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS sd_{c}" for c in C.FE_NUMERIC_COLS)
    return WFE + f""",
stats2 AS (SELECT {stats} FROM fe_s WHERE split = 'train'),
cats AS (SELECT *, row_number() OVER (ORDER BY col_order, position) - 1 AS gpos FROM ({_cats_sql()}))
""" + union(parts)


@register("f05_feature_matrix", sql=_matrix_sql(), doubles=("value",))
def f5(spark, sf_dir):
    fe, bundle = common.fitted(spark, sf_dir)
    m = apply_prep(fe, bundle.params, keep=[C.KEY_COL, "split"])
    return m.select(C.KEY_COL, "split", F.posexplode("features").alias("idx", "value")).withColumn("idx", F.col("idx").cast("int"))


@register("f09_sparse_matrix", sql=_matrix_sql().replace("\nSELECT f.CustomerID", "\nSELECT * FROM (SELECT f.CustomerID", 1) + ") WHERE value <> 0",
          doubles=("value",))
def f9(spark, sf_dir):
    """F4 + F5 over a dictionary table: the entries of sparse vectors."""
    fe, bundle = common.fitted(spark, sf_dir)
    p = bundle.params
    d = fit_dictionary(_train(fe), p.categorical_cols)
    exprs = feature_exprs(p)
    n = sum(d.sizes.values())
    m = encode(fe, d, exprs[:len(p.numeric_cols)])
    binary = [F.struct(F.lit(len(p.numeric_cols) + n + k).alias("idx"), F.col(c).cast("double").alias("value"))
              for k, c in enumerate(p.binary_cols)]
    entries = F.concat(F.arrays_zip(F.col("features.indices").alias("idx"), F.col("features.values").alias("value")), F.array(*binary))
    return m.select(C.KEY_COL, "split", F.explode(entries).alias("e")).select(
        C.KEY_COL, "split", F.col("e.idx").cast("int").alias("idx"), F.col("e.value").alias("value")).where("value <> 0")


@register("f10_dictionary", sql=WFE + f"\nSELECT \"column\", category, CAST(position AS BIGINT) AS position FROM ({_cats_sql()})")
def f10(spark, sf_dir):
    """F4 as a dictionary table."""
    fe, bundle = common.fitted(spark, sf_dir)
    return fit_dictionary(_train(fe), bundle.params.categorical_cols).table


@register("f07_fit_apply_separation", sql=WSC.replace("scored AS (", "unused_scored AS (") + "\n" + union([
    f"SELECT f.split, '{c}' AS \"column\", avg((CAST(f.{c} AS DOUBLE) - s.mu_{c}) / "
    f"CASE WHEN s.sd_{c} = 0 OR s.sd_{c} IS NULL THEN {ONE} ELSE s.sd_{c} END) AS mean_scaled "
    f"FROM fe_s f CROSS JOIN train_stats s GROUP BY f.split" for c in C.FE_NUMERIC_COLS]), doubles=("mean_scaled",))
def f7(spark, sf_dir):
    """Scaled numeric means per split: ~0 on train (fit there), off-zero on val/test (applied there)."""
    fe, bundle = common.fitted(spark, sf_dir)
    m = apply_prep(fe, bundle.params, keep=["split"])
    n = len(bundle.params.numeric_cols)
    long = m.select("split", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col("features")[i].alias("x")) for i, c in enumerate(bundle.params.numeric_cols[:n])
    ])).alias("kv")).select("split", "kv.*")
    return long.groupBy("split", "column").agg(F.avg("x").alias("mean_scaled"))


# M1 / M2 / M16 ---------------------------------------------------------------
@register("m01_balanced_weights", sql=WS + """
SELECT Churn AS label, count(*) AS n,
  (SELECT count(*) FROM with_folds WHERE split = 'train') / (2.0 * count(*)) AS weight
FROM with_folds WHERE split = 'train' GROUP BY Churn""", doubles=("weight",))
def m01(spark, sf_dir):
    t = _train(common.split_table(spark, sf_dir)).withColumn("label", F.col(C.TARGET_COL))
    return balanced_weights(t).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.first("weight").alias("weight"))


@register("m02_scale_pos_weight", sql=WS + """
SELECT CAST(count(*) FILTER (WHERE Churn = 0) AS DOUBLE) / count(*) FILTER (WHERE Churn = 1) AS scale_pos_weight
FROM with_folds WHERE split = 'train'""", doubles=("scale_pos_weight",))
def m02(spark, sf_dir):
    t = _train(common.split_table(spark, sf_dir)).withColumn("label", F.col(C.TARGET_COL))
    return pos_weight(t).where(F.col("label") == 1).agg(F.first("weight").alias("scale_pos_weight"))


@register("m16_fixed_model_scores", sql=WSC + "\nSELECT CustomerID, split, p FROM scored", doubles=("p",))
def m16(spark, sf_dir):
    return common.scored_splits(spark, sf_dir).select(C.KEY_COL, "split", "p")


# E1 / E2 -------------------------------------------------------------------
@register("e01_confusion_matrix", sql=WSC + f"""
SELECT tn, fp, fn, tp FROM ({ES.counts_sql(TEST, ES.values_table([C.DEFAULT_THRESHOLD]))})""")
def e01(spark, sf_dir):
    return E.confusion(_test(spark, sf_dir), C.DEFAULT_THRESHOLD)


@register("e02_threshold_metrics", sql=WSC + f"""
SELECT threshold, {ES.rates_sql()}, tn, fp, fn, tp FROM ({ES.counts_sql(TEST, ES.values_table([C.DEFAULT_THRESHOLD]))})""",
          doubles=("threshold", "accuracy", "precision", "recall", "specificity", "f1"))
def e02(spark, sf_dir):
    return E.threshold_metrics(_test(spark, sf_dir), C.DEFAULT_THRESHOLD)


# E3 - E8 -------------------------------------------------------------------
@register("e03_roc_auc", sql=WSC + f"\nSELECT {ES.auc_sql(TEST)} AS roc_auc", doubles=("roc_auc",))
def e03(spark, sf_dir):
    return E.roc_auc(_test(spark, sf_dir))


@register("e04_pr_auc", sql=WSC + f"""
SELECT sum(CAST(pos AS DOUBLE) / P * (prec + prec_before) / 2) AS pr_auc FROM (
  SELECT *, CAST(tp AS DOUBLE) / (tp + fp) AS prec,
    coalesce(lag(CAST(tp AS DOUBLE) / (tp + fp)) OVER (ORDER BY score DESC), CAST(1 AS DOUBLE)) AS prec_before
  FROM {ES.curve_sql(TEST)})""", doubles=("pr_auc",))
def e04(spark, sf_dir):
    return E.pr_auc(_test(spark, sf_dir))


@register("e05_brier_score", sql=WSC + f"\nSELECT avg((p - y) * (p - y)) AS brier_score FROM {TEST}",
          doubles=("brier_score",))
def e05(spark, sf_dir):
    t = _test(spark, sf_dir)
    yy = F.col("y").cast("double")
    return t.agg(F.avg((F.col("p") - yy) * (F.col("p") - yy)).alias("brier_score"))


@register("e06_log_loss", sql=WSC + f"""
SELECT avg(-(y * ln(pc) + (1 - y) * ln(1 - pc))) AS log_loss FROM (
  SELECT CAST(y AS DOUBLE) AS y, least(greatest(p, {ES.dl(E.EPS)}), {ES.dl(1 - E.EPS)}) AS pc FROM {TEST})""",
          doubles=("log_loss",))
def e06(spark, sf_dir):
    t = _test(spark, sf_dir)
    yy = F.col("y").cast("double")
    pc = F.least(F.greatest(F.col("p"), F.lit(E.EPS)), F.lit(1 - E.EPS))
    return t.agg(F.avg(-(yy * F.log(pc) + (F.lit(1.0) - yy) * F.log(F.lit(1.0) - pc))).alias("log_loss"))


@register("e07_roc_curve", sql=WSC + f"""
SELECT score AS threshold, {ES.div0('fp', 'N')} AS fpr, {ES.div0('tp', 'P')} AS tpr FROM {ES.curve_sql(TEST)}""",
          doubles=("threshold", "fpr", "tpr"))
def e07(spark, sf_dir):
    return E.roc_curve(_test(spark, sf_dir))


@register("e08_pr_curve", sql=WSC + f"""
SELECT score AS threshold, CAST(tp AS DOUBLE) / (tp + fp) AS precision, {ES.div0('tp', 'P')} AS recall,
       CAST(P AS DOUBLE) / (P + N) AS baseline FROM {ES.curve_sql(TEST)}""",
          doubles=("threshold", "precision", "recall", "baseline"))
def e08(spark, sf_dir):
    return E.pr_curve(_test(spark, sf_dir))


# E9 / E10 ------------------------------------------------------------------
SWEEP = C.sweep_thresholds()


def _sweep_sql(rows: str) -> str:
    return f"""SELECT round(threshold, 2) AS threshold, threshold AS raw_threshold,
  {ES.div0('tp', 'tp + fn')} AS recall, {ES.div0('tp', 'tp + fp')} AS precision,
  {ES.div0('2 * tp', '2 * tp + fp + fn')} AS f1, {ES.net_sql()} AS net_savings, tp, fp
FROM ({ES.counts_sql(rows, ES.values_table(SWEEP))})"""


@register("e09_threshold_sweep", sql=WSC + "\n" + _sweep_sql(VAL),
          doubles=("threshold", "raw_threshold", "recall", "precision", "f1", "net_savings"))
def e09(spark, sf_dir):
    return E.threshold_sweep(_val(spark, sf_dir)).drop("idx")


def _pick_sql(rows: str) -> str:
    return f"""SELECT threshold, raw_threshold, tier AS rule, recall, precision, f1, net_savings FROM (
  SELECT *, CASE WHEN recall >= {ES.dl(C.MIN_RECALL)} AND precision >= {ES.dl(C.MIN_PRECISION)} THEN 1
                 WHEN recall >= {ES.dl(C.MIN_RECALL)} THEN 2 ELSE 3 END AS tier
  FROM ({_sweep_sql(rows)}))
ORDER BY tier, CASE WHEN tier = 3 THEN recall ELSE net_savings END DESC, raw_threshold LIMIT 1"""


@register("e10_pick_threshold", sql=WSC + "\n" + _pick_sql(VAL),
          doubles=("threshold", "raw_threshold", "recall", "precision", "f1", "net_savings"))
def e10(spark, sf_dir):
    return E.pick_threshold(E.threshold_sweep(_val(spark, sf_dir)))


# E11 / E12 / E13 / B3 ------------------------------------------------------
def _candidates_table() -> str:
    base = union([f"SELECT {ES.dl(t)} AS th" for t in C.CANDIDATE_THRESHOLDS])
    return f"(SELECT DISTINCT th FROM ({base} UNION ALL SELECT threshold AS th FROM ({_pick_sql(VAL)})))"


def _comparison_sql() -> str:
    auc = ES.auc_sql(TEST)
    return f"""SELECT *,
  CAST(recall_pass AS INTEGER) + CAST(roc_auc_pass AS INTEGER) + CAST(precision_pass AS INTEGER) + CAST(f1_pass AS INTEGER) AS kpi_passes
FROM (
  SELECT *, recall >= {ES.dl(C.KPI_TARGETS['recall'])} AS recall_pass,
         coalesce(roc_auc >= {ES.dl(C.KPI_TARGETS['roc_auc'])}, false) AS roc_auc_pass,
         precision >= {ES.dl(C.KPI_TARGETS['precision'])} AS precision_pass, f1 >= {ES.dl(C.KPI_TARGETS['f1'])} AS f1_pass
  FROM (SELECT threshold, tn, fp, fn, tp, {ES.rates_sql()}, {auc} AS roc_auc, {ES.impact_sql()}
        FROM ({ES.counts_sql(TEST, _candidates_table())})))"""


def _comparison(spark, sf_dir):
    scored = common.scored_splits(spark, sf_dir)
    val = scored.where(F.col("split") == "val")
    test = scored.where(F.col("split") == "test")
    tuned = E.pick_threshold(E.threshold_sweep(val)).select("threshold").scalar()
    return E.threshold_comparison(test, E.candidate_thresholds(tuned))


@register("e11_candidate_metrics", sql=WSC + f"""
SELECT threshold, accuracy, precision, recall, specificity, f1, tn, fp, fn, tp FROM ({_comparison_sql()})""",
          doubles=("threshold", "accuracy", "precision", "recall", "specificity", "f1"))
def e11(spark, sf_dir):
    return _comparison(spark, sf_dir).select("threshold", "accuracy", "precision", "recall", "specificity", "f1",
                                             "tn", "fp", "fn", "tp")


@register("e12_kpi_compliance", sql=WSC + f"""
SELECT threshold, roc_auc, recall_pass, roc_auc_pass, precision_pass, f1_pass, kpi_passes FROM ({_comparison_sql()})""",
          doubles=("threshold", "roc_auc"))
def e12(spark, sf_dir):
    return _comparison(spark, sf_dir).select("threshold", "roc_auc", "recall_pass", "roc_auc_pass", "precision_pass",
                                             "f1_pass", "kpi_passes")


@register("e13_recommended_threshold", sql=WSC + f"""
SELECT threshold AS recommended_threshold, kpi_passes, net_savings FROM ({_comparison_sql()})
ORDER BY kpi_passes DESC, net_savings DESC, threshold LIMIT 1""", doubles=("recommended_threshold", "net_savings"))
def e13(spark, sf_dir):
    return E.recommend_threshold(_comparison(spark, sf_dir))


@register("b03_impact_comparison", sql=WSC + f"""
SELECT threshold, kpi_passes, recall, precision, f1, accuracy, targeted, caught, net_savings, roi_pct
FROM ({_comparison_sql()})""",
          doubles=("threshold", "recall", "precision", "f1", "accuracy", "net_savings", "roi_pct"))
def b03(spark, sf_dir):
    return _comparison(spark, sf_dir).select("threshold", "kpi_passes", "recall", "precision", "f1", "accuracy",
                                             "targeted", "caught", "net_savings", "roi_pct")


# E14 / E15 / E16 -----------------------------------------------------------
def _fair_sql(th: str = ES.dl(DT), source: str = "scored") -> str:
    parts = []
    for c in C.FAIRNESS_COLS:
        parts.append(f"""SELECT '{c}' AS subgroup_category, CAST({c} AS VARCHAR) AS subgroup_value, count(*) AS sample_size,
  avg(CAST(Churn AS DOUBLE)) AS actual_churn_rate, avg(CAST(p >= {th} AS DOUBLE)) AS selection_rate,
  count(*) FILTER (WHERE p >= {th} AND Churn = 1) AS tp, count(*) FILTER (WHERE p >= {th} AND Churn <> 1) AS fp,
  count(*) FILTER (WHERE p < {th} AND Churn = 1) AS fn
FROM {source} WHERE split = 'test' GROUP BY {c}""")
    return f"""SELECT subgroup_category, subgroup_value, sample_size, actual_churn_rate, selection_rate,
  {ES.div0('tp', 'tp + fn')} AS recall, {ES.div0('tp', 'tp + fp')} AS precision, {ES.div0('2 * tp', '2 * tp + fp + fn')} AS f1_score
FROM ({union(parts)})"""


@register("e14_subgroup_fairness", sql=WSC + "\n" + _fair_sql(),
          doubles=("actual_churn_rate", "selection_rate", "recall", "precision", "f1_score"))
def e14(spark, sf_dir):
    return E.subgroup_fairness(_test(spark, sf_dir), DT)


@register("e15_disparity_flags", sql=WSC + f"""
SELECT subgroup_category, max(recall) - min(recall) AS recall_range, max(selection_rate) - min(selection_rate) AS selection_range,
  first(subgroup_value ORDER BY recall ASC, subgroup_value) AS lowest_recall_group,
  first(subgroup_value ORDER BY recall DESC, subgroup_value) AS highest_recall_group,
  max(recall) - min(recall) > {ES.dl(C.RECALL_GAP_LIMIT)} AS recall_gap_flag,
  max(selection_rate) - min(selection_rate) > {ES.dl(C.SELECTION_GAP_LIMIT)} AS selection_gap_flag
FROM ({_fair_sql()}) GROUP BY subgroup_category""", doubles=("recall_range", "selection_range"))
def e15(spark, sf_dir):
    return E.disparity_flags(E.subgroup_fairness(_test(spark, sf_dir), DT))


@register("e16_assessment_flags", sql=WSC + f"""
SELECT threshold, recall_pass, precision_pass, f1_pass, roc_auc_pass,
  CASE WHEN fp + tp > 0 THEN CAST(fp AS DOUBLE) / (fp + tp) * CAST(100 AS DOUBLE) END AS fp_share_pct,
  coalesce(CASE WHEN fp + tp > 0 THEN CAST(fp AS DOUBLE) / (fp + tp) * CAST(100 AS DOUBLE) END > {ES.dl(C.FP_SHARE_LIMIT)}, false) AS fp_share_flag,
  specificity < {ES.dl(C.SPECIFICITY_FLOOR)} AS low_specificity_flag
FROM ({_comparison_sql()}) WHERE threshold = {ES.dl(DT)}""", doubles=("threshold", "fp_share_pct"))
def e16(spark, sf_dir):
    return E.assessment_flags(_comparison(spark, sf_dir).where(F.col("threshold") == DT))


# the same at the recommended threshold instead of the deployed one
#: The recommended candidate and the report's parts at it.
REC = WSC + f""",
rec AS (SELECT * FROM ({_comparison_sql()}) ORDER BY kpi_passes DESC, net_savings DESC, threshold LIMIT 1)"""
_REC_FAIR = _fair_sql("r.t", "scored CROSS JOIN (SELECT threshold AS t FROM rec) AS r")


def _recommended(spark, sf_dir):
    """Scored test rows, the candidates' comparison and the recommended one of them."""
    scored = common.scored_splits(spark, sf_dir)
    test = scored.where(F.col("split") == "test")
    tuned = E.pick_threshold(E.threshold_sweep(scored.where(F.col("split") == "val"))).select("threshold").scalar()
    comparison = E.threshold_comparison(test, E.candidate_thresholds(tuned))
    return test, comparison, E.recommend_threshold(comparison).select("recommended_threshold").scalar()


@register("e19_recommended_fairness", sql=REC + "\n" + _REC_FAIR,
          doubles=("actual_churn_rate", "selection_rate", "recall", "precision", "f1_score"))
def e19(spark, sf_dir):
    test, _, th = _recommended(spark, sf_dir)
    return E.subgroup_fairness(test, th)


@register("e20_recommended_disparity", sql=REC + f"""
SELECT subgroup_category, max(recall) - min(recall) AS recall_range, max(selection_rate) - min(selection_rate) AS selection_range,
  first(subgroup_value ORDER BY recall ASC, subgroup_value) AS lowest_recall_group,
  first(subgroup_value ORDER BY recall DESC, subgroup_value) AS highest_recall_group,
  max(recall) - min(recall) > {ES.dl(C.RECALL_GAP_LIMIT)} AS recall_gap_flag,
  max(selection_rate) - min(selection_rate) > {ES.dl(C.SELECTION_GAP_LIMIT)} AS selection_gap_flag
FROM ({_REC_FAIR}) GROUP BY subgroup_category""", doubles=("recall_range", "selection_range"))
def e20(spark, sf_dir):
    test, _, th = _recommended(spark, sf_dir)
    return E.disparity_flags(E.subgroup_fairness(test, th))


@register("e21_recommended_assessment", sql=REC + f"""
SELECT threshold, recall_pass, precision_pass, f1_pass, roc_auc_pass,
  CASE WHEN fp + tp > 0 THEN CAST(fp AS DOUBLE) / (fp + tp) * CAST(100 AS DOUBLE) END AS fp_share_pct,
  coalesce(CASE WHEN fp + tp > 0 THEN CAST(fp AS DOUBLE) / (fp + tp) * CAST(100 AS DOUBLE) END > {ES.dl(C.FP_SHARE_LIMIT)}, false) AS fp_share_flag,
  specificity < {ES.dl(C.SPECIFICITY_FLOOR)} AS low_specificity_flag
FROM rec""", doubles=("threshold", "fp_share_pct"))
def e21(spark, sf_dir):
    _, comparison, th = _recommended(spark, sf_dir)
    return E.assessment_flags(comparison.where(F.col("threshold") == th))


# B1 / B2 -------------------------------------------------------------------
@register("b01_net_savings", sql=WSC + f"""
SELECT threshold, tp, fp, {ES.net_sql()} AS net_savings FROM ({ES.counts_sql(TEST, ES.values_table([DT]))})""",
          doubles=("threshold", "net_savings"))
def b01(spark, sf_dir):
    cm = E.confusion(_test(spark, sf_dir), DT)
    return cm.select(F.lit(DT).alias("threshold"), "tp", "fp", E.net_savings(F.col("tp"), F.col("fp")).alias("net_savings"))


@register("b02_financial_impact", sql=WSC + f"""
SELECT threshold, {ES.impact_sql()} FROM ({ES.counts_sql(TEST, ES.values_table([DT]))})""",
          doubles=("threshold", "unmitigated_loss", "retained", "saved_revenue", "campaign_cost", "net_savings", "roi_pct"))
def b02(spark, sf_dir):
    cm = E.confusion(_test(spark, sf_dir), DT).select(F.lit(DT).alias("threshold"), "*")
    return E.financial_impact_cols(cm).drop("tn", "fp", "fn", "tp")


# I1 - I5 -------------------------------------------------------------------
def _lenient(c: str) -> str:
    return (f"CASE CAST({c} AS VARCHAR) WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 WHEN 'Male' THEN 1 WHEN 'Female' THEN 0 "
            f"ELSE TRY_CAST(CAST({c} AS VARCHAR) AS INTEGER) END")


def _serving_sql() -> str:
    med = "(SELECT median(TotalCharges) FROM with_folds WHERE split = 'train')"
    lenient = ", ".join(f"{_lenient(c)} AS {c}" for c in C.BINARY_MAP_COLS)
    return WSC + f""",
serving AS (
  SELECT * EXCLUDE (Churn, ChurnP, ChurnObserved) REPLACE ({binmap('PhoneService')} AS PhoneService,
         TRY_CAST(trim(TotalCharges) AS DOUBLE) AS TotalCharges) FROM raw
),
served AS (SELECT * REPLACE ({lenient}) FROM serving)""" + fe_ctes("served", med, name="fe_i") + f""",
predicted AS (
  SELECT f.*, {ONE} / ({ONE} + exp(-(
      {logit_sql()}
  ))) AS churn_probability
  FROM fe_i f CROSS JOIN train_stats s
),
predicted2 AS (SELECT *, CAST(churn_probability >= {ES.dl(DT)} AS INTEGER) AS churn_prediction FROM predicted),
responses AS (
  SELECT coalesce(CAST(CustomerID AS VARCHAR), 'UNKNOWN') AS customer_id, round(churn_probability, 4) AS churn_probability,
    churn_prediction, CASE WHEN churn_prediction = 1 THEN 'Churn' ELSE 'No Churn' END AS churn_label,
    {ES.dl(DT)} AS decision_threshold,
    CASE WHEN churn_probability >= {ES.dl(C.CRITICAL_CUTOFF)} THEN 'Critical' WHEN churn_probability >= {ES.dl(DT)} THEN 'High'
         WHEN churn_probability >= {ES.dl(C.MEDIUM_CUTOFF)} THEN 'Medium' ELSE 'Low' END AS risk_tier
  FROM predicted2
)"""


def _bundle_and_records(spark, sf_dir):
    raw = snapshot_table(spark, sf_dir)  # derived once for the fit and the records
    return common.fitted(spark, sf_dir, raw)[1], common.serving_records(spark, sf_dir, raw)


_RAW_COLS = ["Tenure", "PhoneService", "Partner", "ContractType", "MonthlyCharges", "TotalCharges"]


@register("i01_predict_raw", sql=_serving_sql() + f"""
SELECT CustomerID, {", ".join(f"s.{c}" for c in _RAW_COLS)}, churn_probability, churn_prediction
FROM serving s JOIN (SELECT CustomerID, churn_probability, churn_prediction FROM predicted2) p USING (CustomerID)""",
          doubles=("MonthlyCharges", "TotalCharges", "churn_probability"))
def i01(spark, sf_dir):
    bundle, recs = _bundle_and_records(spark, sf_dir)
    return I.predict_raw(recs, bundle).select(C.KEY_COL, *_RAW_COLS, "churn_probability", "churn_prediction")


@register("i02_score_responses", sql=_serving_sql() + "\nSELECT * FROM responses",
          doubles=("churn_probability", "decision_threshold"))
def i02(spark, sf_dir):
    bundle, recs = _bundle_and_records(spark, sf_dir)
    return I.score_records(recs, bundle)


@register("i03_batch_summary", sql=_serving_sql() + """
SELECT count(*) AS total_records, count(*) FILTER (WHERE churn_prediction = 1) AS predicted_churn_count,
  round(CASE WHEN count(*) = 0 THEN 0.0 ELSE CAST(count(*) FILTER (WHERE churn_prediction = 1) AS DOUBLE) / count(*) END, 4) AS churn_rate,
  round(coalesce(avg(churn_probability), 0.0), 4) AS mean_churn_probability
FROM responses""", doubles=("churn_rate", "mean_churn_probability"))
def i03(spark, sf_dir):
    bundle, recs = _bundle_and_records(spark, sf_dir)
    return I.batch_summary(I.score_records(recs, bundle))


@register("i04_single_record", sql=_serving_sql() + """
SELECT * FROM responses WHERE customer_id = (SELECT min(CustomerID) FROM serving)""",
          doubles=("churn_probability", "decision_threshold"))
def i04(spark, sf_dir):
    bundle, recs = _bundle_and_records(spark, sf_dir)
    one = recs.orderBy(C.KEY_COL).limit(1)  # a batch of one record is the feature here
    return I.score_records(one, bundle)


@register("i05_tier_distribution", sql=_serving_sql() + """
SELECT risk_tier, count(*) AS n, avg(churn_probability) AS mean_probability FROM responses GROUP BY risk_tier""",
          doubles=("mean_probability",))
def i05(spark, sf_dir):
    bundle, recs = _bundle_and_records(spark, sf_dir)
    return I.tier_distribution(I.score_records(recs, bundle))


@register("p07_result_filter", sql=_serving_sql() + """
SELECT * FROM responses WHERE risk_tier = 'High' AND contains(lower(customer_id), lower('00001'))""",
          doubles=("churn_probability", "decision_threshold"))
def p07(spark, sf_dir):
    bundle, recs = _bundle_and_records(spark, sf_dir)
    return I.filter_results(I.score_records(recs, bundle), tier="High", query="00001")


@register("p08_top_risk", sql=_serving_sql() + """
SELECT * FROM responses ORDER BY churn_probability DESC, customer_id LIMIT 20""",
          doubles=("churn_probability", "decision_threshold"))
def p08(spark, sf_dir):
    bundle, recs = _bundle_and_records(spark, sf_dir)
    # top-k report: the limit is the feature (TakeOrderedAndProject, k rows per task)
    return I.score_records(recs, bundle).orderBy(F.col("churn_probability").desc(), F.col("customer_id")).limit(20)


# E18 -----------------------------------------------------------------------
_ROW_TEXT = ("concat_ws('|', customer_id, CAST(CAST(round(churn_probability * 10000) AS BIGINT) AS VARCHAR), "
             "CAST(churn_prediction AS VARCHAR), risk_tier)")
_DIGEST = "-".join("' || CAST(CAST(sum(('0x' || substr(md5({t}), {k}, 15))::HUGEINT) % {p} AS BIGINT) AS VARCHAR) || '".format(
    t=_ROW_TEXT, k=k, p=E.DIGEST_PRIME) for k in (1, 16))


@register("e18_reproducibility", sql=_serving_sql() + f"""
SELECT count(*) AS n_rows, '{_DIGEST}' AS first_digest, '{_DIGEST}' AS second_digest, CAST(0 AS BIGINT) AS only_in_first,
  CAST(0 AS BIGINT) AS only_in_second, count(*) FILTER (WHERE churn_prediction = 1) AS n_positive FROM responses""")
def e18(spark, sf_dir):
    """Two fits and scorings of one snapshot under different partitionings: digests, row differences and totals."""
    raw = snapshot_table(spark, sf_dir)
    a = I.score_records(common.serving_records(spark, sf_dir, raw), common.fitted(spark, sf_dir, raw)[1])
    dealt = raw.repartition(13, F.rand(7))
    b = I.score_records(common.serving_records(spark, sf_dir, dealt), common.fitted(spark, sf_dir, dealt)[1])
    text = F.concat_ws("|", "customer_id", F.round(F.col("churn_probability") * 10000).cast("bigint").cast("string"),
                       F.col("churn_prediction").cast("string"), "risk_tier")
    totals = a.agg(F.count_if(F.col("churn_prediction") == 1).alias("n_positive"))
    return reduce(DataFrame.crossJoin, [E.multiset_digest(a, text, "first_digest"), E.multiset_digest(b, text, "second_digest").drop("n_rows"),
                                        totals, E.reproducibility(a, b)])  # one row each
