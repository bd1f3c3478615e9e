"""Registered queries for row-wise operators, projections, joins, sources/sinks, registry and streaming."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import functions as F

from .. import config as C
from .. import schemas as S
from ..functions import columns as X
from ..operators import evaluate as E
from ..operators import registry as R
from ..operators import scoring as I
from ..operators.models import FIXED_MODEL
from ..session import scratch_path
from ..sources.customer import join_loss_audit, load_joined, rename_columns, source_tables, split_sources
from ..sources.sinks import write_csv, write_feature_matrix
from ..sources.tables import read_source, read_splits
from ..sqlcheck import eval_sql as ES
from ..sqlcheck.parts import bucket_sql, binmap, fe_ctes, hash_sql, joined_ctes, split_ctes, total_services_sql, with_ctes
from ..sqlcheck.snapshot_sql import snapshot_ctes
from . import common
from .catalog import register
from .catalog_model import REC, TEST, VAL, _REC_FAIR, _bundle_and_records, _comparison_sql, _names_sql, _pick_sql, _serving_sql
from .catalog_model import WFE as WFIT

W = with_ctes(joined_ctes())
WFE = with_ctes(joined_ctes(), fe_ctes("cleaned", "(SELECT median(TotalCharges) FROM cleaned)"))


def _fe_all(spark, sf_dir):
    c = common.cleaned(spark, sf_dir)
    return c, X.engineer_features(c, common.exact_median(c, "TotalCharges"))


# X1 - X10 ------------------------------------------------------------------
@register("x01_to_number", sql=W + """
SELECT CustomerID, TotalCharges AS TotalCharges_raw, TRY_CAST(trim(TotalCharges) AS DOUBLE) AS TotalCharges_num FROM joined""",
          doubles=("TotalCharges_num",))
def x01(spark, sf_dir):
    j = common.joined(spark, sf_dir)
    return j.select(C.KEY_COL, F.col("TotalCharges").alias("TotalCharges_raw"), X.to_number("TotalCharges").alias("TotalCharges_num"))


@register("x02_label_flag", sql=W + """
SELECT CustomerID, Churn AS Churn_raw, CAST(coalesce(Churn, '') = 'Yes' AS INTEGER) AS label FROM joined""")
def x02(spark, sf_dir):
    j = common.joined(spark, sf_dir)
    return j.select(C.KEY_COL, F.col("Churn").alias("Churn_raw"), X.label_flag("Churn").alias("label"))


@register("x03_strict_map", sql=W + "\nSELECT CustomerID, " + ", ".join(
    f"{binmap(c)} AS {c}" for c in C.BINARY_MAP_COLS) + " FROM joined")
def x03(spark, sf_dir):
    j = common.joined(spark, sf_dir)
    return j.select(C.KEY_COL, *[X.strict_map(c).alias(c) for c in C.BINARY_MAP_COLS])


@register("x04_lenient_map", sql=_serving_sql() + "\nSELECT CustomerID, " + ", ".join(C.BINARY_MAP_COLS) + " FROM served")
def x04(spark, sf_dir):
    recs = common.serving_records(spark, sf_dir)
    return X.lenient_map_columns(recs).select(C.KEY_COL, *C.BINARY_MAP_COLS)


@register("x05_fill_null", sql=WFE + "\nSELECT CustomerID, TotalCharges FROM fe_filled", doubles=("TotalCharges",))
def x05(spark, sf_dir):
    c = common.cleaned(spark, sf_dir)
    med = common.exact_median(c, "TotalCharges")
    return c.select(C.KEY_COL, X.fill_null("TotalCharges", float(med)).alias("TotalCharges"))


@register("x06_total_services", sql=WFE + "\nSELECT CustomerID, TotalServices FROM fe")
def x06(spark, sf_dir):
    return _fe_all(spark, sf_dir)[1].select(C.KEY_COL, "TotalServices")


@register("x07_has_internet", sql=W + """
SELECT CustomerID, CAST(NOT (InternetService IS NOT DISTINCT FROM 'No') AS INTEGER) AS HasInternetService FROM cleaned""")
def x07(spark, sf_dir):
    return common.cleaned(spark, sf_dir).select(C.KEY_COL, X.has_internet().alias("HasInternetService"))


@register("x08_avg_monthly_spend", sql=WFE + "\nSELECT CustomerID, AvgMonthlySpend FROM fe", doubles=("AvgMonthlySpend",))
def x08(spark, sf_dir):
    return _fe_all(spark, sf_dir)[1].select(C.KEY_COL, "AvgMonthlySpend")


@register("x09_charge_diff", sql=WFE + "\nSELECT CustomerID, ChargeDiff FROM fe", doubles=("ChargeDiff",))
def x09(spark, sf_dir):
    return _fe_all(spark, sf_dir)[1].select(C.KEY_COL, "ChargeDiff")


@register("x10_tenure_bucket", sql=W + f"\nSELECT TenureBucket, count(*) AS n FROM (SELECT {bucket_sql()} AS TenureBucket FROM cleaned) GROUP BY TenureBucket")
def x10(spark, sf_dir):
    return common.cleaned(spark, sf_dir).select(X.tenure_bucket().alias("TenureBucket")).groupBy("TenureBucket").agg(
        F.count(F.lit(1)).alias("n"))


# X12 / X13 -----------------------------------------------------------------
def _rules_sql() -> list[tuple[str, str]]:
    rules = []
    for col, allowed in C.ENUMS.items():
        vals = ", ".join("'" + v + "'" for v in allowed)
        rules.append((f"{col}:required", f"{col} IS NOT NULL"))
        rules.append((f"{col}:enum", f"{col} IS NULL OR {col} IN ({vals})"))
    for col in ("SeniorCitizen", "PhoneService"):
        rules.append((f"{col}:required", f"{col} IS NOT NULL"))
        rules.append((f"{col}:binary", f"{col} IS NULL OR {col} IN (0, 1)"))
    rules.append(("Tenure:required", "Tenure IS NOT NULL"))
    rules.append(("Tenure:range", f"Tenure IS NULL OR Tenure BETWEEN {C.TENURE_RANGE[0]} AND {C.TENURE_RANGE[1]}"))
    rules.append(("MonthlyCharges:required", "MonthlyCharges IS NOT NULL"))
    rules.append(("MonthlyCharges:range", f"MonthlyCharges IS NULL OR MonthlyCharges BETWEEN {ES.dl(C.MONTHLY_RANGE[0])} AND {ES.dl(C.MONTHLY_RANGE[1])}"))
    rules.append(("TotalCharges:range", f"TotalCharges IS NULL OR TotalCharges BETWEEN {ES.dl(C.TOTAL_RANGE[0])} AND {ES.dl(C.TOTAL_RANGE[1])}"))
    return rules


@register("x12_validate_records", sql=_serving_sql() + "\nSELECT CASE WHEN " + " AND ".join(
    f"coalesce({cond}, false)" for _, cond in _rules_sql()) + " THEN 'valid' ELSE 'rejected' END AS status, count(*) AS n_rows FROM serving GROUP BY 1")
def x12(spark, sf_dir):
    recs = common.serving_records(spark, sf_dir)
    valid, rejected = X.validate(recs)
    return valid.select(F.lit("valid").alias("status")).unionByName(rejected.select(F.lit("rejected").alias("status"))) \
        .groupBy("status").agg(F.count(F.lit(1)).alias("n_rows"))


@register("x13_violation_summary", sql=_serving_sql() + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{name}' AS rule, count(*) AS n_rows FROM serving WHERE NOT coalesce({cond}, false) HAVING count(*) > 0"
    for name, cond in _rules_sql()))
def x13(spark, sf_dir):
    recs = common.serving_records(spark, sf_dir)
    _, rejected = X.validate(recs)
    return X.violation_summary(rejected)


# J3 / X21 ------------------------------------------------------------------
@register("j03_aligned_by_key", sql=with_ctes(joined_ctes()) + """
SELECT Churn, count(*) AS n_rows, CAST(sum(Tenure) AS BIGINT) AS sum_tenure FROM cleaned GROUP BY Churn""")
def j03(spark, sf_dir):
    """Features and labels kept apart, in different orders, and aligned by the key instead of by position."""
    t = common.cleaned(spark, sf_dir)
    x = t.select(C.KEY_COL, "Tenure").orderBy(F.col("Tenure").desc())
    y = t.select(C.KEY_COL, C.TARGET_COL).orderBy(C.KEY_COL)
    return x.join(y, C.KEY_COL).groupBy(C.TARGET_COL).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("Tenure").alias("sum_tenure"))


@register("x21_regularisation_label", sql=with_ctes(joined_ctes()) + """
SELECT CASE WHEN r = 0.0 THEN 'L2' WHEN r = 1.0 THEN 'L1' ELSE 'ElasticNet(' || CAST(r AS VARCHAR) || ')' END AS penalty,
  count(*) AS n FROM (SELECT CAST(Tenure % 5 AS DOUBLE) / 4 AS r FROM cleaned) GROUP BY penalty""")
def x21(spark, sf_dir):
    ratio = (F.col("Tenure") % 5).cast("double") / 4
    return common.cleaned(spark, sf_dir).select(X.regularisation_label(ratio).alias("penalty")).groupBy("penalty").agg(
        F.count(F.lit(1)).alias("n"))


# X14 - X20 -----------------------------------------------------------------
@register("x14_decision", sql=_serving_sql() + """
SELECT CustomerID, churn_probability, churn_prediction,
  CAST(round(churn_probability, 2) >= """ + ES.dl(C.DEPLOYED_THRESHOLD) + """ AS INTEGER) AS prediction_rounded_input
FROM predicted2""", doubles=("churn_probability",))
def x14(spark, sf_dir):
    bundle, recs = _bundle_and_records(spark, sf_dir)
    p = I.predict_raw(recs, bundle)
    return p.select(C.KEY_COL, "churn_probability", "churn_prediction",
                    X.decision(F.round("churn_probability", 2), C.DEPLOYED_THRESHOLD).alias("prediction_rounded_input"))


@register("x15_label_text", sql=_serving_sql() + "\nSELECT churn_label, count(*) AS n FROM responses GROUP BY churn_label")
def x15(spark, sf_dir):
    bundle, recs = _bundle_and_records(spark, sf_dir)
    return I.score_records(recs, bundle).groupBy("churn_label").agg(F.count(F.lit(1)).alias("n"))


@register("x16_risk_tier", sql=_serving_sql() + "\nSELECT customer_id, risk_tier FROM responses")
def x16(spark, sf_dir):
    bundle, recs = _bundle_and_records(spark, sf_dir)
    return I.score_records(recs, bundle).select("customer_id", "risk_tier")


@register("x17_round_probability", sql=_serving_sql() + "\nSELECT customer_id, churn_probability FROM responses",
          doubles=("churn_probability",))
def x17(spark, sf_dir):
    bundle, recs = _bundle_and_records(spark, sf_dir)
    return I.score_records(recs, bundle).select("customer_id", "churn_probability")


@register("x18_default_id", sql=_serving_sql() + """
SELECT count(*) FILTER (WHERE customer_id = 'UNKNOWN') AS n_unknown, count(*) AS n_rows FROM responses""")
def x18(spark, sf_dir):
    bundle, recs = _bundle_and_records(spark, sf_dir)
    r = I.score_records(recs, bundle)
    return r.agg(F.count_if(F.col("customer_id") == "UNKNOWN").alias("n_unknown"), F.count(F.lit(1)).alias("n_rows"))


@register("x19_total_charges_fallback", sql=W + """
SELECT CustomerID, coalesce(nullif(TotalCharges, CAST(0 AS DOUBLE)), Tenure * MonthlyCharges) AS TotalCharges FROM cleaned""",
          doubles=("TotalCharges",))
def x19(spark, sf_dir):
    return common.cleaned(spark, sf_dir).select(C.KEY_COL, X.total_charges_fallback().alias("TotalCharges"))


@register("x20_retention_action", sql=_serving_sql() + """
SELECT r.risk_tier, a.action_priority, a.action, count(*) AS n
FROM responses r JOIN (VALUES """ + ", ".join(f"('{t}', {p}, '{a}')" for t, p, a in X.RETENTION_ACTIONS) + """) AS a(risk_tier, action_priority, action)
  ON r.risk_tier = a.risk_tier
GROUP BY r.risk_tier, a.action_priority, a.action""")
def x20(spark, sf_dir):
    bundle, recs = _bundle_and_records(spark, sf_dir)
    r = X.with_retention_action(I.score_records(recs, bundle))
    return r.groupBy("risk_tier", "action_priority", "action").agg(F.count(F.lit(1)).alias("n"))


# P1 - P5 / P9 ----------------------------------------------------------------
RENAMES = {"MonthlyCharges": "monthly_charges", "TotalCharges": "total_charges", "CustomerID": "customer_id"}


@register("p01_rename_columns", sql=with_ctes(snapshot_ctes()) + """
SELECT CustomerID AS customer_id, MonthlyCharges AS monthly_charges, TotalCharges AS total_charges, PhoneService,
       MultipleLines, InternetService, OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport, StreamingTV, StreamingMovies
FROM usage_t""", doubles=("monthly_charges",))
def p01(spark, sf_dir):
    return rename_columns(source_tables(spark, sf_dir)["usage"], RENAMES)


@register("p02_pick_columns", sql=W + "\nSELECT CustomerID, Tenure, ContractType, MonthlyCharges FROM joined",
          doubles=("MonthlyCharges",))
def p02(spark, sf_dir):
    from ..sources.customer import pick_columns
    return pick_columns(common.joined(spark, sf_dir), ["CustomerID", "Tenure", "ContractType", "MonthlyCharges"])


@register("p03_drop_columns", sql=W + "\nSELECT * EXCLUDE (CustomerID, Churn) FROM cleaned",
          doubles=("MonthlyCharges", "TotalCharges"))
def p03(spark, sf_dir):
    return common.cleaned(spark, sf_dir).drop(C.KEY_COL, C.TARGET_COL, "NotAColumn")


@register("p04_add_columns", sql=with_ctes(joined_ctes(), split_ctes()) + "\nSELECT CustomerID, split, fold FROM with_folds")
def p04(spark, sf_dir):
    return common.split_table(spark, sf_dir).select(C.KEY_COL, "split", "fold")


@register("p05_predicate_filter", sql=W + """
SELECT CustomerID, Tenure, TotalCharges FROM joined WHERE trim(TotalCharges) = '' OR (Tenure = 0 AND Churn = 'Yes')""")
def p05(spark, sf_dir):
    j = common.joined(spark, sf_dir)
    return j.where((F.trim("TotalCharges") == "") | ((F.col("Tenure") == 0) & (F.col("Churn") == "Yes"))).select(
        C.KEY_COL, "Tenure", "TotalCharges")


@register("p09_label_with_features", sql=with_ctes(joined_ctes(), split_ctes()) + fe_ctes(
    "with_folds", "(SELECT median(TotalCharges) FROM with_folds WHERE split = 'train')", name="fe_s") + """,
ncat AS (SELECT """ + " + ".join(
    f"(SELECT count(DISTINCT {c}) FROM fe_s WHERE split = 'train')" for c in C.FE_CATEGORICAL_COLS) + """ AS k)
SELECT CustomerID, CAST(Churn AS DOUBLE) AS label, CAST(""" + str(len(C.FE_NUMERIC_COLS) + len(C.FE_BINARY_COLS)) + """ + (SELECT k FROM ncat) AS INTEGER) AS n_features
FROM fe_s""", doubles=("label",))
def p09(spark, sf_dir):
    from ..operators.models import model_input
    fe, bundle = common.fitted(spark, sf_dir)
    from pyspark.ml.functions import vector_to_array
    m = model_input(fe, bundle.params)
    return m.select(C.KEY_COL, "label", F.size(vector_to_array("features")).alias("n_features"))


# J4 ------------------------------------------------------------------------
@register("j04_join_loss_audit", sql=with_ctes(snapshot_ctes()) + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{n}' AS source, count(*) AS lost_keys FROM (SELECT DISTINCT CustomerID FROM {t}) s "
    f"WHERE " + " OR ".join(f"CustomerID NOT IN (SELECT CustomerID FROM {o})" for o in ("contracts", "demographics", "usage_t") if o != t)
    for n, t in (("contracts", "contracts"), ("demographics", "demographics"), ("usage", "usage_t"))))
def j04(spark, sf_dir):
    return join_loss_audit(source_tables(spark, sf_dir))


# S1 / S3 / S2 / S5 / S8 ------------------------------------------------------
@register("s01_csv_source_scan", sql=W + "\nSELECT * FROM joined", doubles=("MonthlyCharges",))
def s01(spark, sf_dir):
    """S4 -> S3 (CSV with header) -> S1 (fixed-schema CSV scans) -> J1."""
    tables = source_tables(spark, sf_dir)
    root = scratch_path(spark, "csv_sources")
    paths = {n: write_csv(df, os.path.join(root, n)) for n, df in tables.items()}
    schemas = {"contracts": S.CONTRACTS, "demographics": S.DEMOGRAPHICS, "usage": S.USAGE}
    return load_joined({n: read_source(spark, p, schemas[n]) for n, p in paths.items()})


@register("s02_split_scan", sql=with_ctes(joined_ctes(), split_ctes()) + "\nSELECT * FROM with_folds WHERE split = 'test'",
          doubles=("MonthlyCharges", "TotalCharges"))
def s02(spark, sf_dir):
    return common.prepared_splits(spark, sf_dir).where(F.col("split") == "test")


@register("s05_feature_matrix_sink", sql=with_ctes(joined_ctes(), split_ctes()) + """
SELECT split, count(*) AS n_rows, CAST(sum(Churn) AS BIGINT) AS n_positive FROM with_folds GROUP BY split""")
def s05(spark, sf_dir):
    from ..operators.models import model_input
    fe, bundle = common.fitted(spark, sf_dir)
    path = write_feature_matrix(model_input(fe, bundle.params, extra=["split"]), scratch_path(spark, "features"))
    back = spark.read.parquet(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.sum(F.col("label")).cast("bigint").alias("n_positive"))


@register("s08_json_batch_ingest", sql=_serving_sql() + "\nSELECT * FROM responses",
          doubles=("churn_probability", "decision_threshold"))
def s08(spark, sf_dir):
    """Records packed as JSON arrays of bounded batches, ingested with from_json + explode, then scored."""
    bundle, recs = _bundle_and_records(spark, sf_dir)
    n = recs.count()
    n_batches = max(1, -(-n // 100))  # about 100 records per payload
    # spread by a per-row id (not the key): even a key holding a third of the rows is cut into small payloads
    row_id = F.xxhash64(F.col(C.KEY_COL), F.monotonically_increasing_id())
    payloads = (recs.withColumn("_batch", F.pmod(row_id, F.lit(n_batches)))
                .groupBy("_batch").agg(F.to_json(F.collect_list(F.struct(*recs.columns))).alias("payload")))
    path = scratch_path(spark, "payloads")
    payloads.write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    rows = back.select(F.explode(F.from_json("payload", S.SERVING_ARRAY)).alias("r")).select("r.*")
    return I.score_records(rows, bundle)


# R1 - R5 -------------------------------------------------------------------
_REC_COLS = ["CustomerID", "Tenure", "ContractType", "PaymentMethod", "PaperlessBilling", "Gender", "SeniorCitizen",
             "Dependents", "Partner", "TotalCharges", "PhoneService", "MultipleLines", "InternetService"]


@register("r01_record_checksums", sql=with_ctes(snapshot_ctes()) + "\nSELECT CustomerID, sha256(concat_ws('|', " + ", ".join(
    f"CAST({c} AS VARCHAR)" for c in _REC_COLS) + ")) AS sha256 FROM raw")
def r01(spark, sf_dir):
    from ..sources.customer import snapshot_table
    raw = snapshot_table(spark, sf_dir)
    return raw.select(C.KEY_COL, F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in _REC_COLS]), 256).alias("sha256"))


def _saved_version(spark, sf_dir):
    from . import training as T
    data, bundle = T.model_data(spark, sf_dir)
    model = T.fit("logistic_regression", data.where(F.col("split") == "train"))
    picked = E.pick_threshold(E.threshold_sweep(T.predictions(model, data.where(F.col("split") == "val")))).first()
    reg = scratch_path(spark, "registry")
    names = [n for _, n, _ in bundle.params.feature_names()]
    R.save_version(spark, reg, "v1.0.0", model, bundle.params.to_json(), float(picked["threshold"]), names,
                   "churn_logistic_regression", bundle.total_charges_median,
                   model_params={"C": 1.0, "l1_ratio": 0.0, "max_iter": 1000})
    return reg


@register("r02_versioned_save")
def r02(spark, sf_dir):
    reg = _saved_version(spark, sf_dir)
    return R.manifest_frame(spark, reg, "v1.0.0").select("model_name", "version", "threshold", "n_features",
                                                          F.explode("checksums").alias("file", "sha256"))


def _save_fixed(spark, sf_dir, *versions):
    """The fixed model over the fitted parameters, saved under each of ``versions`` in turn."""
    _, bundle = common.fitted(spark, sf_dir)
    reg = scratch_path(spark, "registry")
    for version in versions:
        R.save_version(spark, reg, version, None, bundle.params.to_json(), bundle.threshold, [n for _, n, _ in bundle.params.feature_names()],
                       "fixed_model", bundle.total_charges_median, bundle.scorer)
    return reg


@register("r03_latest_pointer", sql=with_ctes(joined_ctes(), split_ctes()) + """
SELECT 'v1.' || count(*) FILTER (WHERE split = 'train') || '.' || count(*) FILTER (WHERE split = 'val') AS latest FROM with_folds""")
def r03(spark, sf_dir):
    """Of two versions, named by the rows of their splits, the pointer has the one saved last."""
    n = {r["split"]: r["count"] for r in common.split_table(spark, sf_dir).groupBy("split").count().collect()}
    reg = _save_fixed(spark, sf_dir, f"v0.{n['val']}.{n['test']}", f"v1.{n['train']}.{n['val']}")
    return R.latest_version(spark, reg)


@register("r04_verified_load")
def r04(spark, sf_dir):
    reg = _saved_version(spark, sf_dir)
    _, checks = R.load_verified(spark, reg)
    return checks.groupBy("status").agg(F.count(F.lit(1)).alias("n_files"))


@register("r05_model_info")
def r05(spark, sf_dir):
    reg = _saved_version(spark, sf_dir)
    return R.model_info(spark, reg, "v1.0.0")


@register("r06_loaded_scores", sql=_serving_sql() + "\nSELECT * FROM responses",
          doubles=("churn_probability", "decision_threshold"))
def r06(spark, sf_dir):
    """Responses of a bundle that was saved as a version, verified and loaded again."""
    bundle, recs = _bundle_and_records(spark, sf_dir)
    reg = scratch_path(spark, "registry")
    R.save_version(spark, reg, "v1.0.0", None, bundle.params.to_json(), bundle.threshold,
                   [n for _, n, _ in bundle.params.feature_names()], "fixed_model", bundle.total_charges_median, bundle.scorer)
    return I.score_records(recs, R.load_bundle(spark, reg))


_FIXED_SCORER = hashlib.sha256(json.dumps({"intercept": FIXED_MODEL.intercept, "weights": FIXED_MODEL.weights}).encode()).hexdigest()


@register("r07_fixed_manifest", sql=WFIT + f""",
names AS (SELECT * FROM ({_names_sql()})),
model AS (SELECT 'fixed_model' AS model_name, 'v2.0.0' AS version, {ES.dl(C.DEPLOYED_THRESHOLD)} AS threshold,
  CAST((SELECT count(*) FROM names) AS INTEGER) AS n_features)
SELECT model.*, 'feature_names.json' AS file,
  sha256('["' || (SELECT string_agg(name, '", "' ORDER BY idx) FROM names) || '"]') AS sha256 FROM model
UNION ALL
SELECT model.*, 'threshold.json', sha256('{{"threshold": {C.DEPLOYED_THRESHOLD!r}, "total_charges_median": '
  || (SELECT CAST(median(TotalCharges) AS VARCHAR) FROM with_folds WHERE split = 'train') || '}}') FROM model
UNION ALL
SELECT model.*, 'scorer.json', '{_FIXED_SCORER}' FROM model""", doubles=("threshold",))
def r07(spark, sf_dir):
    """R2: the manifest of the fixed model; all files but the fitted parameters, whose digits SQL can't write."""
    reg = _save_fixed(spark, sf_dir, "v2.0.0")
    return R.manifest_frame(spark, reg, "v2.0.0").select(
        "model_name", "version", "threshold", "n_features", F.explode("checksums").alias("file", "sha256")).where("file <> 'prep_params.json'")


@register("r08_fixed_model_info", sql=WFIT + f"""
SELECT 'fixed_model' AS model_name, 'v2.0.0' AS version, 'LinearScorer' AS model_class, {ES.dl(C.DEPLOYED_THRESHOLD)} AS threshold,
  CAST(count(*) AS INTEGER) AS n_features, CAST(4 AS INTEGER) AS n_artifacts FROM ({_names_sql()})""", doubles=("threshold",))
def r08(spark, sf_dir):
    """The information record of the fixed model's version."""
    reg = _save_fixed(spark, sf_dir, "v2.0.0")
    return R.model_info(spark, reg, "v2.0.0").select("model_name", "version", "model_class", "threshold", "n_features", "n_artifacts")


# E17 -----------------------------------------------------------------------
def _report_sql() -> str:
    """The report's rows from separate queries over the scored test rows."""
    def section(name: str, item: str, metrics: dict[str, str], source: str) -> list[str]:
        return [f"SELECT '{name}' AS section, CAST({item} AS VARCHAR) AS item, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM {source}"
                for m, e in metrics.items()]

    same = lambda *names: {n: n for n in names}
    pct = "CAST(round(threshold * 100) AS INTEGER)"
    clipped = f"least(greatest(p, {ES.dl(E.EPS)}), {ES.dl(1 - E.EPS)})"
    pr = f"""(SELECT sum(CAST(pos AS DOUBLE) / P * (CAST(tp AS DOUBLE) / (tp + fp) + CASE WHEN tp - pos + fp - neg = 0 THEN CAST(1 AS DOUBLE)
  ELSE CAST(tp - pos AS DOUBLE) / (tp - pos + fp - neg) END) / 2) FROM {ES.curve_sql(TEST)})"""
    head = {"test_samples": "count(*)", "churn_count": "sum(y)", "churn_rate": "avg(CAST(y AS DOUBLE))", "roc_auc": ES.auc_sql(TEST), "pr_auc": pr,
            "brier_score": "avg((p - y) * (p - y))", "log_loss": f"avg(-(y * ln({clipped}) + (1 - y) * ln(1 - {clipped})))",
            "optimal_threshold": f"(SELECT threshold FROM ({_pick_sql(VAL)}))", "recommended_threshold": "(SELECT threshold FROM rec)"}
    return REC + "\n" + "\nUNION ALL\n".join([
        *section("headline", "''", {k: v for k, v in head.items() if not v.startswith("(SELECT")}, TEST),
        *section("headline", "''", {k: v for k, v in head.items() if v.startswith("(SELECT")}, "(SELECT 1)"),
        *section("threshold", pct, same("recall", "precision", "f1", "net_savings", "kpi_passes"), f"({_comparison_sql()})"),
        *section("fairness", "subgroup_category || '=' || subgroup_value", same("sample_size", "recall", "selection_rate"), f"({_REC_FAIR})"),
        *section("disparity", "subgroup_category", {"recall_range": "max(recall) - min(recall)",
                                                     "selection_range": "max(selection_rate) - min(selection_rate)"},
                 f"({_REC_FAIR}) GROUP BY subgroup_category") ,
        *section("assessment", pct, {"fp_share_pct": "CASE WHEN fp + tp > 0 THEN CAST(fp AS DOUBLE) / (fp + tp) * 100 END"}, "rec")])


@register("e17_evaluation_report", sql=_report_sql(), doubles=("value",))
def e17(spark, sf_dir):
    """The nested report of one plan, read out of its JSON."""
    from .evaluation import evaluation_report, report_rows
    return report_rows(evaluation_report(spark, sf_dir).select("report_json"))


# I6 / I7 -------------------------------------------------------------------
def _run_stream(spark, sf_dir):
    from ..streaming.scoring_stream import start_scoring_stream
    bundle, recs = _bundle_and_records(spark, sf_dir)
    landing = scratch_path(spark, "landing")
    # several files arrive in the landing folder
    recs.repartition(4).write.mode("overwrite").parquet(landing)
    out = scratch_path(spark, "stream_out")
    q = start_scoring_stream(spark, landing, S.SERVING, bundle, out, available_now=True)
    q.awaitTermination()
    return out


@register("i06_stream_scoring", sql=_serving_sql() + "\nSELECT * FROM responses",
          doubles=("churn_probability", "decision_threshold"))
def i06(spark, sf_dir):
    from ..streaming.scoring_stream import read_scored
    return read_scored(spark, _run_stream(spark, sf_dir)).drop("batch_id")


@register("i07_stream_batch_summary", sql=_serving_sql() + """
SELECT count(*) AS total_records, count(*) FILTER (WHERE churn_prediction = 1) AS predicted_churn_count FROM responses""")
def i07(spark, sf_dir):
    from ..streaming.scoring_stream import read_summaries
    s = read_summaries(spark, _run_stream(spark, sf_dir))
    return s.agg(F.sum("total_records").cast("bigint").alias("total_records"),
                 F.sum("predicted_churn_count").cast("bigint").alias("predicted_churn_count"))


@register("i08_stream_repeats", sql=_serving_sql() + f"""
SELECT count(*) AS total_records, count(*) FILTER (WHERE {hash_sql('customer_id', 'replay')} % 100 < 20) AS repeated_records,
  count(*) FILTER (WHERE churn_prediction = 1) AS predicted_churn_count FROM responses""")
def i08(spark, sf_dir):
    """I6 + I7 where a fifth of the records arrives a second time, in other files and micro-batches."""
    from ..sources.dirty import percent
    from ..streaming.scoring_stream import read_summaries, start_scoring_stream
    bundle, recs = _bundle_and_records(spark, sf_dir)
    landing = scratch_path(spark, "landing")
    recs.repartition(3).write.mode("overwrite").parquet(landing)
    recs.where(percent("replay") < 20).repartition(2).write.mode("append").parquet(landing)
    out = scratch_path(spark, "stream_out")
    start_scoring_stream(spark, landing, S.SERVING, bundle, out, max_files_per_trigger=2, repeats_within="7 days").awaitTermination()
    return read_summaries(spark, out).agg(*[F.sum(c).cast("bigint").alias(c) for c in (
        "total_records", "repeated_records", "predicted_churn_count")])


@register("s06_json_report_sink", sql=_report_sql(), doubles=("value",))
def s06(spark, sf_dir):
    """S6 + S7: the evaluation report written as JSON and read back with a fixed schema."""
    from ..sources.sinks import write_json_report
    from .evaluation import evaluation_report, report_rows
    path = write_json_report(evaluation_report(spark, sf_dir).select("report_json"), scratch_path(spark, "report"))
    return report_rows(spark.read.schema("report_json string").json(path))


# Dedicated checks for ids otherwise exercised inside other queries -------------
@register("j01_inner_equi_join", sql=W + """
SELECT ContractType, count(*) AS n_rows, count(DISTINCT CustomerID) AS n_keys FROM joined GROUP BY ContractType""")
def j01(spark, sf_dir):
    """Three-way inner equi-join on the key; rows and distinct keys per contract type."""
    j = load_joined(source_tables(spark, sf_dir))
    return j.groupBy("ContractType").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(C.KEY_COL).alias("n_keys"))


@register("p06_nonzero_filter", sql=W + "\nSELECT * FROM (\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') AS n_missing FROM joined"
    for c in ["CustomerID", "Tenure", "ContractType", "PaymentMethod", "PaperlessBilling", "Churn", "Gender", "SeniorCitizen",
              "Dependents", "Partner", "MonthlyCharges", "TotalCharges", "PhoneService", "MultipleLines", "InternetService",
              "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies"])
    + "\n) WHERE n_missing > 0")
def p06(spark, sf_dir):
    """A per-column profile of missing-or-blank cells, keeping only the non-zero entries."""
    j = common.joined(spark, sf_dir)
    wide = j.agg(*[F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(c) for c in j.columns])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing"))
                                          for c in j.columns])).alias("x")).select("x.*")
    return long.where(F.col("n_missing") > 0)


@register("p10_columns_by_dtype", sql=W + """
SELECT kind, count(*) AS n_columns, CAST(sum(non_null) AS BIGINT) AS non_null_cells FROM (
""" + "\nUNION ALL\n".join(
    f"SELECT '{'numeric' if c in ('Tenure', 'SeniorCitizen', 'MonthlyCharges', 'TotalCharges', 'Churn', 'PaperlessBilling', 'Dependents', 'Partner', 'PhoneService', 'Gender') else 'string'}' AS kind, count({c}) AS non_null FROM cleaned"
    for c in ["CustomerID", "Tenure", "ContractType", "PaymentMethod", "PaperlessBilling", "Churn", "Gender", "SeniorCitizen",
              "Dependents", "Partner", "MonthlyCharges", "TotalCharges", "PhoneService", "MultipleLines", "InternetService",
              "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies"])
    + "\n) GROUP BY kind")
def p10(spark, sf_dir):
    """P10: columns split by schema type (numeric vs string) with their non-null cell counts."""
    from ..operators.profile import numeric_columns, string_columns
    t = common.cleaned(spark, sf_dir)
    kinds = {**{c: "numeric" for c in numeric_columns(t)}, **{c: "string" for c in string_columns(t)}}
    counts = t.agg(*[F.count(F.col(c)).alias(c) for c in kinds])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("non_null"))
                                            for c, k in kinds.items()])).alias("x")).select("x.*")
    return long.groupBy("kind").agg(F.count(F.lit(1)).alias("n_columns"), F.sum("non_null").cast("bigint").alias("non_null_cells"))


@register("s03_csv_sink", sql=with_ctes(joined_ctes(), split_ctes()) + """
SELECT split, count(*) AS n_rows, CAST(sum(Churn) AS BIGINT) AS n_positive, count(TotalCharges) AS n_total_charges FROM with_folds GROUP BY split""")
def s03(spark, sf_dir):
    """S3: the prepared splits written as CSV partitioned by split (no index column) and read back typed."""
    s = common.split_table(spark, sf_dir)
    path = scratch_path(spark, "csv_splits")
    (s.write.mode("overwrite").option("header", True).partitionBy("split").csv(path))
    back = spark.read.option("header", True).schema(
        s.drop("split").schema).csv(path)  # partition column split is recovered from the folder names
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("Churn").cast("bigint").alias("n_positive"),
                                     F.count("TotalCharges").alias("n_total_charges"))


@register("s07_json_metadata_source", sql=with_ctes(joined_ctes(), split_ctes()) + fe_ctes(
    "with_folds", "(SELECT median(TotalCharges) FROM with_folds WHERE split = 'train')", name="fe_s") + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", avg(CAST({c} AS DOUBLE)) AS mean, stddev_pop(CAST({c} AS DOUBLE)) AS std "
    f"FROM fe_s WHERE split = 'train'" for c in C.FE_NUMERIC_COLS), doubles=("mean", "std"))
def s07(spark, sf_dir):
    """S6 + S7: fitted parameters saved as a JSON document and read back with a fixed schema."""
    _, bundle = common.fitted(spark, sf_dir)
    path = scratch_path(spark, "params") + "/prep_params"
    # written through Spark so the shared folder may be any Hadoop file system
    spark.createDataFrame([(bundle.params.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    doc = spark.read.schema("means map<string,double>, stds map<string,double>, numeric_cols array<string>") \
        .option("multiLine", True).json(path)
    return doc.select(F.explode("numeric_cols").alias("column"), "means", "stds").select(
        "column", F.col("means")[F.col("column")].alias("mean"), F.col("stds")[F.col("column")].alias("std"))
