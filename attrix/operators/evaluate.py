"""Evaluation operators (E1-E18) over a scored table ``(y, p, ...)``.

Threshold metrics for many thresholds come from ONE pass: each row is
bucketed by how many thresholds it passes, the (<= thresholds+1)-row
bucket table is suffix-summed, and every threshold reads its counts from
it. Curves and areas use ``cum_counts`` (no single-partition window over
rows).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from .ranks import cum_counts, join_null_safe

EPS = 2.220446049250313e-16  # float64 machine epsilon (log-loss clipping)


def _div0(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rates_from_counts(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    """E2 from the four counts; empty denominators give 0."""
    n = tn + fp + fn + tp
    return {
        "accuracy": _div0(tp + tn, n),
        "precision": _div0(tp, tp + fp),
        "recall": _div0(tp, tp + fn),
        "specificity": _div0(tn, tn + fp),
        "f1": _div0(F.lit(2) * tp, F.lit(2) * tp + fp + fn),
    }


# E1 / E2 -------------------------------------------------------------------
def confusion(scored: DataFrame, threshold: float, y: str = "y", p: str = "p") -> DataFrame:
    pred = F.col(p) >= F.lit(float(threshold))
    pos = F.col(y) == 1
    return scored.agg(
        F.count_if(~pred & ~pos).alias("tn"), F.count_if(pred & ~pos).alias("fp"),
        F.count_if(~pred & pos).alias("fn"), F.count_if(pred & pos).alias("tp"),
    )


def threshold_metrics(scored: DataFrame, threshold: float, y: str = "y", p: str = "p") -> DataFrame:
    cm = confusion(scored, threshold, y, p)
    r = rates_from_counts(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp"))
    return cm.select(F.lit(float(threshold)).alias("threshold"), *[v.alias(k) for k, v in r.items()],
                     "tn", "fp", "fn", "tp")


# E9 / E11 kernel -------------------------------------------------------------
def counts_at_thresholds(scored: DataFrame, thresholds: Sequence[float | Column], y: str = "y", p: str = "p") -> DataFrame:
    """(idx, threshold, tn, fp, fn, tp) for every threshold from one pass over the rows.

    Thresholds that are columns must be constants, such as scalar subqueries; an equal one is listed once.
    """
    spark = scored.sparkSession
    fixed = all(not isinstance(t, Column) for t in thresholds)
    ths = [t if isinstance(t, Column) else F.lit(float(t)) for t in (sorted(thresholds) if fixed else thresholds)]
    arr = F.sort_array(F.array(*ths))
    # thresholds t with p >= t; subqueries can't stand in a lambda
    passed = F.size(F.filter(arr, lambda t: t <= F.col(p))) if fixed else reduce(lambda a, b: a + b, [
        F.when(F.col(p) >= t, 1).otherwise(0) for t in ths])
    buckets = scored.select(passed.alias("k"), (F.col(y) == 1).cast("int").alias("pos")).groupBy("k").agg(
        F.sum("pos").cast("bigint").alias("bp"), F.count(F.lit(1)).alias("bn_all"))
    one = spark.range(1)
    full = one.select(F.explode(F.sequence(F.lit(0), F.size(arr))).alias("k"))
    # len(thresholds)+1 rows: the unpartitioned windows run on a bounded table
    w = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wa = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    suf = (full.join(F.broadcast(buckets), "k", "left")
           .select("k", F.coalesce("bp", F.lit(0)).alias("bp"),
                   (F.coalesce("bn_all", F.lit(0)) - F.coalesce("bp", F.lit(0))).alias("bn"))
           .select("k", F.sum("bp").over(w).alias("tp_ge"), F.sum("bn").over(w).alias("fp_ge"),
                   F.sum("bp").over(wa).alias("P"), F.sum("bn").over(wa).alias("N")))
    th_df = one.select(F.posexplode(arr).alias("idx", "threshold"))
    j = th_df.join(F.broadcast(suf), th_df.idx + 1 == suf.k)
    j = j if fixed else j.dropDuplicates(["threshold"])  # equal thresholds have equal counts
    return j.select(
        "idx", "threshold",
        (F.col("N") - F.col("fp_ge")).cast("bigint").alias("tn"), F.col("fp_ge").cast("bigint").alias("fp"),
        (F.col("P") - F.col("tp_ge")).cast("bigint").alias("fn"), F.col("tp_ge").cast("bigint").alias("tp"),
    )


def net_savings(tp: Column, fp: Column, costs: C.Costs = C.Costs()) -> Column:
    """B1: TP x retention x CLV - (TP + FP) x cost."""
    return tp * F.lit(costs.retention_rate * costs.clv) - (tp + fp) * F.lit(float(costs.cost_per_head))


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float] | None = None, y: str = "y", p: str = "p",
                    costs: C.Costs = C.Costs()) -> DataFrame:
    """Recall, precision, F1 and net savings at each threshold (stored rounded to 2 places)."""
    ths = C.sweep_thresholds() if thresholds is None else list(thresholds)
    cc = counts_at_thresholds(scored, ths, y, p)
    r = rates_from_counts(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp"))
    return cc.select(
        "idx", F.round(F.col("threshold"), 2).alias("threshold"), F.col("threshold").alias("raw_threshold"),
        r["recall"].alias("recall"), r["precision"].alias("precision"), r["f1"].alias("f1"),
        net_savings(F.col("tp"), F.col("fp"), costs).alias("net_savings"), "tp", "fp",
    )


def pick_threshold(sweep: DataFrame, min_recall: float = C.MIN_RECALL, min_precision: float = C.MIN_PRECISION) -> DataFrame:
    """Max savings with both constraints, else with recall only, else max recall; first row on ties."""
    both = (F.col("recall") >= min_recall) & (F.col("precision") >= min_precision)
    rec = F.col("recall") >= min_recall
    tier = F.when(both, 1).when(rec, 2).otherwise(3)
    # the first non-empty tier wins; inside it: savings (tiers 1, 2) or recall (tier 3), then lowest threshold
    metric = F.when(F.col("tier") == 3, F.col("recall")).otherwise(F.col("net_savings"))
    # the sweep has one row per threshold (81): ordering it is bounded work
    return (sweep.withColumn("tier", tier).withColumn("_m", metric)
            .orderBy(F.col("tier").asc(), F.col("_m").desc(), F.col("idx").asc()).limit(1)
            .select("threshold", "raw_threshold", F.col("tier").alias("rule"), "recall", "precision", "f1", "net_savings"))


# E3 - E8 -------------------------------------------------------------------
def curve_table(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Cumulative table per distinct score, descending, with totals P and N."""
    return cum_counts(scored, p, y).crossJoin(  # one row
        scored.agg(F.count_if(F.col(y) == 1).alias("P"), F.count_if(F.col(y) != 1).alias("N")))


def roc_auc(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Tie-aware area under the ROC curve."""
    ct = curve_table(scored, y, p)
    return ct.agg(F.try_divide(F.sum(F.col("neg") * (F.lit(2) * F.col("tp") - F.col("pos")) / F.lit(2.0)),
                               F.first("P").cast("double") * F.first("N").cast("double")).alias("roc_auc"))


def scores_by(scored: DataFrame, by: Sequence[str], threshold: float = C.DEFAULT_THRESHOLD, y: str = "y", p: str = "p") -> DataFrame:
    """Recall, ROC-AUC (NULL where a class is absent), precision and F1 of every group, in one table."""
    pred, pos = F.col(p) >= F.lit(float(threshold)), F.col(y) == 1
    counts = scored.groupBy(*by).agg(
        F.count_if(~pred & ~pos).alias("tn"), F.count_if(pred & ~pos).alias("fp"),
        F.count_if(~pred & pos).alias("fn"), F.count_if(pred & pos).alias("tp"))
    areas = cum_counts(scored, p, y, by).groupBy(*by).agg(F.try_divide(
        F.sum(F.col("neg") * (F.lit(2) * F.col("tp") - F.col("pos")) / F.lit(2.0)),
        F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("roc_auc"))
    r = rates_from_counts(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp"))
    return join_null_safe(counts, areas, by).select(
        *by, r["recall"].alias("recall"), "roc_auc", r["precision"].alias("precision"), r["f1"].alias("f1"), "tp", "fp")


def pr_auc(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Trapezoid area under the precision-recall curve anchored at (recall 0, precision 1)."""
    ct = curve_table(scored, y, p)
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    before_tp = F.col("tp") - F.col("pos")
    before_n = before_tp + F.col("fp") - F.col("neg")
    prec_before = F.when(before_n == 0, F.lit(1.0)).otherwise(before_tp / before_n)
    return ct.agg(F.sum(F.col("pos") / F.col("P") * (prec + prec_before) / F.lit(2.0)).alias("pr_auc"))


def probability_scores(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """E3 + E4 + E5 + E6 in one row."""
    yy = F.col(y).cast("double")
    pc = F.least(F.greatest(F.col(p), F.lit(EPS)), F.lit(1 - EPS))
    other = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(p) - yy) * (F.col(p) - yy)).alias("brier_score"),
        F.avg(-(yy * F.log(pc) + (F.lit(1.0) - yy) * F.log(F.lit(1.0) - pc))).alias("log_loss"),
    )
    return other.crossJoin(roc_auc(scored, y, p)).crossJoin(pr_auc(scored, y, p)).select(  # one row each
        "n", "roc_auc", "pr_auc", "brier_score", "log_loss")


def roc_curve(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score."""
    ct = curve_table(scored, y, p)
    return ct.select(F.col("score").alias("threshold"), _div0(F.col("fp"), F.col("N")).alias("fpr"),
                     _div0(F.col("tp"), F.col("P")).alias("tpr"))


def pr_curve(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, precision, recall) at every distinct score plus the prevalence baseline."""
    ct = curve_table(scored, y, p)
    return ct.select(F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                     _div0(F.col("tp"), F.col("P")).alias("recall"),
                     (F.col("P") / (F.col("P") + F.col("N"))).alias("baseline"))


# E11 / E12 / E13 -------------------------------------------------------------
def candidate_thresholds(tuned: float | Column | None = None, base: Sequence[float] = C.CANDIDATE_THRESHOLDS) -> list[float | Column]:
    s = sorted(set(float(t) for t in base))
    if isinstance(tuned, Column):
        return [*s, tuned]
    return s if tuned is None else sorted({*s, float(tuned)})


def threshold_comparison(scored: DataFrame, thresholds: Sequence[float | Column], y: str = "y", p: str = "p",
                         costs: C.Costs = C.Costs(), kpi: dict = C.KPI_TARGETS) -> DataFrame:
    """E11 + E12 + B2 per candidate threshold (one pass over rows for all thresholds)."""
    cc = counts_at_thresholds(scored, thresholds, y, p).crossJoin(roc_auc(scored, y, p))  # one row
    r = rates_from_counts(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp"))
    m = cc.select("idx", "threshold", "tn", "fp", "fn", "tp", *[v.alias(k) for k, v in r.items()], "roc_auc")
    m = m.withColumns({
        "recall_pass": F.col("recall") >= kpi["recall"],
        "roc_auc_pass": F.coalesce(F.col("roc_auc") >= kpi["roc_auc"], F.lit(False)),
        "precision_pass": F.col("precision") >= kpi["precision"],
        "f1_pass": F.col("f1") >= kpi["f1"],
    })
    m = m.withColumn("kpi_passes", (F.col("recall_pass").cast("int") + F.col("roc_auc_pass").cast("int")
                                    + F.col("precision_pass").cast("int") + F.col("f1_pass").cast("int")))
    return financial_impact_cols(m, costs)


def financial_impact_cols(m: DataFrame, costs: C.Costs = C.Costs()) -> DataFrame:
    """B2 columns from (tn, fp, fn, tp)."""
    targeted = F.col("tp") + F.col("fp")
    saved = F.col("tp") * F.lit(costs.retention_rate) * F.lit(float(costs.clv))
    cost = targeted * F.lit(float(costs.cost_per_head))
    net = saved - cost
    return m.withColumns({
        "unmitigated_loss": ((F.col("tp") + F.col("fn")) * F.lit(float(costs.clv))),
        "targeted": targeted.cast("bigint"),
        "caught": F.col("tp").cast("bigint"),
        "retained": F.col("tp") * F.lit(costs.retention_rate),
        "saved_revenue": saved,
        "campaign_cost": cost,
        "net_savings": net,
        "roi_pct": F.when(cost > 0, net / cost * F.lit(100.0)).otherwise(F.lit(0.0)),
    })


def recommend_threshold(comparison: DataFrame) -> DataFrame:
    """Most KPIs passed, then most savings, then the lowest threshold."""
    # one row per candidate threshold (<= 7): bounded ordering
    return comparison.orderBy(F.col("kpi_passes").desc(), F.col("net_savings").desc(), F.col("threshold").asc()).limit(1) \
        .select(F.col("threshold").alias("recommended_threshold"), "kpi_passes", "net_savings")


# E14 / E15 -----------------------------------------------------------------
def subgroup_fairness(scored: DataFrame, threshold: float | Column, cols: Sequence[str] = C.FAIRNESS_COLS,
                      y: str = "y", p: str = "p") -> DataFrame:
    """Per (attribute, value): size, actual rate, selection rate, recall, precision, F1.

    The attributes are unpivoted and counted in one ``groupBy``.
    """
    pred = (F.col(p) >= (threshold if isinstance(threshold, Column) else F.lit(float(threshold)))).cast("int")
    long = scored.select(F.col(y).alias("_y"), pred.alias("_pred"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("subgroup_category"), F.col(c).cast("string").alias("subgroup_value")) for c in cols
    ])).alias("g")).select("g.*", "_y", "_pred")
    agg = long.groupBy("subgroup_category", "subgroup_value").agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.avg(F.col("_y").cast("double")).alias("actual_churn_rate"),
        F.avg(F.col("_pred").cast("double")).alias("selection_rate"),
        F.count_if((F.col("_pred") == 1) & (F.col("_y") == 1)).alias("tp"),
        F.count_if((F.col("_pred") == 1) & (F.col("_y") != 1)).alias("fp"),
        F.count_if((F.col("_pred") != 1) & (F.col("_y") == 1)).alias("fn"),
    )
    return agg.select(
        "subgroup_category", "subgroup_value", "sample_size", "actual_churn_rate", "selection_rate",
        _div0(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        _div0(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _div0(F.lit(2) * F.col("tp"), F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1_score"),
    )


def disparity_flags(fairness: DataFrame, recall_gap: float = C.RECALL_GAP_LIMIT,
                    selection_gap: float = C.SELECTION_GAP_LIMIT) -> DataFrame:
    """Per attribute, recall and selection-rate ranges with flags and the extreme groups."""
    return fairness.groupBy("subgroup_category").agg(
        (F.max("recall") - F.min("recall")).alias("recall_range"),
        (F.max("selection_rate") - F.min("selection_rate")).alias("selection_range"),
        F.min_by("subgroup_value", F.struct(F.col("recall"), F.col("subgroup_value"))).alias("lowest_recall_group"),
        F.min_by("subgroup_value", F.struct((-F.col("recall")).alias("nr"), F.col("subgroup_value"))).alias("highest_recall_group"),
    ).withColumns({
        "recall_gap_flag": F.col("recall_range") > recall_gap,
        "selection_gap_flag": F.col("selection_range") > selection_gap,
    })


# E16 -----------------------------------------------------------------------
def assessment_flags(metrics_row: DataFrame, fp_share_limit: float = C.FP_SHARE_LIMIT,
                     specificity_floor: float = C.SPECIFICITY_FLOOR) -> DataFrame:
    """Strength/weakness flags of one threshold-comparison row."""
    flagged = F.col("fp") + F.col("tp")
    share = F.when(flagged > 0, F.col("fp") / flagged * F.lit(100.0))
    return metrics_row.select(
        "threshold", "recall_pass", "precision_pass", "f1_pass", "roc_auc_pass",
        share.alias("fp_share_pct"),
        F.coalesce(share > fp_share_limit, F.lit(False)).alias("fp_share_flag"),
        (F.col("specificity") < specificity_floor).alias("low_specificity_flag"),
    )


# E18 -----------------------------------------------------------------------
def reproducibility(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` missing in ``b`` and vice versa (multiset difference); both 0 = identical."""
    missing = lambda x, y, name: x.exceptAll(y).agg(F.count(F.lit(1)).alias(name))
    return missing(a, b, "only_in_first").crossJoin(missing(b, a, "only_in_second"))  # one row each


#: Modulus of the row hashes' sums: a prime below 2 ** 61, so that a sum of two fits 64 bits.
DIGEST_PRIME = 2305843009213693921


def multiset_digest(df: DataFrame, row_text: Column, out: str = "digest") -> DataFrame:
    """One row: the number of rows and an order-independent digest of ``row_text`` over them.

    Each row's text is hashed to two numbers of 60 bits, which are summed; equal multisets of rows give equal digests
    however they are partitioned, and a row more, less or changed gives another one. Partial sums make it one row a task.
    """
    half = lambda k: F.conv(F.substring(F.md5(row_text), k, 15), 16, 10).cast("decimal(38,0)")
    sums = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.coalesce(F.sum(half(k)), F.lit(0)).alias(f"s{k}") for k in (1, 16)])
    parts = [(F.col(f"s{k}") % F.lit(DIGEST_PRIME).cast("decimal(38,0)")).cast("bigint").cast("string") for k in (1, 16)]
    return sums.select("n_rows", F.concat_ws("-", *parts).alias(out))
