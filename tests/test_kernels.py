"""Property tests of the scale kernels against brute force."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from attrix import config as C
from attrix.operators import evaluate as E
from attrix.operators.ranks import cum_counts, dist_mode, dist_quantiles, dist_rank, hash32


def test_sweep_grid_matches_arange_semantics():
    ths = C.sweep_thresholds()
    assert len(ths) == 81
    assert ths[39] == 0.48999999999999977
    assert ths[-1] == 0.8999999999999996


def test_dist_rank_equals_single_window(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("g"))
    h = df.withColumn("h", hash32(F.col("k"), "x"))
    got = dist_rank(h, "h", "k", by=["g"], out="r", bucket_bits=6)
    ref = h.withColumn("r2", F.row_number().over(Window.partitionBy("g").orderBy("h", "k")))
    j = got.join(ref, ["k", "g"])
    assert j.where(F.col("r") != F.col("r2")).count() == 0
    assert j.count() == 3000


def _scored(spark, n=2000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        y = 1 if rnd.random() < 0.3 else 0
        p = round(min(1.0, max(0.0, rnd.gauss(0.35 + 0.3 * y, 0.2))), 2)  # rounding makes ties
        rows.append((y, p))
    return spark.createDataFrame(rows, "y int, p double"), rows


def _brute_auc(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    s = 0.0
    for a in pos:
        for b in neg:
            s += 1.0 if a > b else 0.5 if a == b else 0.0
    return s / (len(pos) * len(neg))


def test_roc_auc_tie_aware_and_reversal(spark):
    df, rows = _scored(spark)
    auc = E.roc_auc(df).first()["roc_auc"]
    assert auc == pytest.approx(_brute_auc(rows), abs=1e-12)
    rev = E.roc_auc(df.withColumn("p", -F.col("p"))).first()["roc_auc"]
    assert rev == pytest.approx(1 - auc, abs=1e-12)


def test_cum_counts_equals_single_window(spark):
    df, rows = _scored(spark)
    got = {r.score: (r.tp, r.fp) for r in cum_counts(df).collect()}
    tp = fp = 0
    for score in sorted({p for _, p in rows}, reverse=True):
        tp += sum(1 for y, p in rows if p == score and y == 1)
        fp += sum(1 for y, p in rows if p == score and y == 0)
        assert got[score] == (tp, fp)


def test_pr_auc_trapezoid(spark):
    df, rows = _scored(spark)
    scores = sorted({p for _, p in rows}, reverse=True)
    P = sum(y for y, _ in rows)
    tp = fp = 0
    prev_prec, area = 1.0, 0.0
    for s in scores:
        pos = sum(1 for y, p in rows if p == s and y == 1)
        neg = sum(1 for y, p in rows if p == s and y == 0)
        tp += pos
        fp += neg
        prec = tp / (tp + fp)
        area += pos / P * (prec + prev_prec) / 2
        prev_prec = prec
    assert E.pr_auc(df).first()["pr_auc"] == pytest.approx(area, abs=1e-12)


def test_threshold_kernel_equals_direct_counts(spark):
    df, rows = _scored(spark)
    got = {round(r.threshold, 10): (r.tn, r.fp, r.fn, r.tp) for r in E.counts_at_thresholds(df, C.sweep_thresholds()).collect()}
    for t in C.sweep_thresholds():
        tp = sum(1 for y, p in rows if p >= t and y == 1)
        fp = sum(1 for y, p in rows if p >= t and y == 0)
        fn = sum(1 for y, p in rows if p < t and y == 1)
        tn = sum(1 for y, p in rows if p < t and y == 0)
        assert got[round(t, 10)] == (tn, fp, fn, tp)


def test_confusion_counts_sum_to_n(spark):
    df, rows = _scored(spark)
    r = E.confusion(df, 0.5).first()
    assert r.tn + r.fp + r.fn + r.tp == len(rows)


def test_pick_threshold_first_branch_with_sharp_score(spark):
    rows = [(1, 0.9)] * 80 + [(1, 0.3)] * 5 + [(0, 0.2)] * 300 + [(0, 0.8)] * 10
    df = spark.createDataFrame(rows, "y int, p double")
    sweep = E.threshold_sweep(df)
    pick = E.pick_threshold(sweep).first()
    assert pick.rule == 1
    assert pick.recall >= 0.75 and pick.precision >= 0.5


def test_pick_threshold_fallback_max_recall(spark):
    rows = [(1, 0.05)] * 10 + [(0, 0.95)] * 10
    pick = E.pick_threshold(E.threshold_sweep(spark.createDataFrame(rows, "y int, p double"))).first()
    assert pick.rule == 3 and pick.threshold == 0.1


def test_financial_impact_golden(spark):
    # (targeted, caught) -> net = caught * 0.5 * 3000 - targeted * 150; ROI = net / cost * 100
    df = spark.createDataFrame([(437 - 220, 220, 0, 0), (427 - 217, 217, 0, 0)], "fp bigint, tp bigint, fn bigint, tn bigint")
    r48, r49 = E.financial_impact_cols(df).collect()
    assert r48.net_savings == 264450.0 and r48.roi_pct == pytest.approx(403.4, abs=0.05)
    assert r49.net_savings == 261450.0 and r49.roi_pct == pytest.approx(408.2, abs=0.05)


def test_fairness_single_class_subgroup(spark):
    rows = [(0, 0.9, "A")] * 5 + [(1, 0.9, "B")] * 5
    df = spark.createDataFrame(rows, "y int, p double, Gender string")
    f = {r.subgroup_value: r for r in E.subgroup_fairness(df, 0.5, ["Gender"]).collect()}
    assert f["A"].recall == 0.0 and f["A"].precision == 0.0
    assert f["B"].recall == 1.0


def test_dist_rank_hot_stratum_spreads_over_buckets(spark):
    # 90 % of the rows in one class: the rank is still exact and the row-level window runs per bucket
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"),
                                  F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("g"))
    h = df.withColumn("h", hash32(F.col("k"), "hot"))
    got = dist_rank(h, "h", "k", by=["g"], out="r", bucket_bits=8)
    per_class = {r.g: (r.n, r.lo, r.hi, r.d) for r in got.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"),
        F.count_distinct("r").alias("d")).collect()}
    assert per_class[0] == (4500, 1, 4500, 4500)
    assert per_class[1] == (500, 1, 500, 500)
    buckets = h.where("g = 0").select(F.shiftright("h", 24).alias("b")).distinct().count()
    assert buckets > 200  # the hot class is cut into many window partitions


def test_threshold_counts_with_hot_score(spark):
    # one score value carries a third of the rows: grouped first, counts stay exact
    rows = [(1, 0.5)] * 300 + [(0, 0.5)] * 200 + [(1, 0.9)] * 100 + [(0, 0.1)] * 400
    df = spark.createDataFrame(rows, "y int, p double")
    got = {round(r.threshold, 2): (r.tp, r.fp) for r in E.counts_at_thresholds(df, [0.5, 0.51]).collect()}
    assert got[0.5] == (400, 200) and got[0.51] == (100, 0)
    assert E.roc_auc(df).first()["roc_auc"] == pytest.approx(_brute_auc(rows), abs=1e-12)


def test_dist_rank_with_hot_duplicate_key(spark):
    # one key value holds a third of the rows: it is numbered per input partition and the ranks stay exact
    hot = spark.range(1500).select(F.lit("HOT").alias("k"), F.lit(0).alias("g"))
    rest = spark.range(3000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 2).alias("g"))
    df = hot.unionByName(rest).withColumn("h", hash32(F.col("k"), "x"))
    got = dist_rank(df, "h", "k", by=["g"], out="r", bucket_bits=6)
    ref = df.withColumn("r2", F.row_number().over(Window.partitionBy("g").orderBy("h", "k")))
    # exact ranks are a permutation 1..n per class and agree with the single window up to ties
    a = got.groupBy("g").agg(F.count("r").alias("n"), F.count_distinct("r").alias("d"), F.min("r").alias("lo"),
                             F.max("r").alias("hi")).orderBy("g").collect()
    assert [(r.n, r.d, r.lo, r.hi) for r in a] == [(3000, 3000, 1, 3000), (1500, 1500, 1, 1500)]
    per_key_got = got.groupBy("g", "k").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    per_key_ref = ref.groupBy("g", "k").agg(F.min("r2").alias("lo"), F.max("r2").alias("hi"))
    assert per_key_got.exceptAll(per_key_ref).count() == 0


def test_dist_rank_behind_a_shuffle_join_with_a_wide_payload(spark):
    # tags are stored before they are used: a plan that could number rows anew still loses none
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], "-1")
        spark.conf.set(keys[1], "64k")
        a = spark.range(8000).select(F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.col("id").cast("string")).alias("k"),
                                     F.col("id"), F.repeat(F.lit("x"), 200).alias("payload"))
        b = spark.range(8000).select("id", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 2).alias("g"))
        df = a.join(b, "id").withColumn("h", hash32(F.col("k"), "x"))
        got = dist_rank(df, "h", "k", by=["g"], out="r", bucket_bits=4)
        per = {r.g: (r.n, r.d, r.lo, r.hi) for r in got.groupBy("g").agg(
            F.count("r").alias("n"), F.count_distinct("r").alias("d"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect()}
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)
    assert per == {None: (1600, 1600, 1, 1600), 0: (3200, 3200, 1, 3200), 1: (3200, 3200, 1, 3200)}


def test_dist_quantiles_match_interpolated_percentiles(spark):
    df = spark.range(200_000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 100_003).cast("double").alias("value"))
    df = df.unionByName(spark.createDataFrame([(0, None), (0, float("nan"))], "g long, value double"))
    got = {(r.g, r.prob): r.quantile for r in dist_quantiles(df, [0.0, 0.25, 0.5, 0.9], ["g"]).collect()}
    ref = df.where("value IS NOT NULL AND NOT isnan(value)").groupBy("g").agg(
        F.percentile("value", F.array(*map(F.lit, [0.0, 0.25, 0.5, 0.9]))).alias("q")).collect()
    for r in ref:
        for p, q in zip([0.0, 0.25, 0.5, 0.9], r.q):
            assert got[r.g, p] == pytest.approx(q, abs=1e-9)
    one = dist_quantiles(spark.createDataFrame([(3.0,)], "value double"), [0.5]).collect()
    assert [(r.prob, r.quantile) for r in one] == [(0.5, 3.0)]
    assert dist_quantiles(spark.createDataFrame([], "value double"), [0.5]).count() == 0


def test_dist_mode_takes_the_smallest_of_equals(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (1, "b"), (2, None), (2, "z")], "g int, value string")
    assert {r.g: r.mode for r in dist_mode(df, ["g"]).collect()} == {1: "a", 2: "z"}
