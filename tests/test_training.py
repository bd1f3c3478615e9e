"""Invariants of fits, folds, searches and their kept results."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from attrix import config as C
from attrix.operators import batched, boosting
from attrix.operators import evaluate as E
from attrix.operators import models as M
from attrix.plans import training as T


@pytest.fixture(scope="module")
def data(spark):
    """A model input with two informative features, folds and splits."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(600):
        x = rng.normal(size=3)
        y = float(x[0] - 0.5 * x[1] + rng.normal() > 0.6)
        rows.append((f"C{k:04d}", y, [float(v) for v in x], "train" if k % 5 else "val", k % 5 and (k // 5) % C.N_FOLDS))
    df = spark.createDataFrame(rows, "CustomerID string, label double, x array<double>, split string, fold int")
    return df.select("CustomerID", "label", array_to_vector("x").alias("features"), "split", "fold").checkpoint()


def test_logistic_regression_is_at_its_optimum(data):
    train = M.balanced_weights(data.where("split = 'train'"))
    model = T.make_estimator("logistic_regression", train, {"C": 0.7}).fit(train)
    rows = train.select("label", "weight", "features").collect()
    x, y, w = np.array([r.features.toArray() for r in rows]), np.array([r.label for r in rows]), np.array([r.weight for r in rows])
    coefficients = model.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ coefficients + model.intercept)))
    gradient = x.T @ (w * (p - y)) + coefficients / 0.7  # of sum of losses and half the squared norm over C
    assert np.abs(gradient).max() < 1e-2 * w.sum() / 10 and abs((w * (p - y)).sum()) < 1e-2


def test_fits_are_deterministic(data):
    a, b = (T.scores(T.predictions(T.fit("random_forest", data.where("split = 'train'"), {"n_trees": 5}),
                                   data.where("split = 'val'"))) for _ in range(2))
    assert a == b


def test_importances_sum_to_one(data):
    model = T.fit("random_forest", data.where("split = 'train'"), {"n_trees": 10})
    assert model.featureImportances.toArray().sum() == pytest.approx(1.0)
    assert model.featureImportances[0] > model.featureImportances[2]


def test_forests_grow_as_deep_as_spark_allows():
    assert M.random_forest(3).getMaxDepth() == 30


def test_an_auc_of_one_class_stays_undefined(spark):
    one = spark.createDataFrame([(1, 0.2), (1, 0.7)], "y int, p double")
    assert E.roc_auc(one).first()["roc_auc"] is None
    assert M.optional(None) is None and M.mean([None, 0.5, 0.7]) == pytest.approx(0.6) and M.mean([None]) is None
    table = M.summarize_cv(spark, {"m": [
        {"fold": 0, "recall": 0.5, "roc_auc": None, "precision": 0.2, "f1": 0.3},
        {"fold": 1, "recall": 0.7, "roc_auc": 0.8, "precision": 0.4, "f1": 0.5}]}).first()
    assert (table.recall_mean, table.roc_auc_mean, table.recall_std) == (pytest.approx(0.6), 0.8, pytest.approx(0.1))


def test_grid_wins_ties_and_undefined_scores_lose():
    grid, rand = [{"C": 1.0, "mean_roc_auc": 0.8}], [{"C": 2.0, "mean_roc_auc": 0.8}, {"C": 3.0, "mean_roc_auc": None}]
    assert M.search_winner(grid, rand)["search"] == "grid"
    assert M.search_winner([{"C": 1.0, "mean_roc_auc": None}], rand)["search"] == "random"


def test_kept_results_follow_the_data_and_the_settings(spark, data):
    calls = []

    def build():
        calls.append(1)
        return len(calls)

    assert T.fitted_once(spark, data, "kept-test", [1], build) == 1
    assert T.fitted_once(spark, data.repartition(3), "kept-test", [1], build) == 1  # same rows in another order
    assert T.fitted_once(spark, data, "kept-test", [2], build) == 2
    other = data.withColumn("label", F.when(F.col("CustomerID") == "C0001", 1 - F.col("label")).otherwise(F.col("label")))
    assert T.fitted_once(spark, other, "kept-test", [1], build) == 3


def arrays(df):
    rows = df.select("label", "fold", "features").collect()
    return (np.array([r.features.toArray() for r in rows]), np.array([r.label for r in rows]), np.array([r.fold for r in rows]))


@pytest.mark.parametrize("l1_ratio", [0.0, 1.0, 0.5])
def test_batched_fits_are_at_their_optimum(data, l1_ratio):
    """The conditions of the penalised optimum hold for every C and fold, with exact zeros under L1."""
    problems = [batched.Problem(c, l1_ratio, f) for c in (0.001, 0.01, 0.7, 10.0) for f in (None, *range(C.N_FOLDS))]
    fitted = T.batch_fit(data, problems)
    x, y, fold = arrays(data.where("split = 'train'"))
    for f in fitted:
        p, own = f.problem, fold != f.problem.fold
        n = np.array([(y[own] == k).sum() for k in (0, 1)])
        w = np.where(own, (n.sum() / (2 * n))[y.astype(int)], 0)
        slope = w * (1 / (1 + np.exp(-(x @ f.coefficients + f.intercept))) - y)
        gradient = x.T @ slope + (1 - l1_ratio) / p.C * f.coefficients
        zero, lam = f.coefficients == 0, l1_ratio / p.C
        assert abs(slope.sum()) < 1e-4 and np.all(np.abs(gradient[zero]) <= lam + 1e-4)
        assert np.allclose(gradient[~zero], -lam * np.sign(f.coefficients[~zero]), atol=1e-4)
    assert max(f.sweeps for f in fitted) < 30
    if l1_ratio == 1.0:
        assert any((f.coefficients == 0).all() for f in fitted) and any((f.coefficients != 0).all() for f in fitted)


def test_batched_fit_equals_spark_ml(data):
    train = M.balanced_weights(data.where("split = 'train'"))
    own = T.batch_fit(data, [batched.Problem(0.7, 0.0)])[0]
    lib = T.make_estimator("logistic_regression", train, {"C": 0.7}).fit(train)
    assert np.allclose(own.coefficients, lib.coefficients.toArray(), atol=1e-3) and own.intercept == pytest.approx(lib.intercept, abs=1e-3)


def test_batched_fit_of_collinear_and_constant_columns(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(rng.random() < (0.8 if k % 3 == 0 else 0.3)), [float(k % 3 == j) for j in range(3)] + [1.0], "train", k % 5)
            for k in range(300)]
    df = spark.createDataFrame(rows, "id int, label double, x array<double>, split string, fold int").select(
        "label", array_to_vector("x").alias("features"), "split", "fold")
    for f in T.batch_fit(df, [batched.Problem(c, r) for c in (0.01, 1.0, 100.0) for r in (0.0, 1.0)]):
        assert np.isfinite(f.coefficients).all() and f.sweeps < 100
        assert abs(f.coefficients[3]) < 1e-6  # the unpenalised intercept takes the constant's part


def brute_tree(x, y, margin, weight, s, bins):
    """A Newton tree by trying every split of every node."""
    p = 1 / (1 + np.exp(-margin))
    g, h = weight * (p - y), weight * p * (1 - p)

    def node(rows, depth):
        total, best = (g[rows].sum(), h[rows].sum()), (boosting.LEAST_GAIN, None)
        score = lambda a, b: a * a / (b + s.l2)
        for missing_left in (False, True):
            for f, cuts in enumerate(bins if depth < s.depth else []):
                for c in cuts:
                    left = rows & np.where(np.isnan(x[:, f]), missing_left, x[:, f] < c)
                    right = rows & ~left
                    if min(h[left].sum(), h[right].sum()) < s.min_child_hessian:
                        continue
                    gain = (score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(*total)) / 2
                    if gain > best[0] + 1e-9:
                        best = gain, (left, right)
        if best[1] is None:
            return np.where(rows, -s.rate * total[0] / (total[1] + s.l2), 0.0)
        return node(best[1][0], depth + 1) + node(best[1][1], depth + 1)

    return node(np.ones(len(y), bool), 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_boosted_trees_equal_brute_force(spark, seed):
    """Margins after each round, with missing values, folds left out and a weight on positives."""
    rng = np.random.default_rng(seed)
    n = 120
    x = np.column_stack([rng.integers(0, 6, n), rng.integers(0, 2, n), rng.normal(size=n).round(1), np.ones(n)]).astype(float)
    x[rng.random(x.shape) < 0.1] = np.nan
    y = (np.nan_to_num(x[:, 0]) + 2 * np.nan_to_num(x[:, 2]) + rng.normal(size=n) > 2).astype(float)
    rows = [([None if np.isnan(v) else float(v) for v in r], float(label), k % 3) for k, (r, label) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x array<double>, label double, fold int").repartition(3)
    s = boosting.BoostSettings(rounds=4, depth=3, rate=0.3, positive_weight=1.7)
    left_out = [None, 0, 2]
    models = boosting.fit_boosted(df, "x", "label", 4, s, "fold", left_out)
    cuts = [np.unique(c[~np.isnan(c)])[1:] for c in x.T]
    for model, out in zip(models, left_out):
        weight = np.where(y == 1, s.positive_weight, 1.0) * (np.arange(n) % 3 != (-1 if out is None else out))
        margin = np.full(n, -(weight * (0.5 - y)).sum() / (weight.sum() / 4))
        assert model.base == pytest.approx(margin[0])
        for _ in range(s.rounds):
            moved = brute_tree(x, y, margin, weight, s, cuts)
            own = weight > 0
            margin = margin + moved
        assert np.allclose(model.margin(x)[own], margin[own])
        assert boosting.BoostedModel.from_dict(model.to_dict()).margin(x) == pytest.approx(model.margin(x), nan_ok=True)


def test_quantile_bins_and_lineage_cuts(spark, monkeypatch):
    """Many values fall into bins between quantiles; state cut in the shared folder changes nothing."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 2))
    y = (x[:, 0] > 0.3).astype(float)
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "x array<double>, label double").repartition(4)
    cuts = boosting.cut_points(df, "x", 2, 20)
    assert all(10 < len(c) < 20 for c in cuts)
    plain = boosting.fit_boosted(df, "x", "label", 2, boosting.BoostSettings(6), cuts=cuts)[0]
    monkeypatch.setattr(boosting, "CHECKPOINT", 2)
    cut = boosting.fit_boosted(df, "x", "label", 2, boosting.BoostSettings(6), cuts=cuts)[0]
    task = boosting.fit_boosted(df, "x", "label", 2, boosting.BoostSettings(6), cuts=cuts, in_task=True)[0]
    assert np.allclose(plain.margin(x), task.margin(x))
    assert np.allclose(plain.margin(x), cut.margin(x)) and ((plain.margin(x) > 0) == y.astype(bool)).mean() > 0.95
    assert plain.importances(2)[0] > 0.9


def test_boosting_of_no_rows_and_one_class(spark):
    df = spark.createDataFrame([([1.0], 1.0), ([2.0], 1.0)], "x array<double>, label double")
    assert boosting.fit_boosted(df.where("false"), "x", "label", 1)[0].margin(np.zeros((2, 1))).tolist() == [0, 0]
    model = boosting.fit_boosted(df, "x", "label", 1, boosting.BoostSettings(3))[0]
    assert (model.margin(np.array([[1.0], [2.0]])) > 1).all()


def test_grouped_scores_equal_single_ones(spark, data):
    rng = np.random.default_rng(2)
    rows = [(None if k % 3 == 0 else f"g{k % 3}", int(rng.random() < 0.4), round(float(rng.random()), 1)) for k in range(300)]
    rows += [("one", 1, 0.3), ("one", 1, 0.9)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    for r in E.scores_by(df, ["g"]).collect():
        own = T.scores(df.where(F.col("g").eqNullSafe(F.lit(r.g))))
        assert (r.recall, r.precision, r.f1) == (own["recall"], own["precision"], own["f1"])
        assert r.roc_auc == (None if r.g == "one" else pytest.approx(own["roc_auc"]))


def test_the_importance_forest_has_no_class_weights(spark, data, monkeypatch):
    seen = []
    make = T.make_estimator
    monkeypatch.setattr(T, "make_estimator", lambda name, train, prm=None: (seen.append(train), make(name, train, {"n_trees": 3}))[1])
    T.fit("random_forest", data.where("split = 'train'"), {"n_trees": 3}, weighted=False)
    assert [r.weight for r in seen[-1].select("weight").distinct().collect()] == [1.0]

    class Params:
        def feature_names(self):
            return [(k, f"f{k}", "f") for k in range(3)]

    T.feature_importance(spark, data, Params()).collect()
    assert [r.weight for r in seen[-1].select("weight").distinct().collect()] == [1.0]


def test_tuning_has_four_stages(spark, data, monkeypatch):
    monkeypatch.setattr(M, "grid_params", lambda: [{"C": 0.1, "l1_ratio": 0.0}, {"C": 1.0, "l1_ratio": 1.0}])
    monkeypatch.setattr(M, "random_params", lambda: [{"C": 0.01, "l1_ratio": 0.5}])
    rows = {r.stage: r for r in T.tuning_comparison(spark, data).collect()}
    assert set(rows) == {"untuned", "grid_search", "random_search", "tuned_threshold"}
    assert (rows["random_search"].C, rows["random_search"].l1_ratio) == (0.01, 0.5)
    assert rows["tuned_threshold"].C in (0.1, 1.0, 0.01)
    for found in T.search_results(spark, data, "grid"):
        aucs = [T.scores(T.predictions(T.batch_fit(data, [batched.Problem(found["C"], found["l1_ratio"], f)])[0],
                                       data.where(f"split = 'train' and fold = {f}")))["roc_auc"] for f in range(2)]
        all_folds = T.fold_predictions(data, "logistic_regression", {k: found[k] for k in ("C", "l1_ratio")})
        by_fold = {r.fold: r.roc_auc for r in E.scores_by(all_folds, ["fold"]).collect()}
        assert aucs == pytest.approx([by_fold[0], by_fold[1]])
        assert found["mean_roc_auc"] == pytest.approx(np.mean(list(by_fold.values())))
        assert found["std_roc_auc"] == pytest.approx(np.std(list(by_fold.values())))


def test_digests_tell_multisets_apart(spark):
    rows = [(k % 7, f"r{k % 5}") for k in range(60)]
    make = lambda r, n: spark.createDataFrame(r, "a int, b string").repartition(n)
    digest = lambda df: tuple(E.multiset_digest(df, F.concat_ws("|", F.col("a").cast("string"), "b")).first())
    base = digest(make(rows, 1))
    assert base == digest(make(rows[::-1], 7)) and base[0] == 60
    others = [rows[1:], rows + rows[:1], [(9, "r0"), *rows[1:]], [rows[1], *rows[1:]]]
    assert len({base, *[digest(make(r, 3)) for r in others]}) == 5
    assert digest(make(rows, 1).where("false"))[0] == 0


def test_thresholds_can_be_subqueries(spark):
    scored = spark.createDataFrame([(k % 2, k / 20) for k in range(21)], "y int, p double")
    picked = spark.createDataFrame([(0.35,)], "t double").select("t").scalar()
    want = {r.threshold: tuple(r)[2:] for r in E.counts_at_thresholds(scored, [0.35, 0.5, 0.1]).collect()}
    for given in ([picked, 0.5, 0.1], [0.1, 0.35, 0.5, picked]):
        assert {r.threshold: tuple(r)[2:] for r in E.counts_at_thresholds(scored, given).collect()} == want


def test_the_report_is_one_plan(spark):
    from attrix.plans import common, evaluation

    scored = common.scored_splits(spark, "/root/testdata/sf0.001")
    head, parts = evaluation.report_parts(scored)
    assert "subquery" in parts["subgroup_fairness"]._jdf.queryExecution().optimizedPlan().toString().lower()
    row = head.first()
    assert row.recommended_threshold in {r.threshold for r in parts["threshold_comparison"].collect()}


@pytest.fixture
def collected(monkeypatch):
    """Bytes of each result that ``RDD.collect`` brings to the driver."""
    import pickle

    from pyspark import RDD

    sizes, collect = [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda rdd: (got := collect(rdd), sizes.append(len(pickle.dumps(got))))[0])
    return sizes


def many_parts(spark, parts, rows=400, width=12):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(rows, width))
    y = (x[:, 0] + rng.normal(size=rows) > 0).astype(float)
    return spark.createDataFrame([(r.tolist(), float(v), k % C.N_FOLDS) for k, (r, v) in enumerate(zip(x, y))],
                                 "x array<double>, label double, fold int").repartition(parts)


def test_boosting_sends_splits_not_histograms_to_the_driver(spark, collected):
    df = many_parts(spark, 6)
    cuts = boosting.cut_points(df, "x", 12)
    collected.clear()
    boosting.fit_boosted(df, "x", "label", 12, boosting.BoostSettings(2), cuts=cuts, in_task=False)
    histogram = 2 * 8 * boosting._Bins(cuts).slots * 8  # of one partition at the last level
    assert collected and max(collected) < histogram / 8


def test_reduced_sums_are_whole_and_in_order(spark, monkeypatch):
    from attrix.operators import blocks

    monkeypatch.setattr(blocks, "FLAT", 2)
    parts = spark.sparkContext.parallelize([np.full((5, 2), 10.0 ** k) for k in range(9)], 9)
    got = blocks.reduced(parts, lambda b: b, lambda k, part: (k, part), 3)
    assert [k for k, _ in got] == [0, 1, 2] and np.array_equal(np.concatenate([v for _, v in got]), np.full((5, 2), 111111111.0))
    assert blocks.reduced(spark.sparkContext.parallelize([], 3), lambda b: b, lambda k, part: part, 2) == []


def test_a_search_sends_points_not_hessians_to_the_driver(spark, collected):
    df = many_parts(spark, 6)
    packed = T.packed_rows(df, "x", ["label", "fold"], 12)
    collected.clear()
    fitted = batched.fit_batch(packed, [batched.Problem(c, r, f) for c in (0.1, 1.0) for r in (0.0, 1.0) for f in range(C.N_FOLDS)],
                               12, C.N_FOLDS)
    packed.unpersist()
    assert all(f.sweeps < 100 for f in fitted) and max(collected[1:]) < 2 * len(fitted) * 13 * 13 * 8 / 2


def test_forests_grow_the_same_from_wide_nodes(spark, data, monkeypatch):
    """Sweeps over wide nodes and tasks below them leave out no row or tree; the forest is not on the driver."""
    from attrix.operators import forest

    train, val = data.where("split = 'train'"), data.where("split = 'val'")
    one = T.fit("random_forest", train, {"n_trees": 40})
    monkeypatch.setattr(forest, "GROUP_ROWS", 60)
    monkeypatch.setattr(forest, "TOGETHER", 15)
    many = T.fit("random_forest", train, {"n_trees": 40})
    for m in (one, many):
        nodes = spark.read.parquet(m.path)
        assert nodes.select("tree").distinct().count() == 40
        p = T.predictions(m, val)
        assert p.count() == val.count() and p.where("p < 0 or p > 1").count() == 0
        assert T.scores(p)["roc_auc"] > 0.7
    assert max(len(t.feature) for t in one.tops) == 1 and max(len(t.feature) for t in many.tops) > 3
    assert np.allclose(one.featureImportances.toArray(), many.featureImportances.toArray(), atol=0.1)


def test_a_tree_separates_what_its_features_separate():
    from attrix.operators import forest

    rng = np.random.default_rng(4)
    for n in (40, 5000):  # runs of keys, and a cell for every bin
        b = rng.integers(0, 30, (n, 3)).astype(np.uint8)
        y = (b[:, 0].astype(int) + b[:, 1] > 30).astype(int)
        tree = forest.grow(b, y, np.ones(n, np.int64), np.array([1.0, 2.0]), 3, 30, rng)
        leaf = forest._leaf_of(tree.feature, tree.cut, tree.child, b)
        same = {}
        for row, label in zip(map(tuple, b), y):
            same.setdefault(row, set()).add(label)
        assert all(len(v) == 1 for v in same.values()) and np.array_equal(tree.w[leaf, 1] > tree.w[leaf, 0], y == 1)


def test_cuts_are_found_without_joining_rows(spark, monkeypatch):
    """A join of the values is planned by their compressed size, which sends all rows of repeated values to the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    df = spark.createDataFrame([([float(k % 3), float(k), None if k % 2 else 1.0],) for k in range(300)], "x array<double>")

    def join(*_, **__):
        raise AssertionError("rows are joined")

    monkeypatch.setattr(DataFrame, "join", join)
    few, many, one = boosting.cut_points(df, "x", 3, 32)
    assert few.tolist() == [1.0, 2.0] and one.tolist() == []
    assert len(many) == 31 and np.abs(many - np.arange(1, 32) * 300 / 32).max() <= 1


def test_models_of_few_rows_grow_in_a_task_each(spark, data):
    """Folds on one partition don't wait for each other, and are the models that grow together."""
    rows = data.where("split = 'train'").select(vector_to_array("features").alias("x"), "label", "fold").checkpoint()
    s, left_out = boosting.BoostSettings(rounds=5, depth=3), [*range(C.N_FOLDS), None]
    sc, group = spark.sparkContext, "in-task-models"
    sc.setJobGroup(group, "boosting")
    try:
        alone = boosting.fit_boosted(rows, "x", "label", 3, s, "fold", left_out, rows.count())
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = sc.statusTracker().getJobIdsForGroup(group)
    stages = [sc.statusTracker().getStageInfo(k) for j in jobs for k in sc.statusTracker().getJobInfo(j).stageIds]
    assert len(left_out) in {k.numTasks for k in stages if k is not None}
    together = boosting.fit_boosted(rows, "x", "label", 3, s, "fold", left_out, in_task=False)
    for a, b in zip(alone, together, strict=True):
        assert len(a.trees) == len(b.trees) and all(
            np.array_equal(u.feature, v.feature) and np.allclose(u.cut, v.cut) and np.allclose(u.weight, v.weight)
            for u, v in zip(a.trees, b.trees, strict=True))


def test_steps_reach_the_lowest_point_along_flat_directions():
    """Columns that add up to others, as all categories and sums of flags do, leave only a weak L1 penalty to move along."""
    rng = np.random.default_rng(6)
    kinds = rng.integers(0, 3, (400, 4))
    flags = np.concatenate([kinds == k for k in range(3)], axis=1).astype(float)
    x = np.column_stack([flags, flags, flags[:, :5].sum(axis=1), rng.normal(size=400), np.ones(400)])
    y = x @ rng.normal(size=x.shape[1])
    hessian = np.stack([x.T @ x] * 2)
    l1 = np.array([0.05, 20.0])
    beta = rng.normal(size=(2, x.shape[1]))
    gradient = np.stack([x.T @ (x @ b - y) for b in beta])
    for b, lam in zip(batched.proximal_step(beta, gradient, hessian, l1, np.zeros(2)), l1):
        slope, of = x.T @ (x @ b - y), b[:-1]
        assert abs(slope[-1]) < 1e-6 and np.all(np.abs(slope[:-1][of == 0]) <= lam + 1e-6) and (of == 0).any()
        assert np.allclose(slope[:-1][of != 0], -lam * np.sign(of[of != 0]), atol=1e-6)


def test_models_of_several_partitions_grow_in_a_task_each(spark, monkeypatch):
    """Rows beyond one partition don't take jobs for each tree; missing values and features of two bins count as in sweeps."""
    from attrix.operators import blocks

    monkeypatch.setattr(blocks, "PARTITION_ROWS", 200)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(9)
    n = 1000
    x = np.column_stack([rng.normal(size=(n, 2)), rng.integers(0, 2, (n, 11)), np.ones(n), rng.integers(0, 5, n)]).astype(float)
    x[:, 1][rng.random(n) < 0.2] = x[:, 4][rng.random(n) < 0.2] = np.nan
    y = (x[:, 0] + x[:, 3] + np.nan_to_num(x[:, 1]) + 2 * np.nan_to_num(x[:, 4]) + rng.normal(size=n) > 2).astype(float)
    rows = [([None if np.isnan(v) else float(v) for v in r], float(label), k % 3) for k, (r, label) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x array<double>, label double, fold int").repartition(6).checkpoint()
    s, left_out = boosting.BoostSettings(rounds=12, positive_weight=1.5), [0, 1, 2, None]
    sc, group = spark.sparkContext, "several-partitions"
    cuts = boosting.cut_points(df, "x", x.shape[1])
    sc.setJobGroup(group, "boosting")
    try:
        alone = boosting.fit_boosted(df, "x", "label", x.shape[1], s, "fold", left_out, n, cuts)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup(group)) < s.rounds
    together = boosting.fit_boosted(df, "x", "label", x.shape[1], s, "fold", left_out, n, cuts, in_task=False)
    for a, b in zip(alone, together, strict=True):
        assert a.base == pytest.approx(b.base) and len(a.trees) == len(b.trees) == s.rounds
        assert any(t.missing_left.any() for t in a.trees)
        assert all(np.array_equal(u.feature, v.feature) and np.allclose(u.cut, v.cut) and np.array_equal(u.missing_left, v.missing_left)
                   and np.allclose(u.weight, v.weight, atol=1e-8) for u, v in zip(a.trees, b.trees))


def test_rows_are_binned_once_for_all_trees(spark, data, monkeypatch):
    from attrix.operators import forest

    calls, numbered = [], forest._numbered
    monkeypatch.setattr(forest, "_numbered", lambda *a: (calls.append(1), numbered(*a))[1])
    train = data.where("split = 'train'")
    one = T.fit("random_forest", train, {"n_trees": 7})
    monkeypatch.setattr(forest, "TOGETHER", 2)
    monkeypatch.setattr(forest, "SCORED", 1)
    many = T.fit("random_forest", train, {"n_trees": 7})
    assert len(calls) == 2
    assert np.array_equal(one.featureImportances.toArray(), many.featureImportances.toArray())
    p = [sorted((r.CustomerID, r.p) for r in T.predictions(m, data.where("split = 'val'")).collect()) for m in (one, many)]
    assert p[0] == p[1]


@pytest.mark.parametrize("values", [2, 30])
def test_cells_are_those_of_all_rows(monkeypatch, values):
    """Dense cells, runs of few rows and strips of nodes count every row once."""
    from attrix.operators import forest

    rng = np.random.default_rng(values)
    sizes = rng.integers(1, 4, 60) if values > 2 else rng.integers(1, 90, 60)
    b = rng.integers(0, values, (sizes.sum(), 5)).astype(np.uint8)
    sums, pick = rng.integers(1, 5, len(b)).astype(float), np.stack([rng.permutation(5)[:3] for _ in sizes])
    want = {}
    for row, node, v in zip(b, np.repeat(np.arange(60), sizes), sums):
        for place, f in enumerate(pick[node]):
            want[node * 3 + place, row[f]] = want.get((node * 3 + place, row[f]), 0) + v
    for strip in (7, 1 << 14):
        monkeypatch.setattr(forest, "STRIP", strip)
        group, bin_, cells = forest._cells(b, sums, sizes, pick, np.full(5, values))
        keys = list(zip(group.tolist(), bin_.tolist()))
        assert keys == sorted(keys) and dict(zip(keys, cells)) == want
