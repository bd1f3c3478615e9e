"""Flawed inputs: joins that multiply and lose rows, duplicates, text that is no number; single records; value counts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrix import schemas as S
from attrix.functions import columns as X
from attrix.operators import profile as A
from attrix.operators.scoring import local_records, score_records, score_rows
from attrix.operators.value_table import value_table
from attrix.sources.customer import join_loss_audit, load_joined, multiplicity_audit


def test_numbers(spark):
    given = {"NaN": None, "nan": None, "12d": None, "7f": None, "3L": None, "inf": None, "-Infinity": None, "": None, "  ": None, "1,000": None,
             "0x1A": None, "abc": None, "1e": None, ".": None, "+": None, "1 2": None, None: None,
             " 1.5e2 ": 150.0, ".5": 0.5, "-3.": -3.0, "+7": 7.0, "0": 0.0, "1E-3": 0.001, "29.85": 29.85}
    rows = spark.createDataFrame([(k,) for k in given], "v string").select("v", X.to_number("v").alias("n")).collect()
    assert {r.v: r.n for r in rows} == given


def sources(spark, seed):
    rnd = random.Random(seed)
    def table(cols, n):  # noqa: E306
        return spark.createDataFrame([(rnd.choice([None, *"abcdefgh"]), *[rnd.randrange(3) for _ in cols]) for _ in range(n)],
                                     "CustomerID string, " + ", ".join(f"{c} int" for c in cols))
    return {"contracts": table(["x"], 20), "demographics": table(["y"], 12), "usage": table(["z"], 15)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_the_audit_tells_what_the_join_does(spark, seed):
    t = sources(spark, seed)
    got = {r.source: r for r in multiplicity_audit(t).collect()}
    joined = load_joined(t)
    keys = {n: [r.CustomerID for r in df.collect()] for n, df in t.items()}
    whole = set.intersection(*[set(k) - {None} for k in keys.values()])
    assert got[None]["rows"] == joined.count() and got[None].matched_keys == len(whole)
    for n, k in keys.items():
        r, kept = got[n], [x for x in k if x in whole]
        assert (r["rows"], r.null_key_rows, r.lost_rows) == (len(k), k.count(None), len(k) - len(kept))
        assert r.repeated_keys == len({x for x in k if x is not None and k.count(x) > 1})
        assert r.lost_keys == len(set(k) - {None} - whole) and r.fan_out_rows == joined.count() - len(kept)
    assert {r.source: r.lost_keys for r in join_loss_audit(t).collect()} == {n: got[n].lost_keys for n in t}


def test_the_audit_of_nothing_and_of_products_beyond_64_bits(spark):
    t = sources(spark, 1)
    empty = {n: df.where("false") for n, df in t.items()}
    assert {r["rows"] for r in multiplicity_audit(empty).collect()} == {0}
    from attrix.sources import customer

    many = spark.createDataFrame([("k", 3 * 10**9, 3 * 10**9, 3 * 10**9)], "k string, contracts long, demographics long, usage long")
    kept = customer._multiplicities
    customer._multiplicities = lambda *_: many
    try:
        assert [r["rows"] for r in multiplicity_audit(t).collect() if r.source is None] == [27 * 10**27]
    finally:
        customer._multiplicities = kept


def test_duplicates(spark):
    rows = [("a", 1), ("a", 1), ("a", 2), ("b", None), ("b", None), (None, 1), (None, 1), ("", 1)]
    r = A.duplicate_report(spark.createDataFrame(rows, "CustomerID string, x int")).first()
    assert (r.duplicate_keys, r.duplicate_rows) == (4, 3)
    none = A.duplicate_report(spark.createDataFrame([], "CustomerID string, x int")).first()
    assert (none.duplicate_keys, none.duplicate_rows) == (0, 0)


def test_value_counts_give_what_separate_passes_give(spark):
    rng = np.random.default_rng(1)
    rows = [(None if rng.random() < 0.1 else float(rng.integers(0, 40)), rng.choice(["u", "v", None]), None if rng.random() < 0.05 else int(rng.random() < 0.4))
            for _ in range(500)]
    rows = [(x, None if t is None else str(t), y) for x, t, y in rows] + [(1e9, "u", 1), (float("nan"), "w", 0)]
    df = spark.createDataFrame(rows, "x double, t string, y int").repartition(4)
    table = value_table(df, ["x", "t", "y"], "y", rows=True)
    x = np.array([r[0] for r in rows if r[0] is not None and r[0] == r[0]])
    d = {r.column: r for r in table.describe(["x"], 6).collect()}["x"]
    assert (d["count"], d.min, d.max) == (len(x), x.min(), x.max())
    assert (d["mean"], d["std"]) == (pytest.approx(x.mean(), rel=1e-9), pytest.approx(x.std(ddof=1), rel=1e-9))
    assert (d.p25, d.p50, d.p75) == tuple(pytest.approx(q) for q in np.quantile(x, [0.25, 0.5, 0.75]))
    assert {r.column: r.null_count for r in table.nulls().collect()} == {
        c: sum(r[k] is None for r in rows) for k, c in enumerate("xty") if any(r[k] is None for r in rows)}
    q1, q3 = np.quantile(x, [0.25, 0.75])
    assert table.outliers(["x"]).first().outliers == ((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))).sum()
    pairs = np.array([(a, b) for a, _, b in rows if a is not None and a == a and b is not None])
    assert table.class_correlation(["x"]).first().r == pytest.approx(np.corrcoef(pairs.T)[0, 1])
    for r in table.rates(["t"]).collect():
        own = [y for _, t, y in rows if t == r.value and y is not None]
        assert r.rate == pytest.approx(sum(own) / len(own))
    assert table.size().first().n_rows == len(rows)
    hist = table.class_histogram("x", 10).collect()
    assert sum(r["count"] for r in hist) == len(x)
    box = {r["class"]: r for r in table.box_stats(["x"]).collect()}
    ones = np.array([a for a, _, b in rows if b == 1 and a is not None and a == a])
    q1, m, q3 = np.quantile(ones, [0.25, 0.5, 0.75])
    inside = ones[(ones >= q1 - 1.5 * (q3 - q1)) & (ones <= q3 + 1.5 * (q3 - q1))]
    assert (box[1].q1, box[1].median, box[1].whisker_high, box[1].fliers) == (q1, m, inside.max(), len(ones) - len(inside))


def test_the_report_scans_the_joined_table_once(spark, monkeypatch):
    from attrix.operators import value_table as V
    from attrix.plans import common, eda

    scans = []
    make = V.value_table
    monkeypatch.setattr(eda, "value_table", lambda df, *a, **k: (scans.append(df), make(df, *a, **k))[1])
    report = eda.eda_report(common.joined(spark, "/root/testdata/sf0.001"))
    files = report.inputFiles()
    assert len(scans) == 1 and files and all("value-counts" in f for f in files)


def test_single_records_are_scored_without_a_job(spark):
    from attrix.plans import common

    sf = "/root/testdata/sf0.001"
    _, bundle = common.fitted(spark, sf)
    recs = common.serving_records(spark, sf).orderBy("CustomerID")
    rows = [tuple(r) for r in recs.limit(20).collect()]
    want = score_records(spark.createDataFrame(rows, S.SERVING), bundle).collect()
    assert score_rows(spark, rows, bundle) == want
    assert score_rows(spark, [dict(zip(S.SERVING.names, rows[0]))], bundle) == want[:1]
    plan = score_records(local_records(spark, rows), bundle)._jdf.queryExecution().executedPlan().toString()
    assert plan.startswith("LocalTableScan")
    odd = score_rows(spark, [{"CustomerID": None, "Tenure": 5, "MonthlyCharges": 50.0, "PhoneService": 1}], bundle)
    assert odd[0].customer_id == "UNKNOWN" and score_rows(spark, [], bundle) == []
    group = "no-job"
    spark.sparkContext.setJobGroup(group, group)
    score_rows(spark, rows, bundle)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
