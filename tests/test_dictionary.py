"""Category dictionaries and sparse vectors against dense ones, and with a million categories."""

import random

import pytest
from pyspark.sql import functions as F

from attrix import config as C
from attrix.operators import prep
from attrix.operators.dictionary import encode, fit_dictionary, vectors


def table(spark, seed, n=300):
    rnd = random.Random(seed)
    vals = [None, "", "a", "B", "é", "b b", "zz", "=", "10", "9"]
    return spark.createDataFrame([(k, rnd.choice(vals), rnd.choice(vals[:4]), rnd.choice([None, 0.0, 1.5])) for k in range(n)],
                                 "id int, s string, t string, x double").repartition(5)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_sparse_vectors_equal_literal_expressions(spark, limit):
    """With joins of either kind; categories that only the scored rows have, and NULL, have no entry."""
    train, new = table(spark, 1).where("s <> 'zz'"), table(spark, 2)
    cfg = C.FeatureConfig(numeric_cols=["x"], categorical_cols=["s", "t"], binary_cols=[])
    p = prep.fit_prep(train, cfg)
    d = fit_dictionary(train, ["s", "t"])
    assert d.sizes == {c: len(v) for c, v in p.categories.items()}
    assert {(r.column, r.position): r.category for r in d.table.collect()} == {
        (c, k): v for c, vs in p.categories.items() for k, v in enumerate(vs)}
    assert [tuple(r) for r in d.names(1).orderBy("idx").collect()] == p.feature_names()[1:]
    exprs = prep.feature_exprs(p)
    dense = {r.id: r.f for r in new.select("id", F.array(*exprs).alias("f")).collect()}
    got = encode(new, d, exprs[:1], broadcast_categories=limit)
    assert got.columns == [*new.columns, "features"]
    for r in vectors(got).collect():
        want = dense[r.id]
        if want[0] is None:
            assert list(r.features.indices)[:1] == [0] and r.features.toArray()[1:].tolist() == want[1:]
        else:
            assert r.features.toArray().tolist() == want and 0.0 not in r.features.values.tolist()


def test_a_million_categories(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("c"))
    d = fit_dictionary(rows.unionAll(rows.where("c < 'c0000100'")), ["c"])
    assert d.sizes == {"c": n}
    wrong = d.table.where(F.col("position") != F.substring("category", 2, 7).cast("long"))
    assert wrong.isEmpty()
    got = encode(rows.where("c like '%77'").unionAll(spark.createDataFrame([("new",)], "c string")), d)
    assert "strategy=broadcast" not in got._jdf.queryExecution().optimizedPlan().toString()  # no hint, the planner decides
    first = F.col("features.indices")[0]
    bad = got.where((F.col("c") != "new") & ((first != F.substring("c", 2, 7).cast("int")) | (F.size("features.indices") != 1)))
    assert bad.isEmpty() and got.count() == n // 100 + 1
    assert got.where("c = 'new'").first().features.indices == []
    with pytest.raises(ValueError, match="dictionary"):
        prep.fit_prep(rows, C.FeatureConfig(numeric_cols=[], categorical_cols=["c"], binary_cols=[]))


def test_dictionary_of_nothing(spark):
    empty = table(spark, 1).where("false")
    d = fit_dictionary(empty, ["s", "t"])
    assert d.sizes == {"s": 0, "t": 0} and d.table.collect() == []
    assert all(r.features.indices == [] for r in encode(table(spark, 1), d).collect())
