"""Golden cases of the row-wise operators (cleaning, features, tiers, validation)."""

from pyspark.sql import functions as F

from attrix.functions import columns as X


def test_clean_maps_binaries_label_and_charges(spark):
    df = spark.createDataFrame(
        [("A", "Yes", "Yes", "No", "Yes", "No", "Female", "29.85"),
         ("B", "No", "No", "Yes", "No", "Yes", "Male", "100.50")],
        "CustomerID string, Churn string, PaperlessBilling string, Dependents string, Partner string, "
        "PhoneService string, Gender string, TotalCharges string")
    out = X.clean(df).orderBy("CustomerID").collect()
    assert [r.Churn for r in out] == [1, 0]
    assert [r.PaperlessBilling for r in out] == [1, 0]
    assert [r.Dependents for r in out] == [0, 1]
    assert [r.Partner for r in out] == [1, 0]
    assert [r.Gender for r in out] == [0, 1]
    assert [r.TotalCharges for r in out] == [29.85, 100.5]


def test_blank_and_null_coercion(spark):
    df = spark.createDataFrame([(" ",), ("abc",), (None,), (" 12.5 ",)], "t string")
    assert [r[0] for r in df.select(X.to_number("t")).collect()] == [None, None, None, 12.5]
    df2 = spark.createDataFrame([("Yes",), (None,), ("No",)], "c string")
    assert [r[0] for r in df2.select(X.label_flag("c")).collect()] == [1, 0, 0]


def _features_row(spark, tenure, monthly, total, extra=None):
    base = {"Tenure": tenure, "MonthlyCharges": monthly, "TotalCharges": total, "PhoneService": 1,
            "InternetService": "Fiber optic", "MultipleLines": "Yes", "OnlineSecurity": "No", "OnlineBackup": "Yes",
            "DeviceProtection": "No", "TechSupport": "No", "StreamingTV": "Yes", "StreamingMovies": "No"}
    base.update(extra or {})
    schema = ("Tenure int, MonthlyCharges double, TotalCharges double, PhoneService int, InternetService string, "
              "MultipleLines string, OnlineSecurity string, OnlineBackup string, DeviceProtection string, "
              "TechSupport string, StreamingTV string, StreamingMovies string")
    cols = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(base[c] for c in cols)], schema)


def test_engineer_features_golden(spark):
    out = X.engineer_features(_features_row(spark, 10, 70.0, 700.0), 1000.0).first()
    assert out.TotalServices == 5
    assert out.AvgMonthlySpend == 70.0
    assert out.ChargeDiff == 0.0
    assert out.TenureBucket == "0-12"
    assert "PhoneService" not in out.asDict() and "HasInternetService" not in out.asDict()


def test_zero_tenure_fill(spark):
    out = X.engineer_features(_features_row(spark, 0, 50.0, None), 100.0).first()
    assert out.TotalCharges == 100.0
    assert out.AvgMonthlySpend == 100.0
    assert out.ChargeDiff == -50.0


def test_bucket_edges_are_right_closed(spark):
    df = spark.createDataFrame([(t,) for t in (0, 12, 13, 24, 48, 72, 73, None)], "Tenure int")
    got = [r[0] for r in df.select(X.tenure_bucket("Tenure")).collect()]
    assert got == ["0-12", "0-12", "12-24", "12-24", "24-48", "48-72", "nan", "nan"]


def test_null_semantics_of_service_count(spark):
    out = X.engineer_features(_features_row(spark, 5, 10.0, 50.0, {"InternetService": None, "StreamingTV": None}), 1.0)
    # NULL add-on counts 0, NULL internet counts 1
    assert out.first().TotalServices == 2 + 1 + 1  # two "Yes" add-ons + phone + internet(NULL)
    out2 = X.engineer_features(_features_row(spark, 5, 10.0, 50.0, {"PhoneService": None}), 1.0)
    assert out2.first().TotalServices is None


def test_risk_tiers_at_049(spark):
    df = spark.createDataFrame([(0.15,), (0.35,), (0.55,), (0.85,)], "p double")
    got = [r[0] for r in df.select(X.risk_tier("p", 0.49)).collect()]
    assert got == ["Low", "Medium", "High", "Critical"]
    # threshold above 0.75 makes High unreachable
    assert [r[0] for r in df.select(X.risk_tier("p", 0.9)).collect()] == ["Low", "Medium", "Medium", "Critical"]


def test_strict_vs_lenient_map(spark):
    df = spark.createDataFrame([("Yes",), ("Maybe",), ("1",), (None,)], "c string")
    assert [r[0] for r in df.select(X.strict_map("c")).collect()] == [1, None, None, None]
    assert [r[0] for r in df.select(X.lenient_map("c")).collect()] == [1, None, 1, None]


def test_validation_rejects_bad_record(spark):
    from attrix import schemas as S

    good = ("C1", 10, "Month-to-month", "Mailed check", "Yes", "Male", 0, "No", "Yes", 70.0, 700.0, 1, "No", "DSL",
            "No", "Yes", "No", "No", "No", "No")
    bad = ("C2", 10, "Month-to-month", "Mailed check", "Yes", "Robot", 0, "No", "Yes", -100.0, None, 1, "No", "DSL",
           "No", "Yes", "No", "No", "No", "No")
    df = spark.createDataFrame([good, bad], S.SERVING)
    valid, rejected = X.validate(df)
    assert [r.CustomerID for r in valid.collect()] == ["C1"]
    v = rejected.first().violations
    assert "Gender:enum" in v and "MonthlyCharges:range" in v
    summary = {r.rule: r.n_rows for r in X.violation_summary(rejected).collect()}
    assert summary["Gender:enum"] == 1


def test_decision_uses_unrounded_probability(spark):
    df = spark.createDataFrame([(0.48996,)], "p double")
    r = df.select(X.decision("p", 0.49).alias("d"), X.round_prob("p").alias("r")).first()
    assert r.d == 0 and r.r == 0.49
