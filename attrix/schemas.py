"""Fixed schemas of the attrition sources, the serving record and the prediction row."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType


def _s(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


STR, INT, DBL = StringType(), IntegerType(), DoubleType()

CONTRACTS = _s(("CustomerID", STR), ("Tenure", INT), ("ContractType", STR), ("PaymentMethod", STR),
               ("PaperlessBilling", STR), ("Churn", STR))
DEMOGRAPHICS = _s(("CustomerID", STR), ("Gender", STR), ("SeniorCitizen", INT), ("Dependents", STR), ("Partner", STR))
USAGE = _s(("CustomerID", STR), ("MonthlyCharges", DBL), ("TotalCharges", STR), ("PhoneService", STR),
           ("MultipleLines", STR), ("InternetService", STR), ("OnlineSecurity", STR), ("OnlineBackup", STR),
           ("DeviceProtection", STR), ("TechSupport", STR), ("StreamingTV", STR), ("StreamingMovies", STR))

# Serving record: no label, PhoneService as 0/1, TotalCharges numeric (nullable).
SERVING = _s(("CustomerID", STR), ("Tenure", INT), ("ContractType", STR), ("PaymentMethod", STR),
             ("PaperlessBilling", STR), ("Gender", STR), ("SeniorCitizen", INT), ("Dependents", STR), ("Partner", STR),
             ("MonthlyCharges", DBL), ("TotalCharges", DBL), ("PhoneService", INT), ("MultipleLines", STR),
             ("InternetService", STR), ("OnlineSecurity", STR), ("OnlineBackup", STR), ("DeviceProtection", STR),
             ("TechSupport", STR), ("StreamingTV", STR), ("StreamingMovies", STR))
SERVING_ARRAY = ArrayType(SERVING)

PREDICTION = _s(("customer_id", STR), ("churn_probability", DBL), ("churn_prediction", INT), ("churn_label", STR),
                ("decision_threshold", DBL), ("risk_tier", STR))
