"""Scoring jobs (I1-I5) and the result filter.

A scoring job is one narrow plan: serving map -> feature engineering ->
feature expressions -> probability -> decision -> response columns. There
is no shuffle until a summary is asked for, and the summary is one
aggregation (partial aggregation map-side).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import config as C
from ..functions import columns as X
from ..schemas import SERVING
from .models import LinearScorer
from .prep import PrepParams


@dataclass
class ScoringBundle:
    """Everything a scoring job needs: fitted parameters, model, threshold, train median.

    The Column expressions of the scoring plan are built once per input
    layout and reused for every batch, so a request costs a few ``select``s
    (one analysis each) instead of rebuilding hundreds of expressions.
    """

    params: PrepParams
    scorer: LinearScorer | None = None
    ml_model: object | None = None
    threshold: float = C.DEPLOYED_THRESHOLD
    total_charges_median: float = C.TOTAL_CHARGES_MEDIAN_FALLBACK
    _cache: dict = field(default_factory=dict, repr=False)

    def engineered_columns(self, columns: tuple[str, ...]) -> list:
        """One projection: serving map (X4) + median fill (X5) + engineered columns."""
        key = ("fe", columns)
        if key not in self._cache:
            mapped = {c: X.lenient_map(c) for c in C.BINARY_MAP_COLS if c in columns}
            filled = X.fill_null("TotalCharges", float(self.total_charges_median))
            phone = mapped.get("PhoneService", F.col("PhoneService"))
            avg = X.avg_monthly_spend(total=filled)
            out = []
            for c in columns:
                if c in C.DROP_WEAK_COLS:
                    continue
                if c == "TotalCharges":
                    out.append(filled.alias(c))
                elif c in mapped:
                    out.append(mapped[c].alias(c))
                else:
                    out.append(F.col(c))
            out += [X.total_services(phone=phone).alias("TotalServices"), avg.alias("AvgMonthlySpend"),
                    X.charge_diff(avg=avg).alias("ChargeDiff"), X.tenure_bucket().alias("TenureBucket")]
            self._cache[key] = out
        return self._cache[key]

    def probability_column(self):
        if "p" not in self._cache:
            self._cache["p"] = self.scorer.probability(self.params).alias("churn_probability")
        return self._cache["p"]

    def probability(self, engineered: DataFrame) -> DataFrame:
        if self.scorer is not None:
            return engineered.select("*", self.probability_column())
        from pyspark.ml.functions import array_to_vector, vector_to_array

        from .prep import feature_exprs

        vec = engineered.withColumn("features", array_to_vector(F.array(*feature_exprs(self.params))))
        out = self.ml_model.transform(vec)
        return out.withColumn("churn_probability", vector_to_array(F.col("probability"))[1]).drop(
            "features", "rawPrediction", "probability", "prediction")


def predict_raw(df: DataFrame, bundle: ScoringBundle) -> DataFrame:
    """The raw input columns as they came, churn_probability and churn_prediction (on the unrounded value)."""
    fe = df.select(F.struct("*").alias("_raw"), *bundle.engineered_columns(tuple(df.columns)))  # X4 + X5-X10
    scored = bundle.probability(fe)
    return scored.select("_raw.*", "churn_probability",
                         X.decision("churn_probability", bundle.threshold).alias("churn_prediction"))


def to_response(scored: DataFrame, threshold: float, key: str = C.KEY_COL) -> DataFrame:
    """(customer_id, rounded probability, prediction, label, threshold, risk tier)."""
    return scored.select(*_response_columns(key in scored.columns, threshold, key))


def score_records(df: DataFrame, bundle: ScoringBundle, key: str = C.KEY_COL) -> DataFrame:
    """I2 over I1 (response expressions built once per bundle and input layout)."""
    scored = predict_raw(df, bundle)
    ck = ("resp", key, key in scored.columns)
    if ck not in bundle._cache:
        bundle._cache[ck] = _response_columns(key in scored.columns, bundle.threshold, key)
    return scored.select(*bundle._cache[ck])


_ARROW = {"string": pa.string(), "integer": pa.int32(), "double": pa.float64()}


def local_records(spark: SparkSession, rows: Sequence[Sequence | Mapping], schema: StructType = SERVING) -> DataFrame:
    """A handful of records (tuples in the schema's order, or mappings; absent fields are NULL) as a local relation.

    The optimiser evaluates a projection of a local relation itself, so that collecting it starts no job.
    """
    names = [f.name for f in schema.fields]
    tuples = [[r.get(n) for n in names] if isinstance(r, Mapping) else r for r in rows]
    arrays = [pa.array([r[k] for r in tuples], _ARROW[f.dataType.typeName()]) for k, f in enumerate(schema.fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names))


def score_rows(spark: SparkSession, rows: Sequence[Sequence | Mapping], bundle: ScoringBundle, schema: StructType = SERVING) -> list[Row]:
    """I4: response rows of one record or a request of a few, in their order, without a job.

    For records that are in the caller's memory already; tables are scored by ``score_records``.
    """
    return score_records(local_records(spark, rows, schema), bundle).collect()


def _response_columns(has_key: bool, threshold: float, key: str) -> list:
    kcol = F.col(key) if has_key else F.lit(None).cast("string")
    return [
        X.default_id(kcol).alias("customer_id"),
        X.round_prob("churn_probability").alias("churn_probability"),
        F.col("churn_prediction"),
        X.label_text("churn_prediction").alias("churn_label"),
        F.lit(float(threshold)).alias("decision_threshold"),
        X.risk_tier("churn_probability", threshold).alias("risk_tier"),
    ]


def batch_summary(responses: DataFrame) -> DataFrame:
    """Totals over the response rows; the mean is over the ROUNDED probabilities."""
    return responses.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.col("churn_prediction") == 1).alias("predicted_churn_count"),
        F.avg("churn_probability").alias("_mean"),
    ).select(
        "total_records", "predicted_churn_count",
        F.round(F.coalesce(F.try_divide(F.col("predicted_churn_count").cast("double"),
                                        F.col("total_records").cast("double")), F.lit(0.0)), 4).alias("churn_rate"),
        F.round(F.coalesce(F.col("_mean"), F.lit(0.0)), 4).alias("mean_churn_probability"),
    )


def tier_distribution(responses: DataFrame) -> DataFrame:
    """Rows and mean probability per risk tier."""
    return responses.groupBy("risk_tier").agg(
        F.count(F.lit(1)).alias("n"), F.avg("churn_probability").alias("mean_probability"))


def filter_results(responses: DataFrame, tier: str | None = "All", query: str | None = "") -> DataFrame:
    """Tier filter ('All' or empty disables it) AND case-insensitive id substring."""
    cond = F.lit(True)
    if tier and tier != "All":
        cond = cond & (F.col("risk_tier") == tier)
    if query:
        cond = cond & F.lower(F.col("customer_id")).contains(query.lower())
    return responses.where(cond)
