"""Fitted transforms (F1-F8): fit on the training rows, apply anywhere.

``fit_prep`` runs one aggregation over the training rows (partial
aggregation map-side; result is O(number of columns)) and reads a bounded number of
categories; it returns plain parameters. ``apply_prep`` is a narrow projection: the feature
vector is an ``array<double>`` of built-in expressions (codegen, no shuffle),
converted to an ML vector only where a Spark ML estimator needs one.

The ``ml.feature`` classes with the obvious names are not used for the
statistics: ``Imputer`` is approximate and ``StandardScaler`` uses the
sample deviation, while these transforms must be exact and use the
population deviation.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from .ranks import dist_mode, dist_quantiles


#: Each category becomes an expression of the transform and a name in the parameters; beyond this use ``dictionary``.
LITERAL_CATEGORIES = 10_000


@dataclass
class PrepParams:
    numeric_cols: list[str]
    categorical_cols: list[str]
    binary_cols: list[str]
    medians: dict[str, float | None] = field(default_factory=dict)      # F1 (numeric imputation)
    modes: dict[str, str | None] = field(default_factory=dict)          # F2 (categorical imputation)
    means: dict[str, float | None] = field(default_factory=dict)        # F3
    stds: dict[str, float | None] = field(default_factory=dict)         # F3 (population)
    categories: dict[str, list[str]] = field(default_factory=dict)      # F4 (sorted)
    impute: bool = False

    def feature_names(self) -> list[tuple[int, str, str]]:
        """(index, name, source column) in output order."""
        names = [(c, c) for c in self.numeric_cols]
        for c in self.categorical_cols:
            names += [(f"{c}_{v}", c) for v in self.categories[c]]
        names += [(c, c) for c in self.binary_cols]
        return [(i, n, s) for i, (n, s) in enumerate(names)]

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "PrepParams":
        return PrepParams(**json.loads(text))


def fit_prep(train: DataFrame, cfg: C.FeatureConfig = C.FE_CONFIG, impute: bool = False) -> PrepParams:
    """Fit medians, modes, mean/population std and sorted categories on ``train``.

    With ``impute`` (stage-4 layout) numeric columns are median-filled and
    categorical columns mode-filled before the scaler statistics and the
    category lists are taken, as a fitted imputer followed by the scaler would.
    """
    num, cat, bins = list(cfg.numeric_cols), list(cfg.categorical_cols), list(cfg.binary_cols)
    medians: dict = {}
    modes: dict = {}
    if impute:
        medians = dict.fromkeys(num)
        if num:
            long = train.select(F.explode(F.array(*[
                F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in num])).alias("x"))
            medians |= {r["column"]: r["quantile"] for r in dist_quantiles(long.select("x.*"), [0.5], ["column"]).collect()}
        modes = dict.fromkeys(cat)
        if cat:
            long = train.select(F.explode(F.array(*[
                F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cat])).alias("x"))
            modes |= {r["column"]: r["mode"] for r in dist_mode(long.select("x.*"), ["column"]).collect()}
        src = train.withColumns({
            **{c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in num if medians[c] is not None},
            **{c: F.coalesce(F.col(c), F.lit(modes[c])) for c in cat if modes[c] is not None},
        })
    else:
        src = train
    row = src.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"mu__{c}") for c in num],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"sd__{c}") for c in num],
        F.count(F.lit(1)).alias("n"),
    ).first()
    return PrepParams(
        numeric_cols=num, categorical_cols=cat, binary_cols=bins,
        medians=medians, modes=modes,
        means={c: row[f"mu__{c}"] for c in num},
        stds={c: row[f"sd__{c}"] for c in num},
        categories=_categories(src, cat),
        impute=impute,
    )


def _categories(src: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """Sorted categories of each column, of which there may be ``LITERAL_CATEGORIES`` in all."""
    out: dict[str, list[str]] = {c: [] for c in cols}
    if cols:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
        found = src.select(F.explode(cells).alias("x")).select("x.*").where(F.col("value").isNotNull()).distinct()
        rows = found.limit(LITERAL_CATEGORIES + 1).collect()
        if len(rows) > LITERAL_CATEGORIES:
            raise ValueError(f"over {LITERAL_CATEGORIES} categories: encode them with operators.dictionary")
        for r in rows:
            out[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in out.items()}


def feature_exprs(p: PrepParams) -> list[Column]:
    """The output columns of the column transformer, in order, as double expressions."""
    out: list[Column] = []
    for c in p.numeric_cols:
        x = F.col(c).cast("double")
        if p.impute and p.medians.get(c) is not None:
            x = F.coalesce(x, F.lit(float(p.medians[c])))
        mu = p.means.get(c)
        sd = p.stds.get(c)
        mu = 0.0 if mu is None else float(mu)
        sd = 1.0 if not sd else float(sd)  # zero variance -> divide by 1
        out.append((x - F.lit(mu)) / F.lit(sd))
    for c in p.categorical_cols:
        x = F.col(c).cast("string")
        if p.impute and p.modes.get(c) is not None:
            x = F.coalesce(x, F.lit(p.modes[c]))
        for v in p.categories[c]:
            out.append(x.eqNullSafe(v).cast("double"))  # unseen / NULL -> all zeros
    for c in p.binary_cols:
        out.append(F.col(c).cast("double"))
    return out


def apply_prep(df: DataFrame, p: PrepParams, out: str = "features", keep: list[str] | None = None) -> DataFrame:
    """add the ``array<double>`` feature column (other columns kept unless ``keep`` is given)."""
    arr = F.array(*feature_exprs(p)).alias(out)
    if keep is None:
        return df.withColumn(out, arr)
    return df.select(*keep, arr)


def to_vector(df: DataFrame, col: str = "features", out: str | None = None) -> DataFrame:
    """Array twin -> ML vector (dense) for Spark ML estimators."""
    from pyspark.ml.functions import array_to_vector

    return df.withColumn(out or col, array_to_vector(F.col(col)))


def feature_names_table(spark: SparkSession, p: PrepParams) -> DataFrame:
    return spark.createDataFrame(p.feature_names(), "idx int, name string, source_column string")


def train_median(train: DataFrame, col: str = "TotalCharges",
                 fallback: float = C.TOTAL_CHARGES_MEDIAN_FALLBACK) -> float:
    """F8: exact train median, with the fixed fallback when there is no value."""
    row = dist_quantiles(train, [0.5], value=col).first()
    return fallback if row is None else float(row["quantile"])
