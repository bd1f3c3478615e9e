"""Shared building blocks of the registered queries: the prepared customer table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from .. import config as C
from ..functions.columns import clean, engineer_features
from ..operators.ranks import dist_quantiles
from ..operators.split import stratified_split
from ..session import scratch_path
from ..sources.customer import load_joined, source_tables


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every top-level floating column (float sums depend on summation order)."""
    scale = float(10 ** digits)
    # floor(x * s + 0.5) / s: plain IEEE operations, so any engine gives the same bits
    fl = {f.name: F.floor(F.col(f.name).cast("double") * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
          for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.withColumns(fl) if fl else df


def joined(spark: SparkSession, sf_dir: str, raw: DataFrame | None = None) -> DataFrame:
    """The three sources joined on the key."""
    return load_joined(source_tables(spark, sf_dir, raw))


def cleaned(spark: SparkSession, sf_dir: str, raw: DataFrame | None = None) -> DataFrame:
    """X22 over the joined table."""
    return clean(joined(spark, sf_dir, raw))


def exact_median(df: DataFrame, col: str) -> float | None:
    """exact interpolated median (a scalar to the driver)."""
    row = dist_quantiles(df, [0.5], value=col).first()
    return row["quantile"] if row else None


def split_table(spark: SparkSession, sf_dir: str, raw: DataFrame | None = None) -> DataFrame:
    """D1 + D2 over the cleaned table: adds ``split`` and ``fold`` (lazy plan)."""
    return stratified_split(cleaned(spark, sf_dir, raw), k=C.N_FOLDS)


def prepared_splits(spark: SparkSession, sf_dir: str, raw: DataFrame | None = None) -> DataFrame:
    """The split table written once (parquet partitioned by ``split`` in the shared folder) and read back.

    This is the single materialisation point of the preparation plan: the
    fits, medians and scoring jobs that follow read the written table (with
    partition pruning on ``split``) instead of re-running scan, joins and
    ranks, and a lost executor only recomputes from this table.
    """
    from ..sources.sinks import write_splits
    from ..sources.tables import read_splits

    path = write_splits(split_table(spark, sf_dir, raw), scratch_path(spark, "splits"))
    return read_splits(spark, path)


def engineered_splits(spark: SparkSession, sf_dir: str, raw: DataFrame | None = None) -> tuple[DataFrame, float]:
    """Split table with engineered features; TotalCharges filled with the train median."""
    s = prepared_splits(spark, sf_dir, raw)
    med = exact_median(s.where(F.col("split") == "train"), "TotalCharges")
    med = C.TOTAL_CHARGES_MEDIAN_FALLBACK if med is None else med
    return engineer_features(s, med), med


def serving_records(spark: SparkSession, sf_dir: str, raw: DataFrame | None = None) -> DataFrame:
    """Serving-shaped records of every customer: no label, PhoneService 0/1, numeric TotalCharges."""
    from ..functions.columns import strict_map, to_number
    from ..sources.customer import snapshot_table

    raw = snapshot_table(spark, sf_dir) if raw is None else raw
    cols = [c for c in raw.columns if c not in (C.TARGET_COL, "ChurnP", "ChurnObserved")]
    return raw.select(*cols).withColumns({
        "PhoneService": strict_map("PhoneService"),
        "TotalCharges": to_number("TotalCharges"),
    })


def fitted(spark: SparkSession, sf_dir: str, raw: DataFrame | None = None):
    """Split + engineered table and a scoring bundle fitted on its train rows (fixed model)."""
    from ..operators.models import FIXED_MODEL
    from ..operators.prep import fit_prep
    from ..operators.scoring import ScoringBundle

    fe, med = engineered_splits(spark, sf_dir, raw)
    params = fit_prep(fe.where(F.col("split") == "train"), C.FE_CONFIG)
    bundle = ScoringBundle(params=params, scorer=FIXED_MODEL, threshold=C.DEPLOYED_THRESHOLD,
                           total_charges_median=med)
    return fe, bundle


def scored_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, split, fold, y, p, fairness columns) for every customer under the fixed model."""
    fe, bundle = fitted(spark, sf_dir)
    return fe.select(
        C.KEY_COL, "split", "fold", F.col(C.TARGET_COL).alias("y"),
        bundle.scorer.probability(bundle.params).alias("p"), *C.FAIRNESS_COLS,
    )
