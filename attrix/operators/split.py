"""Stratified split (D1) and stratified k-fold assignment.

Rows are ordered inside each class by a salted md5 of the key (stable,
seeded, independent of partitioning) and cut at integer-rounded sizes, so
each class is split 70/15/15 exactly up to one row. Ranks come from
``dist_rank`` (no single-partition window).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .ranks import join_null_safe, dist_rank, hash32


def stratified_split(df: DataFrame, key: str = C.KEY_COL, stratum: str = C.TARGET_COL,
                     fractions=C.SPLIT_FRACTIONS, seed: int = C.RANDOM_STATE, out: str = "split",
                     k: int | None = None, fold_col: str = "fold") -> DataFrame:
    """70/15/15 per class by hash rank; with ``k`` also the stratified fold of each training row.

    Training rows are the first ranks of each class in hash order, so the
    round-robin ``(rank - 1) % k`` over that same order is a class-balanced
    shuffled k-fold without a second rank computation.
    """
    tr, va, _ = fractions
    a, b = int(round(tr * 100)), int(round((tr + va) * 100))
    hashed = df.withColumn("_h", hash32(F.col(key), f"split{seed}"))
    ranked = dist_rank(hashed, "_h", key, by=[stratum], out="_r")
    sizes = ranked.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    n, j = F.col("_n"), join_null_safe(ranked, sizes, [stratum])
    cut_train = F.floor((F.lit(a) * n + 50) / 100)
    cut_val = F.floor((F.lit(b) * n + 50) / 100)
    label = F.when(F.col("_r") <= cut_train, "train").when(F.col("_r") <= cut_val, "val").otherwise("test")
    j = j.withColumn(out, label)
    if k:
        j = j.withColumn(fold_col, F.when(F.col(out) == "train", ((F.col("_r") - 1) % k).cast("int")))
    return j.drop("_h", "_r", "_n")
