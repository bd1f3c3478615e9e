"""Parallel exact ranks, cumulative label counts and quantiles (the scale kernels).

A window without ``partitionBy`` plans ``Exchange SinglePartition``: the
whole table in one task. The kernels below avoid that with a two-level
scheme, the same at every size: counts per (stratum, range) are prefix-summed
and joined back, and row-level windows only run inside one range. Joins back
are null-safe, so NULL strata and keys keep their rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir


def hash32(key: Column, salt: str) -> Column:
    """First 32 bits of md5(key || '-' || salt) as a non-negative bigint."""
    digest = F.md5(F.concat(key.cast("string"), F.lit("-" + salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` on null-safe equality of ``keys`` (kept once, from ``left``)."""
    named = right.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)],
                         *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_j{i}")) for i, k in enumerate(keys)])
    return left.join(named, on, how).drop(*[f"_j{i}" for i in range(len(keys))])


def dist_rank(df: DataFrame, order_col: str, tie_col: str, by: Sequence[str] = (), out: str = "rank",
              bucket_bits: int = 12) -> DataFrame:
    """Exact 1-based ``row_number`` over (order_col, tie_col) within ``by``, computed in parallel.

    ``order_col`` must be a non-negative 32-bit integer (e.g. ``hash32``) or
    NULL, so its leading ``bucket_bits`` bits order the buckets (NULL first).

    Rows are tagged with the partition they come from and stored
    (``checkpoint()``), so every branch below sees the same tags. They are
    counted per (key, tag), which collapses a duplicated key map-side; prefix
    sums over buckets, then over the keys of a bucket, give every (key, tag)
    group its offset; and the rows of a group, of one input partition at
    most, are numbered in a window of their own. Rows of equal (order_col,
    tie_col) are interchangeable, so any order among them is exact.
    """
    by = list(by)
    shared_dir(df.sparkSession)
    shift = 32 - bucket_bits
    bucket = F.coalesce(F.shiftright(F.col(order_col), shift).cast("int"), F.lit(-1))
    tagged = df.withColumns({"_bucket": bucket, "_tag": F.spark_partition_id()}).checkpoint()
    keys = [*by, "_bucket", order_col, tie_col, "_tag"]
    groups = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    counts = groups.groupBy(*by, "_bucket").agg(F.sum("_c").alias("_cnt"))
    # at most 2**bucket_bits + 1 rows per stratum
    w = Window.partitionBy(*by).orderBy("_bucket") if by else Window.orderBy("_bucket")
    offsets = counts.select(*by, "_bucket", (F.sum("_cnt").over(w) - F.col("_cnt")).alias("_offset"))
    gw = Window.partitionBy(*by, "_bucket").orderBy(F.col(order_col), F.col(tie_col), F.col("_tag")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    starts = groups.select(*keys, (F.sum("_c").over(gw) - F.col("_c")).alias("_start"))
    starts = join_null_safe(starts, offsets, [*by, "_bucket"]).withColumn("_start", F.col("_start") + F.col("_offset")).drop("_offset")
    numbered = join_null_safe(tagged, starts, keys)
    rw = Window.partitionBy(*keys).orderBy(F.col(order_col))
    return numbered.withColumn(out, F.row_number().over(rw) + F.col("_start")).drop("_bucket", "_tag", "_start")


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str = "_b") -> DataFrame:
    """``df`` range-partitioned by (by, order) and stored, with the number of each row's range in ``out``.

    Ranges ascend in the given order; all rows of one (by, order) value share one.
    """
    shared_dir(df.sparkSession)
    return df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn(out, F.spark_partition_id()).checkpoint()


def cum_counts(scored: DataFrame, score: str = "p", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score (descending), within ``by``: pos, neg and cumulative tp/fp including that score.

    Scores are grouped first (partial aggregation), so the table becomes one
    row per distinct score; these are range-partitioned by descending score
    once and stored. Prefix sums run inside each range on top of the sums of
    the ranges before it (one row a range).
    """
    by = list(by)
    grouped = scored.groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(~(F.col(label) == 1) | F.col(label).isNull()).alias("neg"),
    )
    tagged = ranged(grouped, by, [F.col("score").desc()])
    tot = tagged.groupBy(*by, "_b").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    wo = Window.partitionBy(*by).orderBy("_b") if by else Window.orderBy("_b")
    offs = tot.select(*by, "_b", (F.sum("_bp").over(wo) - F.col("_bp")).alias("_op"),
                      (F.sum("_bn").over(wo) - F.col("_bn")).alias("_on"))
    j = join_null_safe(tagged, offs, [*by, "_b"]) if by else tagged.join(offs, "_b")
    w = Window.partitionBy(*by, "_b").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return j.select(
        *by, "score", "pos", "neg",
        (F.sum("pos").over(w) + F.col("_op")).alias("tp"),
        (F.sum("neg").over(w) + F.col("_on")).alias("fp"),
    )


def dist_quantiles(values: DataFrame, probs: Sequence[float], by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Exact interpolated quantiles of ``value`` per ``by``: (by..., prob, quantile), NULL and NaN values left out.

    Values are counted (partial aggregation), the counts range-partitioned and
    prefix-summed as in ``cum_counts``; the two ranks that a quantile lies
    between are then read off. No group is collected into one task.
    """
    v = values.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    return quantiles_of_counts(v.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c")), probs, by, "_v", "_c")


def quantiles_of_counts(counts: DataFrame, probs: Sequence[float], by: Sequence[str], value: str, count: str) -> DataFrame:
    """``dist_quantiles`` of values that are counted already: one row per ``by`` and value."""
    by = list(by)
    counts = counts.select(*by, F.col(value).alias("_v"), F.col(count).alias("_c"))
    tagged = ranged(counts, by, [F.col("_v").asc()])
    # one row a range and group: sums of the ranges before, within the group
    parts = tagged.groupBy(*by, "_b").agg(F.sum("_c").alias("_n"))
    wo = Window.partitionBy(*by).orderBy("_b") if by else Window.orderBy("_b")
    before = parts.select(*by, "_b", (F.sum("_n").over(wo) - F.col("_n")).alias("_before"))
    w = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = join_null_safe(tagged, before, [*by, "_b"]).withColumn("_hi", F.sum("_c").over(w) + F.col("_before"))
    total = parts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    ranked = join_null_safe(ranked, total, by) if by else ranked.crossJoin(total)  # one row
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in probs])).alias("prob")
    spots = ranked.select(*by, "_v", "_c", "_hi", "_total", wanted)
    at = F.col("prob") * (F.col("_total") - 1)
    low, high = F.floor(at) + 1, F.ceil(at) + 1  # ranks from 1
    first = F.col("_hi") - F.col("_c")
    holds = lambda r: (first < r) & (r <= F.col("_hi"))
    picked = spots.where(holds(low) | holds(high)).groupBy(*by, "prob").agg(
        F.max(F.when(holds(low), F.col("_v"))).alias("_lo"), F.max(F.when(holds(high), F.col("_v"))).alias("_up"),
        F.max(at - F.floor(at)).alias("_f"))
    return picked.select(*by, "prob", (F.col("_lo") + (F.col("_up") - F.col("_lo")) * F.col("_f")).alias("quantile"))


def dist_mode(values: DataFrame, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Most frequent non-null ``value`` per ``by`` (the smallest of equally frequent ones): (by..., mode)."""
    by = list(by)
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    top = counts.groupBy(*by).agg(F.max("_c").alias("_c"))
    most = join_null_safe(counts, top, [*by, "_c"])
    return most.groupBy(*by).agg(F.min(value).alias("mode"))
