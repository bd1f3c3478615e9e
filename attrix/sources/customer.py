"""Attrition source tables: vertical split (S4), load-and-join (S9/J1), join audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from .snapshot import snapshot_wide

SOURCE_LAYOUT = {
    "contracts": C.CONTRACT_COLS,
    "demographics": C.DEMOGRAPHIC_COLS,
    "usage": C.USAGE_COLS,
}


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename map; names absent from ``df`` are ignored."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def pick_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Column pick list."""
    return df.select(*cols)


def split_sources(wide: DataFrame, layout: Mapping[str, Sequence[str]] = SOURCE_LAYOUT) -> dict[str, DataFrame]:
    """One wide table -> several keyed tables (each keeps the key)."""
    return {name: wide.select(*cols) for name, cols in layout.items()}


def snapshot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived wide customer table, written once to the shared folder and read back.

    Later stages (three source selects, joins, ranks, fits) read this table
    instead of re-running the order/line-item aggregation for each use.
    """
    from ..session import scratch_path

    path = scratch_path(spark, "snapshot")
    snapshot_wide(spark, sf_dir).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def source_tables(spark: SparkSession, sf_dir: str, raw: DataFrame | None = None) -> dict[str, DataFrame]:
    """The three attrition source tables derived from the driver tables (or from a snapshot already written)."""
    return split_sources(snapshot_table(spark, sf_dir) if raw is None else raw)


def load_joined(tables: Mapping[str, DataFrame], key: str = C.KEY_COL,
                order: Sequence[str] = ("contracts", "demographics", "usage")) -> DataFrame:
    """Inner equi-join of the sources on one key (unmatched keys drop out).

    No strategy is forced: on big inputs both sides shuffle on the key
    (sort-merge join); AQE switches to a broadcast join at runtime only when
    a side's measured size is under the broadcast threshold.
    """
    out = tables[order[0]]
    for name in order[1:]:
        out = out.join(tables[name], key, "inner")
    return out


def _multiplicities(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """One row per key with the number of rows each source has of it; one shuffle for all sources."""
    parts = [t.select(F.col(key).alias("k"), *[F.lit(int(n == own)).alias(n) for n in tables]) for own, t in tables.items()]
    every = reduce(DataFrame.unionAll, parts)
    return every.groupBy("k").agg(*[F.sum(n).alias(n) for n in tables])  # partial sums: a hot key is a row a task


def join_loss_audit(tables: Mapping[str, DataFrame], key: str = C.KEY_COL) -> DataFrame:
    """Per source, keys that the inner join would drop (present here, missing elsewhere)."""
    return multiplicity_audit(tables, key).where("source is not null").select("source", "lost_keys")


def multiplicity_audit(tables: Mapping[str, DataFrame], key: str = C.KEY_COL) -> DataFrame:
    """What the inner join of all sources on ``key`` does to their rows, before it is run.

    Per source: its rows, those without a key, keys that stand more than once, keys that another source lacks, rows that the join
    loses, and rows of the join beyond one for each kept row. The row without a source name has the join's rows (``rows``)
    and matched keys (``matched_keys``). Counts of rows are decimals: products of multiplicities have no bound of 64 bits.
    """
    names = list(tables)
    n = {s: F.col(s).cast("decimal(38,0)") for s in names}
    joined = reduce(lambda a, b: (a * b).cast("decimal(38,0)"), n.values())
    known, matched = F.col("k").isNotNull(), F.col("k").isNotNull() & reduce(lambda a, b: a & b, [F.col(s) > 0 for s in names])
    total = lambda cond, what: F.coalesce(F.sum(F.when(cond, what)), F.lit(0)).cast("decimal(38,0)")
    has = {s: known & (F.col(s) > 0) for s in names}
    rows = [F.struct(
        F.lit(s).alias("source"), total(F.lit(True), n[s]).alias("rows"), total(~known, n[s]).alias("null_key_rows"),
        F.count_if(known & (F.col(s) > 1)).alias("repeated_keys"), F.count_if(has[s] & ~matched).alias("lost_keys"),
        total(~matched, n[s]).alias("lost_rows"), total(matched, joined - n[s]).alias("fan_out_rows"),
        F.count_if(matched).alias("matched_keys")) for s in names]
    rows.append(F.struct(
        F.lit(None).cast("string").alias("source"), total(matched, joined).alias("rows"), F.lit(0).cast("decimal(38,0)").alias("null_key_rows"),
        F.count_if(matched & (joined > 1)).alias("repeated_keys"), F.lit(0).cast("long").alias("lost_keys"),
        F.lit(0).cast("decimal(38,0)").alias("lost_rows"), F.lit(0).cast("decimal(38,0)").alias("fan_out_rows"),
        F.count_if(matched).alias("matched_keys")))
    cells = [r.alias(f"r{k}") for k, r in enumerate(rows)]
    wide = _multiplicities(tables, key).agg(*cells)
    return wide.select(F.explode(F.array(*[F.col(f"r{k}") for k in range(len(rows))])).alias("x")).select("x.*")
