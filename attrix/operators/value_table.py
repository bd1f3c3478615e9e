"""One table of value counts behind the profile of a table.

``value_table`` scans the input once: the columns are unpivoted and counted by (class, column, value), with partial counts
before the shuffle, and the counts are written to the shared folder, partitioned by column. Nulls, moments, quantiles, outliers,
histograms, box statistics, rates and duplicates are all read off this table, which has a row for each different value
instead of one for each cell; a report that needs one column reads that column's part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import half_even_round
from ..session import scratch_path
from .ranks import join_null_safe, quantiles_of_counts

#: The pseudo column that stands for whole rows.
ROW = "*"
QUARTERS = (0.25, 0.5, 0.75)


@dataclass
class ValueTable:
    """Counts ``n`` by class, column and value (text, and ``number`` where the column is numeric)."""

    counts: DataFrame
    columns: list[str]

    def of(self, cols: Sequence[str]) -> DataFrame:
        return self.counts.where(F.col("column").isin(*cols))

    def numbers(self, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
        """(by..., column, number, n) of the values that are numbers."""
        return self.of(cols).where(F.col("number").isNotNull() & ~F.isnan("number")).groupBy(*by, "column", "number").agg(
            F.sum("n").alias("n"))

    def every(self, cols: Sequence[str]) -> DataFrame:
        """One row a column, so that a column without values keeps its place."""
        return self.counts.sparkSession.createDataFrame([(c,) for c in cols], "column string")

    # A1 / A4 / P6 ----------------------------------------------------------
    def size(self) -> DataFrame:
        return self.of(self.columns[:1]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))

    def nulls(self, nonzero_only: bool = True) -> DataFrame:
        per = self.of(self.columns).groupBy("column").agg(
            F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("null_count"), F.sum("n").alias("rows"))
        out = per.select("column", "null_count", half_even_round(F.lit(100.0) * F.col("null_count") / F.col("rows"), 2).alias("null_pct"))
        return out.where("null_count > 0") if nonzero_only else out

    # A6 / A7 ---------------------------------------------------------------
    def duplicates(self, key: str) -> DataFrame:
        """Rows whose key, and rows that as a whole, stood before: one row; needs the key and ``ROW``."""
        again = self.of([key, ROW]).groupBy("column", "value").agg((F.sum("n") - 1).alias("n"))
        of = lambda c: F.coalesce(F.sum(F.when(F.col("column") == c, F.col("n"))), F.lit(0)).cast("bigint")
        return again.agg(of(key).alias("duplicate_keys"), of(ROW).alias("duplicate_rows"))

    # A8 --------------------------------------------------------------------
    def quartiles(self, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
        """(by..., column, q1, median, q3)."""
        keys = [*by, "column"]
        q = quantiles_of_counts(self.numbers(cols, by), QUARTERS, keys, "number", "n")
        at = lambda p: F.max(F.when(F.col("prob") == p, F.col("quantile")))
        return q.groupBy(*keys).agg(*[at(p).alias(c) for p, c in zip(QUARTERS, ("q1", "median", "q3"))])

    def moments(self, cols: Sequence[str]) -> DataFrame:
        """(column, count, mean, std, min, max); deviations are taken from the mean, not from sums of squares."""
        x, n = F.col("number"), F.col("n")
        first = self.numbers(cols).groupBy("column").agg(
            F.sum("n").alias("count"), (F.sum(x * n) / F.sum(n)).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))
        spread = self.numbers(cols).join(first, "column").groupBy("column", "count", "mean", "min", "max").agg(
            F.sum(n * (x - F.col("mean")) * (x - F.col("mean"))).alias("ss"))
        return spread.withColumn("std", F.sqrt(F.try_divide(F.col("ss"), (F.col("count") - 1).cast("double")))).drop("ss")

    def describe(self, cols: Sequence[str], digits: int = 2) -> DataFrame:
        full = self.every(cols).join(self.moments(cols), "column", "left").join(self.quartiles(cols), "column", "left").withColumnsRenamed(
            {"q1": "p25", "median": "p50", "q3": "p75"})
        return full.select("column", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
                           *[half_even_round(F.col(m), digits).alias(m) for m in ("mean", "std", "min", "p25", "p50", "p75", "max")])

    # A9 / A15 --------------------------------------------------------------
    def value_counts(self, cols: Sequence[str], digits: int = 2) -> DataFrame:
        counts = self.of(cols).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.sum("n").cast("bigint").alias("count"))
        return counts.crossJoin(self.size()).select(  # one row
            "column", "value", "count", half_even_round(F.lit(100.0) * F.col("count") / F.col("n_rows"), digits).alias("pct"))

    def rates(self, cols: Sequence[str]) -> DataFrame:
        """(column, value, rate): the share of class 1 among rows of a known class."""
        y = F.col("class").cast("double")
        return self.of(cols).where("value is not null and class is not null").groupBy("column", "value").agg(
            (F.sum(y * F.col("n")) / F.sum("n")).alias("rate"))

    # A11 -------------------------------------------------------------------
    def outliers(self, cols: Sequence[str]) -> DataFrame:
        """Q1, Q3, the 1.5 IQR fences and the number of values strictly outside them."""
        width = F.col("q3") - F.col("q1")
        fences = self.quartiles(cols).select("column", "q1", "q3", (F.col("q1") - 1.5 * width).alias("lower"),
                                             (F.col("q3") + 1.5 * width).alias("upper"))
        outside = (F.col("number") < F.col("lower")) | (F.col("number") > F.col("upper"))
        found = self.numbers(cols).join(fences, "column").where(outside).groupBy("column").agg(F.sum("n").alias("outliers"))
        return self.every(cols).join(fences, "column", "left").join(found, "column", "left").select(
            "column", "q1", "q3", "lower", "upper", F.coalesce("outliers", F.lit(0)).cast("bigint").alias("outliers"))

    # A13 -------------------------------------------------------------------
    def class_correlation(self, cols: Sequence[str]) -> DataFrame:
        """(column, r): Pearson r of each numeric column with the class, over rows that have both; NULL without spread."""
        pairs = self.of(cols).where("number is not null and not isnan(number) and class is not null").select(
            "column", F.col("number").alias("x"), F.col("class").cast("double").alias("y"), F.col("n").cast("double").alias("n"))
        n, x, y = F.col("n"), F.col("x"), F.col("y")
        means = pairs.groupBy("column").agg((F.sum(x * n) / F.sum(n)).alias("mx"), (F.sum(y * n) / F.sum(n)).alias("my"))
        dx, dy = x - F.col("mx"), y - F.col("my")
        r = pairs.join(means, "column").groupBy("column").agg(
            F.try_divide(F.sum(n * dx * dy), F.sqrt(F.sum(n * dx * dx)) * F.sqrt(F.sum(n * dy * dy))).alias("r"))
        return self.every(cols).join(r, "column", "left")

    # A17 / A18 -------------------------------------------------------------
    def class_histogram(self, col: str, bins: int = 30) -> DataFrame:
        """(class, bin, bin_start, bin_end, count): equal width over each class's own range."""
        values = self.numbers([col], ["class"])
        ranges = values.groupBy("class").agg(F.min("number").alias("lo"), F.max("number").alias("hi"))
        lo, hi, x = F.col("lo"), F.col("hi"), F.col("number")
        b = F.when(hi == lo, F.lit(0)).otherwise(F.least(F.floor((x - lo) / ((hi - lo) / F.lit(bins))), F.lit(bins - 1))).cast("int")
        binned = join_null_safe(values, ranges, ["class"]).withColumn("bin", b).groupBy("class", "bin", "lo", "hi").agg(
            F.sum("n").cast("bigint").alias("count"))
        edge = lambda k: lo + k * (hi - lo) / F.lit(bins)
        return binned.select("class", "bin", edge(F.col("bin")).alias("bin_start"), edge(F.col("bin") + 1).alias("bin_end"), "count")

    def box_stats(self, cols: Sequence[str]) -> DataFrame:
        """(class, column, q1, median, q3, whisker_low, whisker_high, fliers)."""
        j = join_null_safe(self.numbers(cols, ["class"]), self.quartiles(cols, ["class"]), ["class", "column"])
        reach, x = 1.5 * (F.col("q3") - F.col("q1")), F.col("number")
        inside = (x >= F.col("q1") - reach) & (x <= F.col("q3") + reach)
        return j.groupBy("class", "column", "q1", "median", "q3").agg(
            F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("fliers"))


def _row_digest(columns: Sequence[str]) -> Column:
    """A digest of a whole row; NULL differs from every text."""
    cells = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in columns]
    return F.md5(F.to_json(F.array(*cells)))


def value_table(df: DataFrame, cols: Sequence[str] | None = None, target: str | Column | None = None, rows: bool = False) -> ValueTable:
    """Counts of the values of ``cols`` by ``target`` (a class, or none), and of whole rows if ``rows``."""
    from .profile import numeric_columns

    cols = list(df.columns if cols is None else cols)
    numeric = set(numeric_columns(df))
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"),
                      (F.col(c) if c in numeric else F.lit(None)).cast("double").alias("number")) for c in cols]
    if rows:
        cells.append(F.struct(F.lit(ROW).alias("column"), _row_digest(df.columns).alias("value"), F.lit(None).cast("double").alias("number")))
    of = F.lit(None).cast("string") if target is None else F.col(target) if isinstance(target, str) else target
    counts = df.select(of.alias("class"), F.explode(F.array(*cells)).alias("cell")).groupBy(
        "class", F.col("cell.column").alias("column"), F.col("cell.value").alias("value")).agg(
        F.max("cell.number").alias("number"), F.count(F.lit(1)).alias("n"))
    path = scratch_path(df.sparkSession, "value-counts")
    counts.write.mode("overwrite").partitionBy("column").parquet(path)
    back = df.sparkSession.read.schema(counts.schema).parquet(path)
    return ValueTable(back, cols)
