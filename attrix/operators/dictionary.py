"""One-hot encoding over a category dictionary (F4, F5), for columns of any number of categories.

The dictionary is a table: every category of a column with its place in sorted order, ranked in parallel (range partitions
and counts a range). A row finds its places by joins, which are broadcast for columns of at most ``BROADCAST_CATEGORIES``
categories, as counted when the dictionary was made, and left to the planner beyond. Vectors are sparse: the cost of a row is
its columns, not its categories, and no category becomes an expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .ranks import ranged

BROADCAST_CATEGORIES = 200_000


@dataclass
class Dictionary:
    """(column, category, position) as a stored table, and the number of categories of each column."""

    table: DataFrame
    sizes: dict[str, int]

    def offsets(self, first: int = 0) -> dict[str, int]:
        """Where each column's categories begin in the vector, after ``first`` other features."""
        out, at = {}, first
        for c, n in self.sizes.items():
            out[c], at = at, at + n
        return out

    def names(self, first: int = 0) -> DataFrame:
        """(idx, name, source_column) of the encoded features."""
        offset = F.create_map(*[x for c, at in self.offsets(first).items() for x in (F.lit(c), F.lit(at))])
        return self.table.select((offset[F.col("column")] + F.col("position")).cast("int").alias("idx"),
                                 F.concat_ws("_", "column", "category").alias("name"), F.col("column").alias("source_column"))


def fit_dictionary(train: DataFrame, cols: Sequence[str]) -> Dictionary:
    """the sorted categories of ``cols`` in ``train``; NULL is no category."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("category")) for c in cols])
    found = train.select(F.explode(cells).alias("x")).select("x.*").where(F.col("category").isNotNull()).distinct()
    tagged = ranged(found, ["column"], [F.col("category").asc()])
    counts = tagged.groupBy("column", "_b").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("column", "_b", (F.sum("n").over(Window.partitionBy("column").orderBy("_b")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("column", "_b").orderBy("category")) - 1
    ranked = tagged.withColumn("place", place).join(before, ["column", "_b"]).select(
        "category", (F.col("place") + F.col("before")).cast("long").alias("position"), "column")
    path = scratch_path(train.sparkSession, "dictionary")
    ranked.write.mode("overwrite").partitionBy("column").parquet(path)
    table = train.sparkSession.read.schema(ranked.schema).parquet(path).select("column", "category", "position")
    sizes = {r["column"]: r["n"] for r in table.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a column
    return Dictionary(table, {c: sizes.get(c, 0) for c in cols})


def encode(df: DataFrame, dictionary: Dictionary, numbers: Sequence[Column] = (), out: str = "features",
           broadcast_categories: int | None = None) -> DataFrame:
    """``df`` with a sparse vector of ``numbers`` and the one-hot places of the dictionary's columns.

    Categories that the dictionary lacks, and NULL, have no entry. The vector has the layout of an ML vector
    (type, size, indices, values); ``vectors`` reads it as one.
    """
    limit = BROADCAST_CATEGORIES if broadcast_categories is None else broadcast_categories
    first, offsets = len(numbers), dictionary.offsets(len(numbers))
    rows, tag = df, "_"
    while any(c.startswith(tag) for c in df.columns):
        tag += "_"
    for k, (c, n) in enumerate(dictionary.sizes.items()):
        places = dictionary.table.where(F.col("column") == c).select(
            F.col("category").alias(f"{tag}c{k}"), F.col("position").alias(f"{tag}p{k}"))
        rows = rows.join(F.broadcast(places) if n <= limit else places, F.col(c).cast("string") == F.col(f"{tag}c{k}"), "left")
    entry = lambda i, v: F.struct(i.cast("int").alias("i"), v.cast("double").alias("v"))
    entries = [entry(F.lit(i), x) for i, x in enumerate(numbers)] + [
        entry(F.col(f"{tag}p{k}") + F.lit(offsets[c]), F.lit(1.0)) for k, c in enumerate(dictionary.sizes)]
    kept = F.filter(F.array(*entries), lambda e: e["i"].isNotNull() & (e["v"].isNull() | (e["v"] != 0.0)))
    width = first + sum(dictionary.sizes.values())
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(width).cast("int").alias("size"),
                      F.transform(kept, lambda e: e["i"]).alias("indices"), F.transform(kept, lambda e: e["v"]).alias("values"))
    return rows.select(*df.columns, vector.alias(out))


def vectors(encoded: DataFrame, col: str = "features") -> DataFrame:
    """``encoded`` written to the shared folder and read back with ``col`` as ML vectors, without a Python function a row."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import StructField, StructType

    path = scratch_path(encoded.sparkSession, "vectors")
    encoded.write.mode("overwrite").parquet(path)
    schema = StructType([StructField(f.name, VectorUDT() if f.name == col else f.dataType) for f in encoded.schema.fields])
    return encoded.sparkSession.read.schema(schema).parquet(path)
