"""Helpers shared by the document operators: inputs, shared scratch tables, small numeric helpers."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrix.session import shared_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh table path in the shared checkpoint folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def local_form(path: str) -> str:
    """The mounted form of a shared path, for workers that map files of the shared folder."""
    if path.startswith("file:"):
        return "/" + path[len("file:"):].lstrip("/")
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table of ours in the shared folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(spark: SparkSession, df: DataFrame, name: str, by: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """``df`` written as a table of the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def id_and_bytes(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the UTF-8 bytes of the text (a null text as empty); other columns never reach the workers."""
    return docs.select(
        F.col(doc_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )


def id_and_text(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def input_partitions(df: DataFrame) -> int:
    return max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fold(col: str, mod: int):
    """crc32 of the decimal id text modulo ``mod``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and xor-shift), for spreading combined hashes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ship(spark: SparkSession) -> None:
    """Gives the Python workers of this session the package, once, also where it isn't installed on them."""
    sc = spark.sparkContext
    if getattr(sc, "_attrix_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    where = tempfile.mkdtemp(prefix="attrix-")
    target = os.path.join(where, "attrix_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(target)
    sc._attrix_shipped = True


def fresh(df: DataFrame) -> str:
    """A prefix that no column of ``df`` begins with."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def text_runs(texts: list, chars: int):
    """(start, stop) of runs of texts of about ``chars`` characters together; a longer text is a run of its own."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


class Kept(dict):
    """What was learned about pieces of text, in two generations of at most ``size`` entries.

    A look-up of a piece that neither has adds it to ``new`` and gives None.
    """

    def __init__(self, size: int):
        super().__init__()
        self.size, self.older, self.new = size, {}, set()

    def __missing__(self, piece):
        got = self.older.get(piece)
        if got is None:
            self.new.add(piece)
        else:
            self[piece] = got
        return got

    def find(self, piece):
        """What both generations know of a piece, or None."""
        got = self.get(piece)
        if got is None and (got := self.older.get(piece)) is not None:
            self[piece] = got
        return got

    def turn(self) -> None:
        if len(self) > self.size:
            self.older = dict(self)
            self.clear()


def give_back() -> None:
    """Returns this worker's free memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own ways
        pass


_HOLDER: list = []


def hold(name: str, clear) -> None:
    """Says that the operator ``name`` keeps things in this worker; what another one kept before goes back to the system."""
    if _HOLDER and _HOLDER[0] != name:
        _HOLDER[1]()
        give_back()
    _HOLDER[:] = [name, clear]
