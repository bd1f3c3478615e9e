"""The corpus pipeline: toxicity, near duplicates, benchmark leaks, personal data, token ids.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns the rows for the next one, with
the columns of documents but for the last. ``run`` writes every stage's rows to the shared folder and reads them again.
All stages take nulls, repeated rows and extra columns as their operators do; a null text is kept by every filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrix.llm import decontaminate, gru_toxicity, jaccard_groups, rank_bpe, surrogates
from attrix.llm.common import documents, fresh, ship, stored, table
from attrix.llm.queries import tokenizer

#: Bytes of a batch of rows on its way to a Python worker; ten thousand rows, Spark's own bound, can be very long texts.
ARROW_BYTES = 8 << 20

ORACLE_SQL = None  # a trained model and edit distances decide: SQL can't express them


def _prepare(spark: SparkSession) -> None:
    """The package for the workers, and batches of bounded bytes for the stages that follow in this session."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores under one half. The model learns from labels and the texts of this stage's input."""
    _prepare(spark)
    net = gru_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(gru_toxicity.toxicity_column(net) < 0.5)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that of its smallest document id (without ids, of its smallest set); rows without words stay.

    A row whose id no other row has is known by its id: rows stay where they are, and the ids that go are joined to them. Only rows
    that share an id, or have none, are hashed again to tell them apart; of those equal in id and set the row with the least text,
    then the least of its other columns (as JSON), stays.
    """
    _prepare(spark)
    found, _ = stored(spark, jaccard_groups.jaccard_components(docs), "components")
    with_words = found.where("node is not null")
    # of each component the least id and then the least set
    kept = with_words.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("k")).select(
        F.col("k.doc_id").alias("d"), F.col("k.node").alias("n"))
    kept, _ = stored(spark, kept, "kept-sets")
    shared = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("d"))
    shared, _ = stored(spark, shared, "shared-ids")
    known = F.col("doc_id").eqNullSafe(F.col("d"))
    gone = with_words.where("doc_id is not null").join(kept, known & (F.col("node") == F.col("n")), "left_anti").select(
        F.col("doc_id").alias("d")).unionByName(shared).distinct()
    gone, _ = stored(spark, gone, "gone-ids")
    one = F.col("doc_id") == F.col("d")
    alone = docs.where("doc_id is not null").join(gone, one, "left_anti")

    rows = docs.where("doc_id is null").unionByName(docs.where("doc_id is not null").join(shared, one, "left_semi"))
    tag = fresh(docs)
    rows = rows.withColumn(f"{tag}node", jaccard_groups.set_nodes(rows))
    empty = rows.where(F.col(f"{tag}node") == 0).select(*docs.columns)
    chosen = rows.join(kept, known & (F.col(f"{tag}node") == F.col("n")), "left_semi")
    order = F.struct(F.col("text"), F.to_json(F.struct(*docs.columns)))
    chosen = chosen.groupBy("doc_id", f"{tag}node").agg(F.min_by(F.struct(*docs.columns), order).alias("r"))
    return alone.unionByName(empty).unionByName(chosen.select("r.*"))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark passage."""
    _prepare(spark)
    columns = decontaminate.leaked_columns(docs, table(spark, sf_dir, "benchmark"))
    return docs.where(~reduce(lambda a, b: a | b, columns)) if columns else docs


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with surrogates for personal data in the text."""
    return surrogates.replace_entities(docs)[0]


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row."""
    _prepare(spark)
    return rank_bpe.encode_documents(docs, tokenizer("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("toxicity", not_toxic),
    ("ngram_jaccard_join", without_near_duplicates),
    ("benchmark_decontamination", without_leaks),
    ("personal_data", without_personal_data),
    ("bpe_encoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs, _ = stored(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
