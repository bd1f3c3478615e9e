"""Streaming scoring (I6) and per-micro-batch summaries.

Records arrive as files in a landing folder and are read with a fixed
schema (no inference). Each micro-batch is validated (X12), scored with
the static scoring bundle (I2), written to an output table, with rejects
going to a quarantine table. The summary of each micro-batch (I3) is
observed while the scores are written, and stored in a folder keyed by ``batch_id`` with overwrite,
so a replayed batch after a restart rewrites the same rows (idempotent).

With ``repeats_within`` the stream keeps a count for each record (customer and content): a record that came before, in this
batch or an earlier one, is not scored again but written to the repeats table and counted in the summary. A count is dropped
once the watermark, the arrival time less ``repeats_within``, has passed its record's last arrival; arrival is the time of
the micro-batch, so no record is ever late. Records are dealt by their digest over ``BUCKETS`` states, each with a sorted
table of its records' digests, counts and times: a batch calls Python once a bucket, not once a record. Without
``repeats_within`` there is no stateful operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from .. import config as C
from ..functions.columns import validate
from ..operators.scoring import ScoringBundle, score_records

SUMMARY = "total_records long, predicted_churn_count long, churn_rate double, mean_churn_probability double"
_OCCURRENCES = "payload string, occurrence long"
#: States over which records are dealt; part of what a checkpoint holds.
BUCKETS = 1 << 12
#: A record's digest, how often it came, and when its count is dropped.
_COUNT = np.dtype([("record", "S32"), ("seen", "i8"), ("until", "i8")])


def _count_occurrences(keep_ms: int):
    """The count of one record with a state of its own: what ``_count_buckets`` does for each record of a bucket."""
    def occurrences(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else 0
        arrived = 0
        for frame in frames:
            yield pd.DataFrame({"payload": frame["payload"], "occurrence": range(seen, seen + len(frame))})
            seen += len(frame)
            arrived = max(arrived, int(frame["arrived"].max().timestamp() * 1000))
        state.update((seen,))
        state.setTimeoutTimestamp(max(arrived, state.getCurrentWatermarkMs()) + keep_ms)

    return occurrences


def _merged(held: np.ndarray, records: np.ndarray, until: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts with ``records`` added, which last until ``until``, and each record's number of occurrences before it."""
    digests, at, times = np.unique(records, return_inverse=True, return_counts=True)
    order = np.argsort(at, kind="stable")
    number = np.empty(len(records), np.int64)
    number[order] = np.arange(len(records)) - np.repeat(np.cumsum(times) - times, times)
    place = np.searchsorted(held["record"], digests)
    known = place < len(held)
    known[known] = held["record"][place[known]] == digests[known]
    before = np.zeros(len(digests), np.int64)
    before[known] = held["seen"][place[known]]
    new = np.empty(len(digests), _COUNT)
    new["record"], new["seen"], new["until"] = digests, before + times, until
    rest = np.delete(held, place[known])
    every = np.concatenate([rest, new])
    return every[np.argsort(every["record"], kind="stable")], before[at] + number


def _count_buckets(keep_ms: int):
    def occurrences(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.frombuffer(state.get[0], _COUNT) if state.exists else np.zeros(0, _COUNT)
        watermark = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for frame in frames:
                if not len(frame):
                    continue
                until = max(int(frame["arrived"].max().timestamp() * 1000), watermark) + keep_ms
                held, occurrence = _merged(held, frame["record"].to_numpy().astype("S32"), until)
                yield pd.DataFrame({"payload": frame["payload"], "occurrence": occurrence})
        held = held[held["until"] >= watermark]
        if len(held):
            state.update((held.tobytes(),))
            state.setTimeoutTimestamp(int(held["until"].min()))
        else:
            state.remove()

    return occurrences


def numbered_records(records: DataFrame, within: str) -> DataFrame:
    """(payload, occurrence) of a stream of records: 0 for a record that is new within the watermark, 1 for its first repeat..."""
    keep_ms = int(pd.Timedelta(within).total_seconds() * 1000)
    rows = records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("payload"),
                          F.current_timestamp().alias("arrived")).withColumn("record", F.md5("payload")).withWatermark("arrived", within)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("record"), F.lit(BUCKETS)))
    return rows.groupBy("bucket").applyInPandasWithState(
        _count_buckets(keep_ms), _OCCURRENCES, "counts binary", "append", GroupStateTimeout.EventTimeTimeout)


def start_scoring_stream(spark: SparkSession, landing: str, schema: StructType, bundle: ScoringBundle,
                         out_dir: str, available_now: bool = True, fmt: str = "parquet",
                         max_files_per_trigger: int | None = None, repeats_within: str | None = None):
    """Start the stream; returns the ``StreamingQuery`` (call ``awaitTermination`` for availableNow)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.load(landing)
    if repeats_within is not None:
        src = numbered_records(src, repeats_within)

    def write(df: DataFrame, table: str, batch_id: int) -> None:
        # the batch id lives in the folder name (partition column when read back)
        df.write.mode("overwrite").parquet(f"{out_dir}/{table}/batch_id={batch_id}")

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        records, extra = batch, {}
        if repeats_within is not None:
            rows = batch.select(F.from_json("payload", schema).alias("r"), "occurrence")
            repeats = rows.where("occurrence > 0").select("r.*", "occurrence")
            counted = Observation()
            write(repeats.observe(counted, F.count(F.lit(1)).alias("n")).select(
                F.col(C.KEY_COL).alias("customer_id"), "occurrence"), "repeats", batch_id)
            extra = {"repeated_records": counted.get["n"]}
            records = rows.where("occurrence = 0").select("r.*")
        valid, rejected = validate(records)
        seen = Observation()
        write(score_records(valid, bundle).observe(
            seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("churn_prediction") == 1).alias("churn"),
            F.avg("churn_probability").alias("mean")), "scored", batch_id)
        write(rejected, "quarantine", batch_id)
        n, churn, mean = (seen.get[k] for k in ("n", "churn", "mean"))
        summary = spark.createDataFrame([(n, churn, round(churn / n, 4) if n else 0.0, round(mean, 4) if n else 0.0)], SUMMARY)
        write(summary.withColumns({k: F.lit(v).cast("long") for k, v in extra.items()}), "summary", batch_id)
        batch.unpersist()

    writer = src.writeStream.foreachBatch(handle).option("checkpointLocation", f"{out_dir}/_checkpoint")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_scored(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(f"{out_dir}/scored")


def read_summaries(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(f"{out_dir}/summary")
