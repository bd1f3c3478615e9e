"""Registry integrity and streaming/batch equivalence."""

import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from attrix.operators import registry as R
from attrix.session import scratch_path
from attrix.storage import Storage


def test_checksums_and_tamper(spark):
    reg = scratch_path(spark, "reg-test")
    m = R.save_version(spark, reg, "v1", None, json.dumps({"a": 1}), 0.49, ["f1", "f2"], "demo")
    assert all(len(v) == 64 for v in m["checksums"].values())
    manifest, checks = R.load_verified(spark, reg)
    assert manifest["version"] == "v1"
    with open(os.path.join(reg, "v1", "threshold.json"), "w") as fh:
        fh.write('{"threshold": 0.9}')
    with pytest.raises(ValueError, match="Checksum mismatch"):
        R.load_verified(spark, reg, "v1")
    with pytest.raises(FileNotFoundError):
        R.verify(spark, reg, "v9")


def test_checksums_survive_a_copy_of_a_dotted_version(spark):
    import shutil

    reg = scratch_path(spark, "reg-dots")
    R.save_version(spark, reg, "v1.0.0", None, json.dumps({"a": 1}), 0.49, ["f1"], "demo")
    moved = os.path.join(scratch_path(spark, "reg-moved"), "copy.d")
    shutil.copytree(reg, moved)
    assert {r.status for r in R.verify(spark, moved, "v1.0.0").collect()} == {"ok"}


def test_large_files_are_hashed_in_chunks(spark):
    reg = scratch_path(spark, "reg-large")
    os.makedirs(os.path.join(reg, "sub"))
    for name, size in (("a.bin", 0), ("sub/b.bin", 1), ("c d.bin", 5000), ("é%.bin", 70_001)):
        with open(os.path.join(reg, name), "wb") as fh:
            fh.write(os.urandom(size))
    whole = {(r.file, r["size"], r.sha256) for r in R.file_checksums(spark, reg).collect()}
    assert len(whole) == 4
    for limit in (0, 1000):
        assert {(r.file, r["size"], r.sha256) for r in R.file_checksums(spark, reg, limit).collect()} == whole
    assert R.streamed_sha256(f"file://{reg}/c d.bin", 999) in {s for _, _, s in whole}


def test_versions_do_not_change_and_the_pointer_is_whole(spark):
    reg = scratch_path(spark, "reg-writers")

    def save(k):
        try:
            return R.save_version(spark, reg, f"v{k % 3}", None, json.dumps({"k": k}), k / 10, ["f"], f"model-{k}")
        except Exception as e:  # noqa: BLE001
            return e

    with ThreadPoolExecutor(max_workers=6) as pool:
        done = list(pool.map(save, range(6)))  # two writers a version
    won = {m["version"]: m for m in done if isinstance(m, dict)}
    assert set(won) == {"v0", "v1", "v2"} and len([m for m in done if isinstance(m, dict)]) == 3
    for version, manifest in won.items():
        found, checks = R.load_verified(spark, reg, version)
        assert found["model_name"] == manifest["model_name"] and {r.status for r in checks.collect()} == {"ok"}
    assert R.latest_version(spark, reg).first()["latest"] in won
    with pytest.raises(FileExistsError):
        R.save_version(spark, reg, "v1", None, "{}", 0.1, ["f"], "again")
    assert R.load_verified(spark, reg, "v1")[0]["model_name"] == won["v1"]["model_name"]
    assert not [f for f in os.listdir(reg) if f.startswith("latest.json.") or f.endswith(".crc")]


def test_an_unfinished_save_is_no_version(spark, monkeypatch):
    reg = scratch_path(spark, "reg-cut")
    R.save_version(spark, reg, "v1", None, "{}", 0.1, ["f"], "first")
    monkeypatch.setattr(R, "file_checksums", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        R.save_version(spark, reg, "v2", None, "{}", 0.1, ["f"], "second")
    monkeypatch.undo()
    assert R.latest_version(spark, reg).first()["latest"] == "v1"
    with pytest.raises(FileNotFoundError):
        R.load_verified(spark, reg, "v2")


def test_storage_moves(spark):
    store, base = Storage(spark), scratch_path(spark, "storage")
    store.write_text(f"{base}/a", "é1")
    store.write_text(f"{base}/b", "2")
    with pytest.raises(Exception):
        store.move(f"{base}/a", f"{base}/b")
    assert (store.read_text(f"{base}/a"), store.read_text(f"{base}/b")) == ("é1", "2")
    store.move(f"{base}/a", f"{base}/b", replace=True)
    assert store.read_text(f"{base}/b") == "é1" and not store.exists(f"{base}/a")


def test_a_moved_trained_version_scores_alike(spark):
    import shutil

    from attrix.operators.scoring import ScoringBundle, predict_raw
    from attrix.plans import common
    from attrix.plans import training as T

    sf = "/root/testdata/sf0.001"
    data, bundle = T.model_data(spark, sf)
    model = T.fit("logistic_regression", data.where("split = 'train'"))
    trained = ScoringBundle(params=bundle.params, ml_model=model, threshold=0.37, total_charges_median=bundle.total_charges_median)
    reg = scratch_path(spark, "reg-model")
    R.save_version(spark, reg, "v1.0.0", model, bundle.params.to_json(), 0.37, [n for _, n, _ in bundle.params.feature_names()],
                   "lr", bundle.total_charges_median, model_params={"C": 1.0})
    moved = os.path.join(scratch_path(spark, "reg-elsewhere"), "copy")
    shutil.copytree(reg, moved)
    shutil.rmtree(reg)
    loaded = R.load_bundle(spark, moved)
    assert loaded.threshold == 0.37 and loaded.total_charges_median == bundle.total_charges_median
    recs = common.serving_records(spark, sf)
    got, want = predict_raw(recs, loaded), predict_raw(recs, trained)
    assert got.columns == [*recs.columns, "churn_probability", "churn_prediction"]  # raw input and two columns
    assert got.exceptAll(want).count() == 0 and got.count() == recs.count()
    assert json.loads(R.model_info(spark, moved, "v1.0.0").first().model_params) == {"C": 1.0}


def test_stream_equals_batch(spark):
    from attrix.plans import common
    from attrix.operators.scoring import score_records
    from attrix.streaming.scoring_stream import read_scored, read_summaries, start_scoring_stream
    from attrix import schemas as S

    sf = "/root/testdata/sf0.001"
    bundle = common.fitted(spark, sf)[1]
    recs = common.serving_records(spark, sf)
    landing = scratch_path(spark, "landing-test")
    recs.repartition(3).write.mode("overwrite").parquet(landing)
    out = scratch_path(spark, "out-test")
    start_scoring_stream(spark, landing, S.SERVING, bundle, out).awaitTermination()
    streamed = read_scored(spark, out).drop("batch_id")
    batch = score_records(recs, bundle)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    tot = read_summaries(spark, out).agg(F.sum("total_records")).first()[0]
    assert tot == recs.count()


def test_repeated_records_are_counted_and_not_scored_again(spark):
    """A replayed file, records repeated within a file, changed records and records without an id."""
    from attrix import schemas as S
    from attrix.operators.scoring import batch_summary, score_records
    from attrix.plans import common
    from attrix.streaming.scoring_stream import read_scored, read_summaries, start_scoring_stream

    sf = "/root/testdata/sf0.001"
    bundle = common.fitted(spark, sf)[1]
    recs = common.serving_records(spark, sf).orderBy("CustomerID")
    rows = [tuple(r) for r in recs.limit(30).collect()]
    nameless, null_total = (None, *rows[1][1:]), (*rows[2][:10], None, *rows[2][11:])
    files = [rows[:10] + rows[:2] + [nameless], rows[:10], rows[10:20] + [(*rows[3][:1], rows[3][1] + 1, *rows[3][2:])] + [nameless],
             [null_total, null_total]]
    landing, out = scratch_path(spark, "landing-repeats"), scratch_path(spark, "out-repeats")

    def arrive(k):
        spark.createDataFrame(files[k], S.SERVING).coalesce(1).write.mode("append").parquet(landing)
        start_scoring_stream(spark, landing, S.SERVING, bundle, out, repeats_within="7 days").awaitTermination()

    for k in range(len(files)):
        arrive(k)  # each restart goes on from the checkpoint's state
    every = [r for f in files for r in f]
    scored = read_scored(spark, out).drop("batch_id")
    want = score_records(spark.createDataFrame(list(dict.fromkeys(every)), S.SERVING), bundle)
    assert scored.exceptAll(want).count() == 0 and want.exceptAll(scored).count() == 0
    s = read_summaries(spark, out).agg(F.sum("total_records").alias("n"), F.sum("repeated_records").alias("repeats")).first()
    assert (s.n, s.repeats) == (len(set(every)), len(every) - len(set(every)))
    one = batch_summary(read_scored(spark, out).where("batch_id = 0")).first()
    got = read_summaries(spark, out).where("batch_id = 0").first()
    assert (got.total_records, got.predicted_churn_count, got.churn_rate, got.mean_churn_probability, got.repeated_records) == (*one, 2)
    repeats = spark.read.parquet(f"{out}/repeats")
    assert repeats.count() == s.repeats and repeats.where(f"customer_id = '{rows[0][0]}'").agg(F.max("occurrence")).first()[0] == 2


def test_states_end_with_the_watermark():
    """A repeat after the state has timed out is a new record again."""
    import pandas as pd

    from attrix.streaming.scoring_stream import _count_occurrences

    class State:
        exists, hasTimedOut, value, timeout = False, False, None, None

        def update(self, v):
            self.exists, self.value = True, v

        def remove(self):
            self.exists, self.value = False, None

        get = property(lambda self: self.value)

        def getCurrentWatermarkMs(self):
            return 0

        def setTimeoutTimestamp(self, ms):
            self.timeout = ms

    count, state = _count_occurrences(5000), State()
    at = lambda s: pd.DataFrame({"payload": ["r"] * 2, "arrived": [pd.Timestamp(s, unit="s")] * 2})
    assert [x for f in count(("k",), iter([at(10), at(11)]), state) for x in f["occurrence"]] == [0, 1, 2, 3]
    assert state.timeout == 16000 and state.value == (4,)
    state.hasTimedOut = True
    assert list(count(("k",), iter([]), state)) == [] and not state.exists
    state.hasTimedOut = False
    assert [x for f in count(("k",), iter([at(30)]), state) for x in f["occurrence"]] == [0, 1]


def test_counts_of_records_share_a_state():
    """Records of one bucket are counted apart, over batches, and dropped one by one as the watermark passes."""
    import numpy as np
    import pandas as pd

    from attrix.streaming import scoring_stream as SS

    class State:
        hasTimedOut, value, watermark, timeout = False, None, 0, None
        exists = property(lambda self: self.value is not None)
        get = property(lambda self: self.value)
        getCurrentWatermarkMs = lambda self: self.watermark

        def update(self, value):
            self.value = value

        def remove(self):
            self.value = None

        def setTimeoutTimestamp(self, at):
            self.timeout = at

    state, count = State(), SS._count_buckets(1000)

    def batch(at, records):
        frame = pd.DataFrame({"payload": records, "record": [f"{ord(r):032x}" for r in records], "arrived": pd.to_datetime([at] * len(records), unit="ms")})
        return [n for f in count((1,), iter([frame[:2], frame[2:]]), state) for n in f["occurrence"]]

    assert batch(10, list("babcb")) == [0, 0, 1, 0, 2]
    assert batch(500, list("ad")) == [1, 0] and state.timeout == 1010
    state.hasTimedOut, state.watermark = True, 1200  # b and c have passed, a and d came again or later
    assert list(count((1,), iter([]), state)) == [] and len(np.frombuffer(state.value[0], SS._COUNT)) == 2 and state.timeout == 1500
    state.hasTimedOut = False
    assert batch(1300, list("abd")) == [2, 0, 1]
    state.hasTimedOut, state.watermark = True, 9000
    assert list(count((1,), iter([]), state)) == [] and not state.exists
