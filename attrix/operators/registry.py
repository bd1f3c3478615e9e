"""Artifact registry (R1-R5): versioned save, checksums, latest pointer, verified load.

Everything goes through Hadoop file systems: Spark writes models and reads artifacts, ``Storage`` writes the few small documents.
A version is written to a staging folder, summed up in a manifest and then renamed to its name, so a version that exists is
whole; the pointer is a document that is replaced by a rename, so two writers leave one of their versions as the latest and
never a mixture. Checksums are taken by the executors: Spark hashes files up to ``WHOLE`` bytes, larger ones are read in
chunks by a worker, as one value of Spark can't hold them.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import json
import platform
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..storage import Storage
from .models import LinearScorer
from .prep import PrepParams
from .scoring import ScoringBundle

MANIFEST = "manifest.json"
LATEST = "latest.json"
#: Files up to this size are hashed as one value; Spark itself ends at 2 GiB.
WHOLE = 1 << 30
CHUNK = 8 << 20


def streamed_sha256(uri: str, chunk: int = CHUNK) -> str:
    """SHA-256 of a file of any size, read in chunks through the Hadoop, local or object store client of the worker.

    ``uri`` is a path as Spark reports it: with its scheme, and not escaped.
    """
    from pyarrow import fs

    scheme, rest = uri.split(":", 1)
    system, path = (fs.LocalFileSystem(), rest) if scheme == "file" else fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")
    digest = hashlib.sha256()
    with system.open_input_stream(path) as stream:
        while block := stream.read(chunk):
            digest.update(block)
    return digest.hexdigest()


def _streamed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame.assign(sha256=[streamed_sha256(uri) for uri in frame["path"]])


def file_checksums(spark: SparkSession, root: str, whole: int | None = None) -> DataFrame:
    """(relative path, size, sha256) of every file under ``root`` (manifest excluded)."""
    whole = WHOLE if whole is None else whole
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    small = every.where(F.col("length") <= whole).select("path", "length", F.sha2(F.col("content"), 256).alias("sha256"))
    large = every.where(F.col("length") > whole).select("path", "length")  # the content is never read here
    spread = large.repartition("path").mapInPandas(_streamed, "path string, length long, sha256 string")
    store = Storage(spark)
    empty = spark.createDataFrame([(p, 0, hashlib.sha256().hexdigest()) for p in store.empty_files(root)],
                                  "path string, length long, sha256 string")
    # the qualified root, as Spark writes it in front of the paths, is cut by its length
    rel = F.substr(F.col("path"), F.lit(len(store.qualified(root).rstrip("/")) + 2))
    name = F.element_at(F.split(F.col("file"), "/"), -1)  # names that file scans hide
    return small.unionByName(spread).unionByName(empty).select(rel.alias("file"), F.col("length").alias("size"), "sha256").where(
        ~F.col("file").endswith(MANIFEST) & ~F.col("file").rlike(r"(^|/)\.") & ~name.startswith("_"))


def save_version(spark: SparkSession, registry: str, version: str, model, params_json: str, threshold: float,
                 feature_names: list[str], model_name: str, median: float | None = None,
                 scorer: LinearScorer | None = None, model_params: dict | None = None) -> dict:
    """R2 + R3: the model (MLWriter or literal weights), parameters, threshold and train median as ``registry/version`` with a
    manifest, and the pointer set to it. A version that exists is an error: versions don't change."""
    store, target = Storage(spark), f"{registry}/{version}"
    if store.exists(target):
        raise FileExistsError(f"version {version} exists")
    staging = f"{registry}/staging-{uuid.uuid4().hex}"
    store.make_folder(staging)
    if model is not None:
        model.write().overwrite().save(f"{staging}/model")
    store.write_text(f"{staging}/prep_params.json", params_json)
    store.write_text(f"{staging}/threshold.json", json.dumps({"threshold": threshold, "total_charges_median": median}))
    if scorer is not None:
        store.write_text(f"{staging}/scorer.json", json.dumps({"intercept": scorer.intercept, "weights": scorer.weights}))
    store.write_text(f"{staging}/feature_names.json", json.dumps(feature_names))
    sums = {r["file"]: r["sha256"] for r in file_checksums(spark, staging).collect()}  # one row per file
    manifest = {
        "model_name": model_name,
        "version": version,
        "created_at": _dt.datetime.now(_dt.timezone.utc).isoformat(),
        "model_class": type(model if model is not None else scorer).__name__,
        "model_params": json.dumps(model_params or {}, sort_keys=True),
        "threshold": threshold,
        "n_features": len(feature_names),
        "environment": {"python": platform.python_version(), "spark": spark.version},
        "checksums": sums,
    }
    store.write_text(f"{staging}/{MANIFEST}", json.dumps(manifest, indent=2, sort_keys=True))
    store.move(staging, target)  # fails if another writer was first
    store.swap_text(f"{registry}/{LATEST}", json.dumps({"latest": version}))  # R3: pointer, not a copy
    return manifest


def manifest_frame(spark: SparkSession, registry: str, version: str) -> DataFrame:
    """The manifest read with a fixed schema (checksums as a map)."""
    schema = ("model_name string, version string, created_at string, model_class string, model_params string, threshold double, "
              "n_features int, environment map<string,string>, checksums map<string,string>")
    return spark.read.schema(schema).option("multiLine", True).json(f"{registry}/{version}/{MANIFEST}")


def latest_version(spark: SparkSession, registry: str) -> DataFrame:
    return spark.read.schema("latest string").option("multiLine", True).json(f"{registry}/{LATEST}")


def verify(spark: SparkSession, registry: str, version: str) -> DataFrame:
    """Recomputed checksums joined with the manifest; one row per file with its status.

    Unlike a check that skips missing files, a file listed in the manifest
    but absent on disk is reported as ``missing``.
    """
    store, vdir = Storage(spark), f"{registry}/{version}"
    if not store.exists(vdir):
        raise FileNotFoundError(f"unknown version {version}")
    if not store.exists(f"{vdir}/{MANIFEST}"):
        raise FileNotFoundError(f"manifest missing for {version}")
    expected = manifest_frame(spark, registry, version).select(F.explode("checksums").alias("file", "expected"))
    actual = file_checksums(spark, vdir).select("file", F.col("sha256").alias("actual"))
    j = expected.join(actual, "file", "full_outer")
    status = (F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unlisted")
              .when(F.col("actual") == F.col("expected"), "ok").otherwise("mismatch"))
    return j.select("file", "expected", "actual", status.alias("status"))


def load_verified(spark: SparkSession, registry: str, version: str | None = None):
    """Raise on any mismatch, then return (manifest row, verification rows)."""
    if version is None:
        version = latest_version(spark, registry).first()["latest"]
    checks = verify(spark, registry, version)
    bad = checks.where(F.col("status") != "ok").count()
    if bad:
        raise ValueError(f"Checksum mismatch in {bad} artifact file(s) of version {version}")
    return manifest_frame(spark, registry, version).first(), checks


def load_bundle(spark: SparkSession, registry: str, version: str | None = None) -> ScoringBundle:
    """The verified version as a bundle that scores (I1-I5); raises on any mismatch."""
    from pyspark.ml.util import DefaultParamsReader

    manifest, checks = load_verified(spark, registry, version)
    store, vdir = Storage(spark), f"{registry}/{manifest['version']}"
    document = lambda name: json.loads(store.read_text(f"{vdir}/{name}"))
    files = {r["file"] for r in checks.select("file").collect()}  # one row per artifact
    served = document("threshold.json")
    median = served["total_charges_median"]
    scorer = document("scorer.json") if "scorer.json" in files else None
    model = (DefaultParamsReader.loadParamsInstance(f"{vdir}/model", spark)
             if any(f.startswith("model/") for f in files) else None)
    return ScoringBundle(
        params=PrepParams(**document("prep_params.json")),
        scorer=None if scorer is None else LinearScorer(scorer["intercept"], scorer["weights"]), ml_model=model,
        threshold=served["threshold"],
        total_charges_median=C.TOTAL_CHARGES_MEDIAN_FALLBACK if median is None else median)


def model_info(spark: SparkSession, registry: str, version: str) -> DataFrame:
    """Model information record."""
    return manifest_frame(spark, registry, version).select(
        "model_name", "version", "created_at", "model_class", "model_params", "threshold", "n_features",
        F.size("checksums").alias("n_artifacts"), F.to_json("environment").alias("environment"),
        F.to_json("checksums").alias("checksums"))
