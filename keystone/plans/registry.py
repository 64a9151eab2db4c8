"""Train-once / load-many access to the two models for batch jobs.

A trained artifact is saved under the shared checkpoint folder, keyed by the
input location and the forest parameters; later jobs (scoring, reports) load
it instead of retraining — the Spark form of "train, persist, then score".
"""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession

from keystone.plans import models as MD
from keystone.session import ensure_checkpoint_dir
from keystone.sources.star import BASE_TABLES, load_star

_MEMO: dict[tuple[str, str], MD.Artifact] = {}


def data_version(spark: SparkSession, sf_dir: str) -> list[tuple[str, int, int]]:
    """(table, bytes, time of the last change) of the tables the star is derived from."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for t in BASE_TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            files = fs.listStatus(path)
            out.append((t, sum(f.getLen() for f in files), max([0, *(f.getModificationTime() for f in files)])))
    return out


def model_path(spark: SparkSession, sf_dir: str, kind: str, **params) -> str:
    """Key: input location and its version, model kind, parameters, package version
    and the feature lists, so that changed data or code never loads a stale model."""
    from keystone import __version__
    from keystone.plans.features import COST_FEATURES, MAINTENANCE_FEATURES
    key = hashlib.sha1(repr((sf_dir, data_version(spark, sf_dir), kind, sorted(params.items()), __version__,
                             COST_FEATURES, MAINTENANCE_FEATURES)).encode())
    return f"{ensure_checkpoint_dir(spark)}/keystone-models/{kind}-{key.hexdigest()[:16]}"


def get_model(spark: SparkSession, sf_dir: str, kind: str, **params) -> MD.Artifact:
    """``kind`` is ``"cost"`` (M11) or ``"maintenance"``."""
    path = model_path(spark, sf_dir, kind, **params)
    memo = spark.sparkContext.applicationId, path          # frames of an ended session can't be read
    if memo in _MEMO:
        return _MEMO[memo]
    try:
        art = MD.load_artifact(spark, path)
    except FileNotFoundError:
        star = load_star(spark, sf_dir)
        train = MD.train_cost_overrun_model if kind == "cost" else MD.train_equipment_maintenance_model
        art = train(star, **params)
        MD.save_artifact(art, path)
        art = MD.load_artifact(spark, path)
    _MEMO[memo] = art
    return art
