"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import re
import tempfile
import weakref

from pyspark.sql import SparkSession

_CHECKPOINTING: weakref.WeakSet = weakref.WeakSet()

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "keystone", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE and skew-join handling on.

    On a cluster ``master`` stays ``None`` so the launcher decides; tests pass
    ``local[N]``. ``spark.sql.shuffle.partitions`` should be sized to the data
    (≈ input bytes / 128 MB); AQE coalesces small ones at run time.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only a session in local mode, where the
    driver runs every task, gets a private folder when it is unset.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="keystone-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    context = spark.sparkContext
    if context not in _CHECKPOINTING:        # setting it again would make another sub-folder
        context.setCheckpointDir(d)
        _CHECKPOINTING.add(context)
    return d


#: Bytes of input files for each partition of a shuffle whose tasks hold sums or hash tables of its rows.
PARTITION_BYTES = 8 << 20


def input_bytes(df) -> int:
    """Bytes of the files that ``df`` reads; a frame that reads none has none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)          # rows of unknown size are said to be more than that


def partitions_for(df) -> int:
    """Shuffle partitions for the rows of ``df``: as the session says, or more, so that a task's share doesn't grow with the input."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // PARTITION_BYTES))


def materialize(df, name: str = "frame"):
    """Cut lineage with a reliable checkpoint in the shared ``spark.checkpoint.dir``.

    Used at the entity-grain boundary of a report: several branches (ranks,
    benchmarks, scalars) then share one computation of the upstream shuffles,
    an executor loss re-reads checkpoint files instead of re-running them, and
    ``count()`` on the result is cheap. ``name`` only labels the call site.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
