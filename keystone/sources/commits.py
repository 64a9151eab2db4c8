"""Atomic commits for folders of Parquet files: numbered manifests, published by a rename.

Data is written to folders of its own first and counts only once a manifest names
it. Manifest ``n`` of a root is the file ``_commits/<n>.json``: the folders of each
table and the ids of the batches that have been applied. It is written aside and
renamed to its number, which fails if another writer took that number; the loser
reads the new state and tries again. Readers take the highest number, so they see
a whole commit or none of it, and a writer that dies leaves only unnamed folders.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

FOLDER = "_commits"


def _fs(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(conf), jvm, conf


def _number(spark: SparkSession, root: str) -> int:
    p, fs, _, _ = _fs(spark, f"{root}/{FOLDER}")
    if not fs.exists(p):
        return 0
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return max([0, *(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())])


def read(spark: SparkSession, root: str) -> dict:
    """The last commit: {"tables": {name: [folder, ...]}, "batches": [id, ...]}; empty before the first."""
    n = _number(spark, root)
    if not n:
        return {"tables": {}, "batches": []}
    p, fs, jvm, _ = _fs(spark, f"{root}/{FOLDER}/{n:012d}.json")
    stream = fs.open(p)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, root: str, change: Callable[[dict], dict | None], tries: int = 100) -> bool:
    """Publish ``change(state)`` as the next manifest; None changes nothing (False). Retried on conflicts."""
    for _ in range(tries):
        n = _number(spark, root)
        state = change(read(spark, root))
        if state is None:
            return False
        aside, fs, jvm, conf = _fs(spark, f"{root}/{FOLDER}/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        place = jvm.org.apache.hadoop.fs.Path(f"{root}/{FOLDER}/{n + 1:012d}.json")
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(aside, place, options)
            return True
        except Exception as e:      # another writer has the number, or the store failed
            fs.delete(aside, False)
            if "FileAlreadyExists" not in str(e):
                raise
    raise RuntimeError(f"no commit to {root} in {tries} tries")


def folder(root: str, table: str) -> str:
    """A new folder for the data of one write."""
    return f"{root}/{table}/{uuid.uuid4().hex}"
