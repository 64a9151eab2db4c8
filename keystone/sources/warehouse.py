"""Warehouse sources and sinks on Parquet.

Each write puts its rows into a new Parquet folder, and counts when a commit names
it (``commits``): a failed write or truncate leaves the tables as they were, and a
batch that is appended again under its id adds nothing. Writes go through Spark's
partitioned writers (no batched driver inserts); facts are written sorted by
``date_id`` so Parquet min/max statistics let date-window filters skip row
groups. All paths are on shared storage (never a machine-local folder).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystone.sources import commits
from keystone.sources.schema import DIMENSIONS, FACTS, SCHEMAS, TABLES


def run_sql(spark: SparkSession, sql: str, params: dict | None = None,
            **tables: DataFrame) -> DataFrame:
    """Parameterised SQL. ``:name`` markers bind ``params``; ``{name}``
    placeholders bind DataFrames (no global temp views)."""
    return spark.sql(sql, args=params or None, **tables)


def load_warehouse(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Open a stored star as of its last commit (lazy scans; pruning and pushdown are free).

    Every declared table must be there; numbers stored in other types are cast to
    the declared ones, and a column that is absent or can't be is an error.
    """
    tables = commits.read(spark, root)["tables"]
    if missing := [t for t in TABLES if t not in tables]:
        raise FileNotFoundError(f"no such tables in {root}: {', '.join(missing)}")
    return {t: stored_table(spark, tables[t], t) for t in TABLES}


def stored_table(spark: SparkSession, folders: list[str], table: str) -> DataFrame:
    """The rows of the folders that a commit names; none of them is an empty table."""
    if not folders:
        return spark.createDataFrame([], SCHEMAS[table])
    parts = [declared(spark.read.parquet(f), table) for f in folders]
    same = all(p.schema == parts[0].schema for p in parts)
    if same:                                        # one scan of all folders
        return declared(spark.read.parquet(*folders), table)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def declared(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the declared columns in their declared types; further columns stay as they are."""
    fields = SCHEMAS[table].fields
    if absent := [f.name for f in fields if f.name not in df.columns]:
        raise ValueError(f"{table} lacks columns: {', '.join(absent)}")
    return df.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in fields if df.schema[f.name].dataType != f.dataType})


def _write(df: DataFrame, path: str, table: str) -> None:
    """Facts are range-partitioned on (``date_id``, a hash of the row's id): files cover
    date ranges, so date-window scans skip whole files and row groups, and one
    busy day spreads over several files. The number of files is that of
    shuffle partitions, which is set to the size of the data."""
    if table in FACTS and "date_id" in df.columns:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread = F.xxhash64("id") if "id" in df.columns else F.xxhash64(*df.columns)
        df = df.withColumn("_spread", spread).repartitionByRange(n, "date_id", "_spread") \
            .sortWithinPartitions("date_id").drop("_spread")
    df.write.parquet(path)


def save_star(star: dict[str, DataFrame], root: str, mode: str = "overwrite",
              tables: list[str] | None = None, batch: str | None = None) -> bool:
    """Write tables and publish them in one commit (``overwrite`` replaces,
    ``append`` adds rows, ``ignore`` keeps what exists: load-if-absent).

    ``batch`` names the write: once it has been applied, writing it again changes
    nothing and gives False.
    """
    if mode not in ("overwrite", "append", "ignore"):
        raise ValueError(f"no such mode: {mode}")
    names = list(tables or TABLES)
    spark = star[names[0]].sparkSession
    batch = batch or uuid.uuid4().hex
    state = commits.read(spark, root)
    if batch in state["batches"]:
        return False
    if mode == "ignore":
        names = [t for t in names if t not in state["tables"]]
    made = {t: commits.folder(root, t) for t in names}
    for t, path in made.items():
        _write(star[t], path, t)

    def change(now: dict) -> dict | None:
        if batch in now["batches"]:
            return None
        for t, path in made.items():
            if mode == "append":
                now["tables"][t] = [*now["tables"].get(t, []), path]
            elif mode == "overwrite" or t not in now["tables"]:
                now["tables"][t] = [path]
        now["batches"].append(batch)
        return now
    return commits.commit(spark, root, change)


def init_warehouse(spark: SparkSession, root: str) -> None:
    """Create the declared tables that do not exist yet, empty, in one commit."""
    def change(now: dict) -> dict | None:
        absent = [t for t in TABLES if t not in now["tables"]]
        now["tables"].update({t: [] for t in absent})
        return now if absent else None
    commits.commit(spark, root, change)


def append(df: DataFrame, root: str, table: str, batch: str | None = None) -> bool:
    """Append rows to one table; the same ``batch`` again adds nothing (False)."""
    return save_star({table: df}, root, "append", [table], batch)


def clear_facts(spark: SparkSession, root: str) -> None:
    """Truncate all fact tables in one commit, keep the dimensions."""
    def change(now: dict) -> dict:
        now["tables"].update({t: [] for t in FACTS})
        return now
    commits.commit(spark, root, change)


def load_summary(star: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) for every table; a missing one is an error.

    A stored table is counted from the footers of its files: no column is read."""
    frames = [star[t].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
              for t in TABLES]
    return reduce(lambda a, b: a.unionByName(b), frames)


def preview(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows in a stated order (a limit is the feature here)."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


__all__ = ["run_sql", "load_warehouse", "save_star", "init_warehouse", "append", "clear_facts",
           "load_summary", "preview", "stored_table", "DIMENSIONS", "FACTS"]
