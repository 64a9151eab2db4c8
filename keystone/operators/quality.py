"""Q1-Q4: data-quality jobs re-aimed from the declarative ORM constraints.

Each check returns a violations / counts table; nothing is collected. Fact
columns are reduced to their distinct values (with counts) before any join,
so a hot key costs one row, not a third of the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystone.sources.schema import ENUM_COLUMNS, FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def enum_violations(star: dict[str, DataFrame]) -> DataFrame:
    """Q1: (table_name, column_name, value, n) for values outside the enum domain."""
    by_table: dict[str, list[tuple[str, list]]] = {}
    for (table, column), domain in ENUM_COLUMNS.items():
        by_table.setdefault(table, []).append((column, list(domain)))
    frames = []
    for table, columns in by_table.items():      # one scan a table: its columns become rows, only bad values stay
        bad = F.array(*[F.when(F.col(c).isNotNull() & ~F.col(c).isin(*d),
                               F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")))
                        for c, d in columns])
        frames.append(star[table].select(F.explode(F.array_compact(bad)).alias("v"))
                      .select(F.lit(table).alias("table_name"), "v.column_name", "v.value"))
    return _union(frames).groupBy("table_name", "column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def foreign_key_orphans(star: dict[str, DataFrame]) -> DataFrame:
    """Rows whose non-NULL foreign key has no parent row, one row per
    foreign key.

    One pass per fact: its key columns are exploded into (column, ref, key)
    rows and reduced to distinct keys with counts (a hot key costs one row);
    then a single join against the union of all parent keys.
    """
    keys = []
    for fact, fks in FOREIGN_KEYS.items():
        pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(d).alias("ref_table"),
                                   F.col(c).cast("long").alias("k")) for c, d, _ in fks])
        keys.append(star[fact].select(F.explode(pairs).alias("p"))
                    .select(F.lit(fact).alias("table_name"), "p.*")
                    .where(F.col("k").isNotNull())
                    .groupBy("table_name", "column_name", "ref_table", "k")
                    .agg(F.count(F.lit(1)).alias("n")))
    used = _union(keys)
    refs = {(d, dc) for fks in FOREIGN_KEYS.values() for _, d, dc in fks}
    parents = _union([star[d].select(F.lit(d).alias("ref_table"), F.col(dc).cast("long").alias("k"))
                      for d, dc in sorted(refs)]).distinct()
    # Left join + NULL test instead of a left-anti join: Catalyst pushes an
    # anti join through the union into every fact branch (re-building the parent
    # keys each time); an outer join keeps one join over the union.
    orphans = used.join(parents.withColumn("_parent", F.lit(True)), ["ref_table", "k"], "left") \
        .where(F.col("_parent").isNull()) \
        .groupBy("table_name", "column_name", "ref_table") \
        .agg(F.count(F.lit(1)).alias("orphan_keys"), F.sum("n").cast("long").alias("orphan_rows"))
    every = used.sparkSession.createDataFrame(              # the declared keys (schema-sized)
        [(f, c, d) for f, fks in FOREIGN_KEYS.items() for c, d, _ in fks],
        "table_name string, column_name string, ref_table string")
    return every.join(orphans, ["table_name", "column_name", "ref_table"], "left").select(
        "table_name", "column_name", "ref_table",
        F.coalesce("orphan_keys", F.lit(0)).cast("long").alias("orphan_keys"),
        F.coalesce("orphan_rows", F.lit(0)).cast("long").alias("orphan_rows"))


def not_null_violations(star: dict[str, DataFrame]) -> DataFrame:
    """Q3: NULL count of every declared NOT NULL column (one aggregate per table)."""
    frames = []
    for table, schema in SCHEMAS.items():
        cols = [f.name for f in schema.fields if not f.nullable and f.name in star[table].columns]
        if not cols:
            continue
        agg = star[table].agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
        frames.append(agg.unpivot([], cols, "column_name", "nulls")
                      .select(F.lit(table).alias("table_name"), "column_name",
                              F.col("nulls").cast("long").alias("nulls")))
    return _union(frames)


def primary_key_duplicates(star: dict[str, DataFrame]) -> DataFrame:
    """Q4: keys that occur more than once (count of such keys and their rows)."""
    frames = []
    for table, key in PRIMARY_KEYS.items():
        dup = star[table].groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        frames.append(dup.agg(F.count(F.lit(1)).alias("duplicate_keys"),
                              F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("duplicate_rows"))
                      .select(F.lit(table).alias("table_name"),
                              F.lit(",".join(key)).alias("key_columns"),
                              "duplicate_keys", "duplicate_rows"))
    return _union(frames)
