"""Binary classification metrics, class balance, train/test table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystone.functions.exprs import dbl, rnd, safe_div
from keystone.session import materialize

METRIC_NAMES = ["accuracy", "precision", "recall", "f1", "roc_auc"]


def _counts(df: DataFrame, label: str, prediction: str, score: str) -> DataFrame:
    """(score, prediction, label) with its number of rows: one pass that all metrics share."""
    return df.groupBy(F.col(score).cast("double").alias("_s"), F.col(prediction).cast("long").alias("_p"),
                      F.col(label).cast("long").alias("_y")).agg(F.count(F.lit(1)).alias("_c"))


def _auc(counts: DataFrame) -> DataFrame:
    """One-row ROC-AUC by mid-ranks (Mann-Whitney U; tied scores count ½) from ``_counts``."""
    vc = counts.where(F.col("_s").isNotNull()).groupBy("_s").agg(
        F.sum("_c").alias("_m"), F.sum(F.col("_y") * F.col("_c")).alias("_pos"))
    b = int(vc.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(vc.repartitionByRange(max(b, 1), "_s").withColumn("_bk", F.spark_partition_id()), "auc-values")
    # one row for each range
    totals = placed.groupBy("_bk").agg(F.sum("_m").alias("_bm")).select(
        "_bk", F.coalesce(F.sum("_bm").over(Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)),
                          F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_bk").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_off") + F.coalesce(F.sum("_m").over(inside), F.lit(0))
    mid = before + (F.col("_m") + 1) / 2.0                     # mean 1-based rank of the tie group
    agg = placed.join(totals, "_bk").select("_pos", "_m", mid.alias("_mid")).agg(
        F.sum(F.col("_pos") * F.col("_mid")).alias("rs"), F.sum("_pos").alias("n1"), F.sum("_m").alias("n"))
    n1, n = dbl("n1"), dbl("n")
    n0 = n - n1
    u = F.col("rs") - n1 * (n1 + 1.0) / 2.0
    return agg.select(F.when((n1 > 0) & (n0 > 0), u / (n1 * n0)).alias("roc_auc"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One-row ROC-AUC; NULL when only one class is present."""
    return _auc(_counts(df, label, label, score))


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                   score: str | None = "score") -> DataFrame:
    """M9: accuracy, precision, recall, F1 (zero division → 0) and ROC-AUC, 4 dp,
    plus the confusion counts — all from one grouping of the input."""
    counts = _counts(df, label, prediction, score or prediction)
    if score is not None:
        counts = materialize(counts, "metric-counts")
    y, p = F.col("_y"), F.col("_p")

    def n_if(c):
        return F.coalesce(F.sum(F.when(c, F.col("_c")).otherwise(0)), F.lit(0)).cast("long")

    c = counts.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n"), n_if((y == 1) & (p == 1)).alias("tp"),
                   n_if((y == 0) & (p == 1)).alias("fp"), n_if((y == 1) & (p == 0)).alias("fn"),
                   n_if((y == 0) & (p == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    out = c.select(
        "n", "tp", "fp", "fn", "tn",
        rnd(F.coalesce(safe_div(tp + tn, "n"), zero), 4).alias("accuracy"),
        rnd(F.coalesce(safe_div(tp, tp + fp), zero), 4).alias("precision"),
        rnd(F.coalesce(safe_div(tp, tp + fn), zero), 4).alias("recall"),
        rnd(F.coalesce(safe_div(tp * 2, tp * 2 + fp + fn), zero), 4).alias("f1"))
    if score is None:
        return out.withColumn("roc_auc", F.lit(None).cast("double"))
    out = out.withColumn("_auc", _auc(counts).scalar())      # attached once
    return out.withColumn("roc_auc", rnd("_auc", 4)).drop("_auc")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Samples, positives, negatives and their shares (one aggregate)."""
    y = F.col(label).cast("long")
    c = df.agg(F.count(F.lit(1)).alias("samples"), F.sum(y).cast("long").alias("positives"))
    return c.select("samples", "positives", (F.col("samples") - F.col("positives")).alias("negatives"),
                    rnd(safe_div("positives", "samples"), 4).alias("positive_share"),
                    rnd(safe_div(F.col("samples") - F.col("positives"), "samples"), 4)
                    .alias("negative_share"))


def metrics_table(train: DataFrame, test: DataFrame) -> DataFrame:
    """(metric, train, test) rows from two one-row metric frames."""
    def long(df, name):
        return df.select(*METRIC_NAMES).unpivot([], METRIC_NAMES, "metric", name)
    return long(train, "train").join(long(test, "test"), "metric") \
        .orderBy(F.array_position(F.array(*[F.lit(m) for m in METRIC_NAMES]), F.col("metric")))
