"""Training, persistence and set-based scoring of the two forests.

* M5 label encoder: alphabetical index of the training labels; unseen → 0. The
  label domain is an enum (≤ 8 values), so the fitted labels are kept as a
  literal map expression (P7) — no join.
* M6 exact stratified 75/25 split: per class, the first round(25 %·n_class)
  rows in ``xxhash64(id, seed)`` order form the test set; the last hash among
  them is found by counting ranges of hashes, without ranking rows.
* M7 balanced class weights n / (k·n_class) as ``weightCol``.
* M8 ``pyspark.ml`` RandomForestClassifier (distributed tree induction), or beyond
  ``SPARK_ROWS`` training rows the same learner over binned rows (``plans/forest.py``).
* M13/M14 score whole sets in one ``transform`` (load the model once), instead
  of one query and one model load per entity.
"""

from __future__ import annotations

import datetime as _dt
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystone.functions.exprs import col, percent_label, rnd, safe_div, title_case
from keystone.operators.ranking import ordinal_stats
from keystone.plans import features as FE
from keystone.plans import forest
from keystone.plans.metrics import binary_metrics, class_balance, metrics_table
from keystone.session import materialize
from keystone.sources import commits


# ---------------------------------------------------------------------------
# Advice texts and thresholds of the two scorers.
# ---------------------------------------------------------------------------
COST_ADVICE_HIGH = ("High overrun risk. Immediately review budget allocations, enforce "
                    "strict change-order controls, and consider value-engineering options.")
COST_ADVICE_MODERATE = ("Moderate overrun risk. Monitor cost categories weekly, activate "
                        "contingency reserves, and flag any scope creep early.")
COST_ADVICE_LOW = ("Low overrun risk. Maintain current cost controls and continue "
                   "regular budget reviews through project completion.")
MAINT_ADVICE_HIGH = ("High maintenance probability ({probability}). Schedule a full service within {days} days. "
                     "Inspect hydraulics, engine hours, and investigate recent fuel-cost increases.")
MAINT_ADVICE_MODERATE = ("Moderate maintenance probability ({probability}). Plan a preventive inspection within "
                         "{days} days and monitor fuel efficiency.")
MAINT_ADVICE_LOW = ("Low maintenance probability ({probability}). Continue standard monitoring. Next routine check "
                    "recommended in approximately {days} days.")
COST_THRESHOLDS = (0.70, 0.45)
MAINT_THRESHOLDS = (0.70, 0.40)


# ---------------------------------------------------------------------------
# M5 label encoder
# ---------------------------------------------------------------------------
def fit_label_encoder(df: DataFrame, c: str) -> DataFrame:
    """(label, index): distinct labels with their place in alphabetical order."""
    labels = df.select(F.col(c).alias("label")).where("label is not null").distinct()
    return ordinal_stats(labels, "label").select("label", F.col("_before").alias("index"))


def encode(df: DataFrame, c: str, labels: DataFrame, name: str) -> DataFrame:
    """Add the code of each label; unseen or NULL → 0."""
    codes = labels.select(F.col("label").alias("_label"), F.col("index").alias("_index"))
    return df.join(codes, df[c] == codes["_label"], "left") \
        .withColumn(name, F.coalesce("_index", F.lit(0)).cast("long")).drop("_label", "_index")


# ---------------------------------------------------------------------------
# M6 / M7 split and weights
# ---------------------------------------------------------------------------
#: Bits of the hash that one look at the data tells apart.
_BITS = 16


def _hash_quantiles(df: DataFrame, group: str, quota: Callable[[int], int]) -> dict:
    """Per group, the least ``_h`` that ``quota(rows)`` rows do not exceed (None for no rows).

    Counts per group and leading bits of the hash tell in which of 65536 ranges
    the sought one lies; the next look counts the next bits inside that range alone.
    At most four looks; nothing is ranked or sorted.
    """
    found: dict = {}
    open_: dict = {}
    for shift in range(64 - _BITS, -1, -_BITS):
        rows = df
        if open_ or found:
            inside = [F.col(group).eqNullSafe(F.lit(g)) & (F.shiftright("_h", shift + _BITS) == prefix) for g, (prefix, _) in open_.items()]
            if not inside:
                break
            rows = df.where(reduce(lambda a, b: a | b, inside))
        counts = rows.groupBy(group, F.shiftright("_h", shift).alias("range")).count().collect()     # 65536 rows a group at most
        for g in {r[0] for r in counts}:
            ranges = sorted((r["range"], r["count"]) for r in counts if r[0] == g)
            if g not in open_:
                wanted = quota(sum(n for _, n in ranges))
                if wanted == 0:
                    found[g] = None
                    continue
                open_[g] = (0, wanted)
            wanted = open_[g][1]
            for at, n in ranges:
                if wanted <= n:
                    break
                wanted -= n
            open_[g] = (at, wanted)
            if wanted == n or shift == 0:             # up to the end of the range
                found[g] = ((at + 1) << shift) - 1
                del open_[g]
    return found


def stratified_split(df: DataFrame, label: str, id_cols: list[str], test_fraction: float = 0.25,
                     seed: int = 42) -> DataFrame:
    """Add ``is_test``: per class the first round(test_fraction·n_class) rows by a
    seeded hash of the id columns. Without two classes of ≥ 2 rows the split is
    not stratified (first ceil(test_fraction·n) rows overall).

    Classes are few (a label); ``df`` is computed once, and its copy is read three times, or
    more if hashes collide in 16 and more leading bits."""
    hashed = materialize(df.withColumn("_h", F.xxhash64(*[F.col(c) for c in id_cols], F.lit(seed))), "split")
    counts = {r[0]: r[1] for r in hashed.groupBy(label).count().collect()}
    if len(counts) > 1 and min(counts.values()) >= 2:
        last = _hash_quantiles(hashed, label, lambda n: int(math.floor(test_fraction * n + 0.5)))
        cuts = [F.col(label).eqNullSafe(F.lit(g)) & (F.col("_h") <= F.lit(h)) for g, h in last.items() if h is not None]
    else:
        last = _hash_quantiles(hashed.withColumn("_all", F.lit(0)), "_all", lambda n: int(math.ceil(test_fraction * n)))
        cuts = [F.col("_h") <= F.lit(h) for h in last.values() if h is not None]
    return hashed.withColumn("is_test", reduce(lambda a, b: a | b, cuts, F.lit(False))).drop("_h")


def class_weights(counts: dict) -> dict:
    """n / (k · n_class) per class (k = number of classes present)."""
    n, k = sum(counts.values()), len(counts)
    return {c: n / (k * nc) for c, nc in counts.items()}


def balanced_weights(train: DataFrame, label: str) -> Column:
    """The weight of its class per row."""
    weights = class_weights({r[0]: r[1] for r in train.groupBy(label).count().collect()})
    m = F.create_map(*[x for c, w in weights.items() for x in (F.lit(c), F.lit(w))])
    return m[F.col(label)]


# ---------------------------------------------------------------------------
# Model artifact, training, persistence
# ---------------------------------------------------------------------------
@dataclass
class Artifact:
    model: RandomForestClassificationModel | forest.Forest
    labels: DataFrame                 # encoder classes: label, index
    features: list[str]
    category: str                     # raw categorical column that is encoded
    train_metrics: DataFrame
    test_metrics: DataFrame
    feature_importance: DataFrame
    balance: DataFrame

    def metrics(self) -> DataFrame:
        """M20."""
        return metrics_table(self.train_metrics, self.test_metrics)

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with score and prediction."""
        if isinstance(self.model, forest.Forest):
            return self.model.score(_filled(df, self.features), self.features)
        return _scored(self.model, _assemble(df, self.features))


@dataclass
class Rule:
    """A scorer without a forest: its probability is an expression over the features.

    It stands where a trained model does, so that populations, bands, advice and
    feature columns of M13-M18 can be checked exactly.
    """
    probability: Column
    labels: DataFrame
    features: list[str]

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with score and prediction; a tie is class 0, as in a forest."""
        return _filled(df, self.features).withColumn("score", self.probability) \
            .withColumn("prediction", (F.col("score") > 0.5).cast("long"))


def _filled(df: DataFrame, feats: list[str]) -> DataFrame:
    """missing, NaN and infinite features become 0."""
    clean = [F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
                    | (F.abs(F.col(c).cast("double")) == float("inf")), 0.0)
             .otherwise(F.col(c).cast("double")).alias(c) for c in feats]
    return df.select(*[c for c in df.columns if c not in feats], *clean)


def _assemble(df: DataFrame, feats: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=feats, outputCol="features").transform(_filled(df, feats))


def _scored(model, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out.withColumn("score", vector_to_array("probability")[1]) \
              .withColumn("prediction", F.col("prediction").cast("long"))


def feature_importance(spark: SparkSession, model, feats: list[str]) -> DataFrame:
    """Importances (sum to 1), 4 dp, largest first."""
    imp = model.featureImportances.toArray().tolist()          # one value per feature
    rows = [(f, float(round(v, 4))) for f, v in zip(feats, imp)]
    return spark.createDataFrame(rows, "feature string, importance double") \
        .orderBy(F.col("importance").desc(), "feature")


#: Training rows of one partition. Each partition sends the sums of all open nodes of all
#: trees at every level, so that beyond some partitions more of them cost more than they save.
TRAIN_ROWS, TRAIN_PARTS, MOST_TRAIN_ROWS = 20_000, 12, 300_000

#: Training rows up to which Spark's own forest is grown. Beyond, its passes over rows times trees take
#: minutes, and the forest is grown from counts of binned rows, with bootstrap samples of its own.
SPARK_ROWS = 200_000


def training_partitions(rows: int) -> int:
    """By the rows alone, so that the forest is the same on any cluster."""
    return max(1, min(math.ceil(rows / TRAIN_ROWS), TRAIN_PARTS), math.ceil(rows / MOST_TRAIN_ROWS))


def _side_by_side(spark: SparkSession, calls: list[Callable]) -> list:
    """What the calls return, their jobs run together; the first error is raised when all have ended."""
    with ThreadPoolExecutor(len(calls)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(call)) for call in calls]]


def train_forest(data: DataFrame, label: str, id_cols: list[str], category: str, enc_name: str,
                 feats: list[str], num_trees: int, max_depth: int, min_leaf: int,
                 seed: int = 42, test_fraction: float = 0.25) -> Artifact:
    """M5 → M6 → M7 → M8 → M9 → M10 (shared by M11 and M12)."""
    spark = data.sparkSession
    data = materialize(data, "train-data")
    if data.isEmpty():
        raise ValueError(f"no rows to train {label} on")
    labels = fit_label_encoder(data, category)
    data = encode(data, category, labels, enc_name)
    split = stratified_split(data, label, id_cols, test_fraction, seed)
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    # By a hash of the ids into a number of partitions that follows the rows, so that
    # bootstrap samples are the same on any cluster and for any session settings.
    rows = sum(counts.values())
    n = training_partitions(rows)
    if rows > SPARK_ROWS and set(counts) <= {0, 1}:
        model = forest.fit(_filled(train, feats), label, feats, id_cols, class_weights(counts), num_trees, max_depth, min_leaf, n, seed)
        xtr, xte = (_filled(x.select(label, *id_cols, *feats), feats).repartition(n, *id_cols) for x in (train, test))
        scored = lambda x: model.score(x, feats)                   # noqa: E731
    else:
        train = train.withColumn("weight", balanced_weights(train, label))
        rf = RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="weight",
                                    numTrees=num_trees, maxDepth=max_depth,
                                    minInstancesPerNode=min_leaf, seed=seed,
                                    featureSubsetStrategy="sqrt", maxMemoryInMB=1024,
                                    cacheNodeIds=True, checkpointInterval=-1)   # a level each: too few to write rows times trees out
        xtr = materialize(_assemble(train, feats).repartition(n, *id_cols).sortWithinPartitions(*id_cols), "train-x")
        xte = _assemble(test, feats).repartition(n, *id_cols)
        model = rf.fit(xtr)
        scored = lambda x: _scored(model, x)                       # noqa: E731

    def metrics(rows: DataFrame) -> DataFrame:
        return materialize(binary_metrics(scored(rows), label), "metrics")

    # each is one pass over rows times trees and then small jobs that leave cores idle
    train_metrics, test_metrics = _side_by_side(spark, [lambda: metrics(xtr), lambda: metrics(xte)])
    return Artifact(model=model, labels=labels, features=feats, category=category,
                    train_metrics=train_metrics, test_metrics=test_metrics,
                    feature_importance=feature_importance(spark, model, feats),
                    balance=class_balance(data, label))


def train_cost_overrun_model(star: dict[str, DataFrame], num_trees: int = 200,
                             max_depth: int = 8, min_leaf: int = 2) -> Artifact:
    """M11."""
    ds = FE.cost_overrun_dataset(star)
    return train_forest(ds, "will_overrun", ["project_id"], "project_type", "project_type_enc",
                        FE.COST_FEATURES, num_trees, max_depth, min_leaf)


def train_equipment_maintenance_model(star: dict[str, DataFrame], num_trees: int = 200,
                                      max_depth: int = 10, min_leaf: int = 3) -> Artifact:
    """M12."""
    ds = FE.maintenance_snapshots(star)
    return train_forest(ds, "needs_maintenance_soon", ["equipment_id", "snapshot_date"],
                        "equipment_type", "equipment_type_enc", FE.MAINTENANCE_FEATURES,
                        num_trees, max_depth, min_leaf)


def save_artifact(a: Artifact, path: str) -> None:
    """A new version of the model (model directory + Parquet side tables, all
    written by Spark), published by one commit; readers of an older one go on reading it."""
    spark = a.train_metrics.sparkSession
    to = commits.folder(path, "versions")
    meta = spark.createDataFrame(
        [("feature", i, v) for i, v in enumerate(a.features)]
        + [("category", 0, a.category), ("learner", 0, type(a.model).__name__)], "kind string, pos long, value string")
    tables = {"meta": meta, "labels": a.labels, "train_metrics": a.train_metrics, "test_metrics": a.test_metrics,
              "feature_importance": a.feature_importance, "balance": a.balance}
    _side_by_side(spark, [lambda: a.model.save(f"{to}/model"),
                          *[lambda name=name, df=df: df.write.parquet(f"{to}/{name}") for name, df in tables.items()]])
    commits.commit(spark, path, lambda now: {"tables": {"model": [to]}, "batches": []})


def load_artifact(spark: SparkSession, path: str) -> Artifact:
    """The last version that was published; FileNotFoundError when the model has not been trained."""
    versions = commits.read(spark, path)["tables"].get("model")
    if not versions:
        raise FileNotFoundError(f"Model not found: {path}. Train it first.")
    at = versions[-1]
    meta = spark.read.parquet(f"{at}/meta").collect()     # a row for each feature and label
    pick = lambda k: [r.value for r in sorted((r for r in meta if r.kind == k),
                                              key=lambda r: r.pos)]
    rd = lambda n: spark.read.parquet(f"{at}/{n}")     # noqa: E731
    learner = forest.Forest if pick("learner") == ["Forest"] else RandomForestClassificationModel
    model = learner.load(f"{at}/model")
    return Artifact(model=model, labels=rd("labels"), features=pick("feature"),
                    category=pick("category")[0], train_metrics=rd("train_metrics"),
                    test_metrics=rd("test_metrics"), feature_importance=rd("feature_importance"),
                    balance=rd("balance"))


# ---------------------------------------------------------------------------
# Scoring (M13-M18)
# ---------------------------------------------------------------------------
def score_projects(star: dict[str, DataFrame], a: Artifact | Rule, ids: DataFrame | list[int] | None = None,
                   costed: bool = False) -> DataFrame:
    """M13 for a set of projects (all when ``ids`` is None; ``costed``: those with a start and costs)."""
    f = FE.project_scoring_features(star, ids, costed)
    f = encode(f, "project_type", a.labels, "project_type_enc")
    s = a.score(f)
    p = F.col("score")
    hi, mid = COST_THRESHOLDS
    rec = (F.when(p >= hi, COST_ADVICE_HIGH).when(p >= mid, COST_ADVICE_MODERATE)
           .otherwise(COST_ADVICE_LOW))
    return s.select(
        "project_id", "project_name", "project_type", "status", "contract_value",
        F.round(p, 4).alias("overrun_probability"),
        F.when(F.col("prediction") == 1, "Will Overrun").otherwise("On Track").alias("prediction"),
        rec.alias("recommendation"),
        F.struct(*[F.col(c) for c in a.features]).alias("features"))


def score_equipment(star: dict[str, DataFrame], a: Artifact | Rule, as_of: _dt.date = FE.AS_OF,
                    ids: DataFrame | list[int] | None = None) -> DataFrame:
    """M14 for a set of machines; machines without usage get type code 0."""
    f = FE.maintenance_scoring_features(star, as_of, ids)
    f = encode(f, "equipment_type", a.labels, "equipment_type_enc").withColumn(
        "equipment_type_enc", F.when(F.col("has_usage") == 1, F.col("equipment_type_enc")).otherwise(F.lit(0).cast("long")))
    s = a.score(f)
    p = F.col("score")
    days = days_until_maintenance(p)
    pct = percent_label(p)
    hi, mid = MAINT_THRESHOLDS
    text = F.when(p >= hi, MAINT_ADVICE_HIGH).when(p >= mid, MAINT_ADVICE_MODERATE).otherwise(MAINT_ADVICE_LOW)
    rec = F.replace(F.replace(text, F.lit("{probability}"), pct), F.lit("{days}"), days.cast("string"))
    return s.select(
        "equipment_id", "equipment_name", "equipment_type", "status",
        F.round(p, 4).alias("maintenance_probability"),
        F.when(F.col("prediction") == 1, "Maintenance Needed")
         .otherwise("No Immediate Maintenance").alias("prediction"),
        days.alias("predicted_days_until_maintenance"),
        rec.alias("recommendation"),
        F.struct(*[F.col(c) for c in a.features]).alias("features"))


def project_risk_band(p) -> Column:
    """D20 / M15 bands: > 0.70 High, ≥ 0.30 Medium, else Low."""
    x = col(p)
    return F.when(x > 0.70, "High").when(x >= 0.30, "Medium").otherwise("Low")


def fleet_risk_band(p, days) -> Column:
    """D20 / M16 bands: Critical if p > 0.70 or < 7 days; Watch if p ≥ 0.50 or ≤ 14 days."""
    x, d = col(p), col(days)
    return (F.when((x > 0.70) | (d < 7), "Critical").when((x >= 0.50) | (d <= 14), "Watch")
            .otherwise("Routine"))


def portfolio_risk(star: dict[str, DataFrame], a: Artifact | Rule) -> DataFrame:
    """Started ACTIVE projects that have costs (J6), scored and banded."""
    p = star["dim_projects"].where((F.col("status") == "ACTIVE")
                                   & F.col("actual_start_date").isNotNull())
    s = score_projects(star, a, p.select("id"), costed=True)       # the sums of their costs tell which have any
    return s.select("project_id", "project_name", title_case("project_type").alias("type"),
                    "contract_value", "overrun_probability", "prediction",
                    project_risk_band("overrun_probability").alias("risk_level"),
                    "recommendation").orderBy("project_name", "project_id")


def fleet_risk(star: dict[str, DataFrame], a: Artifact | Rule, as_of: _dt.date = FE.AS_OF) -> DataFrame:
    """Non-retired machines, scored and banded."""
    e = star["dim_equipment"].where(F.col("status") != "RETIRED")
    s = score_equipment(star, a, as_of, e.select("id"))
    s = s.join(e.select(F.col("id").alias("equipment_id"), "purchase_date"), "equipment_id")
    return s.select(
        "equipment_id", "equipment_name", title_case("equipment_type").alias("type"),
        F.when(F.col("purchase_date").isNotNull(), F.greatest(F.datediff(F.lit(as_of), "purchase_date"), F.lit(0)))
        .cast("long").alias("age_days"),
        F.col("features.total_hours_used").alias("total_hours"),
        "maintenance_probability", F.col("predicted_days_until_maintenance").alias("est_days"),
        fleet_risk_band("maintenance_probability", "predicted_days_until_maintenance").alias("risk"),
        title_case("status").alias("status")).orderBy("equipment_name", "equipment_id")


def risk_kpis(risk: DataFrame, band: str, prob: str) -> DataFrame:
    """Number analysed and mean probability, over all (band ``All``) and per band."""
    return risk.rollup(band).agg(F.grouping(band).alias("_all"), F.count(F.lit(1)).alias("count"),
                                 F.round(F.avg(prob), 4).alias("avg_probability")) \
        .orderBy(F.col("_all").desc(), F.col("count").desc(), band) \
        .select(F.when(F.col("_all") == 1, F.lit("All")).otherwise(F.col(band)).alias(band), "count", "avg_probability")


def days_until_maintenance(p) -> Column:
    """30 days less the probability's share of them, at least one."""
    return F.greatest(F.lit(1), (F.lit(30.0) * (1.0 - col(p))).cast("int")).cast("long")


def days_band(days) -> Column:
    """Fewer than 7 days bad, up to 14 warning, else good."""
    d = col(days)
    return F.when(d < 7, "bad").when(d <= 14, "warning").otherwise("good")


def predict_project(star: dict[str, DataFrame], a: Artifact | Rule, project_id: int) -> DataFrame:
    """M13 for one project; an unknown id is a ValueError."""
    return score_projects(star, a, _known(star["dim_projects"], project_id, "project"))


def predict_machine(star: dict[str, DataFrame], a: Artifact | Rule, equipment_id: int,
                    as_of: _dt.date = FE.AS_OF) -> DataFrame:
    """M14 for one machine; an unknown id is a ValueError."""
    return score_equipment(star, a, as_of, _known(star["dim_equipment"], equipment_id, "machine"))


def _known(dim: DataFrame, key: int, what: str) -> list[int]:
    if dim.where(F.col("id") == key).isEmpty():
        raise ValueError(f"there is no {what} {key}")
    return [key]


def high_risk(risk: DataFrame, band: str, level: str) -> DataFrame:
    """The High / Critical sub-list."""
    return risk.where(F.col(band) == level)


# Display labels of the model features.
FEATURE_LABELS = {
    "project_type_enc": "Project Type", "contract_value": "Contract Value",
    "planned_duration": "Planned Duration", "square_footage": "Square Footage",
    "early_phase_cpi": "Early Phase CPI",
    "equipment_type_enc": "Equipment Type", "age_days": "Age (days)",
    "total_hours_used": "Total Hours", "avg_hours_per_day": "Avg Hrs/Day",
    "fuel_cost_per_hour": "Fuel Cost/Hour", "recent_fuel_cost_trend": "Fuel Cost Trend",
    "maintenance_event_count": "Past Maint. Events", "days_since_maintenance": "Days Since Maint.",
    "avg_maint_cost_per_event": "Avg Maint. Cost",
}


def feature_coverage(frame: DataFrame, feats: list[str]) -> DataFrame:
    """(feature, importance): the share of rows in which a feature has a value other than the filled-in 0, 4 dp."""
    filled = _filled(frame, feats)
    rows = filled.agg(F.count("*").alias("n"), *[F.count_if(F.col(c) != 0).alias(c) for c in feats])
    return rows.unpivot("n", feats, "feature", "rows").select("feature", rnd(safe_div(F.col("rows"), "n"), 4).alias("importance"))


def labelled_importance(importance: DataFrame) -> DataFrame:
    """Importances with display labels (unknown names kept)."""
    m = F.create_map(*[x for k, v in FEATURE_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return importance.select("feature", F.coalesce(m[F.col("feature")], F.col("feature"))
                             .alias("label"), "importance")
