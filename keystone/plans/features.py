"""M1-M4: feature jobs for the cost-overrun and maintenance models.

All set-based: one aggregate per entity (M1, M2, M4) or one range-window pass
per machine (M3) — no per-entity Python loop, no N+1 queries.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystone.functions.exprs import days_between, dbl, dec_sum, ratio_or, rnd, safe_div
from keystone.session import partitions_for

AS_OF = _dt.date(2026, 2, 17)
EARLY_PHASE_SHARE = 0.25


def _early_cutoff(start: Column, planned_days: Column) -> Column:
    """Last day of the early phase: start + max(trunc(25 % of planned days), 1)."""
    early = (planned_days * EARLY_PHASE_SHARE).cast("int")        # CAST truncates
    return F.date_add(start, F.greatest(early, F.lit(1)))


def _cost_sums(costs: DataFrame, projects: DataFrame, cutoff: Column, by_project: bool = False) -> DataFrame:
    """J8 + M1: per project total and early-phase (date <= cutoff) actual/budget.

    Costs are first summed per (project, day) — a partial aggregate that also
    bounds any hot project to one row per day — then joined to the projects and
    split by the cutoff in one conditional aggregate (no theta join). A task holds
    its share of the cutoffs; the days are not sorted. Tables beyond what the session's
    partitions should hold are dealt to more of them, so that shares stay as they are
    (``by_project``: they are already, by the project).
    """
    parts = partitions_for(costs)
    more = parts > int(costs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if more and not by_project:
        costs = costs.repartition(parts, "project_id", "date_id")
    daily = costs.groupBy("project_id", "date_id").agg(
        dec_sum("amount", 4).alias("d_a"), dec_sum("budgeted_amount", 4).alias("d_b"))
    p = projects.select(F.col("id").alias("pid"), cutoff.alias("cutoff"))
    if more:
        daily, p = daily if by_project else daily.repartition(parts, "project_id"), p.repartition(parts, "pid")
    p = p.hint("shuffle_hash")
    j = daily.join(p, daily.project_id == p.pid)
    early = F.col("date_id") <= F.col("cutoff")
    zero = F.lit(0).cast("decimal(38,4)")
    return j.groupBy("project_id").agg(
        F.coalesce(F.sum("d_a"), zero).alias("ta"),
        F.coalesce(F.sum("d_b"), zero).alias("tb"),
        F.coalesce(F.sum(F.when(early, F.col("d_a"))), zero).alias("ea"),
        F.coalesce(F.sum(F.when(early, F.col("d_b"))), zero).alias("eb"))


def early_cpi(ea: Column, eb: Column) -> Column:
    """M1: early budget / early actual, 1.0 when there is no early actual (4 dp)."""
    return rnd(ratio_or(eb, ea, 1.0), 4)


def cost_overrun_dataset(star: dict[str, DataFrame]) -> DataFrame:
    """M2: one row per COMPLETED project with all four dates and a non-zero budget.

    Label ``will_overrun`` = final variance % > 10 (unrounded). Costs dated before
    the actual start count toward the early phase (upper bound only).
    """
    p = star["dim_projects"].where(
        (F.col("status") == "COMPLETED") & F.col("actual_start_date").isNotNull()
        & F.col("actual_end_date").isNotNull() & F.col("planned_start_date").isNotNull()
        & F.col("planned_end_date").isNotNull())
    planned = days_between("planned_end_date", "planned_start_date")
    sums = _cost_sums(star["fact_project_costs"], p,
                      _early_cutoff(F.col("actual_start_date"), planned))
    var = safe_div(dbl(F.col("ta") - F.col("tb")) * 100.0, "tb")
    out = p.join(sums, p.id == sums.project_id).where(F.col("tb") != 0)
    return out.select(
        "project_id", "project_type", "contract_value",
        F.greatest(planned, F.lit(1)).cast("long").alias("planned_duration"),
        F.coalesce("square_footage", F.lit(0.0)).alias("square_footage"),
        early_cpi(F.col("ea"), F.col("eb")).alias("early_phase_cpi"),
        rnd(var, 2).alias("variance_pct"),
        F.when(var > 10.0, 1).otherwise(0).cast("long").alias("will_overrun"))


#: Ids that are sent to all executors to filter a fact with; larger sets are joined.
BROADCAST_IDS = 100_000


def many_ids(ids: DataFrame | list[int] | None) -> bool:
    """Whether a frame of ids is too large to be sent to all executors; it is counted up to the bound."""
    return isinstance(ids, DataFrame) and ids.select("id").distinct().limit(BROADCAST_IDS + 1).count() > BROADCAST_IDS


def only_ids(df: DataFrame, key: str, ids: DataFrame | list[int] | None, many: bool | None = None) -> DataFrame:
    """F8: the rows whose ``key`` is among ``ids``, before anything is summed.

    A list becomes a filter that reaches the scan. A frame (column ``id``) is
    counted up to a bound first: within it, the fact is filtered where it is read, by
    a broadcast semi join; beyond it, by a shuffled one, in which a task holds its share
    of the ids and rows already lie by ``key`` for the sums that follow. ``many`` tells
    which, where the caller has asked ``many_ids``.
    """
    if ids is None:
        return df
    if not isinstance(ids, DataFrame):
        return df.where(F.col(key).isin(list(ids)))
    wanted = ids.select(F.col("id").alias("_id")).distinct()
    if many_ids(ids) if many is None else many:
        df, wanted = df.repartition(partitions_for(df), key), wanted.hint("shuffle_hash")
    else:
        wanted = F.broadcast(wanted)
    return df.join(wanted, df[key] == wanted["_id"], "left_semi")


def project_scoring_features(star: dict[str, DataFrame], ids: DataFrame | list[int] | None = None,
                             costed: bool = False) -> DataFrame:
    """M13 features for any project (optionally only ``ids``: a list, or a frame with ``id``).

    A missing planned end counts as start + 365 days; no costs or no actual
    start gives early CPI 1.0. Projects without a planned start cannot be
    scored and are left out (the single-entity form raises for them). ``costed`` keeps
    started projects that have costs.
    """
    many = many_ids(ids)
    p = only_ids(star["dim_projects"], "id", ids, many).where(F.col("planned_start_date").isNotNull())
    end = F.coalesce(F.col("planned_end_date"), F.date_add("planned_start_date", 365))
    planned = days_between(end, "planned_start_date")
    sums = _cost_sums(only_ids(star["fact_project_costs"], "project_id", ids, many), p.where(F.col("actual_start_date").isNotNull()),
                      _early_cutoff(F.col("actual_start_date"), planned), by_project=many)
    out = p.join(sums, p.id == sums.project_id, "inner" if costed else "left")
    return out.select(
        F.col("id").alias("project_id"), "project_name", "project_type", "status",
        "contract_value",
        F.greatest(planned, F.lit(1)).cast("long").alias("planned_duration"),
        F.coalesce("square_footage", F.lit(0.0)).alias("square_footage"),
        F.when(F.col("project_id").isNull(), F.lit(1.0))
         .otherwise(early_cpi(F.col("ea"), F.col("eb"))).alias("early_phase_cpi"))


# ---------------------------------------------------------------------------
# Maintenance features
# ---------------------------------------------------------------------------
#: Days before and after a snapshot at which its windows begin or end.
RECENT_DAYS, OLDER_DAYS = 90, 180


def _piece(day: Column, offsets: list[int]) -> Column:
    """First day of the stretch of days that a date belongs to: no window that is some
    ``offsets`` away from the start of any month begins or ends inside a stretch.

    For each offset, the latest month start that lies no later than the date when
    shifted by it; so a month falls into about as many stretches as there are offsets.
    """
    return F.greatest(*[F.date_add(F.trunc(F.date_sub(day, o), "month"), o) for o in offsets])


#: Measures of a stretch that snapshots add up.
STRETCH = ["h", "f", "ms", "mn", "rows", "last_maint"]


def usage_by_stretch(usage: DataFrame, start: Column) -> DataFrame:
    """Usage per (machine, stretch of days): hours, fuel, positive maintenance sum / count
    and its last day, rows, first and last day. A machine that holds a large share of all usage has a
    few rows for each month before any window sees it."""
    m = F.coalesce(F.col("maintenance_cost"), F.lit(0))
    return usage.groupBy("equipment_id", start.alias("from_day")).agg(
        dec_sum("hours_used", 4).alias("h"),
        dec_sum(F.coalesce(F.col("fuel_cost"), F.lit(0)), 4).alias("f"),
        dec_sum(F.when(m > 0, m).otherwise(F.lit(0)), 4).alias("ms"),
        F.count(F.when(m > 0, 1)).alias("mn"),
        F.max(F.when(m > 0, F.col("date_id"))).alias("last_maint"),
        F.count(F.lit(1)).alias("rows"), F.min("date_id").alias("first_day"), F.max("date_id").alias("last_day"))


def _maintenance_features(age: Column, hours: Column, fuel: Column, recent: Column,
                          older: Column, m_count: Column, m_sum: Column,
                          since_last: Column) -> list[Column]:
    hours, fuel, m_sum = dbl(hours), dbl(fuel), dbl(m_sum)
    return [
        age.cast("long").alias("age_days"),
        rnd(hours, 1).alias("total_hours_used"),
        rnd(dbl(hours) / dbl(age), 3).alias("avg_hours_per_day"),
        rnd(F.when(hours > 0, fuel / hours).otherwise(F.lit(0.0)), 4).alias("fuel_cost_per_hour"),
        rnd(F.least(ratio_or(recent, older, 1.0), F.lit(10.0)), 4).alias("recent_fuel_cost_trend"),
        m_count.cast("long").alias("maintenance_event_count"),
        F.when(m_count > 0, since_last).otherwise(age).cast("long").alias("days_since_maintenance"),
        rnd(F.when(m_count > 0, m_sum / m_count).otherwise(F.lit(0.0)), 2)
        .alias("avg_maint_cost_per_event"),
    ]


MAINTENANCE_FEATURES = ["equipment_type_enc", "age_days", "total_hours_used",
                        "avg_hours_per_day", "fuel_cost_per_hour", "recent_fuel_cost_trend",
                        "maintenance_event_count", "days_since_maintenance",
                        "avg_maint_cost_per_event"]
COST_FEATURES = ["project_type_enc", "contract_value", "planned_duration", "square_footage",
                 "early_phase_cpi"]


def maintenance_snapshots(star: dict[str, DataFrame], min_rows: int = 5,
                          lead_months: int = 2, horizon_days: int = 30) -> DataFrame:
    """M3: one row per (machine, month-start snapshot) with history features and
    the target "maintenance in the next 30 days".

    Machines need a purchase date and ≥ ``min_rows`` usage rows; snapshots are
    the month starts in [first use + 2 months, last use − 30 days]. All windows of
    a snapshot (history, last 90 days, the 90 before, next 30) begin or end a fixed
    number of days from a month start, so usage is read once and summed to the
    stretches of days between such borders. They tell a machine's span; its snapshots are
    unfolded in the partition that holds it, and the windows are ranges of days over both.
    """
    usage = star["fact_equipment_usage"]
    borders = sorted({0, -RECENT_DAYS, -OLDER_DAYS, horizon_days})
    sums = usage_by_stretch(usage, _piece(F.col("date_id"), borders))
    parts = int(usage.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = Window.partitionBy("equipment_id").orderBy("from_day")           # a few stretches for each month of use
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    u = sums.repartition(parts, "equipment_id").select(
        "*", F.sum("rows").over(whole).alias("n"), F.min("first_day").over(whole).alias("first_use"),
        F.max("last_day").over(whole).alias("last_use"), F.row_number().over(own).alias("place")).where(F.col("n") >= min_rows)
    e = star["dim_equipment"].where(F.col("purchase_date").isNotNull()).groupBy(F.col("id").alias("eid")).agg(
        F.collect_set(F.struct("equipment_type", "purchase_date")).alias("machine"))       # one, unless an id comes twice
    start = F.add_months("first_use", lead_months)
    first_snap = F.when(F.dayofmonth(start) == 1, start).otherwise(F.add_months(F.trunc(start, "month"), 1))
    last_snap = F.date_sub("last_use", horizon_days)
    # a NULL for the stretch itself; a machine's snapshots stand behind its first one
    rows = F.when((F.col("place") == 1) & (F.col("s0") <= F.col("s1")), F.concat(
        F.array(F.lit(None).cast("date")), F.sequence("s0", "s1", F.expr("INTERVAL 1 MONTH")))) \
        .otherwise(F.array(F.lit(None).cast("date")))
    run = u.select("*", first_snap.alias("s0"), last_snap.alias("s1")) \
        .join(e.hint("shuffle_hash"), F.col("equipment_id") == F.col("eid")) \
        .select("equipment_id", "machine", "from_day", *STRETCH, F.explode(rows).alias("snap")) \
        .select("equipment_id", "machine", "snap", F.unix_date(F.coalesce("snap", "from_day")).alias("day"),
                *[F.when(F.col("snap").isNull(), F.col(c)).alias(c) for c in STRETCH])

    days = Window.partitionBy("equipment_id").orderBy("day")
    before = days.rangeBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    over = lambda c, a, z: F.coalesce(F.sum(c).over(days.rangeBetween(a, z)), zero)                  # noqa: E731
    f = run.select("equipment_id", "machine", "snap",
                   *[(F.max if c == "last_maint" else F.sum)(c).over(before).alias(c) for c in STRETCH],
                   over("f", -RECENT_DAYS, -1).alias("recent"), over("f", -OLDER_DAYS, -RECENT_DAYS - 1).alias("older"),
                   over("mn", 0, horizon_days - 1).alias("future_events")).where("snap IS NOT NULL AND rows > 0") \
        .select("*", F.inline("machine"))

    snap = F.col("snap")
    age = F.greatest(F.datediff(snap, "purchase_date"), F.lit(1))
    return f.select(
        "equipment_id", snap.alias("snapshot_date"), "equipment_type",
        *_maintenance_features(age, F.col("h"), F.col("f"), F.col("recent"), F.col("older"),
                               F.col("mn"), F.col("ms"), F.datediff(snap, "last_maint")),
        F.when(F.col("future_events") > 0, 1).otherwise(0).cast("long")
        .alias("needs_maintenance_soon"))


def maintenance_scoring_features(star: dict[str, DataFrame], as_of: _dt.date = AS_OF,
                                 ids: DataFrame | list[int] | None = None) -> DataFrame:
    """M4: features of every machine as of ``as_of`` from usage dated before it.

    One conditional aggregate per machine (partial aggregation absorbs hot
    machines). Machines without usage get the defaults and ``has_usage`` = 0
    (the scorer then uses type code 0 for them).
    """
    asof = F.lit(as_of)
    many = many_ids(ids)
    usage = only_ids(star["fact_equipment_usage"], "equipment_id", ids, many).where(F.col("date_id") < asof)
    m = F.coalesce(F.col("maintenance_cost"), F.lit(0))
    fuel = F.coalesce(F.col("fuel_cost"), F.lit(0))
    d = F.datediff(asof, "date_id")                      # days before as_of (≥ 1)
    agg = usage.groupBy("equipment_id").agg(             # one sum per machine, made before the shuffle
        dec_sum("hours_used", 4).alias("hours"), dec_sum(fuel, 4).alias("fuel"),
        dec_sum(F.when(d <= RECENT_DAYS, fuel).otherwise(F.lit(0)), 4).alias("recent"),
        dec_sum(F.when((d > RECENT_DAYS) & (d <= OLDER_DAYS), fuel).otherwise(F.lit(0)), 4).alias("older"),
        F.count(F.when(m > 0, 1)).alias("m_count"), dec_sum(F.when(m > 0, m).otherwise(F.lit(0)), 4).alias("m_sum"),
        F.min(F.when(m > 0, d)).alias("since_last"))
    e = only_ids(star["dim_equipment"], "id", ids, many)
    j = e.join(agg, e.id == agg.equipment_id, "left")
    # NULL purchase dates stay NULL up to the fill of missing features (greatest() would make them 1).
    age = F.when(F.col("purchase_date").isNotNull(), F.greatest(F.datediff(asof, "purchase_date"), F.lit(1)))
    return j.select(
        F.col("id").alias("equipment_id"), "equipment_name", "equipment_type", "status",
        F.when(F.col("equipment_id").isNull(), 0).otherwise(1).cast("long").alias("has_usage"),
        *_maintenance_features(age, F.coalesce("hours", F.lit(0.0)),
                               F.coalesce("fuel", F.lit(0.0)),
                               F.coalesce("recent", F.lit(0.0)), F.coalesce("older", F.lit(0.0)),
                               F.coalesce("m_count", F.lit(0)), F.coalesce("m_sum", F.lit(0.0)),
                               F.col("since_last")))
