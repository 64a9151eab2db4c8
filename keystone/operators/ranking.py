"""Ranks, tie neighbours and best-per-group without single-task windows.

``RANK() OVER (ORDER BY x)`` with no (or a low-cardinality) partition key puts
every row into one task. Here the same answers come from the *distinct values*
of the key, in one lazy plan and in one way at every size:

1. ``GROUP BY parts, key``: a hot value (one key holding a third of all rows)
   collapses to one row with a count, so skew never reaches a window;
2. a quantile sketch of the key gives bucket bounds; a value's bucket is the number
   of bounds that it reaches, a comparison with a constant array;
3. a window partitioned by (parts, bucket) counts and finds neighbours inside
   each bucket, and bucket totals (a row for each part and bucket it has) give
   the offsets and the neighbours across bucket ends.

Bounds only balance the buckets: the ranks are exact whatever they are. The
input is a shared relation of the statement (it holds a non-deterministic column,
which Spark plans once and never inlines), so that its scans and joins run once
for the sketch, the values and the rows, with no job before the caller's own.

rank = 1 + rows strictly before; ``LAG``/``LEAD`` with an id tie-break follow
from the previous/next distinct value and the min/max id of each tie group;
the ``ROW_NUMBER() = 1`` row is the smallest id of the first tie group.

Ordering follows Spark's defaults: ascending puts NULLs first, descending puts
them last (in both cases NULL sorts as the smallest value). A NULL partition
key is a part like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MAX_BUCKETS = 256


@dataclass
class Ordering:
    """One window ordering to attach: ORDER BY key [DESC] (, tie) PARTITION BY parts."""
    key: str
    parts: Sequence[str] = ()
    descending: bool = False
    tie: str | None = None
    rank: str | None = None           # RANK()
    lead: str | None = None           # LEAD(key) with tie ASC as last sort key
    lag: str | None = None            # LAG(key)  with tie ASC as last sort key
    first: str | None = None          # ROW_NUMBER() = 1 with tie ASC as last sort key
    buckets: int | None = None


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _place(column: str, kind: T.DataType) -> str:
    """SQL for a number (or date) that never falls when the key rises: what the sketch can take."""
    if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return column
    if isinstance(kind, T.BooleanType):
        return f"cast({column} AS int)"
    if isinstance(kind, T.StringType):       # the first seven bytes as a number
        return f"cast(conv(rpad(substring(hex(encode({column}, 'UTF-8')), 1, 14), 14, '0'), 16, 10) AS bigint)"
    raise TypeError(f"no order for {kind.simpleString()} keys")


def _stats_sql(df: DataFrame, o: Ordering, i: int) -> list[str]:
    """Relations b, v, p, t, o and s of ordering ``i`` over ``base``.

    ``s`` has one row per distinct (parts, key): ``_n`` rows holding the value,
    ``_before`` rows strictly before it in the order, ``_prev`` / ``_next`` distinct
    values (NULL at the ends), ``_tmin`` / ``_tmax`` smallest / largest tie value.
    """
    n = max(1, min(MAX_BUCKETS, int(o.buckets or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    key, kind = _q(o.key), df.schema[o.key].dataType
    way = "DESC" if o.descending else "ASC"
    ties = f", min({_q(o.tie)}) AS _tmin, max({_q(o.tie)}) AS _tmax" if o.tie else ", NULL AS _tmin, NULL AS _tmax"
    parts = "".join(f"{_q(p)} AS _part{j}, " for j, p in enumerate(o.parts))
    names = "".join(f"_part{j}, " for j in range(len(o.parts)))
    of_p = "".join(f"p._part{j}, " for j in range(len(o.parts)))
    same = "".join(f" AND p._part{j} <=> o._part{j}" for j in range(len(o.parts)))
    group = ", ".join(str(j + 1) for j in range(len(o.parts) + 1))
    shares = ", ".join(repr(j / n) for j in range(1, n))
    if shares:
        sketch = f"b{i} AS (SELECT percentile_approx({_place(key, kind)}, array({shares})) AS bounds FROM base)"
        reached = f"size(filter(_bounds, bound -> bound <= {_place('_k', kind)}))"
    else:
        sketch, reached = f"b{i} AS (SELECT 1 AS bounds)", "0"
    # NULL is the smallest value: a bucket of its own below all others
    bucket = f"CASE WHEN _k IS NULL THEN -1 ELSE coalesce({reached}, 0) END"
    inside = f"PARTITION BY {of_p}p._bk ORDER BY p._k {way}"
    across = f"{'PARTITION BY ' + names[:-2] if names else ''} ORDER BY _bk {way}"
    low, high = ("_hi", "_lo") if o.descending else ("_lo", "_hi")
    return [
        sketch,
        f"v{i} AS (SELECT {parts}{key} AS _k, count(1) AS _n{ties} FROM base GROUP BY {group})",
        f"p{i} AS (SELECT {names}_k, _n, _tmin, _tmax, {bucket} AS _bk FROM (SELECT *, (SELECT bounds FROM b{i}) AS _bounds FROM v{i}))",
        f"t{i} AS (SELECT {names}_bk, sum(_n) AS _bn, min(_k) AS _lo, max(_k) AS _hi FROM p{i} GROUP BY {names}_bk)",
        f"o{i} AS (SELECT {names}_bk, coalesce(sum(_bn) OVER ({across} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _off, "
        f"lag({high}) OVER ({across}) AS _pb, lead({low}) OVER ({across}) AS _nb FROM t{i})",
        # the neighbour of the outermost rows is in the next bucket; inside, lag and lead of a lone flag tell
        f"s{i} AS (SELECT {of_p}p._k, p._n, p._tmin, p._tmax, "
        f"cast(o._off + coalesce(sum(p._n) OVER ({inside} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS _before, "
        f"CASE WHEN lag(true) OVER ({inside}) THEN lag(p._k) OVER ({inside}) ELSE o._pb END AS _prev, "
        f"CASE WHEN lead(true) OVER ({inside}) THEN lead(p._k) OVER ({inside}) ELSE o._nb END AS _next "
        f"FROM p{i} p JOIN o{i} o ON p._bk = o._bk{same})"]


def _statement(df: DataFrame, relations: list[str], select: str) -> DataFrame:
    base = "base AS (SELECT *, rand(0) AS _once FROM {df})"
    return df.sparkSession.sql(f"WITH {', '.join([base, *relations])} {select}", df=df)


def ordinal_stats(df: DataFrame, key: str, parts: Sequence[str] = (),
                  descending: bool = False, tie: str | None = None,
                  buckets: int | None = None) -> DataFrame:
    """One row per distinct (parts, key) with ``_n``, ``_before``, ``_prev``, ``_next``
    and, with a ``tie``, ``_tmin`` and ``_tmax`` (see ``_stats_sql``)."""
    o = Ordering(key, parts, descending, tie, buckets=buckets)
    names = [f"_part{j} AS {_q(p)}" for j, p in enumerate(parts)]
    columns = [*names, f"_k AS {_q(key)}", "_n", "_before", "_prev", "_next", *(["_tmin", "_tmax"] if tie else [])]
    return _statement(df, _stats_sql(df, o, 0), f"SELECT {', '.join(columns)} FROM s0")


def with_orderings(df: DataFrame, *orderings: Ordering, groups: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Attach RANK / LEAD / LAG / first-row columns of several orderings of the same frame.

    ``groups`` maps a column to aggregates in SQL ({name: expression}) over the rows
    that share its value, attached side by side; rows where it is NULL get none and
    are left out.
    """
    relations, joins, columns = [], [], [f"base.{_q(c)}" for c in df.columns]
    for i, o in enumerate(orderings):
        relations += _stats_sql(df, o, i)
        same = "".join(f" AND base.{_q(p)} <=> s{i}._part{j}" for j, p in enumerate(o.parts))
        joins.append(f"JOIN s{i} ON base.{_q(o.key)} <=> s{i}._k{same}")
        key, tie = f"base.{_q(o.key)}", f"base.{_q(o.tie)}" if o.tie else None
        if o.rank:
            columns.append(f"s{i}._before + 1 AS {_q(o.rank)}")
        if o.lag:
            columns.append(f"CASE WHEN {tie} > s{i}._tmin THEN {key} ELSE s{i}._prev END AS {_q(o.lag)}")
        if o.lead:
            columns.append(f"CASE WHEN {tie} < s{i}._tmax THEN {key} ELSE s{i}._next END AS {_q(o.lead)}")
        if o.first:
            columns.append(f"coalesce(s{i}._before = 0 AND {tie} = s{i}._tmin, false) AS {_q(o.first)}")
    for i, (c, aggregates) in enumerate((groups or {}).items()):
        made = ", ".join(f"{e} AS {_q(name)}" for name, e in aggregates.items())
        relations.append(f"g{i} AS (SELECT {_q(c)}, {made} FROM base GROUP BY {_q(c)})")
        joins.append(f"JOIN g{i} ON base.{_q(c)} = g{i}.{_q(c)}")
        columns += [f"g{i}.{_q(name)}" for name in aggregates]
    return _statement(df, relations, f"SELECT {', '.join(columns)} FROM base {' '.join(joins)}")


def with_first_flag(df: DataFrame, key: str, tie: str, name: str,
                    parts: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY parts ORDER BY key [DESC], tie) = 1``."""
    return with_orderings(df, Ordering(key, parts, descending, tie, first=name))
