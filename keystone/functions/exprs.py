"""Column-expression helpers shared by every report.

All helpers return JVM-side ``Column`` expressions (whole-stage codegen, no
Python UDF). Numeric conventions:

* money and hours are summed as DECIMAL (exact, so results do not depend on
  partitioning or row order) and cast to DOUBLE once before any ratio;
* ``rnd`` rounds half away from zero on the double value, one expression that
  behaves identically in every SQL engine;
* every ratio is zero-guarded (``x / NULLIF(y, 0)``): Spark runs in ANSI mode
  and would otherwise raise on division by zero.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c) -> Column:
    return col(c).cast("double")


def rnd(c, n: int = 0) -> Column:
    """ROUND(x, n) half away from zero: sign(x) * floor(|x|·10ⁿ + 0.5) / 10ⁿ.

    From |x|·10ⁿ = 2⁵³ on a double has no such digits to round: x is returned.
    """
    x = dbl(c)
    p = float(10 ** n)
    return F.when(F.abs(x) * p >= 2.0 ** 53, x).otherwise(
        F.signum(x) * F.floor(F.abs(x) * p + 0.5).cast("double") / p)


def nullif0(c) -> Column:
    """NULLIF(x, 0)."""
    return F.nullif(col(c), F.lit(0))


def safe_div(a, b) -> Column:
    """A / NULLIF(b, 0) in double arithmetic (NULL on zero or NULL divisor)."""
    return dbl(a) / nullif0(dbl(b))


def ratio_or(a, b, default: float = 1.0) -> Column:
    """A / b when b > 0 else ``default``."""
    return F.when(dbl(b) > 0, dbl(a) / dbl(b)).otherwise(F.lit(default))


def dec(x: str) -> Column:
    """An exact decimal literal (so money comparisons stay exact)."""
    return F.lit(Decimal(x))


def days_between(end, start) -> Column:
    """Whole days end - start (julianday difference truncated)."""
    return F.datediff(col(end), col(start))


def month_key(d) -> Column:
    """E7: 'YYYY-MM' month key of a date."""
    return F.date_format(col(d), "yyyy-MM")


def clamp(c, lo=None, hi=None) -> Column:
    """Bound a value to [lo, hi]."""
    x = col(c)
    if lo is not None:
        x = F.greatest(x, F.lit(lo))
    if hi is not None:
        x = F.least(x, F.lit(hi))
    return x


def label_case(value, branches: list[tuple[Column, str]], default: str) -> Column:
    """Searched CASE returning a label (first true branch wins)."""
    out = None
    for cond, label in branches:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default)


def flag(cond: Column) -> Column:
    """1/0 flag with NULL treated as false."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def yes_no(cond: Column) -> Column:
    return F.when(cond, F.lit("Yes")).otherwise(F.lit("No"))


def money_label(c) -> Column:
    """E16: '$1.2M' / '$12K' / '$7', NULL → '—'."""
    x = dbl(c)
    return (F.when(x.isNull(), F.lit("—"))
            .when(F.abs(x) >= 1e6, F.format_string("$%.1fM", x / 1e6))
            .when(F.abs(x) >= 1e3, F.format_string("$%.0fK", x / 1e3))
            .otherwise(F.format_string("$%.0f", x)))


def title_case(c) -> Column:
    """E15: 'ON_HOLD' → 'On Hold'."""
    return F.initcap(F.lower(F.regexp_replace(col(c), "_", " ")))


def percent_label(p) -> Column:
    """Probability as a whole percent, '73%'."""
    return F.concat(F.format_string("%.0f", dbl(p) * 100.0), F.lit("%"))


def dec_sum(c, scale: int) -> Column:
    """Exact SUM of money or hours as DECIMAL: the input is taken as DECIMAL(28, scale)
    (other types are cast, which rounds), the sum has ten more digits. NULLs skipped."""
    return F.sum(col(c).cast(f"decimal(28,{scale})"))
