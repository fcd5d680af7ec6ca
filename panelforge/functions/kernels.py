"""Window kernels of the panel: rows of one code by date, rows of one date, groups of one date."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-12


def by_code():
    return Window.partitionBy("code").orderBy("date")


def by_date():
    return Window.partitionBy("date")


def by_sector():
    return Window.partitionBy("date", "sector")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def frame(first: int, last: int, w: WindowSpec | None = None) -> WindowSpec:
    return (w or by_code()).rowsBetween(first, last)


def _enough(value: Column, x: Column, least: int, over: WindowSpec) -> Column:
    return F.when(F.count(x).over(over) >= least, value)


def roll(f, x: Column | str, n: int, least: int | None = None, w: WindowSpec | None = None) -> Column:
    """f over the last n rows, null with fewer than least (n) values."""
    over, x = frame(-(n - 1), 0, w), col(x)
    return _enough(f(x).over(over), x, n if least is None else least, over)


def lroll(f, x: Column | str, n: int, least: int | None = None, w: WindowSpec | None = None) -> Column:
    """f over the n rows before the current one."""
    over, x = frame(-n, -1, w), col(x)
    return _enough(f(x).over(over), x, n if least is None else least, over)


def lag(x: Column | str, n: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lag(col(x), n).over(w or by_code())


def lead(x: Column | str, n: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lead(col(x), n).over(w or by_code())


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(col(a), col(b))


def ret(x: Column | str, n: int = 1) -> Column:
    return col(x) / (lag(x, n) + EPS) - 1


def zscore(x: Column | str, n: int, least: int, eps: float = 1e-8, left: bool = False) -> Column:
    f = lroll if left else roll
    return (col(x) - f(F.avg, x, n, least)) / (f(F.stddev_samp, x, n, least) + eps)


def clip(x: Column | str, low: float, high: float) -> Column:
    """Null stays null."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def _rising(x: Column, keys: tuple[str, ...]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(x.asc_nulls_last())


def average_rank(x: Column | str, *keys: str) -> Column:
    """Rank by rising x with ties at their mean; null for null. Ties are counted in the order of the rank, so that one sort serves both."""
    x = col(x)
    w = _rising(x, keys)
    tied = F.count(x).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), F.rank().over(w) + (tied - 1) / 2)


def rank01(x: Column | str, *keys: str) -> Column:
    """Average rank to 0..1; 0.5 for the only value."""
    n = F.count(col(x)).over(_rising(col(x), keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    r = average_rank(x, *keys)
    return F.when(r.isNotNull() & (n == 1), F.lit(0.5)).otherwise((r - 1) / F.nullif(n - 1, F.lit(0)))


def correlation(x: Column | str, y: Column | str, over: WindowSpec | None = None) -> Column:
    """Correlation of the rows that have both; null where a side does not vary (corr() itself fails there)."""
    x, y = col(x), col(y)
    px, py = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    parts = [F.covar_pop(px, py), F.stddev_pop(px), F.stddev_pop(py)]
    cov, sx, sy = (p.over(over) for p in parts) if over is not None else parts
    return F.when((sx > 1e-12) & (sy > 1e-12), F.try_divide(cov, sx * sy))


def normal_cdf(x: Column | str) -> Column:
    """Normal distribution function by a rational approximation (error below 1e-7)."""
    x = col(x)
    t = 1 / (1 + 0.2316419 * F.abs(x))
    # Coefficients of the approximation.
    a = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4]))))
    return F.when(x >= 0, 1 - tail).otherwise(tail)
