"""Balances of long and short positions: levels, changes, scores, days of volume, and setups with the price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import EPS, lag, ratio, roll, zscore

BALANCES = ("net", "total", "credit", "imbalance", "short_long", "d_long", "d_short", "d_net", "d_credit", "z_long", "z_short", "z_total", "z_credit", "z_d_short", "total_mom")
SCALED = ("long_adv", "short_adv", "total_adv", "d_long_adv", "d_short_adv", "d_net_adv")


def balances(m: DataFrame, rows: int, momentum: int = 4) -> DataFrame:
    """m(code, date, lg, sh) with BALANCES: scores are over rows records of a code, total_mom against the mean of momentum ones.

    Ratios add 1 to what they divide by, so that an empty side gives a large finite value.
    """
    lg, sh = F.col("lg"), F.col("sh")
    m = m.withColumns({"net": lg - sh, "total": lg + sh, "credit": lg / (sh + 1), "imbalance": (lg - sh) / (lg + sh + EPS), "short_long": sh / (lg + 1)})
    m = m.withColumns({name: F.col(c) - lag(c) for name, c in (("d_long", "lg"), ("d_short", "sh"), ("d_net", "net"), ("d_credit", "credit"))})
    scores = {name: zscore(c, rows, rows) for name, c in (("z_long", "lg"), ("z_short", "sh"), ("z_total", "total"), ("z_credit", "credit"), ("z_d_short", "d_short"))}
    return m.withColumns(scores | {"total_mom": F.col("total") - roll(F.avg, "total", momentum)})


def scaled(m: DataFrame, adv: str = "adv20") -> DataFrame:
    """m (see balances) with SCALED: balances and their changes in days of the mean volume adv; null where that is 0 or unknown."""
    return m.withColumns({name: ratio(c, adv) for name, c in zip(SCALED, ("lg", "sh", "total", "d_long", "d_short", "d_net"), strict=True)})


def setups(df: DataFrame, crowded: Column, unwind: float = 1.5) -> DataFrame:
    """df(short_adv, z_long, d_net, r_1, r_3) with squeeze, unwinding and with_trend as 0 or 1; unknown values count as 0.

    A squeeze is a short balance above crowded that meets a rise, an unwinding a long balance of a score above unwind that meets a fall.
    Balances are compared with crowded to six places, as a quantile may be one of them up to an error of its interpolation.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return df.withColumns({
        "squeeze": F.coalesce((F.round("short_adv", 6) > F.round(crowded, 6)) & (zero("r_1") > 0), F.lit(False)).cast("int"),
        "unwinding": ((zero("z_long") > unwind) & (zero("r_1") < 0)).cast("int"),
        "with_trend": (F.signum(zero("d_net")) == F.signum(zero("r_3"))).cast("int"),
    })
