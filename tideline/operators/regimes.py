"""Regimes: volatility and activity terciles, funding windows, and contrasts between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FUNDING_HOURS, OTHER_HOURS = (0, 8, 16), (4, 12, 20)
HOUR_US = 3_600_000_000


def daily_variance(blocks: DataFrame) -> DataFrame:
    """(symbol, day, rv, n_blocks): squared block returns added up by day."""
    return blocks.groupBy("symbol", "day").agg(F.sum(F.col("r") * F.col("r")).alias("rv"), F.count(F.lit(1)).alias("n_blocks"))


def terciles(df: DataFrame, value: str, by: str = "symbol") -> DataFrame:
    """df with ``tercile``: 0 up to the 1/3 quantile, 1 up to the 2/3 quantile, else 2."""
    lim = df.groupBy(by).agg(F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("lim"))
    return df.join(lim, by).withColumn("tercile", F.when(F.col(value) <= F.col("lim")[0] + 1e-15, 0).when(F.col(value) <= F.col("lim")[1] + 1e-15, 1).otherwise(2)).drop("lim")


def hour_counts(bars: DataFrame) -> DataFrame:
    """(symbol, hour, trades): trades by hour of the day, summed over days."""
    return bars.groupBy("symbol", F.expr(f"m div {HOUR_US} % 24").alias("hour")).agg(F.sum("n").alias("trades"))


def funding_windows(bars: DataFrame, hours: tuple[int, ...] = FUNDING_HOURS, minutes: int = 5, offset: int = 30) -> DataFrame:
    """Bars of the last ``minutes`` before each hour given (pre_funding) and of as many, ``offset`` minutes earlier (control); bars without r are dropped.

    The day is the bar's own, so windows before midnight belong to the day that ends.
    """
    b = bars.withColumn("hour", F.expr(f"m div {HOUR_US} % 24")).withColumn("minute", F.expr("m div 60000000 % 60"))
    b = b.where(F.col("hour").isin([(h - 1) % 24 for h in hours]) & F.col("r").isNotNull())
    window = F.when(F.col("minute") >= 60 - minutes, "pre_funding").when((F.col("minute") >= 60 - offset - minutes) & (F.col("minute") < 60 - offset), "control")
    return b.withColumn("window", window).where("window is not null").withColumn("day", F.expr("m div 86400000000")).drop("minute")


def window_stats(tagged: DataFrame, by: tuple[str, ...] = ("symbol", "window")) -> DataFrame:
    """Counts, means, standard deviation of flow and slope of r on flow (null under three bars) of each window."""
    return tagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_minutes"), F.avg("ofi").alias("mean_ofi"), F.avg(F.abs("ofi")).alias("mean_abs_ofi"), F.stddev_samp("ofi").alias("sd_ofi"),
        F.avg("n").alias("mean_trades"), F.avg(F.abs("r")).alias("mean_abs_r"), F.when(F.count(F.lit(1)) > 2, F.regr_slope("r", F.col("ofi").cast("double"))).alias("slope"),
    )


def funding_replicates(tagged: DataFrame, days: DataFrame, picks: DataFrame) -> DataFrame:
    """(symbol, rep, window, mean_abs_ofi, mean_abs_r, slope) with days as the unit that is resampled.

    tagged bars are first reduced to sums by day and window. days: (symbol, day, i); picks: (rep, i, w) with the number of times w that day i is drawn.
    """
    d = lambda e: F.sum(F.expr(e).cast("double"))
    s = tagged.groupBy("symbol", "day", "window").agg(F.count(F.lit(1)).alias("n"), d("abs(ofi)").alias("ao"), d("abs(r)").alias("ar"), d("ofi").alias("x"), d("r").alias("y"), d("cast(ofi as double) * ofi").alias("xx"), d("ofi * r").alias("xy"))
    w = s.join(days, ["symbol", "day"]).join(picks, "i")
    t = w.groupBy("symbol", "rep", "window").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in ("n", "ao", "ar", "x", "y", "xx", "xy")])
    slope = F.try_divide(F.col("n") * F.col("xy") - F.col("x") * F.col("y"), F.col("n") * F.col("xx") - F.col("x") * F.col("x"))
    return t.select("symbol", "rep", "window", (F.col("ao") / F.col("n")).alias("mean_abs_ofi"), (F.col("ar") / F.col("n")).alias("mean_abs_r"), F.when(F.col("n") > 2, slope).alias("slope"))


def window_difference(reps: DataFrame) -> DataFrame:
    """(symbol, rep, d_mean_abs_ofi, d_mean_abs_r, d_slope): pre_funding minus control."""
    at = lambda c, w: F.max(F.when(F.col("window") == w, F.col(c)))
    return reps.groupBy("symbol", "rep").agg(*[(at(c, "pre_funding") - at(c, "control")).alias(f"d_{c}") for c in ("mean_abs_ofi", "mean_abs_r", "slope")])


def funding_ci(funding: DataFrame, other: DataFrame) -> DataFrame:
    """(symbol, side, quantity, mean, lo, hi) over replicates: the pre-window less the control at funding hours, at the others, and the difference of both (did)."""
    cols = ("d_mean_abs_ofi", "d_mean_abs_r", "d_slope")
    both = funding.join(other.select("symbol", "rep", *[F.col(c).alias(f"o_{c}") for c in cols]), ["symbol", "rep"])
    cells = F.array(*[F.struct(F.lit(side).alias("side"), F.lit(c[2:]).alias("quantity"), v.alias("v")) for c in cols for side, v in (("funding", F.col(c)), ("non_funding", F.col(f"o_{c}")), ("did", F.col(c) - F.col(f"o_{c}")))])
    x = both.select("symbol", F.explode(cells).alias("c")).select("symbol", "c.*")
    return x.groupBy("symbol", "side", "quantity").agg(F.avg("v").alias("mean"), F.percentile("v", F.lit(0.025)).alias("lo"), F.percentile("v", F.lit(0.975)).alias("hi"))


def day_index(bars: DataFrame) -> DataFrame:
    """(symbol, day, i): days in order, from 0."""
    return bars.select("symbol", F.expr("m div 86400000000").alias("day")).distinct().withColumn("i", (F.row_number().over(Window.partitionBy("symbol").orderBy("day")) - 1).cast("long"))
