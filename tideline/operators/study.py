"""The whole impact study: every scale of every symbol in one plan, its regimes, verdicts and comparisons.

Scales are told apart by a symbol of the form ``symbol|scale``, so every estimator runs on all of them at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators import blocks, curves, regimes

#: Fixed values of the study: base blocks to a window at each event scale, and the name of the clock scale.
SCALES = (1, 10, 100, 1000)
CLOCK = "1min"
#: Fixed names of the terciles.
VOLATILITY = ("vol_low", "vol_mid", "vol_high")
ACTIVITY = ("activity_low", "activity_mid", "activity_high")


def named(symbol: Column, scale: str) -> Column:
    return F.concat_ws("|", symbol, F.lit(scale))


def unnamed(df: DataFrame) -> DataFrame:
    """symbol|scale back as two columns."""
    parts = F.split("symbol", r"\|")
    return df.withColumn("scale", parts[1]).withColumn("symbol", parts[0]).select("symbol", "scale", *[c for c in df.columns if c != "symbol"])


def event_windows(base: DataFrame, scales: tuple[int, ...] = SCALES) -> DataFrame:
    """(symbol|scale, day, t, q, r, dt_s) of all event scales; dt_s carried over a day's last window."""
    parts = []
    for m in scales:
        x = base if m == 1 else blocks.derive_scale(base, m)
        parts.append(blocks.with_duration(x.select(named(F.col("symbol"), f"N={m * blocks.BLOCK}").alias("symbol"), "day", "t", "q", "r"), True))
    return reduce(DataFrame.unionByName, parts)


def clock_windows(bars: DataFrame) -> DataFrame:
    """(symbol|1min, day, t, q, r, dt_s) of minute bars with a response; no durations."""
    day = F.expr("date_add(date'1970-01-01', cast(m div 86400000000 as int))")
    return bars.where("r is not null").select(named(F.col("symbol"), CLOCK).alias("symbol"), day.alias("day"), F.col("m").alias("t"), F.col("ofi").alias("q"), "r", F.lit(None).cast("double").alias("dt_s"))


def scale_lengths(windows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(symbol|scale, block_length) from the lengths by symbol."""
    keys = windows.select("symbol").distinct().withColumn("_base", F.split("symbol", r"\|")[0])
    return keys.join(lengths.select(F.col("symbol").alias("_base"), "block_length"), "_base").drop("_base")


def regime_rings(base: DataFrame, bars: DataFrame, hours: int, t0_us: int) -> DataFrame:
    """(symbol, ring, i, h, k): the hours of each volatility tercile (by day) and activity tercile (by hour of the day)."""
    spine = base.select("symbol").distinct().select("symbol", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hours - 1).cast("long"))).alias("h"))
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), F.col("tercile") + 1)
    vol = regimes.terciles(regimes.daily_variance(base).withColumn("rv", F.round("rv", 12)), "rv").select("symbol", "day", pick(VOLATILITY).alias("ring"))
    first_day = F.expr(f"date_add(date'1970-01-01', cast({t0_us} div 86400000000 + h div 24 as int))")
    v = spine.withColumn("day", first_day).join(F.broadcast(vol), ["symbol", "day"]).select("symbol", "ring", "h")
    act = regimes.terciles(regimes.hour_counts(bars), "trades").select("symbol", F.col("hour").cast("long").alias("hour"), pick(ACTIVITY).alias("ring"))
    a = spine.withColumn("hour", F.expr(f"({t0_us} div 3600000000 + h) % 24")).join(F.broadcast(act), ["symbol", "hour"]).select("symbol", "ring", "h")
    return curves.rings_of(v.unionByName(a))


def scale_rings(rings: DataFrame, windows: DataFrame) -> DataFrame:
    """The rings of a symbol for each of its scales."""
    keys = windows.select("symbol").distinct().select(F.col("symbol").alias("_key"), F.split("symbol", r"\|")[0].alias("symbol"))
    return rings.join(F.broadcast(keys), "symbol").drop("symbol").withColumnRenamed("_key", "symbol")


def curves_with_bands(windows: DataFrame, c: DataFrame, replicates: DataFrame, probs: list[float] | None = None) -> DataFrame:
    """The table of curves: symbol, bin, n, mean_q, mean_r, ci_lo, ci_hi, sd_r, frac_zero_r, mean_duration_s, inside."""
    b = curves.binned(windows, probs).groupBy("symbol", "bin").agg(F.avg((F.col("r") == 0).cast("int")).alias("frac_zero_r"), F.avg("dt_s").alias("mean_duration_s"))
    bands = curves.ci_bands(replicates).withColumnsRenamed({"lo": "ci_lo", "hi": "ci_hi"})
    x = curves.interior(curves.curve(c), windows)
    return x.join(bands, ["symbol", "bin"], "left").join(b, ["symbol", "bin"], "left").select("symbol", "bin", "n", "mean_q", "mean_r", "ci_lo", "ci_hi", "sd_r", "frac_zero_r", "mean_duration_s", "inside")


def regime_stats(windows: DataFrame, c: DataFrame, rings: DataFrame, weights: DataFrame, bins: int) -> tuple[DataFrame, DataFrame]:
    """((symbol, ring, hours, windows, slope, slope_lo, slope_hi, amplitude), slopes of replicates). Rings without weights (too short) don't occur."""
    used = rings.join(F.broadcast(weights.select("symbol", "ring").distinct()), ["symbol", "ring"], "left_semi")
    lim = curves.limits(windows)
    rc = curves.ring_curve(c, used).join(F.broadcast(lim), "symbol").withColumn("inside", F.abs("mean_q").between(F.col("lim")[0], F.col("lim")[1])).drop("lim")
    each = curves.replicate_stats(curves.ring_replicates(c, weights), rc, bins)
    size = used.groupBy("symbol", "ring").agg(F.count(F.lit(1)).alias("hours"))
    total = rc.groupBy("symbol", "ring").agg(F.sum("n").alias("windows"), F.max(F.abs("mean_r")).alias("amplitude"))
    out = size.join(total, ["symbol", "ring"], "left").join(curves.central_slope(rc, ("symbol", "ring")), ["symbol", "ring"], "left").join(curves.interval(each, ("slope",), ("symbol", "ring")), ["symbol", "ring"], "left")
    return out.select("symbol", "ring", "hours", "windows", "slope", "slope_lo", "slope_hi", "amplitude"), each


def contrasts(stats: DataFrame, each: DataFrame) -> DataFrame:
    """(symbol, contrast, difference, lo, hi, verdict): H3 compares high with low volatility, H4 low with high activity."""
    pairs = F.array(*[F.struct(F.lit(n).alias("contrast"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in (("H3", VOLATILITY[2], VOLATILITY[0]), ("H4", ACTIVITY[0], ACTIVITY[2]))])

    def paired(df: DataFrame, by: list[str]) -> DataFrame:
        x = df.select("symbol", *by, "ring", "slope", F.explode(pairs).alias("p")).where((F.col("ring") == F.col("p.a")) | (F.col("ring") == F.col("p.b")))
        at = lambda side: F.max(F.when(F.col("ring") == F.col(f"p.{side}"), F.col("slope")))
        return x.groupBy("symbol", *by, F.col("p.contrast").alias("contrast")).agg((at("a") - at("b")).alias("difference"), F.countDistinct("ring").alias("sides")).where("sides = 2").drop("sides")

    ci = curves.interval(paired(each, ["rep"]), ("difference",), ("symbol", "contrast")).withColumnsRenamed({"difference_lo": "lo", "difference_hi": "hi"})
    return paired(stats, []).join(ci, ["symbol", "contrast"], "left").withColumn("verdict", verdict_contrast(F.col("lo"), F.col("hi")))


def verdict_h1(gamma: Column, lo: Column, hi: Column) -> Column:
    """Whether the response is concave in size."""
    return (
        F.when(gamma.isNull(), "not testable").when(gamma <= 0, "FALSIFIED (response decreasing in |Q|)").when(hi < 1, "SUPPORTED (concave)")
        .when(lo > 1, "FALSIFIED (convex)").otherwise("FALSIFIED (linear within CI)")
    )


def verdict_h2(sell_lo: Column, sell_hi: Column, buy_lo: Column, buy_hi: Column) -> Column:
    """Whether the response turns over in the outermost bin of a side."""
    return (
        F.when((sell_hi < 0) | (buy_hi < 0), "SUPPORTED (turnover on at least one side)")
        .when((sell_lo > 0) & (buy_lo > 0), "FALSIFIED (extreme bin extends the trend on both sides)").otherwise("inconclusive (CI spans zero on both sides)")
    )


def verdict_contrast(lo: Column, hi: Column) -> Column:
    return F.when(lo > 0, "SUPPORTED").when(hi < 0, "FALSIFIED (inverted)").otherwise("FALSIFIED (flat, CI spans zero)")


def verdicts(curve_: DataFrame, each: DataFrame, bins: int) -> DataFrame:
    """(symbol, gamma, gamma_lo, gamma_hi, h1, sell_side, sell_lo, sell_hi, buy_side, buy_lo, buy_hi, h2) of curves with inside, and their replicates' statistics."""
    ci = curves.interval(each, ("gamma", "sell_side", "buy_side"), ("symbol",))
    x = curve_.select("symbol").distinct().join(curves.gamma(curve_), "symbol", "left").join(curves.turnover(curve_, bins), "symbol", "left").join(ci, "symbol", "left")
    x = x.withColumnsRenamed({"sell_side_lo": "sell_lo", "sell_side_hi": "sell_hi", "buy_side_lo": "buy_lo", "buy_side_hi": "buy_hi"})
    x = x.withColumn("h1", verdict_h1(F.col("gamma"), F.col("gamma_lo"), F.col("gamma_hi"))).withColumn("h2", verdict_h2(*map(F.col, ("sell_lo", "sell_hi", "buy_lo", "buy_hi"))))
    return x.select("symbol", "gamma", "gamma_lo", "gamma_hi", "h1", "sell_side", "sell_lo", "sell_hi", "buy_side", "buy_lo", "buy_hi", "h2")


def proxy_ratios(bands: DataFrame, mean_error: float, max_error: float) -> DataFrame:
    """(symbol, mean_ci_width, max_ci_width, mean_ratio, max_ratio): a known error of the price source against the width of the bands."""
    w = bands.groupBy("symbol").agg(F.avg(F.col("hi") - F.col("lo")).alias("mean_ci_width"), F.max(F.col("hi") - F.col("lo")).alias("max_ci_width"))
    return w.select("symbol", "mean_ci_width", "max_ci_width", F.try_divide(F.lit(mean_error), F.col("mean_ci_width")).alias("mean_ratio"), F.try_divide(F.lit(max_error), F.col("max_ci_width")).alias("max_ratio"))


def clear_of_zero(bands: DataFrame, curve_: DataFrame) -> DataFrame:
    """(symbol, n_bins, n_clear): bins of a curve, and those whose band doesn't hold zero."""
    x = curve_.join(bands, ["symbol", "bin"], "left")
    return x.groupBy("symbol").agg(F.count("mean_r").alias("n_bins"), F.count_if((F.col("lo") > 0) | (F.col("hi") < 0)).alias("n_clear"))
