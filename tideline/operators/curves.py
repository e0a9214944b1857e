"""Impact curves from sufficient statistics: quantile bins, the hour-by-bin cube, bootstrap, placebo and summaries.

The cube (symbol, h, bin, n, sq, sr, sr2) is small whatever the number of trades (hours times bins),
and every curve, subset and replicate is computed from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.operators.ordered import quantiles, running_number

# Fixed values of the two bin grids: interior quantile probabilities.
EVENT_PROBS = [0.005, 0.0125, 0.025, 0.05, 0.1, 0.175, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.825, 0.9, 0.95, 0.975, 0.9875, 0.995]
CLOCK_PROBS = [k / 15 for k in range(1, 15)]
HOUR = 3_600_000_000


def edges(windows: DataFrame, probs: list[float] | None = None, q: str = "q") -> DataFrame:
    """(symbol, edges): bin boundaries at quantiles of q alone, with linear interpolation, rounded to 6 places."""
    return quantiles(windows, F.col(q), probs or EVENT_PROBS, ["symbol"], "edges").withColumn("edges", F.transform("edges", lambda x: F.round(x, 6)))


def bin_left_closed(q: Column, e: Column) -> Column:
    """Number of boundaries at or under q."""
    return F.size(F.filter(e, lambda x: x <= q))


def bin_right_closed(q: Column, e: Column) -> Column:
    """Number of boundaries under q."""
    return F.size(F.filter(e, lambda x: x < q))


def binned(windows: DataFrame, probs: list[float] | None = None, q: str = "q") -> DataFrame:
    return windows.join(edges(windows, probs, q), "symbol").withColumn("bin", bin_left_closed(F.col(q), F.col("edges"))).drop("edges")


def cube(windows: DataFrame, t0_us: int, probs: list[float] | None = None) -> DataFrame:
    """(symbol, h, bin, n, sq, sr, sr2) over windows (symbol, t, q, r); h counts hours from t0_us."""
    h = F.expr(f"(t - {t0_us}) div {HOUR}").alias("h")
    return binned(windows, probs).groupBy("symbol", h, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("sq"), F.sum("r").alias("sr"), F.sum(F.col("r") * F.col("r")).alias("sr2"))


def curve(c: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(symbol, *by, bin, n, mean_q, mean_r, sd_r) of the cube rows given; sd_r only where n > 1."""
    by = ["symbol", *(by or []), "bin"]
    s = c.groupBy(*by).agg(*[F.sum(x).alias(x) for x in ("n", "sq", "sr", "sr2")])
    var = F.col("sr2") / F.col("n") - (F.col("sr") / F.col("n")) * (F.col("sr") / F.col("n"))
    return s.select(*by, "n", (F.col("sq") / F.col("n")).alias("mean_q"), (F.col("sr") / F.col("n")).alias("mean_r"), F.when(F.col("n") > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("sd_r"))


def hourly_flow(windows: DataFrame, t0_us: int, hours: int) -> DataFrame:
    """(symbol, h, flow): summed q of every hour, 0 where there is none."""
    spine = windows.select("symbol").distinct().select("symbol", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hours - 1).cast("long"))).alias("h"))
    flow = windows.groupBy("symbol", F.expr(f"(t - {t0_us}) div {HOUR}").alias("h")).agg(F.sum("q").alias("flow"))
    return spine.join(flow, ["symbol", "h"], "left").select("symbol", "h", F.coalesce("flow", F.lit(0)).alias("flow"))


def acf(flow: DataFrame, max_lag: int) -> DataFrame:
    """(symbol, lag, acf): sample autocorrelation of flow over h, for lags 0 to max_lag."""
    mean = flow.groupBy("symbol").agg(F.avg("flow").alias("mean"))
    x = flow.join(mean, "symbol").select("symbol", "h", (F.col("flow") - F.col("mean")).alias("x"))
    denom = x.groupBy("symbol").agg(F.sum(F.col("x") * F.col("x")).alias("denom"))
    shifted = x.select("symbol", F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"), "h", "x").withColumn("h", F.col("h") - F.col("lag")).withColumnRenamed("x", "y")
    s = x.join(shifted, ["symbol", "h"]).groupBy("symbol", "lag").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    return s.join(denom, "symbol").select("symbol", "lag", F.try_divide("s", "denom").alias("acf"))


def block_length(a: DataFrame, hours: int, max_lag: int) -> DataFrame:
    """(symbol, horizon, rule, block_length): first lag from which three in a row stay inside the white-noise band, and the cube-root rule; the larger wins."""
    band = 2.0 / hours**0.5
    rule = -(-round(hours ** (1 / 3), 12) // 1)
    w = Window.partitionBy("symbol").orderBy("lag")
    ok = a.withColumn("i", F.abs("acf") < band)
    ok = ok.withColumn("good", F.col("i") & F.lead("i", 1).over(w) & F.lead("i", 2).over(w) & F.col("lag").between(1, max_lag - 3))
    h = ok.groupBy("symbol").agg(F.coalesce(F.min(F.when(F.col("good"), F.col("lag"))), F.lit(max_lag)).alias("horizon"))
    return h.select("symbol", "horizon", F.lit(int(rule)).alias("rule"), F.greatest("horizon", F.lit(int(rule))).alias("block_length"))


def hash_picks(spark: SparkSession, reps: int, blocks: int, hours: int) -> DataFrame:
    """(rep, start): starts of the blocks of each replicate, from an integer hash."""
    ids = spark.range(reps * blocks).select(F.expr(f"id div {blocks}").alias("rep"), F.expr(f"id % {blocks}").alias("j"))
    return ids.select("rep", F.expr(f"(((rep * 7919 + j * 104729 + 17) * 2654435761) % 4294967296) div 65536 % {hours}").alias("start"))


def bootstrap(c: DataFrame, picks: DataFrame, hours: int, length: int) -> DataFrame:
    """(symbol, rep, bin, mean_r): circular moving-block bootstrap over hour cells.

    Picks become weights of hours first, so a replicate is a weighted sum of the cube; picks is (rep, start), hours long.
    """
    weight = picks.select("rep", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("o"), "start").groupBy("rep", F.pmod(F.col("start") + F.col("o"), F.lit(hours)).alias("h")).agg(F.count(F.lit(1)).alias("w"))
    s = c.join(weight, "h").groupBy("symbol", "rep", "bin").agg(F.sum(F.col("n") * F.col("w")).alias("n"), F.sum(F.col("sr") * F.col("w")).alias("sr"))
    return s.select("symbol", "rep", "bin", F.try_divide("sr", "n").alias("mean_r"))


def all_hours(windows: DataFrame, hours: int) -> DataFrame:
    """(symbol, ring, i, h, k): every hour of the span as one ring, named all."""
    spine = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hours - 1).cast("long")))
    return windows.select("symbol").distinct().select("symbol", F.lit("all").alias("ring"), spine.alias("i")).select("symbol", "ring", "i", F.col("i").alias("h"), F.lit(hours).cast("long").alias("k"))


def rings_of(hours_: DataFrame) -> DataFrame:
    """(symbol, ring, i, h, k) of (symbol, ring, h): a ring's hours in order, numbered from 0. As many rows as hours."""
    w = Window.partitionBy("symbol", "ring")
    return hours_.select("symbol", "ring", (F.row_number().over(w.orderBy("h")) - 1).cast("long").alias("i"), "h", F.count(F.lit(1)).over(w).alias("k"))


def ring_weights(rings: DataFrame, lengths: DataFrame, reps: int) -> DataFrame:
    """(symbol, ring, rep, h, w): how often each replicate of the circular moving-block bootstrap draws an hour.

    lengths: (symbol, block_length). A replicate draws ceil(k / length) blocks of consecutive places of the ring, whose starts come from an integer hash. Rings
    shorter than three blocks are left out.
    """
    size = rings.groupBy("symbol", "ring").agg(F.max("k").alias("k")).join(F.broadcast(lengths.select("symbol", F.col("block_length").cast("long").alias("l"))), "symbol")
    size = size.where((F.col("k") >= 3 * F.col("l")) | (F.col("ring") == "all")).withColumn("blocks", F.ceil(F.col("k") / F.col("l")).cast("long"))
    drawn = size.select("symbol", "ring", "k", "l", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))).alias("rep"))
    drawn = drawn.select("symbol", "ring", "k", "l", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"))
    start = F.expr("(((rep * 7919 + j * 104729 + 17) * 2654435761) % 4294967296) div 65536 % k")
    places = drawn.withColumn("start", start).select("symbol", "ring", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("l") - 1)).alias("o"), "start", "k").select("symbol", "ring", "rep", F.pmod(F.col("start") + F.col("o"), F.col("k")).alias("i"))
    return places.groupBy("symbol", "ring", "rep", "i").agg(F.count(F.lit(1)).alias("w")).join(rings, ["symbol", "ring", "i"]).select("symbol", "ring", "rep", "h", "w")


def ring_curve(c: DataFrame, rings: DataFrame) -> DataFrame:
    """(symbol, ring, bin, n, mean_q, mean_r, sd_r) over each ring's hours."""
    return curve(c.join(rings.select("symbol", "ring", "h"), ["symbol", "h"]), ["ring"])


def ring_replicates(c: DataFrame, weights: DataFrame) -> DataFrame:
    """(symbol, ring, rep, bin, mean_r): a replicate is a weighted sum of the cube."""
    s = c.join(weights, ["symbol", "h"]).groupBy("symbol", "ring", "rep", "bin").agg(F.sum(F.col("n") * F.col("w")).alias("n"), F.sum(F.col("sr") * F.col("w")).alias("sr"))
    return s.select("symbol", "ring", "rep", "bin", F.try_divide("sr", "n").alias("mean_r"))


def limits(windows: DataFrame, q: str = "q") -> DataFrame:
    """(symbol, lim): the 10 and 90 % quantiles of abs(q)."""
    return quantiles(windows, F.abs(F.col(q)), [0.1, 0.9], ["symbol"], "lim")


def replicate_stats(reps: DataFrame, curve_: DataFrame, bins: int) -> DataFrame:
    """(symbol, ring, rep, gamma, slope, sell_side, buy_side) of every replicate, over the inside bins of the curve it replicates. curve_ has inside."""
    x = reps.join(F.broadcast(curve_.select("symbol", "ring", "bin", "mean_q", "inside")), ["symbol", "ring", "bin"])
    like = F.col("inside") & (F.signum("mean_r") == F.signum("mean_q")) & (F.col("mean_r") != 0)
    use = F.col("inside") & F.col("mean_r").isNotNull()
    lq, lr = (F.when(like, F.ln(F.abs(F.when(F.col(c) != 0, F.col(c))))) for c in ("mean_q", "mean_r"))
    at = lambda k: F.max(F.when(F.col("bin") == k, F.abs("mean_r")))
    return x.groupBy("symbol", "ring", "rep").agg(
        F.when(F.count_if(like) >= 3, F.regr_slope(lr, lq)).alias("gamma"), F.when(F.count_if(use) >= 3, F.regr_slope(F.when(use, F.col("mean_r")), F.when(use, F.col("mean_q")))).alias("slope"),
        (at(0) - at(1)).alias("sell_side"), (at(bins - 1) - at(bins - 2)).alias("buy_side"),
    )


def interval(df: DataFrame, values: tuple[str, ...], by: tuple[str, ...], level: float = 0.95) -> DataFrame:
    """(*by, v_lo, v_hi for each value): percentile bands over the rows of a group; nulls are left out. For replicates: as many rows a group as there are."""
    a = (1 - level) / 2
    return df.groupBy(*by).agg(*[F.percentile(v, F.lit(p)).alias(f"{v}_{end}") for v in values for end, p in (("lo", a), ("hi", 1 - a))])


def ci_bands(reps: DataFrame, value: str = "mean_r", by: tuple[str, ...] = ("symbol", "bin"), level: float = 0.95) -> DataFrame:
    """(*by, lo, hi): percentile bands over replicates; nulls are left out."""
    a = (1 - level) / 2
    return reps.where(F.col(value).isNotNull()).groupBy(*by).agg(F.percentile(value, F.lit(a)).alias("lo"), F.percentile(value, F.lit(1 - a)).alias("hi"))


def interior(curve_: DataFrame, windows: DataFrame) -> DataFrame:
    """curve with ``inside``: whether abs(mean_q) lies between the 10 and 90 % quantiles of abs(q)."""
    lim = limits(windows)
    return curve_.join(lim, "symbol").withColumn("inside", F.abs("mean_q").between(F.col("lim")[0], F.col("lim")[1])).drop("lim")


def gamma(curve_: DataFrame) -> DataFrame:
    """(symbol, gamma): slope of ln abs(mean_r) on ln abs(mean_q) over inside bins of like sign; null under three bins."""
    ok = curve_.where(F.col("inside") & (F.signum("mean_r") == F.signum("mean_q")) & (F.col("mean_r") != 0))
    return ok.groupBy("symbol").agg(F.when(F.count(F.lit(1)) >= 3, F.regr_slope(F.ln(F.abs("mean_r")), F.ln(F.abs("mean_q")))).alias("gamma"))


def central_slope(curve_: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(*by, slope): slope of mean_r on mean_q over inside bins; null under three bins."""
    ok = curve_.where(F.col("inside") & F.col("mean_r").isNotNull())
    return ok.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= 3, F.regr_slope("mean_r", "mean_q")).alias("slope"))


def turnover(curve_: DataFrame, bins: int, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(*by, sell_side, buy_side): how far the extreme bin's response exceeds its neighbour's, on each side."""
    at = lambda k: F.max(F.when(F.col("bin") == k, F.abs("mean_r")))
    return curve_.groupBy(*by).agg((at(0) - at(1)).alias("sell_side"), (at(bins - 1) - at(bins - 2)).alias("buy_side"))


def indexed(windows: DataFrame) -> DataFrame:
    """windows with i, the position in their symbol's time order, and total, the symbol's number of windows."""
    total = windows.groupBy("symbol").agg(F.count(F.lit(1)).alias("total"))
    return running_number(windows, "i", ["symbol"], ["day", "t"], F.col("day")).join(F.broadcast(total), "symbol")


def placebo(windows: DataFrame, shifts: int, probs: list[float] | None = None, floor: int = 181) -> DataFrame:
    """(symbol, shift_no, bin, n, mean_r): bins shifted around the circle against unshifted responses.

    A shift lies in [least, total - least) with least = max(1, total div floor) and comes from an integer hash of its number.
    """
    return circular_pairs(windows, shifts, probs, floor).groupBy("symbol", "shift_no", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_r"))


def circular_pairs(windows: DataFrame, shifts: int, probs: list[float] | None = None, floor: int = 181) -> DataFrame:
    """(symbol, shift_no, i, bin, r): the response at place i and the bin that the shift brings there."""
    x = indexed(binned(windows, probs))
    least = F.expr(f"greatest(1, total div {floor})")
    moved = x.select("symbol", "total", "i", "bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shifts - 1).cast("long"))).alias("shift_no")).withColumn("least", least)
    moved = moved.withColumn("shift", F.expr("least + (((shift_no + 1) * 2654435761) % 4294967296) div 65536 % greatest(1, total - 2 * least)"))
    moved = moved.select("symbol", "shift_no", "bin", F.pmod(F.col("i") + F.col("shift"), F.col("total")).alias("i"))
    return moved.join(x.select("symbol", "i", "r"), ["symbol", "i"]).select("symbol", "shift_no", "i", "bin", "r")


def placebo_verdict(p: DataFrame, real: DataFrame, windows: DataFrame, bands: DataFrame) -> DataFrame:
    """(symbol, max_z, mean_corr, max_corr, amplitude, real, ratio, passed): the largest deviation of a shifted curve from the overall mean, in half-widths of the bands and as it
    is, against the real curve's; and the correlation of the shapes."""
    overall = windows.groupBy("symbol").agg(F.avg("r").alias("overall"))
    x = p.join(real.select("symbol", "bin", F.col("mean_r").alias("real")), ["symbol", "bin"]).join(overall, "symbol").join(bands, ["symbol", "bin"], "left")
    x = x.select("symbol", "shift_no", (F.col("mean_r") - F.col("overall")).alias("c"), (F.col("real") - F.col("overall")).alias("s"), ((F.col("hi") - F.col("lo")) / 2).alias("half"))
    each = x.groupBy("symbol", "shift_no").agg(F.max(F.abs("c") / F.when(F.col("half") > 1e-12, F.col("half"))).alias("z"), F.corr("c", "s").alias("corr"), F.max(F.abs("c")).alias("a"), F.max(F.abs("s")).alias("real"))
    out = each.groupBy("symbol").agg(F.max("z").alias("max_z"), F.avg("corr").alias("mean_corr"), F.max(F.abs("corr")).alias("max_corr"), F.max("a").alias("amplitude"), F.max("real").alias("real"))
    out = out.withColumn("ratio", F.try_divide("amplitude", "real"))
    return out.withColumn("passed", F.coalesce((F.col("max_z") < 3.0) & (F.abs("mean_corr") < 0.3), F.lit(False)))
