"""Walk-the-book execution: schedules over band-depth snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalars import band_price, half_up, sqrt_cost
from tideline.operators.ordered import by_day, running_number

# Fixed band orders, nearest to the mid first.
ASK_BANDS, BID_BANDS = [6, 7, 8, 9, 10, 11], [5, 4, 3, 2, 1, 0]


def walk(snapshots: DataFrame, side: str, target: Column, participation: float) -> DataFrame:
    """(ts, mid, band, rank, qty, price): what a slice of ``target`` takes of each band, nearest first, at most ``participation`` of its depth.

    snapshots: (ts, mid, band, pct_tenths, depth). What the bands can't give is not carried on.
    """
    order = ASK_BANDS if side == "buy" else BID_BANDS
    rank = F.array_position(F.array(*[F.lit(b) for b in order]), F.col("band")) - 1
    x = snapshots.where(F.col("band").isin(order)).withColumn("rank", rank.cast("int")).withColumn("avail", F.col("depth") * participation)
    before = F.coalesce(F.sum("avail").over(Window.partitionBy("ts").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    x = x.withColumn("qty", F.greatest(F.lit(0.0), F.least(F.col("avail"), target - before)))
    return x.where("qty > 0").select("ts", "mid", "band", "rank", "qty", band_price(F.col("mid"), F.col("pct_tenths")).alias("price"))


def pick_slices(times: DataFrame, slices: int) -> DataFrame:
    """(slice, ts): evenly spaced rows of times(ts), rounding halves up; the first row if there is one slice."""
    n = times.select("ts").distinct().withColumn("_all", F.lit(0))
    i = running_number(n, "i", ["_all"], ["ts"], by_day("ts"))
    want = F.explode(F.sequence(F.lit(0), F.lit(max(slices, 1) - 1)))
    last = n.agg(F.count(F.lit(1)).alias("n")).select("n", want.alias("slice"))
    at = half_up(F.col("slice") * (F.col("n") - 1) / (slices - 1)) if slices > 1 else F.lit(0).cast("long")
    return i.select("i", "ts").join(F.broadcast(last.select("slice", at.alias("i"))), "i").select("slice", "ts")


def schedule(snapshots: DataFrame, slices: DataFrame, side: str, total: float, n: int, participation: float, sigma: float, volume: float) -> DataFrame:
    """(slice, ts, filled, cum_filled, cum_cost, realized, reference): an even schedule over the slices, with the square-root reference."""
    fills = walk(snapshots.join(slices, "ts").drop("slice"), side, F.lit(total / n), participation)
    per = slices.join(fills.groupBy("ts").agg(F.sum("qty").alias("filled"), F.sum(F.col("qty") * F.col("price")).alias("cost")), "ts", "left")
    arrival = slices.join(snapshots.select("ts", "mid").distinct(), "ts").agg(F.min_by("mid", "slice").alias("arrival"))
    w = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as slices
    x = per.crossJoin(arrival).select(  # one row on the right
        "slice", "ts", F.coalesce("filled", F.lit(0.0)).alias("filled"), F.sum(F.coalesce("filled", F.lit(0.0))).over(w).alias("cum_filled"), F.sum(F.coalesce("cost", F.lit(0.0))).over(w).alias("cum_cost"), "arrival"
    )
    avg = F.when(F.col("cum_filled") > 0, F.col("cum_cost") / F.when(F.col("cum_filled") > 0, F.col("cum_filled"))).otherwise(F.col("arrival"))
    sign = 1.0 if side == "buy" else -1.0
    return x.withColumn("realized", (avg - F.col("arrival")) / F.col("arrival") * sign).withColumn("reference", sqrt_cost(F.col("cum_filled"), F.lit(sigma), F.lit(volume))).drop("arrival")


def seed_ladder(snapshot: DataFrame, per_band: int = 4) -> DataFrame:
    """(ts, band, k, side, price, size): per_band resting orders of a quarter of each band's depth, at least one lot, at the band's price in ticks."""
    side = F.when(F.col("band") <= 5, 0).otherwise(1)
    x = snapshot.where("depth > 0").select("ts", "band", side.alias("side"), half_up(band_price(F.col("mid"), F.col("pct_tenths"))).alias("price"), F.greatest(F.lit(1), half_up(F.col("depth") / per_band)).alias("size"))
    return x.select("ts", "band", F.explode(F.sequence(F.lit(1), F.lit(per_band))).alias("k"), "side", "price", "size")
