"""Event-time blocks and clock bars from trade prints, and what is derived from them.

Trades: symbol, day, ts_us, id, price_ticks, qty_lots, is_buyer_maker. Ties in time are
ordered by id. Prints of one day stay together, so (symbol, day) is the unit of parallelism.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.ordered import by_day, carried, following

BLOCK = 25
MINUTE = 60_000_000
HOUR = 3_600_000_000


def signed_qty() -> Column:
    """Bought lots count up, sold ones down: a print whose buyer was the maker was a sale."""
    return F.when(F.col("is_buyer_maker"), -F.col("qty_lots")).otherwise(F.col("qty_lots"))


def log_price(c: str) -> Column:
    return F.ln(F.when(F.col(c) > 0, F.col(c).cast("double")))


def event_blocks(trades: DataFrame, size: int = BLOCK) -> DataFrame:
    """(symbol, day, bi, t, q, r): blocks of ``size`` trades; r is the log return to the next block's first price.

    The partial block at the end of a day and the block before it, if nothing follows, have no r and are dropped.
    """
    g = trades.withColumn("g", F.expr(f"(row_number() over (partition by symbol, day order by ts_us, id) - 1) div {size}"))
    first = F.struct("ts_us", "id")
    b = g.groupBy("symbol", "day", "g").agg(
        F.min("ts_us").alias("t"), F.min_by("price_ticks", first).alias("p0"), F.sum(signed_qty()).alias("q"), F.count(F.lit(1)).alias("n")
    )
    w = Window.partitionBy("symbol", "day").orderBy("g")
    b = b.withColumn("r", F.lead(log_price("p0")).over(w) - log_price("p0")).where((F.col("n") == size) & F.col("r").isNotNull())
    return b.select("symbol", "day", (F.row_number().over(w) - 1).cast("long").alias("bi"), "t", "q", "r")


def minute_bars(trades: DataFrame) -> DataFrame:
    """(symbol, m, ofi, p0, n): signed flow, first price and number of trades of each minute that has any."""
    m = (F.col("ts_us") - F.pmod(F.col("ts_us"), F.lit(MINUTE))).alias("m")
    return trades.groupBy("symbol", m).agg(F.sum(signed_qty()).alias("ofi"), F.min_by("price_ticks", F.struct("ts_us", "id")).alias("p0"), F.count(F.lit(1)).alias("n"))


def minute_response(bars: DataFrame) -> DataFrame:
    """bars with r, the log return to the next minute, null unless that minute follows at once (across days too)."""
    x = following(bars, "_next", F.struct("m", log_price("p0").alias("p")), ["symbol"], ["m"], by_day("m"))
    return x.withColumn("r", F.when(F.col("_next.m") == F.col("m") + MINUTE, F.col("_next.p") - log_price("p0"))).drop("_next")


def derive_scale(blocks: DataFrame, m: int) -> DataFrame:
    """(symbol, day, g, t, q, r): m consecutive base blocks added up; incomplete groups at the end of a day are dropped."""
    return (
        blocks.groupBy("symbol", "day", F.expr(f"bi div {m}").alias("g"))
        .agg(F.min("t").alias("t"), F.sum("q").alias("q"), F.sum("r").alias("r"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == m).drop("n")
    )


def with_duration(windows: DataFrame, fill: bool = False) -> DataFrame:
    """windows with dt_s, the seconds to the next window of the day; null for the day's last, or carried forward if ``fill``."""
    w = Window.partitionBy("symbol", "day").orderBy("t")
    out = windows.withColumn("dt_s", (F.lead("t").over(w) - F.col("t")) / 1e6)
    if not fill:
        return out
    return carried(out.withColumnRenamed("dt_s", "_dt"), "dt_s", F.col("_dt"), ["symbol"], ["day", "t"], F.col("day")).drop("_dt")
