"""Fixed-width clock bins: flow, price response and the quantile-binned curve over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.asof import asof_backward
from tideline.operators.blocks import log_price, signed_qty
from tideline.operators.curves import bin_right_closed
from tideline.operators.ordered import by_day, following, quantiles


def bin_edges(trades: DataFrame, width_us: int) -> DataFrame:
    """(symbol, edge): edges from a symbol's first trade in steps of width_us, up to one step past its last."""
    span = trades.groupBy("symbol").agg(F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"))
    return span.select("symbol", F.explode(F.sequence("t0", F.col("t1") + width_us, F.lit(width_us))).alias("edge"))


def bin_flow(trades: DataFrame, edges: DataFrame, width_us: int) -> DataFrame:
    """(symbol, bin_start, ofi, n_trades) of every bin [edge, next edge); 0 where nothing traded."""
    last = edges.groupBy("symbol").agg(F.max("edge").alias("last"))
    bins = edges.join(F.broadcast(last), "symbol").where("edge < last").select("symbol", F.col("edge").alias("bin_start"))
    t0 = trades.groupBy("symbol").agg(F.min("ts_us").alias("t0"))
    at = trades.join(t0, "symbol").withColumn("bin_start", F.expr(f"t0 + (ts_us - t0) div {width_us} * {width_us}"))
    flow = at.groupBy("symbol", "bin_start").agg(F.sum(signed_qty()).alias("ofi"), F.count(F.lit(1)).alias("n_trades"))
    return bins.join(flow, ["symbol", "bin_start"], "left").na.fill(0, ["ofi", "n_trades"])


def edge_prices(edges: DataFrame, prices: DataFrame, price: str, tie: str | None = None) -> DataFrame:
    """(symbol, edge, price): the last price at or before each edge."""
    return asof_backward(edges.select("symbol", "edge"), prices, ["symbol"], "edge", "ts_us", [price], tie)


def bin_response(edges: DataFrame, prices: DataFrame, price: str, tie: str | None = None) -> DataFrame:
    """(symbol, bin_start, response): log price at a bin's end less that at its start."""
    at = following(edge_prices(edges, prices, price, tie), "_next", F.struct("edge", log_price(price).alias("p")), ["symbol"], ["edge"], by_day("edge"))
    return at.where("_next is not null").select("symbol", F.col("edge").alias("bin_start"), (F.col("_next.p") - log_price(price)).alias("response"))


def response_curve(flow: DataFrame, response: DataFrame, bins: int = 15) -> DataFrame:
    """(symbol, ofi_bin, mean_ofi, n_obs, mean_response): bins of flow closed on the right; the first takes the least value too. The response never moves a bin's borders."""
    e = quantiles(flow, F.col("ofi"), [k / bins for k in range(1, bins)], ["symbol"], "e").withColumn("e", F.transform("e", lambda x: F.round(x, 6)))
    x = flow.join(e, "symbol").withColumn("ofi_bin", bin_right_closed(F.col("ofi"), F.col("e"))).drop("e").join(response, ["symbol", "bin_start"], "left")
    return x.groupBy("symbol", "ofi_bin").agg(F.avg("ofi").alias("mean_ofi"), F.count(F.lit(1)).alias("n_obs"), F.avg("response").alias("mean_response"))
