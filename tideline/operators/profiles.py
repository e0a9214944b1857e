"""First looks at a feed: counts, gaps, shares, and simple order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.ordered import every, following, quantiles, running_sum


def value_counts(df: DataFrame, column: str, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(*by, value, n)."""
    return df.groupBy(*by, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def snapshot_profile(df: DataFrame, ts: str, chunk: Column) -> DataFrame:
    """chunk: a column over ts. (symbol, n_rows, first_ts, last_ts, distinct_ts, median_gap, least_rows, most_rows): distinct times, the median of the gaps between them, and rows at a time."""
    at = df.groupBy("symbol", F.col(ts).alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    gaps = following(at, "next", F.col("ts"), ["symbol"], ["ts"], chunk).select("symbol", (F.col("next") - F.col("ts")).alias("gap")).where("gap is not null")
    median = quantiles(gaps, F.col("gap"), [0.5], ["symbol"], "m").select("symbol", F.col("m")[0].alias("median_gap"))
    s = at.groupBy("symbol").agg(F.sum("n").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("distinct_ts"), F.min("n").alias("least_rows"), F.max("n").alias("most_rows"))
    return s.join(median, "symbol", "left").select("symbol", "n_rows", "first_ts", "last_ts", "distinct_ts", "median_gap", "least_rows", "most_rows")


def trade_profile(trades: DataFrame) -> DataFrame:
    """(symbol, n_rows, first_us, last_us, maker, taker, per_second): null rate over no time."""
    s = trades.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count_if("is_buyer_maker").alias("maker"), F.count_if(~F.col("is_buyer_maker")).alias("taker"))
    return s.withColumn("per_second", F.try_divide(F.col("n_rows") * 1_000_000, F.col("last_us") - F.col("first_us")))


def level_profile(l2: DataFrame) -> DataFrame:
    """(symbol, n_rows, snapshot_rows, snapshot_share)."""
    s = l2.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("is_snapshot").alias("snapshot_rows"))
    return s.withColumn("snapshot_share", F.col("snapshot_rows") / F.col("n_rows"))


def selected(df: DataFrame, value: str, percents: list[int], by: str = "symbol") -> DataFrame:
    """(by, pct, value): the element at place n * pct div 100 of the sorted values, without interpolation. Values are counted first, so no key meets in one task."""
    counts = df.groupBy(by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    x = running_sum(counts, "_upto", F.col("_c"), [by], ["_v"], every("_v", 1024))
    total = counts.groupBy(by).agg(F.sum("_c").alias("_n"))
    want = total.select(by, "_n", F.explode(F.array(*map(F.lit, percents))).alias("pct")).withColumn("_at", F.expr("least(_n * pct div 100, _n - 1)"))
    hit = x.join(F.broadcast(want), by).where((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_c")))
    return hit.select(by, "pct", F.col("_v").alias(value))


def spread_permille(df: DataFrame, value: str, by: str = "symbol") -> DataFrame:
    """(by, least, most, median, permille, text): the median is the element at n div 2; the spread (most - least) * 1000 div median, as text with one decimal; n/a for a median of 0."""
    ends = df.groupBy(by).agg(F.min(value).alias("least"), F.max(value).alias("most"))
    x = ends.join(selected(df, value, [50], by).select(by, F.col(value).alias("median")), by)
    permille = F.when(F.col("median") != 0, F.expr("(most - least) * 1000 div nullif(median, 0)"))
    text = F.coalesce(F.concat(F.expr("cast(permille div 10 as string)"), F.lit("."), F.expr("cast(permille % 10 as string)"), F.lit("%")), F.lit("n/a"))
    return x.withColumn("permille", permille).withColumn("text", text)


def first_examples(compared: DataFrame, n: int = 20) -> DataFrame:
    """The first n rows of each symbol that differ, in order of batch: a bounded heap by symbol, not a sort of all."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("symbol").orderBy("batch"))  # Spark keeps n rows of each partition before the shuffle
    return compared.where("class <> 'None'").withColumn("example", rank).where(F.col("example") <= n)
