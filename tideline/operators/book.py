"""Level-feed order books as relations: no state machine where the feed allows it.

A book after batch b is, for each level of the episode since the last snapshot, the last
amount with batch <= b, if positive. That equals the two-pass adapter only if a batch
names a level once and sides never cross; ``guard`` tests both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.ordered import carried, every, previous, running_sum

#: Batches, and rows, of a chunk along a feed.
BATCHES, ROWS = 1000, 100_000
#: Batches of a bucket in which states and asked batches meet.
BUCKET = 64


def with_episode(l2: DataFrame) -> DataFrame:
    """l2 with ``episode``: the batch of the last snapshot at or before the row, -1 before the first."""
    each = l2.groupBy("symbol", "batch").agg(F.max(F.when(F.col("is_snapshot"), F.col("batch"))).alias("_snap"))
    marks = carried(each, "episode", F.col("_snap"), ["symbol"], ["batch"], every("batch", BATCHES)).select("symbol", "batch", F.coalesce("episode", F.lit(-1).cast("long")).alias("episode"))
    return l2.join(marks, ["symbol", "batch"])


def book_at(l2: DataFrame, batches: DataFrame) -> DataFrame:
    """(symbol, batch, side, price, size): the book after each batch asked for. batches: (symbol, batch).

    Each level's state holds from its batch until the level's next row or the next episode. Asked batches and states meet by bucket of
    batches: a state goes to every bucket it reaches into, of its episode and where something is asked, and an asked batch to its own, so a long episode is many keys.
    """
    rows = with_episode(l2)
    w = Window.partitionBy("symbol", "episode", "side", "price").orderBy("batch", "seq")
    states = rows.withColumn("until", F.lead("batch").over(w)).where("amount > 0").select("symbol", "episode", "side", "price", F.col("amount").alias("size"), F.col("batch").alias("since"), "until")
    marks = rows.select("symbol", "batch", "episode").distinct()
    last = batches.select("symbol", F.col("batch").alias("_b")).distinct()
    both = marks.select("symbol", F.col("batch").alias("_b"), F.lit(0).alias("_ask"), F.col("episode").alias("_e")).unionByName(last.withColumn("_ask", F.lit(1)), allowMissingColumns=True)
    asked = carried(both, "episode", F.col("_e"), ["symbol"], ["_b", "_ask"], every("_b", BATCHES)).where("_ask = 1").select("symbol", "episode", F.col("_b").alias("batch"), F.expr(f"_b div {BUCKET}").alias("bucket"))
    ends = asked.groupBy("symbol", "episode").agg(F.max("batch").alias("_end"))
    reach = F.explode(F.sequence(F.expr(f"since div {BUCKET}"), F.greatest(F.expr(f"since div {BUCKET}"), F.expr(f"coalesce(least(until - 1, _end), _end) div {BUCKET}"))))
    dealt = states.join(ends, ["symbol", "episode"]).where(F.col("since") <= F.col("_end")).withColumn("bucket", reach)
    j = dealt.join(asked, ["symbol", "episode", "bucket"]).where((F.col("since") <= F.col("batch")) & (F.col("until").isNull() | (F.col("until") > F.col("batch"))))
    return j.select("symbol", "batch", "side", "price", "size")


def ranked(book: DataFrame, by: tuple[str, ...] = ("symbol", "batch")) -> DataFrame:
    """book with ``rank`` from the best: bids from the highest price, asks from the lowest."""
    order = F.when(F.col("side") == 0, -F.col("price")).otherwise(F.col("price"))
    return book.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "side").orderBy(order)) - 1)


def top_levels(book: DataFrame, n: int, by: tuple[str, ...] = ("symbol", "batch")) -> DataFrame:
    return ranked(book, by).where(F.col("rank") < n)


def guard(l2: DataFrame, book: DataFrame | None = None) -> DataFrame:
    """(symbol, repeated_levels, crossed_batches): both 0 where the relational form is exact. The touch is followed at every batch of l2."""
    dup = l2.groupBy("symbol", "batch", "side", "price").agg(F.count(F.lit(1)).alias("n")).groupBy("symbol").agg(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).cast("long").alias("repeated_levels"))
    b = book if book is not None else book_at(l2, l2.select("symbol", "batch").distinct())
    touch = b.groupBy("symbol", "batch").agg(F.max(F.when(F.col("side") == 0, F.col("price"))).alias("bid"), F.min(F.when(F.col("side") == 1, F.col("price"))).alias("ask"))
    crossed = touch.groupBy("symbol").agg(F.sum(F.when(F.col("bid") >= F.col("ask"), 1).otherwise(0)).cast("long").alias("crossed_batches"))
    return dup.join(crossed, "symbol", "left").select("symbol", "repeated_levels", F.coalesce("crossed_batches", F.lit(0)).alias("crossed_batches"))


def adapter_counts(l2: DataFrame) -> DataFrame:
    """The level adapter's counters as a relation, under the guard."""
    rows = with_episode(l2)
    p = F.lag("amount").over(Window.partitionBy("symbol", "episode", "side", "price").orderBy("seq"))
    x = rows.withColumn("p", F.coalesce(p, F.lit(0)))
    c = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    s, a, p = F.col("is_snapshot"), F.col("amount"), F.col("p")
    return x.groupBy("symbol").agg(
        c(s & (a > 0)).alias("snapshot_levels"), c(s & (a <= 0)).alias("zero_rows"), c(~s & (a <= 0) & (p > 0)).alias("deletes"), c(~s & (a <= 0) & (p <= 0)).alias("unknown_deletes"),
        c(~s & (a > 0) & (p <= 0)).alias("adds"), c(~s & (a > 0) & (p > 0) & (a < p)).alias("shrinks"), c(~s & (p > 0) & (a > p)).alias("grows"), c(~s & (a > 0) & (a == p)).alias("no_ops"),
    )


def compare(book: DataFrame, published: DataFrame, depth: int) -> DataFrame:
    """(symbol, batch, class, rank, touch_exact): the first difference of each published book, asks before bids at a rank.

    Both sides: (symbol, batch, side, rank, price, size). Classes: None, EngineShallow, EngineDeep, PriceDiffers, SizeDiffers.
    A pair without any level on either side does not occur in the inputs and so not in the result.
    """
    k = ["symbol", "batch", "side", "rank"]
    a = book.where(F.col("rank") < depth).select(*k, F.col("price").alias("ep"), F.col("size").alias("es"))
    b = published.where(F.col("rank") < depth).select(*k, F.col("price").alias("pp"), F.col("size").alias("ps"))
    keys = published.select("symbol", "batch").distinct()
    j = a.join(keys, ["symbol", "batch"], "left_semi").join(b, k, "full_outer")
    cls = F.when(F.col("ep").isNull(), "EngineShallow").when(F.col("pp").isNull(), "EngineDeep").when(F.col("ep") != F.col("pp"), "PriceDiffers").when(F.col("es") != F.col("ps"), "SizeDiffers")
    order = F.col("rank") * 2 + (1 - F.col("side"))
    g = j.withColumn("cls", cls).groupBy("symbol", "batch").agg(F.min_by("cls", F.when(F.col("cls").isNotNull(), order)).alias("cls"), F.min(F.when(F.col("cls").isNotNull(), F.col("rank"))).alias("rank"))
    return g.select("symbol", "batch", F.coalesce("cls", F.lit("None")).alias("class"), "rank", F.coalesce(F.col("rank") != 0, F.lit(True)).alias("touch_exact"))


def tally(compared: DataFrame) -> DataFrame:
    """(symbol, class, rank, n): how often each class occurs first, and at which rank (-1 for none)."""
    return compared.groupBy("symbol", "class", F.coalesce("rank", F.lit(-1)).alias("rank")).agg(F.count(F.lit(1)).alias("n"))


def unaligned(published: DataFrame, l2: DataFrame) -> DataFrame:
    """Published keys (symbol, ts_us, local_ts_us) without a batch of the same times."""
    return published.join(l2.select("symbol", "ts_us", "local_ts_us").distinct(), ["symbol", "ts_us", "local_ts_us"], "left_anti")


def episodes(l2: DataFrame) -> DataFrame:
    """(symbol, episodes, snapshot_rows): runs of consecutive snapshot rows."""
    x = previous(l2, "_p", F.col("is_snapshot"), ["symbol"], ["seq"], every("seq", ROWS)).withColumn("begins", F.col("is_snapshot") & ~F.coalesce("_p", F.lit(False)))
    return x.groupBy("symbol").agg(F.sum(F.col("begins").cast("long")).alias("episodes"), F.sum(F.col("is_snapshot").cast("long")).alias("snapshot_rows"))


def batch_sessions(l2: DataFrame, keys: tuple[str, ...] = ("ts_us", "local_ts_us", "is_snapshot")) -> DataFrame:
    """l2 with ``session``: a new number whenever the keys differ from the row before."""
    key = F.struct(*keys)
    x = previous(l2, "_p", key, ["symbol"], ["seq"], every("seq", ROWS)).withColumn("_new", F.coalesce((key != F.col("_p")).cast("long"), F.lit(0)))
    return running_sum(x, "session", F.col("_new"), ["symbol"], ["seq"], every("seq", ROWS)).drop("_p", "_new")
