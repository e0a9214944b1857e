"""As-of join: for each left row the last right row at or before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.ordered import by_day, carried


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str], tie: str | None = None, chunk: Column | None = None) -> DataFrame:
    """left with the ``values`` of the last right row of the same keys whose time is at or before its own, null if there is none.

    Both sides are merged into one sequence, right rows first at equal times, and the last right row is carried forward: within a chunk of time (a day of
    microseconds unless ``chunk``, a column over _ts, says otherwise), then from chunk to chunk. ``tie`` orders right rows of one time.
    """
    l = left.select(F.struct(*left.columns).alias("_row"), *keys, F.col(left_ts).cast("long").alias("_ts"), F.lit(1).alias("_side"), F.monotonically_increasing_id().alias("_tie"))  # noqa: E741
    r = right.where(F.col(right_ts).isNotNull()).select(*keys, F.col(right_ts).cast("long").alias("_ts"), F.lit(0).alias("_side"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("_tie"), F.struct(*values).alias("_value"))
    both = l.unionByName(r, allowMissingColumns=True)
    got = carried(both.withColumn("_ts", F.coalesce("_ts", F.lit(-(2**62)))), "_found", F.col("_value"), keys, ["_ts", "_side", "_tie"], by_day("_ts") if chunk is None else chunk)
    return got.where("_side = 1").select("_row.*", *[F.col(f"_found.{v}").alias(v) for v in values])
