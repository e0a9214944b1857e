"""Running sums, carried values and successors along an order, without one task for a whole key.

A window over a symbol's whole history would be one task per symbol. Here rows are cut into chunks along the order (a day, a
thousand batches): the window runs within (keys, chunk), the chunks' totals are summed up in a second pass over one row a chunk, and what comes
from other chunks is joined back. ``chunk`` must not fall as the order rises, and keys must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
CHUNK, CARRY = "_chunk", "_carry"


def by_day(ts_us: str) -> Column:
    return F.expr(f"{ts_us} div {DAY_US}")


def every(c: str, n: int) -> Column:
    return F.expr(f"{c} div {n}")


def _window(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def running_sum(df: DataFrame, name: str, value: Column, keys: list[str], order: list, chunk: Column) -> DataFrame:
    """df with ``name``, the sum of ``value`` over the rows of the keys up to this one; rows that tie in the order must not differ in value."""
    x = df.withColumn(CHUNK, chunk)
    total = x.groupBy(*keys, CHUNK).agg(F.sum(value).alias(CARRY))
    before = F.sum(CARRY).over(_window(keys, [CHUNK]).rowsBetween(Window.unboundedPreceding, -1))
    carry = total.select(*keys, CHUNK, F.coalesce(before, F.lit(0)).alias(CARRY))
    own = F.sum(value).over(_window([*keys, CHUNK], order).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn(name, own).join(carry, [*keys, CHUNK]).withColumn(name, F.col(name) + F.col(CARRY)).select(*df.columns, name)


def running_number(df: DataFrame, name: str, keys: list[str], order: list, chunk: Column) -> DataFrame:
    """df with ``name``, the place of the row in its keys' order, from 0."""
    x = running_sum(df, name, F.lit(1).cast("long"), keys, order, chunk)
    return x.withColumn(name, F.col(name) - 1)


def carried(df: DataFrame, name: str, value: Column, keys: list[str], order: list, chunk: Column) -> DataFrame:
    """df with ``name``, the last non-null ``value`` up to this row. Rows that tie in the order must have at most one non-null value."""
    x = df.withColumn(CHUNK, chunk)
    newest = F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
    ends = x.groupBy(*keys, CHUNK).agg(newest.alias(CARRY))
    before = F.last(CARRY, ignorenulls=True).over(_window(keys, [CHUNK]).rowsBetween(Window.unboundedPreceding, -1))
    carry = ends.select(*keys, CHUNK, before.alias(CARRY))
    own = F.last(value, ignorenulls=True).over(_window([*keys, CHUNK], order).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn(name, own).join(carry, [*keys, CHUNK]).withColumn(name, F.coalesce(F.col(name), F.col(CARRY))).select(*df.columns, name)


def following(df: DataFrame, name: str, value: Column, keys: list[str], order: list, chunk: Column) -> DataFrame:
    """df with ``name``, the ``value`` of the next row of the keys; null for the last. The order must be total."""
    x = df.withColumn(CHUNK, chunk)
    begins = x.groupBy(*keys, CHUNK).agg(F.min_by(F.struct(value.alias("v")), F.struct(*order)).alias(CARRY))
    after = F.lead(CARRY).over(_window(keys, [CHUNK]))
    carry = begins.select(*keys, CHUNK, after.alias(CARRY))
    own = F.lead(F.struct(value.alias("v"))).over(_window([*keys, CHUNK], order))
    return x.withColumn(name, own).join(carry, [*keys, CHUNK]).withColumn(name, F.coalesce(F.col(name), F.col(CARRY))["v"]).select(*df.columns, name)


def previous(df: DataFrame, name: str, value: Column, keys: list[str], order: list, chunk: Column) -> DataFrame:
    """df with ``name``, the ``value`` of the row before of the keys; null for the first. The order must be total."""
    x = df.withColumn(CHUNK, chunk)
    ends = x.groupBy(*keys, CHUNK).agg(F.max_by(F.struct(value.alias("v")), F.struct(*order)).alias(CARRY))
    before = F.lag(CARRY).over(_window(keys, [CHUNK]))
    carry = ends.select(*keys, CHUNK, before.alias(CARRY))
    own = F.lag(F.struct(value.alias("v"))).over(_window([*keys, CHUNK], order))
    return x.withColumn(name, own).join(carry, [*keys, CHUNK]).withColumn(name, F.coalesce(F.col(name), F.col(CARRY))["v"]).select(*df.columns, name)


def quantiles(df: DataFrame, value: Column, probs: list[float], keys: list[str], name: str) -> DataFrame:
    """(*keys, name): the quantiles of ``value`` with linear interpolation, as an array of doubles; nulls are left out.

    Values are counted first, which combines on the map side; the places looked for are then found along each key's distinct values, cut
    into spans of the value's own leading digits, so neither all rows nor all values of a key meet in one task.
    """
    v = value.cast("double")
    counts = df.select(*keys, v.alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    # spans that keep the order of values: sign, binary exponent and a few bits of the mantissa
    size = F.abs("_v")
    exponent = F.floor(F.log2(F.when(size > 0, size)))
    fine = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * 16)
    span = F.when(F.col("_v") == 0, F.lit(0)).otherwise(F.signum("_v") * (exponent * 16 + fine + 40000)).cast("long")
    x = running_sum(counts.withColumn("_span", span), "_upto", F.col("_c"), keys, ["_v"], F.col("_span"))
    total = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    # a probability p falls between the values at floor(p (n - 1)) and the one after
    at = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    asked = total.select(*keys, F.explode(at).alias("a"), "_n").select(*keys, F.col("a.i").alias("i"), (F.col("a.p") * (F.col("_n") - 1)).alias("place"))
    asked = asked.withColumn("low", F.floor("place")).withColumn("part", F.col("place") - F.col("low"))
    wanted = asked.groupBy(*keys).agg(F.collect_list(F.struct("i", "low", "part")).alias("asked"))  # as many as there are probabilities
    hit = x.join(F.broadcast(wanted), keys) if not keys or len(probs) <= 1000 else x.join(wanted, keys)
    inside = lambda k: (k >= F.col("_upto") - F.col("_c")) & (k < F.col("_upto"))
    hit = hit.withColumn("low", F.filter("asked", lambda a: inside(a["low"]))).withColumn("high", F.filter("asked", lambda a: inside(F.ceil(a["low"] + a["part"]))))
    hit = hit.where((F.size("low") > 0) | (F.size("high") > 0))
    ends = hit.select(*keys, "_v", F.explode(F.concat(F.transform("low", lambda a: F.struct(a["i"].alias("i"), F.lit(0).alias("end"), a["part"].alias("part"))), F.transform("high", lambda a: F.struct(a["i"].alias("i"), F.lit(1).alias("end"), a["part"].alias("part"))))).alias("e"))
    pick = lambda end: F.max(F.when(F.col("e.end") == end, F.col("_v")))
    each = ends.groupBy(*keys, F.col("e.i").alias("i")).agg(pick(0).alias("lo"), pick(1).alias("hi"), F.max("e.part").alias("part"))
    value_at = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((1 - F.col("part")) * F.col("lo") + F.col("part") * F.col("hi"))
    got = each.select(*keys, F.struct("i", value_at.alias("x")).alias("s")).groupBy(*keys).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return got.select(*keys, F.transform("s", lambda s: s["x"]).alias(name))
