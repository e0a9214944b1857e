"""Readers and writers of text feeds: status columns instead of exceptions, rejected rows stay countable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.scalars import decimal_status, scaled_decimal

INT = r"^-?[0-9]{1,18}$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): lines of plain or gzip text without trailing carriage returns. One gzip file is one task; spread the rows after parsing."""
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"))


def parse_levels(lines: DataFrame, price_decimals: int = 1, size_decimals: int = 3) -> DataFrame:
    """Level-feed rows (exchange,symbol,timestamp,local_timestamp,is_snapshot,side,price,amount) with ``status``:
    Ok, FieldCount, BadNumber, BadSide or BadFlag, tested in the order count, times, flag, side, price, amount."""
    f = F.split("line", ",", -1)
    x = lines.withColumn("f", f)
    c = lambda i: F.col("f")[i]
    status = (
        F.when(F.size("f") != 8, "FieldCount").when(~c(2).rlike(INT) | ~c(3).rlike(INT), "BadNumber").when(~c(4).isin("true", "false"), "BadFlag")
        .when(~c(5).isin("bid", "ask"), "BadSide").when((decimal_status(c(6), price_decimals) != "Ok") | (decimal_status(c(7), size_decimals) != "Ok"), "BadNumber").otherwise("Ok")
    )
    x = x.withColumn("status", status)
    g = lambda i: F.when(F.col("status") == "Ok", F.get("f", F.lit(i)))
    return x.select(
        "line", "status", g(1).alias("symbol"), g(2).try_cast("long").alias("ts_us"), g(3).try_cast("long").alias("local_ts_us"), (g(4) == "true").alias("is_snapshot"),
        F.when(g(5) == "bid", 0).when(g(5) == "ask", 1).alias("side"), scaled_decimal(g(6), price_decimals).alias("price"), scaled_decimal(g(7), size_decimals).alias("amount"),
    )


def parse_book_rows(lines: DataFrame, levels: int = 25, price_decimals: int = 1, size_decimals: int = 3) -> DataFrame:
    """Book rows (exchange,symbol,times, then ask price, ask amount, bid price, bid amount by level) as (line, status, symbol, ts_us, local_ts_us, asks, bids), arrays of struct<price, size> best first.

    A side ends at its first empty price; what follows is not looked at. Status: Ok, FieldCount or BadNumber (a time, or a price or amount of a level that counts); other columns are null then.
    """
    x = lines.withColumn("f", F.split("line", ",", -1))

    def side(at: int):
        level = F.array(*[F.struct(F.get("f", F.lit(4 * i + at)).alias("p"), F.get("f", F.lit(4 * i + at + 1)).alias("q")) for i in range(levels)])
        depth = F.array_position(F.transform(level, lambda v: v["p"]), F.lit("")).cast("int")
        cut = F.when(depth == 0, level).otherwise(F.slice(level, 1, F.greatest(depth - 1, F.lit(0))))
        good = F.forall(cut, lambda v: (decimal_status(v["p"], price_decimals) == "Ok") & (decimal_status(v["q"], size_decimals) == "Ok"))
        return good, F.transform(cut, lambda v: F.struct(scaled_decimal(v["p"], price_decimals).alias("price"), scaled_decimal(v["q"], size_decimals).alias("size")))

    good_asks, asks = side(4)
    good_bids, bids = side(6)
    times = F.get("f", F.lit(2)).rlike(INT) & F.get("f", F.lit(3)).rlike(INT)
    status = F.when(F.size("f") != 4 + 4 * levels, "FieldCount").when(~(times & good_asks & good_bids), "BadNumber").otherwise("Ok")
    x = x.withColumn("status", status)
    ok = lambda c: F.when(F.col("status") == "Ok", c)
    return x.select("line", "status", ok(F.get("f", F.lit(1))).alias("symbol"), ok(F.get("f", F.lit(2)).try_cast("long")).alias("ts_us"), ok(F.get("f", F.lit(3)).try_cast("long")).alias("local_ts_us"), ok(asks).alias("asks"), ok(bids).alias("bids"))


def by_level(books: DataFrame) -> DataFrame:
    """The levels of books (asks, bids as arrays) as rows: the other columns, side, rank, price, size."""
    keep = [c for c in books.columns if c not in ("asks", "bids", "line", "status")]
    parts = [books.select(*keep, F.lit(side).alias("side"), F.posexplode(c).alias("rank", "v")) for side, c in ((1, "asks"), (0, "bids"))]
    return parts[0].unionByName(parts[1]).select(*keep, "side", "rank", F.col("v.price").alias("price"), F.col("v.size").alias("size"))


def parse_book_snapshots(lines: DataFrame, levels: int = 25, price_decimals: int = 1, size_decimals: int = 3) -> DataFrame:
    """(symbol, ts_us, local_ts_us, side, rank, price, size) of the book rows that are Ok; parse_book_rows tells about the others."""
    return by_level(parse_book_rows(lines, levels, price_decimals, size_decimals).where("status = 'Ok'"))


def parse_orders(lines: DataFrame) -> DataFrame:
    """Order-feed rows (time,type,order id,size,price,direction) with ``status``; seconds become microseconds by truncation, direction 1 is a bid."""
    x = lines.withColumn("f", F.split("line", ",", -1))
    c = lambda i: F.get("f", F.lit(i))
    status = (
        F.when(F.size("f") != 6, "FieldCount").when((decimal_status(c(0), 9) != "Ok"), "BadNumber").when(~c(1).isin("1", "2", "3", "4", "5", "7"), "BadType")
        .when(~c(2).rlike(r"^[0-9]{1,18}$") | ~c(3).rlike(INT) | ~c(4).rlike(INT), "BadNumber").when(~c(5).isin("1", "-1"), "BadSide").otherwise("Ok")
    )
    x = x.withColumn("status", status)
    g = lambda i: F.when(F.col("status") == "Ok", c(i))
    return x.select(
        "line", "status", (scaled_decimal(g(0), 9) - F.pmod(scaled_decimal(g(0), 9), F.lit(1000))).alias("_ns"),
        g(1).try_cast("int").alias("type"), g(2).try_cast("long").alias("order_id"), g(3).try_cast("long").alias("size"), g(4).try_cast("long").alias("price"), F.when(g(5) == "1", 0).when(g(5) == "-1", 1).alias("side"),
    ).withColumn("ts_us", F.expr("_ns div 1000")).drop("_ns")


# What stands for an absent level.
ASK_SENTINEL, BID_SENTINEL = 9999999999, -9999999999


def parse_order_book_rows(lines: DataFrame, levels: int = 10) -> DataFrame:
    """(other columns, line, status, asks, bids) of 4 * levels fields (ask price, ask size, bid price, bid size by level). A sentinel price or a size of at most 0 ends a side.

    Status: Ok, FieldCount or BadNumber (any field, also behind a side's end).
    """
    x = lines.withColumn("f", F.split("line", ",", -1))
    x = x.withColumn("status", F.when(F.size("f") != 4 * levels, "FieldCount").when(~F.forall("f", lambda v: v.rlike(r"^[+-]?[0-9]{1,18}$")), "BadNumber").otherwise("Ok"))

    def side(at: int, sentinel: int):
        level = F.array(*[F.struct(F.get("f", F.lit(4 * i + at)).try_cast("long").alias("price"), F.get("f", F.lit(4 * i + at + 1)).try_cast("long").alias("size")) for i in range(levels)])
        end = F.array_position(F.transform(level, lambda v: (v["price"] == sentinel) | (v["size"] <= 0)), F.lit(True)).cast("int")
        return F.when(F.col("status") == "Ok", F.when(end == 0, level).otherwise(F.slice(level, 1, F.greatest(end - 1, F.lit(0)))))

    return x.select(*lines.columns, "status", side(0, ASK_SENTINEL).alias("asks"), side(2, BID_SENTINEL).alias("bids"))


def parse_order_books(lines: DataFrame, levels: int = 10) -> DataFrame:
    """(other columns, side, rank, price, size) of the rows that are Ok."""
    return by_level(parse_order_book_rows(lines, levels).where("status = 'Ok'"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): lines of plain or gzip text files numbered from 1. A file is one task: where a number is needed, its lines must be counted."""
    import pyarrow as pa

    def run(batches):
        import gzip
        import io

        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                raw = pa.BufferReader(content.as_buffer())
                stream = gzip.open(raw) if name.endswith(".gz") else raw
                lines, at = [], 1
                for line in io.TextIOWrapper(stream, "utf-8", newline="\n"):
                    lines.append(line.rstrip("\r\n"))
                    if len(lines) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["file", "line_no", "line"])
                        lines, at = [], at + len(lines)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines), pa.string()), pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["file", "line_no", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, line_no long, line string")


def read_tape(lines: DataFrame) -> DataFrame:
    """Messages of a text tape (A/M/D/T/R lines, # comments) with the other columns of lines and ``status``; blank lines and comments are left out.

    Status: Ok, UnknownTag, MissingFields (a field is absent or no integer) or BadSide, tested in this order. Fields behind the last one are not read. The message's columns are null unless Ok.
    """
    x = lines.withColumn("f", F.split(F.trim("line"), r"\s+")).where("f[0] <> '' and not startswith(f[0], '#')")
    c = lambda i: F.get("f", F.lit(i))
    tag = c(0)
    numbers = {"A": (1, 2, 4, 5), "M": (1, 2, 3), "D": (1, 2), "T": (1, 3, 4), "R": (1,)}
    whole = F.lit(False)
    for t, at in numbers.items():
        good = c(at[0]).rlike(INT)
        for i in at[1:]:
            good = good & c(i).rlike(INT)
        whole = F.when(tag == t, F.coalesce(good, F.lit(False)) & (c(3).isNotNull() if t == "A" else F.lit(True))).otherwise(whole)
    side = F.when(tag == "A", c(3)).when(tag == "T", c(2))
    x = x.withColumn("status", F.when(~tag.isin(*numbers), "UnknownTag").when(~whole, "MissingFields").when(side.isNotNull() & ~side.isin("B", "S"), "BadSide").otherwise("Ok"))
    ok = lambda e: F.when(F.col("status") == "Ok", e)
    number = lambda i: c(i).try_cast("long")
    zero = F.lit(0).cast("long")
    return x.select(
        *lines.columns, "status", ok(F.when(tag == "A", 0).when(tag == "M", 1).when(tag == "D", 2).when(tag == "T", 3).otherwise(4)).alias("type"), ok(number(1)).alias("ts_us"),
        ok(F.when(tag.isin("A", "M", "D"), number(2)).otherwise(zero)).alias("order_id"), ok(F.when(side == "S", 1).otherwise(0)).alias("side"),
        ok(F.when(tag == "A", number(4)).when(tag == "T", number(3)).otherwise(zero)).alias("price"), ok(F.when(tag == "A", number(5)).when(tag == "M", number(3)).when(tag == "T", number(4)).otherwise(zero)).alias("size"),
    )


def checked(parsed: DataFrame) -> DataFrame:
    """parsed, but the job fails at a row that isn't Ok, naming its line number if it has one."""
    where = F.concat(F.lit("line "), F.col("line_no").cast("string")) if "line_no" in parsed.columns else F.col("line")
    return parsed.withColumn("status", F.when(F.col("status") == "Ok", F.col("status")).otherwise(F.raise_error(F.concat(where, F.lit(": "), F.col("status"))).cast("string")))


def tape_lines(messages: DataFrame) -> DataFrame:
    """messages with ``line``, the tape text; write it with ``select('line').write.text``."""
    s = F.when(F.col("side") == 0, "B").otherwise("S")
    t = F.col("type")
    return messages.withColumn("line", F.when(t == 0, F.concat_ws(" ", F.lit("A"), "ts_us", "order_id", s, "price", "size")).when(t == 1, F.concat_ws(" ", F.lit("M"), "ts_us", "order_id", "size")).when(t == 2, F.concat_ws(" ", F.lit("D"), "ts_us", "order_id")).when(t == 3, F.concat_ws(" ", F.lit("T"), "ts_us", s, "price", "size")).otherwise(F.concat_ws(" ", F.lit("R"), "ts_us")))


def read_trades_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw trade prints (id, price, qty, quote_qty, time in ms, is_buyer_maker, with header) as (timestamp, id, price, signed_qty)."""
    raw = spark.read.csv(path, header=True, schema="id long, price double, qty double, quote_qty double, time long, is_buyer_maker boolean")
    return raw.select(F.timestamp_millis("time").alias("timestamp"), "id", "price", F.when(F.col("is_buyer_maker"), -F.col("qty")).otherwise(F.col("qty")).alias("signed_qty"))


def read_mid_csv(spark: SparkSession, path: str) -> DataFrame:
    """Book snapshots with header (timestamp in us, asks[0].price, bids[0].price, ...) as (timestamp, midprice)."""
    raw = spark.read.csv(path, header=True)
    return raw.select(F.timestamp_micros(F.col("timestamp").cast("long")).alias("timestamp"), ((F.col("`asks[0].price`").cast("double") + F.col("`bids[0].price`").cast("double")) / 2).alias("midprice"))


def band_snapshots(raw: DataFrame, start: str, end: str, pcts: list[int]) -> DataFrame:
    """(timestamp, depth array) of band rows (timestamp, percentage, depth) in [start, end): snapshots whose bands aren't the expected ones are dropped; depth in thousandths."""
    x = raw.where((F.col("timestamp") >= start) & (F.col("timestamp") < end)).select("timestamp", F.round(F.col("percentage") * 10).cast("int").alias("p"), F.round(F.col("depth") * 1000).cast("long").alias("d"))
    g = x.groupBy("timestamp").agg(F.sort_array(F.collect_list(F.struct("p", "d"))).alias("v"))
    return g.where(F.transform("v", lambda v: v["p"]) == F.array(*[F.lit(p) for p in pcts])).select("timestamp", F.transform("v", lambda v: v["d"]).alias("depth"))


def pending(requested: DataFrame, manifest: DataFrame) -> DataFrame:
    """Requested (symbol, day) without a finished manifest entry: reduced and its raw file deleted."""
    return requested.join(manifest.where("reduced and raw_deleted"), ["symbol", "day"], "left_anti")


def day_spine(spark: SparkSession, symbols: list[str], start: str, end: str) -> DataFrame:
    """(symbol, day): every symbol on every day, both ends included."""
    return spark.createDataFrame([(s,) for s in symbols], "symbol string").select("symbol", F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day"))
