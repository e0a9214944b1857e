"""The day store: reduced feeds as Parquet by (symbol, day), the cache of derived tables, and the manifest of what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "source string, symbol string, day string, status string, rows long, reduced_path string, raw_deleted boolean, error string"
ENTRY = "struct<status:string,rows:bigint,reduced_path:string,raw_deleted:boolean,error:string>"


def write_days(df: DataFrame, path: str, order: tuple[str, ...] = ("timestamp",), mode: str = "overwrite") -> None:
    """df (with symbol and day) as one sorted set of files for each symbol and day. One shuffle on both keys; a day is the unit that later reads prune to."""
    df.repartition("symbol", "day").sortWithinPartitions("symbol", "day", *order).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "day").parquet(path)


def read_days(spark: SparkSession, path: str, symbol: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The store's rows of a symbol from start to end, both included: filters on partition columns, so other days' files are not listed in the scan. Raises FileNotFoundError if nothing is left."""
    df = spark.read.parquet(path)
    for c, test in ((symbol, lambda v: F.col("symbol") == v), (start, lambda v: F.col("day") >= F.to_date(F.lit(v))), (end, lambda v: F.col("day") <= F.to_date(F.lit(v)))):
        if c is not None:
            df = df.where(test(c))
    if not df.inputFiles() or df.select("day").limit(1).isEmpty():
        raise FileNotFoundError(f"no days of {symbol or 'any symbol'} from {start} to {end} under {path}")
    return df


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at path; built and written first if it isn't there, or with ``force``. A write that was cut off leaves no _SUCCESS and is done anew."""
    if force or not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line): the lines of the first member of each zip file, numbered from 0. A file is one task, as its stream can't be entered in the middle; rows leave in batches."""
    import pyarrow as pa

    def run(batches):
        import io
        import zipfile

        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z, z.open(z.infolist()[0]) as f:
                    lines, at = [], 0
                    for line in io.TextIOWrapper(f, "utf-8", newline="\n"):
                        lines.append(line.rstrip("\r\n"))
                        if len(lines) == 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["file", "n", "line"])
                            lines, at = [], at + len(lines)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines), pa.string()), pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["file", "n", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, n long, line string")


def trades_from_lines(lines: DataFrame) -> DataFrame:
    """(file, timestamp, id, price, signed_qty) of raw trade prints (id, price, qty, quote_qty, time in ms, is_buyer_maker) with a header line."""
    f = F.split("line", ",")
    x = lines.where("n > 0 and line <> ''").select("file", f[0].cast("long").alias("id"), f[1].cast("double").alias("price"), f[2].cast("double").alias("qty"), f[4].cast("long").alias("time"), (F.lower(f[5]) == "true").alias("maker"))
    return x.select("file", F.timestamp_millis("time").alias("timestamp"), "id", "price", F.when(F.col("maker"), -F.col("qty")).otherwise(F.col("qty")).alias("signed_qty"))


def symbol_and_day(df: DataFrame) -> DataFrame:
    """df with symbol and day from the name of its file, ``.../SYMBOL-YYYY-MM-DD.anything`` or ``SYMBOL-kind-YYYY-MM-DD.anything``."""
    name = F.element_at(F.split("file", "/"), -1)
    return df.withColumn("symbol", F.regexp_extract(name, r"^([^-]+)-", 1)).withColumn("day", F.to_date(F.regexp_extract(name, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)))


def reduce_trades(spark: SparkSession, zips: str, out: str) -> DataFrame:
    """Reduces zipped trade prints into the day store; (symbol, day, rows) of what was written."""
    write_days(symbol_and_day(trades_from_lines(zipped_lines(spark, zips))).drop("file"), out, ("timestamp", "id"))
    return read_days(spark, out).groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("rows"))


def reduce_mids(spark: SparkSession, paths: str, out: str) -> DataFrame:
    """Reduces book snapshots (header; timestamp in us, asks[0].price, bids[0].price, ...) into the day store; (symbol, day, rows)."""
    raw = spark.read.csv(paths, header=True)
    mid = (F.col("`asks[0].price`").cast("double") + F.col("`bids[0].price`").cast("double")) / 2
    x = raw.select(F.input_file_name().alias("file"), F.timestamp_micros(F.col("timestamp").cast("long")).alias("timestamp"), mid.alias("midprice"))
    write_days(symbol_and_day(x).drop("file"), out)
    return read_days(spark, out).groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("rows"))


def window_trades(trades: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """(symbol, ts_ms, price, qty) of trades in [start, end) in time order, as scaled integers with sold lots negative. trades: symbol, ts_us, id, price_ticks, qty_lots, is_buyer_maker."""
    from tideline.operators.blocks import signed_qty

    x = trades.where((F.col("ts_us") >= start_us) & (F.col("ts_us") < end_us))
    return x.orderBy("symbol", "ts_us", "id").select("symbol", F.expr("ts_us div 1000").alias("ts_ms"), F.col("price_ticks").alias("price"), signed_qty().alias("qty"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The JSON manifest {source: {symbol: {day: entry}}} as rows; none if the file isn't there."""
    if not exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,map<string,map<string,{ENTRY}>>>").alias("m"))
    x = raw.select(F.explode("m").alias("source", "s")).select("source", F.explode("s").alias("symbol", "d")).select("source", "symbol", F.explode("d").alias("day", "e"))
    return x.select("source", "symbol", "day", "e.*")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Writes the manifest beside its place and renames it there, so a reader never sees half of it. One row a symbol and day: small."""
    import json

    spark = manifest.sparkSession
    out: dict = {}
    for r in manifest.orderBy("source", "symbol", "day").toLocalIterator():
        out.setdefault(r.source, {}).setdefault(r.symbol, {})[r.day] = {k: v for k, v in r.asDict().items() if k not in ("source", "symbol", "day")}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, beside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".tmp"))
    fs = target.getFileSystem(conf)
    stream = fs.create(beside, True)
    stream.write(bytearray(json.dumps(out, indent=2, sort_keys=True).encode()))
    stream.close()
    fs.delete(target, False)
    fs.rename(beside, target)


def run_outcomes(requested: DataFrame, manifest: DataFrame, raw: DataFrame) -> DataFrame:
    """(symbol, day, outcome, rows, error) of one resumable run over requested (symbol, day): skipped where the manifest has the day reduced and its raw file deleted, gap where no raw
    file can be had, else reduced.

    manifest: symbol, day, status, raw_deleted. raw: symbol, day, rows, error; a row with an error, or no row, is a gap.
    """
    done = manifest.where("status = 'reduced' and raw_deleted").select("symbol", F.col("day").cast("date").alias("day"), F.lit(True).alias("done")).distinct()
    x = requested.join(done, ["symbol", "day"], "left").join(raw.withColumn("found", F.lit(True)), ["symbol", "day"], "left")
    outcome = F.when(F.col("done"), "skipped").when(F.col("found").isNull() | F.col("error").isNotNull(), "gap").otherwise("reduced")
    error = F.when(outcome == "gap", F.coalesce("error", F.lit("no raw file")))
    return x.select("symbol", "day", outcome.alias("outcome"), F.when(outcome == "reduced", F.col("rows")).alias("rows"), error.alias("error"))


def updated_manifest(manifest: DataFrame, outcomes: DataFrame, source: str) -> DataFrame:
    """The manifest after a run: skipped days keep their entries, the others get new ones."""
    new = outcomes.where("outcome <> 'skipped'").select(
        F.lit(source).alias("source"), "symbol", F.col("day").cast("string").alias("day"), F.when(F.col("outcome") == "gap", "gap").otherwise("reduced").alias("status"), "rows",
        F.when(F.col("outcome") == "reduced", F.concat_ws("/", F.concat(F.lit("symbol="), "symbol"), F.concat(F.lit("day="), F.col("day").cast("string")))).alias("reduced_path"),
        F.when(F.col("outcome") == "reduced", F.lit(True)).alias("raw_deleted"), "error",
    )
    return manifest.join(new.select("source", "symbol", "day"), ["source", "symbol", "day"], "left_anti").unionByName(new)


def run_summary(outcomes: DataFrame) -> DataFrame:
    """(reduced, skipped, gaps): one row."""
    return outcomes.agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("reduced", "reduced"), ("skipped", "skipped"), ("gap", "gaps"))])
