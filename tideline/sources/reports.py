"""What a run leaves behind: the table of curves, markdown tables, the replay report and the index of packed windows. All from small results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed columns of the table of curves, in order.
CURVE_COLUMNS = ("symbol", "scale", "bin", "n_windows", "mean_q", "mean_r", "ci_lo", "ci_hi", "sd_r", "frac_zero_r", "mean_duration_s", "interior_bin")
#: Fixed names of the volatility terciles in the index.
TERCILES = ("low", "mid", "high")


def curve_table(curves: DataFrame) -> DataFrame:
    """The twelve columns of the table of curves from (symbol, scale, bin, n, ..., inside), in order of symbol, scale and bin."""
    x = curves.withColumnsRenamed({"n": "n_windows", "inside": "interior_bin"})
    return x.select(*CURVE_COLUMNS).orderBy("symbol", "scale", "bin")


def write_curves(curves: DataFrame, path: str) -> None:
    """One CSV file with a header: hours and bins bound the rows, not trades."""
    curve_table(curves).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, formats: dict[str, str] | None = None, title: str | None = None) -> str:
    """df as a markdown table, in its order; formats are by column (as in format()). For results of a few hundred rows."""
    formats = formats or {}

    def cell(name: str, v) -> str:
        return "-" if v is None else format(v, formats.get(name, "")) if not isinstance(v, bool) else ("yes" if v else "NO")

    lines = [f"# {title}", ""] if title else []
    lines += ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(c, r[c]) for c in df.columns) + " |" for r in df.collect()]
    return "\n".join(lines) + "\n"


def replay_report(messages: DataFrame, tagged: DataFrame, depth: int = 5) -> DataFrame:
    """(symbol, line_no, line): the report of a replay: message mix, invariants, the book's first levels, totals, fills with their checksum, conservation.

    tagged: the engine's table for the same messages.
    """
    from tideline.operators.engine import checksum, engine_totals

    kinds = ("adds", "modifies", "deletes", "trades", "resets")
    mix = messages.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("type") == k).alias(name) for k, name in enumerate(kinds)])
    bad = tagged.groupBy("symbol").agg(F.count_if(F.col("kind") == "violation").alias("violations"))
    last = tagged.groupBy("symbol").agg(F.max("episode").alias("episode"))
    book = tagged.where("kind = 'book'").join(F.broadcast(last), ["symbol", "episode"]).groupBy("symbol", "side", "rank", "price").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("orders"))
    level = F.format_string("%s %d: %d x %d (%d orders)", F.when(F.col("side") == 0, "bid").otherwise("ask"), F.col("rank") + 1, F.col("price"), F.col("size"), F.col("orders"))
    levels = book.where(F.col("rank") < depth).select("symbol", (F.lit(10) + F.col("side") * 1000 + F.col("rank")).alias("line_no"), level.alias("line"))
    totals = engine_totals(tagged)
    sums = checksum(tagged)
    say = lambda df, no, *parts: df.select("symbol", F.lit(no).alias("line_no"), F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts]).alias("line"))
    text = lambda c: F.col(c).cast("string")
    out = say(mix, 0, "messages: ", text("n"), *[x for k in kinds for x in (f", {k} ", text(k))])
    out = out.unionByName(say(bad, 1, "invariants: ", F.when(F.col("violations") == 0, "hold").otherwise(F.concat(text("violations"), F.lit(" violations")))))
    out = out.unionByName(levels)
    out = out.unionByName(say(totals, 5000, "quantity: added ", text("qty_added"), ", filled ", text("qty_filled"), ", removed ", text("qty_removed"), ", resting ", text("resting"), ", rejected messages ", text("rejected")))
    out = out.unionByName(say(mix.select("symbol").join(sums, "symbol", "left").na.fill(0, ["fills"]).na.fill("cbf29ce484222325", ["checksum"]), 5001, "fills: ", text("fills"), ", checksum ", F.col("checksum")))
    return out.unionByName(say(totals, 5002, "conservation: residual ", text("residual"))).orderBy("symbol", "line_no")


def window_index(decoded: DataFrame, specs: DataFrame, days: DataFrame) -> DataFrame:
    """The index of packed windows: file, symbol, day, start_ms, end_ms, price_scale, qty_scale, day_sigma, day_volume_base, vol_tercile, reason.

    decoded: (file, window) with the decoded struct; specs: (file, symbol, day, reason), day as yyyymmdd; days: (symbol, day, rv, volume, tercile) with day as yyyymmdd. A file whose header is not what its
    spec says raises.
    """
    x = decoded.select("file", "window.*").join(F.broadcast(specs.select("file", F.col("symbol").alias("_s"), F.col("day").alias("_d"), "reason")), "file")
    wrong = F.raise_error(F.concat(F.lit("header mismatch in "), F.col("file"))).cast("string")
    x = x.withColumn("symbol", F.when((F.col("symbol") == F.col("_s")) & (F.col("day") == F.col("_d")), F.col("symbol")).otherwise(wrong))
    names = F.element_at(F.array(*map(F.lit, TERCILES)), F.col("tercile") + 1)
    return x.join(F.broadcast(days), ["symbol", "day"]).select("file", "symbol", "day", "start_ms", "end_ms", "price_scale", "qty_scale", F.sqrt("rv").alias("day_sigma"), F.col("volume").alias("day_volume_base"), names.alias("vol_tercile"), "reason")


def write_index(index: DataFrame, path: str, made_by: str) -> None:
    """The index as one JSON document. As many entries as windows."""
    import json
    from pathlib import Path

    doc = {"format": "IWD1", "generated_by": made_by, "windows": [r.asDict() for r in index.orderBy("file").collect()]}
    Path(path).write_text(json.dumps(doc, indent=2), encoding="utf-8")
