"""The registered queries of the library and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import scalars as sc
from tideline.operators import adapters, asof, blocks, book, curves, engine, equity, execution, fit, pilot, profiles, regimes, study
from tideline.operators.ordered import every
from tideline.plans import oracles
from tideline.sources import feeds, reports, store, tape, window_codec
from tideline.sources.views import view

#: Start and hours of the span; replicates of the bootstrap, of the funding comparison and of the equity study; shifts of the placebo; lags searched for the block length; levels compared.
T0, HOURS, REPS, FUNDING_REPS, EQUITY_REPS, SHIFTS, MAX_LAG, DEPTH = 1704067200000000, 720, 1000, 2000, 2000, 20, 168, 25
BINS = len(curves.EVENT_PROBS) + 1
#: Known errors of trade prices against midprices, mean and largest by bin (fixed values of the study).
PROXY_MEAN_ERROR, PROXY_MAX_ERROR = 8.099e-07, 7.999e-06


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def _blocks(s, d):
    return blocks.event_blocks(view(s, d, "trades"))


def _bars(s, d):
    return blocks.minute_response(blocks.minute_bars(view(s, d, "trades")))


def _cube(s, d):
    return curves.cube(_blocks(s, d), T0)


def _curve(s, d):
    b = _blocks(s, d)
    return curves.interior(curves.curve(curves.cube(b, T0)), b)


def _acf(s, d):
    return curves.acf(curves.hourly_flow(_blocks(s, d), T0, HOURS), MAX_LAG)


def _lengths(s, d):
    return curves.block_length(_acf(s, d), HOURS, MAX_LAG)


def _all_weights(windows, lengths, reps=REPS):
    return curves.ring_weights(curves.all_hours(windows, HOURS), lengths, reps)


def _reps(s, d):
    b = _blocks(s, d)
    return curves.ring_replicates(_cube(s, d), _all_weights(b, _lengths(s, d)))


def _with_mid(s, d):
    b = _blocks(s, d)
    q = view(s, d, "quotes").withColumn("mid", (F.col("bid_ticks") + F.col("ask_ticks")) / 2)
    return asof.asof_backward(b, q, ["symbol"], "t", "ts_us", ["mid"], "id")


def _proxy(s, d):
    w = Window.partitionBy("symbol").orderBy("day", "bi")
    return _with_mid(s, d).withColumn("r_mid", F.lead(F.ln("mid")).over(w) - F.ln("mid")).where("r_mid is not null")


def _hour_edges(s, d):
    t = view(s, d, "trades")
    return pilot.bin_edges(t, blocks.HOUR), t


def _snapshots(s, d):
    b = view(s, d, "bands").withColumn("ts", F.expr("unix_micros(cast(hour_ts as timestamp))"))
    hours = b.select("ts").distinct().withColumn("symbol", F.lit("AAA"))
    mid = asof.asof_backward(hours, view(s, d, "trades"), ["symbol"], "ts", "ts_us", ["price_ticks"], "id").where("price_ticks is not null")
    return b.join(mid.select("ts", F.col("price_ticks").cast("double").alias("mid")), "ts").select("ts", "mid", "band", "pct_tenths", F.col("depth_lots").alias("depth"))


def _all_batches(s, d):
    return view(s, d, "l2").select("symbol", "batch").distinct()


def _books(s, d):
    return book.top_levels(book.book_at(view(s, d, "l2"), _all_batches(s, d)), DEPTH)


def _published(s, b):
    """The books with known changes, so that every class of difference occurs."""
    deepest = F.max("rank").over(Window.partitionBy("symbol", "batch", "side"))
    b = b.withColumn("deepest", deepest)
    b = b.withColumn("size", F.when((F.col("rank") == 3) & (F.col("batch") % 50 == 0), F.col("size") + 1).otherwise(F.col("size")))
    b = b.withColumn("price", F.when((F.col("rank") == 1) & (F.col("side") == 0) & (F.col("batch") % 60 == 0), F.col("price") - 1).otherwise(F.col("price")))
    last = (F.col("side") == 1) & (F.col("rank") == F.col("deepest"))
    # a level less in some books, a level more in others
    more = F.when(last & (F.col("batch") % 110 == 0) & (F.col("rank") < DEPTH - 1), F.array(F.lit(0), F.lit(1))).when(last & (F.col("batch") % 70 == 0), F.array().cast("array<int>")).otherwise(F.array(F.lit(0)))
    x = b.withColumn("more", F.explode(more))
    return x.select("symbol", "batch", "side", (F.col("price") + F.col("more")).alias("price"), F.when(F.col("more") == 1, 1).otherwise(F.col("size")).alias("size"), (F.col("rank") + F.col("more")).alias("rank"))


def _compared(s, d):
    b = _books(s, d)
    return book.compare(b, _published(s, b), DEPTH)


def _l2_text(s, d):
    x = view(s, d, "l2")
    side = F.when(F.col("side") == 0, "bid").otherwise("ask")
    amount = F.concat(F.expr("cast(amount div 10 as string)"), F.lit("."), (F.col("amount") % 10).cast("string"))
    line = F.concat_ws(",", F.lit("x"), "symbol", F.col("ts_us").cast("string"), F.col("local_ts_us").cast("string"), F.when(F.col("seq") % 41 == 0, "maybe").otherwise(F.col("is_snapshot").cast("string")), F.when(F.col("seq") % 31 == 0, "middle").otherwise(side), F.concat(F.col("price").cast("string"), F.when(F.col("seq") % 29 == 0, ".05").otherwise(".5")), amount)
    return x.select(F.when(F.col("seq") % 37 == 0, F.concat(line, F.lit(",9"))).otherwise(line).alias("line"))


def _regime_labels(s, d):
    return regimes.terciles(regimes.daily_variance(_blocks(s, d)).withColumn("rv", F.round("rv", 12)), "rv")


def _did(s, d, hours):
    bars = _bars(s, d)
    picks = curves.hash_picks(s, FUNDING_REPS, 30, 30).groupBy("rep", F.col("start").alias("i")).agg(F.count(F.lit(1)).alias("w"))
    return regimes.window_difference(regimes.funding_replicates(regimes.funding_windows(bars, hours), regimes.day_index(bars), picks))


def d15_day_volume(s, d):
    return view(s, d, "trades").groupBy("symbol", "day").agg(F.sum(F.abs(blocks.signed_qty())).alias("volume"))


def d16_summary(s, d):
    t = F.col("type")
    return view(s, d, "order_feed").groupBy("symbol").agg(*[F.count_if(t == k).alias(f"n{k}") for k in range(5)], F.count_if(F.col("side") == 0).alias("bids"), F.avg("size").alias("mean_size"), F.avg("price").alias("mean_price"))


def d14_fill_stats(s, d):
    return regimes.window_stats(regimes.funding_windows(_bars(s, d)))


def _rings(s, d):
    return study.regime_rings(_blocks(s, d), blocks.minute_bars(view(s, d, "trades")), HOURS, T0)


def _regimes(s, d):
    b, rings = _blocks(s, d), _rings(s, d)
    return study.regime_stats(b, curves.cube(b, T0), rings, curves.ring_weights(rings, _lengths(s, d), REPS), BINS)


def j14_regime_curves(s, d):
    return curves.ring_curve(_cube(s, d), _rings(s, d))


def j13_activity_curves(s, d):
    lab = regimes.terciles(regimes.hour_counts(blocks.minute_bars(view(s, d, "trades"))), "trades").select("symbol", "hour", "tercile")
    c = curves.cube(_blocks(s, d), T0).withColumn("hour", F.expr("h % 24")).join(lab, ["symbol", "hour"])
    return curves.curve(c, ["tercile"])


def j16_contrast(s, d):
    return study.contrasts(*_regimes(s, d))


def b12_verdicts(s, d):
    c = _curve(s, d).withColumn("ring", F.lit("all"))
    return study.verdicts(c, curves.replicate_stats(_reps(s, d), c, BINS), BINS)


def _scaled(s, d):
    """(windows, cube, replicates) of all event scales, and of the clock scale."""
    event, clock = study.event_windows(_blocks(s, d)), study.clock_windows(_bars(s, d))
    out = []
    for w, probs in ((event, None), (clock, curves.CLOCK_PROBS)):
        c = curves.cube(w, T0, probs)
        out.append((w, c, curves.ring_replicates(c, _all_weights(w, study.scale_lengths(w, _lengths(s, d)))), probs))
    return out


def a24_curve_table(s, d):
    (a, b) = (study.curves_with_bands(w, c, r, probs) for w, c, r, probs in _scaled(s, d))
    return reports.curve_table(study.unnamed(a.unionByName(b)))


def j9_scale_fits(s, d):
    w, c, r, _ = _scaled(s, d)[0]
    return fit.master_fits(curves.curve(c).join(curves.ci_bands(r), ["symbol", "bin"], "left"))


def _equity(s, d):
    return equity.trades(view(s, d, "equity_messages"), view(s, d, "equity_books"))


def _equity_lengths(s, d):
    return curves.block_length(curves.acf(curves.hourly_flow(equity.event_blocks(_equity(s, d)), T0, HOURS), MAX_LAG), HOURS, MAX_LAG)


def d22_spikes(s, d):
    a = profiles.snapshot_profile(view(s, d, "l2"), "ts_us", every("ts", 1_000_000))
    return a.join(profiles.level_profile(view(s, d, "l2")).select("symbol", "snapshot_rows", "snapshot_share"), "symbol")


def _book_text(s, d, levels=3):
    """Book rows with some that are cut, broken or not as deep as others."""
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", "value")
    x = e.select("event_id", F.expr("100000 + cast(round(value * 100) as bigint)").alias("p"))
    n = F.col("event_id")
    price = lambda v: F.concat(F.expr(f"cast({v} div 10 as string)"), F.lit("."), F.expr(f"cast({v} % 10 as string)"))
    fields = [F.lit("x"), F.lit("S"), n.cast("string"), F.when(n % 31 == 0, "soon").otherwise((n + 7).cast("string"))]
    for k in range(levels):
        gone = (n % 5 == 0) & F.lit(k >= 2)
        fields += [F.when(gone, "").otherwise(price(f"(p + {1 + k})")), F.when(gone, "").when((n % 37 == 0) & F.lit(k == 1), "1e3").otherwise(F.lit(str(2 + k))), price(f"(p - {1 + k})"), F.lit(f"{k}.5")]
    line = F.concat_ws(",", *fields)
    return x.select(F.when(n % 41 == 0, F.concat(line, F.lit(","))).otherwise(line).alias("line"))


def a4_book_rows(s, d):
    x = feeds.parse_book_rows(_book_text(s, d), 3)
    return x.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("asks")).alias("asks"), F.sum(F.size("bids")).alias("bids"), F.sum(F.col("bids")[0]["price"]).alias("best_bids"), F.sum(F.col("asks")[1]["size"]).alias("second_sizes"))


def _order_book_text(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", F.expr("5000000 + cast(round(value * 100) as bigint)").alias("p"))
    n, t = F.col("event_id"), lambda c: c.cast("string")
    gone = n % 4 == 0
    line = F.concat_ws(",", t(F.col("p") + 1), F.lit("5"), t(F.col("p") - 1), F.when(n % 6 == 0, "0").otherwise("3"), F.when(gone, "9999999999").otherwise(t(F.col("p") + 2)), F.when(gone, "0").otherwise("7"), F.lit("-9999999999"), F.when(n % 23 == 0, "1.5").otherwise("0"))
    return e.select(F.when(n % 29 == 0, F.substring_index(line, ",", 7)).otherwise(line).alias("line"))


def a6_order_books(s, d):
    x = feeds.parse_order_book_rows(_order_book_text(s, d), 2)
    return x.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("asks")).alias("asks"), F.sum(F.size("bids")).alias("bids"), F.sum(F.col("asks")[0]["price"]).alias("best_asks"))


def _broken_tape(s, d):
    x = feeds.tape_lines(view(s, d, "order_feed"))
    n = F.col("seq")
    broken = F.when(n % 43 == 0, F.concat(F.lit("Z"), F.substring("line", 2, 1000))).when(n % 47 == 0, F.regexp_replace("line", " [BS] ", " X ")).when(n % 53 == 0, F.regexp_replace("line", "[0-9]$", "y")).when(n % 59 == 0, F.concat(F.lit("# "), "line"))
    return x.select(F.coalesce(broken, F.when(n % 61 == 0, F.concat(F.lit("  "), "line", F.lit("  more"))), "line").alias("line"))


def a5_order_status(s, d):
    x = view(s, d, "order_feed")
    t = lambda e: F.expr(e).cast("string")
    seconds = F.concat(t("ts_us % 86400000000 div 1000000"), F.lit("."), F.lpad(t("ts_us % 1000000"), 6, "0"), F.lit("551"))
    n = F.col("seq")
    kind = F.when(n % 31 == 0, "6").otherwise(F.element_at(F.array(*map(F.lit, "12345")), F.col("type") + 1))
    line = F.concat_ws(",", seconds, kind, t("order_id"), F.when(n % 43 == 0, "1e2").otherwise(t("size")), t("price * 100"), F.when(n % 41 == 0, "0").when(F.col("side") == 0, "1").otherwise("-1"))
    p = feeds.parse_orders(x.select(F.when(n % 37 == 0, F.concat(line, F.lit(","))).otherwise(line).alias("line")))
    return p.groupBy("status").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("ts_us", "type", "order_id", "size", "price", "side")])


def a11_mid_csv(s, d):
    path = _scratch(s, "quotes")
    q = view(s, d, "quotes").select(F.col("ts_us").alias("timestamp"), F.lit("x").alias("exchange"), F.col("ask_ticks").alias("asks[0].price"), F.col("bid_ticks").alias("bids[0].price"))
    q.write.option("header", True).option("compression", "gzip").csv(path)
    return feeds.read_mid_csv(s, path).select(F.unix_micros("timestamp").alias("ts_us"), "midprice")


def a13_band_snapshots(s, d):
    b = view(s, d, "bands").where("not (hour(hour_ts) % 5 = 0 and band = 3)")
    raw = b.select(F.col("hour_ts").cast("timestamp").alias("timestamp"), (F.col("pct_tenths") / 10).alias("percentage"), (F.col("depth_lots") / 1000).alias("depth"))
    x = feeds.band_snapshots(raw, "2024-01-03 00:00:00", "2024-01-20 12:00:00", window_codec.BANDS)
    return x.select(F.unix_micros("timestamp").alias("ts_us"), F.posexplode("depth").alias("band", "depth"))


def a17_run(s, d):
    t = view(s, d, "trades").groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("rows"))
    raw = t.select("symbol", "day", "rows", F.when(F.dayofmonth("day") % 7 == 0, "cut off").alias("error"))
    done = t.where("day(day) % 3 = 0").select("symbol", "day", F.lit("reduced").alias("status"), (F.dayofmonth("day") % 2 == 0).alias("raw_deleted"))
    return store.run_outcomes(feeds.day_spine(s, ["AAA", "BBB", "CCC"], "2024-01-01", "2024-01-30"), done, raw)


def _scratch(s, name):
    """A fresh folder beside the checkpoints, or a temporary one where none is set (tests)."""
    import tempfile
    import uuid

    return f"{(s.conf.get('spark.checkpoint.dir', None) or tempfile.gettempdir()).rstrip('/')}/tideline-{name}-{uuid.uuid4().hex}"


def a19_day_store(s, d):
    path = _scratch(s, "days")
    store.write_days(view(s, d, "trades"), path, ("ts_us", "id"))
    days = store.read_days(s, path, "AAA", "2024-01-05", "2024-01-20")
    return days.select("symbol", "day", "id", "ts_us", "price_ticks", "qty_lots", "is_buyer_maker")


def a23_index(s, d):
    w = _windows(s, d).where("day % 4 = 1")
    files = window_codec.decode_windows(window_codec.encode_windows(w)).select(F.concat(F.lit("BTCUSDT-"), F.col("day").cast("string")).alias("file"), "window")
    specs = w.select(F.concat(F.lit("BTCUSDT-"), F.col("day").cast("string")).alias("file"), "symbol", "day", F.lit("every fourth day").alias("reason"))
    int_day = F.date_format("day", "yyyyMMdd").cast("int").alias("day")
    lab = _regime_labels(s, d).where("symbol = 'AAA'").select(F.lit("BTCUSDT").alias("symbol"), int_day, "rv", "tercile")
    volume = d15_day_volume(s, d).where("symbol = 'AAA'").select(F.lit("BTCUSDT").alias("symbol"), int_day, F.col("volume").cast("double").alias("volume"))
    return reports.window_index(files, specs, lab.join(volume, ["symbol", "day"]))


def h8_checksums(s, d):
    text = F.concat_ws("-", "symbol", F.col("day").cast("string"), F.col("volume").cast("string"))
    return d15_day_volume(s, d).select("symbol", "day", sc.fnv1a_hex(text).alias("checksum"))


def h9_epochs(s, d):
    ts = F.timestamp_micros("ts_us")
    return view(s, d, "trades").select("id", F.expr("ts_us div 1000").alias("ms"), F.date_format(ts, "yyyyMMdd").cast("int").alias("day_int"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


def b11_crosses(s, d):
    side = (F.col("id") % 2).cast("int")
    price = F.col("bid_ticks") + F.col("id") % 9 - 2
    resting = F.when(side == 0, F.col("bid_ticks")).otherwise(F.col("ask_ticks"))
    return view(s, d, "quotes").select("id", sc.crosses(side, resting, price).alias("crosses"))


def i22_exit_gate(s, d):
    stats = adapters.replay_levels(view(s, d, "l2"), every=1 << 40).where("batch is null")
    parsed = feeds.parse_levels(_l2_text(s, d))
    return adapters.exit_clean(stats).withColumn("gate", F.lit("replay")).unionByName(adapters.exit_clean(stats, parsed).withColumn("gate", F.lit("with parsing")))


def j15_did(s, d):
    a, b = _did(s, d, regimes.FUNDING_HOURS), _did(s, d, regimes.OTHER_HOURS)
    cols = ("d_mean_abs_ofi", "d_mean_abs_r", "d_slope")
    return a.join(b.select("symbol", "rep", *[F.col(c).alias(f"o_{c}") for c in cols]), ["symbol", "rep"]).select("symbol", "rep", *cols, *[(F.col(c) - F.col(f"o_{c}")).alias(f"di{c}") for c in cols])


def j15_funding_ci(s, d):
    return regimes.funding_ci(_did(s, d, regimes.FUNDING_HOURS), _did(s, d, regimes.OTHER_HOURS))


def j11_placebo_corr(s, d):
    b = _blocks(s, d)
    real = curves.curve(curves.cube(b, T0))
    v = curves.placebo_verdict(curves.placebo(b, SHIFTS), real, b, curves.ci_bands(_reps(s, d)))
    return v.select("symbol", *[F.round(c, n).alias(c) for c, n in (("max_z", 5), ("mean_corr", 5), ("max_corr", 5), ("amplitude", 8), ("real", 8), ("ratio", 4))], "passed")


def j17_proxy_curve(s, d):
    p = _proxy(s, d)
    diff = p.withColumn("r", F.col("r") - F.col("r_mid"))
    c = curves.curve(curves.cube(diff, T0))
    return c.select("symbol", "bin", "n", F.col("mean_r").alias("mean_diff"))


def j17_proxy_clear(s, d):
    p = _proxy(s, d)
    c = curves.cube(p.withColumn("r", F.col("r") - F.col("r_mid")), T0)
    one = p.select("symbol").distinct().withColumn("block_length", F.lit(1))
    return study.clear_of_zero(curves.ci_bands(curves.ring_replicates(c, _all_weights(p, one))), curves.curve(c))


def d17_proxy_headline(s, d):
    a = curves.curve(curves.cube(_proxy(s, d), T0)).select("symbol", "bin", F.col("mean_r").alias("a"))
    b = curves.curve(curves.cube(_proxy(s, d).withColumn("r", F.col("r_mid")), T0)).select("symbol", "bin", F.col("mean_r").alias("b"))
    return a.join(b, ["symbol", "bin"]).groupBy("symbol").agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_abs_diff"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_abs_diff"), F.max(F.abs("b")).alias("amplitude"))


def d6_proxy_scale(s, d):
    return equity.derive_scale(_proxy(s, d), 2, contiguous=True)


def b1_scaled_decimal(s, d):
    li = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_partkey")
    k = F.col("l_partkey") % 9
    whole = F.col("l_orderkey").cast("string")
    text = F.when(k == 0, F.concat(whole, F.lit(".25"))).when(k == 1, F.concat(F.lit("-"), whole, F.lit(".500"))).when(k == 2, F.concat(F.lit("+"), whole)).when(k == 3, F.concat(whole, F.lit(".0625"))).when(k == 4, F.concat(whole, F.lit("e5"))).when(k == 5, F.lit(".75")).when(k == 6, F.concat(F.lit(" "), whole)).when(k == 7, F.concat(F.lit("1234567890123456"), F.lpad(whole, 6, "0"))).otherwise(F.lit("."))
    x = li.select("l_orderkey", "l_linenumber", "l_partkey", text.alias("text")).distinct()
    return x.withColumn("status", sc.decimal_status(F.col("text"), 3)).withColumn("value", sc.scaled_decimal(F.col("text"), 3))


def l2_message_kinds(s, d):
    m = engine.with_reset_episode(view(s, d, "order_feed"))
    p = F.lag("size").over(Window.partitionBy("symbol", "order_id").orderBy("seq"))
    t = F.lag("type").over(Window.partitionBy("symbol", "order_id").orderBy("seq"))
    live = F.when(t.isin(0, 1), p).otherwise(0)
    x = m.where("type in (0, 1, 2)").withColumn("live", F.coalesce(live, F.lit(0)))
    kind = F.when(F.col("type") == 0, "add").when(F.col("type") == 2, "delete").when(F.col("size") > F.col("live"), "grow").when((F.col("size") < F.col("live")) & (F.col("size") > 0), "shrink").otherwise("noop")
    return x.groupBy("symbol", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def e6_delta_codec(s, d):
    w = Window.partitionBy("band").orderBy("hour_ts")
    b = view(s, d, "bands").withColumn("delta", F.col("depth_lots") - F.coalesce(F.lag("depth_lots").over(w), F.lit(0)))
    return b.withColumn("back", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("hour_ts", "band", "delta", F.col("back").cast("long").alias("back"))


def a16_manifest_pending(s, d):
    t = view(s, d, "trades").select("symbol", "day").distinct()
    done = t.where("day(day) % 3 <> 0").select("symbol", "day", F.lit(True).alias("reduced"), (F.dayofmonth("day") % 5 != 0).alias("raw_deleted"))
    return feeds.pending(feeds.day_spine(s, ["AAA", "BBB", "CCC"], "2024-01-01", "2024-01-30"), done)


def c10_unaligned(s, d):
    p = view(s, d, "l2").select("symbol", F.when(F.col("batch") % 9 == 0, F.col("ts_us") + 1).otherwise(F.col("ts_us")).alias("ts_us"), "local_ts_us").distinct()
    return book.unaligned(p, view(s, d, "l2"))


def k3_schedule(s, d):
    sn = _snapshots(s, d)
    return execution.schedule(sn, execution.pick_slices(sn.select("ts").distinct(), 12), "buy", 60000.0, 12, 0.5, 0.05, 1_000_000.0)


def k2_walk_book(s, d):
    return execution.walk(_snapshots(s, d), "sell", F.lit(3000.0), 0.5)


def k6_seed(s, d):
    return execution.seed_ladder(_snapshots(s, d))


def k4_sqrt(s, d):
    return d15_day_volume(s, d).select("symbol", "day", sc.sqrt_cost(F.lit(100.0), F.lit(0.05), F.col("volume")).alias("cost"))


def f4_percentiles(s, d):
    return profiles.selected(view(s, d, "order_feed"), "size", [50, 99])


def i3_fills(s, d):
    return engine.run_engine(view(s, d, "order_feed")).where("kind = 'fill'").select("symbol", "seq", "ts_us", "aggressor", "order_id", "side", "price", "size")


def i9_invariants(s, d):
    x = engine.run_engine(view(s, d, "order_feed"), check_every=25)
    kinds = x.groupBy("symbol").agg(F.count_if(F.col("kind") == "violation").alias("violations"), F.count_if(F.col("kind") == "fill").alias("fills"))
    return kinds.join(engine.engine_totals(x), "symbol")


def i2_engine_counts(s, d):
    x = engine.run_engine(view(s, d, "order_feed"), check_every=25)
    bad = x.groupBy("symbol").agg(F.count_if(F.col("kind") == "violation").alias("violations"))
    t = engine.engine_totals(x).join(bad, "symbol")
    return t.select("symbol", "messages", "trades", "snapshot_resets", (F.col("adds") + F.col("modifies") + F.col("deletes") + F.col("rejected")).alias("others"), "violations", "residual")


def i16_orders(s, d):
    f = view(s, d, "order_feed").withColumn("type", F.element_at(F.array(*[F.lit(v) for v in (1, 2, 3, 4, 5)]), F.col("type") + 1))
    return adapters.replay_orders(f)


def i13_hazard(s, d):
    return adapters.replay_levels(view(s, d, "l2_hazard"))


def i13_two_pass(s, d):
    x = adapters.replay_levels(view(s, d, "l2"), depth=DEPTH).where("batch is not null")
    return x.select("symbol", "batch", "side", "rank", "price", "size")


def i21_single_step(s, d):
    b = book.ranked(book.book_at(view(s, d, "l2"), view(s, d, "l2").select("symbol", "batch").distinct()))
    lv = b.groupBy("symbol", "batch").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == k, F.struct("rank", "price", "size")))), lambda v: F.struct(v["price"].alias("price"), v["size"].alias("size"))).alias(n) for k, n in ((0, "bids"), (1, "asks"))])
    w = Window.partitionBy("symbol").orderBy("batch")
    rows = lv.withColumn("next_bids", F.lead("bids").over(w)).withColumn("next_asks", F.lead("asks").over(w)).where("next_bids is not null")
    rows = rows.select("symbol", F.col("batch").alias("row_index"), F.col("batch").alias("ts_us"), F.lit(1).alias("type"), F.col("batch").alias("order_id"), F.lit(3).cast("long").alias("size"), F.lit(9990).cast("long").alias("price"), F.lit(0).alias("side"), "bids", "asks", "next_bids", "next_asks")
    return adapters.single_step(rows)


def k5_inject(s, d):
    m = view(s, d, "order_feed")
    last = m.groupBy("symbol").agg((F.max("seq") + 1).alias("seq"), F.max("ts_us").alias("ts_us"))
    ioc = last.select("symbol", "seq", "ts_us", F.lit(0).alias("type"), F.lit(1 << 60).alias("order_id"), F.lit(0).alias("side"), F.lit(1 << 60).alias("price"), F.lit(25).cast("long").alias("size"))
    gone = ioc.select("symbol", (F.col("seq") + 1).alias("seq"), "ts_us", F.lit(2).alias("type"), "order_id", "side", "price", "size")
    return engine.run_engine(m.unionByName(ioc).unionByName(gone)).where((F.col("kind") == "fill") & (F.col("aggressor") == 1 << 60)).select("symbol", "order_id", "price", "size")


def j9_master_fit(s, d):
    return fit.master_fits(_curve(s, d))


def a9_tape(s, d):
    return engine.checksum(engine.run_engine(tape.tape(s, {"T1": 20260808, "T2": 7}, 2000)))


def a7_tape_text(s, d):
    return feeds.read_tape(_broken_tape(s, d)).groupBy("status", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.sum("price").alias("prices"), F.sum("order_id").alias("ids"))


def _windows(s, d):
    b = view(s, d, "bands").withColumn("ms", F.expr("unix_millis(cast(hour_ts as timestamp))"))
    snaps = b.groupBy("ms").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "depth_lots"))), lambda v: v["depth_lots"].cast("long")).alias("depth"))
    snaps = snaps.groupBy(F.expr("ms div 86400000").alias("k")).agg(F.array_sort(F.collect_list(F.struct(F.col("ms").alias("ts"), "depth"))).alias("snapshots"))
    t = view(s, d, "trades").where("symbol = 'AAA'").select(F.expr("ts_us div 1000").alias("ts"), F.col("price_ticks").alias("price"), blocks.signed_qty().alias("qty"))
    tr = t.groupBy(F.expr("ts div 86400000").alias("k")).agg(F.array_sort(F.collect_list(F.struct("ts", "price", "qty"))).alias("trades"))
    return snaps.join(tr, "k").select(F.lit("BTCUSDT").alias("symbol"), F.date_format(F.date_from_unix_date(F.col("k").cast("int")), "yyyyMMdd").cast("int").alias("day"), (F.col("k") * 86400000).alias("start_ms"), ((F.col("k") + 1) * 86400000).alias("end_ms"), F.lit(10).alias("price_scale"), F.lit(1000).alias("qty_scale"), "snapshots", "trades")


def a20_codec(s, d):
    out = window_codec.decode_windows(window_codec.encode_windows(_windows(s, d)))
    w = F.col("window")
    return out.select("day", F.size(w.snapshots).alias("snapshots"), F.size(w.trades).alias("trades"), F.aggregate(w.trades, F.lit(0).cast("long"), lambda a, x: a + x["qty"]).alias("qty"), (w.snapshots == F.col("snapshots")).alias("snapshots_equal"), (w.trades == F.col("trades")).alias("trades_equal"))


R = rounded
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "d1_event_blocks": lambda s, d: R(_blocks(s, d)),
    "d2_minute_bars": lambda s, d: blocks.minute_bars(view(s, d, "trades")),
    "d3_minute_response": lambda s, d: R(_bars(s, d)),
    "d4_derive_scale": lambda s, d: R(blocks.derive_scale(_blocks(s, d), 2)),
    "e3_window_duration": lambda s, d: R(blocks.with_duration(_blocks(s, d))),
    "e4_duration_filled": lambda s, d: R(blocks.with_duration(_blocks(s, d), True)),
    "h3_edges": lambda s, d: curves.edges(_blocks(s, d)).select("symbol", F.posexplode("edges").alias("k", "edge")),
    "d7_cube": lambda s, d: R(_cube(s, d)),
    "d8_impact_curve": lambda s, d: R(_curve(s, d)),
    "d8_clock_curve": lambda s, d: R(curves.curve(curves.cube(_bars(s, d).where("r is not null").select("symbol", F.col("m").alias("t"), F.col("ofi").alias("q"), "r"), T0, curves.CLOCK_PROBS))),
    "d10_pinning": lambda s, d: R(curves.binned(blocks.with_duration(_blocks(s, d))).groupBy("symbol", "bin").agg(F.avg((F.col("r") == 0).cast("int")).alias("frac_zero"), F.avg("dt_s").alias("mean_duration")), 5),
    "j20_pilot_curve": lambda s, d: (lambda e, t: R(pilot.response_curve(pilot.bin_flow(t, e, blocks.HOUR), pilot.bin_response(e, t, "price_ticks", "id"))))(*_hour_edges(s, d)),
    "c1_bin_flow": lambda s, d: (lambda e, t: pilot.bin_flow(t, e, blocks.HOUR))(*_hour_edges(s, d)),
    "c2_asof_edge_price": lambda s, d: (lambda e, t: pilot.edge_prices(e, t, "price_ticks", "id"))(*_hour_edges(s, d)),
    "c3_asof_mid": lambda s, d: _with_mid(s, d).select("symbol", "day", "bi", "mid"),
    "g3_bin_spine": lambda s, d: _hour_edges(s, d)[0],
    "c10_unaligned": c10_unaligned,
    "c14_circular_pairs": lambda s, d: R(curves.circular_pairs(_blocks(s, d), SHIFTS)),
    "d11_daily_rv": lambda s, d: R(regimes.daily_variance(_blocks(s, d)), 10),
    "h6_vol_terciles": lambda s, d: _regime_labels(s, d).select("symbol", "day", "tercile"),
    "d12_hour_counts": lambda s, d: regimes.hour_counts(blocks.minute_bars(view(s, d, "trades"))),
    "d13_hourly_flow": lambda s, d: curves.hourly_flow(_blocks(s, d), T0, HOURS),
    "b10_funding_tags": lambda s, d: R(regimes.funding_windows(_bars(s, d))),
    "d14_window_stats": lambda s, d: R(d14_fill_stats(s, d), 6),
    "j3_acf": lambda s, d: R(_acf(s, d)),
    "j3_block_length": _lengths,
    "j4_bootstrap_curve": lambda s, d: R(_reps(s, d).drop("ring")),
    "j5_ci_bands": lambda s, d: R(curves.ci_bands(_reps(s, d))),
    "j6_gamma": lambda s, d: R(curves.gamma(_curve(s, d)), 6),
    "j7_slope": lambda s, d: R(curves.central_slope(_curve(s, d)), 9),
    "j8_turnover": lambda s, d: R(curves.turnover(_curve(s, d), BINS)),
    "j10_placebo": lambda s, d: R(curves.placebo(_blocks(s, d), SHIFTS)),
    "j11_placebo_corr": j11_placebo_corr,
    "j13_activity_curves": lambda s, d: R(j13_activity_curves(s, d)),
    "j14_regime_curves": lambda s, d: R(j14_regime_curves(s, d)),
    "j14_regime_stats": lambda s, d: R(_regimes(s, d)[0], 9),
    "j15_funding_did": lambda s, d: R(j15_did(s, d), 6),
    "j15_funding_ci": lambda s, d: R(j15_funding_ci(s, d), 6),
    "j16_contrast": lambda s, d: R(j16_contrast(s, d), 9),
    "b12_verdicts": lambda s, d: R(b12_verdicts(s, d), 6),
    "j19_proxy_ratios": lambda s, d: R(study.proxy_ratios(curves.ci_bands(_reps(s, d)), PROXY_MEAN_ERROR, PROXY_MAX_ERROR), 7),
    "j17_proxy_clear": j17_proxy_clear,
    "a24_curve_table": lambda s, d: R(a24_curve_table(s, d), 7),
    "a12_midprices": lambda s, d: R(equity.midprices(view(s, d, "equity_books"))),
    "c6_equity_trades": lambda s, d: R(_equity(s, d)),
    "d16_equity_summary": lambda s, d: R(equity.summary(view(s, d, "equity_messages"), _equity(s, d)), 6),
    "d5_equity_blocks": lambda s, d: R(equity.event_blocks(_equity(s, d))),
    "d6_equity_scale": lambda s, d: R(equity.derive_scale(equity.event_blocks(_equity(s, d)), 2)),
    "j18_equity_curves": lambda s, d: R(equity.response_curves(equity.event_blocks(_equity(s, d)), T0, HOURS, _equity_lengths(s, d), EQUITY_REPS), 7),
    "j18_equity_analysis": lambda s, d: R(equity.analysis(equity.event_blocks(_equity(s, d)), T0, HOURS, _equity_lengths(s, d), EQUITY_REPS), 6),
    "a4_book_rows": a4_book_rows,
    "a5_order_status": a5_order_status,
    "a6_order_books": a6_order_books,
    "a11_mid_csv": lambda s, d: R(a11_mid_csv(s, d)),
    "a13_band_snapshots": a13_band_snapshots,
    "a14_window_trades": lambda s, d: store.window_trades(view(s, d, "trades"), T0 + 5 * blocks.HOUR, T0 + 200 * blocks.HOUR),
    "a17_run_outcomes": a17_run,
    "a19_day_store": a19_day_store,
    "a23_window_index": lambda s, d: R(a23_index(s, d), 9),
    "a28_level_messages": lambda s, d: adapters.level_messages(view(s, d, "l2")),
    "b11_crosses": b11_crosses,
    "d22_feed_profile": lambda s, d: R(d22_spikes(s, d)),
    "d22_trade_profile": lambda s, d: R(profiles.trade_profile(view(s, d, "trades")), 6),
    "d22_value_counts": lambda s, d: profiles.value_counts(view(s, d, "order_feed"), "size"),
    "f5_spread": lambda s, d: profiles.spread_permille(view(s, d, "order_feed"), "size"),
    "f6_examples": lambda s, d: profiles.first_examples(_compared(s, d)),
    "h8_checksums": h8_checksums,
    "h9_epochs": h9_epochs,
    "i20_whole_batches": lambda s, d: adapters.whole_batches(view(s, d, "l2"), 5003).select("symbol", "seq", "batch"),
    "i22_exit_gate": i22_exit_gate,
    "j9_scale_fits": lambda s, d: R(j9_scale_fits(s, d)),
    "k7_readbacks": lambda s, d: engine.readbacks(engine.run_engine(view(s, d, "order_feed"))),
    "j17_proxy_diff": lambda s, d: R(j17_proxy_curve(s, d)),
    "d17_proxy_headline": lambda s, d: R(d17_proxy_headline(s, d)),
    "d6_proxy_scale": lambda s, d: R(d6_proxy_scale(s, d)),
    "d15_day_volume": d15_day_volume,
    "d16_summary": lambda s, d: R(d16_summary(s, d)),
    "b1_scaled_decimal": b1_scaled_decimal,
    "b2_level_id": lambda s, d: view(s, d, "l2").select("seq", sc.level_id(F.col("price"), F.col("side")).alias("level_id")),
    "a3_l2_status": lambda s, d: feeds.parse_levels(_l2_text(s, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("price"), F.sum("amount").alias("amount")),
    "i11_batches": lambda s, d: book.batch_sessions(view(s, d, "l2")).groupBy("symbol", "session").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")),
    "i13_l2_book": lambda s, d: book.ranked(book.book_at(view(s, d, "l2"), _all_batches(s, d))),
    "i13_two_pass": i13_two_pass,
    "i13_counts": lambda s, d: book.adapter_counts(view(s, d, "l2")),
    "i13_guard": lambda s, d: book.guard(view(s, d, "l2")),
    "f1_top_levels": _books,
    "i18_book_compare": _compared,
    "d19_tally": lambda s, d: book.tally(_compared(s, d)),
    "d20_ppm": lambda s, d: _compared(s, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("class") == "None").alias("exact")).withColumn("ppm", sc.ppm(F.col("exact"), F.col("compared"))).withColumn("pct", sc.percent_text(F.col("ppm"))),
    "d22_episodes": lambda s, d: book.episodes(view(s, d, "l2")),
    "l2_message_kinds": l2_message_kinds,
    "f4_percentiles": f4_percentiles,
    "f7_slices": lambda s, d: execution.pick_slices(_snapshots(s, d).select("ts").distinct(), 12),
    "k2_walk_book": lambda s, d: R(k2_walk_book(s, d), 6),
    "k3_schedule": lambda s, d: R(k3_schedule(s, d), 6),
    "k4_sqrt_reference": lambda s, d: R(k4_sqrt(s, d)),
    "k6_seed_ladder": k6_seed,
    "e6_delta_codec": e6_delta_codec,
    "a16_manifest_pending": a16_manifest_pending,
    "i2_engine_counts": i2_engine_counts,
    "i3_fills": i3_fills,
    "i9_invariants": i9_invariants,
    "i13_hazard": i13_hazard,
    "i16_order_feed": i16_orders,
    "i21_single_step": i21_single_step,
    "k5_inject": k5_inject,
    "j9_master_fit": lambda s, d: R(j9_master_fit(s, d)),
    "a7_tape_text": a7_tape_text,
    "a20_iwd1_roundtrip": a20_codec,
    "a27_checksum": a9_tape,
    "a27_feed_checksum": lambda s, d: engine.checksum(engine.run_engine(view(s, d, "order_feed"))),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
