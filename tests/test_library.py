"""Every query with checking SQL against DuckDB, feeds, codec, fit and streaming."""

import glob
import gzip
import math
import os

import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tideline.functions import scalars as sc
from tideline.operators import adapters, engine, fit
from tideline.operators.curves import curve
from tideline.plans import catalogue, oracles
from tideline.sources import feeds, tape, window_codec
from tideline.sources.views import view


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    r = duck.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == sorted(repr([plain(x[names.index(c)]) for c in cols]) for x in r.fetchall())


DECIMALS = [("62859.9", 1, 628599), ("1.776", 3, 1776), ("62860", 1, 628600), ("0", 3, 0), ("0.5", 3, 500), ("0.0010", 3, 1), (".25", 2, 25), ("-1.5", 1, -15), ("+2", 1, 20)]
BAD = [("1.7765", 3, "PrecisionLoss"), ("62859.95", 1, "PrecisionLoss"), *[(t, 1, "Malformed") for t in ("", "1e5", "1.2.3", " 1.2", "1.2 ", "abc", ".", "-")], ("12345678901234567890", 0, "Overflow"), ("123456789012345678", 3, "Overflow"), (None, 1, "Malformed")]


def test_exact_decimals(spark):
    for decimals in (0, 1, 2, 3):
        rows = [(t,) for t, d, _ in [*DECIMALS, *BAD] if d == decimals]
        got = {r.t: (r.s, r.v) for r in spark.createDataFrame(rows, "t string").select("t", sc.decimal_status(F.col("t"), decimals).alias("s"), sc.scaled_decimal(F.col("t"), decimals).alias("v")).collect()}
        for t, d, v in DECIMALS:
            assert d != decimals or got[t] == ("Ok", v)
        for t, d, s in BAD:
            assert d != decimals or got[t] == (s, None)


def test_feed_status(spark):
    lines = ["x,S,1,2,true,bid,1.0", "x,S,1,2,true,middle,1.0,2", "x,S,1,2,maybe,bid,1.0,2", "x,S,1,2,true,bid,1.05,2", "x,S,1,2,false,ask,100.1,2.5"]
    got = [r.status for r in feeds.parse_levels(spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1)).collect()]
    assert got == ["FieldCount", "BadSide", "BadFlag", "BadNumber", "Ok"]
    r = feeds.parse_orders(spark.createDataFrame([("34200.025551909,1,16120456,18,5859100,-1",)], "line string")).first()
    assert (r.status, r.ts_us, r.type, r.order_id, r.size, r.price, r.side) == ("Ok", 34200025551, 1, 16120456, 18, 5859100, 1)


def test_book_rows_end_at_the_first_gap(spark):
    line = ",".join(["x", "S", "1", "2", "1.1", "2", "1.0", "3", "1.2", "4", "", "", "", "", "0.8", "1"])
    got = feeds.parse_book_snapshots(spark.createDataFrame([(line,)], "line string"), 3).select("side", "rank", "price", "size").collect()
    assert sorted(map(tuple, got)) == [(0, 0, 10, 3000), (1, 0, 11, 2000), (1, 1, 12, 4000)]
    line = ",".join(["5", "1", "4", "2", "9999999999", "0", "-9999999999", "0"])
    got = feeds.parse_order_books(spark.createDataFrame([(line,)], "line string"), 2).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 4, 2), (1, 0, 5, 1)]


def test_tape_round_trip(spark, tmp_path):
    m = tape.tape(spark, {"A": 20260808}, 300)
    feeds.tape_lines(m).select("line").write.option("compression", "gzip").text(str(tmp_path / "t"))
    back = feeds.read_tape(feeds.read_lines(spark, str(tmp_path / "t")))
    key = lambda r: (r.ts_us, r.type, r.order_id, r.price, r.size)
    assert sorted(map(key, back.collect())) == sorted(map(key, m.collect()))


def test_codec():
    snaps = [(1000 + 30 * i, [i * j for j in range(12)]) for i in range(5)]
    trades = [(1000 + i, 100 + i, (-1) ** i * i) for i in range(7)]
    raw = window_codec.encode("BTCUSDT", 20260425, 1000, 9000, 10, 1000, snaps, trades)
    assert len(raw) == 67 + 5 * 52 + 7 * 12
    for x in (raw, gzip.compress(raw)):
        w = window_codec.decode(x)
        assert w["snapshots"] == snaps and w["trades"] == trades and w["day"] == 20260425
    for broken in (b"nope", raw[:-1], raw[:4] + b"\x02" + raw[5:], raw + b"0"):
        with pytest.raises(ValueError, match=r"."):
            window_codec.decode(broken)
    with pytest.raises(OverflowError):
        window_codec.encode("BTCUSDT", 1, 0, 1, 1, 1, [], [(0, 2**31, 0)])


def test_fit_recovers_the_curve():
    q = np.linspace(-50, 50, 21)
    a = fit.fit_master(q, fit.model(q, np.array([2e-3, 8.0, 1.3, 1.1])))
    assert a[4] < 1e-6
    assert np.isnan(fit.fit_master(q[:3], q[:3])).all()


def test_two_pass_equals_relations_and_hazard_differs(spark):
    stats = {r.note: r.n for r in adapters.replay_levels(view(spark, SF, "l2")).where("batch is null").groupBy("note").agg(F.sum("size").alias("n")).collect()}
    assert stats["evictions"] == stats["fills"] == stats["violations"] == 0
    hazard = {r.note: r.n for r in adapters.replay_levels(view(spark, SF, "l2_hazard")).where("batch is null").groupBy("note").agg(F.sum("size").alias("n")).collect()}
    assert hazard["evictions"] > 0 and hazard["fills"] == hazard["violations"] == 0


def test_conservation_and_clean(spark):
    x = catalogue.queries()["i9_invariants"](spark, SF).collect()
    assert all(r.violations == 0 for r in x)
    o = {(r.symbol, r.note): r["size"] for r in catalogue.queries()["i16_order_feed"](spark, SF).collect()}
    assert all(v == 0 for (_, n), v in o.items() if n == "residual")


def test_stream_equals_batch(spark, tmp_path):
    from tideline.streaming.book import stream_fills

    m = view(spark, SF, "order_feed").where("type <> 4")
    src = str(tmp_path / "in")
    m.repartitionByRange(3, "seq").sortWithinPartitions("seq").write.parquet(src)
    s = stream_fills(spark.readStream.schema(m.schema).parquet(src))
    q = s.writeStream.format("memory").queryName("fills").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    fills = engine.run_engine(m).where("kind = 'fill'").count()
    assert spark.table("fills").where("kind = 'fill'").count() == fills == spark.table("fills").count()


def test_stream_counts_late_messages(spark, tmp_path):
    from tideline.streaming.book import stream_fills

    m = view(spark, SF, "order_feed").where("type <> 4 and symbol = 'AAA'").limit(60).coalesce(1)
    rows = sorted(m.collect(), key=lambda r: r.seq)
    src = str(tmp_path / "in")
    for part in (rows[:40], rows[30:]):  # ten come twice
        spark.createDataFrame(part, m.schema).coalesce(1).write.mode("append").parquet(src)
        q = stream_fills(spark.readStream.schema(m.schema).parquet(src)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = engine.run_engine(spark.createDataFrame(rows, m.schema)).where("kind = 'fill'").count()
    assert got.where("kind = 'late'").count() == 10 and got.where("kind = 'fill'").count() == want


def test_empty_inputs(spark):
    none = view(spark, SF, "trades").limit(0)
    from tideline.operators import blocks

    assert blocks.event_blocks(none).count() == blocks.minute_bars(none).count() == 0
    assert curve(spark.createDataFrame([], "symbol string, bin int, n long, sq double, sr double, sr2 double")).count() == 0
    assert engine.run_engine(view(spark, SF, "order_feed").limit(0)).count() == 0
    assert sc.fnv1a(b"") == 0xCBF29CE484222325
