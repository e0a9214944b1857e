"""Ordered helpers, the day store, reports, profiles, adapters and the equity layer against plain Python."""

import gzip
import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import adapters, book, engine, equity, ordered, profiles, study
from tideline.operators.adapters import LevelAdapter, OrderAdapter
from tideline.operators.asof import asof_backward
from tideline.operators.engine import ADD, DELETE, RESET, Engine
from tideline.sources import feeds, reports, store, tape, window_codec


def walk(seed, n=400):
    r = np.random.default_rng(seed)
    return [("ab"[int(r.integers(2))], i, int(r.integers(-5, 9)) if r.integers(3) else None) for i in sorted(r.choice(5000, n, replace=False).tolist())]


@pytest.mark.parametrize("width", [1, 7, 100, 10_000])
def test_chunks_along_an_order(spark, width):
    """Sums, carried values, successors and predecessors are the same however the order is cut."""
    rows = walk(width)
    d = spark.createDataFrame(rows, "k string, i long, v int")
    chunk = ordered.every("i", width)
    got = ordered.running_sum(d, "total", F.coalesce("v", F.lit(0)).cast("long"), ["k"], ["i"], chunk)
    got = ordered.running_number(got, "place", ["k"], ["i"], chunk)
    got = ordered.carried(got, "seen", F.col("v"), ["k"], ["i"], chunk)
    got = ordered.following(got, "after", F.col("i"), ["k"], ["i"], chunk)
    got = ordered.previous(got, "before", F.col("v"), ["k"], ["i"], chunk)
    want = []
    for k in "ab":
        own, total, seen = [r for r in rows if r[0] == k], 0, None
        for n, (_, i, v) in enumerate(own):
            total, seen = total + (v or 0), seen if v is None else v
            want.append((k, i, v, total, n, seen, own[n + 1][1] if n + 1 < len(own) else None, own[n - 1][2] if n else None))
    assert sorted(tuple(r) for r in got.select("k", "i", "v", "total", "place", "seen", "after", "before").collect()) == sorted(want)


def test_asof_across_chunks(spark):
    r = np.random.default_rng(1)
    right = [(k, int(t), int(t) % 97, n) for n, (k, t) in enumerate(zip(r.choice(list("ab"), 60), r.integers(0, 40 * ordered.DAY_US, 60), strict=True))]
    left = [(k, int(t)) for k, t in zip(r.choice(list("abc"), 200), r.integers(0, 45 * ordered.DAY_US, 200), strict=True)] + [("a", None), ("a", right[0][1])]
    got = asof_backward(spark.createDataFrame(left, "k string, t long"), spark.createDataFrame(right, "k string, u long, v int, n long"), ["k"], "t", "u", ["v"], "n").collect()
    for x in got:
        own = [y for y in right if x.t is not None and y[0] == x.k and y[1] <= x.t]
        assert x.v == (max(own, key=lambda y: (y[1], y[3]))[2] if own else None)
    assert len(got) == len(left)


def test_quantiles_are_numpys(spark):
    r = np.random.default_rng(2)
    rows = [("a", float(x)) for x in r.normal(0, 1000, 500).round(1)] + [("b", float(x)) for x in r.integers(-3, 4, 80)] + [("c", 5.0), ("a", None), ("b", 0.0)]
    probs = [0.0, 0.005, 0.1, 1 / 3, 0.5, 0.775, 0.995, 1.0]
    got = {x.k: x.q for x in ordered.quantiles(spark.createDataFrame(rows, "k string, v double"), F.col("v"), probs, ["k"], "q").collect()}
    for k in "abc":
        assert got[k] == pytest.approx(np.quantile([v for a, v in rows if a == k and v is not None], probs))


def test_selected_and_spread(spark):
    rows = [("a", v) for v in (5, 1, 9, 7, 3, 3)] + [("z", 0)]
    d = spark.createDataFrame(rows, "symbol string, size long")
    got = {(r.symbol, r.pct): r["size"] for r in profiles.selected(d, "size", [0, 50, 99, 100]).collect()}
    assert got == {("a", 0): 1, ("a", 50): 5, ("a", 99): 9, ("a", 100): 9, ("z", 0): 0, ("z", 50): 0, ("z", 99): 0, ("z", 100): 0}
    assert {r.symbol: (r.permille, r.text) for r in profiles.spread_permille(d, "size").collect()} == {"a": (1600, "160.0%"), "z": (None, "n/a")}


def test_reset_removes_what_rested(spark):
    rows = [("s", 0, 0, 1, 0, 0, 100, 5), ("s", 1, 1, 0, RESET, 0, 0, 0), ("s", 2, 2, 1, 0, 0, 100, 7)]
    d = spark.createDataFrame(rows, "symbol string, seq long, ts_us long, order_id long, type int, side int, price long, size long")
    t = engine.engine_totals(engine.run_engine(d)).first()
    e = Engine()
    for _, _, ts, oid, kind, side, price, size in rows:
        e.apply(ts, oid, price, size, kind, side)
    assert {k: t[k] for k in engine.COUNTERS} == e.stats and (t.qty_removed, t.resting, t.residual) == (5, 7, 0)


def test_totals_equal_one_engine(spark):
    """Split at resets or not: the ten counters agree, for every symbol."""
    mix = tape.Mix(60, 10, 20, 5, 5, 5, 25)
    d = tape.tape(spark, {"A": 3, "B": 4}, 600, mix)
    got = {r.symbol: r for r in engine.engine_totals(engine.run_engine(d, check_every=7)).collect()}
    for symbol, seed in (("A", 3), ("B", 4)):
        e = Engine()
        for m in tape.generate(seed, 600, mix):
            e.apply(*m)
        assert {k: got[symbol][k] for k in engine.COUNTERS} == e.stats and got[symbol].residual == 0 and got[symbol].resting == e.resting()


def test_eviction_stall_ends():
    e = Engine()
    e.apply(0, 999, 100, 5, ADD, 1)  # an order that the adapter doesn't know
    a = LevelAdapter(e)
    a.batch(1, False, [(0, 101, 3)])
    assert a.stats["eviction_stalls"] == 1 and a.stats["evictions"] == 1


def test_delta_batch_with_a_level_named_twice():
    a = LevelAdapter(record=True)
    a.batch(0, False, [(0, 100, 5)])
    a.batch(1, False, [(0, 100, 9), (0, 100, 3), (0, 100, 0), (0, 100, 4)])
    assert a.engine.ladder(0) == [(100, 9, 1)]
    assert [m[4] for m in a.sent] == [ADD, engine.MODIFY, DELETE, ADD] and a.stats["no_ops"] == 1


def test_recorded_messages_rebuild_the_book():
    r = np.random.default_rng(6)
    a, o = LevelAdapter(record=True), OrderAdapter(record=True)
    o.seed(0, [(1000, 7), (999, 8)], [(1001, 5), (1002, 6)])
    for t in range(300):
        a.batch(t, t % 60 == 0, [(int(r.integers(2)), int(r.integers(95, 105)), int(r.integers(0, 6))) for _ in range(5)])
        kind = int(r.choice([1, 1, 2, 3, 4, 5, 7]))
        o.apply(t, kind, t if kind == 1 else int(r.integers(max(0, t - 20), t + 1)), int(r.integers(1, 9)), int(r.integers(996, 1006)), int(r.integers(2)))
    for x in (a, o):
        e = Engine()
        for m in x.sent:
            e.apply(*m)
        assert [e.ladder(s) for s in (0, 1)] == [x.engine.ladder(s) for s in (0, 1)] and e.stats == x.engine.stats and not e.violations()
    assert o.live == {i: s.size for i, s in o.orders.items() if not s.seeded} and {i: s.size for i, s in o.orders.items()} == {i: x[2] for i, x in o.engine.orders.items()}


def test_whole_batches(spark):
    d = spark.createDataFrame([("s", i, i // 4) for i in range(20)], "symbol string, seq long, batch long")
    for limit, last in ((20, 4), (30, 4), (19, 3), (17, 3), (16, 2), (1, -1)):
        assert {r.batch for r in adapters.whole_batches(d, limit).collect()} == set(range(last + 1)), limit


def test_book_at_reaches_over_buckets(spark):
    rows = [("s", n, b, b, b == 0, side, p, q) for n, (b, side, p, q) in enumerate([(0, 0, 10, 5), (0, 1, 20, 5), (3, 0, 9, 1), (500, 0, 10, 0), (901, 1, 20, 7)])]
    l2 = spark.createDataFrame(rows, "symbol string, seq long, batch long, ts_us long, is_snapshot boolean, side int, price long, amount long")
    asked = spark.createDataFrame([("s", b) for b in (0, 2, 3, 499, 500, 900, 901, 5000)], "symbol string, batch long")
    got = {}
    for r in book.book_at(l2, asked).collect():
        got.setdefault(r.batch, set()).add((r.side, r.price, r["size"]))
    deep, early, late = {(0, 10, 5), (0, 9, 1), (1, 20, 5)}, {(0, 10, 5), (1, 20, 5)}, {(0, 9, 1), (1, 20, 5)}
    assert got == {0: early, 2: early, 3: deep, 499: deep, 500: late, 900: late, 901: {(0, 9, 1), (1, 20, 7)}, 5000: {(0, 9, 1), (1, 20, 7)}}


def test_tape_lines_are_tested_field_by_field(spark, tmp_path):
    lines = ["# comment", "", "A 10 1 B 100 5", "A 10 1 B abc 5", "A 10 xx B 100 5", "A 10 1 X 100 5", "A 10 1 B 100", "Q 1", "M 10 1 4 and more", "D 10", "T 10 S 100 5", "R 10", "  R 11  "]
    (tmp_path / "t.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    got = [(r.line_no, r.status) for r in feeds.read_tape(feeds.numbered_lines(spark, str(tmp_path / "t.gz"))).orderBy("line_no").collect()]
    want = ["Ok", "MissingFields", "MissingFields", "BadSide", "MissingFields", "UnknownTag", "Ok", "MissingFields", "Ok", "Ok", "Ok"]
    assert got == list(zip(range(3, 14), want, strict=True))
    with pytest.raises(Exception, match="line 4: MissingFields"):
        feeds.checked(feeds.read_tape(feeds.numbered_lines(spark, str(tmp_path / "t.gz")))).collect()


def test_book_rows_have_a_status(spark):
    line = "x,S,1,2,1.1,2,1.0,3,1.2,4,,"
    rows = {line: "Ok", line + ",": "FieldCount", line.replace("1.1", "1.15"): "BadNumber", line.replace(",1,2,", ",1,soon,"): "BadNumber"}
    got = {r.line: (r.status, r.asks, r.bids) for r in feeds.parse_book_rows(spark.createDataFrame([(x,) for x in rows], "line string"), 2).collect()}
    assert {k: v[0] for k, v in got.items()} == rows and [tuple(x) for x in got[line][1]] == [(11, 2000), (12, 4000)] and [tuple(x) for x in got[line][2]] == [(10, 3000)]
    rows = {"5,1,4,2,9999999999,0,-9999999999,0": "Ok", "5,1,4": "FieldCount", "5,1,4,2,9999999999,0,-9999999999,x": "BadNumber"}
    got = {r.line: r for r in feeds.parse_order_book_rows(spark.createDataFrame([(x,) for x in rows], "line string"), 2).collect()}
    assert {k: v.status for k, v in got.items()} == rows and len(next(iter(got.values())).asks) == 1


def test_zipped_trades_into_the_store(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for day, n in (("2024-01-01", 3), ("2024-01-02", 2)):
        with zipfile.ZipFile(raw / f"BTC-trades-{day}.zip", "w") as z:
            z.writestr("t.csv", "id,price,qty,quote_qty,time,is_buyer_maker\n" + "".join(f"{i},{100 + i}.5,{i + 1},0,{1704067200000 - i},{'true' if i % 2 else 'false'}\n" for i in range(n)))
    out = str(tmp_path / "days")
    assert {(r.symbol, str(r.day), r.rows) for r in store.reduce_trades(spark, str(raw), out).collect()} == {("BTC", "2024-01-01", 3), ("BTC", "2024-01-02", 2)}
    got = store.read_days(spark, out, "BTC", "2024-01-01", "2024-01-01")
    assert [(r.id, r.signed_qty) for r in got.orderBy("timestamp").collect()] == [(2, 3.0), (1, -2.0), (0, 1.0)]
    assert "day" in got._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]
    with pytest.raises(FileNotFoundError):
        store.read_days(spark, out, "BTC", "2025-01-01")
    (raw / "book").mkdir()
    (raw / "book" / "BTC-2024-01-05.csv").write_text("timestamp,asks[0].price,bids[0].price\n1704412800000000,101.0,100.0\n")
    assert store.reduce_mids(spark, str(raw / "book"), str(tmp_path / "mids")).first().rows == 1
    assert store.read_days(spark, str(tmp_path / "mids")).first().midprice == 100.5


def test_resumable_run(spark, tmp_path):
    path = str(tmp_path / "manifest.json")
    assert store.read_manifest(spark, path).count() == 0
    requested = feeds.day_spine(spark, ["A", "B"], "2024-01-01", "2024-01-02")
    raw = spark.createDataFrame([("A", "2024-01-01", 5, None), ("A", "2024-01-02", None, "404"), ("B", "2024-01-01", 7, None)], "symbol string, day string, rows long, error string").withColumn("day", F.to_date("day"))
    first = store.run_outcomes(requested, store.read_manifest(spark, path), raw)
    assert tuple(store.run_summary(first).first()) == (2, 0, 2)
    store.write_manifest(store.updated_manifest(store.read_manifest(spark, path), first, "trades"), path)
    assert json.loads((tmp_path / "manifest.json").read_text())["trades"]["A"]["2024-01-02"]["status"] == "gap"
    again = store.run_outcomes(requested, store.read_manifest(spark, path), raw)
    assert tuple(store.run_summary(again).first()) == (0, 2, 2)
    store.write_manifest(store.updated_manifest(store.read_manifest(spark, path), again, "trades"), path)
    assert store.read_manifest(spark, path).count() == 4


def test_cache_is_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for force in (False, False, True):
        assert store.cached(spark, str(tmp_path / "c"), build, force).count() == 3
    assert len(built) == 2


def test_report_and_tables(spark, tmp_path):
    for seed in range(50):
        e = Engine()
        for m in tape.generate(seed, 300):
            e.apply(*m)
        if e.fills and all(map(e.ladder, (0, 1))):
            break
    d = tape.tape(spark, {"A": seed}, 300)
    tagged = engine.run_engine(d, check_every=10).cache()
    lines = [r.line for r in reports.replay_report(d, tagged, 2).collect()]
    assert lines[0].startswith("messages: 300, adds ") and lines[1] == "invariants: hold" and lines[-1] == "conservation: residual 0"
    bid = e.ladder(0)[0]
    assert lines[2] == f"bid 1: {bid[0]} x {bid[1]} ({bid[2]} orders)" and f"fills: {len(e.fills)}, checksum" in lines[-2]
    from tideline.functions.scalars import fnv1a

    assert lines[-2].endswith(f"{fnv1a(''.join(f'{ts},{a},{r},{p},{q},{s}' + chr(10) for ts, a, r, p, q, s in e.fills).encode()):016x}")
    back = engine.readbacks(tagged).first()
    assert (back.fill_count, back.cumulative_cost) == (len(e.fills), sum(f[3] * f[4] for f in e.fills))
    t = reports.markdown(spark.createDataFrame([("a", 1.5, True, None)], "x string, y double, z boolean, w long"), {"y": ".3e"}, "T")
    assert t == "# T\n\n| x | y | z | w |\n|---|---|---|---|\n| a | 1.500e+00 | yes | - |\n"
    c = spark.createDataFrame([("A", "N=25", b, 3, 1.0, 0.1, 0.0, 0.2, 0.1, 0.5, 2.0, b == 0) for b in (1, 0)], "symbol string, scale string, bin int, n long, mean_q double, mean_r double, ci_lo double, ci_hi double, sd_r double, frac_zero_r double, mean_duration_s double, inside boolean")
    reports.write_curves(c, str(tmp_path / "c"))
    assert [r.bin for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()] == ["0", "1"]


def test_index_rejects_another_header(spark, tmp_path):
    raw = window_codec.encode("BTCUSDT", 20240101, 0, 9000, 10, 1000, [], [])
    w = window_codec.decode_windows(spark.createDataFrame([("f", bytearray(raw))], "file string, data binary"))
    days = spark.createDataFrame([("BTCUSDT", 20240101, 0.04, 12.0, 2)], "symbol string, day int, rv double, volume double, tercile int")
    spec = lambda day: spark.createDataFrame([("f", "BTCUSDT", day, "why")], "file string, symbol string, day int, reason string")
    x = reports.window_index(w, spec(20240101), days)
    assert (x.first().day_sigma, x.first().vol_tercile) == (0.2, "high")
    reports.write_index(x, str(tmp_path / "i.json"), "test")
    assert json.loads((tmp_path / "i.json").read_text())["windows"][0]["reason"] == "why"
    with pytest.raises(Exception, match="header mismatch in f"):
        reports.window_index(w, spec(20240102), days).collect()


def test_exit_gate(spark):
    stats = spark.createDataFrame([(s, n, v) for s, bad in (("a", 0), ("b", 1)) for n, v in (("violations", 0), ("fills", 0), ("eviction_stalls", bad))], "symbol string, note string, size long")
    parsed = spark.createDataFrame([("a", "Ok"), ("a", "BadSide")], "symbol string, status string")
    assert {r.symbol: r.clean for r in adapters.exit_clean(stats).collect()} == {"a": True, "b": False}
    assert {r.symbol: r.clean for r in adapters.exit_clean(stats, parsed).collect()} == {"a": False, "b": False}


def test_verdicts(spark):
    rows = [(None, None, None), (-1.0, -2.0, 0.0), (0.5, 0.2, 0.9), (1.5, 1.1, 1.9), (1.0, 0.8, 1.2)]
    got = [r.v.split(" ")[0] for r in spark.createDataFrame(rows, "g double, lo double, hi double").coalesce(1).select(study.verdict_h1(F.col("g"), F.col("lo"), F.col("hi")).alias("v")).collect()]
    assert got == ["not", "FALSIFIED", "SUPPORTED", "FALSIFIED", "FALSIFIED"]
    rows = [(-2.0, -1.0, 1.0, 2.0), (0.1, 1.0, 0.1, 1.0), (-1.0, 1.0, 0.5, 1.0)]
    got = [r.v.split(" ")[0] for r in spark.createDataFrame(rows, "a double, b double, c double, d double").coalesce(1).select(study.verdict_h2(*map(F.col, "abcd")).alias("v")).collect()]
    assert got == ["SUPPORTED", "FALSIFIED", "inconclusive"]


def test_equity_trades_and_blocks(spark):
    day = "2012-06-21"
    messages = [("S", day, i, 34200.000001 + i, 4 if i % 2 else 5, i, 10 + i, 10000 * (100 + i), 1 if i % 3 else -1) for i in range(10)] + [("S", day, 10, 34300.5, 1, 9, 1, 1, 1)]
    m = spark.createDataFrame(messages, "symbol string, day string, row_index long, seconds double, type int, order_id long, size long, price long, direction int").withColumn("day", F.to_date("day"))
    b = spark.createDataFrame([("S", day, i, 1010000, 990000 + 100 * i) for i in range(9)], "symbol string, day string, row_index long, ask long, bid long").withColumn("day", F.to_date("day"))
    t = equity.trades(m, b)
    rows = t.orderBy("row_index").collect()
    assert len(rows) == 10 and rows[9].midprice is None and rows[0].is_hidden and rows[0].signed_qty == 10.0 and rows[1].signed_qty == -11.0
    assert rows[0].t == 15512 * 86_400_000_000 + 34200000001
    blocks = equity.event_blocks(t, 3).orderBy("bi").collect()
    assert [x.bi for x in blocks] == [0, 1] and blocks[0].r == pytest.approx(math.log(103 / 100))
    s = equity.summary(m, t).first()
    assert (s.message_rows, s.visible_trades, s.hidden_trades, s.n1) == (11, 5, 5, 1)
