"""The packed window format: a fixed header, depth deltas by snapshot, and trades, optionally gzipped."""

from __future__ import annotations

import gzip
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
MAGIC, VERSION = b"IWD1", 1
SYMBOLS = {"BTCUSDT": 0, "ETHUSDT": 1}
BANDS = [-50, -40, -30, -20, -10, -2, 2, 10, 20, 30, 40, 50]
HEADER = "<4sBBIqqiiB12hII"
HEADER_SIZE = 67
SNAPSHOT = np.dtype([("dt", "<u4"), ("delta", "<i4", 12)])
TRADE = np.dtype([("dt", "<u4"), ("price", "<i4"), ("qty", "<i4")])


def _fit(name: str, x: np.ndarray, kind: str) -> np.ndarray:
    info = np.iinfo(kind)
    if len(x) and (x.min() < info.min or x.max() > info.max):
        raise OverflowError(f"{name} does not fit {kind}")
    return x.astype(kind)


def encode(symbol: str, day: int, start_ms: int, end_ms: int, price_scale: int, qty_scale: int, snapshots: list[tuple[int, list[int]]], trades: list[tuple[int, int, int]]) -> bytes:
    """snapshots: (ms, 12 depths); trades: (ms, price, signed qty). Raises OverflowError if a value does not fit its field."""
    head = struct.pack(HEADER, MAGIC, VERSION, SYMBOLS[symbol], day, start_ms, end_ms, price_scale, qty_scale, len(BANDS), *BANDS, len(snapshots), len(trades))
    s, t = np.zeros(len(snapshots), SNAPSHOT), np.zeros(len(trades), TRADE)
    ts = np.array([x[0] for x in snapshots], np.int64)
    s["dt"] = _fit("book_dt_ms", np.diff(ts, prepend=start_ms), "uint32")
    depth = np.array([x[1] for x in snapshots], np.int64).reshape(-1, len(BANDS))
    s["delta"] = _fit("book_depth_delta", np.diff(depth, axis=0, prepend=np.zeros((1, len(BANDS)), np.int64)), "int32")
    t["dt"] = _fit("trade_dt_ms", np.diff(np.array([x[0] for x in trades], np.int64), prepend=start_ms), "uint32")
    t["price"], t["qty"] = (_fit(f"trade_{n}", np.array([x[k] for x in trades], np.int64), "int32") for k, n in ((1, "price"), (2, "qty")))
    return head + s.tobytes() + t.tobytes()


def decode(raw: bytes) -> dict:
    """The window as a dict; plain or gzipped. Raises ValueError on a wrong magic, version, band list, or length."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    if raw[:4] != MAGIC:
        raise ValueError("not a window: bad magic")
    if len(raw) < HEADER_SIZE:
        raise ValueError("header is cut off")
    _, version, code, day, start, end, ps, qs, n, *rest = struct.unpack_from(HEADER, raw)
    if version != VERSION:
        raise ValueError(f"version {version}")
    if n != len(BANDS) or rest[:12] != BANDS:
        raise ValueError("unexpected bands")
    ns, nt = rest[12:]
    if len(raw) != HEADER_SIZE + ns * SNAPSHOT.itemsize + nt * TRADE.itemsize:
        raise ValueError("wrong length")
    names = {v: k for k, v in SYMBOLS.items()}
    if code not in names:
        raise ValueError(f"symbol code {code}")
    s = np.frombuffer(raw, SNAPSHOT, ns, HEADER_SIZE)
    t = np.frombuffer(raw, TRADE, nt, HEADER_SIZE + ns * SNAPSHOT.itemsize)
    depth = np.cumsum(s["delta"].astype(np.int64), axis=0)
    return {
        "symbol": names[code], "day": day, "start_ms": start, "end_ms": end, "price_scale": ps, "qty_scale": qs,
        "snapshots": list(zip((start + np.cumsum(s["dt"].astype(np.int64))).tolist(), depth.tolist(), strict=True)),
        "trades": list(zip((start + np.cumsum(t["dt"].astype(np.int64))).tolist(), t["price"].tolist(), t["qty"].tolist(), strict=True)),
    }


WINDOW = "struct<symbol:string,day:int,start_ms:bigint,end_ms:bigint,price_scale:int,qty_scale:int,snapshots:array<struct<ts:bigint,depth:array<bigint>>>,trades:array<struct<ts:bigint,price:bigint,qty:bigint>>>"


def encode_windows(windows: DataFrame) -> DataFrame:
    """windows with ``data``, the gzipped bytes. Columns: symbol, day, start_ms, end_ms, price_scale, qty_scale, snapshots array<struct<ts,depth>>, trades array<struct<ts,price,qty>>."""

    @F.udf("binary", useArrow=True)
    def pack(symbol, day, start, end, ps, qs, snapshots, trades):
        return gzip.compress(encode(symbol, day, start, end, ps, qs, [(r["ts"], list(r["depth"])) for r in snapshots], [(r["ts"], r["price"], r["qty"]) for r in trades]), mtime=0)

    return windows.withColumn("data", pack("symbol", "day", "start_ms", "end_ms", "price_scale", "qty_scale", "snapshots", "trades"))


def decode_windows(files: DataFrame, data: str = "data") -> DataFrame:
    """files with ``window``, the decoded struct."""

    @F.udf(WINDOW, useArrow=True)
    def unpack(raw):
        w = decode(bytes(raw))
        return w | {"snapshots": [{"ts": a, "depth": b} for a, b in w["snapshots"]], "trades": [{"ts": a, "price": b, "qty": c} for a, b, c in w["trades"]]}

    return files.withColumn("window", unpack(data))
