"""A deterministic message generator over the 64-bit Mersenne twister."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tideline.operators.engine import ADD, DELETE, MODIFY, RESET, TRADE

MASK = (1 << 64) - 1


class Twister64:
    """mt19937_64 as published: state of 312 words."""

    def __init__(self, seed: int):
        self.s = [seed & MASK]
        for i in range(1, 312):
            x = self.s[-1]
            self.s.append((6364136223846793005 * (x ^ (x >> 62)) + i) & MASK)
        self.i = 312

    def __call__(self) -> int:
        if self.i == 312:
            s = self.s
            for k in range(312):
                x = (s[k] & 0xFFFFFFFF80000000) | (s[(k + 1) % 312] & 0x7FFFFFFF)
                s[k] = s[(k + 156) % 312] ^ (x >> 1) ^ (0xB5026F5AA96619E9 if x & 1 else 0)
            self.i = 0
        x = self.s[self.i]
        self.i += 1
        x ^= (x >> 29) & 0x5555555555555555
        x ^= (x << 17) & 0x71D67FFFEDA60000
        x ^= (x << 37) & 0xFFF7EEE000000000
        return x ^ (x >> 43)


@dataclass
class Mix:
    """Shares of the kinds in percent (in all 100) and the price process."""

    add: int = 55
    modify: int = 15
    delete: int = 25
    trade: int = 4
    reset: int = 1
    half_spread: int = 6
    max_size: int = 40
    start_mid: int = 100_000
    start_us: int = 1_700_000_000_000_000


def generate(seed: int, count: int, mix: Mix | None = None) -> list[tuple[int, int, int, int, int, int]]:
    """Messages (ts_us, order_id, price, size, type, side)."""
    m = mix or Mix()
    if m.add + m.modify + m.delete + m.trade + m.reset != 100:
        raise ValueError("the shares must add up to 100")
    rng = Twister64(seed)
    kinds = [RESET] * m.reset + [TRADE] * m.trade + [DELETE] * m.delete + [MODIFY] * m.modify + [ADD] * m.add
    live: list[int] = []
    out, ts, mid, fresh = [], m.start_us, m.start_mid, 1
    for _ in range(count):
        ts += 1 + rng() % 50
        mid += rng() % 3 - 1
        kind = kinds[rng() % 100]
        side = rng() % 2
        price = mid + rng() % (2 * m.half_spread + 1) - m.half_spread
        size = 1 + rng() % m.max_size
        if kind in (DELETE, MODIFY) and not live:
            kind = ADD
        if kind == RESET:
            out.append((ts, 0, 0, 0, RESET, 0))
            live.clear()
        elif kind == TRADE:
            out.append((ts, 0, price, size, TRADE, side))
        elif kind == ADD:
            out.append((ts, fresh, price, size, ADD, side))
            live.append(fresh)
            fresh += 1
        else:
            i = rng() % len(live)
            out.append((ts, live[i], 0, size if kind == MODIFY else 0, kind, 0))
            if kind == DELETE:
                live[i] = live[-1]
                live.pop()
    return out


def tape(spark: SparkSession, symbols: dict[str, int], count: int, mix: Mix | None = None) -> DataFrame:
    """Generated messages of each symbol with its seed; generation runs on the executors, one symbol a task."""
    ids = spark.createDataFrame(list(symbols.items()), "symbol string, seed long").repartition(max(1, len(symbols)), "symbol")

    def run(batches):
        import pandas as pd

        for b in batches:
            for symbol, seed in zip(b.symbol, b.seed, strict=True):
                rows = generate(int(seed), count, mix)
                yield pd.DataFrame(rows, columns=["ts_us", "order_id", "price", "size", "type", "side"]).assign(symbol=symbol, seq=range(len(rows)))[["symbol", "seq", "ts_us", "order_id", "price", "size", "type", "side"]]

    return ids.mapInPandas(run, "symbol string, seq long, ts_us long, order_id long, price long, size long, type int, side int")
