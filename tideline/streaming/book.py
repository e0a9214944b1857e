"""The matching engine over a stream of messages, with its book as keyed state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame

from tideline.operators.engine import Engine

OUT = "symbol string, kind string, seq long, ts_us long, aggressor long, order_id long, side int, price long, size long"
STATE = "last_seq long, engine binary"


def stream_fills(messages: DataFrame) -> DataFrame:
    """Fills (kind fill) of a stream of messages (symbol, seq, ts_us, type, order_id, side, price, size), one book per symbol.

    Messages of a micro-batch are applied in order of seq; one with a seq that was already passed is late: it is not applied, and leaves a row of kind late, so a
    replayed batch changes no book and late data can be counted. State is one blob per symbol and grows with the resting orders only.
    """
    import pandas as pd

    def step(key, batches: Iterator[pd.DataFrame], state):
        last, e = -1, Engine()
        if state.exists:
            last, blob = state.get
            vars(e).update(pickle.loads(bytes(blob)))
        pdf = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, ts, kind, oid, side, price, size in pdf[["seq", "ts_us", "type", "order_id", "side", "price", "size"]].itertuples(index=False):
            if seq <= last:
                out.append((key[0], "late", int(seq), int(ts), None, int(oid), int(side), int(price), int(size)))
                continue
            last = int(seq)
            e.apply(int(ts), int(oid), int(price), int(size), int(kind), int(side))
            out += [(key[0], "fill", last, f[0], f[1], f[2], f[5], f[3], f[4]) for f in e.fills]
            e.fills.clear()
            e.prints.clear()
        state.update((last, pickle.dumps(vars(e))))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"aggressor": "Int64"})

    return messages.groupBy("symbol").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")


def stream_minute_flow(trades: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(symbol, window, ofi, n): signed flow by event-time minute, emitted once the watermark has passed. trades: symbol, ts timestamp, qty_lots, is_buyer_maker."""
    from pyspark.sql import functions as F

    from tideline.operators.blocks import signed_qty

    return trades.withWatermark("ts", delay).groupBy("symbol", F.window("ts", "1 minute")).agg(F.sum(signed_qty()).alias("ofi"), F.count(F.lit(1)).alias("n"))
