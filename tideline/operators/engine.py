"""Price-time-priority matching: a plain state machine, and its keyed form for DataFrames.

Messages: ts_us, order_id, price, size, type (0 add, 1 modify, 2 delete, 3 trade, 4 reset), side (0 bid, 1 ask).
A reset empties the book, so (symbol, episode between resets) is the unit of parallelism.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.ordered import every, running_sum

#: Messages of a chunk along a symbol's sequence.
CHUNK_ROWS = 100_000
ADD, MODIFY, DELETE, TRADE, RESET = range(5)
COUNTERS = ("messages", "adds", "modifies", "deletes", "trades", "snapshot_resets", "rejected", "qty_added", "qty_filled", "qty_removed")


class Engine:
    """One instrument's book. ``fills`` and ``prints`` collect what happened; levels are FIFO queues of order ids."""

    def __init__(self) -> None:
        self.levels: tuple[dict[int, OrderedDict[int, None]], ...] = ({}, {})
        self.prices: tuple[list[int], list[int]] = ([], [])  # ascending
        self.orders: dict[int, list[int]] = {}  # id -> [side, price, size]
        self.fills: list[tuple[int, int, int, int, int, int]] = []
        self.prints: list[tuple[int, int, int, int]] = []
        self.stats = dict.fromkeys(COUNTERS, 0)

    def best(self, side: int) -> int | None:
        p = self.prices[side]
        return (p[-1] if side == 0 else p[0]) if p else None

    def crosses(self, side: int, price: int) -> bool:
        """Whether an order at price trades against the ladder of ``side``."""
        b = self.best(side)
        return b is not None and (price <= b if side == 0 else price >= b)

    def apply(self, ts: int, oid: int, price: int, size: int, kind: int, side: int) -> None:
        s = self.stats
        s["messages"] += 1
        if kind == ADD:
            if size <= 0 or oid in self.orders:
                s["rejected"] += 1
                return
            s["adds"] += 1
            s["qty_added"] += size
            if left := self._match(ts, oid, price, size, side):
                self.orders[oid] = [side, price, left]
                queue = self.levels[side].get(price)
                if queue is None:
                    queue = self.levels[side][price] = OrderedDict()
                    insort(self.prices[side], price)
                queue[oid] = None
        elif kind == MODIFY:
            order = self.orders.get(oid)
            if order is None:
                s["rejected"] += 1
                return
            s["modifies"] += 1
            if size <= 0:
                s["qty_removed"] += order[2]
                self._remove(oid)
            elif size < order[2]:
                s["qty_removed"] += order[2] - size
                order[2] = size
            elif size > order[2]:  # a larger size loses its place in the queue
                s["qty_removed"] += order[2]
                s["qty_added"] += size
                order[2] = size
                self.levels[order[0]][order[1]].move_to_end(oid)
        elif kind == DELETE:
            if oid not in self.orders:
                s["rejected"] += 1
                return
            s["deletes"] += 1
            s["qty_removed"] += self.orders[oid][2]
            self._remove(oid)
        elif kind == TRADE:
            s["trades"] += 1
            self.prints.append((ts, price, size, side))
        else:
            s["snapshot_resets"] += 1
            s["qty_removed"] += self.resting()
            self.orders.clear()
            for side_ in (0, 1):
                self.levels[side_].clear()
                self.prices[side_].clear()

    def _match(self, ts: int, oid: int, price: int, size: int, side: int) -> int:
        other = 1 - side
        while size and self.crosses(other, price):
            at = self.best(other)
            queue = self.levels[other][at]
            while size and queue:
                rid = next(iter(queue))
                resting = self.orders[rid]
                traded = min(size, resting[2])
                self.fills.append((ts, oid, rid, at, traded, side))
                self.stats["qty_filled"] += traded
                size -= traded
                resting[2] -= traded
                if resting[2]:
                    break
                del queue[rid], self.orders[rid]
            if not queue:
                self._drop_level(other, at)
        return size

    def _drop_level(self, side: int, price: int) -> None:
        del self.levels[side][price]
        p = self.prices[side]
        del p[bisect_left(p, price)]

    def _remove(self, oid: int) -> None:
        side, price, _ = self.orders.pop(oid)
        queue = self.levels[side][price]
        del queue[oid]
        if not queue:
            self._drop_level(side, price)

    def resting(self) -> int:
        return sum(o[2] for o in self.orders.values())

    def crossed_by(self, side: int, price: int) -> list[int]:
        """Prices of the other side, best first, that an order of ``side`` at price would trade against."""
        p = self.prices[1 - side]
        return p[: bisect_right(p, price)] if side == 0 else p[bisect_left(p, price) :][::-1]

    def ladder(self, side: int, depth: int | None = None) -> list[tuple[int, int, int]]:
        """(price, size, orders) from the best level on, ``depth`` levels at most."""
        p = self.prices[side]
        prices = p[:depth] if side else p[::-1] if depth is None else p[: -depth - 1 : -1]
        return [(p, sum(self.orders[i][2] for i in self.levels[side][p]), len(self.levels[side][p])) for p in prices]

    def inject(self, ts: int, oid: int, side: int, size: int) -> list[tuple[int, int, int, int, int, int]]:
        """An immediate-or-cancel order at an extreme price; returns its fills. The delete of a fully filled order counts as rejected."""
        n = len(self.fills)
        self.apply(ts, oid, 2**62 if side == 0 else -(2**62), size, ADD, side)
        self.apply(ts, oid, 0, 0, DELETE, side)
        return self.fills[n:]

    def residual(self) -> int:
        """Conservation: added less twice the filled, the removed and the resting; 0 always. A fill takes from both of its orders."""
        s = self.stats
        return s["qty_added"] - 2 * s["qty_filled"] - s["qty_removed"] - self.resting()

    def violations(self) -> list[str]:
        out = []
        for side in (0, 1):
            p = self.prices[side]
            if any(a >= b for a, b in zip(p, p[1:], strict=False)):
                out.append("unsorted levels")
            if set(p) != set(self.levels[side]):
                out.append("levels and prices differ")
            for price, queue in self.levels[side].items():
                if not queue:
                    out.append("empty level")
                out += ["order not in its level" for i in queue if self.orders.get(i, [None])[:2] != [side, price]]
        if sum(len(q) for side in (0, 1) for q in self.levels[side].values()) != len(self.orders):
            out.append("index and queues differ")
        if any(o[2] <= 0 for o in self.orders.values()):
            out.append("size not positive")
        b, a = self.best(0), self.best(1)
        if b is not None and a is not None and b >= a:
            out.append("crossed")
        if self.residual():
            out.append("not conserved")
        return out


OUT = "symbol string, episode long, kind string, seq long, nth int, ts_us long, aggressor long, order_id long, side int, rank int, price long, size long, note string"


def with_reset_episode(messages: DataFrame) -> DataFrame:
    """messages with ``episode``: resets so far. The reset itself begins the new episode."""
    return running_sum(messages, "episode", (F.col("type") == RESET).cast("long"), ["symbol"], ["seq"], every("seq", CHUNK_ROWS))


def run_engine(messages: DataFrame, check_every: int = 0) -> DataFrame:
    """One tagged table of what every (symbol, episode) did: fill, print, book (by rank and queue), stat and violation rows.

    messages: symbol, seq, ts_us, type, order_id, side, price, size; applied in order of seq, which must not repeat within a
    symbol. What a reset removes is counted where it rested, at the end of the episode before it. With check_every, invariants are tested after every so many messages, and at the end.
    """
    import pyarrow as pa

    names = [c.split()[0] for c in OUT.split(", ")]

    def run(key, t):
        symbol, episode = (k.as_py() for k in key)
        t = t.sort_by("seq")
        e, rows = Engine(), []
        filled = printed = 0
        follows = t.column("resets")[0].as_py() > episode

        def row(kind, seq=None, ts=None, aggressor=None, oid=None, side=None, rank=None, price=None, size=None, note=None, nth=None):
            rows.append((symbol, episode, kind, seq, nth, ts, aggressor, oid, side, rank, price, size, note))

        cols = [t.column(c).to_pylist() for c in ("seq", "ts_us", "order_id", "price", "size", "type", "side")]
        seq = None
        for n, (seq, ts, oid, price, size, kind, side) in enumerate(zip(*cols, strict=True), 1):
            e.apply(ts, oid, price, size, kind, side)
            for nth, f in enumerate(e.fills[filled:]):
                row("fill", seq, f[0], f[1], f[2], f[5], None, f[3], f[4], nth=nth)
            for p in e.prints[printed:]:
                row("print", seq, p[0], None, None, p[3], None, p[1], p[2])
            filled, printed = len(e.fills), len(e.prints)
            if check_every and n % check_every == 0:
                for v in e.violations():
                    row("violation", seq, ts, note=v)
        for v in e.violations():
            row("violation", seq, note=v)
        for side in (0, 1):
            prices = list(reversed(e.prices[0])) if side == 0 else e.prices[1]
            for rank, p in enumerate(prices):
                for oid in e.levels[side][p]:
                    row("book", None, None, None, oid, side, rank, p, e.orders[oid][2])
        stats = e.stats | {"resting": e.resting()}
        if follows:  # the next episode's reset takes it away
            stats["qty_removed"] += stats["resting"]
            stats["resting"] = 0
        for k, v in stats.items():
            row("stat", size=v, note=k)
        return pa.table({c: pa.array([r[i] for r in rows], f) for i, (c, f) in enumerate(zip(names, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True))})

    resets = messages.groupBy("symbol").agg(F.count_if(F.col("type") == RESET).alias("resets"))
    return with_reset_episode(messages).join(F.broadcast(resets), "symbol").groupBy("symbol", "episode").applyInArrow(run, OUT)


def engine_totals(tagged: DataFrame) -> DataFrame:
    """(symbol, the ten counters, resting, residual): summed over episodes. The residual is what conservation leaves over: 0."""
    stat = lambda n: F.sum(F.when(F.col("note") == n, F.col("size"))).alias(n)
    x = tagged.where("kind = 'stat'").groupBy("symbol").agg(*[stat(n) for n in (*COUNTERS, "resting")])
    return x.withColumn("residual", F.col("qty_added") - 2 * F.col("qty_filled") - F.col("qty_removed") - F.col("resting"))


def readbacks(tagged: DataFrame, aggressor: int | None = None) -> DataFrame:
    """(symbol, fill_count, filled, cumulative_cost): of all fills, or those of one aggressor. The cost is exact: a decimal that doesn't overflow."""
    f = tagged.where("kind = 'fill'" if aggressor is None else f"kind = 'fill' and aggressor = {aggressor}")
    return f.groupBy("symbol").agg(F.count(F.lit(1)).alias("fill_count"), F.sum("size").alias("filled"), F.sum(F.col("price").cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)")).cast("long").alias("cumulative_cost"))




def checksum(tagged: DataFrame) -> DataFrame:
    """(symbol, fills, filled, checksum): the number and quantity of fills and FNV-1a over their lines in order, each line ended by a newline.

    The checksum is a fold over bytes in order, and so is this: fills are sorted into a range of partitions by symbol and order, and each symbol's state goes from one batch of rows to the next.
    """
    import pyarrow as pa

    from tideline.functions.scalars import FNV_OFFSET, fnv1a

    line = F.concat_ws(",", "ts_us", "aggressor", "order_id", "price", "size", "side")
    # fills of one message come in the engine's order
    f = tagged.where("kind = 'fill'").select("symbol", "episode", "seq", "nth", "size", line.alias("line"))
    kind = "symbol string, fills long, filled long, checksum string"

    def run(key, batches):
        h, n, filled = FNV_OFFSET, 0, 0
        for b in batches:
            for text, size in zip(b.column("line").to_pylist(), b.column("size").to_pylist(), strict=True):
                h, n, filled = fnv1a(text.encode() + b"\n", h), n + 1, filled + size
        yield pa.RecordBatch.from_pydict({"symbol": [key], "fills": [n], "filled": [filled], "checksum": [f"{h:016x}"]}, schema=pa.schema([("symbol", pa.string()), ("fills", pa.int64()), ("filled", pa.int64()), ("checksum", pa.string())]))

    def by_symbol(batches):
        def runs():
            for b in batches:
                names = b.column("symbol").to_pylist()
                lo = 0
                for hi in range(1, len(names) + 1):
                    if hi == len(names) or names[hi] != names[lo]:
                        yield names[lo], b.slice(lo, hi - lo)
                        lo = hi

        from itertools import groupby

        for name, group in groupby(runs(), key=lambda x: x[0]):
            yield from run(name, (b for _, b in group))

    return f.repartition("symbol").sortWithinPartitions("symbol", "episode", "seq", "nth").mapInArrow(by_symbol, kind)
