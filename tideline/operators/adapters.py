"""Feed adapters: what an exchange publishes, as messages to the matching engine.

An adapter turns feed rows into messages, applies them to its engine and, when asked to, keeps them: that list is the normalised stream.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.engine import ADD, DELETE, MODIFY, RESET, TRADE, Engine

BID, ASK = 0, 1


class Adapter:
    """Counters by name, an engine, and the messages sent (kept with ``record``)."""

    counters: tuple[str, ...] = ()

    def __init__(self, engine: Engine | None = None, record: bool = False) -> None:
        self.engine = engine or Engine()
        self.stats = dict.fromkeys(self.counters, 0)
        self.sent: list[tuple[int, int, int, int, int, int]] | None = [] if record else None

    def count(self, name: str, n: int = 1) -> None:
        self.stats[name] += n

    def send(self, ts: int, kind: int, oid: int = 0, price: int = 0, size: int = 0, side: int = 0) -> None:
        message = (ts, oid, price, size, kind, side)
        if self.sent is not None:
            self.sent.append(message)
        self.engine.apply(*message)


class LevelAdapter(Adapter):
    """A level feed: each level is one order, whose id is 2 * price + side.

    A snapshot batch rebuilds the book, bids before asks. A delta batch is classified as a whole: its rows that lower a level are sent first,
    in feed order, then those that may raise one. So a book that looks crossed in the middle of a batch isn't when an add
    arrives. Opposite levels that an add would cross all the same are deleted before it.
    """

    counters = ("batches", "snapshot_batches", "snapshot_levels", "zero_rows", "adds", "shrinks", "grows", "no_ops", "deletes", "unknown_deletes", "crossed_adds", "evictions", "eviction_stalls")

    def __init__(self, engine: Engine | None = None, record: bool = False) -> None:
        super().__init__(engine, record)
        self.size: dict[tuple[int, int], int] = {}

    def batch(self, ts: int, is_snapshot: bool, rows: list[tuple[int, int, int]]) -> None:
        """rows: (side, price, amount) in feed order."""
        self.count("batches")
        if is_snapshot:
            self.count("snapshot_batches")
            self.send(ts, RESET)
            self.size.clear()
            levels = [r for side in (BID, ASK) for r in rows if r[0] == side and r[2] > 0]
            self.count("zero_rows", sum(r[2] <= 0 for r in rows))
            self.count("snapshot_levels", len(levels))
            for level in levels:
                self._new(ts, *level)
        else:
            for verb, *level in self.classify(rows):
                self._emit(ts, verb, *level)

    def classify(self, rows: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int]]:
        """(verb, side, price, amount) in the order of sending. What may raise a level is decided when its turn comes, after the falls and any eviction."""
        now = dict[tuple[int, int], int]()
        falls, rises = [], []
        for side, price, amount in rows:
            old = now.get((side, price), self.size.get((side, price), 0))
            if amount <= 0:
                falls.append(("deletes" if old else "unknown_deletes", side, price, 0))
            elif amount < old:
                falls.append(("shrinks", side, price, amount))
            else:
                rises.append(("rises", side, price, amount))
                continue
            now[side, price] = max(amount, 0)
        return falls + rises

    def _emit(self, ts: int, verb: str, side: int, price: int, amount: int) -> None:
        if verb == "rises":
            old = self.size.get((side, price), 0)
            if not old:
                return self._new(ts, side, price, amount)
            verb = "grows" if amount > old else "no_ops"
        self.count(verb)
        if verb == "deletes":
            self.send(ts, DELETE, 2 * price + side, side=side)
            del self.size[side, price]
        elif verb in ("shrinks", "grows"):
            self.send(ts, MODIFY, 2 * price + side, size=amount, side=side)
            self.size[side, price] = amount

    def _new(self, ts: int, side: int, price: int, amount: int) -> None:
        other = 1 - side
        in_the_way = self.engine.crossed_by(side, price)
        self.count("crossed_adds", bool(in_the_way))
        for stale in in_the_way:
            self.send(ts, DELETE, 2 * stale + other, side=other)
            self.size.pop((other, stale), None)
            self.count("evictions")
            if self.engine.best(other) == stale:  # an order that isn't this adapter's holds the level
                self.count("eviction_stalls")
                break
        self.send(ts, ADD, 2 * price + side, price, amount, side)
        self.size[side, price] = amount
        self.count("adds")


#: First id of seeded orders; the next ones follow by rank and side.
SEED_BASE = 10**12


@dataclass
class Tracked:
    """An order that the adapter believes to rest. seeded: it stands for all orders of its level from before the feed."""

    side: int
    price: int
    size: int
    seeded: bool = False


class OrderAdapter(Adapter):
    """An order feed. Orders from before the feed are unknown by id; one seeded order a level absorbs what happens to them."""

    counters = ("rows", "init_levels", "adds", "crossing_adds", "partial_cancels", "deletions", "executions", "execution_deletes", "hidden", "halts", "absorptions", "shortfall", "seed_deletes", "unknown")

    def __init__(self, engine: Engine | None = None, record: bool = False) -> None:
        super().__init__(engine, record)
        self.orders: dict[int, Tracked] = {}
        self.seed_at: dict[tuple[int, int], int] = {}

    @property
    def live(self) -> dict[int, int]:
        """Sizes of the orders that the feed itself named."""
        return {i: o.size for i, o in self.orders.items() if not o.seeded}

    def seed(self, ts: int, bids: list[tuple[int, int]], asks: list[tuple[int, int]]) -> None:
        """Begins anew from a published book, best levels first."""
        self.send(ts, RESET)
        self.orders.clear()
        self.seed_at.clear()
        for oid, side, price, size in [(SEED_BASE + 2 * rank + side, side, *level) for side, levels in ((BID, bids), (ASK, asks)) for rank, level in enumerate(levels)]:
            self.send(ts, ADD, oid, price, size, side)
            self.orders[oid] = Tracked(side, price, size, True)
            self.seed_at.setdefault((side, price), oid)
            self.count("init_levels")

    def reduce(self, oid: int, amount: int) -> int:
        """Lowers a tracked order and forgets it at nothing; what is left of it."""
        order = self.orders[oid]
        order.size = max(order.size - amount, 0)
        if not order.size:
            del self.orders[oid]
            if order.seeded:
                self.seed_at.pop((order.side, order.price), None)
        return order.size

    def apply(self, ts: int, kind: int, oid: int, size: int, price: int, side: int) -> None:
        """kind: 1 new, 2 partial cancel, 3 deletion, 4 visible execution, 5 hidden execution, 7 halt."""
        self.count("rows")
        if kind == 1:
            self._enter(ts, oid, size, price, side)
        elif kind in (2, 3, 4):
            self._leave(ts, kind, oid, size, price, side)
        elif kind == 5:
            self.send(ts, TRADE, 0, price, size, 1 - side)
            self.count("hidden")
        elif kind == 7:
            self.count("halts")

    def _enter(self, ts: int, oid: int, size: int, price: int, side: int) -> None:
        self.count("adds")
        self.count("crossing_adds", self.engine.crosses(1 - side, price))
        seen = len(self.engine.fills)
        self.send(ts, ADD, oid, price, size, side)
        # what the engine matched has left both sides
        for _, _, resting, _, traded, _ in self.engine.fills[seen:]:
            size -= traded
            if resting in self.orders:
                self.reduce(resting, traded)
        if size > 0:
            self.orders[oid] = Tracked(side, price, size)

    def _leave(self, ts: int, kind: int, oid: int, size: int, price: int, side: int) -> None:
        named = oid in self.orders and not self.orders[oid].seeded
        target = oid if named else self.seed_at.get((side, price))
        if target is None:
            self.count("unknown")
            return
        have = self.orders[target].size
        if named and kind == 3:
            size = have
        # a print comes before the size message of a named order, and after that of a seeded one
        if named and kind == 4:
            self.send(ts, TRADE, 0, price, size, 1 - side)
        left = self.reduce(target, size)
        self.send(ts, MODIFY if left else DELETE, target, size=left, side=side)
        if named:
            self.count({2: "partial_cancels", 3: "deletions", 4: "executions" if left else "execution_deletes"}[kind])
            return
        if kind == 4:
            self.send(ts, TRADE, 0, price, size, 1 - side)
        self.count("absorptions")
        self.count("shortfall", max(0, size - have))
        self.count("seed_deletes", not left)


MESSAGES = "symbol string, seq long, ts_us long, order_id long, price long, size long, type int, side int"


def _table(rows: list[tuple], schema: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({n: pa.array([r[k] for r in rows], kinds[f]) for k, (n, f) in enumerate(fields)})


def _batches(t):
    """(batch, ts, is_snapshot, rows) of a level feed's episode, in order."""
    from itertools import groupby

    t = t.sort_by([("batch", "ascending"), ("seq", "ascending")])
    rows = zip(*(t.column(c).to_pylist() for c in ("batch", "ts_us", "is_snapshot", "side", "price", "amount")), strict=True)
    for batch, group in groupby(rows, key=lambda r: r[0]):
        own = list(group)
        yield batch, own[0][1], own[0][2], [r[3:] for r in own]


def replay_levels(l2: DataFrame, every: int = 1, depth: int | None = None, check_every: int = 100) -> DataFrame:
    """(symbol, batch, side, rank, price, size, note): the two-pass book after every ``every``-th batch, its first ``depth`` levels a side, and stats rows with batch null.

    l2: symbol, seq, batch, ts_us, is_snapshot, side, price, amount. Stats rows carry the counter's value in size and its name in note; they are sums
    by episode. Invariants are tested after every ``check_every`` batches, after every snapshot and at the end. A
    snapshot defines the whole state, so (symbol, snapshot episode) is the unit of parallelism.
    """
    from tideline.operators.book import with_episode

    out_kind = "symbol string, batch long, side int, rank int, price long, size long, note string"

    def run(key, t):
        symbol, a, out, violations = key[0].as_py(), LevelAdapter(), [], 0
        n = 0
        for n, (batch, ts, snap, rows) in enumerate(_batches(t), 1):
            a.batch(ts, snap, rows)
            if batch % every == 0:
                out += [(symbol, batch, side, rank, p, q, None) for side in (BID, ASK) for rank, (p, q, _) in enumerate(a.engine.ladder(side, depth))]
            if snap or n % check_every == 0:
                violations += len(a.engine.violations())
        violations += len(a.engine.violations())
        totals = a.stats | {"fills": len(a.engine.fills), "rejected": a.engine.stats["rejected"], "violations": violations}
        return _table(out + [(symbol, None, None, None, None, v, k) for k, v in totals.items()], out_kind)

    return with_episode(l2).groupBy("symbol", "episode").applyInArrow(run, out_kind)


def level_messages(l2: DataFrame) -> DataFrame:
    """The normalised stream of a level feed: (symbol, seq, ts_us, order_id, price, size, type, side). seq: batch * 2**20 and the message's number in the batch."""
    from tideline.operators.book import with_episode

    def run(key, t):
        a, out = LevelAdapter(record=True), []
        for batch, ts, snap, rows in _batches(t):
            a.batch(ts, snap, rows)
            out += [(key[0].as_py(), (batch << 20) + k, *m) for k, m in enumerate(a.sent)]
            a.sent.clear()
        return _table(out, MESSAGES)

    return with_episode(l2).groupBy("symbol", "episode").applyInArrow(run, MESSAGES)


def whole_batches(l2: DataFrame, max_rows: int) -> DataFrame:
    """The first ``max_rows`` rows (by seq) of each symbol without the batch that the limit cuts: a batch is taken as a whole or not at all."""
    from tideline.operators.ordered import every, running_number

    x = running_number(l2, "_n", ["symbol"], ["seq"], every("seq", 100_000))
    # the batch of the last row allowed is still open when the limit is hit, as nothing after it was read
    edge = x.where(F.col("_n") >= max_rows - 1).groupBy("symbol").agg(F.min("batch").alias("_cut"), F.max("_n").alias("_last")).where(F.col("_last") >= max_rows)
    return x.join(F.broadcast(edge), "symbol", "left").where(F.col("_cut").isNull() | (F.col("batch") < F.col("_cut"))).select(*l2.columns)


def first_difference(engine: Engine, bids: list, asks: list, depth: int) -> tuple[str, int | None]:
    """(class, rank) of the first difference between the engine's book and a published one, asks before bids at a rank."""
    for rank in range(depth):
        for side, published in ((ASK, asks), (BID, bids)):
            have = engine.ladder(side, rank + 1)[rank:]
            want = published[rank : rank + 1]
            if not have and want:
                return "EngineShallow", rank
            if have and not want:
                return "EngineDeep", rank
            if have and have[0][0] != want[0]["price"]:
                return "PriceDiffers", rank
            if have and have[0][1] != want[0]["size"]:
                return "SizeDiffers", rank
    return "None", None


def single_step(rows: DataFrame, depth: int = 10) -> DataFrame:
    """(symbol, row_index, class, rank, touch_exact): for each feed row, the book before it is seeded, the row applied, and the result held against the book after it.

    rows: symbol, row_index, ts_us, type, order_id, size, price, side and bids, asks, next_bids, next_asks (arrays of struct<price, size>, best
    first). No state is shared, so any partitioning will do.
    """
    kind = "symbol string, row_index long, class string, rank int, touch_exact boolean"

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                a = OrderAdapter()
                a.seed(r["ts_us"], *[[(x["price"], x["size"]) for x in r[c]] for c in ("bids", "asks")])
                a.apply(r["ts_us"], r["type"], r["order_id"], r["size"], r["price"], r["side"])
                cls, rank = first_difference(a.engine, r["next_bids"], r["next_asks"], depth)
                out.append((r["symbol"], r["row_index"], cls, rank, rank != 0))
            yield from _table(out, kind).to_batches()

    return rows.mapInArrow(run, kind)


def replay_orders(feed: DataFrame) -> DataFrame:
    """(symbol, note, size): the order adapter's counters and the engine's, per symbol. feed: symbol, seq, ts_us, type, order_id, size, price, side.

    An order feed never resets, so a symbol is one sequence; its rows come sorted and are applied a batch at a time.
    """
    kind = "symbol string, note string, size long"

    def run(key, t):
        a = OrderAdapter()
        for b in t.sort_by("seq").to_batches(max_chunksize=10_000):
            for r in zip(*(b.column(c).to_pylist() for c in ("ts_us", "type", "order_id", "size", "price", "side")), strict=True):
                a.apply(*r)
        stats = a.stats | {f"engine_{k}": v for k, v in a.engine.stats.items()} | {"fills": len(a.engine.fills), "resting": a.engine.resting(), "residual": a.engine.residual()}
        return _table([(key[0].as_py(), k, v) for k, v in stats.items()], kind)

    return feed.groupBy("symbol").applyInArrow(run, kind)


def order_messages(feed: DataFrame) -> DataFrame:
    """The normalised stream of an order feed, numbered by symbol."""

    def run(key, t):
        a = OrderAdapter(record=True)
        for r in zip(*(t.sort_by("seq").column(c).to_pylist() for c in ("ts_us", "type", "order_id", "size", "price", "side")), strict=True):
            a.apply(*r)
        return _table([(key[0].as_py(), k, *m) for k, m in enumerate(a.sent)], MESSAGES)

    return feed.groupBy("symbol").applyInArrow(run, MESSAGES)


def exit_clean(stats: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """(symbol, clean): no violations, no fills, no stalled eviction and, with the parsed rows (symbol, status) given, none that is not Ok.

    Rows whose symbol could not be parsed count against every symbol.
    """
    bad = stats.where(F.col("note").isin("violations", "fills", "eviction_stalls")).groupBy("symbol").agg(F.sum("size").alias("bad"))
    if parsed is None:
        return bad.select("symbol", (F.col("bad") == 0).alias("clean"))
    wrong = parsed.where("status <> 'Ok'")
    own = wrong.groupBy("symbol").agg(F.count(F.lit(1)).alias("errors")).where("symbol is not null")
    anywhere = wrong.where("symbol is null").agg(F.count(F.lit(1)).alias("nowhere"))  # one row
    return bad.join(own, "symbol", "left").crossJoin(F.broadcast(anywhere)).select("symbol", ((F.col("bad") == 0) & F.col("errors").isNull() & (F.col("nowhere") == 0)).alias("clean"))
