"""Matching, adapters and invariants: hand-computed cases and random sessions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.operators.adapters import LevelAdapter, OrderAdapter
from tideline.operators.engine import ADD, DELETE, MODIFY, RESET, TRADE, Engine
from tideline.sources.tape import Mix, Twister64, generate


def book(*orders):
    e = Engine()
    for oid, side, price, size in orders:
        e.apply(0, oid, price, size, ADD, side)
    return e


def deep():
    return book((101, 0, 998, 10), (102, 0, 999, 20), (103, 0, 1000, 30), (201, 1, 1003, 15), (202, 1, 1002, 25), (203, 1, 1001, 35))


def fills(e):
    return [(f[2], f[4], f[3]) for f in e.fills]


def test_best_first_and_queue():
    e = deep()
    assert [p for p, _, _ in e.ladder(0)] == [1000, 999, 998] and [p for p, _, _ in e.ladder(1)] == [1001, 1002, 1003]
    e.apply(0, 104, 1000, 7, ADD, 0)
    assert e.ladder(0)[0] == (1000, 37, 2) and list(e.levels[0][1000]) == [103, 104]


def test_rejects():
    e = deep()
    e.apply(0, 9, 1000, 0, ADD, 0)
    e.apply(0, 101, 1000, 5, ADD, 0)
    e.apply(0, 77, 0, 5, MODIFY, 0)
    e.apply(0, 77, 0, 0, DELETE, 0)
    assert e.stats["rejected"] == 4 and not e.violations()


@pytest.mark.parametrize(("size", "queue", "total"), [(4, [1, 2, 3], 24), (12, [2, 3, 1], 32), (10, [1, 2, 3], 30)])
def test_modify(size, queue, total):
    e = book((1, 0, 1000, 10), (2, 0, 1000, 10), (3, 0, 1000, 10))
    e.apply(0, 1, 0, size, MODIFY, 0)
    assert list(e.levels[0][1000]) == queue and e.ladder(0)[0][1] == total and not e.residual()


def test_modify_to_zero_counts_as_modify():
    e = book((1, 0, 1000, 10))
    e.apply(0, 1, 0, 0, MODIFY, 0)
    assert not e.ladder(0) and e.stats["modifies"] == 1 and e.stats["deletes"] == 0


def test_walk_remainder_and_priority():
    e = book((1, 1, 1001, 10), (2, 1, 1002, 10), (3, 1, 1003, 10))
    e.apply(0, 9, 1003, 25, ADD, 0)
    assert fills(e) == [(1, 10, 1001), (2, 10, 1002), (3, 5, 1003)] and not e.ladder(0)
    e = book((1, 1, 1001, 10))
    e.apply(0, 9, 1001, 14, ADD, 0)
    assert e.ladder(0) == [(1001, 4, 1)]
    e = book((201, 1, 1001, 5), (202, 1, 1001, 5), (203, 1, 1001, 5))
    e.apply(0, 9, 1001, 7, ADD, 0)
    assert fills(e) == [(201, 5, 1001), (202, 2, 1001)] and list(e.levels[1][1001]) == [202, 203] and e.ladder(1)[0][1] == 8


def test_reset_and_reuse():
    e = deep()
    e.apply(1, 0, 0, 0, RESET, 0)
    e.apply(1, 101, 0, 0, DELETE, 0)
    e.apply(1, 101, 0, 3, MODIFY, 0)
    e.apply(1, 101, 998, 3, ADD, 0)
    assert e.stats["rejected"] == 2 and e.ladder(0) == [(998, 3, 1)] and e.residual() == 0


def test_inject_never_rests():
    e = book(*[(i, 1, p, q) for i, (p, q) in enumerate([(100010, 10), (100020, 20), (100030, 30)])], *[(9 + i, 0, p, q) for i, (p, q) in enumerate([(99990, 10), (99980, 20), (99970, 30)])])
    got = e.inject(5, 1 << 63, 0, 15)
    assert len(got) == 2 and sum(f[3] * f[4] for f in got) == 100010 * 10 + 100020 * 5
    e.inject(6, 1 << 63, 0, 1000)
    assert sum(f[4] for f in e.fills) == 60 and not e.ladder(1) and len(e.ladder(0)) == 3


SHAPES = [Mix(), Mix(70, 5, 20, 5, 0, 1, 20), Mix(65, 10, 20, 4, 1, 40, 100), Mix(45, 10, 42, 2, 1, 8, 30), Mix(60, 10, 20, 5, 5, 5, 25)]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**63), st.sampled_from(range(5)))
def test_invariants_after_every_message(seed, shape):
    e = Engine()
    for m in generate(seed, 80, SHAPES[shape]):
        e.apply(*m)
        assert not e.violations()


def test_generator_is_the_published_one():
    r = Twister64(5489)
    assert r() == 14514284786278117030
    for _ in range(9998):
        r()
    assert r() == 9981545732273789042


def test_level_adapter_kinds():
    a = LevelAdapter()
    a.batch(0, False, [(0, 1000, 5000), (1, 1001, 5000)])
    for x in (2000, 9000, 9000, 0):
        a.batch(1, False, [(0, 1000, x)])
    a.batch(2, False, [(0, 990, 0)])
    s = a.stats
    assert (s["adds"], s["shrinks"], s["grows"], s["no_ops"], s["deletes"], s["unknown_deletes"]) == (2, 1, 1, 1, 1, 1)


def test_level_adapter_touch_and_crossed():
    a = LevelAdapter()
    a.batch(0, False, [(0, 1000, 5), (1, 1001, 5)])
    a.batch(1, False, [(0, 1001, 4), (1, 1001, 0)])
    assert not a.engine.fills and a.stats["crossed_adds"] == 0 and [p for p, _, _ in a.engine.ladder(0)] == [1001, 1000] and not a.engine.ladder(1)
    a = LevelAdapter()
    a.batch(0, False, [(1, 1001, 5), (1, 1002, 5)])
    a.batch(1, False, [(0, 1003, 7)])
    assert not a.engine.fills and a.stats["crossed_adds"] == 1 and a.stats["evictions"] == 2


def seeded():
    a = OrderAdapter()
    a.seed(0, [(1000, 7), (999, 8)], [(1001, 5), (1002, 6)])
    return a


def test_order_adapter():
    a = seeded()
    assert a.stats["init_levels"] == 4 and not a.live
    a.apply(1, 1, 555, 10, 1000, 0)
    assert a.engine.ladder(0)[0] == (1000, 17, 2)
    a.apply(1, 2, 555, 4, 1000, 0)
    assert a.engine.ladder(0)[0] == (1000, 13, 2)
    a = seeded()
    a.apply(1, 1, 777, 3, 1001, 0)
    assert a.stats["crossing_adds"] == 1 and len(a.engine.fills) == 1
    a = seeded()
    a.apply(1, 1, 9, 20, 1005, 1)
    a.apply(2, 4, 9, 8, 1005, 1)
    assert a.engine.prints == [(2, 1005, 8, 0)] and a.engine.ladder(1)[-1] == (1005, 12, 1)
    a.apply(3, 5, 0, 2, 1001, 1)
    a.apply(3, 7, 0, 0, 0, 0)
    assert a.stats["hidden"] == 1 and a.stats["halts"] == 1


def test_absorption_and_shortfall():
    a = seeded()
    a.apply(1, 2, 12345, 3, 1000, 0)
    assert a.engine.ladder(0)[0][1] == 4 and a.stats["absorptions"] == 1
    a = seeded()
    a.apply(1, 4, 12345, 10, 1000, 0)
    assert a.stats["shortfall"] == 3 and a.stats["seed_deletes"] == 1 and a.engine.prints[0][2] == 10
    a.apply(2, 3, 12345, 1, 500, 0)
    assert a.stats["unknown"] == 1
    assert TRADE == 3
