import random

import numpy as np
import pytest

from palimpsest.plans import labels as L
from palimpsest.plans.labels import Chunk, bounds, chain, labelled, rising_rows, with_positions


def rows_of(spark, order, old):
    """Rows in a new order, with the labels they had."""
    return spark.createDataFrame([(k, i, old.get(k)) for i, k in enumerate(order)], "rowid long, n_pos long, o_label long")


def check(spark, tmp_path, order, old, most_new, chunk=8):
    got = {r.rowid: r.label for r in labelled(rows_of(spark, order, old), str(tmp_path / f"l{random.random()}"))[0].collect()}
    line = [got[k] for k in order]
    assert all(a < b for a, b in zip(line, line[1:])) and len(got) == len(order)
    assert sum(got[k] != old.get(k) for k in order) <= most_new
    return got


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 8)


FIRST = {k: (k + 1) << L.GAP for k in range(40)}


def test_rows_that_go_change_no_label(spark, tmp_path, small):
    check(spark, tmp_path, [k for k in range(40) if k not in (0, 7, 8, 9, 39)], FIRST, 0)
    check(spark, tmp_path, list(range(30, 40)), FIRST, 0)


def test_new_rows_lie_between(spark, tmp_path, small):
    order = [100, 101, *range(5), *range(102, 130), *range(5, 40), 130, 131]  # more than a chunk of new ones in the middle
    check(spark, tmp_path, order, FIRST, 32)
    check(spark, tmp_path, list(range(200, 230)), FIRST, 30)


def test_moved_rows(spark, tmp_path, small):
    check(spark, tmp_path, [*range(1, 40), 0], FIRST, 1)
    check(spark, tmp_path, [39, *range(39)], FIRST, 1)
    check(spark, tmp_path, [*range(10), 25, *range(10, 25), *range(26, 40)], FIRST, 1)
    check(spark, tmp_path, [*range(20, 40), *range(20)], FIRST, 24)  # whole chunks change places
    check(spark, tmp_path, list(range(39, -1, -1)), FIRST, 39)


def test_no_room(spark, tmp_path, small):
    tight = {k: k + 5 for k in range(40)}
    got = check(spark, tmp_path, [*range(12), 90, *range(12, 40)], tight, 41)
    assert got[90] and labelled(rows_of(spark, [0, 90, *range(1, 40)], tight), str(tmp_path / "x"))[1]
    wide = FIRST | {k: FIRST[10] + k - 10 for k in range(11, 13)}
    check(spark, tmp_path, [*range(11), 90, *range(11, 40)], wide, 12)  # one chunk gets labels anew


@pytest.mark.parametrize("seed", range(4))
def test_any_order(spark, tmp_path, small, seed):
    r = random.Random(seed)
    old, order = dict(FIRST), list(range(40))
    for step in range(3):
        for _ in range(r.randint(1, 6)):
            what = r.random()
            if what < 0.4 and len(order) > 5:
                order.pop(r.randrange(len(order)))
            elif what < 0.7:
                order.insert(r.randrange(len(order) + 1), 1000 + r.randrange(10**6))
            else:
                k = order.pop(r.randrange(len(order)))
                order.insert(r.randrange(len(order) + 1), k)
        got = check(spark, tmp_path, order, old, len(order))
        old = got
        positions = {x.rowid: x.pos for x in with_positions(spark.createDataFrame(list(got.items()), "rowid long, label long")).collect()}
        assert [positions[k] for k in order] == list(range(len(order)))


def test_positions_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(L, "RANGE", 3)
    monkeypatch.setattr(L, "UPPER", 2)
    r = random.Random(1)
    rows = [(by, x) for by in (0, 1) for x in r.sample(range(-300, 900), 200)]
    got = with_positions(spark.createDataFrame(rows, "version int, label long"), "version").collect()
    for by in (0, 1):
        expected = sorted(x for b, x in rows if b == by)
        assert [(x.label, x.pos) for x in sorted(got, key=lambda x: x.label) if x.version == by] == [(x, i) for i, x in enumerate(expected)]


def test_rising_subsequence_is_a_longest_one():
    r = random.Random(0)
    for _ in range(50):
        x = [r.randrange(50) for _ in range(r.randint(0, 25))]
        found = rising_rows(np.array(x, np.int64)).tolist()
        best = [1] * len(x)
        for i in range(len(x)):
            best[i] = 1 + max((best[j] for j in range(i) if x[j] < x[i]), default=0)
        assert found == sorted(found) and all(x[a] < x[b] for a, b in zip(found, found[1:])) and len(found) == max(best, default=0)


def test_chain_holds_the_most_labels():
    r = random.Random(2)
    for _ in range(40):
        chunks = []
        for k in range(r.randint(1, 8)):
            a = r.randrange(30)
            chunks.append(Chunk(k, 5, r.randint(0, 5), True, False, a, a + r.randrange(9), 0, 0))
        held = [c for c in chunks if c.held]
        options = [[]]
        for c in held:
            options += [o + [c] for o in options if not o or o[-1].last < c.first]
        best = max(sum(c.held for c in o) for o in options)
        found = [c for c in held if c.number in chain(chunks)]
        assert all(a.last < b.first for a, b in zip(found, found[1:])) and sum(c.held for c in found) == best


def test_bounds_leave_room():
    r = random.Random(3)
    for _ in range(60):
        chunks, at = [], 0
        for k in range(r.randint(1, 7)):
            held = r.random() < 0.6
            head, tail, inner = r.randint(0, 3), r.randint(0, 3), r.randint(0, 4)
            first = at + r.randint(1, 40) if held else None
            last = first + r.randint(0, 20) if held else None
            n = head + tail + inner + 1
            chunks.append(Chunk(k, n, inner + 1 if held else 0, True, False, first, last, head if held else n, tail if held else 0))
            at = last if held else at
        limits = bounds(chunks)
        if limits is None:
            continue
        end = None
        for c in chunks:
            low, high = limits[c.number]
            spaces = [(low, c.first, c.head), (c.last, high, c.tail)] if c.held else [(low, high, c.n)]
            for a, z, n in spaces:
                assert z - a > n and (end is None or a >= end)
                end = z
