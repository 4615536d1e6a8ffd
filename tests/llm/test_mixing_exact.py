import random
import time
from fractions import Fraction

import pytest

from palimpsest.llm import mixing as m


def lags(order, weights):
    """The greatest lag against the target weights, up to the slot in which the first source has its last block."""
    total = sum(Fraction(str(w)) for w in weights.values())
    first_out = min(max(t for t, x in enumerate(order) if x == s) for s in weights)
    worst = Fraction(0)
    for s, w in weights.items():
        had, w = 0, Fraction(str(w)) / total
        for t in range(first_out + 1):
            had += order[t] == s
            worst = max(worst, abs(had - w * (t + 1)))
    return worst


def order_of(plan):
    slots = {}
    for s, a, z, begin, period, share, own in plan:
        for i in range(z - a):
            slots[begin + i // share * period + own[i % share]] = s
    assert sorted(slots) == list(range(len(slots)))
    return [slots[t] for t in range(len(slots))]


@pytest.mark.parametrize("weights", [{"a": 0.61234, "b": 0.38716, "c": 0.0005}, {"a": 1 / 3, "b": 2**0.5, "c": 0.1, "d": 1e-4}])
def test_lag_against_the_target_weight_stays_below_one(weights):
    total = sum(weights.values())
    blocks = {s: int(12_000 * w / total) + 1 for s, w in weights.items()}
    assert lags(order_of(m.phases(blocks, weights, 1000)), weights) < 1


def test_random_weights_and_phases():
    r = random.Random(2)
    for _ in range(40):
        weights = {f"s{k}": r.random() ** 3 + 1e-5 for k in range(r.randint(1, 9))}
        blocks = {s: r.randint(1, 60) for s in weights}
        order = order_of(m.phases(blocks, weights, 7))
        assert {s: order.count(s) for s in blocks} == blocks and lags(order, weights) < 1
    assert order_of(m.phases({"a": 2, "b": 3, "c": 1}, {"a": 0.0, "b": 1.0, "c": 0.0}, 7))[:3] == ["b", "b", "b"]


def test_very_many_sources():
    blocks = {f"s{k}": 1 + k % 5 for k in range(3000)}
    began = time.process_time()
    assert len(order_of(m.phases(blocks, {s: n**0.5 for s, n in blocks.items()}, 1000))) == sum(blocks.values())
    assert time.process_time() - began < 20


def test_mixed_against_the_target_weight(make):
    weights = {"a": 0.7004, "b": 0.2992, "c": 0.0004}
    docs = make([(k, f"t {k}", "en", "c" if k % 2500 == 0 else "ab"[k % 10 < 3]) for k in range(5000)])
    got = m.mixed(docs, weights, block_docs=1).collect()
    order = [r.source for r in sorted(got, key=lambda r: r.mix_slot)]
    assert [r.mix_slot for r in sorted(got, key=lambda r: r.mix_slot)] == list(range(5000)) and lags(order, weights) < 1
