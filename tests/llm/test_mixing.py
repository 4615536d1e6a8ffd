from fractions import Fraction

from palimpsest.llm import mixing as m


def test_phases_use_every_block_once():
    blocks, weights = {"a": 100, "b": 3, "c": 40, "d": 0}, {"a": 0.2, "b": 0.5, "c": 0.3, "d": 1.0}
    plan = m.phases(blocks, weights, 100)
    slots = sorted(begin + i // share * period + own[i % share] for _, a, z, begin, period, share, own in plan for i in range(z - a))
    assert slots == list(range(143))
    for s, n in blocks.items():
        assert [b for x, a, z, *_ in plan if x == s for b in range(a, z)] == list(range(n))


def source_of(k):
    return ["hot", "hot", "b", "c", None][k % 5]


def test_mixed_table(make):
    rows = [(k, f"text {k}", "en", source_of(k)) for k in range(700)] + [(5, "other", "en", "hot"), (5, "other", "en", "hot"), (None, "x", "en", "b")]
    docs = make(rows, {"slot": "1", "n": "2", "__n": "3", "range": "4", "draw": "5", "row": "6"})
    weights = {"hot": 0.5, "b": 0.3, "c": 0.15}
    out = m.mixed(docs, weights, block_docs=8, period=100)
    assert out.columns == [*docs.columns, "mix_block", "mix_slot", "mix_offset"]
    got = out.collect()
    assert sorted(repr(tuple(r)[: len(docs.columns)]) for r in got) == sorted(repr(tuple(r)) for r in docs.collect())
    blocks = {}
    for r in got:
        blocks.setdefault(r.mix_slot, []).append(r)
    assert sorted(blocks) == list(range(len(blocks)))
    last = {}
    for rs in blocks.values():
        assert len({(r.source, r.mix_block) for r in rs}) == 1 and sorted(r.mix_offset for r in rs) == list(range(len(rs)))
        last[rs[0].source] = max(last.get(rs[0].source, 0), rs[0].mix_block)
    assert all(len(rs) == 8 or rs[0].mix_block == last[rs[0].source] for rs in blocks.values())
    order = [blocks[k][0].source for k in sorted(blocks)]
    shares = {s: Fraction(str(w)) for s, w in weights.items()} | {None: Fraction("0.15")}  # the null source has the least weight
    total = sum(shares.values())
    first_out = min(max(i for i, x in enumerate(order) if x == s) for s in ("hot", "b", "c", None))
    for s, w in shares.items():
        for t in range(first_out):
            assert abs(sum(x == s for x in order[: t + 1]) - w / total * (t + 1)) < 1
    again = m.mixed(docs.repartition(7), weights, block_docs=8, period=100)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got))


def test_interleaved_and_odd_tables(make):
    docs = make([(k, "t", "en", source_of(k)) for k in range(200)])
    out = m.interleaved(docs, block_docs=4)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == list(range(200))
    slots = {r.doc_id: (r.mix_slot, r.mix_offset) for r in m.mixed(docs, block_docs=4).collect()}
    order = [slots[r.doc_id] for r in out.collect()]
    assert order == sorted(order)
    assert m.mix_order(make([])).collect() == [] and m.interleaved(make([])).count() == 0
    alone = m.mix_order(make([(None, None, None, None)])).collect()
    assert [(r.source, r.mix_block, r.mix_slot, r.mix_offset) for r in alone] == [(None, 0, 0, 0)]
