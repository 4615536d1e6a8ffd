import random

import pytest

from palimpsest.llm import hamming as h


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(codes, queries, k):
    out = []
    for q, a in queries:
        near = sorted(((a ^ b).bit_count(), i) for i, b in codes if i != q)[:k]
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, None if c is None else signed(c)) for i, c in rows], "id long, code long")


@pytest.mark.parametrize("k, segments", [(1, None), (7, None), (7, 3), (4, 5)])
def test_top_k_against_brute_force(spark, monkeypatch, k, segments):
    if segments:  # other widths than for so many codes
        own = h.segments_for
        monkeypatch.setattr(h, "segments_for", lambda n: own(2 ** (64 // segments)))
    r = random.Random(k)
    centres = [r.getrandbits(64) for _ in range(12)]
    codes = [(i, r.getrandbits(64)) for i in range(150)]
    for i in range(150, 420):
        c = r.choice(centres)
        for b in r.sample(range(64), r.randint(0, 9)):
            c ^= 1 << b
        codes.append((i, c))
    codes += [(1000 + i, centres[0]) for i in range(200)]  # one code that a third of all rows have
    queries = [x for x in codes if x[0] % 23 == 0 or x[0] in (1001, 1002)]
    got = sorted(map(tuple, h.top_k(table(spark, codes), table(spark, queries), k).collect()))
    assert got == brute(codes, queries, k)


def test_far_neighbours_take_more_rounds(spark):
    r = random.Random(3)
    codes = [(i, r.getrandbits(64)) for i in range(60)] + [(100 + i, r.getrandbits(18)) for i in range(300)]
    got = sorted(map(tuple, h.top_k(table(spark, codes), table(spark, codes[50:90]), 5).collect()))
    assert got == brute(codes, codes[50:90], 5)
    few = [(i, r.getrandbits(64)) for i in range(5)]  # every other row is wanted, however far
    assert sorted(map(tuple, h.top_k(table(spark, few), table(spark, few), 9).collect())) == brute(few, few, 9)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_given_vectors(spark, sf):
    """All queries of the given tables, every one of them ended by its bound, against all pairs."""
    codes = h.sign_codes(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet"), "vec_id", "embedding")
    rows = [(r.id, r.code % (1 << 64)) for r in codes.collect()]
    got = sorted(map(tuple, h.top_k(codes, codes.where("id % 100 = 0"), 10).collect()))
    assert got == brute(rows, [x for x in rows if x[0] % 100 == 0], 10) and not hasattr(h, "_scanned")


def test_segments():
    for n, m in ((0, 16), (10, 16), (500, 9), (2000, 7), (51_000, 5), (1 << 21, 3), (1 << 32, 2)):
        found = h.segments_for(n)
        assert len(found) == m and found[0][0] == 0 and sum(w for _, w in found) == 64 and all(a + w == b for (a, w), (b, _) in zip(found, found[1:]))


def test_few_rows_nulls_and_repeats(spark):
    codes = table(spark, [(1, 5), (1, 5), (2, 5), (3, 1 << 63), (None, 7), (4, None)])
    got = sorted(map(tuple, h.top_k(codes, codes, 10).collect()))
    assert got == brute([(1, 5), (2, 5), (3, 1 << 63)], [(1, 5), (2, 5), (3, 1 << 63)], 10)
    none = table(spark, [])
    assert h.top_k(none, none).collect() == [] and h.top_k(codes, none).collect() == []
    alone = table(spark, [(1, 5)])
    assert h.top_k(alone, alone).collect() == []


def test_codes(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, -2.0]), (4, None), (5, []), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 2.0])]
    got = {r.id: r.code for r in h.sign_codes(spark.createDataFrame(rows, "k long, v array<float>"), "k", "v").collect()}
    assert sorted(got) == [1, 2, 3, 8] and got[1] == got[2] == ~got[3]
