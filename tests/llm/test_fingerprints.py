import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import fingerprints as f

from .conftest import EN, ODD

WORDS = [a + b for a in "ba ce di fo gu ha lo mi nu re sa te".split() for b in "n r s t l m".split()]


def prose(seed, n=600):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def test_entropy_levels_match_a_plain_count():
    b = np.frombuffer((prose(1) + "a" * 300 + prose(2)).encode(), np.uint8)
    levels = f._entropies(b)
    assert len(levels) == len(b) - 63
    for i in range(0, len(levels), 37):
        total = sum(int(f._G[c]) for c in Counter(b[i : i + 64].tolist()).values())
        assert levels[i] == (f._MOST - total) * 1000 // f._MOST


def test_segments_and_neighbours_do_not_matter(monkeypatch):
    texts = [prose(k, 300 + 100 * k).encode() for k in range(6)] + [b"", b"short", b"z" * 900]
    ranks = f.rarity_ranks(f.entropy_counts(texts))
    whole = f.digests(texts, ranks)
    for text, (n, filters) in zip(texts, whole):
        m, alone = f.digests([text], ranks)[0]
        assert n == m and (filters == alone).all()
    monkeypatch.setattr(f, "SEGMENT", 500)
    assert all(a[0] == b[0] and (a[1] == b[1]).all() for a, b in zip(whole, f.digests(texts, ranks)))
    assert [n for n, _ in whole[6:]] == [0, 1, 0]


def test_popular_windows_match_brute_force():
    rng = np.random.default_rng(0)
    ranks = rng.integers(0, 50, 400).astype(np.int32)
    ranks[rng.random(400) < 0.1] = f._OUT
    points = np.zeros(400, int)
    for i in range(400 - 63):
        run = ranks[i : i + 64]
        if run.min() < f._OUT:
            points[i + int(run.argmin())] += 1
    assert f._popular(ranks).tolist() == np.flatnonzero(points >= f.POINTS).tolist()


def test_edits_are_digested_as_from_scratch():
    texts = [prose(k, 20 + 60 * k).encode() for k in range(8)] + [b"tiny", b"", b"x" * 200]
    ranks = f.rarity_ranks(f.entropy_counts(texts))
    found = f.features(texts, ranks)
    cases = [(t, len(t) - len(t) // 4, texts[(k + 1) % len(texts)][: len(t) // 4], g) for k, (t, g) in enumerate(zip(texts, found))]
    for (blob, cut, end, _), (n, filters) in zip(cases, f.edited_digests(cases, ranks)):
        m, anew = f.digests([blob[:cut] + end], ranks)[0]
        assert n == m and (filters == anew).all()


def test_likeness_is_high_for_copies_and_low_for_others():
    a, b = prose(1).encode(), prose(2).encode()
    near = a[: len(a) * 3 // 4] + b[: len(a) // 4]
    da, db, dn, none = f.digests([a, b, near, b""], f.rarity_ranks(f.entropy_counts([a, b])))
    assert f.likeness(da, da) == 1 and f.likeness(da, dn) > 0.5 > 0.2 > f.likeness(da, db)
    assert f.likeness(none, none) == 1 and f.likeness(none, da) == 0 and 0 <= f.likeness(dn, da) <= 1


@pytest.mark.parametrize("ids", ["plain", "ties"])
def test_compare_edited_against_brute_force(make, ids):
    texts = [prose(k, 30 + 17 * k) for k in range(25)] + ODD
    rows = [(k * 7 if ids == "plain" else k // 3, t, "en", "s") for k, t in enumerate(texts)]
    if ids == "ties":
        rows += [(None, EN, "en", "s"), (None, None, "en", "s")]
    random.Random(3).shuffle(rows)
    docs = make(rows, {"fingerprint": "1", "part": "2"})
    got = sorted(f.compare_edited(docs).collect(), key=repr)
    order = sorted(((i, t or "") for i, t, _, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    ranks = f.rarity_ranks(f.entropy_counts([t.encode() for _, t in order]))
    expected = []
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        d, e, n = f.digests([x.encode() for x in (t, edited, following)], ranks)
        expected.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f.written_as(d), f.written_as(e), f.likeness(d, e), f.likeness(d, n)))
    assert [tuple(r) for r in got] == sorted(expected, key=lambda r: repr(f_row(r)))


def f_row(r):
    from pyspark.sql import Row

    return Row(doc_id=r[0], n_chars=r[1], edited_sha256=r[2], fingerprint=r[3], edited_fingerprint=r[4], near_edited=r[5], near_next=r[6])


def test_operator_keeps_columns_and_equal_texts(make):
    out = f.fingerprints(make(ODD, {"fingerprint": "5", "level": "6"})).collect()
    assert len(out) == len(ODD) and out[7].fingerprint == out[8].fingerprint and out[0].fingerprint == "0:" and out[0].level == 6
    assert f.compare_edited(make([])).collect() == [] and f.fingerprints(make([])).count() == 0
