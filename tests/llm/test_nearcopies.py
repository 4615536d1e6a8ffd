import random

import numpy as np
import pytest

from palimpsest.llm import nearcopies as n
from palimpsest.llm.simhash import shingle_hashes


def prose(r, k):
    return [f"w{r.randrange(5000)}" for _ in range(k)]


def edited(r, words, k):
    out = list(words)
    for at in r.sample(range(len(out)), k):
        out[at] = f"x{r.randrange(10**6)}"
    return out


def kept_by_loops(rows, words=5, similarity=0.8):
    sets = {i: set(shingle_hashes(t, words).tolist()) for i, t in rows}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            a, b = sets[i], sets[j]
            if i < j and (a == b or len(a & b) >= similarity * len(a | b)):
                x, y = root[i], root[j]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return sorted(i for i in root if root[i] == i)


@pytest.mark.parametrize("crowd, small", [(256, 1000), (24, 0), (3, 1000)])
def test_every_pair_at_the_similarity_is_met_and_others_stay(make, monkeypatch, crowd, small):
    monkeypatch.setattr(n, "SMALL", small)
    r = random.Random(4)
    rows = []
    for k in range(30):
        base = prose(r, r.randint(60, 240))
        rows.append(" ".join(base))
        rows += [" ".join(edited(r, base, e)) for e in (1, 2, 3, len(base) // 40, len(base) // 25, len(base) // 12)]
    passage = prose(r, 30)
    rows += [" ".join(passage + prose(r, 12)) for _ in range(12)] + ["", "a b", "A  b", "a b c"]
    rows = [(k * 7 % 997, t) for k, t in enumerate(rows)]
    kept = n.without_near_copies(make([(i, t, "en", "s") for i, t in rows]), crowd=crowd)
    expected = kept_by_loops(rows)
    assert sorted(x.doc_id for x in kept.collect()) == expected and len(expected) < len(rows) - 60


def test_similar_sets_share_least_shingles():
    r = np.random.default_rng(2)
    shared = []
    for _ in range(300):
        a = r.integers(0, 1 << 63, 270).astype(np.uint64)
        b = np.unique(np.concatenate((a[30:], r.integers(0, 1 << 63, 30).astype(np.uint64))))  # Jaccard 0.8
        shared.append(int((n.least_shingles(np.unique(a)) == n.least_shingles(b)).sum()))
    assert min(shared) > 0 and abs(np.mean(shared) / n.DRAWS - 0.8) < 0.03 and np.var(shared) < 1.5 * n.DRAWS * 0.16
    assert not len(n.least_shingles(np.empty(0, np.uint64))) and len(set(n.least_shingles(np.array([7], np.uint64)).tolist())) == n.DRAWS


def test_prefixes_of_similar_sets_meet():
    r = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(r.integers(0, 1 << 62, r.integers(1, 60)).astype(np.uint64))
        b = np.unique(np.concatenate((r.permutation(a)[: len(a) - int(len(a) * 0.1)], r.integers(0, 1 << 62, int(len(a) * 0.1)).astype(np.uint64))))
        hot = r.permutation(a)[: len(a) // 3]
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            assert len(np.intersect1d(n.prefix(a, 0.8, hot), n.prefix(b, 0.8, hot)))


def test_repeated_and_missing_ids(make):
    docs = make([(1, "a b c", "en", "s"), (1, "d e f", "en", "s"), (None, "a b c", "en", "s"), (None, "a b c", "en", "s"), (2, "q r s", "en", "s"), (3, "Q r s", "en", "s")])
    kept = n.without_near_copies(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id or -1 for x in kept.collect()) == [-1, -1, 1, 2]
    assert n.without_near_copies(make([])).count() == 0
