import random
import re

import pytest
import xxhash

from palimpsest.llm import components as c
from palimpsest.llm import simhash as s

from .conftest import ODD


def plain_fingerprint(text, words):
    text = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    tokens = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or [" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints):
    """(doc_id, fingerprint) pairs to doc_id -> smallest linked id, by all pairs."""
    parent = {i: i for i, _ in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(prints):
        for j, b in prints[:k]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in prints}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def cloud(n, seed):
    """Fingerprints with dense groups, sparse ones, and chains at the limit."""
    r = random.Random(seed)
    out = [0, 1, (1 << 64) - 1]
    for _ in range(n // 20):
        base = r.getrandbits(64)
        out.append(base)
        for _ in range(12):
            x = r.choice(out[-12:])
            for b in r.sample(range(64), r.choice([1, 2, 3, 3, 4, 5])):
                x ^= 1 << b
            out.append(x)
        out += [r.getrandbits(64) for _ in range(7)]
    return sorted(set(out))


@pytest.mark.parametrize("crowd", [256, 2, 1])
def test_links_connect_what_all_pairs_connect(spark, crowd):
    prints = cloud(260, crowd)
    found = c.components(s.links(spark.createDataFrame([(signed(x),) for x in prints], "simhash long"), crowd)).collect()
    expected = plain_components([(signed(x), x) for x in prints])
    groups = {}
    for i, root in expected.items():
        groups.setdefault(root, set()).add(i)
    got = {}
    for r in found:
        got.setdefault(r.component, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)
    assert all(min(members) == name for name, members in got.items())


@pytest.mark.parametrize("words", [3, 5])
def test_near_duplicates_against_brute_force(make, words):
    r = random.Random(words)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = list(ODD)
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 40, 300]))]
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append("  ".join(copy).upper() if r.random() < 0.3 else "\t".join(copy))
    docs = make([(1000 - k, t, "en", "s") for k, t in enumerate(texts)], {"simhash": "1", "component": "2", "key": "3"})
    got = {x.doc_id: (x.simhash % (1 << 64), x.component_id) for x in s.near_duplicates(docs, words=words).collect()}
    prints = [(1000 - k, plain_fingerprint(t, words)) for k, t in enumerate(texts)]
    roots = plain_components(prints)
    assert got == {i: (p, roots[i]) for i, p in prints}
    kept = s.deduplicated(docs, words=words)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted(set(roots.values()))


def test_odd_tables(make):
    assert s.near_duplicates(make([])).collect() == [] and s.deduplicated(make([])).count() == 0
    twice = make([(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (None, "a b c", "en", "s"), (2, "a b c", "en", "s")])
    assert sorted((x.doc_id or -1, x.component_id) for x in s.near_duplicates(twice).collect()) == [(-1, 1), (1, 1), (1, 1), (2, 1)]
    assert sorted(x.doc_id or -1 for x in s.deduplicated(twice).collect()) == [-1, 1]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.component for r in c.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}
    assert c.components(spark.createDataFrame([], "u long, v long")).count() == 0
