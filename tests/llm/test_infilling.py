import hashlib
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import infilling
from palimpsest.llm.infilling import Chunks, digests, fill_in_middle, restored
from palimpsest.llm.queries import OP13_SQL, op13_fill_in_middle
from tests.llm.conftest import ODD

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain_form(doc_id, text, seed="1"):
    """The transformation by its statement, unit by unit."""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abZ é日\n<PS>M .🎉"), max_size=60), min_size=1, max_size=8), st.integers(0, 50))
def test_cuts_equal_a_unit_by_unit_match(parts, seed):
    rng = np.random.default_rng(seed)
    text = "".join(parts[k] * int(rng.integers(1, 9)) for k in rng.integers(0, len(parts), 20))
    chunks = Chunks()
    m = chunks.measured(text.encode())
    units = UNIT.findall(text)
    assert m.n == len(units)
    for t in {0, len(units), *rng.integers(0, len(units) + 1, 8).tolist()}:
        head = "".join(units[:t])
        assert m.cut(t) == (len(head.encode()), len(head))


def test_chunks_follow_the_content():
    rng = np.random.default_rng(0)
    letters = lambda n: "".join(rng.choice(list("abcdefgh ,.é"), n))
    shared = letters(20_000)
    chunks = Chunks()
    chunks.measured((letters(777) + shared).encode())
    before, hits = len(chunks.known), chunks.hits
    chunks.measured((letters(1234) + shared).encode())
    assert chunks.hits - hits > 20 and len(chunks.known) - before < 15
    for text in (b"x" * 100_000, ("é" * 50_000).encode(), letters(50_000).encode()):
        ends = infilling.chunk_ends(np.frombuffer(text, np.uint8))
        sizes = np.diff([0, *ends])
        assert ends[-1] == len(text) and sizes.max() <= infilling.MOST + 3 and sizes[:-1].min() >= infilling.LEAST
        for a, b in zip([0, *ends], ends):
            text[a:b].decode()


def test_a_small_cache_changes_nothing():
    text = " ".join(f"word{k % 700}" for k in range(20_000)).encode()
    small = Chunks(most=1000)
    assert small.measured(text).units == Chunks().measured(text).units and small.held < 20_000


def test_transformation_equals_its_statement(spark, make):
    rng = np.random.default_rng(1)
    texts = [*ODD, "a <S> b", "<", "<P", "x<M" * 40, *("".join(rng.choice(list("ab <PS>M\né"), int(rng.integers(1, 400)))) for _ in range(120))]
    docs = make(texts, {"form": "'mine'", "extra": "doc_id * 2", "output": "1"})
    got = {r.doc_id: r for r in fill_in_middle(docs).withColumn("back", restored()).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        r = got[k]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_form(k, text or "") and r.back == (text or "") and r.extra == 2 * k
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}


def test_defined_cases(spark, make):
    rows = [(None, "one two", "en", "a"), (7, "same text here", "en", "a"), (7, "same text here", "en", "a"), (8, None, "en", "a")]
    got = digests(make(rows)).collect()
    assert len(got) == 4 and len({tuple(r) for r in got if r.doc_id == 7}) == 1
    assert next(r for r in got if r.doc_id == 8).form == "plain" and next(r for r in got if r.doc_id is None).restored_sha256 == hashlib.sha256(b"one two").hexdigest()
    assert digests(make([])).collect() == []


def test_a_very_long_text(spark, make):
    text = "Ab, cé\n" * 200_000
    (r,) = fill_in_middle(make([(3, text, "en", "a")])).collect()
    assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_form(3, text)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = {r[0]: r for r in con.sql(f"SELECT doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 FROM ({OP13_SQL})").fetchall()}
    got = {r.doc_id: tuple(r) for r in op13_fill_in_middle(spark, sf).collect()}
    assert got == expected
