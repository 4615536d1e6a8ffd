import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from palimpsest.llm import sentencepieces as sp
from palimpsest.llm import tokencounts as tc
from palimpsest.llm import tokenfiles as tf

from .conftest import EN, FR, ODD

WORD, BYTE, PIECE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
HARD = [
    *[x or "" for x in ODD], EN, FR, "  a   b\n\n c ", "it's they'LL don't 'S", "a<|endoftext|>b <|startoftext|>", "ΑΣ İ ﬁ é́ ñ ß Ÿ ª µ", "tab\t\x0b\x0c\x1c\x85\xa0　x", "3.14 1000000 ١٢٣",
    "!!! ??? ### &&& – — “q” €", "aaaaaaaaaaaaaaaaaaaaaaaa bbbbbbbbbb abababababab", "<s> </s> <unk> <0x41>", "=" * 70 + " " * 20 + "x", "🎉🎊👨‍👩‍👧 é", "'", " ", "Ça… « oui » !",
]


@pytest.mark.parametrize("unit", ["byte", "bit"])
def test_planes(unit):
    r = np.random.default_rng(0)
    for ids in (r.integers(0, 50_000, 1000), r.integers(0, 200_000, 777), np.array([], int), np.array([65_535])):
        width, planes = tf.pack(ids.astype(np.uint32), unit)
        assert tf.unpack(width, planes, len(ids)).tolist() == ids.tolist() and len(planes) == (width if unit == "bit" else width // 8)


def test_joined_checksums():
    for a, b in ((b"", b"x"), (b"abc", b""), (b"abc" * 99, b"defg" * 1234)):
        assert tf.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def expected_index(rows):
    t = Tokenizer.from_file(WORD)
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("block", [1 << 16, 64, 1])
def test_files_round_trip(make, monkeypatch, block):
    monkeypatch.setattr(tf, "BLOCK", block)
    texts = HARD if block > 1 else HARD[:12]
    rows = [((k * 37) % 101, t) for k, t in enumerate([*texts, None, (EN + " ") * (40 if block > 1 else 1)])]
    docs = make([(i, t, "en", "s") for i, t in rows], {"ids": "1", "shard": "2"})
    assert sorted(map(tuple, tf.round_trip(docs, WORD, 2).collect())) == expected_index(rows)


def test_files_of_odd_tables(spark, make, tmp_path):
    assert tf.round_trip(make([]), WORD, 2).collect() == []
    ties = make([(1, "b", "en", "s"), (1, "a", "en", "s"), (None, "c", "en", "s")])
    tf.write_ids(ties, str(tmp_path / "f"), WORD, 2, unit="bit")
    index = sorted(map(tuple, tf.read_index(spark, str(tmp_path / "f")).collect()), key=lambda r: r[1])
    assert [r[0] for r in index] == [None, 1, 1] and [r[1] for r in index] == [0, 2, 4]
    assert sum(len(r.ids) for r in tf.read_ids(spark, str(tmp_path / "f")).collect()) == 6


def test_counts_match_library(make):
    t = Tokenizer.from_file(BYTE)
    docs = make(HARD, {"n_tokens": "1", "over_limit": "2"})
    for r, text in zip(sorted(tc.document_counts(docs, BYTE, 20).collect()), HARD):
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 20), text
    assert tc.document_counts(make([]), BYTE).collect() == [] and tc.document_counts(make([None]), BYTE).collect()[0][1:] == (0, 0, False)


def test_counts_begin_anew_and_other_vocabularies():
    t = Tokenizer.from_file(BYTE)
    small = tc.TokenCounter(BYTE, most=5)
    for _ in range(2):
        assert small.counts(HARD) == [len(x.ids) for x in t.encode_batch(HARD, add_special_tokens=False)]
    processor = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert tc.TokenCounter(PIECE).counts(HARD) == [len(processor.encode(x)) for x in HARD]
    assert tc.TokenCounter(WORD).counts(HARD) == [len(x.ids) for x in Tokenizer.from_file(WORD).encode_batch(HARD, add_special_tokens=False)]


def test_sentencepiece_parity(make):
    processor = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = sorted(sp.encoded(make(HARD, {"ids": "1", "matched": "2"}), PIECE).collect(), key=lambda r: r.doc_id)
    for r, text in zip(rows, HARD):
        assert r.ids == processor.encode(text) and r.matched and r.n_tokens == len(r.ids), text
        assert r.restored == (processor.decode(r.ids) == text)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    backend, whole = sp.Backend(PIECE, 1), sp.build(PIECE)
    ids = [processor.encode(t) for t in (*HARD, "\u2581a \u2581\u2581 b", "   ", "\u2603\u2581")]
    assert backend.decode(ids) == whole.decode_batch(ids, skip_special_tokens=False) == [processor.decode(x) for x in ids]
    back = sp.decoded(sp.encoded(make([EN, None, FR]), PIECE), PIECE).orderBy("doc_id").collect()
    assert [r.decoded for r in back] == [EN, "", FR]
    assert sp.document_ids(make([]), PIECE).collect() == []


def test_texts_are_marked_before_they_are_encoded():
    """The normalizer's steps took almost half of the time of an encoding."""
    backend, whole = sp.Backend(PIECE, 1), sp.build(PIECE)
    texts = [*HARD, "", " ", "   ", "\n ", " a", "\u2581a \u2581\u2581 b", "\u2603\u2581", "a  \u2581 ", "\0 a\r\n  b"]
    assert whole.normalizer is not None and str(backend.tokenizer.normalizer) == "Sequence(normalizers=[])"
    assert backend.encode(texts) == [whole.encode(t, add_special_tokens=False).ids for t in texts] == backend.expected(texts)


def test_unigram_models_are_rebuilt(tmp_path):
    """A unigram model written by hand: pieces, unknown, and byte fallback off."""
    import struct

    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    def field(number, data):
        return varint(number << 3 | 2) + varint(len(data)) + data

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("▁a", -2.5, 1), ("ab", -3.2, 1), ("▁ab", -4.0, 1)]
    body = b"".join(field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(k)) for p, s, k in pieces)
    body += field(2, varint(3 << 3) + varint(1)) + field(3, field(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(1) + varint(5 << 3) + varint(1))
    path = tmp_path / "u.model"
    path.write_bytes(body)
    reference, rebuilt = sentencepiece.SentencePieceProcessor(model_file=str(path)), sp.build(str(path))
    for text in ("ab ab", "a b", "aabb abab", "", "  a  b ", "axb"):
        assert rebuilt.encode(text, add_special_tokens=False).ids == reference.encode(text), text
