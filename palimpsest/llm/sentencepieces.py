"""SentencePiece models on the tokenizers library.

The model file's protobuf is read here: pieces with their scores and types, and
the trainer's and normaliser's settings. From them a tokenizer is built that
gives the same ids: the precompiled character map and the handling of spaces as
normaliser with the metaspace marker, unigram scores as a unigram model or, for
BPE models, the merges that the scores imply, and byte fallback for characters
that no piece has. Batches are encoded and decoded by the library's threads.

Every whole text goes through the normaliser, the splitter and the model of the
rebuilt tokenizer, through the reference library and back through the decoder:
``matched`` says for each document that both libraries gave the same ids, and
``restored`` that decoding gave the text back.

Defined cases: a null text is empty and has no ids; equal texts have equal ids;
lone surrogates can't be in a UTF-8 column; control pieces (<s>, </s>) written
out in a text are ordinary text; a very long text is a batch of its own; an empty
table gives an empty result; other columns are kept whatever their names.
"""

from __future__ import annotations

import os
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import by_bytes, with_fields

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class SpModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # (piece, score, type)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_space: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message: ints, or bytes as they are."""

    def varint(at):
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"protobuf wire type {kind}")
        yield key >> 3, value


def read_model(path: str) -> SpModel:
    out = SpModel()
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            out.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    out.kind = v
                elif n == 24:
                    out.suffix_space = bool(v)
                elif n == 35:
                    out.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    out.charsmap = v
                elif n == 3:
                    out.dummy_prefix = bool(v)
                elif n == 4:
                    out.squeeze = bool(v)
                elif n == 5:
                    out.escape = bool(v)
    return out


def implied_merges(model: SpModel) -> list[tuple[str, str]]:
    """Every way to make a piece of two others, pieces of higher score first."""
    usable = {p for p, _, kind in model.pieces if kind in (NORMAL, USER)}
    ranked = sorted((-score, k, p) for k, (p, score, kind) in enumerate(model.pieces) if kind == NORMAL and len(p) > 1)
    return [(p[:c], p[c:]) for _, _, p in ranked for c in range(1, len(p)) if p[:c] in usable and p[c:] in usable]


def build(path: str):
    """A tokenizers.Tokenizer with the ids of the SentencePiece model at ``path``."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    model = read_model(path)
    if model.kind not in (UNIGRAM, BPE) or model.suffix_space:
        raise ValueError("only unigram and BPE models with leading markers are supported")
    unknown = next((k for k, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    else:
        core = models.BPE({p: k for k, (p, _, _) in enumerate(model.pieces)}, implied_merges(model), unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    if model.escape and not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER)):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    user = [AddedToken(p, normalized=True, special=False) for p, _, kind in model.pieces if kind == USER]
    if user:
        tokenizer.add_tokens(user)
    tail = [decoders.Replace(MARK, " ")] if model.escape else []
    tail += [decoders.ByteFallback()] if model.byte_fallback else []
    tail += [decoders.Fuse()] + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])
    tokenizer.decoder = decoders.Sequence(tail)
    return tokenizer


class Backend:
    """The rebuilt tokenizer beside the reference library."""

    def __init__(self, path: str, threads: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))  # both are read when the library first encodes a batch
        import sentencepiece
        from tokenizers import decoders, normalizers

        self.tokenizer = build(path)
        # of the decoder's steps only byte fallback goes token by token; marker and first space are replaced in whole texts
        model = read_model(path)
        self.tokenizer.decoder = decoders.ByteFallback() if model.byte_fallback else decoders.Fuse()
        self.marker, self.opening = model.escape, model.dummy_prefix
        # likewise marked before encoding, where no other step comes first: the normalizer's steps keep offsets that nothing reads
        self.marked = not model.charsmap and not model.squeeze and not any(kind == USER for _, _, kind in model.pieces)
        if self.marked:
            self.tokenizer.normalizer = normalizers.Sequence([])
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        self.threads = threads

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.marked:
            texts = [" " + t if t else t for t in texts] if self.opening else texts
            texts = [t.replace(" ", MARK) for t in texts] if self.marker else texts
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        texts = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        texts = [t.replace(MARK, " ") for t in texts] if self.marker else texts
        return [t.removeprefix(" ") for t in texts] if self.opening else texts

    def expected(self, texts: list[str]) -> list[list[int]]:
        return self.reference.encode(texts, num_threads=self.threads)


_backends: dict[str, Backend] = {}


def _backend(path: str, threads: int) -> Backend:
    if path not in _backends:
        _backends[path] = Backend(path, threads)
    return _backends[path]


def encoded(docs: DataFrame, model: str, text: str = "text", threads: int = 2) -> DataFrame:
    """Every row with ``ids``, ``n_tokens``, ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers), ``matched`` (parity) and ``restored`` (decoding gives the text back); such columns are replaced. No shuffle."""
    own = {"ids": "array<int>", "n_tokens": "long", "ids_crc32": "long", "matched": "boolean", "restored": "boolean"}
    rest = docs.drop(*own)
    at = rest.columns.index(text)

    def apply(batches):
        backend = _backend(model, threads)
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            ids, crc, matched, restored = [], [], [], []
            for a, z in by_bytes(texts):
                part = texts[a:z]
                found = backend.encode(part)
                matched += [x == y for x, y in zip(found, backend.expected(part))]
                restored += [x == y for x, y in zip(backend.decode(found), part)]
                fixed = [np.array(x, "<u4") for x in found]
                crc += [zlib.crc32(x.tobytes()) for x in fixed]
                ids += [x.view("<i4") for x in fixed]
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()),
                pa.array(matched, pa.bool_()), pa.array(restored, pa.bool_()),
            ], [*batch.schema.names, *own])

    return rest.mapInArrow(apply, with_fields(rest.schema, **own))


def decoded(rows: DataFrame, model: str, ids: str = "ids", threads: int = 2) -> DataFrame:
    """Every row with ``decoded``, the text of its ids (a null list gives null)."""
    rest = rows.drop("decoded")
    at = rest.columns.index(ids)

    def apply(batches):
        backend = _backend(model, threads)
        for batch in batches:
            lists = batch.column(at).to_pylist()
            texts = [t for a in range(0, len(lists), 256) for t in backend.decode([x or [] for x in lists[a : a + 256]])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else t for x, t in zip(lists, texts)], pa.string())], [*batch.schema.names, "decoded"])

    return rest.mapInArrow(apply, with_fields(rest.schema, decoded="string"))


def document_ids(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, matched, restored`` of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return encoded(rows, model).select("doc_id", "n_tokens", "ids_crc32", "matched", "restored")
