"""Token ids in files of bit-shuffled, compressed blocks.

Format. A dataset of Parquet files, one row a block: ``shard``, ``block``
(number in the shard), ``first`` (ids of the shard before it), ``n_ids``,
``width`` (bits of an id: 16 or 32), ``planes`` (binary each) and the block's
part of the document index: ``docs`` (number in the shard), ``doc_ids``,
``offsets`` (where the part begins in the document) and ``lengths`` of the
parts of documents that it holds, and ``goes_on``, whether the last of these has
more in the next block. A block has ``BLOCK`` ids (a shard's last one
fewer); it is transposed to planes, plane p holding byte (or bit) p of all its
ids, and each plane is compressed with zstandard, so a block can be read
without any other. ``width`` planes are bit planes, fewer are byte planes. Shards follow each other in doc_id order; the ids
before a shard are the sum over the blocks of the shards before it.

Defined cases: null texts are empty and have the end id only; equal doc_ids are
ordered by a hash of the text; null doc_ids come first; an empty table makes
empty files; a text of any length is encoded whole, in a batch of its own, and its
ids may go over many blocks; other columns aren't read.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import by_bytes, parts_for, settle, shared_path, text_bytes

BLOCK = 1 << 16
BLOCKS = "shard int, block long, first long, n_ids int, width int, planes array<binary>, docs array<long>, doc_ids array<long>, offsets array<long>, lengths array<long>, goes_on boolean"
_encoders: dict = {}


def _encoder(path: str):
    """The library's tokenizer of a file, for whole texts: no padding, no truncation."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        _encoders[path] = Tokenizer.from_file(path)
        _encoders[path].no_padding()
        _encoders[path].no_truncation()
    return _encoders[path]


def pack(ids: np.ndarray, unit: str = "byte") -> tuple[int, list[bytes]]:
    """(width, compressed planes) of one block; ``unit`` bit or byte."""
    width = 16 if not len(ids) or int(ids.max()) < 1 << 16 else 32
    fixed = ids.astype("<u2" if width == 16 else "<u4")
    compressor = zstandard.ZstdCompressor(level=1)
    if unit == "bit":
        planes = [np.packbits((fixed >> b).astype(np.uint8) & 1) for b in range(width)]
    else:
        planes = [np.ascontiguousarray(p) for p in fixed.view(np.uint8).reshape(len(ids), width // 8).T]
    return width, [compressor.compress(p.tobytes()) for p in planes]


def unpack(width: int, planes: list[bytes], n: int) -> np.ndarray:
    """The ids of one block, as unsigned 32-bit numbers; as many planes as ``width`` are bit planes."""
    reader = zstandard.ZstdDecompressor()
    opened = [np.frombuffer(reader.decompress(p), np.uint8) for p in planes]
    if len(planes) == width:
        out = np.zeros(n, "<u4")
        for b, plane in enumerate(opened):
            out |= np.unpackbits(plane, count=n).astype("<u4") << np.uint32(b)
        return out
    raw = np.empty((n, width // 8), np.uint8)
    for k, plane in enumerate(opened):
        raw[:, k] = plane
    return raw.view("<u2" if width == 16 else "<u4")[:, 0].astype("<u4")


def crc32_joined(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings in a row from the crc32 of each and the second's length: ``length`` zero bytes shift the first, a power of a bit matrix."""
    if not length:
        return first

    def times(matrix, v):
        out = 0
        for row in matrix:
            if not v:
                break
            if v & 1:
                out ^= row
            v >>= 1
        return out

    matrix = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    bits = 8 * length
    while bits:
        if bits & 1:
            first = times(matrix, first)
        bits >>= 1
        if bits:
            matrix = [times(matrix, row) for row in matrix]
    return first ^ second


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text", unit: str = "byte") -> None:
    """Encode every whole text with the tokenizer file ``tokenizer`` and write the dataset ``path`` in ascending doc_id order.

    Texts are dealt into ranges of (doc_id, hash of the text) by their measured
    bytes and sorted; a task encodes a range in batches by the library and writes
    it as a shard, holding one block and one batch of documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text").asc()]
    dealt = rows.repartitionByRange(parts_for(spark, text_bytes(rows)), *order).sortWithinPartitions(*order, "text")

    def table(rows):
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.binary()), *[pa.list_(pa.int64())] * 4, pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["shard", "block", "first", "n_ids", "width", "planes", "docs", "doc_ids", "offsets", "lengths", "goes_on"])

    def blocks(batches):
        encoder = _encoder(tokenizer)
        shard, held, n_held, index, block, n_docs = None, [], 0, [], 0, 0

        def flush(n):
            nonlocal held, n_held, index, block
            ids = np.concatenate(held) if held else np.empty(0, np.uint32)
            own, held, n_held = ids[:n], [ids[n:]], len(ids) - n
            width, planes = pack(own, unit)
            parts, left, room = [], [], n
            for doc, doc_id, offset, length in index:
                took = min(length, room)
                if took:
                    parts.append((doc, doc_id, offset, took))
                if length > took:
                    left.append((doc, doc_id, offset + took, length - took))
                room -= took
            index = left
            row = [shard, block, block * BLOCK, n, width, planes, *[[p[k] for p in parts] for k in range(4)], bool(left) and left[0][2] > 0]
            block += 1
            return row

        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = (x.ids for a, z in by_bytes(texts) for x in encoder.encode_batch_fast(texts[a:z], add_special_tokens=False))
            for own, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), found):
                shard = own
                whole = np.array([*ids, end_id], np.uint32)
                index.append((n_docs, doc_id, 0, len(whole)))
                n_docs += 1
                held.append(whole)
                n_held += len(whole)
                while n_held >= BLOCK:
                    yield table([flush(BLOCK)])
        if n_held:
            yield table([flush(n_held)])

    # a range is one task's, so its number names the shard
    dealt.select(F.spark_partition_id().alias("shard"), "doc_id", "text").mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, all from the ids in the files.

    Blocks are read on their own. Documents that lie in one block are answered from
    it; of the others, the checksums of the parts are joined.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))  # one row a shard

    def parts(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                raw = unpack(row["width"], row["planes"], row["n_ids"])
                at, last = 0, len(row["docs"]) - 1
                for k, (doc, doc_id, offset, length) in enumerate(zip(row["docs"], row["doc_ids"], row["offsets"], row["lengths"])):
                    whole = offset == 0 and not (k == last and row["goes_on"])
                    out.append((row["shard"], doc, doc_id, offset, length, row["first"] + at, zlib.crc32(raw[at : at + length].tobytes()), whole))
                    at += length
            kinds = (pa.int32(), *[pa.int64()] * 6, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], ["shard", "doc", "doc_id", "offset", "n_tokens", "at", "ids_crc32", "whole"])

    found = settle(blocks.mapInArrow(parts, "shard int, doc long, doc_id long, offset long, n_tokens long, at long, ids_crc32 long, whole boolean"))
    cut = found.where(~F.col("whole")).groupBy("shard", "doc").agg(
        F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "n_tokens", "ids_crc32"))).alias("parts")
    )

    def join_parts(batches):
        for batch in batches:
            crc = pa.array([_crc_of_parts(p) for p in batch.column(4).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], crc], ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    joined = cut.select("shard", "doc_id", "at", "n_tokens", "parts").mapInArrow(join_parts, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    docs = found.where("whole").select("shard", "doc_id", "at", "n_tokens", "ids_crc32").union(joined)
    return docs.join(before, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _crc_of_parts(parts):
    crc = 0
    for part in parts:
        crc = crc32_joined(crc, part["ids_crc32"], 4 * part["n_tokens"])
    return crc


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Every block's ``shard, block, first, ids``."""

    def open_blocks(batches):
        for batch in batches:
            rows = batch.select(["shard", "block", "first", "n_ids", "width", "planes"]).to_pylist()
            yield pa.RecordBatch.from_arrays([
                *[batch.column(k) for k in range(3)],
                pa.array([unpack(r["width"], r["planes"], r["n_ids"]).astype(np.int64) for r in rows], pa.list_(pa.int64())),
            ], ["shard", "block", "first", "ids"])

    return spark.read.schema(BLOCKS).parquet(path).mapInArrow(open_blocks, "shard int, block long, first long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files to the shared folder and answer from what is read back."""
    path = shared_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer, end_id)
    return read_index(docs.sparkSession, path)
