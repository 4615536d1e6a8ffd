"""Phrase collocations by SETM: occurrence relations that are kept sorted, joined with themselves, counted and thinned.

The relation of length 1 has a row for every word in every piece (texts end a piece
at the separators below). It is written once, in blocks: a block holds whole
documents of one language, words as numbers, in the order of piece and position,
with a 0 between pieces. One round makes the relation of the next length from it:

1. semi-join: occurrences of phrases that are too rare go;
2. merge join: an occurrence at a place meets the one at the next place of the same
   piece, which gives the occurrences of phrases one word longer, sorted as before;
3. the relation is written, without the places that it doesn't need any more;
4. group-count: each block counts its own phrases, Spark adds the counts up.

The semi-join goes through a Bloom filter of the frequent phrases, of at most
``BITS`` bits whatever the corpus, since that is sent to all tasks. What it lets
pass wrongly is counted and then dropped by its exact count, so results are exact;
a corpus of more frequent phrases than the filter can tell apart costs time only.

A word is known by a 64-bit hash of language and word. All different words are
counted as text, so two with one hash are found, and another seed is taken.

Defined cases: a null text is empty; a null language counts as ``und``; repeated
rows count as often as they are there; a very long text is read in slices that end
between words; an empty table gives an empty result; other columns are not used.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import shared_path
from palimpsest.sources.files import Files

#: Words in a block before it is written (a document stays whole), and characters of a text that are split at a time.
BLOCK, SLICE = 500_000, 4 << 20
#: Bits of the largest filter (32 MB), bits for each phrase below that, and places that a phrase sets.
BITS, BITS_EACH, PLACES = 1 << 28, 16, 4
SEEDS = 16
#: Compressed bytes of a row group of written tables.
ROW_GROUP = 8 << 20

#: What ends a piece, and what stands between words.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_MAP = bytes.maketrans(_ENDS + b"\t", b"\n" * len(_ENDS) + b" ")
_RELATION = "lang string, words array<string>, counts array<long>, ids array<long>, codes binary, starts binary"


def _slices(text: bytes):
    """Parts of a text that begin and end between words."""
    a = 0
    while len(text) - a > SLICE:
        z = max(text.rfind(b" ", a, a + SLICE), text.rfind(b"\n", a, a + SLICE))
        if z <= a:  # a word longer than a slice
            z = min((p for p in (text.find(b" ", a + SLICE), text.find(b"\n", a + SLICE)) if p >= 0), default=len(text))
        yield text[a:z]
        a = z
    yield text[a:]


class _Block:
    """Words of one language as codes; 0 ends a piece."""

    def __init__(self):
        self.code = defaultdict(count(2).__next__, {b"\n": 0, b"": 1})  # nothing here refers to the block, so that it is freed at once
        self.parts: list[np.ndarray] = []

    def add(self, text: bytes) -> int:
        size = 0
        for part in _slices(text.lower().translate(_MAP)):
            words = part.replace(b"\n", b" \n ").split(b" ")
            codes = np.fromiter(map(self.code.__getitem__, words), np.int32, len(words))
            codes = codes[codes != 1]
            self.parts.append(codes)
            size += len(codes)
        self.parts.append(np.zeros(1, np.int32))
        return size

    def row(self, lang: str, seed: int) -> tuple:
        codes = np.concatenate(self.parts)
        codes = np.where(codes > 1, codes - 1, 0).astype(np.int32)
        codes = codes[(codes != 0) | np.append(codes[1:] != 0, True)]  # one mark between pieces
        words = [w for w in self.code if w not in (b"\n", b"")]
        lead = lang.encode() + b"\0"
        ids = np.array([0, *(xxhash.xxh3_64_intdigest(lead + w, seed) for w in words)], np.uint64)
        counts = np.bincount(codes, minlength=len(ids))[1:]
        return lang, [w.decode() for w in words], counts, ids[1:].view(np.int64), codes.tobytes(), np.packbits(codes != 0).tobytes()


def first_relation(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Blocks of the relation of single words, from ``lang`` and ``text``."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))

    def apply(batches):
        names = [f.split()[0] for f in _RELATION.split(", ")]
        kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]

        def made(blocks):
            for lang, block in blocks.items():
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(block.row(lang, seed), kinds)], names)

        blocks, size = defaultdict(_Block), 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if text:
                    size += blocks[lang].add(text)
                if size >= BLOCK:
                    yield from made(blocks)
                    blocks, size = defaultdict(_Block), 0
        yield from made(blocks)

    return rows.mapInArrow(apply, _RELATION)


def phrase_hash(ids: list[np.ndarray]) -> np.ndarray:
    """One number for each phrase from the numbers of its words."""
    h = ids[0].astype(np.uint64)
    for more in ids[1:]:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + more.astype(np.uint64)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _bits_of(h: np.ndarray, bits: int):
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(PLACES):
        yield ((h + np.uint64(k) * step) & np.uint64(bits - 1)).astype(np.int64)


class Filter:
    """Bits set for a number of phrases; says of a phrase that it may be there, or that it isn't."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, 64 * len(words)

    def __contains__(self, h: int) -> bool:
        return bool(self.held(np.array([h], np.uint64))[0])

    def held(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in _bits_of(h, self.bits):
            out &= (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return out


def filter_of(counts: DataFrame, length: int, n: int) -> Filter:
    """The filter of the phrases in ``i_0 ..``. Tasks set bits; the driver gets no more than the bits themselves."""
    bits = min(BITS, 1 << max(10, math.ceil(math.log2(BITS_EACH * max(n, 1)))))

    def apply(batches):
        for batch in batches:
            h = phrase_hash([batch.column(k).to_numpy() for k in range(length)])
            at = np.unique(np.concatenate(list(_bits_of(h, bits))))
            if len(at):
                slots, begin = np.unique(at >> 6, return_index=True)
                ones = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), begin)
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(ones.view(np.int64))], ["slot", "ones"])

    found = counts.select(*[f"i_{k}" for k in range(length)]).mapInArrow(apply, "slot long, ones long").groupBy("slot").agg(F.bit_or("ones").alias("ones")).toArrow()
    words = np.zeros(bits >> 6, np.uint64)
    words[found["slot"].to_numpy()] = found["ones"].to_numpy().astype(np.int64).view(np.uint64)
    return Filter(words)


def _unpacked(batch: pa.RecordBatch):
    """Numbers of words (from code 1 on), codes and starts of each block."""
    for ids, codes, starts in zip(*batch.columns):
        own = np.append(np.zeros(1, np.uint64), ids.values.to_numpy().view(np.uint64))
        yield own, np.frombuffer(codes.as_py(), np.int32), np.flatnonzero(np.unpackbits(np.frombuffer(starts.as_py(), np.uint8)))


def extended(ids: np.ndarray, codes: np.ndarray, starts: np.ndarray, length: int, frequent: Filter) -> tuple[np.ndarray, np.ndarray]:
    """Codes and starts of the relation of ``length + 1`` words, from that of ``length``."""
    h = phrase_hash([ids[codes[starts + k]] for k in range(length)]) if len(starts) else np.zeros(0, np.uint64)
    kept = starts[frequent.held(h)]
    longer = kept[:-1][np.diff(kept) == 1]
    used = np.zeros(len(codes) + 1, bool)
    for k in range(length + 1):
        used[longer + k] = True
    used, closed = used[:-1], np.append(False, used[:-2])
    stay = used | closed  # the place after a run ends its piece
    thinned = np.where(used, codes, 0)[stay].astype(np.int32)
    return thinned, (np.cumsum(stay) - 1)[longer].astype(np.int32)


def next_relation(relation: DataFrame, length: int, frequent: Filter) -> DataFrame:
    sent = relation.sparkSession.sparkContext.broadcast(frequent.words)

    def apply(batches):
        own = Filter(sent.value)
        for batch in batches:
            for ids, codes, starts in _unpacked(batch):
                codes, starts = extended(ids, codes, starts, length, own)
                if len(starts):  # of the words only those that are left
                    begins = np.zeros(len(codes), bool)
                    begins[starts] = True
                    left, codes = np.unique(np.append(codes, np.int32(0)), return_inverse=True)
                    values = ids[left[1:]].view(np.int64), codes[:-1].astype(np.int32).tobytes(), np.packbits(begins).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, (pa.list_(pa.int64()), pa.binary(), pa.binary()))], ["ids", "codes", "starts"])

    return relation.select("ids", "codes", "starts").mapInArrow(apply, "ids array<long>, codes binary, starts binary")


def phrase_counts(relation: DataFrame, length: int) -> DataFrame:
    """``i_0 .., f`` of all phrases in a relation."""
    names = [f"i_{k}" for k in range(length)]

    def apply(batches):
        for batch in batches:
            for ids, codes, starts in _unpacked(batch):
                group = codes[starts].astype(np.int64)
                for k in range(1, length):
                    _, group = np.unique(group * len(ids) + codes[starts + k], return_inverse=True)
                _, first, n = np.unique(group, return_index=True, return_counts=True)
                at = starts[first]
                for a in range(0, len(at), 100_000):
                    z = a + 100_000
                    yield pa.RecordBatch.from_arrays([*[pa.array(ids[codes[at[a:z] + k]].view(np.int64)) for k in range(length)], pa.array(n[a:z].astype(np.int64))], [*names, "n"])

    counted = relation.select("ids", "codes", "starts").mapInArrow(apply, ", ".join(f"{n} long" for n in [*names, "n"]))
    return counted.groupBy(*names).agg(F.sum("n").alias("f"))


def _written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """A table written and read again. A block is a row of some megabytes and a reader holds a row group whole, so row groups end by their bytes, counted from the first row on (a hundredth by default), however many blocks a task writes."""
    path = shared_path(df.sparkSession, tag)
    df.write.options(**{"compression": "zstd", "parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": 1}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _words(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """The written relation of single words, ``lang, word, i_0, f`` of all words, and the relation's path."""
    for seed in range(SEEDS):
        relation, path = _written(first_relation(docs, seed), "phrases-1")
        each = relation.select("lang", F.explode(F.arrays_zip("words", "counts", "ids")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.ids").alias("i_0"), F.col("w.counts").alias("n"))
        words, _ = _written(each.groupBy("i_0", "lang", "word").agg(F.sum("n").alias("f")), "words")
        if words.groupBy("i_0").count().where("count > 1").isEmpty():
            return relation, words, path
        Files(spark).delete(path)
    raise RuntimeError("different words have the same hash under every seed")


def _scored(tables: dict[int, DataFrame], length: int) -> DataFrame:
    """Phrases of a length with the cut of least score: ``i_0 .., a, l, r, score``."""
    names = [f"i_{k}" for k in range(length)]
    out, cuts = tables[length].select(*names, F.col("f").alias("a")), []
    for k in range(1, length):
        for side, part in ((f"l_{k}", names[:k]), (f"r_{k}", names[k:])):
            table = tables[len(part)].select(*[F.col(f"i_{j}").alias(p) for j, p in enumerate(part)], F.col("f").alias(side))
            out = out.join(table, part)
        score = F.expr(f"CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(15,0)) div (CAST(l_{k} AS DECIMAL(19,0)) * CAST(r_{k} AS DECIMAL(19,0)))")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l_{k}").alias("l"), F.col(f"r_{k}").alias("r")))
    return out.withColumn("cut", F.least(*cuts) if len(cuts) > 1 else cuts[0]).select(*names, "a", "cut.l", "cut.r", "cut.score")


def _not_within(phrases: DataFrame, length: int, tables: dict[int, DataFrame], share: int) -> DataFrame:
    """Without the phrases of which a longer one that has them makes up ``share`` percent."""
    names = [f"i_{k}" for k in range(length)]
    parts = [
        t.select(*[F.col(f"i_{at + k}").alias(f"i_{k}") for k in range(length)], F.col("f").alias("longer"))
        for m, t in tables.items() if m > length for at in range(m - length + 1)
    ]
    if not parts:
        return phrases
    most = reduce(DataFrame.union, parts).groupBy(*names).agg(F.max("longer").alias("longer"))
    return phrases.join(most, names, "left").where(f"longer IS NULL OR 100 * longer < {share} * a").drop("longer")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of two to ``longest`` words of each language."""
    spark = docs.sparkSession
    relation, words, path = _words(spark, docs)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent, _ = _written(words.where(F.col("f") >= least), "phrases-f1")
    tables, filters = {1: frequent}, frequent
    for length in range(1, longest):
        held = filter_of(filters, length, filters.count())
        relation, after = _written(next_relation(relation, length, held), f"phrases-{length + 1}")
        Files(spark).delete(path)
        path = after
        filters, _ = _written(phrase_counts(relation, length + 1).where(F.col("f") >= least), f"phrases-f{length + 1}")
        tables[length + 1] = filters
    Files(spark).delete(path)
    ranked = []
    for length in range(2, longest + 1):
        found = _not_within(_scored(tables, length), length, tables, share)
        for k in range(length):
            found = found.join(frequent.select(F.col("i_0").alias(f"i_{k}"), F.col("word").alias(f"w_{k}"), *([F.col("lang")] if k == 0 else [])), f"i_{k}")
        ranked.append(found.select("lang", F.concat_ws(" ", *[f"w_{k}" for k in range(length)]).alias("phrase"), "a", "l", "r", "score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = reduce(DataFrame.union, ranked).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)  # each task keeps its own best before the rest move
    return best.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
