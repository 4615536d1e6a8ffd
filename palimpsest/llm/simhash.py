"""SimHash near-duplicates with pigeonring filtering.

A text's fingerprint has 64 bits: bit b is 1 if it is set in over half of the
XXH64 values (seed 42) of the text's word shingles. Equal fingerprints are one
class. Two classes are linked if at most 3 bits differ, and documents that
links connect form a component.

Candidates. A fingerprint is a ring of four 16-bit segments. By the pigeonring
principle two fingerprints within 3 bits have a segment from which every chain
of k segments differs in at most floor(3k/4) bits: 0, 1, 2 and 3 for k = 1 to 4.
The first two links of the chain are looked up by an equal-key join (the first
segment whole, and the second without one of its four nibbles: one differing
bit lies in one nibble), the chain's other budgets prune what the join meets,
and the full Hamming distance decides.

Crowded keys. Where more than ``crowd`` classes share a key, their links are
found another exact way, without pairs: two fingerprints are within 3 bits if
and only if one lies within 1 bit and the other within 2 bits of a common
value. So each class in a crowd is sent to the 65 values within 1 bit (there
the least becomes the value's centre) and to the 2081 values within 2 bits,
where it is linked to the centre. That is linear in the number of classes.

Defined cases: null texts are empty; a text without words has fingerprint zero
and is linked like any other; fewer words than a shingle make one shingle of
all of them. Words are split at the six ASCII white-space characters, and only
A-Z are lower-cased. A very long text takes memory in proportion to its length
for the one moment it is hashed; an empty table gives an empty result; columns
besides doc_id and the text aren't read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import settle
from palimpsest.llm.components import components

SEED = 42
BITS = 3
SEGMENTS = 4
WIDTH = 64 // SEGMENTS
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    tokens = (text or "").encode().translate(_LOWER).split()  # bytes.split takes exactly the six ASCII characters
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    view = memoryview(joined)
    pairs = zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist())
    return np.array([digest(view[a:z], SEED) for a, z in pairs], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as an unsigned number."""
    sums = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 15):
        sums += np.unpackbits(hashes[a : a + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(sums * 2 > len(hashes)).tolist())


def simhashes(docs: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """``doc_id`` and ``simhash`` (the 64 bits as a long) of every row."""

    def apply(batches):
        for batch in batches:
            found = np.array([fingerprint(shingle_hashes(x, words)) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "simhash"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(apply, "doc_id long, simhash long")


def _segment(f, k: int):
    return F.shiftrightunsigned(f, WIDTH * (k % SEGMENTS)).bitwiseAND(F.lit(0xFFFF))


def _keys(fp) -> F.Column:
    """The 16 keys of a fingerprint: start of the chain, nibble left out, first segment, rest of the second."""
    out = []
    for k in range(SEGMENTS):
        for nibble in range(4):
            rest = _segment(fp, k + 1).bitwiseAND(F.lit(0xFFFF & ~(0xF << 4 * nibble)))
            tag = (k * 4 + nibble) << 32
            out.append(F.lit(tag).bitwiseOR(F.shiftleft(_segment(fp, k), 16)).bitwiseOR(rest))
    return F.array(*out)


def _chain_holds(difference, start) -> F.Column:
    """Budgets of the chain of 1, 2, 3 and 4 segments from ``start`` on: floor(3k/4)."""
    turned = F.when(start == 0, difference)
    for k in range(1, SEGMENTS):
        turned = turned.when(start == k, F.shiftrightunsigned(difference, WIDTH * k).bitwiseOR(F.shiftleft(difference, 64 - WIDTH * k)))
    return (
        (turned.bitwiseAND(F.lit(0xFFFF)) == 0)
        & (F.bit_count(turned.bitwiseAND(F.lit(0xFFFFFFFF))) <= 1)
        & (F.bit_count(turned.bitwiseAND(F.lit(0xFFFFFFFFFFFF))) <= 2)
    )


def _near_masks(radius: int) -> list[int]:
    """All 64-bit values with at most ``radius`` bits, as signed longs."""
    values = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(64), r)]
    return [v - (1 << 64) if v >> 63 else v for v in values]


def links(classes: DataFrame, crowd: int = 256) -> DataFrame:
    """(u, v) fingerprints within 3 bits: every pair where no key is crowded, and links that connect the same fingerprints in a crowd. ``classes(simhash)`` must be distinct."""
    keyed = classes.select("simhash", F.explode(_keys(F.col("simhash"))).alias("key"))
    sizes = settle(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    few = sizes.where(F.col("n") <= crowd).select("key")
    some = keyed.join(few, "key", "left_semi")
    one, two = some.select("key", F.col("simhash").alias("u")), some.select("key", F.col("simhash").alias("v"))
    differ = F.col("u").bitwiseXOR(F.col("v"))
    start = F.shiftright("key", 34)
    pairs = one.join(two, "key").where((F.col("u") < F.col("v")) & _chain_holds(differ, start) & (F.bit_count(differ) <= BITS)).select("u", "v").distinct()
    crowded = sizes.where(F.col("n") > crowd).select("key")
    if not crowded.limit(1).count():
        return pairs
    members = settle(keyed.join(crowded, "key", "left_semi").select("simhash").distinct())

    def sent(radius: int) -> DataFrame:
        masks = np.array(_near_masks(radius), np.int64)

        def spread(batches):
            for batch in batches:
                own = batch.column(0).to_numpy()
                for a in range(0, len(own), 64):
                    part = own[a : a + 64]
                    yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ masks).ravel()), pa.array(np.repeat(part, len(masks)))], ["value", "simhash"])

        return members.mapInArrow(spread, "value long, simhash long")

    centres = sent(1).groupBy("value").agg(F.min("simhash").alias("centre"))
    stars = sent(2).join(centres, "value").where("simhash <> centre").groupBy("simhash", "centre").agg(F.lit(1).alias("one"))
    return pairs.union(stars.select(F.col("simhash").alias("u"), F.col("centre").alias("v")))


def near_duplicates(docs: DataFrame, text: str = "text", words: int = 3, crowd: int = 256) -> DataFrame:
    """``doc_id, simhash, component_id`` of every row; component_id is the smallest doc_id that links reach.

    Repeated doc_ids are answered once each; null ones have a fingerprint and
    join components, which no null names unless no other id is there.
    """
    hashed = settle(simhashes(docs, text, words))
    classes = settle(hashed.groupBy("simhash").agg(F.min("doc_id").alias("least")))
    linked = components(links(classes.select("simhash"), crowd))
    named = classes.join(linked.withColumnRenamed("node", "simhash"), "simhash", "left").withColumn("component", F.coalesce("component", "simhash"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = named.join(least, "component").select("simhash", "component_id")
    return hashed.join(by_class, "simhash").select("doc_id", "simhash", "component_id")


def deduplicated(docs: DataFrame, text: str = "text", words: int = 5, crowd: int = 256) -> DataFrame:
    """The documents of which each component keeps the one of smallest doc_id; columns as given. Rows without a doc_id stay, as no id tells them apart; of rows that share an id the one of the least text hash stays."""
    found = near_duplicates(docs.where("doc_id is not null"), text, words, crowd)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    ided = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    twice = ided.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.limit(1).count():
        order = Window.partitionBy("doc_id").orderBy(F.xxhash64(text), text)
        again = ided.join(twice, "doc_id", "left_semi").select(F.struct("*").alias("row"), "doc_id", text).withColumn("nth", F.row_number().over(order))
        ided = ided.join(twice, "doc_id", "left_anti").union(again.where("nth = 1").select("row.*"))
    return ided.union(docs.where("doc_id is null"))
