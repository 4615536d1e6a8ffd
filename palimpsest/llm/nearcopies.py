"""Near copies: documents whose sets of word shingles have a Jaccard similarity of ``similarity`` or more.

SimHash within 3 bits (``simhash.links``) meets almost exact copies only: two
texts at 0.8 differ in about 10 of 64 bits, and no ring of 64 bits with chains
for that many tells them from strangers. So candidates come from two sides, and
every one is verified by the exact similarity of its two sets.

* SimHash links, as in op 2.
* Least shingles: the least hash of a set under each of ``DRAWS`` hash functions.
  Two sets of similarity s share each with probability s, so a pair at 0.8 shares
  none of 12 with probability 0.2 ** 12, once in 250 million pairs.

Before texts are fetched, parities of 1,024 buckets of both sets are compared:
they differ in no more places than the sets in shingles, so what is dropped for
them is below ``similarity``.

Rounds. First each document is verified with its SimHash links and, of the
documents that are the first to have one of its least shingles, with the two it
shares most with. Then pairs are left only where documents of one key are in
different components: those are verified one by one. A large group of near copies
so costs a few pairs a document, not the square. Keys that more than ``crowd``
documents share (a passage that very many different documents have) aren't paired.
Their documents are met by prefixes of their sets instead: two sets of similarity s
or more share one of the first n - ceil(s n) + 1 shingles of each in any fixed
order, and in the order taken common shingles come last. A pair is met at the first
shingle it shares, where both sets must have as many left as the similarity needs.

Defined cases: as in ``simhash``, null texts are empty, and fewer words than a
shingle make one shingle of all of them; texts without words are copies of each
other; of rows that share a doc_id one stays; rows without a doc_id stay; a very
long text costs time and memory in proportion to its length; columns of any name
are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import OrderedDict
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import settle
from palimpsest.llm.components import components
from palimpsest.llm.simhash import fingerprint, links, shingle_hashes

DRAWS = 12
OWNERS = 2
MOST_HOT = 50_000
SAMPLE = 20_000
BUCKETS = 1024
#: Ids that are sent to every task at once (8 bytes each) rather than joined by a shuffle of the texts.
SMALL = 400_000
_FACTORS = np.random.default_rng(12).integers(0, 1 << 63, DRAWS).astype(np.uint64) << np.uint64(1) | np.uint64(1)
_SALTS = np.random.default_rng(13).integers(0, 1 << 63, DRAWS).astype(np.uint64)


def least_shingles(shingles: np.ndarray) -> np.ndarray:
    """A key for the least of the set under each hash function; none of an empty set."""
    if not len(shingles):
        return np.empty(0, np.uint64)
    least = np.full(DRAWS, np.iinfo(np.uint64).max)
    for a in range(0, len(shingles), 1 << 14):
        least = np.minimum(least, (shingles[a : a + (1 << 14), None] * _FACTORS).min(0))
    return least ^ _SALTS


def prefix(shingles: np.ndarray, similarity: float, hot: np.ndarray | None = None) -> np.ndarray:
    """The first shingles of a sorted set, hot ones last: one of them is in the prefix of every set as similar."""
    n = len(shingles)
    if hot is not None and n:
        late = np.isin(shingles, hot)
        shingles = np.concatenate((shingles[~late], shingles[late]))
    return shingles[: n - ceil(similarity * n - 1e-9) + 1]


def _per_text(docs: DataFrame, schema: str, kinds: tuple, row) -> DataFrame:
    """``id`` and what ``row`` makes of each text."""

    def apply(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                rows = [row(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], ["id", *[x.split()[0] for x in schema.split(", ")]])

    return docs.select("id", "text").mapInArrow(apply, f"id long, {schema}")


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """A hash of the set, SimHash, size, keys and parities of each text's shingles."""

    def row(text):
        every = shingle_hashes(text, words)
        own = np.unique(every)
        parity = np.packbits(np.bincount((own % BUCKETS).astype(np.int64), minlength=BUCKETS) & 1).tobytes()
        return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63), np.uint64(fingerprint(every)).view(np.int64), len(own), least_shingles(own).view(np.int64), parity

    return _per_text(docs, "same long, simhash long, n int, keys array<long>, bits binary", (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()), row)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    return _per_text(docs, "shingles array<long>", (pa.list_(pa.int64()),), lambda x: (np.unique(shingle_hashes(x, words)).view(np.int64),))


def _prefixes(docs: DataFrame, words: int, similarity: float, hot: np.ndarray | None) -> DataFrame:
    def row(text):
        own = np.unique(shingle_hashes(text, words))
        return len(own), prefix(own, similarity, hot).view(np.int64)

    return _per_text(docs, "n int, keys array<long>", (pa.int32(), pa.list_(pa.int64())), row)


def _of(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The documents with (or ``left_anti`` without) one of the settled ``ids``: few are sent to all tasks, many joined by a shuffle."""
    return docs.join(F.broadcast(ids) if ids.count() <= SMALL else ids, "id", how)


def _plausible(pairs: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sizes and parities of buckets don't rule out that they are similar."""

    def apply(batches):
        for batch in batches:
            n, m = (batch.column(k).to_numpy().astype(float) for k in (2, 3))
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, BUCKETS // 64) for k in (4, 5))
            differ = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
            fits = (differ <= (n + m) * (1 - similarity) / (1 + similarity) + 1e-6) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(fits))

    one, two = (prints.select(F.col("id").alias(x), F.col("n").alias("n_" + x), F.col("bits").alias("bits_" + x)) for x in "uv")
    return settle(pairs.join(one, "u").join(two, "v").select("u", "v", "n_u", "n_v", "bits_u", "bits_v").mapInArrow(apply, "u long, v long"))


def _hot(docs: DataFrame, words: int, crowd: int) -> np.ndarray | None:
    """Shingles that about ``crowd`` documents or more have, by a sample of the documents: it decides the order of prefixes only."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    met = _sets(some, words).select(F.explode("shingles").alias("key")).groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > max(3, crowd * share))
    found = [r["key"] for r in met.orderBy(F.desc("m"), "key").limit(MOST_HOT).collect()]
    return np.array(found, np.int64).view(np.uint64) if found else None


def _verified(pairs: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""
    ids = settle(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    # texts, not sets, are shuffled: a set is larger than its text and can't be compressed
    texts = _of(docs, ids)
    one, two = texts.select(F.col("id").alias("u"), F.col("text").alias("a")), texts.select(F.col("id").alias("v"), F.col("text").alias("b"))

    def apply(batches):
        known: OrderedDict[int, np.ndarray] = OrderedDict()  # sets of the last documents met: a group's first one is in many pairs

        def own(i, text):
            if i not in known:
                known[i] = np.unique(shingle_hashes(text.as_py(), words))
                if len(known) > 32:
                    known.popitem(last=False)
            known.move_to_end(i)
            return known[i]

        for batch in batches:
            keep = []
            for k, (u, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                a, b = own(u, batch.column(2)[k]), own(v, batch.column(3)[k])
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return settle(pairs.join(one, "u").join(two, "v").select("u", "v", "a", "b").mapInArrow(apply, "u long, v long"))


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, crowd: int = 24) -> DataFrame:
    """``id, component`` of every row of ``docs(id, text)``, whose ids are distinct and not null; a component is named by its least id."""
    found = settle(_sketches(docs, words))
    classes = settle(found.groupBy("same").agg(F.min("id").alias("id")))
    least = settle(found.join(classes.select("id"), "id", "left_semi"))
    prints = least.select("id", "n", "bits")

    def checked(pairs):
        return _verified(_plausible(pairs, prints, similarity), docs, words, similarity)

    keyed = least.select("id", "n", F.explode("keys").alias("key"))
    owners = settle(keyed.groupBy("key").agg(F.min(F.struct("id", "n")).alias("own"), F.max("id").alias("last"), F.count("*").alias("sharing")).where("last > own.id"))
    shared = settle(keyed.join(owners.select("key", "own", "sharing"), "key"))
    near = F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9
    first = shared.where("id > own.id").withColumn("m", F.col("own.n")).where(near).groupBy("id", F.col("own.id").alias("u")).agg(F.count("*").alias("k"))
    order = Window.partitionBy("id").orderBy(F.desc("k"), "u")  # no more rows than hash functions in a window
    first = first.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= OWNERS).select("u", F.col("id").alias("v"))
    by_print = settle(least.groupBy("simhash").agg(F.min("id").alias("id")))
    linked = links(by_print.select("simhash")).withColumnsRenamed({"u": "p", "v": "q"})
    linked = linked.join(by_print.select(F.col("simhash").alias("p"), F.col("id").alias("a")), "p").join(by_print.select(F.col("simhash").alias("q"), F.col("id").alias("b")), "q")
    equal = least.select("simhash", F.col("id").alias("b")).join(by_print.withColumnRenamed("id", "a"), "simhash").where("a <> b")
    printed = linked.select("a", "b").union(equal.select("a", "b")).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    tried = settle(first.union(printed).distinct())
    similar = checked(tried)

    reached = components(similar).withColumnsRenamed({"node": "id", "component": "c"})
    named = shared.select("key", "id", "n", "sharing").join(reached, "id", "left").withColumn("c", F.coalesce("c", "id"))
    parted = named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    left = settle(named.join(parted, "key", "left_semi"))

    def paired(keys, enough=F.lit(True)):
        one, two = keys.select("key", F.col("id").alias("u"), "n", "i", F.col("c").alias("cu")), keys.select("key", F.col("id").alias("v"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("c").alias("cv"))
        return one.join(two, "key").where((F.col("u") < F.col("v")) & (F.col("cu") != F.col("cv")) & near & enough).select("u", "v")

    others = paired(left.where(F.col("sharing") <= crowd).withColumn("i", F.lit(0)))
    crowded = settle(left.where(F.col("sharing") > crowd).select("id", "c").distinct())
    if crowded.limit(1).count():
        few = _of(docs, crowded.select("id"))
        prefixes = _prefixes(few, words, similarity, _hot(few, words, crowd)).select("id", "n", F.posexplode("keys").alias("i", "key"))
        # from the first shingle that two sets share on, both must have as many as their overlap needs
        enough = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-6
        others = others.union(paired(settle(prefixes.join(crowded, "id")), enough))
    similar = similar.union(checked(settle(others.distinct().join(tried, ["u", "v"], "left_anti"))))
    ends = components(similar).withColumnsRenamed({"node": "id"})
    class_ends = classes.join(ends, "id", "left").select("same", F.coalesce("component", "id").alias("component"))
    return found.select("id", "same").join(class_ends, "same").select("id", "component")


def without_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, crowd: int = 24) -> DataFrame:
    """The documents of which each component keeps the one of smallest doc_id; columns as given."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    ided = rows.where("id is not null")
    twice = settle(ided.groupBy("id").count().where("count > 1").select("id"))
    if twice.limit(1).count():
        order = Window.partitionBy("id").orderBy(F.xxhash64("text"), "text", F.to_json("row"))
        again = _of(ided, twice).withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
        ided = _of(ided, twice, "left_anti").union(again)
    gone = settle(near_copies(ided.select("id", "text"), words, similarity, crowd).where("id > component").select("id"))
    return _of(ided, gone, "left_anti").select("row.*").union(docs.where("doc_id is null"))
