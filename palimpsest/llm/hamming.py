"""Exact top-k search of binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments of about log2(n) - 2 bits for n different codes,
each with an index of its own, so that a bucket holds about four codes: wider ones
would make a query look up more empty buckets than it meets codes. Round r looks up, in every index, all values that differ from
the query's segment in exactly r bits. With m segments, codes within m r + m - 1
bits of the query differ in at most r bits in some segment, so after round r all
of those have been met and verified; a query is done when its k-th verified
distance is covered by that bound, and only the others go on. Each pair is met
once: in the first segment of those that differ least. No query is answered in
any other way: a far k-th neighbour takes more rounds, which end where all values
of a segment have been looked up.

Equal codes are one entry with its count and its k + 1 smallest ids, and equal
queries are asked once, so a vector that a third of all rows share costs no more
than another. The k + 1 best entries by (distance, smallest id) hold the k + 1
best rows, so no more are kept.

Defined cases: rows without a code, with nulls or non-finite numbers in the
vector, or without an id are neither found nor asked; a row never finds itself; ties go to the
smaller id; repeated ids count as one row per code; with fewer than k other rows
all are returned; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import settle

#: The narrowest segment in bits.
NARROWEST = 4


def sign_codes(vectors: DataFrame, key: str, vector: str, seed: int = 7) -> DataFrame:
    """(id, code): the sides of 64 seeded random hyperplanes through the origin that a vector lies on."""

    def apply(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, codes = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.array(v if v is not None else [], np.float64)  # a null becomes NaN
                if i is None or not len(x) or not np.isfinite(x).all():
                    continue
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng([seed, len(x)]).standard_normal((64, len(x)))
                ids.append(i)
                codes.append(np.packbits(planes[len(x)] @ x > 0).view(np.int64)[0])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codes, pa.int64())], ["id", "code"])

    return vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(apply, "id long, code long")


def segments_for(n: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment for ``n`` codes."""
    m = max(1, round(64 / max(NARROWEST, log2(max(n, 1)) - 2)))
    widths = [64 // m + (k < 64 % m) for k in range(m)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def _segment(code, segment: tuple[int, int]):
    return F.shiftrightunsigned(code, segment[0]).bitwiseAND(F.lit((1 << segment[1]) - 1))


def _per_segment(code, segments: list[tuple[int, int]]) -> F.Column:
    return F.explode(F.array(*[F.struct(F.lit(k).alias("part"), _segment(F.col(code), s).alias("value")) for k, s in enumerate(segments)]))


def _probes(queries: DataFrame, segments: list[tuple[int, int]], r: int) -> DataFrame:
    """``query, bound, part, value`` of all values that differ from a query's segment in exactly ``r`` bits."""

    def apply(batches):
        masks = [np.array([sum(1 << b for b in c) for c in combinations(range(w), r)], np.int64) for _, w in segments]
        for batch in batches:
            asked, bounds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k, (shift, width) in enumerate(segments):
                n = len(masks[k])
                step = max(1, (1 << 16) // max(1, n))
                for a in range(0, len(asked) if n else 0, step):
                    own = asked[a : a + step]
                    values = (((own.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)[:, None] ^ masks[k]).ravel()
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(own, n)), pa.array(np.repeat(bounds[a : a + step], n).astype(np.int32)), pa.array(np.full(len(values), k, np.int32)), pa.array(values),
                    ], ["query", "bound", "part", "value"])

    return queries.select("query", "bound").mapInArrow(apply, "query long, bound int, part int, value long")


def _best(df: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("distance", "least")
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, id, distance``: the ``k`` rows of ``codes(id, code)`` nearest to each row of ``queries(id, code)``, itself left out."""
    codes = codes.where("id is not null and code is not null").distinct()
    ranked = codes.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("place") <= k + 1)
    some = ranked.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min("id").alias("least"))
    entries = settle(some.join(codes.groupBy("code").agg(F.count("*").alias("n")), "code"))
    wanted = min(k + 1, entries.agg(F.sum("n")).first()[0] or 0)
    asked = queries.where("id is not null and code is not null").select("id", "code").distinct()
    open_codes = settle(asked.select(F.col("code").alias("query")).distinct().withColumn("bound", F.lit(64)))
    segments = segments_for(entries.count())
    index = settle(entries.select("code", "least", "n", _per_segment("code", segments).alias("s")).select("code", "least", "n", "s.part", "s.value"))
    found = done = None
    r = 0
    while wanted and not open_codes.isEmpty():
        differ = F.col("code").bitwiseXOR(F.col("query"))
        probes = _probes(open_codes, segments, r).withColumnsRenamed({"part": "part_", "value": "value_"})
        once = F.lit(True)
        for s, segment in enumerate(segments):
            bits = F.bit_count(_segment(differ, segment))
            once = once & F.when(F.col("part") > s, bits > r).otherwise(bits >= r)
        met = index.join(probes, (F.col("part") == F.col("part_")) & (F.col("value") == F.col("value_")) & once & (F.bit_count(differ) <= F.col("bound")))
        met = met.select("query", "code", "least", "n", F.bit_count(differ).alias("distance"))
        found = settle(_best(met if found is None else found.union(met), k + 1))
        covered = len(segments) * (r + 1) - 1
        running = F.sum("n").over(Window.partitionBy("query").orderBy("distance", "least"))
        state = found.withColumn("so_far", running).where(F.col("so_far") >= wanted).groupBy("query").agg(F.min("distance").alias("kth"))
        state = open_codes.select("query").join(state, "query", "left").withColumn("finished", F.coalesce(F.col("kth") <= covered, F.lit(False)) | F.lit(covered >= 64))
        state = settle(state)
        over = found.join(state.where("finished").select("query"), "query", "left_semi")
        done = over if done is None else done.union(over)
        open_codes = settle(state.where(~F.col("finished")).select("query", F.coalesce("kth", F.lit(64)).alias("bound")))
        found = found.join(open_codes.select("query"), "query", "left_semi")
        r += 1
    if done is None:
        return asked.sparkSession.createDataFrame([], "query_id long, rank int, id long, distance int")
    rows = done.join(entries.select("code", "ids"), "code").select("query", "distance", F.explode("ids").alias("id"))
    own = Window.partitionBy("query").orderBy("distance", "id")
    rows = rows.withColumn("place", F.row_number().over(own)).where(F.col("place") <= k + 1).drop("place")
    answers = asked.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(rows, "query").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", F.col("distance").cast("int").alias("distance"))
