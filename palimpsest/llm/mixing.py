"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks. Block i of a source of weight w is
released at slot floor(i / w) and due at slot ceil((i + 1) / w); in each slot the
released block of earliest deadline is next. Since the weights sum to one this
keeps every source within one block of its share at any time.

Weights are the exact fractions that their decimals say, so the lag stays below one block of the target
weight however long the table is. Blocks are dealt on the driver, in one pass: a
step costs the logarithm of the number of sources, and one number a block is
kept (1/``block_docs`` of the rows; some 30 MB for a million blocks). When a
source has run out, the others go on with their weights in proportion: a new
phase. Sources of weight zero come after all others. No document is dropped or
repeated.

Target weights are given, or follow from the sources' sizes by ``temper``
(share to that power, so 0 weighs sources alike and 1 as they come). Sources
without a weight of their own get the least of the given ones.

Defined cases: a null source is a source of its own; equal doc_ids are told
apart by text, and rows equal in both are interchangeable; a null doc_id counts as
an empty one; null and very long texts are hashed whole; empty tables give empty
results; other columns are kept whatever their names.
"""

from __future__ import annotations

import heapq
from array import array
from fractions import Fraction
from math import ceil, lcm

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NO_SOURCE = "\x00null"


def exact_schedule(blocks: dict[str, int], weights: dict[str, float]) -> dict[str, array]:
    """The slot of each block of each source, by earliest deadline among the released, with weights as they are."""
    left = {s: n for s, n in blocks.items() if n}
    exact = {s: max(Fraction(0), Fraction(str(weights[s]))) for s in left}
    scale = lcm(*[w.denominator for w in exact.values()])
    parts = {s: int(w * scale) for s, w in exact.items()}
    out = {s: array("q") for s in left}
    order, slot = sorted(left, key=lambda s: (-parts[s], s)), 0
    while order:
        if not parts[order[0]]:  # only sources of weight zero are left
            parts = dict.fromkeys(order, 1)
        total, begin, last = sum(parts[s] for s in order), slot, None
        waiting: list[tuple[int, int, str]] = []  # (release, index, source)
        ready: list[tuple[int, int, str]] = []  # (deadline, index, source)
        first = 0  # the sources from here on in the order wait with their first block, earliest deadline first
        while last is None:
            now = slot - begin
            while waiting and waiting[0][0] <= now:
                _, i, s = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(i + 1) * total // parts[s]), i, s))
            if first < len(order) and parts[order[first]] and (not ready or -(-total // parts[order[first]]) < ready[0][0]):
                i, s = 0, order[first]
                first += 1
            else:
                _, i, s = heapq.heappop(ready)
            out[s].append(slot)
            slot += 1
            left[s] -= 1
            if left[s]:
                heapq.heappush(waiting, ((i + 1) * total // parts[s], i + 1, s))
            else:
                last = s
        order.remove(last)
    return out


def phases(blocks: dict[str, int], weights: dict[str, float], period: int) -> list[tuple[str, int, int, int, int, int, array]]:
    """(source, first block, last block + 1, first slot, length, length, slots) of each ``period`` blocks of a source; slots count from the first, 0."""
    out = []
    for s, slots in exact_schedule(blocks, weights).items():
        for a in range(0, len(slots), period):
            part = slots[a : a + period]
            out.append((s, a, a + len(part), 0, len(part), len(part), part))
    return out


def _draw(doc_id, text) -> F.Column:
    """A number of 60 bits from the md5 of a row's id and text."""
    said = F.concat_ws(" ", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long")


def _dealt(rows: DataFrame, weights: dict[str, float] | None, temper: float, block_docs: int, period: int) -> DataFrame:
    """``rows(row, source, draw, tie)`` with ``block``, ``slot`` and ``offset``. Numbers come from counts by (source, range of draws) and a window in each of those, so a source with a third of all rows is spread."""
    spark = rows.sparkSession
    ranges = max(128, rows.count() // 2_000)
    rows = rows.withColumn("source", F.coalesce("source", F.lit(NO_SOURCE))).withColumn("range", F.floor(F.col("draw") / F.lit(2.0**60) * ranges).cast("int"))
    counts = rows.groupBy("source", "range").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("range")) - F.col("n")).drop("n")
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}  # one row a source
    if weights is None:
        goal = {s: n**temper for s, n in sizes.items()}
    else:
        least = min(weights.values(), default=1.0)
        goal = {s: weights.get(s, least) for s in sizes}
    plan = phases({s: ceil(n / block_docs) for s, n in sizes.items()}, goal, period)
    columns = ([p[0] for p in plan], [p[1] // period for p in plan], [p[6] for p in plan])
    kinds = pa.schema([("source", pa.string()), ("part", pa.int64()), ("slots", pa.list_(pa.int64()))])
    table = spark.createDataFrame(pa.table([pa.array(c, k.type) for c, k in zip(columns, kinds)], schema=kinds))
    inner = Window.partitionBy("source", "range").orderBy("draw", F.asc_nulls_first("tie"))
    numbered = rows.withColumn("nth", F.row_number().over(inner) - 1).join(before, ["source", "range"]).withColumn("n", F.col("before") + F.col("nth"))
    numbered = numbered.withColumn("block", F.floor(F.col("n") / block_docs).cast("long")).withColumn("part", F.floor(F.col("block") / period).cast("long"))
    small = sum(len(p[6]) for p in plan) <= 4_000_000  # 8 bytes each
    placed = numbered.join(F.broadcast(table) if small else table, ["source", "part"])
    slot = F.element_at("slots", (F.col("block") - F.col("part") * period + 1).cast("int")).cast("long")
    return placed.select("row", "block", slot.alias("slot"), (F.col("n") % block_docs).cast("int").alias("offset"))


def _packed(docs: DataFrame, by: str, text: str) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(by).cast("string").alias("source"), _draw(F.col("doc_id"), F.col(text)).alias("draw"), F.col("doc_id").cast("long").alias("tie"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.5, block_docs: int = 16, period: int = 1000, by: str = "source", text: str = "text") -> DataFrame:
    """Every row with ``mix_block`` (its block in the source), ``mix_slot`` (the block's turn) and ``mix_offset`` (place in the block); columns of these names are replaced.

    Within a source documents are ordered by a hash of their id and text, so a
    block is no run of neighbours.
    """
    rest = docs.drop("mix_block", "mix_slot", "mix_offset")
    found = _dealt(_packed(rest, by, text), weights, temper, block_docs, period)
    return found.select("row.*", F.col("block").alias("mix_block"), F.col("slot").alias("mix_slot"), F.col("offset").alias("mix_offset"))


def mix_order(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.5, block_docs: int = 16, period: int = 1000) -> DataFrame:
    """``doc_id, source, mix_block, mix_slot, mix_offset`` of every document; texts aren't moved."""
    rows = _packed(docs.select("doc_id", "source", "text"), "source", "text").withColumn("row", F.struct(F.col("tie").alias("doc_id"), "source"))
    found = _dealt(rows, weights, temper, block_docs, period)
    return found.select("row.doc_id", "row.source", F.col("block").alias("mix_block"), F.col("slot").alias("mix_slot"), F.col("offset").alias("mix_offset"))


def interleaved(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.5, block_docs: int = 16, period: int = 1000) -> DataFrame:
    """The documents, columns as given, dealt and sorted so that the files hold them in the order of the mix."""
    kept = _dealt(_packed(docs, "source", "text"), weights, temper, block_docs, period)
    return kept.repartitionByRange(F.col("slot")).sortWithinPartitions("slot", "offset").select("row.*")
