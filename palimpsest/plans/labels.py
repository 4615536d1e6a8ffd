"""Order labels: numbers that keep rows in their order, so that a row that goes or comes changes no other row's.

A row's position isn't kept; its label is, and the position is the number of
smaller labels among the rows of the version, counted when it is asked for
(``with_positions``). Labels begin ``GAP`` apart. A commit finds the rows whose
labels no longer rise with their new places and gives only those, and the rows
without a label, new ones between those of their neighbours.

Places are cut into chunks of ``CHUNK``. Within a chunk a window tells whether the
labels rise; only a chunk in which they don't goes through a longest rising
subsequence. One row of figures for each chunk comes to the driver, which keeps a
chain of chunks that rises as well, and deals the gaps between chunks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.files import Files, step

#: Distance of first labels, as a power of two; places in a chunk.
GAP, CHUNK = 20, 1 << 14
#: Labels of a range that is counted as one when positions are asked for, as a power of two: 4096 rows of first labels.
RANGE = GAP + 12
#: Ranges that are added up as one, as a power of two.
UPPER = 12


def first_label(place: Column) -> Column:
    return F.shiftleft(place.cast("bigint") + 1, GAP)


def with_positions(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Rows with ``pos``, how many of them have a smaller ``label`` (among those of equal ``by``). Ranges of labels are counted, their counts added up in two levels, and rows numbered within their range; no window holds a table."""
    of = [by] if by else []
    rows = rows.withColumn("__range", F.shiftright("label", RANGE))
    counts = rows.groupBy(*of, "__range").agg(F.count("*").alias("__n")).withColumn("__upper", F.shiftright("__range", UPPER))
    uppers = counts.groupBy(*of, "__upper").agg(F.sum("__n").alias("__n"))
    so_far = lambda over: F.coalesce(F.sum("__n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = counts.withColumn("__within", so_far(Window.partitionBy(*of, "__upper").orderBy("__range")))
    above = uppers.select(*of, "__upper", so_far(Window.partitionBy(*of).orderBy("__upper")).alias("__above"))
    starts = within.join(above, [*of, "__upper"]).select(*of, "__range", (F.col("__within") + F.col("__above")).alias("__before"))
    nth = F.row_number().over(Window.partitionBy(*of, "__range").orderBy("label"))
    return rows.withColumn("__nth", nth).join(starts, [*of, "__range"]).withColumn("pos", F.col("__before") + F.col("__nth") - 1).drop("__range", "__nth", "__before")


@dataclass(frozen=True)
class Chunk:
    """Figures of one chunk: rows before its first label and after its last; how many labels; whether they rise, and leave room for the rows between."""

    number: int
    n: int
    held: int
    rising: bool
    tight: bool
    first: int | None
    last: int | None
    head: int
    tail: int


def rising_rows(labels: np.ndarray) -> np.ndarray:
    """Places of a longest rising subsequence."""
    ends, at, before = [], [], np.full(len(labels), -1)
    for i, x in enumerate(labels.tolist()):
        k = bisect_left(ends, x)
        if k == len(ends):
            ends.append(x)
            at.append(i)
        else:
            ends[k], at[k] = x, i
        before[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return np.array(out[::-1], int)


def chain(chunks: list[Chunk]) -> set[int]:
    """Chunks whose ranges of labels rise from one to the next and hold the most labels in all."""
    held = [c for c in chunks if c.held]
    if all(a.last < b.first for a, b in zip(held, held[1:])):
        return {c.number for c in held}
    lasts = sorted({c.last for c in held})
    best: list[tuple[int, int]] = [(0, -1)] * (len(lasts) + 1)  # a prefix maximum tree of (labels, chunk)
    before: dict[int, int] = {}
    for c in held:
        most, i = (0, -1), bisect_left(lasts, c.first)
        while i > 0:
            most, i = max(most, best[i]), i & (i - 1)
        before[c.number] = most[1]
        i, own = bisect_right(lasts, c.last), (most[0] + c.held, c.number)
        while i <= len(lasts):
            best[i], i = max(best[i], own), i + (i & -i)
    most, i = (0, -1), len(lasts)
    while i > 0:
        most, i = max(most, best[i]), i & (i - 1)
    out, at = set(), most[1]
    while at >= 0:
        out.add(at)
        at = before[at]
    return out


def bounds(chunks: list[Chunk]) -> dict[int, tuple[int, int]] | None:
    """The labels between which each chunk's own ones lie, from where the kept ones are; None if there is too little room."""
    held = [c for c in chunks if c.held]
    if not held:
        return None
    out: dict[int, list[int]] = {c.number: [0, 0] for c in chunks}
    waiting: list[tuple[Chunk, int]] = []  # chunks with rows since the last kept label, and how many
    last = held[0].first - (sum(c.n for c in chunks if c.number < held[0].number) + held[0].head + 1 << GAP)
    for c in chunks:
        waiting.append((c, c.head if c.held else c.n))
        if c.held:
            if not _dealt(out, waiting, last, c.first):
                return None
            last, waiting = c.last, [(c, c.tail)]
    return {k: (a, z) for k, (a, z) in out.items()} if _dealt(out, waiting, last, last + (sum(n for _, n in waiting) + 1 << GAP)) else None


def _dealt(out: dict[int, list[int]], waiting: list[tuple[Chunk, int]], low: int, high: int) -> bool:
    """Deal the labels between ``low`` and ``high`` to the chunks by their rows."""
    total = sum(n + 1 for _, n in waiting)
    if high - low < total + len(waiting):
        return False
    so_far = 0
    for k, (c, n) in enumerate(waiting):
        a, so_far = low + (high - low) * so_far // total, so_far + n + 1
        z = low + (high - low) * so_far // total
        # the first chunk may end with a kept label, the last one begins with one
        if not (k == 0 and c.held and c.last == low):
            out[c.number][0] = a
        out[c.number][1] = z
        if k == len(waiting) - 1 and c.held and c.first == high:
            out[c.number][1] = 0  # dealt with what comes after
    return True


def _windows(rows: DataFrame) -> DataFrame:
    """Rows with the kept labels beside them: ``__run`` counts those up to a row, ``__left`` and ``__right`` are the nearest, ``__size`` the rows without a label between them and ``__nth`` the number of this one."""
    chunk, back = (Window.partitionBy("__chunk").orderBy(o) for o in (F.col("n_pos"), F.desc("n_pos")))  # frames that grow cost a row each, those that shrink a chunk
    rows = rows.withColumns({
        "__run": F.count("__label").over(chunk.rowsBetween(Window.unboundedPreceding, 0)),
        "__right": F.last("__label", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)),
        "__most": F.max("__label").over(chunk.rowsBetween(Window.unboundedPreceding, -1)),
    })
    run = Window.partitionBy("__chunk", "__run")
    opened = (F.col("__run") > 0).cast("bigint")
    return rows.withColumns({"__left": F.max("__label").over(run), "__size": F.count("*").over(run) - opened, "__nth": F.row_number().over(run.orderBy("n_pos")) - opened})


def _figures(rows: DataFrame) -> list[Chunk]:
    """Of rows with their windows."""
    bare = F.col("__label").isNull()
    found = rows.groupBy("__chunk").agg(
        F.count("*").alias("n"), F.count("__label").alias("held"), F.coalesce(F.bool_and(F.col("__label") > F.col("__most")), F.lit(True)).alias("rising"),
        F.coalesce(F.bool_or(bare & (F.col("__right") - F.col("__left") <= F.col("__size"))), F.lit(False)).alias("tight"), F.min("__label").alias("first"), F.max("__label").alias("last"),
        F.count_if(bare & F.col("__left").isNull()).alias("head"), F.count_if(bare & F.col("__left").isNotNull() & F.col("__right").isNull()).alias("tail"),
    )
    return [Chunk(*r) for r in sorted(map(tuple, found.collect()))]


def _risen(rows: DataFrame) -> DataFrame:
    """Chunks with the labels of a longest rising subsequence only."""

    def apply(table: pa.Table) -> pa.Table:
        table = table.sort_by("n_pos")
        labels = table["__label"].to_numpy(zero_copy_only=False)
        there = np.flatnonzero(~np.isnan(labels.astype(float)))
        own = table["__label"].to_pylist()
        kept = {int(there[k]) for k in rising_rows(np.array([own[i] for i in there], np.int64))}
        column = pa.array([x if i in kept else None for i, x in enumerate(own)], pa.int64())
        return table.set_column(table.schema.get_field_index("__label"), "__label", column)

    return rows.groupBy("__chunk").applyInArrow(apply, rows.schema)


def labelled(rows: DataFrame, path: str) -> tuple[DataFrame, bool]:
    """Rows (``n_pos``, ``o_label``, null for a row that had none, and more) with ``label``: the old one for as many as can keep it. Whether all are new, for lack of room."""
    spark, names = rows.sparkSession, [*rows.columns, "__chunk", "__label"]
    placed = rows.withColumns({"__chunk": F.floor(F.col("n_pos") / CHUNK), "__label": F.col("o_label")})
    for attempt in range(4):
        beside = _windows(placed)
        beside = step(beside, f"{path}-{attempt}")  # each of its uses reads the windows and doesn't make them again
        if attempt:
            Files(spark).delete(f"{path}-{attempt - 1}")
        chunks = _figures(beside)
        linked = chain([c for c in chunks if c.rising and not c.tight])
        fallen = {c.number for c in chunks if not c.rising}
        bare = {c.number for c in chunks if c.held and c.number not in linked and c.number not in fallen}
        if not fallen and not bare:
            break
        if attempt == 3:
            return rows.withColumn("label", first_label(F.col("n_pos"))), True
        what = F.broadcast(spark.createDataFrame([(k, k in bare) for k in sorted(fallen | bare)], "__chunk long, __bare boolean"))
        marked = beside.select(*names).join(what, "__chunk", "left").select(*names, "__bare")
        placed = marked.where("__bare IS NULL OR __bare").withColumn("__label", F.when(F.col("__bare").isNull(), F.col("__label"))).drop("__bare")
        if fallen:
            placed = placed.unionByName(_risen(marked.where("NOT __bare").drop("__bare")))
    limits = bounds(chunks)
    if limits is None:
        return rows.withColumn("label", first_label(F.col("n_pos"))), True
    between = F.broadcast(spark.createDataFrame([(c.number, *limits[c.number]) for c in chunks], "__chunk long, __low long, __high long"))
    new = F.expr("coalesce(__left, __low) + (coalesce(__right, __high) - coalesce(__left, __low)) div (__size + 1) * __nth")
    return beside.join(between, "__chunk").withColumn("label", F.coalesce(F.col("__label"), new)).select(*rows.columns, "label"), False
