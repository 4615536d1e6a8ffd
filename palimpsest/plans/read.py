"""Reading versions and histories: filters on two integer columns that reach the Parquet scan, and only the cells that are asked for."""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.cells import as_text, value_at
from palimpsest.plans.labels import with_positions
from palimpsest.store import Store


def whole(store: Store, table: str) -> DataFrame:
    """All segments or positions; those that are open end with the last version."""
    last = store.manifest.snapshots.next_version() - 1
    return store.spans(table).withColumn("to_version", F.least("to_version", F.lit(last)))


def _covers(version: SparkColumn | int) -> SparkColumn:
    return (F.col("from_version") <= version) & (F.col("to_version") >= version)


def labels_at(store: Store, version: int) -> DataFrame:
    """``rowid, label``: the rows of a version and what orders them."""
    return store.spans("positions", alive=version).select("rowid", "label")


def positions_at(store: Store, version: int) -> DataFrame:
    """``rowid, pos`` of a version, none if the archive doesn't have it. Positions count among the rows of the version's frame: rows that an operator dropped leave their places empty."""
    m = store.manifest
    frame = m.frame(version)
    if frame == version or not m.snapshots.has_version(version):
        rows = labels_at(store, version) if m.snapshots.has_version(version) else labels_at(store, 0).where("false")
        return with_positions(rows).select("rowid", "pos")
    rows = whole(store, "positions").where(_covers(version) | _covers(frame))
    rows = rows.groupBy("rowid").agg(F.max("label").alias("label"), F.bool_or(_covers(version)).alias("now"))
    return with_positions(rows).where("now").select("rowid", "pos")


def positions_of_all(store: Store) -> DataFrame:
    """``rowid, version, pos`` of every row in every version."""
    m = store.manifest
    pairs = F.array(*[F.struct(F.lit(s.version).alias("v"), F.lit(m.frame(s.version)).alias("f")) for s in m.snapshots])
    rows = whole(store, "positions").select("rowid", "label", "from_version", "to_version", F.explode(F.filter(pairs, lambda p: _covers(p["v"]) | _covers(p["f"]))).alias("p"))
    rows = rows.groupBy("rowid", F.col("p.v").alias("version")).agg(F.max("label").alias("label"), F.bool_or(_covers(F.col("p.v"))).alias("now"))
    return with_positions(rows, "version").where("now").select("rowid", "version", "pos")


def rows_at(store: Store, version: int, positions: bool = False, keys: bool = False, labels: bool = False) -> tuple[DataFrame, list[str]]:
    """``rowid``, ``v_0`` .. of the columns at ``version``, ``pos``, ``label`` (which orders like ``pos`` and costs less) and ``key`` on request; and the columns."""
    m = store.manifest
    columns, kinds = m.schema.at_version(version), m.schema.kinds_at(version)
    values = [value_at(c.colid, kinds[c.colid], m.cells).alias(f"v_{i}") for i, c in enumerate(columns)]
    out = store.spans("segments", alive=version).select("rowid", *values)
    if labels:
        out = out.join(store.unsent(labels_at(store, version)), "rowid")
    if positions:
        out = out.join(store.unsent(positions_at(store, version)), "rowid")
    if keys:
        out = out.join(store.unsent(store.keys().select("rowid", "key")), "rowid")
    return out, columns


def index_of(key: SparkColumn) -> SparkColumn:
    """A row index as a number, from its key."""
    return key[0]["whole"]


def lifetimes(store: Store) -> DataFrame:
    """``rowid, from_version, to_version`` of each unbroken life of a row."""
    s = whole(store, "segments").select("rowid", "from_version", "to_version")
    order = Window.partitionBy("rowid").orderBy("from_version")
    fresh = (F.col("from_version") > F.lag("to_version").over(order) + 1) | F.lag("to_version").over(order).isNull()
    numbered = s.withColumn("life", F.sum(fresh.cast("int")).over(order))
    return numbered.groupBy("rowid", "life").agg(F.min("from_version").alias("from_version"), F.max("to_version").alias("to_version")).drop("life")


def cell_history(store: Store, colid: int) -> DataFrame:
    """``rowid, value, from_version, to_version``: each run of versions in which a row's cell had a value while the column was there. Values are text if the column changed its type, else of its type."""
    m = store.manifest
    history = m.schema.columns[colid]
    kinds = {s.kind for s in history.spells}
    parts = []
    for spell in history.spells:
        value = value_at(colid, spell.kind, m.cells)
        value = value if len(kinds) == 1 else as_text(value, spell.kind)
        seg = whole(store, "segments").where((F.col("from_version") <= spell.last) & (F.col("to_version") >= spell.first))
        parts.append(seg.select("rowid", value.alias("value"), F.greatest("from_version", F.lit(spell.first)).alias("from_version"), F.least("to_version", F.lit(spell.last)).alias("to_version")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    order = Window.partitionBy("rowid").orderBy("from_version")
    fresh = F.coalesce((F.col("from_version") > F.lag("to_version").over(order) + 1) | ~F.col("value").eqNullSafe(F.lag("value").over(order)), F.lit(True))
    fresh = fresh | F.lag("to_version").over(order).isNull()
    numbered = out.withColumn("run", F.sum(fresh.cast("int")).over(order))
    return numbered.groupBy("rowid", "run").agg(F.first("value").alias("value"), F.min("from_version").alias("from_version"), F.max("to_version").alias("to_version")).drop("run")


def nested_rows(store: Store) -> DataFrame:
    """The nested view of an archive: ``rowid, key, versions, positions, cells``, where each distinct value of a cell has the runs of versions it held in.

    It is made from the tables when it is asked for; nothing is kept this way.
    """
    run = F.struct("from_version", "to_version")
    lives = lifetimes(store).groupBy("rowid").agg(F.sort_array(F.collect_list(run)).alias("versions"))
    nth = F.row_number().over(Window.partitionBy("rowid", "pos").orderBy("version"))
    held = positions_of_all(store).withColumn("run", F.col("version") - nth).groupBy("rowid", "pos", "run").agg(F.min("version").alias("from_version"), F.max("version").alias("to_version"))
    places = held.groupBy("rowid", "pos").agg(F.sort_array(F.collect_list(run)).alias("versions"))
    places = places.groupBy("rowid").agg(F.sort_array(F.collect_list(F.struct("versions", "pos"))).alias("positions"))
    out = store.keys().select("rowid", "key").join(store.unsent(lives), "rowid").join(store.unsent(places), "rowid")
    cells = None
    for colid in store.manifest.schema.columns:
        h = cell_history(store, colid).where("value is not null")
        kind = store.manifest.schema.columns[colid].spells[-1].kind
        h = h.select("rowid", F.lit(colid).alias("colid"), as_text(F.col("value"), kind).alias("value"), "from_version", "to_version")
        cells = h if cells is None else cells.union(h)
    if cells is None:
        return out.withColumn("cells", F.lit(None).cast("array<struct<colid int, versions array<struct<from_version int, to_version int>>, value string>>"))
    per_value = cells.groupBy("rowid", "colid", "value").agg(F.sort_array(F.collect_list(run)).alias("versions"))
    per_row = per_value.groupBy("rowid").agg(F.sort_array(F.collect_list(F.struct("colid", "versions", "value"))).alias("cells"))
    return out.join(store.unsent(per_row), "rowid", "left")
