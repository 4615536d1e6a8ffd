"""Archives kept as two JSON files, brought over version by version.

``metadata.dat`` holds columns, snapshots and the key; ``rows.dat`` has a line for
each row, with the versions it was there in, its positions, and the values of its
cells with their versions. A version that isn't said is the row's.

    {"r": 5, "k": "pier", "t": [[2, 4], [6, 6]], "p": [{"t": [[2, 2]], "v": 17}, {"t": [[3, 4], [6, 6]], "v": 12}], "c": {"0": {"v": "pier"}, "3": {"t": [[4, 4]], "v": 8.25}}}

Older archives keep the rows as one JSON array, an element a line or all in one;
the lines of either form are read in splits.

Rows are parsed once, by Spark; each version is then a selection of them that is
committed, so a row keeps its identity by its key or row index. Values keep their
JSON types, and row indexes too: numbers, texts or lists, and where they are of
several kinds, all of them with their kind. Times of the snapshots are kept.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import replace

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.archive import Archive
from palimpsest.snapshots import SnapshotDescriptor, SnapshotListing, as_time
from palimpsest.sources.documents import Document, json_cell, json_typed
from palimpsest.sources.files import Files
from palimpsest.store import scratch_dir

_SPANS = "array<array<int>>"
_VALUE = f"struct<t: {_SPANS}, v: variant>"


def _covers(spans: SparkColumn, version: int) -> SparkColumn:
    return F.exists(spans, lambda s: (s[0] <= version) & (s[1] >= version))


def _value_at(value: SparkColumn, version: int) -> SparkColumn:
    """The variant that a value, given alone or in a list with their versions, has at a version."""
    each = F.coalesce(F.try_variant_get(value, "$", f"array<{_VALUE}>"), F.array(F.try_variant_get(value, "$", _VALUE)))
    held = F.filter(each, lambda x: x["v"].isNotNull() & (x["t"].isNull() | _covers(x["t"], version)))
    return F.get(held, F.lit(0))["v"]


def _covers_py(spans: list, version: int) -> bool:
    return any(a <= version <= b for a, b in spans)


def _value_py(value, version: int):
    held = value if isinstance(value, list) else [value]
    return next((x["v"] for x in held if "t" not in x or _covers_py(x["t"], version)), None)


def _time(value):
    return as_time(value["$datetime"] if isinstance(value, dict) else value)


def _rows(spark: SparkSession, path: str, copy: str) -> DataFrame:
    """The parsed rows, written once to ``copy``."""
    schema = f"array<struct<k: variant, t: {_SPANS}, p: variant, c: map<string,variant>>>"
    objects = F.regexp_extract("value", r"(?s)^\s*\[?\s*(\{.*\})", 1)  # without what belongs to an array around them
    parsed = spark.read.text(path).select(objects.alias("o")).where("o != ''").select(F.explode(F.from_json(F.concat(F.lit("["), "o", F.lit("]")), schema)).alias("r")).select("r.*")
    parsed.write.parquet(copy)
    return spark.read.schema(parsed.schema).parquet(copy)


def import_archive(spark: SparkSession, source: str, path: str | None = None) -> Archive:
    """A new archive, in a folder or a volatile one, with all versions of the one in the folder ``source``. Compressed rows are read if the file is named ``rows.dat.gz``."""
    files = Files(spark)
    meta = json.loads(files.read(f"{source}/metadata.dat"))
    name = next((n for n in ("rows.dat", "rows.dat.gz") if files.exists(f"{source}/{n}")), "rows.dat")
    copy = f"{scratch_dir(spark)}/import-{uuid.uuid4().hex}"
    try:
        return _imported(spark, meta, _rows(spark, f"{source}/{name}", copy), path)
    finally:
        files.delete(copy)


def _imported(spark: SparkSession, meta: dict, rows: DataFrame, path: str | None) -> Archive:
    key, archive, names = meta.get("primaryKey"), None, {}
    # the kinds of all row indexes, so that one of them is the same key in every version
    indexes = set() if key else {r[0] for r in rows.select(json_cell(F.col("k"))["t"]).distinct().collect()} - {None}
    snapshots = sorted(meta.get("snapshots", []), key=lambda s: s["v"])
    for snapshot in snapshots:
        version = snapshot["v"]
        columns = sorted((_value_py(c["p"], version), c["c"], str(_value_py(c["n"], version))) for c in meta["schema"] if _covers_py(c["t"], version))
        alive = rows.where(_covers(F.col("t"), version))
        cells = alive.select(
            F.variant_get(_value_at(F.col("p"), version), "$", "bigint").alias("__pos"), json_cell(F.col("k")).alias("__idx"),
            *[json_cell(_value_at(F.col("c")[str(colid)], version)).alias(f"v_{i}") for i, (_, colid, _) in enumerate(columns)],
        )
        kinds = cells.agg(*[F.sort_array(F.collect_set(f"v_{i}.t")).alias(f"v_{i}") for i in range(len(columns))], F.lit(0).alias("one")).first()
        index = [] if key else [json_typed("__idx", indexes, None).alias("__idx")]
        document = Document(cells.select("__pos", *index, *[json_typed(f"v_{i}", set(kinds[f"v_{i}"]), None).alias(f"v_{i}") for i in range(len(columns))]), [n for _, _, n in columns])
        about = SnapshotDescriptor(snapshot.get("d"), _time(snapshot["vt"]), snapshot.get("a"))
        renamed = {names[c]: n for _, c, n in columns if c in names and names[c] != n}
        names = {c: n for _, c, n in columns}
        if archive is None:
            archive = Archive.create(spark, path, document, [names[c] for c in key] if key else None, about)
        else:
            archive.commit(document, about, renamed or None)
    if archive is None:
        return Archive.create(spark, path)
    m = archive.store.manifest
    listed = [replace(own, transaction_time=_time(s["tt"])) for own, s in zip(m.snapshots, snapshots)]
    archive.store.publish(replace(m, snapshots=SnapshotListing(listed)))
    return archive
