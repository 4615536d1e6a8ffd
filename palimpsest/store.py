"""Where an archive lies: Parquet tables that are only ever added, and a manifest that names the current ones.

    manifest-N.json              snapshots, columns, key, counters, table folders; the highest N counts
    data/<commit>/segments/state=open|ended|closed    rowid, from_version, to_version, cells
    data/<commit>/positions/state=open|ended|closed   rowid, label, digests of the cells, since, from_version, to_version
    data/<commit>/keys                                rowid, key, occ, kh, since

A commit writes only what changes: the segments that begin (``open``), and for
each that ends its row and versions (``ended``), which takes it out of the open
ones of earlier commits. Readers broadcast the ended ones while they are few (``SENT``);
more of them meet the open ones in a join that deals both out by row. Their number is
bounded (``ENDED_MOST``, and ``ENDED_SHARE`` of the open ones): a commit that goes
beyond it settles the table, open and ``closed`` segments in files of their own, and
deals the rows to its buckets before that join, so that it moves them once.

Open and closed rows lie in hash buckets, those of keys by the key's hash, the
others by row. A commit reads them as bucketed tables and so joins without moving
them; a few rows are looked up in the files of their buckets only. The number of
buckets is the archive's and grows with it (``buckets_for``).

A rollback moves nothing: it puts a ``cut`` on every folder. Of a folder with a cut
only what had begun by that version counts, and what ended with it or later is open
again; folders that come after have no cut, so a version that is made anew is told
apart from the one that it replaces.

A commit writes its tables under a folder of its own and last makes the next
manifest, the one step that publishes it: a file that isn't there is made whole,
by one writer only. A failed commit leaves files that no manifest names;
``vacuum`` deletes those and what no longer counts.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.columns import ArchiveSchema
from palimpsest.functions.keys import KEY_TYPE
from palimpsest.snapshots import Snapshot, SnapshotListing
from palimpsest.sources.files import Files

TABLES = {
    "segments": "rowid bigint, from_version int, to_version int",
    "positions": "rowid bigint, label bigint, d1 bigint, d2 bigint, since int, from_version int, to_version int",
    "keys": f"rowid bigint, key {KEY_TYPE.simpleString()}, occ int, kh bigint, since int",
}
ENDED = "rowid bigint, from_version int, to_version int"
PARTS = ("segments_open", "segments_ended", "segments_closed", "positions_open", "positions_ended", "positions_closed", "keys")
OPEN = 2**31 - 1
#: Ended segments that a table may have before it is settled: 4 million rows of 16 bytes, and no more than a quarter of the open ones.
ENDED_MOST, ENDED_SHARE = 4_000_000, 0.25
#: Rows of a table that are sent through the driver to all tasks at most.
SENT = 100_000
KEPT_MANIFESTS = 8
#: Settings by which Spark deletes what a query has moved as soon as it ends.
CLEANUP = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled",)
#: What the buckets of a table are made by.
BUCKETED_BY = {"segments": "rowid", "positions": "rowid", "keys": "kh"}


class ChangedMeanwhile(RuntimeError):
    """Another writer has published a version since the archive was loaded."""


def buckets_for(rows: int) -> int:
    """Buckets for so many rows: one for each 8,192 up to 64, so that few rows are found in few files, then one for each million."""
    return max(min(64, 1 << max(0, (rows - 1) // 8192).bit_length()), 1 << max(0, (rows - 1) >> 20).bit_length())


@dataclass(frozen=True)
class Part:
    """A folder of a table, in so many buckets; later versions than ``cut`` don't count in it."""

    path: str
    buckets: int
    cut: int | None = None


@dataclass(frozen=True)
class Manifest:
    schema: ArchiveSchema = field(default_factory=ArchiveSchema)
    snapshots: SnapshotListing = field(default_factory=SnapshotListing)
    primary_key: tuple[int, ...] | None = None
    row_counter: int = 0
    next_key: int = 0  # above every row index that has been a key
    paths: dict[str, tuple[Part, ...]] = field(default_factory=lambda: {p: () for p in PARTS})
    cells: dict[str, str] = field(default_factory=dict)  # physical cell columns and their types
    counts: dict[str, int] = field(default_factory=dict)  # rows of the open and ended parts
    buckets: int = 1
    most_occ: int = 0  # the most rows that have had one key
    top_label: int = 0  # above every label
    digested: tuple[str, ...] = ()  # the cells that the digests of living rows may hold
    frames: dict[int, int] = field(default_factory=dict)  # versions whose positions count among the rows of an earlier one
    batches: dict[str, int] = field(default_factory=dict)  # the last batch of each stream

    def to_json(self) -> str:
        return json.dumps({
            "schema": self.schema.to_json(), "snapshots": [s.to_json() for s in self.snapshots], "primary_key": self.primary_key,
            "row_counter": self.row_counter, "next_key": self.next_key, "paths": {p: [[x.path, x.buckets, x.cut] for x in parts] for p, parts in self.paths.items()}, "cells": self.cells, "counts": self.counts,
            "buckets": self.buckets, "most_occ": self.most_occ, "top_label": self.top_label, "digested": self.digested, "frames": sorted(self.frames.items()), "batches": self.batches,
        }, indent=1)

    def replaced(self, **fields) -> Manifest:
        return replace(self, **fields)

    def frame(self, version: int) -> int:
        """The version among whose rows the positions of a version count."""
        return self.frames.get(version, version)

    def cut(self, version: int) -> dict[str, tuple[Part, ...]]:
        """All folders, cut at a version."""
        return {p: tuple(Part(x.path, x.buckets, version if x.cut is None else min(x.cut, version)) for x in parts) for p, parts in self.paths.items()}

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        d = json.loads(text)
        return cls(
            ArchiveSchema.from_json(d["schema"]), SnapshotListing([Snapshot.from_json(s) for s in d["snapshots"]]), tuple(d["primary_key"]) if d["primary_key"] else None,
            d["row_counter"], d["next_key"], {p: tuple(Part(*x) for x in d["paths"].get(p, ())) for p in PARTS}, d["cells"], d["counts"],
            d["buckets"], d["most_occ"], d["top_label"], tuple(d["digested"]), dict(map(tuple, d["frames"])), d["batches"],
        )


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, for volatile archives; a temporary one only in a local session for which none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/") if found else tempfile.gettempdir()


class Store:
    """One archive's folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        self.manifest = Manifest()
        self._number = -1

    @classmethod
    def volatile(cls, spark: SparkSession) -> Store:
        return cls(spark, f"{scratch_dir(spark)}/archive-{uuid.uuid4().hex}")

    def _numbers(self) -> list[int]:
        return sorted(int(m[1]) for n in self.files.names(self.path) if (m := re.fullmatch(r"manifest-(\d+)\.json", n)))

    def load(self) -> Store:
        numbers = self._numbers()
        if not numbers:
            raise FileNotFoundError(f"there is no archive at {self.path}")
        self.manifest, self._number = Manifest.from_json(self.files.read(f"{self.path}/manifest-{numbers[-1]:06d}.json")), numbers[-1]
        return self

    def exists(self) -> bool:
        return bool(self._numbers())

    def clear(self) -> None:
        self.files.delete(self.path)
        self.manifest, self._number = Manifest(), -1

    def new_data(self) -> str:
        """A folder for the tables of one commit, relative to the archive."""
        return f"data/{self.manifest.snapshots.next_version():06d}-{uuid.uuid4().hex[:12]}"

    def drop_steps(self, data: str, *names: str) -> None:
        """Delete steps of a commit that nothing reads any more."""
        for name in names:
            self.files.delete(f"{self.path}/{data}/{name}")

    @contextmanager
    def passing_shuffles(self) -> Iterator[None]:
        """Within the block what Spark moves for a write is deleted once that is done: steps are read from their files, never from what was moved for them."""
        before = {name: self.spark.conf.get(name, None) for name in CLEANUP}
        try:
            for name in CLEANUP:
                self.spark.conf.set(name, "true")
            yield
        finally:
            for name, value in before.items():
                self.spark.conf.unset(name) if value is None else self.spark.conf.set(name, value)

    def publish(self, manifest: Manifest) -> None:
        """Make the next manifest. Of two writers that began from the same one the second fails."""
        last = self._numbers()[-1:]
        if last and last[0] != self._number or not self.files.create(f"{self.path}/manifest-{self._number + 1:06d}.json", manifest.to_json()):
            raise ChangedMeanwhile("the archive was changed by another writer; load it again")
        self.manifest, self._number = manifest, self._number + 1

    def schema_of(self, part: str, manifest: Manifest | None = None) -> T.StructType:
        """The declared schema of one of ``PARTS``, so that nothing is inferred and old files lack new cells as nulls."""
        m, ended = manifest or self.manifest, part.endswith("_ended")
        table = part.split("_")[0]
        schema = T.StructType.fromDDL(ENDED if ended else TABLES[table])
        if table == "segments" and not ended:
            for name, kind in m.cells.items():
                schema.add(T.StructField(name, T.StructType.fromDDL(f"x {kind}")[0].dataType))
        return schema

    def _by_cut(self, part: str, m: Manifest) -> list[tuple[int | None, list[str]]]:
        found: dict[int | None, list[str]] = {}
        for p in m.paths[part]:
            found.setdefault(p.cut, []).append(f"{self.path}/{p.path}")
        return list(found.items())

    def _scan(self, part: str, paths: list[str], m: Manifest) -> DataFrame:
        schema = self.schema_of(part, m)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _without_ended(self, rows: DataFrame, table: str, m: Manifest, how: str, buckets: int | None = None) -> DataFrame:
        """Rows joined with ``__rowid, __from, __to`` of what has ended. Few of those go to all tasks; more are dealt out by row, as the rows are, into ``buckets`` if given."""
        parts = [self._scan(f"{table}_ended", paths, m).where(F.lit(True) if cut is None else F.col("to_version") < cut) for cut, paths in self._by_cut(f"{table}_ended", m)]
        ended = reduce(DataFrame.union, parts).toDF("__rowid", "__from", "__to")
        few = m.counts[f"{table}_ended"] <= SENT  # no less than there are: a cut only takes some away
        if buckets:
            rows, ended = rows.repartition(buckets, "rowid"), ended if few else ended.repartition(buckets, "__rowid")
        # a difference, since an equality would have rows dealt by both columns and so moved out of their buckets
        return rows.join(F.broadcast(ended) if few else ended.hint("merge"), (F.col("rowid") == F.col("__rowid")) & (F.col("from_version") - F.col("__from") == 0), how)

    def unsent(self, rows: DataFrame) -> DataFrame:
        """A side of a join, a row or so for each of the archive's. If it has many, they aren't sent to all tasks, however few bytes their files have (in memory a key takes some ten times as many)."""
        return rows if self.manifest.row_counter <= SENT else rows.hint("merge")

    def keys(self, manifest: Manifest | None = None, since: bool = False) -> DataFrame:
        """``rowid, key, occ, kh`` of every row there has been, and on request the version that it came with."""
        m = manifest or self.manifest
        parts = [self._scan("keys", paths, m).where(F.lit(True) if cut is None else F.col("since") <= cut) for cut, paths in self._by_cut("keys", m)]
        return (reduce(DataFrame.union, parts) if parts else self._scan("keys", [], m)).drop(*([] if since else ["since"]))

    def spans(self, table: str, manifest: Manifest | None = None, alive: int | None = None, buckets: int | None = None) -> DataFrame:
        """Segments or positions with the versions they held in, open ones to ``OPEN``; with ``alive`` those of one version, with ``buckets`` dealt out by row. The filters reach the scans."""
        m, parts = manifest or self.manifest, []
        for state in ("open", "closed"):
            for cut, paths in self._by_cut(f"{table}_{state}", m):
                rows = self._scan(f"{table}_{state}", paths, m)
                least = [v for v in (alive, cut) if v is not None]
                if least:
                    rows = rows.where(F.col("from_version") <= min(least))
                if alive is not None and state == "closed":
                    rows = rows.where(F.col("to_version") >= min(least))
                parts.append(rows if cut is None else rows.withColumn("to_version", F.when(F.col("to_version") >= cut, OPEN).otherwise(F.col("to_version"))))
        rows = reduce(DataFrame.unionByName, parts) if parts else self._scan(f"{table}_open", [], m)
        if m.paths[f"{table}_ended"]:
            names = rows.columns
            rows = self._without_ended(rows, table, m, "left", buckets)
            rows = rows.where(F.col("__to").isNull() | (F.col("__to") >= alive)) if alive is not None else rows
            return rows.withColumn("to_version", F.coalesce("__to", "to_version")).select(*names)
        return rows.repartition(buckets, "rowid") if buckets else rows

    # what is living now, by buckets

    def _living_parts(self, table: str, m: Manifest) -> list[Part]:
        """What may hold living rows, ``OPEN`` for no cut."""
        parts = m.paths["keys"] if table == "keys" else (*m.paths[f"{table}_open"], *(p for p in m.paths[f"{table}_closed"] if p.cut is not None))
        return [Part(f"{self.path}/{p.path}", p.buckets, OPEN if p.cut is None else p.cut) for p in parts]

    def _still(self, table: str, rows: DataFrame, m: Manifest) -> DataFrame:
        """Of rows with the ``cut`` of their folder those that live."""
        if table == "keys":
            return rows.where(F.col("since") <= F.col("cut")).drop("cut", "since")
        rows = rows.where((F.col("from_version") <= F.col("cut")) & (F.col("to_version") >= F.col("cut"))).withColumn("to_version", F.lit(OPEN)).drop("cut")
        if m.paths[f"{table}_ended"]:
            rows = self._without_ended(rows, table, m, "left_anti")
        return rows

    @contextmanager
    def bucketed(self, table: str, manifest: Manifest | None = None) -> Iterator[DataFrame | None]:
        """Living rows as a table whose buckets Spark knows, so that a join by them doesn't move them; for use within the block. None if there are none."""
        m, name, conf = manifest or self.manifest, f"palimpsest_{uuid.uuid4().hex}", "spark.sql.requireAllClusterKeysForCoPartition"
        parts = self._living_parts(table, m)
        if not parts:
            yield None
            return
        if any(p.buckets != m.buckets for p in parts):  # until the table is settled in its new buckets
            yield self.keys(m) if table == "keys" else self.living(table, m)
            return
        by, before = BUCKETED_BY[table], self.spark.conf.get(conf)
        columns = f"{self.schema_of(f'{table}_open' if table != 'keys' else table, m).toDDL()}, part INT, cut INT"
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (path '{self.path}/data') PARTITIONED BY (part, cut) CLUSTERED BY ({by}) INTO {m.buckets} BUCKETS")
        try:
            places = " ".join(f"PARTITION (part={k}, cut={p.cut}) LOCATION '{p.path}'" for k, p in enumerate(parts))
            self.spark.sql(f"ALTER TABLE {name} ADD {places}")
            self.spark.conf.set(conf, "false")  # rows are dealt by the bucket's column, not by all that are compared
            yield self._still(table, self.spark.table(name).drop("part"), m)
        finally:
            self.spark.conf.set(conf, before)
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def bucket_of(self, column: str) -> Column:
        """The bucket of a row by the column of its table's buckets."""
        return F.pmod(F.hash(column), F.lit(self.manifest.buckets))

    def bucket_files(self, table: str, buckets: set[int]) -> list[tuple[str, int]]:
        """(file, cut) of all files that living rows of some buckets may be in."""
        m, out = self.manifest, []
        for p in self._living_parts(table, m):
            for name in self.files.names(p.path):
                found = re.search(r"_(\d+)\.c\d+\.", name)
                if found and (p.buckets != m.buckets or int(found[1]) in buckets):
                    out.append((f"{p.path}/{name}", p.cut))
        return out

    def in_buckets(self, table: str, buckets: set[int]) -> DataFrame:
        """Living rows, from the files of some buckets only."""
        m, found = self.manifest, {}
        for file, cut in self.bucket_files(table, buckets):
            found.setdefault(cut, []).append(file)
        part = table if table == "keys" else f"{table}_open"
        parts = [self._scan(part, files, m).withColumn("cut", F.lit(cut)) for cut, files in found.items()] or [self._scan(part, [], m).withColumn("cut", F.lit(OPEN))]
        return self._still(table, reduce(DataFrame.unionByName, parts), m)

    def living(self, table: str, manifest: Manifest | None = None) -> DataFrame:
        """The segments or positions that are open now, or all keys."""
        return self.spans(table, manifest).where(F.col("to_version") == OPEN)

    def write_bucketed(self, df: DataFrame, table: str, path: str, buckets: int, by_state: bool = False, seen: Observation | None = None, *counts: Column) -> None:
        """Write rows in buckets, by ``state`` if asked; ``seen`` gets the ``counts``. The table is forgotten, its files stay."""
        self.write_dealt(df.repartition(buckets, BUCKETED_BY[table]), table, path, buckets, by_state, seen, *counts)

    def write_dealt(self, df: DataFrame, table: str, path: str, buckets: int, by_state: bool = False, seen: Observation | None = None, *counts: Column) -> None:
        """The same of rows that have been dealt to their buckets."""
        name, by = f"palimpsest_{uuid.uuid4().hex}", BUCKETED_BY[table]
        writer = (df.observe(seen, *counts) if seen else df).write.bucketBy(buckets, by).option("path", f"{self.path}/{path}").option("compression", "zstd").format("parquet")
        (writer.partitionBy("state") if by_state else writer).saveAsTable(name)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def vacuum(self) -> list[str]:
        """Delete data folders and manifests that don't count any more; readers of older versions of the tables must be done."""
        used = {p.path.split("/")[1] for parts in self.manifest.paths.values() for p in parts}
        gone = [f"data/{n}" for n in self.files.names(f"{self.path}/data") if n not in used]
        old = [f"manifest-{n:06d}.json" for n in self._numbers() if n <= self._number - KEPT_MANIFESTS]
        gone += [n for n in self.files.names(self.path) if n in old or n.endswith(".draft")]
        for name in gone:
            self.files.delete(f"{self.path}/{name}")
        return gone
