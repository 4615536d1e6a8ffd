"""An archive: all snapshots of one dataset, merged by key or row index."""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.cells import cell_name, family, stored
from palimpsest.functions.columns import ArchiveSchema, Column, primary_key_ids
from palimpsest.functions.keys import key_of, python_order
from palimpsest.operators.dataset import Transform, action_text, as_operator
from palimpsest.plans import compare, read
from palimpsest.plans.merge import Incoming, advance, last_of_key, matched, upserted
from palimpsest.plans.ranks import ranked
from palimpsest.snapshots import Snapshot, SnapshotDescriptor, SnapshotListing
from palimpsest.sources.documents import Document, to_document
from palimpsest.sources.files import step
from palimpsest.store import Manifest, Store


@dataclass
class SnapshotDiff:
    """Changes between two versions: rows as a DataFrame, columns as a list."""

    changes: DataFrame
    columns: list[dict]

    def rows(self, op: str | None = None) -> DataFrame:
        return self.changes if op is None else self.changes.where(F.col("op") == op)

    def inserts(self) -> DataFrame:
        return self.rows("INSERT")

    def deletes(self) -> DataFrame:
        return self.rows("DELETE")

    def updates(self) -> DataFrame:
        return self.rows("UPDATE")

    def cells(self) -> DataFrame:
        """``rowid, key, colid, old_value, new_value`` of each changed cell."""
        return self.changes.select("rowid", "key", F.explode("cells").alias("c")).select("rowid", "key", "c.colid", F.col("c.old").alias("old_value"), F.col("c.new").alias("new_value"))

    def moved(self) -> DataFrame:
        return self.changes.where("new_pos is not null").select("rowid", "key", "old_pos", "new_pos")

    def schema(self) -> list[dict]:
        return self.columns

    def describe(self) -> dict[str, dict[str, int]]:
        """Counts of the changes of columns and rows."""
        return {"schema": compare.described_schema(self.columns), "rows": compare.described(self.changes).first().asDict()}


class Archive:
    """Snapshots as versions 0, 1, 2 and so on. Without a key rows are matched by their row index."""

    def __init__(self, store: Store):
        self.store = store

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, doc=None, primary_key=None, descriptor: SnapshotDescriptor | None = None, replace: bool = False, batch: tuple[str, int] | None = None, fold: bool = False, **options) -> Archive:
        """A new archive in a folder, or a volatile one in the shared scratch folder. A key needs a first document. ``batch`` and ``fold`` are those of ``commit``."""
        store = Store(spark, path) if path else Store.volatile(spark)
        if store.exists():
            if not replace:
                raise ValueError(f"there is an archive at {path}")
            store.clear()
        if primary_key and doc is None:
            raise ValueError("a primary key needs a document")
        out = cls(store)
        if doc is None:
            store.publish(Manifest())
            return out
        document = to_document(spark, doc, **options)
        key = primary_key_ids(document.columns, primary_key)
        store.manifest = Manifest(primary_key=tuple(key) if key else None)
        out.commit(document, descriptor, batch=batch, fold=fold)
        return out

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Archive:
        return cls(Store(spark, path).load())

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    @property
    def primary_key(self) -> tuple[int, ...] | None:
        return self.store.manifest.primary_key

    def snapshots(self) -> SnapshotListing:
        return self.store.manifest.snapshots

    def schema(self) -> ArchiveSchema:
        return self.store.manifest.schema

    def is_empty(self) -> bool:
        return self.snapshots().is_empty()

    def snapshots_df(self) -> DataFrame:
        rows = [(s.version, s.valid_time, s.transaction_time, s.description, action_text(s.action)) for s in self.snapshots()]
        return self.spark.createDataFrame(rows, "version int, valid_time timestamp, transaction_time timestamp, description string, action string")

    # writing

    def known_kinds(self) -> dict[str, str]:
        """Name and type of the columns of the last version."""
        last = self.snapshots().last_snapshot()
        if last is None:
            return {}
        kinds = self.schema().kinds_at(last.version)
        return {str(c): kinds[c.colid] for c in self.schema().at_version(last.version)}

    def _document(self, doc, options: dict) -> Document:
        """The document of a commit. Types that are inferred from a file are those of the archive wherever all values have them; a key column keeps its type."""
        guessed = isinstance(doc, (str, os.PathLike)) and options.get("infer")
        known = self.known_kinds() if guessed else {}
        document = to_document(self.spark, doc, **({"kinds": known} if known else {}) | options)
        if guessed and self.primary_key:
            columns = {c.colid: str(c) for c in self.schema().at_version(self.snapshots().last_snapshot().version)} if known else {}
            for name in (columns[c] for c in self.primary_key if c in columns):
                kind = dict(zip(map(str, document.columns), document.kinds)).get(name)
                if kind is not None and family(kind) != family(known[name]):
                    raise ValueError(f"the values of key column {name} are not all {known[name]}, as they were until now; without infer they are text")
        return document

    def commit(self, doc, descriptor: SnapshotDescriptor | None = None, renamed: dict[str, str] | None = None, validate: bool = False, batch: tuple[str, int] | None = None, fold: bool = False, **options) -> Snapshot:
        """Merge a document as the next version. ``renamed`` says which old name a new one stands for; ``validate`` asks that a keyed document comes in key order; with ``fold`` the last of the rows of equal key counts, else they are rows of their own. ``batch`` is the name of a stream and the number of its batch, kept with the version in one step. A failure leaves the archive as it was."""
        return self._merged(self._document(doc, options), descriptor, renamed, validate, batch=batch, fold=fold)

    def upsert(self, doc, descriptor: SnapshotDescriptor | None = None, batch: tuple[str, int] | None = None, **options) -> Snapshot:
        """Make a version from the last one and a few rows. Of given rows of equal key the last counts; it takes the place of the rows of that key (that of the first, if there are more), or comes after all others. Without a key all given rows are new. Only files of the buckets that the given keys and rows fall into are read, and no other row is moved or written."""
        if self.is_empty():
            return self.commit(doc, descriptor, batch=batch, fold=True, **options)
        document = self._document(doc, options)
        last = self.snapshots().last_snapshot().version
        given = [c.name if isinstance(c, Column) else str(c) for c in document.columns]
        columns, kinds = self.schema().at_version(last), self.schema().kinds_at(last)
        lacking = [c for c in columns if str(c) not in given]
        order = [*[(c, f"v_{given.index(str(c))}") for c in columns if str(c) in given], *[(c, None) for c in lacking], *[(c, f"v_{i}") for i, c in enumerate(given) if c not in {str(x) for x in columns}]]
        order.sort(key=lambda x: columns.index(x[0]) if x[0] in columns else len(columns))
        values = [(F.col(v) if v else F.lit(None).cast(kinds[c.colid])).alias(f"v_{i}") for i, (c, v) in enumerate(order)]
        rest = [c for c in document.df.columns if not c.startswith("v_") and (c != "__idx" or self.primary_key)]
        return self._merged(Document(document.df.select(*rest, *values), [c for c, _ in order], document.order), descriptor, partial=True, batch=batch)

    def _merged(self, document: Document, descriptor: SnapshotDescriptor | None, renamed: dict[str, str] | None = None, validate: bool = False, partial: bool = False, batch: tuple[str, int] | None = None, fold: bool = False) -> Snapshot:
        m = self.store.manifest
        version = m.snapshots.next_version()
        m.snapshots.append(version, descriptor)  # fails here, before anything is written
        last = m.snapshots.last_snapshot()
        schema, ids = m.schema.merge(document.columns, version, last.version if last else None, renamed, document.kinds)
        if m.primary_key and not set(m.primary_key) <= set(ids):
            raise ValueError("the document lacks a key column")
        data = self.store.new_data()
        with self.store.passing_shuffles():
            rows, cells, by_key = self._keyed(document, ids, data, partial)
            if validate and m.primary_key:
                self._in_order(rows)
            if fold and m.primary_key and not partial:
                rows, by_key = last_of_key(rows, cells), False  # folded rows leave gaps
            keyed = bool(m.primary_key)
            incoming = upserted(self.store, rows, cells, keyed, data) if partial else matched(self.store, rows, cells, keyed, data, by_key)
            incoming.kinds, incoming.batches = dict(zip(ids, document.kinds)), dict([batch] if batch else [])
            after = advance(self.store, data, schema, incoming, descriptor, partial)
        self.store.publish(after)
        self._tidy(data)
        return self.snapshots().last_snapshot()

    def _tidy(self, data: str) -> None:
        """Delete the steps of a commit that no table reads any more."""
        for name in self.store.files.names(f"{self.store.path}/{data}"):
            if name not in ("segments", "positions", "keys", "segments-settled", "positions-settled", "keys-settled"):
                self.store.files.delete(f"{self.store.path}/{data}/{name}")

    def _keyed(self, document: Document, ids: list[int], data: str, partial: bool) -> tuple[DataFrame, list[str], bool]:
        """Rows with ``__key``, ``__pos`` and cells under their physical names, written if they are needed more than once; and whether positions count them in key order, rows without a key last."""
        df, pk = document.df, self.primary_key
        if pk:
            parts = [(F.col(f"v_{ids.index(c)}"), df.schema[f"v_{ids.index(c)}"].dataType) for c in pk]
            key = key_of(parts)
        elif "__idx" in df.columns:
            kind = df.schema["__idx"].dataType
            key = F.when(F.col("__idx").isNotNull(), key_of([(F.col("__idx"), kind)]))
        else:
            key = None
        sorted_by_key = key is not None and not document.has_positions and not document.order  # else the key is made after the rows were sorted, and not moved with them
        df = df.withColumn("__key", key) if sorted_by_key else df
        by_key = not document.has_positions and (key is None or not document.order)
        if not document.has_positions:
            order = document.order or ([F.col("__key")] if pk else [F.col("__key").asc_nulls_last()] if key is not None else [])
            values = [F.col(f"v_{i}") for i in range(len(ids)) if not isinstance(df.schema[f"v_{i}"].dataType, (T.MapType, T.VariantType))]
            order = [*order, *values] if order else []  # ties by the values, so that equal input has equal positions
            df, _ = ranked(df, order, f"{self.store.path}/{data}/document", "__pos", without=[c for c in df.columns if c.startswith("__o_")])
        if key is not None:
            df = df if sorted_by_key else df.withColumn("__key", key)
        else:
            df = df.withColumn("__key", key_of([(F.col("__pos"), T.LongType())]))
        names = [cell_name(c, k) for c, k in zip(ids, document.kinds)]
        cells = [stored(F.col(f"v_{i}"), k).alias(n) for i, (n, k) in enumerate(zip(names, document.kinds))]
        out = df.select("__key", F.col("__pos").cast("bigint").alias("__pos"), *cells)
        if document.has_positions and not partial:
            out = step(out, f"{self.store.path}/{data}/document")
        return out, names, by_key

    @staticmethod
    def _in_order(rows: DataFrame) -> None:
        """Raise ValueError if a key is less than the one before it. Neighbours are compared within ranges of positions, and their ends with each other."""
        by = rows.select("__key", "__pos").repartitionByRange("__pos").sortWithinPartitions("__pos").withColumn("__part", F.spark_partition_id())
        order = Window.partitionBy("__part").orderBy("__pos")
        ends = by.withColumn("__last", F.lag("__key").over(order)).groupBy("__part").agg(
            F.coalesce(F.max(F.col("__key") < F.col("__last")), F.lit(False)).alias("bad"), F.min_by("__key", "__pos").alias("first"), F.max_by("__key", "__pos").alias("last"), F.min("__pos").alias("at")
        ).orderBy("at").collect()
        order_of = lambda key: [(p["kind"], p["num"], p["whole"], p["str"]) for p in key]
        if any(e["bad"] for e in ends) or any(order_of(b["first"]) < order_of(a["last"]) for a, b in zip(ends, ends[1:])):
            raise ValueError("the document is not in key order")

    def apply(self, operators, origin: int | None = None) -> list[Snapshot]:
        """Make one version from each operator in a row, the first from ``origin`` (the last version by default). Rows keep their identity and position; what an operator drops the later ones don't see."""
        operators = [as_operator(o) for o in (operators if isinstance(operators, (list, tuple)) else [operators])]
        origin = self._existing(origin)
        def snapshot(version: int) -> tuple[DataFrame, list]:
            rows, columns = read.rows_at(self.store, version, labels=True)
            return rows.select(F.col("rowid").alias("__rowid"), F.col("label").alias("__pos"), *[F.col(f"v_{i}").alias(str(c)) for i, c in enumerate(columns)]), columns

        current, before = snapshot(origin)
        out, manifest = [], self.store.manifest
        try:
            for op in operators:
                version = self.snapshots().next_version()
                result = op.transform(current)
                names = [c for c in result.columns if c not in ("__rowid", "__pos")]
                wanted = list(op.columns) if op.columns is not None and len(op.columns) == len(names) else names
                by_name = {str(c): c for c in before}
                fixed = [c if isinstance(c, Column) else Column(c, by_name[c].colid) if c in by_name else c for c in wanted]
                renames = getattr(op, "rename", {})
                for old, new in renames.items():
                    if old in by_name and new in names and new not in by_name:
                        fixed[names.index(new)] = Column(new, by_name[old].colid)
                kinds = [result.schema[n].dataType.simpleString() for n in names]
                schema, ids = self.schema().merge(fixed, version, None, None, kinds)
                cells = [stored(F.col(f"`{n}`"), k).alias(cell_name(c, k)) for n, c, k in zip(names, ids, kinds)]
                data = self.store.new_data()
                incoming = Incoming(result.select(F.col("__rowid").alias("rowid"), "__pos", *cells), dict(zip(ids, kinds)), labels=True, frame=self.store.manifest.frame(origin))
                self.store.manifest = advance(self.store, data, schema, incoming, op.descriptor())
                out.append(self.snapshots().last_snapshot())
                self._tidy(data)
                origin, (current, before) = version, snapshot(version)  # the next operator reads what this one wrote, not its plan
            after, self.store.manifest = self.store.manifest, manifest
            self.store.publish(after)
        except BaseException:
            self.store.manifest = manifest
            raise
        return out

    def restore(self, version: int, descriptor: SnapshotDescriptor | None = None) -> Snapshot:
        """Make a version once more, as the next one: its rows with their identity, positions and values. What came between stays in the history."""
        d = descriptor or SnapshotDescriptor(f"version {version} restored")
        return self.apply(Transform(lambda df: df, description=d.description, action=d.action, valid_time=d.valid_time), origin=self._existing(version))[0]

    def rollback(self, version: int) -> None:
        """Forget everything after ``version``: the manifest says so, no data is read or written. Row and column identifiers aren't used again."""
        self._existing(version)
        m = self.store.manifest
        frames = {v: f for v, f in m.frames.items() if v <= version}
        # digests that live again may hold cells of any column
        self.store.publish(m.replaced(schema=m.schema.rollback(version), snapshots=m.snapshots.rollback(version), paths=m.cut(version), frames=frames, digested=tuple(sorted(m.cells))))

    # reading

    def _existing(self, version: int | None) -> int:
        if self.is_empty():
            raise ValueError("the archive has no snapshot")
        version = self.snapshots().last_snapshot().version if version is None else version
        if not self.snapshots().has_version(version):
            raise ValueError(f"unknown version {version}")
        return version

    def checkout(self, version: int | None = None, order: str | None = None, row_id: bool = False, position: bool = False) -> DataFrame:
        """The table at a version, lazily, with each column's identifier in its metadata. ``order`` is position, key or None; ``row_id`` adds ``__index`` (row index, or row id where there is a key), ``position`` adds ``__pos``."""
        version = self._existing(version)
        index = row_id and not self.primary_key
        rows, columns = read.rows_at(self.store, version, position, index or order == "key", labels=order == "position")
        if order == "position":
            rows = rows.orderBy("label")
        elif order == "key":
            rows = rows.orderBy("key", "rowid")
        out = [F.col(f"v_{i}").alias(str(c), metadata={"colid": c.colid, "colidx": c.colidx}) for i, c in enumerate(columns)]
        if row_id:
            out.insert(0, (read.index_of(F.col("key")) if index else F.col("rowid")).alias("__index"))
        if position:
            out.insert(0, F.col("pos").alias("__pos"))
        return rows.select(*out)

    def open(self, version: int | None = None) -> DataFrame:
        """The rows of a version in key order, with ``__rowid``; may be read any number of times."""
        rows, columns = read.rows_at(self.store, self._existing(version), keys=True)
        return rows.orderBy("key", "rowid").select(F.col("rowid").alias("__rowid"), *[F.col(f"v_{i}").alias(str(c)) for i, c in enumerate(columns)])

    def document(self, version: int | None = None) -> Document:
        """A version as a document with its positions and row indexes, for the sinks."""
        rows, columns = read.rows_at(self.store, self._existing(version), positions=True, keys=True)
        index = F.col("rowid") if self.primary_key else read.index_of(F.col("key"))
        return Document(rows.select(F.col("pos").alias("__pos"), index.alias("__idx"), *[f"v_{i}" for i in range(len(columns))]), columns)

    def at_time(self, when) -> DataFrame | None:
        """The table as it was valid at a time; None before the first snapshot."""
        snapshot = self.snapshots().at_time(when)
        return None if snapshot is None else self.checkout(snapshot.version)

    def diff(self, original: int, new: int, positions: bool = True) -> SnapshotDiff:
        """What changed from one version to another; an unknown version is empty."""
        return SnapshotDiff(compare.row_changes(self.store, original, new, positions), self.schema().diff(original, new))

    def rows(self) -> DataFrame:
        """The nested view of all rows: keys, versions, positions, and each cell's values with their versions."""
        return read.nested_rows(self.store)

    def lifetimes(self) -> DataFrame:
        return read.lifetimes(self.store)

    def cell_history(self, column) -> DataFrame:
        """Runs of versions of the values of one column, given by Column, identifier, or name in the last version that has it."""
        if isinstance(column, Column):
            colid = column.colid
        elif isinstance(column, int):
            colid = column
        else:
            found = [(s.last, c.colid) for c in self.schema().columns.values() for s in c.spells if s.name == column]
            if not found:
                raise ValueError(f"unknown column {column}")
            colid = max(found)[1]
        return read.cell_history(self.store, colid)

    def keys(self) -> DataFrame:
        """``rowid, key, occ`` of every row that has ever been there."""
        return self.store.keys().select("rowid", "key", "occ")

    def register(self, name: str, versions: Iterable[int] | None = None) -> None:
        """Temporary views ``name_vN`` of versions, and ``name`` of the last, for SQL."""
        for v in versions if versions is not None else [s.version for s in self.snapshots()]:
            self.checkout(v).createOrReplaceTempView(f"{name}_v{v}")
        self.checkout().createOrReplaceTempView(name)

    def vacuum(self) -> list[str]:
        """Delete files that no current table needs."""
        return self.store.vacuum()


def sort_keys(values: list) -> list:
    """Values in the order of keys."""
    return sorted(values, key=python_order)
