"""Row operators that make new versions from a snapshot."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palimpsest.snapshots import SnapshotDescriptor


class DatasetOperator:
    """Makes a version's rows from an earlier one's: ``transform`` gets the named columns with ``__rowid`` and ``__pos`` (a number that orders the rows) and returns a DataFrame that keeps those two for the rows that stay."""

    def __init__(self, columns: list | None = None, description: str | None = None, action: dict | None = None, valid_time=None):
        self.columns, self.description, self.action, self.valid_time = columns, description, action, valid_time

    def descriptor(self) -> SnapshotDescriptor:
        return SnapshotDescriptor(self.description, self.valid_time, self.action)

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


class Expressions(DatasetOperator):
    """Columns by expressions, and a filter; nothing leaves the JVM. ``set`` replaces or adds columns, ``drop`` and ``rename`` do as they say."""

    def __init__(self, set: dict[str, SparkColumn | str] | None = None, where: SparkColumn | str | None = None, drop: list[str] | None = None, rename: dict[str, str] | None = None, **kwargs):
        super().__init__(**kwargs)
        self.set, self.where, self.drop, self.rename = set or {}, where, drop or [], rename or {}

    def transform(self, df: DataFrame) -> DataFrame:
        df = df.where(self.where) if self.where is not None else df
        df = df.withColumns({n: F.expr(e) if isinstance(e, str) else e for n, e in self.set.items()}) if self.set else df
        return df.drop(*self.drop).withColumnsRenamed(self.rename)


class Transform(DatasetOperator):
    """Any function of a DataFrame to a DataFrame."""

    def __init__(self, function: Callable[[DataFrame], DataFrame], **kwargs):
        super().__init__(**kwargs)
        self.function = function

    def transform(self, df: DataFrame) -> DataFrame:
        return self.function(df)


class RowFunction(DatasetOperator):
    """A Python function of (rowid, list of values) that returns the new values, or None to drop the row. ``kinds`` are the types of ``columns``."""

    def __init__(self, function: Callable, columns: list, kinds: list[str], **kwargs):
        super().__init__(columns=columns, **kwargs)
        self.function, self.kinds = function, kinds

    def transform(self, df: DataFrame) -> DataFrame:
        names = [c for c in df.columns if c not in ("__rowid", "__pos")]
        out = T.StructType.fromDDL("__rowid bigint, __pos bigint, " + ", ".join(f"`{c}` {k}" for c, k in zip(self.columns, self.kinds)))
        function, kinds = self.function, to_arrow_schema(out)

        def apply(batches):
            for batch in batches:
                # lists of Python values: a null beside a whole number leaves it whole
                ids, places, *lists = (column.to_pylist() for column in batch.columns)
                rows = zip(*lists) if lists else ([] for _ in ids)
                kept = [(i, p, *new) for i, p, row in zip(ids, places, rows) if (new := function(i, list(row))) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in kept], field.type) for k, field in enumerate(kinds)], schema=kinds)

        return df.select("__rowid", "__pos", *names).mapInArrow(apply, out)


def as_operator(op) -> DatasetOperator:
    return op if isinstance(op, DatasetOperator) else Transform(op)


def action_text(action: dict | None) -> str | None:
    return json.dumps(action) if action is not None else None
