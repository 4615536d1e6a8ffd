"""Documents: tables with named columns, a position and a row index for each row.

A document holds a DataFrame with ``__pos`` (place in the document), ``__idx``
(row index, null for a new row) and the values as ``v_0``, ``v_1`` and so on, so
that column names may repeat.
"""

from __future__ import annotations

import csv
import json
import math
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, time
from itertools import islice

import pandas as pd
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.columns import Column, column_index


@dataclass
class Document:
    """``df`` without ``__pos`` takes its order from ``order`` (columns of ``df``)."""

    df: DataFrame
    columns: list
    order: list[SparkColumn] | None = None

    @property
    def kinds(self) -> list[str]:
        return [self.df.schema[f"v_{i}"].dataType.simpleString() for i in range(len(self.columns))]

    @property
    def has_positions(self) -> bool:
        return "__pos" in self.df.columns

    def sorted(self, keys) -> Document:
        """The rows ordered by columns (names, places or Columns), nulls last, ties by position; positions stay."""
        at = column_index(self.columns, keys)
        ties = [F.col("__pos")] if self.has_positions else list(self.order or [])
        return Document(self.df.orderBy(*[F.col(f"v_{i}").asc_nulls_last() for i in at], *ties), self.columns, self.order)

    def read_order(self) -> Document:
        """The rows ordered by index, new rows last."""
        return Document(self.df.orderBy(F.col("__idx").asc_nulls_last(), "__pos"), self.columns, self.order)

    def select(self, columns) -> Document:
        at = column_index(self.columns, columns)
        hidden = [c for c in self.df.columns if not c.startswith("v_")]
        return Document(self.df.select(*hidden, *[F.col(f"v_{i}").alias(f"v_{k}") for k, i in enumerate(at)]), [self.columns[i] for i in at], self.order)

    def iterrows(self) -> Iterator[tuple]:
        """(row index, values), partition by partition."""
        n = len(self.columns)
        for row in self.df.toLocalIterator():
            yield row["__idx"] if "__idx" in self.df.columns else None, [row[f"v_{i}"] for i in range(n)]

    def to_df(self) -> pd.DataFrame:
        """As a pandas frame of objects, with the row index."""
        rows = list(self.iterrows())
        return pd.DataFrame([v for _, v in rows], index=[i for i, _ in rows], columns=self.columns, dtype=object)

    def named(self) -> DataFrame:
        """The values under their names."""
        return self.df.select(*[F.col(f"v_{i}").alias(str(c)) for i, c in enumerate(self.columns)])


def empty_document(spark: SparkSession, columns: list) -> Document:
    """A document that only declares its columns."""
    fields = [T.StructField("__pos", T.LongType()), T.StructField("__idx", T.LongType()), *[T.StructField(f"v_{i}", T.StringType()) for i in range(len(columns))]]
    return Document(spark.createDataFrame([], T.StructType(fields)), list(columns))


def from_spark(df: DataFrame, order_by=None, row_index: str | SparkColumn | None = None, columns: list | None = None) -> Document:
    """A DataFrame as a document. A table has no order of its own, so ``order_by`` (names or expressions) gives it one; by default the key's, or else that of the row index or the files."""
    index = F.col(row_index) if isinstance(row_index, str) else row_index
    names = [c for c in df.columns if c != row_index]
    order = [F.col(c) if isinstance(c, str) else c for c in ([order_by] if isinstance(order_by, (str, SparkColumn)) else order_by or [])]
    extra = {f"__o_{k}": c for k, c in enumerate(order)}
    values = [_clean(F.col(f"`{c}`"), df.schema[c].dataType).alias(f"v_{i}") for i, c in enumerate(names)]
    out = df.select(*values, *([index.alias("__idx")] if index is not None else []), *[c.alias(n) for n, c in extra.items()])
    if index is not None:
        out = out.withColumn("__idx", _new_if_negative(out))
    return Document(out, columns or [_with_identity(df, c) for c in names], [F.col(n) for n in extra] or None)


def _with_identity(df: DataFrame, name: str):
    meta = df.schema[name].metadata or {}
    return Column(name, meta["colid"], meta.get("colidx")) if "colid" in meta else name


def _clean(value: SparkColumn, kind: T.DataType) -> SparkColumn:
    return F.when(~F.isnan(value), value) if isinstance(kind, (T.FloatType, T.DoubleType)) else value


def _new_if_negative(df: DataFrame) -> SparkColumn:
    index, kind = F.col("__idx"), df.schema["__idx"].dataType
    if isinstance(kind, T.NumericType):
        index = F.when((index >= 0) & (~F.isnan(index) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.lit(True)), index)
        return index.cast("bigint")
    return index


def nan_to_none(value):
    """None for a number that isn't one."""
    return None if isinstance(value, float) and math.isnan(value) else value


def _plain(value):
    value = nan_to_none(value.item() if hasattr(value, "item") and getattr(value, "ndim", 0) == 0 else value)
    if value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return value.tolist() if hasattr(value, "tolist") else value


def _kind(values: list) -> T.DataType:
    """The type of a list of Python values; of several kinds, tagged text."""
    kinds = {type(v) for v in values if v is not None}
    if not kinds:
        return T.StringType()
    if kinds == {bool}:
        return T.BooleanType()
    if kinds == {int} and all(-(2**63) <= v < 2**63 for v in values if v is not None):
        return T.LongType()
    if kinds <= {int, float}:
        return T.DoubleType()
    simple = {str: T.StringType(), datetime: T.TimestampNTZType(), date: T.DateType(), bytes: T.BinaryType()}
    if len(kinds) == 1 and (kind := kinds.pop()) in simple:
        aware = kind is datetime and any(v.tzinfo for v in values if v is not None)
        return T.TimestampType() if aware else simple[kind]
    return T.StructType([T.StructField("t", T.StringType()), T.StructField("v", T.StringType())])


_TAGS = {bool: "bool", int: "int", float: "float", str: "str", datetime: "datetime", date: "date", time: "time"}


def _tagged(value):
    if value is None:
        return None
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        value = int(value)  # 1 and 1.0 are equal
    tag = _TAGS.get(type(value), "json")
    text = value.isoformat() if isinstance(value, (datetime, date, time)) else json.dumps(value, default=str) if tag == "json" else str(value)
    return {"t": tag, "v": text}


def untagged(value):
    """A tagged value as Python has it."""
    if value is None:
        return None
    kind, text = value["t"], value["v"]
    read = {"bool": lambda s: s == "True", "int": int, "float": float, "str": str, "datetime": datetime.fromisoformat, "date": date.fromisoformat, "time": time.fromisoformat, "json": json.loads}
    return read[kind](text)


def from_rows(spark: SparkSession, columns: list, rows: list[tuple]) -> Document:
    """A document from (position, row index, values) triples in memory; a null or negative number as index is a new row."""
    lists = [[_plain(r[2][i]) if i < len(r[2]) else None for r in rows] for i in range(len(columns))]
    kinds = [_kind(v) for v in lists]
    lists = [[_tagged(x) for x in v] if isinstance(k, T.StructType) else [float(x) if isinstance(k, T.DoubleType) and x is not None else x for x in v] for v, k in zip(lists, kinds)]
    index = [_plain(r[1]) for r in rows]
    index = [list(i) if isinstance(i, tuple) else i for i in index]
    if any(isinstance(i, list) for i in index):
        index = [None if i is None or i == -1 else json.dumps(i if isinstance(i, list) else [i]) for i in index]
    index = [None if isinstance(i, (int, float)) and not isinstance(i, bool) and i < 0 else i for i in index]
    kind = _kind(index) if any(i is not None for i in index) else T.LongType()
    if isinstance(kind, T.StructType):
        raise ValueError("row indexes of several types")
    if isinstance(kind, T.DoubleType) and all(i is None or float(i).is_integer() for i in index):
        kind, index = T.LongType(), [None if i is None else int(i) for i in index]
    schema = T.StructType([T.StructField("__pos", T.LongType()), T.StructField("__idx", kind), *[T.StructField(f"v_{i}", k) for i, k in enumerate(kinds)]])
    data = [(int(r[0]), x, *[v[k] for v in lists]) for k, (r, x) in enumerate(zip(rows, index))]
    return Document(spark.createDataFrame(data, schema), list(columns))


def from_pandas(spark: SparkSession, df: pd.DataFrame) -> Document:
    """A pandas frame; its index gives the row index, its order the positions. Column types are kept; NaN is null."""
    columns = [c if isinstance(c, str) else str(c) for c in df.columns]
    values = [df.iloc[:, i].tolist() for i in range(df.shape[1])]
    return from_rows(spark, columns, [(k, idx, [v[k] for v in values]) for k, idx in enumerate(df.index.tolist())])


def _in_file_order(lines: DataFrame) -> DataFrame:
    """Lines (``__file``, ``__start`` and ``__nth`` of each) with ``__pos`` in the order of the files, without those that are a file's first line and its ``__head``. Rows aren't moved: only some numbers a split of the files are."""
    splits = lines.groupBy("__file", "__start").agg(F.min("__nth").alias("__first"), F.count("*").alias("__n"), F.min_by("__head", "__nth").alias("__headed"))
    lost = ((F.col("__start") == 0) & F.col("__headed")).cast("int")
    before = F.sum(F.col("__n") - lost).over(Window.orderBy("__file", "__start")) - F.col("__n") + lost  # one row a split
    placed = lines.join(splits.select("__file", "__start", (F.col("__first") + lost).alias("__first"), before.alias("__before")), ["__file", "__start"])
    return placed.where("__nth >= __first").withColumn("__pos", F.col("__before") + F.col("__nth") - F.col("__first")).drop("__file", "__start", "__nth", "__head", "__first", "__before")


def _broken_lines(spark: SparkSession, path: str, quote: str, encoding: str) -> bool:
    """Whether some quoted value of a CSV file goes over a line's end, for then the file can't be split."""
    if not quote:
        return False
    lines = spark.read.options(sep="\x01", quote="", encoding=encoding).schema("line string").csv(path)
    odd = F.pmod(F.length("line") - F.length(F.replace(F.col("line"), F.lit(quote), F.lit(""))), F.lit(2)) == 1
    return lines.where(odd).limit(1).count() > 0


def delimiter_of(path: str, delim: str | None = None) -> str:
    if delim is not None:
        return "\t" if delim.lower() in ("tab", "\\t") else delim
    base = path[:-3] if path.endswith(".gz") else path
    return "\t" if base.endswith(".tsv") else ","


def from_csv(
    spark: SparkSession, path: str, header: list | None = None, delim: str | None = None, quotechar: str = '"', encoding: str = "UTF-8", none_is: str | None = None, skip_lines: int = 0, compressed: bool | None = None, infer: bool = False, kinds: dict[str, str] | None = None, multiline: bool | None = None
) -> Document:
    """A CSV or TSV file, plain or gzip. The first line names the columns unless ``header`` does, and is left out wherever a file of a folder begins with it; values are strings unless ``infer`` or ``kinds`` (types by name, for columns whose values all have them); ``none_is`` is the text of a null; missing cells of short rows are null. The row index is the position. Files are read in splits unless values go over lines (``multiline``; found out if it isn't said)."""
    if compressed and not path.endswith(".gz"):
        raise ValueError("Spark tells gzip files by their extension .gz")
    multiline = _broken_lines(spark, path, quotechar, encoding) if multiline is None else multiline
    options = {"sep": delimiter_of(path, delim), "quote": quotechar, "escape": quotechar, "encoding": encoding, "multiLine": multiline, "nullValue": "\x00none", "emptyValue": ""}
    raw = spark.read.options(**options).option("mode", "PERMISSIVE")
    first = None
    if header is None:
        files = spark.read.text(path).inputFiles()  # of a folder the first one in order has it
        lines = spark.read.options(sep="\x01", quote="", encoding=encoding).csv(min(files)).limit(skip_lines + 50).collect() if files else []  # a header may have line breaks in quotes
        first = next(islice(csv.reader((f"{r[0]}\n" for r in lines), delimiter=options["sep"], quotechar=quotechar), skip_lines, None), None)
        if first is None:
            return empty_document(spark, [])
        header = first
    width = len(header)
    schema = T.StructType([*[T.StructField(f"_c{i}", T.StringType()) for i in range(width)], T.StructField("__bad", T.StringType())])
    body = raw.option("header", False).option("columnNameOfCorruptRecord", "__bad").schema(schema).csv(path)
    head = F.lit(first is not None and not skip_lines)  # then the first line of each file
    for i, name in enumerate(header if first is not None else ()):
        head = head & F.coalesce(F.col(f"_c{i}") == F.lit(name), F.lit(name == ""))
    place = [head.alias("__head"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__nth")]
    rows = _in_file_order(body.select(*[f"_c{i}" for i in range(width)], F.col("__bad").isNotNull().alias("__short"), *place))
    lead = skip_lines + (first is not None) if skip_lines else 0
    if lead:
        rows = rows.where(F.col("__pos") >= lead).withColumn("__pos", F.col("__pos") - lead)
    values = []
    for i in range(width):
        v = F.when(F.col("__short") & F.col(f"_c{i}").isNull(), None).otherwise(F.coalesce(f"_c{i}", F.lit("")))
        values.append((F.when(v == none_is, None).otherwise(v) if none_is is not None else v).alias(f"v_{i}"))
    out = rows.select("__pos", F.col("__pos").alias("__idx"), *values)
    given = [(kinds or {}).get(str(c)) for c in header]
    return Document(inferred(out, width, given) if infer or any(given) else out, list(header))


_GUESSES = ("bigint", "double", "boolean")


def inferred(df: DataFrame, width: int, given: list[str | None] = ()) -> DataFrame:
    """Text columns of the ``given`` type where every value that isn't empty has it, else as bigint, double or boolean where every one is."""
    tests, given = {}, list(given) or [None] * width
    for i in range(width):
        v = F.nullif(F.col(f"v_{i}"), F.lit(""))
        for kind in dict.fromkeys([given[i], *_GUESSES] if given[i] else _GUESSES):
            if kind == "string":
                continue
            ok = v.isNull() | v.try_cast(kind).isNotNull()
            if kind == "bigint":
                ok = v.isNull() | v.rlike(r"^[+-]?\d{1,18}$")
            tests[f"{kind}_{i}"] = F.coalesce(F.min(ok), F.lit(False)) & (F.count(v) > 0)
    found = df.agg(*[c.alias(n) for n, c in tests.items()]).first() if tests else {}
    picks = {}
    for i in range(width):
        if given[i] == "string":
            continue
        kind = next((k for k in ([given[i], *_GUESSES] if given[i] else _GUESSES) if found[f"{k}_{i}"]), None)
        if kind:
            picks[f"v_{i}"] = F.nullif(F.col(f"v_{i}"), F.lit("")).cast(kind)
    return df.withColumns(picks) if picks else df


def json_default(value):
    """Dates and times with their tags, and arrays, for JSON."""
    if isinstance(value, datetime):
        return {"$datetime": value.isoformat()}
    if isinstance(value, date):
        return {"$date": value.isoformat()}
    if isinstance(value, time):
        return {"$time": value.isoformat()}
    if hasattr(value, "tolist"):
        return value.tolist()
    raise TypeError(f"cannot write {type(value).__name__} as JSON")


def _first_line(lines: DataFrame) -> str | None:
    """The first line of the first file, by name, that has any; Spark's own first row is of the largest file."""
    for file in sorted(re.sub(":/+", ":/", f) for f in lines.inputFiles()):  # a scheme may be followed by one slash or by three
        begin = lines.where((F.regexp_replace("_metadata.file_path", ":/+", ":/") == file) & (F.col("_metadata.file_block_start") == 0))
        for row in begin.select("value").limit(1).collect():
            return row["value"]
    return None


def from_json(spark: SparkSession, path: str, kinds: dict[str, str] | None = None) -> Document:
    """A JSON-lines document: a line with the list of columns, then lines [position, row index, [values]].

    Each cell has its JSON type: a column whose values are of one kind is typed
    (whole numbers and fractions as double), one of several kinds, or of times of
    day, is tagged text. ``kinds`` says types by name. A missing file is an empty
    document.
    """
    try:
        lines = spark.read.text(path)
        head = _first_line(lines)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return empty_document(spark, [])
        raise
    if head is None:
        return empty_document(spark, [])
    columns = [Column(c["name"], c["id"], c.get("index")) if isinstance(c, dict) else c for c in json.loads(head)]
    rows = lines.where((F.col("value") != head) & (F.trim("value") != "")).select(F.parse_json("value").alias("r"))
    cells = [c.alias(f"v_{i}") for i in range(len(columns)) for c in [json_cell(F.variant_get("r", f"$[2][{i}]", "variant"))]]
    out = rows.select(F.variant_get("r", "$[0]", "bigint").alias("__pos"), json_cell(F.variant_get("r", "$[1]", "variant")).alias("__idx"), *cells)
    names = ["__idx", *[f"v_{i}" for i in range(len(columns))]]
    found = out.agg(*[F.sort_array(F.collect_set(f"{n}.t")).alias(n) for n in names]).first()  # a few kinds a column
    given = {f"v_{i}": (kinds or {}).get(str(c)) for i, c in enumerate(columns)}
    out = out.withColumns({n: json_typed(n, set(found[n]), given.get(n)) for n in names})
    kind = out.schema["__idx"].dataType
    if isinstance(kind, (T.LongType, T.DoubleType)):
        index = F.col("__idx").cast("bigint")
        out = out.withColumn("__idx", F.when(index >= 0, index))
    elif isinstance(kind, T.StructType):
        out = out.withColumn("__idx", F.col("__idx.v"))
    elif not found["__idx"]:
        out = out.withColumn("__idx", F.lit(None).cast("bigint"))
    return Document(out, columns)


def json_cell(cell: SparkColumn) -> SparkColumn:
    """A JSON value, given as a variant, as its kind and its text."""
    shape = F.schema_of_variant(cell)
    stamps = {tag: F.try_variant_get(cell, f"$['${tag}']", "string") for tag in ("datetime", "date", "time")}
    kind = F.when(shape.startswith("OBJECT"), F.coalesce(*[F.when(c.isNotNull(), tag) for tag, c in stamps.items()], F.lit("json")))
    kind = kind.when(shape.startswith("ARRAY"), "json").when(shape == "BIGINT", "int").when(shape == "BOOLEAN", "bool").when(shape == "STRING", "str")
    text = F.coalesce(*[F.when(shape.startswith("OBJECT"), c) for c in stamps.values()], F.variant_get(cell, "$", "string"))
    return F.when(cell.isNotNull() & (shape != "VOID"), F.struct(kind.otherwise("float").alias("t"), text.alias("v")))


_JSON_KINDS = {"int": "bigint", "float": "double", "bool": "boolean", "str": "string", "datetime": "timestamp_ntz", "date": "date"}


def json_typed(name: str, found: set[str], kind: str | None) -> SparkColumn:
    """The cells of a column as values of one type where they have one."""
    text = F.col(f"{name}.v")
    if kind:
        return text.cast(kind)
    if found == {"int", "float"}:
        return text.cast("double")
    if len(found) == 1 and (only := next(iter(found))) in _JSON_KINDS:
        zoned = only == "datetime"  # a time with an offset is an instant
        return F.coalesce(text.try_cast("timestamp_ntz"), text.cast("timestamp").cast("timestamp_ntz")) if zoned else text.cast(_JSON_KINDS[only])
    return text if not found else F.col(name)


def to_document(spark: SparkSession, doc, **options) -> Document:
    """Anything that a commit takes: a Document, a Spark or pandas DataFrame, or the path of a CSV, TSV or JSON-lines file."""
    if isinstance(doc, Document):
        return doc
    if isinstance(doc, pd.DataFrame):
        return from_pandas(spark, doc)
    if isinstance(doc, DataFrame):
        return from_spark(doc, **options)
    if isinstance(doc, (str, os.PathLike)):
        path = str(doc)
        is_json = path.removesuffix(".gz").endswith((".json", ".jsonl"))
        return from_json(spark, path, **options) if is_json else from_csv(spark, path, **options)
    raise ValueError(f"not a document: {type(doc).__name__}")
