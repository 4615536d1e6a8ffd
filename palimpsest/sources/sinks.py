"""Writing documents as CSV, TSV and JSON lines."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from palimpsest.functions.columns import Column
from palimpsest.sources.documents import Document, delimiter_of, json_default


def write_csv(doc: Document, path: str, delim: str | None = None, header: bool = True, none_as: str = "", quotechar: str = '"', encoding: str = "UTF-8", gzip: bool = False) -> None:
    """A folder of CSV files in position order, each with the header."""
    out = doc.df.orderBy("__pos") if doc.has_positions else doc.df
    out = out.select(*[F.col(f"v_{i}").cast("string").alias(str(c)) for i, c in enumerate(doc.columns)])
    options = {"sep": delimiter_of(path, delim), "quote": quotechar, "escape": quotechar, "encoding": encoding, "nullValue": none_as, "emptyValue": "", "header": header}
    out.write.mode("overwrite").options(**options, **({"compression": "gzip"} if gzip else {})).csv(path)


def _json_cell(i: int, kind: str) -> F.Column:
    value = F.col(f"v_{i}")
    tag = {"date": "$date", "timestamp": "$datetime", "timestamp_ntz": "$datetime"}.get(kind)
    if tag:
        text = F.date_format(value, "yyyy-MM-dd") if kind == "date" else F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        inner = F.to_json(F.struct(text.alias(tag)))
    else:
        # a value by itself: the object's text without its name and braces
        inner = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'^\{"v":([\s\S]*)\}$', 1)
    return F.when(value.isNull(), F.lit("null")).otherwise(inner)


def write_json(doc: Document, path: str, gzip: bool = False) -> None:
    """A JSON-lines document of one folder: the columns first, then [position, row index, [values]] in position order."""
    spark = doc.df.sparkSession
    head = json.dumps([{"name": str(c), "id": c.colid, "index": c.colidx} if isinstance(c, Column) else c for c in doc.columns], default=json_default)
    index = F.regexp_extract(F.to_json(F.struct(F.col("__idx").alias("v"))), r'^\{"v":([\s\S]*)\}$', 1) if "__idx" in doc.df.columns else F.lit("")
    index = F.when(F.length(index) > 0, index).otherwise(F.lit("null"))
    cells = F.concat_ws(",", *[_json_cell(i, k) for i, k in enumerate(doc.kinds)]) if doc.columns else F.lit("")
    line = F.concat(F.lit("["), F.col("__pos").cast("string"), F.lit(","), index, F.lit(",["), cells, F.lit("]]"))
    rows = doc.df.select(F.col("__pos").alias("p"), line.alias("value"))
    top = spark.createDataFrame([(-1, head)], "p bigint, value string")
    top.union(rows).orderBy("p").select("value").write.mode("overwrite").options(**({"compression": "gzip"} if gzip else {})).text(path)
