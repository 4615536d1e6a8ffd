"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def small_batches(spark: SparkSession, rows: int = 512, size: int = 8 << 20) -> None:
    """Send rows to Python by ``rows`` and about ``size`` bytes rather than Spark's 10,000 and 64 MB, unless the session says otherwise: whole texts are large, and both sides hold a batch."""
    for name, default, own in (("maxRecordsPerBatch", "10000", rows), ("maxBytesPerBatch", "67108864b", size)):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name) == default:
            spark.conf.set(name, str(own))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in a local session for which none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="spark-")
    return own


def shared_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint: a later read never recomputes what stands above, and survives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all values of a text column."""
    return df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def parts_for(spark: SparkSession, size: int, each: int = 64 << 20) -> int:
    """Number of ranges for ``size`` bytes: ``each`` in one, but as many as the session has shuffle partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def by_bytes(texts: list[str], most_texts: int = 256, most: int = 1 << 20):
    """(begin, end) of runs of texts with at most so many characters, or of one text."""
    a = size = 0
    for k, text in enumerate(texts):
        if k > a and (size + len(text) > most or k - a == most_texts):
            yield a, k
            a, size = k, 0
        size += len(text)
    if a < len(texts):
        yield a, len(texts)


def key_bounds(df: DataFrame, key: str, parts: int) -> list:
    """At most ``parts`` values of ``key``, each in the table, that deal its rows evenly into ranges; ascending, the smallest value first."""
    probs = [i / parts for i in range(parts)]
    row = df.where(F.col(key).isNotNull()).agg(
        F.min(key).alias("least"), F.percentile_approx(key, probs, max(10_000, 20 * parts)).alias("cuts")
    ).first()
    return sorted({row["least"], *(row["cuts"] or [])}) if row["least"] is not None else []


def range_of(key: str, bounds: list) -> tuple[F.Column, F.Column]:
    """Number of the range that a row's key falls into, found by bisection, and whether the key is its bound; rows without a key fall into the first and open none."""
    if not bounds:
        return F.lit(0), F.lit(False)
    sorted_bounds = np.array(bounds, np.int64)

    def place(keys: pa.Array) -> pa.Array:
        own = keys.fill_null(bounds[0]).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.maximum(np.searchsorted(sorted_bounds, own, "right") - 1, 0)
        return pa.array(2 * at + (sorted_bounds[at] == own), pa.int64())

    found = F.arrow_udf(place, "long")(F.col(key))
    return F.shiftright(found, 1).cast("int"), F.col(key).isNotNull() & (found % 2 == 1)


def with_fields(schema: T.StructType, **kinds: str) -> T.StructType:
    """The schema with further fields at its end; the given one stays as it is."""
    more = T.StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in kinds.items()))
    return T.StructType([*schema.fields, *more.fields])
