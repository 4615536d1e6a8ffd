"""Physical cell columns: one for each column identifier and family of types, so that a change of type rewrites nothing."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FAMILIES = [
    (T.IntegralType, "long", "bigint"), ((T.FloatType, T.DoubleType), "dbl", "double"), ((T.StringType, T.CharType, T.VarcharType), "str", "string"),
    (T.BooleanType, "bool", "boolean"), (T.DateType, "date", "date"), (T.TimestampType, "ts", "timestamp"), (T.TimestampNTZType, "tsn", "timestamp_ntz"), (T.BinaryType, "bin", "binary"),
]


def kind_of(kind: str) -> T.DataType:
    return T.StructType.fromDDL(f"x {kind}")[0].dataType


def family(kind: str) -> tuple[str, str]:
    """(family, stored type) of a column type."""
    data = kind_of(kind)
    for types, name, stored in _FAMILIES:
        if isinstance(data, types):
            return name, stored
    if isinstance(data, T.NullType):
        return "str", "string"
    return "x" + hashlib.sha1(data.simpleString().encode()).hexdigest()[:8], data.simpleString()


def cell_name(colid: int, kind: str) -> str:
    return f"c_{colid}_{family(kind)[0]}"


def families_of(colid: int, cells: dict[str, str]) -> list[str]:
    return [c for c in cells if c.rsplit("_", 1)[0] == f"c_{colid}"]


def stored(column: Column, kind: str) -> Column:
    """A value as it is kept: whole numbers as bigint, fractions as double with NaN as null."""
    name, as_kind = family(kind)
    out = column.cast(as_kind)
    return F.when(~F.isnan(out), out) if name == "dbl" else out


def value_at(colid: int, kind: str, cells: dict[str, str], prefix: str = "") -> Column:
    """The cell as a column of type ``kind``; numbers are found whichever way they were kept."""
    own = cell_name(colid, kind)
    names = [own]
    if own.endswith(("_long", "_dbl")):
        names += [n for n in (f"c_{colid}_long", f"c_{colid}_dbl") if n != own]
    found = [F.col(prefix + n) for n in names if n in cells]
    if not found:
        return F.lit(None).cast(kind)
    return F.coalesce(*[c.cast(kind) for c in found]) if len(found) > 1 else found[0].cast(kind)


def same_cell(colid: int, kind: str, cells: dict[str, str], old: str, new: str) -> Column:
    """Whether the kept cell (prefix ``old``) equals the new one (prefix ``new``), null to null, 1 to 1.0, and never across families."""
    own = cell_name(colid, kind)
    others = [c for c in families_of(colid, cells) if c != own]
    numeric = [n for n in (f"c_{colid}_long", f"c_{colid}_dbl") if n in cells]
    new_value, old_value = F.col(new + own), F.col(old + own) if own in cells else F.lit(None).cast(family(kind)[1])
    if own in (f"c_{colid}_long", f"c_{colid}_dbl") and len(numeric) == 2:
        other = next(n for n in numeric if n != own)
        equal = F.when(F.col(old + other).isNotNull(), F.col(old + other).cast("double").eqNullSafe(new_value.cast("double"))).otherwise(old_value.eqNullSafe(new_value))
        rest = [c for c in others if c != other]
    else:
        equal, rest = old_value.eqNullSafe(new_value), others
    for c in rest:
        equal = equal & F.col(old + c).isNull()
    return equal


def as_text(value: Column, kind: str) -> Column:
    return F.to_json(F.struct(value.alias("v"))) if family(kind)[0].startswith("x") else value.cast("string")
