"""Differences between two versions.

A segment that covers both versions is unchanged, so only segments that cover
one of them are joined (all of them if the two versions have other columns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.cells import as_text, family, value_at
from palimpsest.plans.read import positions_at, whole
from palimpsest.store import Store

CELLS = "array<struct<colid int, old string, new string>>"


def _side(store: Store, version: int, other: int | None, names: dict) -> DataFrame:
    df = whole(store, "segments").where((F.col("from_version") <= version) & (F.col("to_version") >= version))
    if other is not None:
        df = df.where((F.col("from_version") > other) | (F.col("to_version") < other))
    return df.select(*[c.alias(n) for n, c in names.items()])


def row_changes(store: Store, before: int, after: int, positions: bool = True) -> DataFrame:
    """``rowid, key, op, cells, old_pos, new_pos`` of every row that differs.

    ``op`` is INSERT, DELETE or UPDATE; ``cells`` holds the changed values as
    text; the positions are set where the row moved. A version that the archive
    doesn't have is empty. Without ``positions`` moves aren't looked for.
    """
    m = store.manifest
    kinds_a, kinds_b = m.schema.kinds_at(before), m.schema.kinds_at(after)
    only = before if kinds_a == kinds_b else None, after if kinds_a == kinds_b else None
    both_ids = sorted({*kinds_a, *kinds_b})
    a = {"a_rowid": F.col("rowid")} | {f"a_{c}": value_at(c, kinds_a[c], m.cells) for c in both_ids if c in kinds_a}
    b = {"b_rowid": F.col("rowid")} | {f"b_{c}": value_at(c, kinds_b[c], m.cells) for c in both_ids if c in kinds_b}
    joined = _side(store, before, only[1], a).join(_side(store, after, only[0], b), F.col("a_rowid") == F.col("b_rowid"), "full_outer")
    changed = []
    for c in both_ids:
        old, new = F.col(f"a_{c}") if c in kinds_a else F.lit(None), F.col(f"b_{c}") if c in kinds_b else F.lit(None)
        old_text, new_text = as_text(old, kinds_a.get(c, "string")), as_text(new, kinds_b.get(c, "string"))
        if c in kinds_a and c in kinds_b:
            fa, fb = family(kinds_a[c])[0], family(kinds_b[c])[0]
            if fa == fb:
                same = old.eqNullSafe(new)
            elif {fa, fb} == {"long", "dbl"}:
                same = old.cast("double").eqNullSafe(new.cast("double"))
            else:
                same = old.isNull() & new.isNull()
        else:
            same = old.isNull() & new.isNull()
        changed.append(F.when(~same, F.array(F.struct(F.lit(c).alias("colid"), old_text.alias("old"), new_text.alias("new")))).otherwise(F.array().cast(CELLS)))
    cells = F.concat(*changed) if changed else F.array().cast(CELLS)
    op = F.when(F.col("a_rowid").isNull(), "INSERT").when(F.col("b_rowid").isNull(), "DELETE").otherwise("UPDATE")
    rows = joined.select(F.coalesce("a_rowid", "b_rowid").alias("rowid"), op.alias("op"), cells.alias("cells"))
    rows = rows.withColumn("cells", F.when(F.col("op") == "UPDATE", F.col("cells")).otherwise(F.array().cast(CELLS))).where((F.col("op") != "UPDATE") | (F.size("cells") > 0))
    if positions:
        was, now = positions_at(store, before).withColumnRenamed("pos", "old_pos"), positions_at(store, after).withColumnRenamed("pos", "new_pos")
        moved = was.join(store.unsent(now), "rowid").where("old_pos <> new_pos")
        rows = rows.join(moved, "rowid", "full_outer").select("rowid", F.coalesce("op", F.lit("UPDATE")).alias("op"), F.coalesce("cells", F.array().cast(CELLS)).alias("cells"), "old_pos", "new_pos")
    else:
        rows = rows.withColumns({"old_pos": F.lit(None).cast("bigint"), "new_pos": F.lit(None).cast("bigint")})
    return rows.join(store.unsent(store.keys().select("rowid", "key")), "rowid")


def described(changes: DataFrame) -> DataFrame:
    """One row of counts. A row that moved counts as moved, and its changed cells aren't counted as updated; ``all_updated`` and ``all_values`` count them too."""
    update, moved, n = F.col("op") == "UPDATE", F.col("new_pos").isNotNull(), F.size("cells")
    count = lambda c: F.count_if(c).cast("bigint")
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("bigint")
    return changes.agg(
        count(F.col("op") == "INSERT").alias("inserted"), count(F.col("op") == "DELETE").alias("deleted"), count(update & moved).alias("moved"),
        count(update & ~moved).alias("updated"), total(update & ~moved).alias("updated_values"), count(update & (n > 0)).alias("all_updated"), total(update).alias("all_values"),
    )


def described_schema(changes: list[dict]) -> dict[str, int]:
    """Counts of column changes; a column may be both moved and renamed."""
    update = [c for c in changes if c["op"] == "UPDATE"]
    return {
        "inserted": sum(c["op"] == "INSERT" for c in changes), "deleted": sum(c["op"] == "DELETE" for c in changes),
        "moved": sum(c["new_pos"] is not None for c in update), "renamed": sum(c["new_name"] is not None for c in update),
    }
