import pytest

from palimpsest.functions.columns import ArchiveSchema, Column, column_index, column_ref, document_schema, primary_key_ids, select_clause, to_schema
from palimpsest.functions.versions import Versions


def test_versions_hold_runs():
    v = Versions.of(0, (4, 6), (10, 13), 20)
    assert [x for x in range(25) if v.contains(x)] == [0, 4, 5, 6, 10, 11, 12, 13, 20]
    assert v.last_version() == 20 and not v.is_empty() and Versions().last_version() is None
    assert str(Versions.of(1, (3, 4))) == "[1, 3-4]"


def test_versions_append():
    assert Versions.of(1).append(2).runs == ((1, 2),)
    assert Versions.of(1).append(3).runs == ((1, 1), (3, 3))
    with pytest.raises(ValueError):
        Versions.of((1, 3)).append(3)
    with pytest.raises(ValueError):
        Versions.of((3, 1))


@pytest.mark.parametrize("version", range(0, 18))
def test_versions_rollback(version):
    v = Versions.of(1, (4, 8), (10, 11), 15)
    back = v.rollback(version)
    assert [x for x in range(20) if back.contains(x)] == [x for x in range(version + 1) if v.contains(x)]


def test_schema_merge_by_name_and_id():
    one, ids = ArchiveSchema().merge(["Vessel", "Draught", "Tonnage"], 0, None)
    assert ids == [0, 1, 2]
    two, ids = one.merge(["Vessel", Column("Opened", 1), "Harbour", "Tonnage"], 1, 0)
    assert ids == [0, 1, 3, 2]
    three, ids = two.merge(["Opened", "Vessel", "Harbour", "Flag"], 2, 1)
    assert ids == [1, 0, 3, 4]
    assert [(str(c), c.colid) for c in three.at_version(2)] == [("Opened", 1), ("Vessel", 0), ("Harbour", 3), ("Flag", 4)]
    assert three.at_version(9) == []
    assert [str(c) for c in three.rollback(0).at_version(0)] == ["Vessel", "Draught", "Tonnage"]
    assert set(three.rollback(0).columns) == {0, 1, 2}


def test_dropped_name_gets_a_new_identifier():
    s, _ = ArchiveSchema().merge(["A", "B"], 0, None)
    s, _ = s.merge(["A"], 1, 0)
    s, ids = s.merge(["A", "B"], 2, 1)
    assert ids == [0, 2]


def test_renamed_and_ambiguous():
    s, _ = ArchiveSchema().merge(["Vessel", "Depth"], 0, None)
    s, ids = s.merge(["Vessel", "Fathoms"], 1, 0, {"Depth": "Fathoms"})
    assert ids == [0, 1] and s.diff(0, 1) == [{"colid": 1, "op": "UPDATE", "old_name": "Depth", "new_name": "Fathoms", "old_pos": None, "new_pos": None}]
    twice, _ = ArchiveSchema().merge([Column("A", 0), Column("A", 1)], 0, None)
    with pytest.raises(ValueError, match="unique"):
        twice.merge(["A"], 1, 0)
    with pytest.raises(ValueError, match="multiple"):
        s.merge([Column("Vessel", 0), "Vessel"], 2, 0)


def test_document_schema_and_references():
    with pytest.raises(ValueError):
        document_schema(["A", "A"])
    with pytest.raises(ValueError):
        document_schema([Column("A", 1), Column("B", 1)])
    with pytest.raises(ValueError):
        to_schema(["A", Column("B", 0)])
    schema = to_schema(["Vessel", "A", "A"])
    assert column_ref(schema, 2) == ("A", 2) and column_ref(schema, "A") == ("A", 1) and column_ref(schema, schema[2]) == ("A", 2)
    assert column_index(schema, ["A", 0]) == [1, 0] and select_clause(schema, "Vessel") == (["Vessel"], [0])
    for bad in (3, -1, "B", Column("A", 0, 7), True):
        with pytest.raises(ValueError):
            column_ref(schema, bad)


def test_primary_key():
    assert primary_key_ids(["Vessel", "Draught"], ["Draught"]) == [1] and primary_key_ids(["Vessel"], None) is None
    assert primary_key_ids([Column("A", 5), Column("A", 7)], [Column("A", 7)]) == [7]
    with pytest.raises(ValueError, match="Unknown|unknown"):
        primary_key_ids(["Vessel"], "Hull")
    with pytest.raises(ValueError, match="ambiguous"):
        primary_key_ids([Column("A", 5), Column("A", 7)], "A")


def test_key_order(spark):
    from pyspark.sql import functions as F

    from palimpsest.functions.keys import key_of
    from palimpsest.operators.archive import sort_keys

    assert sort_keys([None, 1, 1.2, "a", "b", 2]) == [1, 1.2, 2, "a", "b", None]
    numbers = spark.sql("SELECT * FROM VALUES (0, 1.0D), (1, 1.2D), (2, CAST(NULL AS DOUBLE)), (3, double('NaN')), (4, -3.5D) t(i, v)")
    texts = spark.sql("SELECT * FROM VALUES (5, 'a'), (6, '1') t(i, v)")
    whole = spark.sql("SELECT * FROM VALUES (7, 1L), (8, 9007199254740993L), (9, 9007199254740992L) t(i, v)")
    keys = None
    for df in (numbers, texts, whole):
        k = df.select("i", key_of([(F.col("v"), df.schema["v"].dataType)]).alias("key"))
        keys = k if keys is None else keys.union(k)
    order = [r.i for r in keys.orderBy("key", "i").collect()]
    assert order == [4, 0, 7, 1, 9, 8, 6, 5, 2, 3]
    same = keys.alias("a").join(keys.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.i") < F.col("b.i"))).select("a.i", "b.i").collect()
    assert sorted(map(tuple, same)) == [(0, 7), (2, 3)]
