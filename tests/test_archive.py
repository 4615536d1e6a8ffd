from datetime import datetime, timezone

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from palimpsest.functions.columns import Column
from palimpsest.operators.archive import Archive
from palimpsest.operators.dataset import Expressions, RowFunction
from palimpsest.snapshots import SnapshotDescriptor, SnapshotListing
from palimpsest.sources.documents import empty_document, from_rows, untagged


def frame(rows, index=None, columns=("Berth", "Draught")):
    return pd.DataFrame(rows, columns=list(columns), index=None if index is None else pd.Index(index, dtype=object))


FRAMES = [
    frame([["Nadia", 32], ["Oskar", 45], ["Petra", 27], ["Nadia", 23]]),
    frame([["Nadia", 32], ["Oskar", 44], ["Petra", 27], ["Quint", 23]], [0, 1, 2, 3]),
    frame([["Quint", 33], ["Petra", 27], ["Oskar", 44], ["Nadia", 32]], [3, 2, 1, 0]),
    frame([["Nadia", 32], ["Rosa", 25], ["Petra", 27], ["Oskar", 44]], [0, None, 2, 1]),
    frame([["Nadia", 32], ["Petra", 27], ["Oskar", 44]], [0, 2, 1]),
]


def values(df):
    return [list(r) for r in df.collect()]


@pytest.mark.parametrize("key", [["Berth", "Draught"], None])
@pytest.mark.parametrize("persistent", [True, False])
def test_commit_and_checkout(spark, tmp_path, key, persistent):
    path = str(tmp_path / "a") if persistent else None
    a = Archive.create(spark, path, FRAMES[0], key)
    for f in FRAMES[1:]:
        a.commit(f)
    if persistent:
        a = Archive.load(spark, path)
        left = {p.name for d in (tmp_path / "a" / "data").iterdir() for p in d.iterdir()}
        assert {"segments", "positions", "keys"} <= left <= {"segments", "positions", "keys", "segments-settled", "positions-settled"}
    for v, f in enumerate(FRAMES):
        got = values(a.checkout(v, order="position", row_id=True))
        assert [r[1:] for r in got] == f.values.tolist()
        if key is None:
            assert [r[0] for r in got] == [4 if i is None else i for i in f.index]
    if key:
        names = [(r.key[0]["str"], r.key[1]["whole"]) for r in a.keys().orderBy("key").collect()]
        assert names == [("Nadia", 23), ("Nadia", 32), ("Oskar", 44), ("Oskar", 45), ("Petra", 27), ("Quint", 23), ("Quint", 33), ("Rosa", 25)]
        assert [[r[0] for r in values(a.open(v))] for v in range(3)] == [[0, 1, 2, 3], [1, 4, 3, 5], [1, 4, 3, 6]]


def bytes_of(path):
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


def test_a_small_commit_writes_little(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id AS k", "sha2(CAST(id AS STRING), 256) AS v")
    a = Archive.create(spark, str(tmp_path / "a"), rows, ["k"])
    folders = lambda: {p.name: bytes_of(p) for p in (tmp_path / "a" / "data").iterdir()}
    first = folders()
    changed = rows.selectExpr("k", "CASE WHEN k % 2000 = 7 THEN 'new' ELSE v END AS v")
    a.commit(changed.where("k <> 19999"))
    a.upsert(spark.createDataFrame([(5, "five"), (70_000, "more")], "k long, v string"))
    for name, size in folders().items():
        assert name in first or size < 0.05 * sum(first.values())
    expected = {r.k: r.v for r in changed.where("k <> 19999").collect()}
    assert {r.k: r.v for r in a.checkout(1).collect()} == expected
    assert {r.k: r.v for r in a.checkout(2).collect()} == expected | {5: "five", 70_000: "more"}
    assert {r.k: r.v for r in a.checkout(0).collect()} == {r.k: r.v for r in rows.collect()}
    assert a.diff(0, 1).describe()["rows"]["all_updated"] == 10 and a.diff(1, 2, positions=False).describe()["rows"]["inserted"] == 1
    assert [r[0] for r in a.checkout(2, order="position").tail(1)] == [70_000]
    a.rollback(1)
    assert {r.k: r.v for r in a.checkout().collect()} == expected and a.lifetimes().where("to_version = 0").count() == 1


def test_settling_changes_nothing(spark, monkeypatch):
    from palimpsest.plans import merge

    seen = []
    for share in (0.0, 10.0):
        monkeypatch.setattr(merge, "ENDED_SHARE", share)
        a = Archive.create(spark, None, FRAMES[0], ["Berth", "Draught"])
        for f in FRAMES[1:]:
            a.commit(f)
        a.upsert(frame([["Oskar", 44], ["Zoe", 1]]))
        seen.append([[values(a.checkout(v, order="position", row_id=True)) for v in range(6)], values(a.lifetimes().orderBy("rowid", "from_version")), values(a.diff(1, 4).rows().orderBy("rowid").select("rowid", "op", "old_pos", "new_pos"))])
    assert seen[0] == seen[1] and seen[0][0][5][-1] == [8, "Zoe", 1]


def test_of_two_writers_one_succeeds(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "a")
    Archive.create(spark, path, FRAMES[0], ["Berth", "Draught"])
    handles = [Archive.load(spark, path) for _ in range(4)]

    def attempt(k):
        try:
            handles[k].commit(frame([["Nadia", 32], [f"w{k}", k]]))
            return k
        except RuntimeError:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = [k for k in pool.map(attempt, range(4)) if k is not None]
    last = Archive.load(spark, path)
    assert len(won) == 1 and len(last.snapshots()) == 2 and [f"w{won[0]}", won[0]] in values(last.checkout())
    assert all(last.store.files.create(f"{path}/x", "t") is wanted for wanted in (True, False))


def test_upserts_without_a_key_append(spark):
    a = Archive.create(spark, None, frame([["a", 1]]))
    a.upsert(frame([["b", 2], ["c", 3]]))
    a.upsert(spark.createDataFrame([("d", 4, True)], "Berth string, Draught long, More boolean"))
    assert values(a.checkout(order="position", row_id=True)) == [[0, "a", 1, None], [1, "b", 2, None], [2, "c", 3, None], [3, "d", 4, True]]


def test_exact_keys(spark):
    from decimal import Decimal

    near = [Decimal("9007199254740992"), Decimal("9007199254740993"), Decimal("0.1"), Decimal("0.1000000000000000000001"), Decimal("123456789012345678901234567.5")]
    rows = lambda v: spark.createDataFrame([(str(d), v) for d in near], "s string, v int")
    first, second = (rows(v).selectExpr("CAST(s AS decimal(38,0)) AS k", "v").where("k > 5") for v in (1, 2))
    a = Archive.create(spark, None, first, ["k"])
    a.commit(second)
    assert a.keys().count() == 3 and a.diff(0, 1).describe()["rows"]["all_updated"] == 3
    fine = rows(1).where("s < '0.2'").selectExpr("CAST(s AS decimal(38,30)) AS k", "v")
    b = Archive.create(spark, None, fine, ["k"])
    b.commit(spark.createDataFrame([(0.1, 5)], "k double, v int"))
    assert b.keys().count() == 2 and b.diff(0, 1).describe()["rows"]["deleted"] == 1


def test_instants_as_keys(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        rows = spark.range(2).selectExpr("timestamp_seconds(1699162200 + id * 3600) AS k", "id")  # half past one, twice
        a = Archive.create(spark, None, rows, ["k"])
        assert a.keys().count() == 2
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        a.commit(rows)
        assert a.keys().count() == 2 and a.diff(0, 1).rows().count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_row_functions_keep_whole_numbers(spark):
    big = 9007199254740993
    a = Archive.create(spark, None, spark.createDataFrame([(1, big), (2, None)], "k long, v long"), ["k"])
    a.apply(RowFunction(lambda rowid, r: r, ["k", "v"], ["bigint", "bigint"]))
    assert sorted(values(a.checkout())) == [[1, big], [2, None]]


def test_inferred_types_are_the_archives(spark, tmp_path):
    for name, text in (("a", "k,v,w\n1,x,1\n2,y,2\n"), ("b", "k,v,w\n1,x,1.5\n2,,2\n"), ("c", "k,v,w\n1,x,1\nA7,y,2\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    a = Archive.create(spark, None, str(tmp_path / "a.csv"), ["k"], infer=True)
    a.commit(str(tmp_path / "b.csv"), infer=True)
    assert a.diff(0, 1).describe()["rows"] | {"updated_values": 0, "all_values": 0} == {"inserted": 0, "deleted": 0, "moved": 0, "updated": 2, "updated_values": 0, "all_updated": 2, "all_values": 0}
    with pytest.raises(ValueError, match="key column k"):
        a.commit(str(tmp_path / "c.csv"), infer=True)
    assert len(a.snapshots()) == 2


DIFFS = [
    frame([["Nadia", 32], ["Oskar", 45], ["Petra", 27], ["Quint", 23]]),
    frame([[32, "Nadia", 180], [45, "Oskar", 175], [27, "Petra", 168], [23, "Quint", 181]], columns=("Draught", "Berth", "Depth")),
    frame([[180, 32, "Nadia"], [168, 27, "Petra"], [181, 24, "Quint"]], [0, 2, 3], columns=("Depth", "Draught", "Berth")),
    frame([[180, 32, "Nadia"], [169, 27, "Petra"], [181, 24, "Quint"]], [0, 2, 3], columns=("Size", "Draught", "Berth")),
]


def test_diff_counts(spark):
    a = Archive.create(spark, None, DIFFS[0])
    a.commit(DIFFS[1])
    a.commit(DIFFS[2])
    a.commit(DIFFS[3], renamed={"Depth": "Size"})
    expected = [(0, 1, (0, 1, 2), (0, 0, 4)), (1, 2, (0, 0, 3), (1, 0, 2)), (2, 3, (0, 0, 1), (0, 0, 1))]
    for old, new, columns, rows in expected:
        d = a.diff(old, new)
        ops = [c["op"] for c in d.schema()]
        assert tuple(ops.count(o) for o in ("DELETE", "INSERT", "UPDATE")) == columns
        assert (d.deletes().count(), d.inserts().count(), d.updates().count()) == rows
    assert a.diff(2, 3).describe()["schema"] == {"inserted": 0, "deleted": 0, "moved": 0, "renamed": 1}
    assert [tuple(r)[2:] for r in a.diff(2, 3).cells().collect()] == [(2, "168", "169")]
    assert a.diff(-1, 0).describe()["rows"]["inserted"] == 4 and a.diff(0, 99).describe()["rows"]["deleted"] == 4
    assert a.diff(1, 1).rows().count() == 0


def test_diff_of_moved_rows(spark):
    a = Archive.create(spark, None, frame([["A", 1], ["B", 2], ["C", 3]]), ["Berth"])
    a.commit(frame([["B", 2], ["C", 4]]))
    d = a.diff(0, 1)
    assert d.describe()["rows"] == {"inserted": 0, "deleted": 1, "moved": 2, "updated": 0, "updated_values": 0, "all_updated": 1, "all_values": 1}
    assert a.diff(0, 1, positions=False).describe()["rows"]["updated"] == 1


def test_rollback(spark, tmp_path):
    path = str(tmp_path / "a")
    frames = [FRAMES[0], frame([["Nadia", 32, 180], ["Oskar", 45, 170], ["Petra", 27, 160], ["Nadia", 23, 150]], columns=("Berth", "Draught", "Depth")), FRAMES[1]]
    a = Archive.create(spark, path, frames[0])
    for f in frames[1:]:
        a.commit(f)
    used = a.store.manifest.row_counter
    a.rollback(1)
    a = Archive.load(spark, path)
    assert len(a.snapshots()) == 2 and values(a.checkout(order="position")) == frames[1].values.tolist()
    a.rollback(0)
    assert list(a.schema().columns) == [0, 1] and values(a.checkout(order="position")) == FRAMES[0].values.tolist()
    assert a.store.manifest.row_counter == used
    with pytest.raises(ValueError):
        a.rollback(1)
    a.commit(FRAMES[1])
    assert values(a.checkout(1, order="position")) == FRAMES[1].values.tolist()
    before = values(a.checkout(0, order="position"))
    assert a.vacuum() and values(a.checkout(0, order="position")) == before


def test_apply(spark):
    a = Archive.create(spark, None, FRAMES[0])
    made = a.apply([
        Expressions(set={"Draught": "Draught + 1"}, description="older", action={"op": "inc"}),
        Expressions(where="Berth <> 'Oskar'", rename={"Berth": "Mooring"}),
        RowFunction(lambda i, r: [r[0].upper(), r[1], r[1] / 2] if r[1] > 24 else None, ["Mooring", "Draught", "Half"], ["string", "bigint", "double"]),
    ])
    assert [s.version for s in made] == [1, 2, 3] and made[0].action == {"op": "inc"} and made[0].description == "older"
    assert values(a.checkout(1, order="position")) == [["Nadia", 33], ["Oskar", 46], ["Petra", 28], ["Nadia", 24]]
    assert values(a.checkout(2, order="position", position=True)) == [[0, "Nadia", 33], [2, "Petra", 28], [3, "Nadia", 24]]
    assert values(a.checkout(3, order="position")) == [["NADIA", 33, 16.5], ["PETRA", 28, 14.0]]
    assert [c["new_name"] for c in a.schema().diff(1, 2)] == ["Mooring"]
    a.apply(Expressions(where="Draught < 30"), origin=0)
    assert values(a.checkout(order="position")) == [["Petra", 27], ["Nadia", 23]]
    assert [r.version for r in a.snapshots_df().collect()] == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        a.apply(Expressions(where="Draught < 30"), origin=9)


def test_restore(spark):
    a = Archive.create(spark, None, FRAMES[0], ["Berth", "Draught"], SnapshotDescriptor(valid_time=datetime(2024, 1, 1)))
    a.commit(FRAMES[2])
    before = values(a.checkout(0, order="position", row_id=True))
    assert a.restore(0).version == 2 and values(a.checkout(2, order="position", row_id=True)) == before
    assert a.diff(0, 2).rows().count() == 0 and values(a.checkout(1, order="position")) == FRAMES[2].values.tolist()


def test_failed_commit_and_apply_change_nothing(spark):
    a = Archive.create(spark, None, FRAMES[0], ["Berth"], SnapshotDescriptor(valid_time=datetime(2024, 5, 1)))
    with pytest.raises(ValueError):
        a.commit(FRAMES[1], SnapshotDescriptor(valid_time=datetime(2024, 4, 1)))
    with pytest.raises(ValueError, match="key"):
        a.commit(frame([[1]], columns=("Draught",)))
    with pytest.raises(Exception):
        a.apply([Expressions(set={"Draught": "Draught + 1"}), Expressions(where="no_such_column = 1")])
    assert len(a.snapshots()) == 1 and a.checkout().count() == 4


def test_null_and_duplicate_keys_and_revival(spark):
    one = frame([[None, 1], ["A", 2], ["A", 3], [None, 4]], columns=("K", "V"))
    a = Archive.create(spark, None, one, ["K"])
    a.commit(frame([["A", 2], [None, 9]], columns=("K", "V")))
    a.commit(one)
    rows = [values(a.checkout(v, order="position", row_id=True)) for v in range(3)]
    assert rows == [[[2, None, 1], [0, "A", 2], [1, "A", 3], [3, None, 4]], [[0, "A", 2], [2, None, 9]], [[2, None, 1], [0, "A", 2], [1, "A", 3], [3, None, 4]]]
    lives = sorted(map(tuple, a.lifetimes().collect()))
    assert lives == [(0, 0, 2), (1, 0, 0), (1, 2, 2), (2, 0, 2), (3, 0, 0), (3, 2, 2)]
    nested = {r.rowid: r for r in a.rows().collect()}
    assert {c["value"]: [tuple(v) for v in c["versions"]] for c in nested[2].cells} == {"1": [(0, 0), (2, 2)], "9": [(1, 1)]}
    assert sorted(map(tuple, a.cell_history("V").where("rowid = 2").collect())) == [(2, 1, 0, 0), (2, 1, 2, 2), (2, 9, 1, 1)]


def test_types_change_and_mix(spark):
    a = Archive.create(spark, None, frame([["A", 1], ["B", 2]], columns=("K", "V")), ["K"])
    a.commit(frame([["A", 1.0], ["B", 2.5]], columns=("K", "V")))
    a.commit(frame([["A", "1"], ["B", None]], columns=("K", "V")))
    assert values(a.checkout(0, order="key")) == [["A", 1], ["B", 2]] and a.checkout(0).schema["V"].dataType.simpleString() == "bigint"
    assert values(a.checkout(1, order="key")) == [["A", 1.0], ["B", 2.5]] and values(a.checkout(2, order="key")) == [["A", "1"], ["B", None]]
    assert [a.diff(v, v + 1).updates().count() for v in range(2)] == [1, 2]
    mixed = Archive.create(spark, None, frame([["A", 1], [2, 2.5], ["C", "x"]]))
    got = values(mixed.checkout(order="position"))
    assert [[untagged(x) for x in r] for r in got] == [["A", 1], [2, 2.5], ["C", "x"]]


def test_columns_keep_identity(spark):
    a = Archive.create(spark, None, FRAMES[0])
    out = a.checkout(0)
    assert [f.metadata for f in out.schema] == [{"colid": 0, "colidx": 0}, {"colid": 1, "colidx": 1}]
    a.commit(out.withColumnRenamed("Draught", "Years"), row_index=None, order_by="Berth")
    assert [(str(c), c.colid) for c in a.schema().at_version(1)] == [("Berth", 0), ("Years", 1)]
    twice = from_rows(spark, [Column("A", 0), Column("A", 1)], [(0, 0, [1, 2])])
    assert values(Archive.create(spark, None, twice).checkout()) == [[1, 2]]


def test_empty_documents_and_archives(spark):
    a = Archive.create(spark)
    for call in (a.checkout, a.open, lambda: a.apply([]), lambda: a.rollback(0)):
        with pytest.raises(ValueError):
            call()
    a.commit(empty_document(spark, ["A"]))
    assert a.checkout().columns == ["A"] and a.checkout().count() == 0
    a.commit(frame([["x"]], columns=("A",)))
    a.commit(empty_document(spark, ["A"]))
    assert [a.checkout(v).count() for v in range(3)] == [0, 1, 0]
    with pytest.raises(ValueError):
        Archive.create(spark, None, None, ["A"])
    with pytest.raises(ValueError):
        a.checkout(3)


def test_validate_wants_key_order(spark):
    a = Archive.create(spark, None, frame([["B", 1], ["A", 2]]), ["Berth"])
    with pytest.raises(ValueError, match="order"):
        a.commit(frame([["B", 1], ["A", 2]]), validate=True)
    a.commit(frame([["A", 2], ["A", 2], ["B", 1]]), validate=True)


def test_snapshots():
    s = SnapshotListing()
    for d in (1, 2, 3):
        s = s.append(s.next_version(), SnapshotDescriptor(valid_time=datetime(2020, 5, d)))
    at = lambda *t: s.at_time(datetime(*t))
    assert at(2020, 4, 1) is None and at(2020, 5, 1, 8).version == 0 and at(2020, 5, 10).version == 2 and s.at_time("2020-05-02T00:00:00Z").version == 1
    assert len(s.rollback(1)) == 2 and s[1].valid_time == datetime(2020, 5, 2, tzinfo=timezone.utc) and s.has_version(2) and s.last_snapshot().version == 2
    with pytest.raises(KeyError):
        s.get(7)
    with pytest.raises(ValueError):
        s.append(5)
    with pytest.raises(ValueError):
        s.append(3, SnapshotDescriptor(valid_time=datetime(2019, 1, 1)))


def test_concurrent_writers_are_told(spark, tmp_path):
    path = str(tmp_path / "a")
    one = Archive.create(spark, path, FRAMES[0])
    two = Archive.load(spark, path)
    one.commit(FRAMES[1])
    with pytest.raises(RuntimeError):
        two.commit(FRAMES[1])
    assert len(Archive.load(spark, path).snapshots()) == 2
    with pytest.raises(ValueError):
        Archive.create(spark, path, FRAMES[0])
    assert len(Archive.create(spark, path, FRAMES[0], replace=True).snapshots()) == 1


def test_scan_is_pruned(spark):
    a = Archive.create(spark, None, FRAMES[0], ["Berth"])
    a.commit(FRAMES[1])
    plan = a.checkout(0).select("Draught")._jdf.queryExecution().executedPlan().toString()
    scans = plan[plan.index("PushedFilters") :]  # whose text is cut short
    assert "PushedFilters: [IsNotNull(from_version), IsNotNull(to_version), LessThanOrEqual(from_versio" in scans and "c_0_str" not in scans


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(0, 2)), max_size=5), min_size=2, max_size=3))
def test_any_history_comes_back(spark, snapshots):
    docs = [from_rows(spark, ["k", "v"], [(i, i, list(r)) for i, r in enumerate(s)]) for s in snapshots]
    for d in docs:  # empty lists have no type of their own
        d.df = d.df.selectExpr("__pos", "__idx", "cast(v_0 as string) v_0", "cast(v_1 as bigint) v_1")
    a = Archive.create(spark, None, docs[0], ["k"])
    for d in docs[1:]:
        a.commit(d)
    for v, s in enumerate(snapshots):
        assert [tuple(r) for r in a.checkout(v, order="position").collect()] == s
    pairs = lambda s: [(k, sum(x[0] == k for x in s[:i]), v) for i, (k, v) in enumerate(s)]
    old, new = ({p[:2]: p[2] for p in pairs(s)} for s in snapshots[:2])
    ops = sorted(r.op for r in a.diff(0, 1, positions=False).rows().collect())
    assert ops == sorted(["DELETE"] * len(old.keys() - new.keys()) + ["INSERT"] * len(new.keys() - old.keys()) + ["UPDATE"] * sum(old[k] != new[k] for k in old.keys() & new.keys()))
    a.rollback(0)
    assert [tuple(r) for r in a.checkout(order="position").collect()] == snapshots[0]
