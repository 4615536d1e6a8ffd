"""What commits, upserts, rollbacks and streams read, move and write."""

import random

import pytest

from palimpsest.operators.archive import Archive
from palimpsest.operators.dataset import Expressions
from palimpsest.plans import merge, ranks
from palimpsest.plans.labels import labelled
from palimpsest.sources.documents import from_rows, from_spark
from palimpsest.sources.files import step
from palimpsest.store import CLEANUP, Part, buckets_for


def size_of(path, table=""):
    return sum(p.stat().st_size for p in path.rglob("*.parquet") if table in str(p))


def files_of(path):
    return {p for p in path.rglob("*.parquet")}


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Orders at sf0.1, of which the first one goes; one row is changed and one comes."""
    path = tmp_path_factory.mktemp("orders") / "a"
    rows = spark.read.parquet("/root/testdata/sf0.1/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    a = Archive.create(spark, str(path), rows, ["o_orderkey"])
    first = {t: size_of(path, f"/{t}/") for t in ("segments", "positions", "keys")}
    least = rows.agg({"o_orderkey": "min"}).first()[0]
    before = files_of(path)
    a.commit(rows.where(f"o_orderkey <> {least}"))
    return a, path, rows, least, first, before


def test_a_row_that_goes_writes_no_positions(orders):
    a, path, rows, least, first, before = orders
    written = sum(p.stat().st_size for p in files_of(path) - before if "/positions" in str(p))
    assert 0 < written < 0.01 * first["positions"]
    n = rows.count()
    moved = a.diff(0, 1).describe()["rows"]
    assert (moved["deleted"], moved["moved"], moved["all_updated"]) == (1, n - 1, 0)
    got = a.checkout(1, position=True).selectExpr("min(__pos)", "max(__pos)", "count(distinct __pos)").first()
    assert tuple(got) == (0, n - 2, n - 1)


def test_an_upserted_row_reads_few_files_and_moves_no_table(spark, orders, monkeypatch):
    a, path, rows, least, first, before = orders
    read, plans, store = [], [], a.store
    found, wrote = store.bucket_files, store.write_bucketed
    monkeypatch.setattr(store, "bucket_files", lambda *args: read.extend(found(*args)) or found(*args))
    monkeypatch.setattr(store, "bucketed", lambda *args: pytest.fail("a table is read as a whole"))
    monkeypatch.setattr(store, "spans", lambda *args: pytest.fail("a table is read as a whole"))
    monkeypatch.setattr(store, "keys", lambda *args: pytest.fail("all keys are read"))
    monkeypatch.setattr(store, "write_bucketed", lambda df, *args: (plans.append(df._jdf.queryExecution().executedPlan().toString()), wrote(df, *args)))
    key = rows.where("o_custkey % 7 = 3").first().o_orderkey
    a.upsert(spark.createDataFrame([(key, -5, "Z")], "o_orderkey long, o_custkey long, o_orderstatus string"))
    monkeypatch.undo()
    assert store.manifest.buckets >= 32 and read and len({f for f, _ in read}) < 0.05 * len([p for p in files_of(path) if "state=ended" not in str(p)])
    assert a.checkout(2).where(f"o_orderkey = {key}").collect()[0][1:] == (-5, "Z")
    assert a.checkout(2).count() == a.checkout(1).count()


def test_a_commit_moves_only_the_snapshot(spark, orders, monkeypatch):
    a, path, rows, least, first, before = orders
    plans = []
    from pyspark.sql.readwriter import DataFrameWriter

    write = DataFrameWriter.parquet

    def kept(self, path, *args, **kwargs):
        if path.endswith(("/matched", "/joined")):
            plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", kept)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a.commit(rows.selectExpr("o_orderkey", "o_custkey", "IF(o_orderkey % 1000 = 7, 'Y', o_orderstatus) AS o_orderstatus"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert len(plans) == 2
    for plan in plans:  # what lies under an exchange isn't a bucketed table
        lines = plan.splitlines()
        bucketed = [i for i, x in enumerate(lines) if "Bucketed: true" in x]
        assert bucketed
        for i in bucketed:
            depth = len(lines[i]) - len(lines[i].lstrip(" :+-"))
            for line in reversed(lines[:i]):
                own = len(line) - len(line.lstrip(" :+-"))
                if own < depth:
                    depth = own
                    assert "Exchange" not in line, plan
    assert a.checkout().where("o_orderstatus = 'Y'").count() == rows.where("o_orderkey % 1000 = 7").count()


def test_a_rollback_writes_no_data(orders):
    a, path, rows, least, first, before = orders
    there, last = files_of(path), a.snapshots().last_snapshot().version
    expected = {v: sorted(map(tuple, a.checkout(v).collect()))[:500] for v in (0, 1)}
    assert last >= 1
    a.rollback(1)
    assert files_of(path) == there
    b = Archive.load(a.spark, str(path))
    assert {v: sorted(map(tuple, b.checkout(v).collect()))[:500] for v in (0, 1)} == expected and len(b.snapshots()) == 2


def frame(spark, rows):
    return from_rows(spark, ["k", "v"], [(i, i, list(r)) for i, r in enumerate(rows)])


@pytest.mark.parametrize("seed", range(3))
def test_histories_with_forks(spark, monkeypatch, seed):
    """Random commits, upserts, filters, restores and rollbacks against lists of rows."""
    r = random.Random(seed)
    monkeypatch.setattr(merge, "ENDED_SHARE", r.choice([0.0, 0.3, 10.0]))
    monkeypatch.setattr(merge, "buckets_for", lambda n: 4)
    versions = [[(k, r.randrange(3)) for k in r.sample(range(12), 8)]]
    a = Archive.create(spark, None, frame(spark, versions[0]), ["k"])
    for _ in range(6):
        now = list(versions[-1])
        what = r.choice(["commit", "commit", "upsert", "filter", "restore", "rollback"])
        if what == "commit":
            now = [(k, r.randrange(3) if r.random() < 0.3 else v) for k, v in now if r.random() < 0.8]
            now += [(k, 9) for k in r.sample(range(20), 3) if k not in dict(now)]
            if r.random() < 0.5:
                now.append(now.pop(0)) if now else None
            a.commit(frame(spark, now or [(0, 0)]))
            now = now or [(0, 0)]
        elif what == "upsert":
            given = [(r.randrange(25), r.randrange(3)) for _ in range(3)]
            a.upsert(frame(spark, given))
            last = dict(given)
            now = [(k, last.pop(k, v)) for k, v in now] + sorted(last.items(), key=lambda x: max(i for i, g in enumerate(given) if g[0] == x[0]))
        elif what == "filter":
            a.apply(Expressions(where="v <> 1"))
            now = [x for x in now if x[1] != 1]
        elif what == "restore":
            back = r.randrange(len(versions))
            a.restore(back)
            now = list(versions[back])
        else:
            back = r.randrange(len(versions))
            a.rollback(back)
            versions = versions[: back + 1]
            continue
        versions.append(now)
    for v, rows in enumerate(versions):
        assert [tuple(x) for x in a.checkout(v, order="position").collect()] == rows
    ids = {x.key[0]["whole"]: x.rowid for x in a.keys().collect()}
    assert len(ids) == a.keys().count()
    lives = {(x.rowid, v) for x in a.lifetimes().collect() for v in range(x.from_version, x.to_version + 1)}
    assert lives == {(ids[k], v) for v, rows in enumerate(versions) for k, _ in rows}
    old, new = versions[0], versions[-1]
    changes = {x.rowid: x for x in a.diff(0, len(versions) - 1, positions=False).rows().collect()}
    assert {ids[k] for k, v in new if k in dict(old) and dict(old)[k] != v} == {i for i, x in changes.items() if x.op == "UPDATE"}
    nested = {x.rowid: x for x in a.rows().collect()}
    for v, rows in enumerate(versions):
        for k, value in rows:
            cells = {c["colid"]: c["value"] for c in nested[ids[k]].cells if any(s["from_version"] <= v <= s["to_version"] for s in c["versions"])}
            assert cells == {0: str(k), 1: str(value)} and any(s["from_version"] <= v <= s["to_version"] for p in nested[ids[k]].positions for s in p["versions"])


def test_upserts_of_repeated_keys(spark):
    a = Archive.create(spark, None, frame(spark, [("x", 0), ("y", 0)]), ["k"])
    a.upsert(frame(spark, [("a", 1), ("a", 2), ("x", 5)]))
    assert [tuple(r) for r in a.checkout(order="position").collect()] == [("x", 5), ("y", 0), ("a", 2)]
    a.upsert(frame(spark, [("a", 3), (None, 1), (None, 2)]))
    assert [tuple(r) for r in a.checkout(order="position").collect()] == [("x", 5), ("y", 0), ("a", 3), (None, 2)]
    b = Archive.create(spark, None, frame(spark, [("x", 0), ("x", 1), ("y", 2), ("x", 3)]), ["k"])
    b.upsert(frame(spark, [("x", 7)]))
    assert [tuple(r) for r in b.checkout(order="position").collect()] == [("x", 7), ("y", 2)]
    b.commit(frame(spark, [("x", 0), ("x", 1), ("y", 2), ("x", 3)]))
    assert b.keys().count() == 4 and [tuple(r) for r in b.checkout(order="position").collect()] == [("x", 0), ("x", 1), ("y", 2), ("x", 3)]


def test_types_and_columns_change_by_upserts_and_commits(spark):
    a = Archive.create(spark, None, frame(spark, [("x", 1), ("y", 2)]), ["k"])
    a.upsert(spark.createDataFrame([("y", 2.0, True), ("z", 2.5, None)], "k string, v double, more boolean"))
    a.commit(spark.createDataFrame([("x", 1.0, None), ("y", 2.0, True), ("z", 2.5, None)], "k string, v double, more boolean"))
    assert a.diff(1, 2, positions=False).rows().count() == 0 and a.lifetimes().count() == 3
    segments = a.store.spans("segments").where("rowid = 0").collect()
    assert len(segments) == 1  # 1 is 1.0, so the segment went on
    a.commit(spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 2.5)], "k string, v double"))
    a.commit(spark.createDataFrame([("x", 1.0), ("y", 3.0), ("z", 2.5)], "k string, v double"))
    assert [r.rowid for r in a.diff(3, 4, positions=False).rows().collect()] == [1]


def test_buckets_grow_with_the_archive(spark, monkeypatch):
    a = Archive.create(spark, None, frame(spark, [("x", 1)]), ["k"])
    assert a.store.manifest.buckets == 1
    monkeypatch.setattr(merge, "buckets_for", lambda n: max(1, n // 2))
    rows = [(f"k{i}", i) for i in range(40)]
    a.upsert(frame(spark, rows))
    m = a.store.manifest
    assert m.buckets == 20 and {p.buckets for parts in m.paths.values() for p in parts if "ended" not in p.path} == {20}
    a.upsert(frame(spark, [("k7", -1)]))
    a.commit(frame(spark, [("x", 1), *rows[5:]]))
    assert sorted(map(tuple, a.checkout(2).collect())) == sorted([("x", 1), *[(k, -1 if k == "k7" else v) for k, v in rows]])
    assert sorted(map(tuple, a.checkout(3).collect())) == sorted([("x", 1), *rows[5:]]) and a.keys().count() == 41
    assert [buckets_for(n) for n in (0, 1, 8192, 8193, 150_000, 10**6, 10**8, 10**10)] == [1, 1, 1, 2, 32, 64, 128, 16384]


def test_folders_of_other_buckets_are_read_all_the_same(spark):
    a = Archive.create(spark, None, frame(spark, [("x", 1), ("y", 2)]), ["k"])
    m = a.store.manifest
    a.store.manifest = m.replaced(buckets=3)
    a.upsert(frame(spark, [("y", 5)]))
    a.commit(frame(spark, [("y", 5), ("z", 1)]))
    assert sorted(map(tuple, a.checkout().collect())) == [("y", 5), ("z", 1)] and a.keys().count() == 3
    assert Part("p", 2) == Part("p", 2, None)


def test_occurrences_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(merge, "CHUNK", 16)
    rows = spark.range(400).selectExpr("IF(id % 3 = 0, 'hot', CAST(id % 50 AS STRING)) AS __key", "id AS __pos")
    got, most = merge.with_occurrences(rows)
    seen, expected = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r["__pos"]):
        seen[r["__key"]] = seen.get(r["__key"], 0) + 1
        expected[r["__pos"]] = seen[r["__key"]]
    assert {r["__pos"]: r["__occ"] for r in got.collect()} == expected and most == max(seen.values())
    unique, most = merge.with_occurrences(spark.range(9).selectExpr("id AS __key", "id AS __pos"))
    assert most == 1 and {r["__occ"] for r in unique.collect()} == {1}


def test_streams_know_their_batches(spark, tmp_path):
    from palimpsest.streaming.ingest import commit_batch, ingest_once

    path = str(tmp_path / "a")
    batch = lambda *rows: spark.createDataFrame(list(rows), "k int, v string")
    one, two = commit_batch(path, ["k"], stream="one"), commit_batch(path, ["k"], stream="two")
    one(batch((1, "a"), (1, "b"), (2, "c")), 0)
    two(batch((3, "x")), 0)
    two(batch((3, "again")), 0)
    one(batch((2, "d")), 1)
    one(batch((2, "again")), 0)
    a = Archive.load(spark, path)
    assert sorted(map(tuple, a.checkout().collect())) == [(1, "b"), (2, "d"), (3, "x")] and len(a.snapshots()) == 3 and a.store.manifest.batches == {"one": 1, "two": 0}
    source = tmp_path / "in"
    stream = lambda: spark.readStream.schema("k int, v string").parquet(str(source))
    batch((7, "s")).write.parquet(str(source))
    for k in (1, 2, 1, 2):
        a = ingest_once(stream(), path, ["k"], checkpoint=str(tmp_path / f"c{k}"))
    assert len(a.snapshots()) == 5 and len(a.store.manifest.batches) == 4 and a.checkout().where("k = 7").count() == 1
    a.rollback(2)
    assert len(ingest_once(stream(), path, ["k"], checkpoint=str(tmp_path / "c1")).snapshots()) == 3


def test_streams_that_race_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from palimpsest.streaming.ingest import commit_batch

    path = str(tmp_path / "a")
    Archive.create(spark, path, spark.createDataFrame([(0, "z")], "k int, v string"), ["k"])
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda s: commit_batch(path, ["k"], stream=str(s))(spark.createDataFrame([(s, "v")], "k int, v string"), 0), (1, 2, 3)))
    a = Archive.load(spark, path)
    assert sorted(r.k for r in a.checkout().collect()) == [0, 1, 2, 3] and len(a.snapshots()) == 4


def test_many_ended_rows_are_not_sent_through_the_driver(spark, tmp_path, monkeypatch):
    keys = spark.range(40).selectExpr("id AS k", "id AS v")
    a = Archive.create(spark, str(tmp_path / "a"), keys, ["k"])
    monkeypatch.setattr("palimpsest.store.SENT", 3)
    monkeypatch.setattr(merge, "ENDED_SHARE", 0.25)
    plans, wrote = [], a.store.write_dealt
    monkeypatch.setattr(a.store, "write_dealt", lambda df, *args: (plans.append(df._jdf.queryExecution().executedPlan().toString()), wrote(df, *args)))
    a.commit(keys.where("k % 8 > 0"))  # 5 rows end, and stay in a folder of ended ones
    assert a.store.manifest.paths["segments_ended"] and "Broadcast" not in a.checkout(1)._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.k for r in a.checkout(1).collect()) == [k for k in range(40) if k % 8] and a.checkout(0).count() == 40
    plans.clear()
    a.commit(keys.selectExpr("k", "v + k % 2 AS v"))  # 20 more: the table is settled
    settled = [p for p in plans if "__rowid" in p]
    assert not a.store.manifest.paths["segments_ended"] and settled and not any("Broadcast" in p for p in settled)
    assert all(p.count("Exchange ") == 2 for p in settled)  # each side is moved once
    assert sorted(map(tuple, a.checkout(2).collect())) == [(k, k + k % 2) for k in range(40)]
    assert sorted(map(tuple, a.checkout(1).collect())) == [(k, k) for k in range(40) if k % 8]
    assert sorted(map(tuple, a.checkout(0).collect())) == [(k, k) for k in range(40)]
    a.upsert(spark.createDataFrame([(k, -k) for k in range(5)], "k long, v long"))
    a.commit(keys.where("k > 1"))
    assert sorted(map(tuple, a.checkout(3).collect())) == [(k, -k if k < 5 else k + k % 2) for k in range(40)]
    assert sorted(map(tuple, a.checkout().collect())) == [(k, k) for k in range(2, 40)]


def test_keys_of_few_rows_are_numbered_without_a_join(spark):
    got, most = merge.with_occurrences(spark.range(60).selectExpr("id % 20 AS __key", "id AS __pos"))
    assert most == 3 and "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["__pos"], r["__key"], r["__occ"]) for r in got.collect()) == [(k, k % 20, k // 20 + 1) for k in range(60)]


def test_a_first_version_in_key_order_is_sorted_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merge, "ranked", lambda *args: pytest.fail("rows are sorted again"))
    rows = spark.createDataFrame([(5, "a"), (None, "b"), (3, "c"), (5, "d"), (9, "e")], "k long, v string")
    a = Archive.create(spark, str(tmp_path / "a"), rows, ["k"])
    monkeypatch.undo()
    found = a.checkout(0, row_id=True, position=True).collect()
    assert sorted(tuple(r) for r in found) == [(0, 0, 3, "c"), (1, 1, 5, "a"), (2, 2, 5, "d"), (3, 3, 9, "e"), (4, 4, None, "b")]
    assert sorted((r.rowid, r.occ) for r in a.keys().collect()) == [(0, 1), (1, 1), (2, 2), (3, 1), (4, 1)]
    a.commit(rows.where("v <> 'a'").union(spark.createDataFrame([(4, "f")], rows.schema)))
    assert sorted(tuple(r) for r in a.checkout(1, row_id=True).collect()) == [(0, 3, "c"), (1, 5, "d"), (3, 9, "e"), (4, None, "b"), (5, 4, "f")]


def test_tables_are_not_sent_through_the_driver(spark, tmp_path, monkeypatch):
    """Their files are compressed, so Spark takes them for small and would send them to all tasks."""
    from pyspark.sql.readwriter import DataFrameWriter

    a = Archive.create(spark, str(tmp_path / "a"), spark.range(40).selectExpr("id AS k", "id AS v"), ["k"])
    monkeypatch.setattr("palimpsest.store.SENT", 3)
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans, write = [], DataFrameWriter.parquet

    def kept(self, path, *args, **kwargs):
        if path.endswith(("/matched", "/joined")):
            plans.append(plan_of(self._df))
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", kept)
    a.commit(spark.range(8, 48).selectExpr("id AS k", "id + id % 2 AS v"))
    a.commit(spark.range(48).selectExpr("id AS k", "CAST(id AS STRING) AS w"))  # a column goes, so cells are compared
    assert len(plans) == 4 and sum("s_rowid" in p for p in plans) == 1
    plans += [plan_of(x) for x in (a.diff(0, 1, positions=False).rows(), a.open(1), a.checkout(1, order="position"))]
    sent = [x for p in plans for x in p.splitlines() if "BroadcastHashJoin" in x and "__part" not in x]  # a row a partition may be sent
    assert all("SortMergeJoin" in p for p in plans) and not sent
    assert sorted((r.k, r.v) for r in a.checkout(1).collect()) == [(k, k + k % 2) for k in range(8, 48)]
    assert sorted(map(tuple, a.checkout(2, position=True).collect())) == [(k, k, str(k)) for k in range(48)]
    assert {(r.key[0]["whole"], r.op) for r in a.diff(0, 1).rows("DELETE").collect()} == {(k, "DELETE") for k in range(8)}
    a.upsert(spark.createDataFrame([(3, "x"), (50, "y")], "k long, w string"))
    assert sorted(map(tuple, a.checkout().collect())) == [(k, "x" if k == 3 else str(k)) for k in range(48)] + [(50, "y")]


def test_steps_of_a_commit_go_once_they_are_read(spark, monkeypatch):
    left, write = [], merge.write_states

    def noted(store, df, table, path, *rest, **more):
        left.append(set(store.files.names(f"{store.path}/{path.rpartition('/')[0]}")))
        return write(store, df, table, path, *rest, **more)

    monkeypatch.setattr(merge, "write_states", noted)
    doc = lambda n: from_spark(spark.range(n).selectExpr("id % 7 AS k", "-id AS x"), order_by="x")
    a = Archive.create(spark, None, doc(40), ["k"])
    a.commit(doc(50))
    assert len(left) >= 4 and not any(names & {"document", "numbered", "matched"} for names in left)
    assert a.checkout(0).count() == 40 and {(r["k"], r["x"]) for r in a.checkout(1).collect()} == {(i % 7, -i) for i in range(50)}
    assert spark.conf.get(CLEANUP[0]) == "false"  # as it was


def test_what_only_the_order_needs_is_not_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ranks, "step", lambda df, path: written.append((path, df.columns)) or step(df, path))
    doc = from_spark(spark.range(20).selectExpr("id AS k", "-id AS x"), order_by="x")
    a = Archive.create(spark, None, doc, ["k"])
    assert [r["k"] for r in a.checkout(0, order="position").collect()] == list(range(19, -1, -1))
    columns = next(names for path, names in written if path.endswith("/document"))
    assert set(columns) == {"v_0", "v_1", "__mid"}


def test_earlier_attempts_at_labels_go(spark, tmp_path):
    rows = spark.createDataFrame([(k, k, (9 - k) << 20) for k in range(10)], "rowid long, n_pos long, o_label long")
    out, _ = labelled(rows, str(tmp_path / "l"))
    assert [r["rowid"] for r in out.orderBy("label").collect()] == list(range(10))
    assert len([p for p in tmp_path.iterdir()]) == 1
