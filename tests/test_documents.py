import gzip
from datetime import date, datetime

import pandas as pd
import pytest

from palimpsest.operators.archive import Archive
from palimpsest.sources.documents import empty_document, from_csv, from_json, from_pandas, from_rows, nan_to_none, to_document
from palimpsest.sources.sinks import write_csv, write_json

AGENCIES = "agency,borough,state\nDOB,BK,NY\n\"D,O\"\"E\",,NY\nHPD,\\N,NJ\n"


def rows(doc):
    return [(r["__pos"], r["__idx"], *[r[f"v_{i}"] for i in range(len(doc.columns))]) for r in doc.df.orderBy("__pos").collect()]


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(AGENCIES)
    doc = from_csv(spark, str(path), none_is="\\N")
    assert doc.columns == ["agency", "borough", "state"]
    assert rows(doc) == [(0, 0, "DOB", "BK", "NY"), (1, 1, 'D,O"E', "", "NY"), (2, 2, "HPD", None, "NJ")]
    named = from_csv(spark, str(path), header=["a", "b", "c"])
    assert rows(named)[0] == (0, 0, "agency", "borough", "state") and len(rows(named)) == 4


def test_tsv_gzip_skip_and_infer(spark, tmp_path):
    path = tmp_path / "a.tsv.gz"
    with gzip.open(path, "wt") as f:
        f.write("# comment\nid\tx\tname\n2\t1.5\tb\n1\t2\ta\n")
    doc = from_csv(spark, str(path), skip_lines=1, infer=True)
    assert doc.kinds == ["bigint", "double", "string"] and rows(doc) == [(0, 0, 2, 1.5, "b"), (1, 1, 1, 2.0, "a")]
    assert [r["v_2"] for r in doc.sorted(["id"]).df.collect()] == ["a", "b"]


def test_ragged_and_empty_csv(spark, tmp_path):
    short, empty, head = tmp_path / "s.csv", tmp_path / "e.csv", tmp_path / "h.csv"
    short.write_text("a,b,c\n1,2,3\n4\n")
    empty.write_text("")
    head.write_text("a,b\n")
    assert rows(from_csv(spark, str(short))) == [(0, 0, "1", "2", "3"), (1, 1, "4", None, None)]
    assert from_csv(spark, str(empty)).columns == [] and rows(from_csv(spark, str(head))) == []


def test_csv_round_trip(spark, tmp_path):
    doc = from_rows(spark, ["A", "B"], [(0, 0, ["x", None]), (1, 1, ['q"u,o', "line\nbreak"]), (2, 2, ["", "z"])])
    write_csv(doc, str(tmp_path / "o.csv"), none_as="\\N", gzip=True)
    back = from_csv(spark, str(tmp_path / "o.csv"), header=["A", "B"], none_is="\\N")
    assert ("", "z") in [r[2:] for r in rows(back)] and ('q"u,o', "line\nbreak") in [r[2:] for r in rows(back)] and ("x", None) in [r[2:] for r in rows(back)]


def test_json_round_trip(spark, tmp_path):
    data = [(0, 0, ["a", 1, 1.5, datetime(2020, 5, 1, 8, 30)]), (1, 5, ['q"', None, 2.5, None])]
    doc = from_rows(spark, ["s", "i", "f", "t"], data)
    write_json(doc, str(tmp_path / "d.json"))
    back = from_json(spark, str(tmp_path / "d.json"), {"t": "timestamp_ntz"})
    assert back.columns == ["s", "i", "f", "t"] and rows(back.select(["s"])) == [(0, 0, "a"), (1, 5, 'q"')]
    assert [r["v_3"] for r in back.df.orderBy("__pos").collect()] == [datetime(2020, 5, 1, 8, 30), None]


def test_json_document(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text('["Name", "Age", "Born"]\n[0, "k1", ["Alice", 23, {"$date": "2000-01-02"}]]\n[1, "k0", ["Bob", 44, null]]\n')
    doc = from_json(spark, str(path), {"Name": "string", "Age": "bigint", "Born": "date"})
    assert rows(doc) == [(0, "k1", "Alice", 23, date(2000, 1, 2)), (1, "k0", "Bob", 44, None)]
    assert [i for i, _ in doc.read_order().iterrows()] == ["k0", "k1"]
    assert from_json(spark, str(tmp_path / "none.json")).columns == []
    a = Archive.create(spark, None, doc)
    assert [r.Name for r in a.checkout(order="key").collect()] == ["Bob", "Alice"]


def test_json_values_keep_their_types(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text('["s", "i", "f", "b", "m", "t", "d", "z"]\n[0, 0, ["01234", 7, 1, true, "1", {"$time": "08:30:00"}, {"$datetime": "2020-05-01T08:30:00"}, null]]\n[1, -1, ["5", null, 2.5, false, 1, {"$time": "09:00:00"}, null, null]]\n')
    doc = from_json(spark, str(path))
    assert rows(doc.select(["s"])) == [(0, 0, "01234"), (1, None, "5")]
    got = [tuple(r[f"v_{k}"] for k in range(8)) for r in doc.df.orderBy("__pos").collect()]
    assert [r[:4] for r in got] == [("01234", 7, 1.0, True), ("5", None, 2.5, False)]
    assert [tuple(r[4]) for r in got] == [("str", "1"), ("int", "1")] and [tuple(r[5]) for r in got] == [("time", "08:30:00"), ("time", "09:00:00")]
    assert [r[6:] for r in got] == [(datetime(2020, 5, 1, 8, 30), None), (None, None)]


def test_csv_in_many_files_and_splits(spark, tmp_path):
    lines = [f"{k},{'x' * (k % 50)}" for k in range(6000)]
    d = tmp_path / "many"
    d.mkdir()
    cuts = [0, 10, 4000, 4001, 6000]
    for n, (a, z) in enumerate(zip(cuts, cuts[1:])):
        (d / f"p{n}.csv").write_text("\n".join((["k,v"] if not n else []) + lines[a:z]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        doc = from_csv(spark, str(d))
        assert doc.df.rdd.getNumPartitions() > 3
        got = [(r["__pos"], r["v_0"]) for r in doc.df.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == [(k, str(k)) for k in range(6000)]


def test_pandas_and_memory(spark):
    frame = pd.DataFrame({"Name": ["A", "B", "C"], "Age": [1.0, float("nan"), 3.0]}, index=[2, -1, 0])
    doc = from_pandas(spark, frame)
    assert rows(doc) == [(0, 2, "A", 1.0), (1, None, "B", None), (2, 0, "C", 3.0)]
    assert [r[1] for r in [(r["__pos"], r["v_0"]) for r in doc.read_order().df.collect()]] == ["C", "A", "B"]
    assert list(doc.to_df().index)[0] == 2 and nan_to_none(float("nan")) is None and nan_to_none(1) == 1
    tuples = from_rows(spark, ["Name"], [(0, 0, ["a"]), (1, (1, 2), ["b"]), (2, -1, ["c"])])
    assert [r[1] for r in rows(tuples)] == ["[0]", "[1, 2]", None]
    assert rows(empty_document(spark, ["A", "B"])) == []


def test_datetime_column_survives(spark, tmp_path):
    a = Archive.create(spark, str(tmp_path / "a"), pd.DataFrame([[datetime(2020, 1, 2, 3, 4, 5)]], columns=["0"]))
    assert a.checkout().collect()[0][0] == datetime(2020, 1, 2, 3, 4, 5)


def test_dispatch(spark, tmp_path):
    (tmp_path / "a.csv").write_text(AGENCIES)
    assert to_document(spark, str(tmp_path / "a.csv")).columns[0] == "agency"
    assert to_document(spark, spark.range(3), order_by="id").columns == ["id"]
    with pytest.raises(ValueError):
        to_document(spark, 7)


def test_json_head_of_the_first_file(spark, tmp_path):
    folder = tmp_path / "a b.json"
    folder.mkdir()
    (folder / "part-00000.txt").write_text("")
    (folder / "part-00001.txt").write_text('["a","b"]\n[0,0,["x",1]]\n')
    (folder / "part-00002.txt").write_text("".join(f'[{k},{k},["y{k}",{k}]]\n' for k in range(1, 200)))  # Spark reads the largest file first
    back = from_json(spark, str(folder))
    assert back.columns == ["a", "b"] and back.df.count() == 200 and rows(back)[:2] == [(0, 0, "x", 1), (1, 1, "y1", 1)]
