import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.archive import Archive
from palimpsest.sources.imports import _rows, import_archive


def put(path, meta, rows):
    path.mkdir()
    (path / "metadata.dat").write_text(json.dumps(meta))
    (path / "rows.dat").write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def column(colid, t, names, places):
    return {"c": colid, "t": t, "n": names, "p": places}


def snapshot(v):
    return {"v": v, "vt": {"$datetime": f"2021-0{v + 1}-01T00:00:00+00:00"}, "tt": {"$datetime": f"2021-0{v + 1}-02T00:00:00+00:00"}, "d": f"load {v}", "a": {"n": v}}


SCHEMA = [
    column(0, [[0, 2]], {"v": "name"}, [{"t": [[0, 1]], "v": 0}, {"t": [[2, 2]], "v": 1}]),
    column(1, [[0, 2]], [{"t": [[0, 0]], "v": "size"}, {"t": [[1, 2]], "v": "length"}], [{"t": [[0, 1]], "v": 1}, {"t": [[2, 2]], "v": 0}]),
    column(2, [[1, 2]], {"v": "seen"}, {"v": 2}),
]
ROWS = [
    {"r": 0, "k": "01", "t": [[0, 2]], "p": {"v": 0}, "c": {"0": {"v": "01"}, "1": [{"t": [[0, 0], [2, 2]], "v": 5}, {"t": [[1, 1]], "v": 6}], "2": {"t": [[1, 2]], "v": {"$date": "2020-02-29"}}}},
    {"r": 1, "k": "02", "t": [[0, 0], [2, 2]], "p": [{"t": [[0, 0]], "v": 1}, {"t": [[2, 2]], "v": 2}], "c": {"0": {"v": "02"}, "1": {"v": None}, "2": {"t": [[2, 2]], "v": None}}},
    {"r": 2, "k": "x", "t": [[1, 2]], "p": {"v": 1}, "c": {"0": {"v": "x"}, "1": {"v": 7}, "2": {"v": None}}},
]


@pytest.mark.parametrize("keyed", [True, False])
def test_versions_are_brought_over(spark, tmp_path, keyed):
    rows = ROWS if keyed else [r | {"k": r["r"]} for r in ROWS]
    source = put(tmp_path / "old", {"primaryKey": [0] if keyed else None, "schema": SCHEMA, "snapshots": [snapshot(v) for v in range(3)], "rowcount": 3}, rows)
    import_archive(spark, source, str(tmp_path / "new"))
    a = Archive.load(spark, str(tmp_path / "new"))
    got = [[tuple(r) for r in a.checkout(v, order="position").collect()] for v in range(3)]
    from datetime import date

    day = date(2020, 2, 29)
    assert got == [[("01", 5), ("02", None)], [("01", 6, day), ("x", 7, None)], [(5, "01", day), (7, "x", None), (None, "02", None)]]
    assert [[str(c) for c in a.schema().at_version(v)] for v in range(3)] == [["name", "size"], ["name", "length", "seen"], ["length", "name", "seen"]]
    assert sorted((r.from_version, r.to_version) for r in a.lifetimes().collect()) == [(0, 0), (0, 2), (1, 2), (2, 2)] and a.keys().count() == 3
    assert [(s.valid_time.month, s.transaction_time.day, s.description, s.action) for s in a.snapshots()] == [(v + 1, 2, f"load {v}", {"n": v}) for v in range(3)]


@pytest.mark.parametrize("form", ["lines", "bracketed", "one"])
def test_rows_as_one_array(spark, tmp_path, form):
    """The older form, with each row on a line or all on one, gives what lines of rows give; brackets and commas in values are values."""
    rows = [r | {"c": r["c"] | {"0": {"v": f"[{{,}}],{r['k']}\u2028]"}}} for r in ROWS]
    texts = [json.dumps(r, ensure_ascii=False) for r in rows]
    whole = {"lines": "[\n" + ",\n".join(texts) + "\n]\n", "bracketed": " [" + " ,\n\n".join(texts) + "] ", "one": "[" + ", ".join(texts) + "]"}[form]
    (tmp_path / "array").write_text(whole)
    (tmp_path / "plain").write_text("\n".join(texts))
    read = [sorted(r[0] for r in _rows(spark, str(tmp_path / n), str(tmp_path / f"{n}-copy")).select(F.to_json(F.struct("k", "t", "p", "c"))).collect()) for n in ("array", "plain")]
    assert read[0] == read[1] and len(read[0]) == len(rows) and "[{,}],01\u2028]" in "".join(read[0])


def test_an_archive_without_snapshots(spark, tmp_path):
    source = put(tmp_path / "old", {"primaryKey": None, "schema": [], "snapshots": [], "rowcount": 0}, [])
    assert import_archive(spark, source).is_empty()


@pytest.mark.parametrize("indexes", [["b", "a", "ü"], [3, "3", "x"], [[1, 2], [1, 3], [0]], [1.5, 2, 0.25]])
def test_row_indexes_of_any_kind(spark, tmp_path, indexes):
    """Each row keeps its identity by its index, whatever that is, over versions that have other rows."""
    meta = {"schema": [{"c": 0, "t": [[0, 2]], "n": {"v": "V"}, "p": {"v": 0}}], "snapshots": [{"v": v, "vt": f"2024-01-0{v + 1}T00:00:00", "tt": f"2024-01-0{v + 1}T00:00:00", "d": ""} for v in range(3)]}
    rows = [{"r": 0, "k": indexes[0], "t": [[0, 2]], "p": {"v": 0}, "c": {"0": [{"t": [[0, 0]], "v": "one"}, {"t": [[1, 2]], "v": "two"}]}}, {"r": 1, "k": indexes[1], "t": [[0, 0], [2, 2]], "p": {"v": 1}, "c": {"0": {"v": "away"}}}, {"r": 2, "k": indexes[2], "t": [[1, 2]], "p": {"v": 2}, "c": {"0": {"v": "new"}}}]
    (tmp_path / "metadata.dat").write_text(json.dumps(meta))
    (tmp_path / "rows.dat").write_text("\n".join(map(json.dumps, rows)))
    a = import_archive(spark, str(tmp_path))
    assert [sorted(r.V for r in a.checkout(v).collect()) for v in range(3)] == [["away", "one"], ["new", "two"], ["away", "new", "two"]]
    assert sorted((r.from_version, r.to_version) for r in a.lifetimes().collect()) == [(0, 0), (0, 2), (1, 2), (2, 2)] and a.keys().count() == 3
