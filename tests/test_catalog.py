import pandas as pd
import pytest

from palimpsest.catalog import ArchiveDescriptor, DatabaseArchiveManager, FileArchiveManager, VolatileArchiveManager
from palimpsest.cli import main

PEOPLE = pd.DataFrame([["1", "Alice"], ["2", "Bob"]], columns=["SSN", "Name"])


@pytest.fixture(params=["file", "database", "memory"])
def catalog(request, spark, tmp_path):
    if request.param == "file":
        return FileArchiveManager(spark, str(tmp_path / "c"), create=True)
    if request.param == "database":
        return DatabaseArchiveManager(spark, str(tmp_path / "c"), ":memory:")
    return VolatileArchiveManager(spark)


def test_catalog(catalog):
    people = catalog.create("people", "some", ["SSN"], PEOPLE)
    later = catalog.create("later", primary_key="SSN")
    assert [d.name for d in catalog.list()] == ["later", "people"] and catalog.contains(people.identifier)
    assert catalog.get_by_name("people").primary_key == ("SSN",) and catalog.get_by_name("nobody") is None
    assert catalog.get(people.identifier).checkout().count() == 2
    assert catalog.commit(later.identifier, PEOPLE).version == 0 and catalog.commit(later.identifier, PEOPLE).version == 1
    with pytest.raises(ValueError):
        catalog.create("people")
    with pytest.raises(ValueError):
        catalog.rename(later.identifier, "people")
    catalog.rename(later.identifier, "later")
    catalog.rename(later.identifier, "soon")
    assert catalog.get_by_name("soon").identifier == later.identifier
    catalog.delete(people.identifier)
    catalog.delete("unknown")
    assert list(catalog.archives()) == [later.identifier]
    with pytest.raises(ValueError):
        catalog.get(people.identifier)


def test_file_catalog_is_found_again(spark, tmp_path):
    FileArchiveManager(spark, str(tmp_path / "c")).create("people", doc=PEOPLE)
    again = FileArchiveManager(spark, str(tmp_path / "c"))
    assert [d.name for d in again.list("created_at")] == ["people"]
    assert FileArchiveManager(spark, str(tmp_path / "c"), create=True).archives() == {}


def test_descriptor_is_validated():
    good = ArchiveDescriptor.create(primary_key="A").to_dict()
    assert ArchiveDescriptor.from_dict(good).name == good["identifier"]
    for change in ({"identifier": None}, {"created_at": "never"}, {"primary_key": [1]}, {"other": 1}):
        with pytest.raises(ValueError):
            ArchiveDescriptor.from_dict(good | change)


def test_command_line(spark, tmp_path, capsys):
    base = ["--basedir", str(tmp_path / "c")]
    one, two = tmp_path / "1.csv", tmp_path / "2.csv"
    one.write_text("id,name\n1,a\n2,b\n")
    two.write_text("id,label\n1,a\n3,c\n")

    def run(*args, code=0):
        assert main([*base, *args]) == code
        return capsys.readouterr().out

    run("init")
    run("create", "t", "--pk", "id", "--input", str(one))
    assert "version 1" in run("commit", "t", str(two), "--rename", "name:label", "--description", "second", "--valid-time", "2099-01-01T00:00:00")
    assert "t\t" in run("list") and "second" in run("snapshots", "t")
    assert "rows\tinserted\t1" in run("diff", "t", "0", "1")
    run("checkout", "t", str(tmp_path / "o.tsv"), "--version", "0", "--single")
    assert (tmp_path / "o.tsv").read_text().splitlines() == ["id\tname", "1\ta", "2\tb"]
    run("checkout", "t", str(tmp_path / "folder.csv"))
    run("rollback", "t", "0")
    run("rename", "t", "u")
    run("rename", "t", "v", code=1)
    run("checkout", "u", str(tmp_path / "x.csv"), "--version", "7", code=1)
    run("delete", "u")
    assert run("list") == ""
