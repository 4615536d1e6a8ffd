"""Catalogs of named archives: in memory, in a JSON file beside the archives, or in an SQLite database."""

from __future__ import annotations

import json
import os
import re
import sqlite3
import uuid
from abc import ABC, abstractmethod
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession

from palimpsest.functions.columns import as_list
from palimpsest.operators.archive import Archive
from palimpsest.snapshots import as_time, utc_now
from palimpsest.sources.files import Files
from palimpsest.store import Store, scratch_dir


KEPT = 8  # files of the catalog before the last one


@dataclass(frozen=True)
class ArchiveDescriptor:
    """Catalog entry of an archive."""

    identifier: str
    created_at: str
    name: str = ""
    description: str = ""
    primary_key: tuple[str, ...] | None = None

    @classmethod
    def create(cls, name: str | None = None, description: str | None = None, primary_key=None) -> ArchiveDescriptor:
        identifier = uuid.uuid4().hex
        return cls(identifier, utc_now().isoformat(), name or identifier, description or "", tuple(map(str, as_list(primary_key))) or None)

    @classmethod
    def from_dict(cls, data: dict) -> ArchiveDescriptor:
        """Validated; the name is the identifier by default."""
        extra = set(data) - {"identifier", "created_at", "name", "description", "primary_key"}
        if extra or not isinstance(data.get("identifier"), str) or not isinstance(data.get("created_at"), str):
            raise ValueError(f"invalid archive descriptor: {sorted(extra) or 'identifier and created_at are needed'}")
        as_time(data["created_at"])
        key = data.get("primary_key")
        if key is not None and (not isinstance(key, (list, tuple)) or not all(isinstance(k, str) for k in key)):
            raise ValueError("invalid primary key")
        return cls(data["identifier"], data["created_at"], data.get("name") or data["identifier"], data.get("description") or "", tuple(key) if key else None)

    def to_dict(self) -> dict:
        return asdict(self)


class ArchiveManager(ABC):
    """Creates, lists, renames, opens and deletes archives. Names are unique."""

    def __init__(self, spark: SparkSession, basedir: str):
        self.spark, self.basedir, self.files = spark, basedir.rstrip("/"), Files(spark)

    @abstractmethod
    def _load(self) -> dict[str, ArchiveDescriptor]: ...

    @abstractmethod
    def _put(self, descriptor: ArchiveDescriptor) -> None: ...

    @abstractmethod
    def _drop(self, identifier: str) -> None: ...

    def archives(self) -> dict[str, ArchiveDescriptor]:
        """Descriptors by identifier."""
        return self._load()

    def list(self, by: str = "name") -> list[ArchiveDescriptor]:
        return sorted(self._load().values(), key=lambda d: (getattr(d, by), d.identifier))

    def contains(self, identifier: str) -> bool:
        return identifier in self._load()

    def _path(self, identifier: str) -> str:
        return f"{self.basedir}/{identifier}"

    def create(self, name: str | None = None, description: str | None = None, primary_key=None, doc=None, descriptor=None, **options) -> ArchiveDescriptor:
        """A new archive, with a first snapshot if there is a document; a key without one applies to the first commit."""
        if name is not None and self.get_by_name(name) is not None:
            raise ValueError(f"an archive named {name} exists already")
        entry = ArchiveDescriptor.create(name, description, primary_key)
        if doc is not None:
            Archive.create(self.spark, self._path(entry.identifier), doc, primary_key, descriptor, **options)
        elif not primary_key:
            Archive.create(self.spark, self._path(entry.identifier))
        self._put(entry)
        return entry

    def commit(self, identifier: str, doc, descriptor=None, **options):
        """Commit to an archive, whose folder may be empty until now."""
        entry, path = self._entry(identifier), self._path(identifier)
        if entry.primary_key and not Store(self.spark, path).exists():
            return Archive.create(self.spark, path, doc, list(entry.primary_key), descriptor, **options).snapshots().last_snapshot()
        return self.get(identifier).commit(doc, descriptor, **options)

    def _entry(self, identifier: str) -> ArchiveDescriptor:
        found = self._load().get(identifier)
        if found is None:
            raise ValueError(f"unknown archive {identifier}")
        return found

    def get(self, identifier: str) -> Archive:
        self._entry(identifier)
        return Archive.load(self.spark, self._path(identifier))

    def get_by_name(self, name: str) -> ArchiveDescriptor | None:
        return next((d for d in self._load().values() if d.name == name), None)

    def rename(self, identifier: str, name: str) -> None:
        """To its own name is allowed and does nothing; to another one's isn't."""
        entry, other = self._entry(identifier), self.get_by_name(name)
        if other is not None and other.identifier != identifier:
            raise ValueError(f"an archive named {name} exists already")
        if entry.name != name:
            self._put(ArchiveDescriptor.from_dict(entry.to_dict() | {"name": name}))

    def delete(self, identifier: str) -> None:
        """The archive and its entry; an unknown one is left alone."""
        if self.contains(identifier):
            self._drop(identifier)
            self.files.delete(self._path(identifier))


class VolatileArchiveManager(ArchiveManager):
    """A catalog that ends with the process."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark, f"{scratch_dir(spark)}/catalog-{uuid.uuid4().hex}")
        self._entries: dict[str, ArchiveDescriptor] = {}

    def _load(self):
        return dict(self._entries)

    def _put(self, descriptor):
        self._entries[descriptor.identifier] = descriptor

    def _drop(self, identifier):
        self._entries.pop(identifier, None)


class FileArchiveManager(ArchiveManager):
    """A catalog in files ``archives-N.json``, in any store that Spark reaches; the highest N counts. A change makes the next file, which only one writer can, so no change is lost."""

    def __init__(self, spark: SparkSession, basedir: str, create: bool = False):
        super().__init__(spark, basedir)
        if create:
            self.files.delete(self.basedir)
        if not self._numbers():
            self.files.create(self._file(0), "[]")

    def _file(self, number: int) -> str:
        return f"{self.basedir}/archives-{number:06d}.json"

    def _numbers(self) -> list[int]:
        return sorted(int(m[1]) for n in self.files.names(self.basedir) if (m := re.fullmatch(r"archives-(\d+)\.json", n)))

    def _load(self):
        return self._at(self._numbers()[-1])

    def _at(self, number):
        return {d.identifier: d for d in map(ArchiveDescriptor.from_dict, json.loads(self.files.read(self._file(number))))}

    def _changed(self, change) -> None:
        for _ in range(100):
            numbers = self._numbers()
            entries = change(self._at(numbers[-1]))
            if self.files.create(self._file(numbers[-1] + 1), json.dumps([d.to_dict() for d in entries.values()], indent=1)):
                for old in numbers[:-KEPT]:
                    self.files.delete(self._file(old))
                return
        raise RuntimeError("the catalog is changed by others all the time")

    def _put(self, descriptor):
        def change(entries):
            if any(d.name == descriptor.name and d.identifier != descriptor.identifier for d in entries.values()):
                raise ValueError(f"an archive named {descriptor.name} exists already")
            return entries | {descriptor.identifier: descriptor}

        self._changed(change)

    def _drop(self, identifier):
        self._changed(lambda entries: {k: d for k, d in entries.items() if k != identifier})


class DatabaseArchiveManager(ArchiveManager):
    """A catalog in SQLite; ``:memory:`` lasts as long as the manager."""

    def __init__(self, spark: SparkSession, basedir: str, database: str, create: bool = False):
        super().__init__(spark, basedir)
        if database != ":memory:" and os.path.dirname(database):
            os.makedirs(os.path.dirname(database), exist_ok=True)
        self._db = sqlite3.connect(database)
        with self._db:
            if create:
                self._db.execute("DROP TABLE IF EXISTS archive_key")
                self._db.execute("DROP TABLE IF EXISTS archive")
            self._db.execute("CREATE TABLE IF NOT EXISTS archive (identifier TEXT PRIMARY KEY, name TEXT UNIQUE NOT NULL, description TEXT NOT NULL, created_at TEXT NOT NULL)")
            self._db.execute("CREATE TABLE IF NOT EXISTS archive_key (identifier TEXT REFERENCES archive ON DELETE CASCADE, pos INTEGER, name TEXT, PRIMARY KEY (identifier, pos))")

    def _load(self):
        keys: dict[str, list[str]] = {}
        for identifier, name in self._db.execute("SELECT identifier, name FROM archive_key ORDER BY identifier, pos"):
            keys.setdefault(identifier, []).append(name)
        rows = self._db.execute("SELECT identifier, created_at, name, description FROM archive").fetchall()
        return {r[0]: ArchiveDescriptor(*r, tuple(keys[r[0]]) if r[0] in keys else None) for r in rows}

    def _put(self, d):
        with self._db:
            self._db.execute("INSERT INTO archive VALUES (?, ?, ?, ?) ON CONFLICT (identifier) DO UPDATE SET name = excluded.name, description = excluded.description", (d.identifier, d.name, d.description, d.created_at))
            self._db.execute("DELETE FROM archive_key WHERE identifier = ?", (d.identifier,))
            self._db.executemany("INSERT INTO archive_key VALUES (?, ?, ?)", [(d.identifier, i, k) for i, k in enumerate(d.primary_key or ())])

    def _drop(self, identifier):
        with self._db:
            self._db.execute("DELETE FROM archive_key WHERE identifier = ?", (identifier,))
            self._db.execute("DELETE FROM archive WHERE identifier = ?", (identifier,))


def manager(spark: SparkSession, basedir: str | None = None, database: str | None = None, create: bool = False) -> ArchiveManager:
    """The catalog of a folder: in a database where one is given, else in its JSON file."""
    from palimpsest import config

    basedir, database = basedir or config.basedir(), database or config.catalog_database()
    return DatabaseArchiveManager(spark, basedir, database, create) if database else FileArchiveManager(spark, basedir, create)
