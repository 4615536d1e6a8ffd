"""Columns that keep their identity when they are renamed, moved, dropped or retyped."""

from __future__ import annotations

from dataclasses import dataclass, field


class Column(str):
    """A column name with an identifier (``colid``) and, in a snapshot, a place (``colidx``)."""

    def __new__(cls, name, colid: int, colidx: int | None = None):
        out = super().__new__(cls, name)
        out.colid, out.colidx = colid, colidx
        return out


@dataclass(frozen=True)
class Spell:
    """What a column was from one version to another."""

    first: int
    last: int
    name: str
    pos: int
    kind: str

    def look(self) -> tuple:
        return self.name, self.pos, self.kind


@dataclass
class ColumnHistory:
    colid: int
    spells: list[Spell] = field(default_factory=list)

    def at(self, version: int) -> Spell | None:
        return next((s for s in reversed(self.spells) if s.first <= version <= s.last), None)

    def extended(self, version: int, name: str, pos: int, kind: str) -> ColumnHistory:
        last = self.spells[-1] if self.spells else None
        if last and last.last == version - 1 and last.look() == (name, pos, kind):
            return ColumnHistory(self.colid, [*self.spells[:-1], Spell(last.first, version, name, pos, kind)])
        return ColumnHistory(self.colid, [*self.spells, Spell(version, version, name, pos, kind)])

    def rollback(self, version: int) -> ColumnHistory | None:
        kept = [Spell(s.first, min(s.last, version), *s.look()) for s in self.spells if s.first <= version]
        return ColumnHistory(self.colid, kept) if kept else None


def document_schema(columns: list) -> tuple[list[Column], list[str]]:
    """The columns with identifiers and the plain names; each may appear once."""
    ids = [c for c in columns if isinstance(c, Column)]
    names = [c for c in columns if not isinstance(c, Column)]
    if len({c.colid for c in ids}) < len(ids):
        raise ValueError("duplicate column identifier")
    if len(set(names)) < len(names):
        raise ValueError("duplicate column name")
    return ids, names


def as_list(columns) -> list:
    if columns is None:
        return []
    return list(columns) if isinstance(columns, (list, tuple)) or not isinstance(columns, (str, int)) else [columns]


def to_schema(columns: list) -> list[Column]:
    """Columns with identifiers for plain names; either all or none may have one already."""
    given = [isinstance(c, Column) for c in columns]
    if all(given):
        return list(columns)
    if any(given):
        raise ValueError("columns with and without identifiers")
    return [Column(c, i, i) for i, c in enumerate(columns)]


def column_ref(schema: list, column) -> tuple[str, int]:
    """(name, place) of a column given by place, by name (the first that fits) or as a Column."""
    if isinstance(column, bool) or not isinstance(column, (int, str)):
        raise ValueError(f"invalid column reference {column!r}")
    if isinstance(column, int):
        if not 0 <= column < len(schema):
            raise ValueError(f"no column at {column}")
        return schema[column], column
    if isinstance(column, Column) and column.colidx is not None:
        if not 0 <= column.colidx < len(schema) or schema[column.colidx] != column:
            raise ValueError(f"column {column} is not at {column.colidx}")
        return schema[column.colidx], column.colidx
    for i, name in enumerate(schema):
        if name == column:
            return name, i
    raise ValueError(f"unknown column {column}")


def column_index(schema: list, columns) -> list[int]:
    return [column_ref(schema, c)[1] for c in as_list(columns)]


def select_clause(schema: list, columns) -> tuple[list[str], list[int]]:
    refs = [column_ref(schema, c) for c in as_list(columns)]
    return [n for n, _ in refs], [i for _, i in refs]


class ArchiveSchema:
    """The histories of all columns that an archive has ever had."""

    def __init__(self, columns: list[ColumnHistory] | None = None, next_id: int = 0):
        columns = columns or []
        self.columns = {c.colid: c for c in columns}
        if len(self.columns) < len(columns):
            raise ValueError("duplicate column identifier")
        self.next_id = max([next_id, *(c + 1 for c in self.columns)])

    def at_version(self, version: int) -> list[Column]:
        alive = [(s.pos, s.name, c.colid) for c in self.columns.values() if (s := c.at(version))]
        return [Column(name, colid, place) for place, (_, name, colid) in enumerate(sorted(alive))]

    def kinds_at(self, version: int) -> dict[int, str]:
        return {c.colid: s.kind for c in self.columns.values() if (s := c.at(version))}

    def mapping(self, version: int) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for c in self.at_version(version):
            out.setdefault(str(c), []).append(c.colid)
        return out

    def merge(self, columns: list, version: int, origin: int | None, renamed: dict[str, str] | None = None, kinds: list[str] | None = None) -> tuple[ArchiveSchema, list[int]]:
        """The schema with a further version, and the identifiers of its columns.

        Columns with identifiers are matched by them; names by the schema at
        ``origin`` after ``renamed`` (old name to new) is undone. A name without
        a match begins a new column, even if a dropped one was called so.
        """
        ids, _ = document_schema(columns)
        kinds = kinds or ["string"] * len(columns)
        known = self.mapping(origin) if origin is not None else {}
        old_name = {new: old for old, new in (renamed or {}).items()}
        following = max([self.next_id - 1, *(c.colid for c in ids)]) + 1
        out, after = [], dict(self.columns)
        for place, (column, kind) in enumerate(zip(columns, kinds)):
            if isinstance(column, Column):
                colid = column.colid
            else:
                found = known.get(old_name.get(column, column), [])
                if len(found) > 1:
                    raise ValueError(f"cannot match {column} to a unique column")
                if found:
                    colid = found[0]
                else:
                    colid, following = following, following + 1
            if colid in out:
                raise ValueError(f"multiple matches for column {colid}")
            out.append(colid)
            after[colid] = after.get(colid, ColumnHistory(colid)).extended(version, str(column), place, kind)
        return ArchiveSchema(list(after.values()), max(self.next_id, following)), out

    def rollback(self, version: int) -> ArchiveSchema:
        """Without later versions; identifiers aren't used again."""
        return ArchiveSchema([c for x in self.columns.values() if (c := x.rollback(version))], self.next_id)

    def diff(self, before: int, after: int) -> list[dict]:
        """One change for each column that was inserted, deleted, renamed or moved."""
        out = []
        for colid, c in sorted(self.columns.items()):
            old, new = c.at(before), c.at(after)
            row = {"colid": colid, "op": "UPDATE", "old_name": None, "new_name": None, "old_pos": None, "new_pos": None}
            if old and new:
                if old.name != new.name:
                    row |= {"old_name": old.name, "new_name": new.name}
                if old.pos != new.pos:
                    row |= {"old_pos": old.pos, "new_pos": new.pos}
                if old.name != new.name or old.pos != new.pos:
                    out.append(row)
            elif old or new:
                out.append(row | {"op": "DELETE" if old else "INSERT"})
        return out

    def to_json(self) -> dict:
        return {"next_id": self.next_id, "columns": [{"colid": c.colid, "spells": [[s.first, s.last, *s.look()] for s in c.spells]} for c in self.columns.values()]}

    @classmethod
    def from_json(cls, data: dict) -> ArchiveSchema:
        return cls([ColumnHistory(c["colid"], [Spell(*s) for s in c["spells"]]) for c in data["columns"]], data["next_id"])


def primary_key_ids(columns: list, primary_key) -> list[int] | None:
    """Identifiers of the key columns in a first snapshot."""
    names = as_list(primary_key)
    if not names:
        return None
    _, ids = ArchiveSchema().merge(columns, 0, None)
    by_name: dict[str, list[int]] = {}
    for column, colid in zip(columns, ids):
        by_name.setdefault(str(column), []).append(colid)
    out = []
    for name in names:
        if isinstance(name, Column):
            found = [name.colid] if name.colid in ids else []
        else:
            found = by_name.get(name, [])
        if len(found) != 1:
            raise ValueError(f"{'unknown' if not found else 'ambiguous'} key column {name}")
        out += found
    return out
