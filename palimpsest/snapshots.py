"""Descriptions of the versions of an archive."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass
from datetime import datetime, timezone


def utc_now() -> datetime:
    return datetime.now(timezone.utc)


def as_time(value: datetime | str) -> datetime:
    """An aware time; naive ones count as UTC."""
    value = datetime.fromisoformat(value.replace("Z", "+00:00")) if isinstance(value, str) else value
    return value if value.tzinfo else value.replace(tzinfo=timezone.utc)


@dataclass(frozen=True)
class SnapshotDescriptor:
    """What is known of a snapshot besides its data."""

    description: str | None = None
    valid_time: datetime | None = None
    action: dict | None = None


@dataclass(frozen=True)
class Snapshot:
    version: int
    valid_time: datetime
    transaction_time: datetime
    description: str = ""
    action: dict | None = None

    @property
    def created_at(self) -> datetime:
        return self.transaction_time

    def to_json(self) -> dict:
        return asdict(self) | {"valid_time": self.valid_time.isoformat(), "transaction_time": self.transaction_time.isoformat()}

    @classmethod
    def from_json(cls, data: dict) -> Snapshot:
        return cls(**data | {k: as_time(data[k]) for k in ("valid_time", "transaction_time")})


class SnapshotListing:
    """Snapshots of rising version whose valid times never go back; not changed in place."""

    def __init__(self, snapshots: list[Snapshot] | None = None):
        self._all = tuple(snapshots or ())
        for a, b in zip(self._all, self._all[1:]):
            if b.version <= a.version:
                raise ValueError(f"version {b.version} after {a.version}")
            if b.valid_time < a.valid_time:
                raise ValueError(f"valid time {b.valid_time} before {a.valid_time}")

    def append(self, version: int, descriptor: SnapshotDescriptor | None = None) -> SnapshotListing:
        if version != self.next_version():
            raise ValueError(f"version {version} is not {self.next_version()}")
        d, now = descriptor or SnapshotDescriptor(), utc_now()
        return SnapshotListing([*self._all, Snapshot(version, as_time(d.valid_time or now), now, d.description or "", d.action)])

    def at_time(self, when: datetime | str) -> Snapshot | None:
        """The last snapshot that was valid by then."""
        when = as_time(when)
        return next((s for s in reversed(self._all) if s.valid_time <= when), None)

    def get(self, version: int) -> Snapshot:
        for s in self._all:
            if s.version == version:
                return s
        raise KeyError(version)

    __getitem__ = get

    def has_version(self, version: int) -> bool:
        return any(s.version == version for s in self._all)

    def last_snapshot(self) -> Snapshot | None:
        return self._all[-1] if self._all else None

    def next_version(self) -> int:
        return self._all[-1].version + 1 if self._all else 0

    def is_empty(self) -> bool:
        return not self._all

    def rollback(self, version: int) -> SnapshotListing:
        return SnapshotListing([s for s in self._all if s.version <= version])

    def __len__(self) -> int:
        return len(self._all)

    def __iter__(self) -> Iterator[Snapshot]:
        return iter(self._all)
