"""Sets of versions as sorted, disjoint intervals that don't touch."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class Versions:
    """An immutable set of version numbers; ``runs`` holds inclusive (first, last) pairs."""

    runs: tuple[tuple[int, int], ...] = ()

    @classmethod
    def of(cls, *items: int | Iterable[int]) -> Versions:
        """From single versions and (first, last) pairs, in any order, overlapping or not."""
        pairs = sorted((x, x) if isinstance(x, int) else tuple(x) for x in items)
        out: list[list[int]] = []
        for first, last in pairs:
            if last < first:
                raise ValueError(f"invalid interval ({first}, {last})")
            if out and first <= out[-1][1] + 1:
                out[-1][1] = max(out[-1][1], last)
            else:
                out.append([first, last])
        return cls(tuple(map(tuple, out)))

    def contains(self, version: int) -> bool:
        return any(first <= version <= last for first, last in reversed(self.runs))

    def append(self, version: int) -> Versions:
        """With a version after the last one."""
        if self.runs and version <= self.runs[-1][1]:
            raise ValueError(f"version {version} is not after {self.runs[-1][1]}")
        return Versions.of(*self.runs, version)

    def rollback(self, version: int) -> Versions:
        """Without what comes after ``version``."""
        return Versions(tuple((first, min(last, version)) for first, last in self.runs if first <= version))

    def is_empty(self) -> bool:
        return not self.runs

    def last_version(self) -> int | None:
        return self.runs[-1][1] if self.runs else None

    def __str__(self) -> str:
        return "[" + ", ".join(str(a) if a == z else f"{a}-{z}" for a, z in self.runs) + "]"
