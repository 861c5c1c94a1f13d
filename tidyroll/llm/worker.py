"""What a Python worker keeps between its tasks."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from typing import Any

#: Bytes that the memory of one operator may have in a worker, by estimate.
MEMORY_BYTES = 64 << 20
#: What a remembered text costs beside its characters: string, number, and place in a dict.
ENTRY_BYTES = 160

_held: list[tuple[Hashable, Any]] = []


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """The thing that was made for `key`, or a new one in place of the last.

    Spark reuses its Python workers for tasks of other operators. There is one place for what they
    keep, so that the memories of an operator that has ended don't stay beside the next one's.
    """
    if not _held or _held[0][0] != key:
        _held.clear()  # before the next is made
        _held.append((key, make()))
    return _held[0][1]


class Words(dict):
    """A number for each text that was looked up, up to a bound in bytes; beyond it, all are forgotten."""

    def __init__(self, make: Callable[[list], Iterable[int]], most: int = MEMORY_BYTES):
        super().__init__()
        self.make, self.most, self.bytes = make, most, 0

    def learn(self, wanted: set) -> None:
        """Afterwards all of `wanted` are there."""
        if self.bytes > self.most:
            self.clear()
            self.bytes = 0
        new = [w for w in wanted if w not in self]
        if new:
            self.update(zip(new, self.make(new), strict=True))
            self.bytes += ENTRY_BYTES * len(new) + sum(map(len, new))
