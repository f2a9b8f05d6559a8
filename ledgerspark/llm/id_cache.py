"""Token ids of strings, remembered by Python workers within a bound."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from itertools import islice

import numpy as np


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: a byte that prints is itself, the others follow at 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class _Numbered(defaultdict):
    """Numbers its keys in the order they are first asked for."""

    def __init__(self, keys=()):
        super().__init__()
        self.default_factory = self.__len__
        for k in keys:
            self[k]


class IdCache:
    """Ids of strings. ``encode`` gives the ids of new ones end to end, and how many each has. A worker keeps its
    cache from task to task; beyond ``limit`` strings, ``trim`` keeps the half that was used most."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int):
        self.encode, self.limit = encode, limit
        self.number = _Numbered()
        self.flat, self.start, self.used = np.empty(0, np.int32), np.zeros(1, np.int64), np.empty(0, np.int64)

    def numbers(self, strings: list[str], times: np.ndarray | None = None) -> np.ndarray:
        """Numbers of the strings; ``times``: how often each of these (then distinct) strings is about to be used."""
        had = len(self.number)
        got = np.fromiter(map(self.number.__getitem__, strings), np.int64, len(strings))
        if len(self.number) > had:
            flat, size = self.encode(list(islice(self.number, had, None)))
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(size)])
            self.used = np.concatenate([self.used, np.zeros(len(self.number) - had, np.int64)])
        if times is None:
            self.used += np.bincount(got, minlength=len(self.used))
        else:
            self.used[got] += times
        return got

    def hold(self, string: str) -> None:
        """A string without ids."""
        self.number[string]
        self.start, self.used = np.append(self.start, self.start[-1]), np.append(self.used, 1 << 60)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered strings end to end, and how many each has."""
        first = self.start[rows]
        size = self.start[rows + 1] - first
        shift = np.cumsum(size) - size
        return self.flat[np.arange(int(size.sum())) + np.repeat(first - shift, size)], size

    def trim(self) -> None:
        """Forget the least used strings beyond the limit; numbers given before are void."""
        if len(self.number) <= self.limit:
            return
        kept = np.sort(np.argpartition(-self.used, self.limit // 2)[:self.limit // 2])
        flat, size = self.take(kept)
        keys = list(self.number)
        self.number.default_factory = None  # refers to the strings it numbers: they would stay until a garbage collection
        self.number = _Numbered(keys[k] for k in kept.tolist())
        self.flat, self.start, self.used = flat, np.concatenate([[0], np.cumsum(size)]), self.used[kept] // 2
