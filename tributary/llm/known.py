"""What a Python worker keeps from task to task: a cache of bounded size in two generations."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa

_kept: dict = {}


def kept(make: Callable, *key):
    """The object that ``make(*key)`` made first in this process; workers are used for many tasks, and one text is as good as another."""
    at = (make, *key)
    if at not in _kept:
        _kept[at] = make(*key)
    return _kept[at]


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for a task's batches; behind it the worker, which stays for later tasks, gives the memory back that it no longer uses."""

    @wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not this C library
                pass

    return tidied


class Known(dict):
    """At most ``2 * most`` entries, plus those of one call: when one generation is full, the one before is forgotten."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.before = most, {}

    def missing(self, names: Iterable) -> list:
        """Of ``names`` those without an entry; entries of the last generation are taken over."""
        if len(self) > self.most:
            self.before = dict(self)
            self.clear()
        found = []
        for name in (names if isinstance(names, set) else set(names)).difference(self):
            value = self.before.get(name)
            if value is None:
                found.append(name)
            else:
                self[name] = value
        return found
