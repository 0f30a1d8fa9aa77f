"""Shared pools by normalised root: one entry per root, however many rules name it."""

from __future__ import annotations

import posixpath
import threading
from dataclasses import dataclass, field
from typing import Any


@dataclass
class Pool:
    """A root: how many use it, and the listed files of its tables, which reads go through."""

    key: str
    references: int = 0
    tables: dict[str, Any] = field(default_factory=dict)


def pool_key(root: str) -> str:
    """A root without doubled or trailing slashes, so that equal roots share a pool."""
    scheme, sep, path = root.partition("://")
    return scheme + sep + posixpath.normpath(path) if sep else posixpath.normpath(root)


class PoolRegistry:
    """Counts who uses a root; what is cached for it is dropped with its last user."""

    def __init__(self):
        self._pools: dict[str, Pool] = {}
        self._others: dict[str, Pool] = {}
        #: Whole tables by name and roots, put together from the pools.
        self.whole: dict[tuple, Any] = {}
        self._lock = threading.Lock()

    def get_or_create(self, root: str) -> Pool:
        key = pool_key(root)
        with self._lock:
            pool = self._pools.setdefault(key, Pool(key))
            pool.references += 1
            return pool

    def release(self, root: str) -> None:
        key = pool_key(root)
        with self._lock:
            pool = self._pools.get(key)
            if pool is None:
                return
            pool.references -= 1
            if pool.references <= 0:
                del self._pools[key]
                self.whole = {}

    def pool(self, root: str) -> Pool:
        """The pool of a root that somebody uses; a pool of its own for one that nobody does (the default root)."""
        key = pool_key(root)
        with self._lock:
            return self._pools.get(key) or self._others.setdefault(key, Pool(key))

    def forget(self, table: str) -> None:
        """Drop the listed files of a table in all pools."""
        with self._lock:
            for pool in (*self._pools.values(), *self._others.values()):
                pool.tables.pop(table, None)
            self.whole = {k: x for k, x in self.whole.items() if k[0] != table}

    def stats(self) -> dict[str, int]:
        """References by root."""
        with self._lock:
            return {k: p.references for k, p in self._pools.items()}

    def count(self) -> int:
        return len(self._pools)
