"""Read and write splitting: operations, policies that choose among sources or replicas, and router lookup."""

from __future__ import annotations

import enum
import itertools
import logging
import random
import threading
from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ShardingError
from ..operators.common import numbered

log = logging.getLogger("shardloom")


class Operation(enum.Enum):
    READ = "read"
    WRITE = "write"


class Policy(Protocol):
    def pick(self, n: int) -> int:
        """One of n candidates, from 0."""


class RandomPolicy:
    """Uniformly random; a seed makes it repeatable."""

    def __init__(self, seed: int | None = None):
        self.seed, self._random = seed, random.Random(seed)

    def pick(self, n):
        return self._random.randrange(n)

    def expr(self, n: int) -> Column:
        return F.floor(F.rand(self.seed) * n).cast("int")


class RoundRobinPolicy:
    """One after the other; the first pick is candidate 1."""

    def __init__(self):
        self._turn = itertools.count(1)

    def pick(self, n):
        return next(self._turn) % n

    @staticmethod
    def assign(df: DataFrame, n: int, *order: str, name: str = "pick") -> DataFrame:
        """Batch form: ``df`` with the picks of its rows taken in ``order``, without one task seeing them all."""
        return numbered(df, *order, name=name).withColumn(name, (F.col(name) + 1) % n)


class StrictRoundRobinPolicy(RoundRobinPolicy):
    """Round robin that is exact under concurrent use."""

    def __init__(self):
        super().__init__()
        self._lock = threading.Lock()

    def pick(self, n):
        with self._lock:
            return super().pick(n)


class PolicyFunc:
    """A policy from a function."""

    def __init__(self, function: Callable[[int], int]):
        self.pick = function


def select_pool(router, op: Operation, default_root: str) -> tuple[str, str]:
    """Root and label (``source`` or ``replica``) of an operation: reads take replicas, or sources where there are none;
    writes take sources, or the default root where there are none."""
    sources = list(router.sources) or [default_root]
    if op is Operation.READ and router.replicas:
        pools, policy, label = list(router.replicas), router.replica_policy, "replica"
    else:
        pools, policy, label = sources, router.source_policy if op is Operation.WRITE else router.replica_policy, "source" if op is Operation.WRITE else "replica"
    if len(pools) == 1:
        return pools[0], label
    i = policy.pick(len(pools))
    if not 0 <= i < len(pools):
        raise ShardingError(f"a policy picked {i} of {len(pools)}")
    return pools[i], label


def find_router(routers: Sequence, use: str | None = None, table: str | None = None):
    """Precedence: the router named by ``use``, then one that serves ``table``, then one without a table list."""
    if use is not None:
        for r in routers:
            if r.name == use:
                return r
        raise ShardingError(f"no router is called {use}")
    for r in routers:
        if table and table.lower() in {t.lower() for t in r.tables}:
            return r
    free = [r for r in routers if not r.tables]
    return free[0] if free else None


def labelled(label: str, sql: str) -> str:
    """A statement as it is logged; without a label it stands alone."""
    return f"[{label}] {sql}" if label else sql


def trace(label: str, sql: str, error: Exception | None = None) -> None:
    """Log a statement with the pool it went to and the error it met."""
    if error is None:
        log.info(labelled(label, sql))
    else:
        log.error("%s: %s", labelled(label, sql), error)
