import datetime as dt
import random

import pytest

from shardloom.operators.sessions import sessions

SCHEMA = "id bigint, user string, at timestamp_ntz, kind string, entity int, chunk int"


def brute(rows, gap):
    seen, by = set(), {}
    for i, user, at, kind, *_ in rows:
        if user is None or at is None or i is not None and (user, at, i) in seen:
            continue
        seen.add((user, at, i))
        by.setdefault(user, []).append((at, kind))
    out = []
    for user, events in by.items():
        events.sort(key=lambda e: e[0])
        for k, (at, kind) in enumerate(events):
            if k and (at - events[k - 1][0]).total_seconds() <= gap:
                out[-1][2], out[-1][3] = at, out[-1][3] + 1
                out[-1][4].add(kind)
            else:
                out.append([user, at, at, 1, {kind}])
    return sorted((u, s, e, int((e - s).total_seconds()), n, len(k - {None})) for u, s, e, n, k in out)


@pytest.mark.parametrize("chunk", [600, 86_400])
def test_equals_brute_force(spark, chunk):
    r = random.Random(chunk)
    t = dt.datetime(2026, 1, 1, 22)
    rows = []
    for i in range(600):
        user = r.choice(["a"] * 5 + ["b", "", None])
        at = None if r.random() < 0.03 else t + dt.timedelta(seconds=int(r.random() * 40_000) // 60 * 60)
        rows.append((None if r.random() < 0.05 else i, user, at, r.choice(["x", "y", None, "z"]), 1, 2))
    rows += [x for x in rows if r.random() < 0.1 and x[0] is not None]
    got = sessions(spark.createDataFrame(rows, SCHEMA), "user", "at", 60, "id", "kind", chunk).collect()
    assert sorted(map(tuple, got)) == brute(rows, 60)
    plain = sessions(spark.createDataFrame(rows, SCHEMA), "user", "at", 60, "id", chunk_seconds=chunk)
    assert sorted(map(tuple, plain.collect())) == [x[:5] for x in brute(rows, 60)]


def test_gap_is_inclusive_and_ties_join(spark, at):
    rows = [(1, "a", at(0), None, 0, 0), (2, "a", at(30), "k", 0, 0), (3, "a", at(61), "k", 0, 0), (4, "a", at(61), "k", 0, 0), (4, "a", at(61), "K", 0, 0)]
    got = sessions(spark.createDataFrame(rows, SCHEMA), "user", "at", 1800, "id", "kind").orderBy("start_at").collect()
    assert [(r.duration_s, r.events, r.kinds) for r in got] == [(1800, 2, 1), (0, 2, 1)]


def test_empty(spark):
    assert sessions(spark.createDataFrame([], SCHEMA), "user", "at", 60, "id", "kind").collect() == []


def test_kinds_do_not_depend_on_the_order_of_arrival(spark, at):
    """Of two deliveries of one record, one without kind, the other's kind counts."""
    rows = [(1, 5, at(0), "view"), (1, 5, at(0), None), (2, 5, at(3), None), (2, 5, at(3), "buy"), (2, 5, at(3), "view")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "id bigint, u bigint, t timestamp_ntz, k string").coalesce(1)
        assert [(r.events, r.kinds) for r in sessions(df, "u", "t", 1800, "id", "k").collect()] == [(2, 1)]
