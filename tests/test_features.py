import datetime as dt
import random

import pytest

from shardloom.operators import features
from shardloom.operators.features import feature_table, kinds_of

SCHEMA = "id bigint, user bigint, kind string, at timestamp_ntz, v double, n int, entity string"
NOW = dt.datetime(2026, 3, 1)


def rows_of(seed):
    r = random.Random(seed)
    rows = [(None if r.random() < 0.05 else i, r.choice([5] * 9 + [1, 2, None]), r.choice([f"k{j}" for j in range(12)] + [None, ""]), None if r.random() < 0.1 else dt.datetime(2026, 1, 1) + dt.timedelta(seconds=r.randrange(10**6)), None if r.random() < 0.1 else float(r.randrange(100)), 1, "e") for i in range(500)]
    return rows + [x for x in rows if x[0] is not None and r.random() < 0.2]


def brute(rows):
    seen, out = set(), {}
    for i, user, kind, at, v, *_ in rows:
        if user is None or not kind or i is not None and i in seen:
            continue
        seen.add(i)
        n, total, last = out.setdefault(user, {}).get(kind, (0, 0.0, None))
        out[user][kind] = (n + 1, total + (v or 0), at if last is None or at is not None and at > last else last)
    return out


@pytest.mark.parametrize("combine", [50, features.COMBINE_ROWS])
def test_map_layout(spark, monkeypatch, combine):
    monkeypatch.setattr(features, "COMBINE_ROWS", combine)
    rows = rows_of(combine)
    got = feature_table(spark.createDataFrame(rows, SCHEMA), "user", "kind", "at", "id", "v", NOW).collect()
    want = brute(rows)
    assert {r.entity: {k: (c.n, c.total, c.last_at) for k, c in r.features.items()} for r in got} == want
    for r in got:
        cells = want[r.entity].values()
        assert (r.events, r.types, r.total) == (sum(c[0] for c in cells), len(cells), sum(c[1] for c in cells))
        assert r.last_at == max((c[2] for c in cells if c[2]), default=None)
        assert all(c.recency_s == (None if c.last_at is None else (NOW - c.last_at).total_seconds()) for c in r.features.values())


def test_hot_entities_are_merged_by_groups_of_types(spark, monkeypatch):
    """The split of a hot entity changes no result, in either layout."""
    monkeypatch.setattr(features, "COMBINE_ROWS", 40)
    rows = rows_of(11)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    kinds = kinds_of(df, "kind")
    run = lambda k: sorted(map(str, feature_table(df, "user", "kind", "at", "id", "v", NOW, k).collect()))
    flat = lambda: {r.entity: {k: (c.n, c.total, c.last_at) for k, c in r.features.items()} for r in feature_table(df, "user", "kind", "at", "id", "v", NOW).collect()}
    want = run(kinds)
    monkeypatch.setattr(features, "HOT_ROWS", 60)
    assert run(kinds) == want and flat() == brute(rows)


def test_deliveries_that_differ(spark):
    """Each column takes the largest non-null value of an id's rows, whatever their order; text ids work too."""
    rows = [("a", 1, "k", None, 3.0, 0, ""), ("a", 1, None, dt.datetime(2026, 1, 2), None, 0, ""), ("a", 1, "", dt.datetime(2026, 1, 1), 1.0, 0, ""), (None, 1, "k", None, 1.0, 0, ""), (None, 1, "k", None, 1.0, 0, "")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, SCHEMA.replace("id bigint", "id string")).coalesce(1)
        got = feature_table(df, "user", "kind", "at", "id", "v").collect()
        assert [(r.entity, {k: (c.n, c.total, c.last_at) for k, c in r.features.items()}) for r in got] == [(1, {"k": (3, 5.0, dt.datetime(2026, 1, 2))})]


def test_wide_layout(spark):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, SCHEMA)
    kinds = kinds_of(df, "kind")
    assert kinds == sorted({k for u in brute(rows).values() for k in u} | {r[2] for r in rows if r[2]})
    got = feature_table(df, "user", "kind", "at", "id", "v", NOW, kinds[:-1]).collect()
    want = brute(rows)
    assert {r.entity for r in got} == want.keys()
    for r in got:
        for k in kinds[:-1]:
            assert (r[f"n_{k}"], r[f"total_{k}"], r[f"last_{k}"]) == want[r.entity].get(k, (0, 0.0, None))
            assert r[f"recency_{k}"] == (None if r[f"last_{k}"] is None else (NOW - r[f"last_{k}"]).total_seconds())
        assert r.events == sum(c[0] for c in want[r.entity].values())


def test_limits_and_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert feature_table(df, "user", "kind", "at", "id").collect() == [] and kinds_of(df, "kind") == []
    with pytest.raises(ValueError):
        kinds_of(spark.createDataFrame(rows_of(1), SCHEMA), "kind", most=3)
