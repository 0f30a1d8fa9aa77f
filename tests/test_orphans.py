import datetime as dt
import random

import numpy as np

from shardloom.operators import orphans as O

REF = "id bigint, user bigint, at timestamp_ntz, key string, n int"
CHANGE = "cid bigint, user bigint, kind string, at timestamp_ntz"


def time(r):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=r.randrange(364), seconds=r.randrange(86400))


def exists(user, at, users, changes):
    mine = sorted((c[3], c[2].strip().lower()) for c in {c[0]: c for c in changes}.values() if c[1] == user and c[3] is not None)
    if at is None:
        return user in users
    before = [k for t, k in mine if t <= at]
    if before:
        return before[-1] != "delete"
    return mine[0][1] != "create" if mine else user in users


def test_equals_brute_force(spark):
    r = random.Random(4)
    keys = [1, 2, 3, 65_535, 65_536, 70_000, -5, -70_000, 1 << 40, 9, 10, 11]
    users = [1, 2, 65_535, 70_000, -5, 9, 9]
    changes = [(i, r.choice(keys[:-1]), r.choice(["create", " Delete", "restore\t", "DELETE"]), time(r)) for i in range(40)]
    changes += changes[:5] + [(99, None, "delete", time(r)), (98, 3, "delete", None)]
    tables = {n: [(None if r.random() < 0.02 else i, r.choice(keys + [0, None]), None if r.random() < 0.1 else time(r), "x", 1) for i in range(500)] for n in ("a", "b")}
    for t in tables.values():
        t += [x for x in t[:40] if x[0] is not None]
    got = O.orphans([(n, spark.createDataFrame(t, REF), "id", "user", "at") for n, t in tables.items()], spark.createDataFrame([(u,) for u in users], "uid bigint"), "uid", (spark.createDataFrame(changes, CHANGE), "user", "kind", "at", "cid"), no_key=0)
    want = sorted({(n, *x[:3]) for n, t in tables.items() for x in t if x[0] is not None and x[1] not in (0, None) and not exists(x[1], x[2], users, changes)})
    want_null = [(n, x[1]) for n, t in tables.items() for x in t if x[0] is None and x[1] not in (0, None) and not exists(x[1], x[2], users, changes)]
    rows = got.collect()
    key = lambda x: (x[0], x[1])
    assert sorted(((x.table_name, x.row_id, x.key, x["at"]) for x in rows if x.row_id is not None), key=key) == sorted(want, key=key)
    assert sorted((x.table_name, x.key) for x in rows if x.row_id is None) == sorted(want_null)
    report = {(x.table_name, x.month): (x.orphan_rows, x.orphan_keys) for x in O.orphan_report(got).collect()}
    assert sum(n for n, _ in report.values()) == len(rows)
    for (t, m), (n, k) in report.items():
        here = [x for x in rows if x.table_name == t and (f"{x['at']:%Y-%m}" if x["at"] else None) == m]
        assert (n, k) == (len(here), len({x.key for x in here}))


def test_text_keys(spark):
    ref = spark.createDataFrame([(1, "a", dt.datetime(2026, 2, 1)), (2, "b", dt.datetime(2026, 2, 1)), (3, "c", dt.datetime(2026, 2, 1)), (4, "", None), (5, None, None), (6, "c", dt.datetime(2026, 4, 1))], "id bigint, key string, at timestamp_ntz")
    changes = spark.createDataFrame([(1, "c", "delete", dt.datetime(2026, 3, 1)), (2, "zz", "create", dt.datetime(2026, 3, 1))], "cid bigint, key string, kind string, at timestamp_ntz")
    users = spark.createDataFrame([("a",), ("c",)], "uid string")
    got = O.orphans([("t", ref, "id", "key", "at")], users, "uid", (changes, "key", "kind", "at", "cid"), no_key="").collect()
    assert sorted((r.row_id, r.key) for r in got) == [(2, "b"), (6, "c")]


def test_empty_tables(spark):
    none, changes = spark.createDataFrame([], REF), spark.createDataFrame([], CHANGE)
    users, some = spark.createDataFrame([], "uid bigint"), spark.createDataFrame([(7, 5, dt.datetime(2026, 1, 1), "", 0), (8, 5, None, "", 0)], REF)
    run = lambda t: O.orphans([("t", t, "id", "user", "at")], users, "uid", (changes, "user", "kind", "at", "cid")).collect()
    assert run(none) == [] and sorted(r.row_id for r in run(some)) == [7, 8]
    assert O.orphan_report(O.orphans([("t", none, "id", "user", "at")], users, "uid", (changes, "user", "kind", "at", "cid"))).collect() == []


def test_containers_round_trip(spark):
    r = np.random.default_rng(1)
    keys = np.unique(np.concatenate([r.integers(0, 65_536, 9_000), 65_536 + r.integers(0, 65_536, 50), -r.integers(1, 99, 20)]))
    df = spark.createDataFrame([(O.REFERENCE, 3, int(k)) for k in keys for _ in range(2)], "what int, period int, key bigint").coalesce(1)
    of = O.Places(16)
    packed = df.mapInArrow(O._containers(of), O._CONTAINER).collect()
    assert {p.places[:1] for p in packed} == {b"a", b"b"}
    back = sorted(int(k) for p in packed for k in of.keys(p.key_range, of.unpacked(bytes(p.places))))
    assert sorted(set(back)) == keys.tolist()


def test_places_are_sets():
    r = np.random.default_rng(2)
    for shift in (16, 30, 48):
        of = O.Places(shift)
        for n, m in ((0, 5), (5, 0), (50, 9_000), (9_000, 50), (20_000, 20_000)):
            a, b = (np.unique(r.integers(0, min(1 << shift, 65_536), k)).astype(of.kind) for k in (n, m))
            x, y = of.unpacked(of.packed(a)), of.unpacked(of.packed(b))
            assert set(of.listed(of.either([x, y])).tolist()) == set(a.tolist()) | set(b.tolist())
            assert set(of.listed(of.without(x, y)).tolist()) == set(a.tolist()) - set(b.tolist())
    assert O.Places.of(1_000, 1, 1_000).shift == 16 and O.Places.of(65_536, 0, 1 << 62).shift > 40 and O.Places.of(1, -(1 << 63), (1 << 63) - 1).shift == 48


def test_sparse_keys_and_both_joins(spark, monkeypatch):
    """Hashed keys give the orphans that dense ones give, however the surviving keys meet their rows."""
    r = random.Random(3)
    h = lambda k: (k * 0x9E3779B97F4A7C15 + 77) % (1 << 64) - (1 << 63)
    at = lambda: dt.datetime(2026, 1, 1) + dt.timedelta(days=r.randrange(300))
    refs, users = [(i, r.choice([3, r.randrange(900)]), at()) for i in range(900)], [(k,) for k in range(0, 900, 2)]
    changes = [(i, r.randrange(900), r.choice(["delete", "create"]), at()) for i in range(300)]

    def run(code):
        one = spark.createDataFrame([(i, code(k), t) for i, k, t in refs], "id bigint, user bigint, at timestamp_ntz")
        ch = spark.createDataFrame([(i, code(k), x, t) for i, k, x, t in changes], "cid bigint, user bigint, kind string, at timestamp_ntz")
        return sorted(x.row_id for x in O.orphans([("t", one, "id", "user", "at")], spark.createDataFrame([(code(k),) for k, in users], "uid bigint"), "uid", (ch, "user", "kind", "at", "cid")).collect())

    dense = run(lambda k: k)
    assert dense and dense == run(h)
    monkeypatch.setattr(O, "MOST_CASES", 0)
    assert dense == run(h)


def test_dictionary(spark):
    d = O.dictionary(spark.createDataFrame([("b",), ("a",), ("a",), (None,), ("",)], "k string"), "k").collect()
    assert {r.k for r in d} == {"", "a", "b"} and len({r.code for r in d}) == 3
