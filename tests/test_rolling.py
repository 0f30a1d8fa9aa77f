import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shardloom.operators import rolling
from shardloom.operators.rolling import rolling_totals, two_stack

UNTIL = dt.date(2026, 3, 1)
SCHEMA = "id bigint, user bigint, at timestamp_ntz, amount decimal(10,2), entity string, day string"


@settings(max_examples=80, deadline=None)
@given(values=st.lists(st.integers(-50, 50), max_size=40), span=st.integers(1, 12))
def test_two_stack_equals_plain_windows(values, span):
    x = np.array(values, dtype=np.int64)
    for op, identity, plain in ((np.add, 0, sum), (np.minimum, 10**9, min), (np.maximum, -(10**9), max)):
        assert two_stack(x, span, op, identity).tolist() == [plain(values[max(0, i - span + 1) : i + 1]) for i in range(len(values))]


def rows_of(seed, n=150):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        user = r.choice([1, 1, 1, 2, 3, None, 77])
        at = None if r.random() < 0.05 else dt.datetime(2026, 1, 1) + dt.timedelta(days=int(r.random() ** 2 * 70), seconds=r.randrange(86400))
        amount = None if r.random() < 0.1 else Decimal(r.randrange(-5000, 90000)) / 100
        rows.append((None if r.random() < 0.05 else i, user, at, amount, "x", "y"))
    return rows + [x for x in rows if x[0] is not None and r.random() < 0.1]


def brute(rows, spans, until, active):
    seen, daily = set(), {}
    for i, user, at, amount, *_ in rows:
        if user is None or at is None or at.date() > until or i is not None and i in seen:
            continue
        seen.add(i)
        daily.setdefault(user, {}).setdefault(at.date(), []).append(amount)
    out = {}
    for user, days in daily.items():
        d = min(days)
        while d <= until:
            row = [len(days.get(d, []))]
            for s in spans:
                got = [a for k in range(s) for a in days.get(d - dt.timedelta(days=k), [])]
                v = [a for a in got if a is not None]
                row += [len(got), len(v), sum(v, Decimal(0)), float(sum(v)) / len(v) if v else None, min(v, default=None), max(v, default=None)]
            if not active or row[-6]:
                out[user, d] = row
            d += dt.timedelta(days=1)
    return out


@pytest.mark.parametrize("emit", ["calendar", "active"])
@pytest.mark.parametrize("dense", [40, rolling.DENSE_DAYS])
def test_equals_brute_force(spark, monkeypatch, emit, dense):
    monkeypatch.setattr(rolling, "DENSE_DAYS", dense)
    rows = rows_of(dense)
    got = rolling_totals(spark.createDataFrame(rows, SCHEMA), "user", "at", "amount", (3, 10), "id", UNTIL, emit).collect()
    mine = {(r[0], r[1]): list(r)[2:] for r in got}
    want = brute(rows, (3, 10), UNTIL, emit == "active")
    assert len(got) == len(mine) and mine.keys() == want.keys()
    for k, w in want.items():
        assert [float(x) if isinstance(x, Decimal) else x for x in mine[k]] == pytest.approx([float(x) if isinstance(x, Decimal) else x for x in w])


def test_text_keys_doubles_and_no_ids(spark):
    day = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([("a", day, 1.5), ("a", day, 1.5), ("a", day + dt.timedelta(days=2), -0.5), ("", day, None)], "k string, at timestamp_ntz, v double")
    got = {(r.entity, r.day.day): (r.rows_2, r.total_2, r.least_2) for r in rolling_totals(df, "k", "at", "v", (2,), emit="active").collect()}
    assert got == {("a", 1): (2, 3.0, 1.5), ("a", 2): (2, 3.0, 1.5), ("a", 3): (1, -0.5, -0.5), ("a", 4): (1, -0.5, -0.5), ("", 1): (1, 0.0, None), ("", 2): (1, 0.0, None)}


def test_empty_and_wrong_parameters(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rolling_totals(empty, "user", "at", "amount", until=UNTIL).count() == 0
    for kw in ({}, {"emit": "x", "until": UNTIL}, {"spans": (0,), "until": UNTIL}):
        with pytest.raises(ValueError):
            rolling_totals(empty, "user", "at", "amount", **kw)


def test_overflow_is_an_error(spark):
    big = (1 << 62) + 5
    df = spark.createDataFrame([(1, dt.datetime(2026, 1, d), v) for d, v in ((1, big), (3, big), (20, -big), (22, big))], "u bigint, t timestamp_ntz, v bigint")
    run = lambda x, *spans: rolling_totals(x, "u", "t", "v", spans, until=dt.date(2026, 2, 1), emit="active").collect()
    with pytest.raises(Exception, match="does not fit 64 bits"):
        run(df, 2, 7)
    assert max(r.total_7 for r in run(df.where("v < 0 or day(t) > 10"), 7)) == big and max(r.total_2 for r in run(df, 2)) == big
