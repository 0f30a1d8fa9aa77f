import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shardloom.operators import skew
from shardloom.operators.skew import heavy_keys, keyed_results

SCHEMA = "id bigint, k string, v decimal(10,2), bin int, n int"


def brute(rows, quantiles):
    seen, by = set(), {}
    for i, k, v, *_ in rows:
        if i is None or i not in seen:
            seen.add(i)
            by.setdefault(k, []).append(v)
    total = sum(map(len, by.values()))
    out = {}
    for k, vs in by.items():
        v = sorted(x for x in vs if x is not None)
        pick = [v[max(1, math.ceil(q * len(v) - 1e-9)) - 1] if v else None for q in quantiles]
        out[k] = (len(vs), len(v), sum(v) if v else None, min(v, default=None), max(v, default=None), *pick, len(vs) / total)
    return out


def test_equals_brute_force(spark):
    r = random.Random(8)
    rows = [(None if r.random() < 0.03 else i, r.choice(["hot"] * 20 + ["a", "b", "", None, "only_null"]), None if r.random() < 0.1 else Decimal(r.choice([r.randrange(-(10**9), 10**9), r.randrange(-300, 300), 5])) / 100, 0, 0) for i in range(800)]
    rows = [(i, k, None if k == "only_null" else v, b, n) for i, k, v, b, n in rows] + [rows[3], rows[5]]
    rows = [x for j, x in enumerate(rows) if j < 800 or x[0] is not None]
    got = keyed_results(spark.createDataFrame(rows, SCHEMA), "k", "v", (0.0, 0.25, 0.5, 0.9, 1.0), "id", 0.1).collect()
    want = brute(rows, (0.0, 0.25, 0.5, 0.9, 1.0))
    assert {r.key: tuple(r)[1:-1] for r in got} == {k: v[:-1] + (pytest.approx(v[-1]),) for k, v in want.items()}
    assert {r.key for r in got if r.heavy} == {k for k, v in want.items() if v[-1] > 0.1}


@pytest.mark.parametrize("kind, values", [("bigint", [-(1 << 63), (1 << 63) - 1, 0, -1, 1, 1 << 40]), ("int", [-5, 3, 3, 2**31 - 1]), ("tinyint", [-128, 127, 0])])
def test_extremes(spark, kind, values):
    df = spark.createDataFrame([(1, int(v)) for v in values], "k int, v bigint").selectExpr("k", f"cast(v as {kind}) as v")
    r = keyed_results(df, "k", "v", (0.5,)).first()
    assert (r.q50, r.least, r.most, int(r.total)) == (sorted(values)[math.ceil(len(values) / 2) - 1], min(values), max(values), sum(values))


def test_empty_and_types(spark):
    assert keyed_results(spark.createDataFrame([], SCHEMA), "k", "v", ident="id").collect() == []
    with pytest.raises(TypeError):
        keyed_results(spark.createDataFrame([], "k int, v double"), "k", "v")


@pytest.mark.parametrize("cold", [0, 5, 1_000_000])
def test_hot_and_cold_keys_agree(spark, monkeypatch, cold):
    """Whatever counts as hot, the ranks are the same."""
    monkeypatch.setattr(skew, "COLD_ROWS", cold)
    r = random.Random(cold)
    rows = [(i, r.choice(["hot"] * 9 + ["b", "c", None]), Decimal(r.choice([r.randrange(-(10**9), 10**9), r.randrange(5)])) / 100, 0, 0) for i in range(400)]
    got = keyed_results(spark.createDataFrame(rows, SCHEMA), "k", "v", (0.0, 0.5, 1.0), "id").collect()
    assert {x.key: tuple(x)[1:-1] for x in got} == {k: v[:-1] + (pytest.approx(v[-1]),) for k, v in brute(rows, (0.0, 0.5, 1.0)).items()}


def test_bins_bound_the_shuffle(spark):
    """A pass sends at most 256 rows per range and task, however many different values a key has."""
    rows = spark.range(0, 40_000, 1, 4).select(F.lit(1).alias("key"), (F.col("id") * 7_919 % 40_009).alias("v"))
    state = spark.createDataFrame([(1, 0, 20_000, 0, 40_008), (1, 1, 39_000, 0, 40_008)], "key int, q int, rank bigint, lo bigint, hi bigint")
    want = sorted(i * 7_919 % 40_009 for i in range(40_000))
    assert {x.q: x.lo for x in skew.resolve_ranks(rows, state).collect()} == {0: want[19_999], 1: want[38_999]}


@pytest.mark.parametrize("share", [0.05, 0.2, 0.34])
def test_heavy_keys(spark, share):
    r = random.Random(1)
    rows = [(i, r.choice(["a"] * 30 + ["b"] * 10 + [None] * 8 + [""] * 2 + [str(r.randrange(300))] * 20)) for i in range(900)]
    counts = {k: sum(x == k for _, x in rows) for k in {x for _, x in rows}}
    got = heavy_keys(spark.createDataFrame([*rows, *rows[:50], (None, "b")], "id int, k string"), "k", share, "id").collect()
    counts["b"] += 1
    assert {x.key: x.rows for x in got} == {k: n for k, n in counts.items() if n > share * 901}
    exact = spark.createDataFrame([(k,) for k in "aabbccddee"], "k string")
    assert heavy_keys(exact, "k", 0.2).collect() == [] and {x.key for x in heavy_keys(exact, "k", 0.19).collect()} == set("abcde")
    assert heavy_keys(exact.limit(0), "k", 0.2).collect() == []
