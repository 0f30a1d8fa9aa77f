import datetime as dt
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardloom.errors import InvalidKey, ShardingError
from shardloom.functions import strategies as S

# mappings, bounds, inputs and suffixes below are fixed values
CITY = S.EnumStrategy({"beijing": "_bj", "shanghai": "_sh", "guangzhou": "_gz"}, "_other")
RANGE = S.RangeStrategy([0, 1000, 5000, 10000])


@pytest.mark.parametrize("value, suffix", [("beijing", "_bj"), ("shanghai", "_sh"), ("guangzhou", "_gz"), ("shenzhen", "_other")])
def test_enum(value, suffix):
    assert CITY.suffix(value) == suffix


def test_enum_refuses_numbers_and_unknown():
    with pytest.raises(InvalidKey):
        CITY.suffix(123)
    with pytest.raises(ShardingError):
        S.EnumStrategy({"a": "_a"}).suffix("b")
    assert S.EnumStrategy({"a": ""}, "_x").suffix("a") == ""


def test_date():
    when = dt.datetime(2026, 3, 22, 10)
    assert S.DateStrategy("20060102").suffix(when) == "_20260322"
    assert S.DateStrategy("200601").suffix(when) == "_202603"
    assert S.DateStrategy().suffix("2026-03-22T10:00:00Z") == "_20260322"
    assert S.DateStrategy().suffix(1711094400) == "_20240322"
    assert S.DateStrategy().suffix("2026-03-22T03:30:00+08:00") == "_20260322"
    for wrong in ("2026-03-22", 1.5, None, True):
        with pytest.raises(ShardingError):
            S.DateStrategy().suffix(wrong)
    with pytest.raises(ShardingError):
        S.DateStrategy("Jan 2006")


@pytest.mark.parametrize("value, suffix", [(0, "_0"), (999, "_0"), (1000, "_1"), (4999, "_1"), (5000, "_2"), (9999, "_2"), (10000, "_3"), (15000, "_3"), (-100, "_0")])
def test_range(value, suffix):
    assert RANGE.suffix(value) == suffix


def test_range_names_and_checks():
    assert S.RangeStrategy([0, 100, 500], lambda i: f"_range_{i}").suffix(150) == "_range_1"
    for bounds in ([], [5, 1], [1, 1]):
        with pytest.raises(ShardingError):
            S.RangeStrategy(bounds)
    with pytest.raises(InvalidKey):
        RANGE.suffix("5")


def test_hash():
    h = S.HashStrategy(10)
    assert (h.suffix(123), h.suffix(-123), h.suffix("user123"), h.suffix("123"), h.suffix(-3.9)) == ("_3", "_3", "_7", "_2", "_3")
    assert [S.crc32(x) for x in ("user123", "123", "北京")] == [1231517047, 2286445522, 3429596817]
    for wrong in (None, True, b"x"):
        with pytest.raises(ShardingError):
            h.suffix(wrong)
    with pytest.raises(ShardingError):
        S.HashStrategy(0)


def test_padded():
    assert [S.padded_format(n) for n in (1, 9, 10, 100, 1000)] == ["_%01d", "_%01d", "_%02d", "_%03d", "_%04d"]
    for n in (0, 10_000):
        with pytest.raises(ShardingError):
            S.padded_format(n)
    p = S.PaddedModulo(10)
    assert (p.suffix(7), p.suffix(-3), p.suffix("+12"), p.suffix(" 12 ")) == ("_07", "_-3", "_02", f"_{zlib.crc32(b' 12 ') % 10:02d}")
    with pytest.raises(InvalidKey):
        p.suffix(1.5)


@pytest.mark.parametrize("suffix, index", [("", 0), ("_0", 0), ("_07", 7), ("_bj", 0), ("_-3", -3), ("12", 12), ("_12.5", 0), ("__4", 0)])
def test_suffix_to_index(suffix, index):
    assert S.suffix_to_index(suffix) == index


def same(spark, strategy, values, kind):
    rows = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("k", kind)]))
    got = [r[0] for r in rows.select(strategy.expr(F.col("k"), kind)).collect()]
    assert got == [strategy.suffix(v) for v in values]


longs = st.lists(st.integers(-(1 << 63), (1 << 63) - 1), min_size=1, max_size=30)
texts = st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00"), max_size=12) | st.from_regex(r"[+-]?[0-9]{1,20}", fullmatch=True), min_size=1, max_size=30)


@settings(max_examples=8, deadline=None)
@given(numbers=longs, words=texts, floats=st.lists(st.floats(-1e15, 1e15), min_size=1, max_size=20))
def test_expressions_equal_twins(spark, numbers, words, floats):
    for s in (S.HashStrategy(7), S.PaddedModulo(37), RANGE, S.NoSharding()):
        same(spark, s, numbers, T.LongType())
    for s in (S.HashStrategy(7), S.PaddedModulo(37), CITY):
        same(spark, s, words, T.StringType())
    for s in (S.HashStrategy(7), RANGE):
        same(spark, s, floats, T.DoubleType())


@settings(max_examples=5, deadline=None)
@given(times=st.lists(st.datetimes(dt.datetime(1900, 1, 1), dt.datetime(2200, 1, 1)), min_size=1, max_size=20))
def test_dates_equal_twins(spark, times):
    for layout in ("20060102", "200601", "2006-01-02 15", "2006.01"):
        same(spark, S.DateStrategy(layout), times, T.TimestampNTZType())
        same(spark, S.DateStrategy(layout), [t.strftime("%Y-%m-%dT%H:%M:%S") + "-07:00" for t in times], T.StringType())
        same(spark, S.DateStrategy(layout), [int((t - dt.datetime(1970, 1, 1)).total_seconds()) for t in times], T.LongType())
    same(spark, S.DateStrategy("2006", "2006/01/02 15:04"), [t.strftime("%Y/%m/%d %H:%M") for t in times], T.StringType())


def test_custom(spark):
    same(spark, S.CustomStrategy(lambda v: f"_{v % 4}"), [1001, 2002, 7], T.LongType())
    person = S.CustomStrategy(lambda v: f"_{int(v[-2:]) % 4}", lambda c: F.concat(F.lit("_"), (F.right(c, F.lit(2)).cast("int") % 4).cast("string")))
    ids = ["1234567890120", "1234567890125", "1234567890128", "9876543210986"]
    same(spark, person, ids, T.StringType())
    assert [person.suffix(i) for i in ids] == ["_0", "_1", "_0", "_2"]


@pytest.mark.parametrize("strategy", [S.HashStrategy(3), S.PaddedModulo(3), RANGE, S.DateStrategy()])
def test_null_keys_fail(spark, strategy):
    with pytest.raises(Exception, match="null"):
        spark.range(1).select(strategy.expr(F.lit(None).cast("bigint"), T.LongType())).collect()


@pytest.mark.parametrize("strategy, kind", [(RANGE, T.StringType()), (CITY, T.LongType()), (S.PaddedModulo(3), T.DoubleType()), (S.HashStrategy(3), T.BooleanType()), (S.DateStrategy(), T.DoubleType())])
def test_wrong_types_fail_when_planned(strategy, kind):
    with pytest.raises(InvalidKey):
        strategy.expr(F.lit(None), kind)
