"""Shard functions: each has a native column expression and a driver twin for single values, which always agree.

``suffix(value)`` places one Python value, ``expr(column, type)`` a column of that Spark type. Null keys and types a
function cannot place are errors in both: the expression raises at run time for null rows and at planning time for types.
"""

from __future__ import annotations

import datetime as dt
import math
import re
import zlib
from collections.abc import Callable, Mapping, Sequence
from decimal import Decimal
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidKey, ShardingError

_INT64 = 1 << 64
_DIGITS = re.compile(r"[+-]?[0-9]+\Z")
#: Layout words of dates and the patterns of Spark and Python for them (fixed values).
_LAYOUT = [("2006", "yyyy", "%Y"), ("01", "MM", "%m"), ("02", "dd", "%d"), ("15", "HH", "%H"), ("04", "mm", "%M"), ("05", "ss", "%S")]
_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
RFC3339 = "2006-01-02T15:04:05Z07:00"


class Strategy(Protocol):
    """A shard function."""

    def suffix(self, value: Any) -> str: ...

    def expr(self, key: Column, kind: T.DataType) -> Column: ...


def to_int64(value: Any) -> int:
    """A number as a 64-bit integer; fractions are cut off towards zero."""
    if isinstance(value, bool) or not isinstance(value, (int, float, Decimal)):
        raise InvalidKey(f"{value!r} is no number")
    if isinstance(value, float) and not math.isfinite(value):
        raise InvalidKey(f"{value!r} is no finite number")
    n = int(value)
    if not -(1 << 63) <= n < 1 << 63:
        raise InvalidKey(f"{value!r} does not fit 64 bits")
    return n


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, (T.IntegralType, T.FloatType, T.DoubleType, T.DecimalType))


def int64_expr(key: Column, kind: T.DataType) -> Column:
    """The column form of ``to_int64``."""
    if not _is_number(kind):
        raise InvalidKey(f"{kind.simpleString()} is no numeric type")
    return key.cast("bigint")


def _required(key: Column, out: Column) -> Column:
    return F.when(key.isNull(), F.raise_error(F.lit("the sharding key is null"))).otherwise(out)


def _no_null(value):
    if value is None:
        raise InvalidKey("the sharding key is null")


def crc32(text: str) -> int:
    """CRC-32 of the UTF-8 bytes."""
    return zlib.crc32(text.encode("utf-8"))


def _remainder(n: int, m: int) -> int:
    """Remainder with the sign of ``n``."""
    return int(math.copysign(abs(n) % m, n))


class HashStrategy:
    """``_<|number % shards|>``, not padded; text is numbered by its CRC-32."""

    monotone = False

    def __init__(self, shards: int):
        if shards <= 0:
            raise ShardingError("the number of shards must be positive")
        self.shards = shards

    def suffix(self, value):
        _no_null(value)
        return f"_{abs(_remainder(crc32(value) if isinstance(value, str) else to_int64(value), self.shards))}"

    def expr(self, key, kind):
        number = F.crc32(key) if isinstance(kind, T.StringType) else int64_expr(key, kind)
        return _required(key, F.concat(F.lit("_"), F.abs(number % F.lit(self.shards)).cast("string")))


class EnumStrategy:
    """Exact lookup of text; others get a non-empty default or are an error."""

    monotone = False

    def __init__(self, mapping: Mapping[str, str], default: str = ""):
        self.mapping, self.default = dict(mapping), default

    def suffix(self, value):
        if not isinstance(value, str):
            raise InvalidKey(f"{value!r} is no text")
        if value in self.mapping:
            return self.mapping[value]
        if self.default:
            return self.default
        raise ShardingError(f"no shard is listed for {value!r}")

    def expr(self, key, kind):
        if not isinstance(kind, T.StringType):
            raise InvalidKey(f"{kind.simpleString()} is no text type")
        other = F.lit(self.default) if self.default else F.raise_error(F.concat(F.lit("no shard is listed for "), key))
        found = F.element_at(F.create_map(*[F.lit(x) for kv in self.mapping.items() for x in kv]), key) if self.mapping else F.lit(None).cast("string")
        return _required(key, F.coalesce(found, other))


def _patterns(layout: str) -> tuple[str, str]:
    """Spark's and Python's pattern of a date layout; raises for parts that have no counterpart."""
    java, python, i = "", "", 0
    while i < len(layout):
        for word, j, p in _LAYOUT:
            if layout.startswith(word, i):
                java, python, i = java + j, python + p, i + len(word)
                break
        else:
            c = layout[i]
            if c.isalnum():
                raise ShardingError(f"the layout {layout!r} has an unknown part at {layout[i:]!r}")
            java, python, i = java + (f"'{c}'" if c != "'" else "''"), python + ("%%" if c == "%" else c), i + 1
    return java, python


class DateStrategy:
    """``_<date>`` in a layout; text is parsed and keeps its own wall clock, integers are Unix seconds in UTC."""

    def __init__(self, layout: str = "20060102", value_layout: str = RFC3339):
        self.java, self.python = _patterns(layout or "20060102")
        self.value_layout = value_layout or RFC3339
        self.value_patterns = None if self.value_layout == RFC3339 else _patterns(self.value_layout)
        #: Suffixes sort like times if the parts go from years downwards.
        self.monotone = (layout or "20060102") in ("2006", "200601", "20060102", "2006010215", "2006-01", "2006-01-02")

    def suffix(self, value):
        if isinstance(value, str):
            try:
                if self.value_patterns is None:
                    if not re.match(_RFC3339.replace("$", r"\Z"), value):
                        raise ValueError
                    when = dt.datetime.strptime(value[:19], "%Y-%m-%dT%H:%M:%S")
                else:
                    when = dt.datetime.strptime(value, self.value_patterns[1])
            except ValueError:
                raise ShardingError(f"{value!r} is no time in the layout {self.value_layout}") from None
        elif isinstance(value, int) and not isinstance(value, bool):
            when = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=value)
        elif isinstance(value, (dt.datetime, dt.date)):
            when = value
        else:
            raise InvalidKey(f"{value!r} is no time, text or whole number")
        return "_" + when.strftime(self.python.replace("%Y", f"{when.year:04d}"))

    def expr(self, key, kind):
        if isinstance(kind, T.StringType):
            wrong = F.raise_error(F.concat(F.lit(f"no time in the layout {self.value_layout}: "), key)).cast("timestamp_ntz")
            if self.value_patterns is None:
                when = F.when(key.rlike(_RFC3339), F.try_to_timestamp(F.substring(key, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz"))
            else:
                when = F.try_to_timestamp(key, F.lit(self.value_patterns[0])).cast("timestamp_ntz")
            when = F.coalesce(when, wrong)
        elif isinstance(kind, (T.IntegerType, T.LongType)):
            # seconds since the epoch as a wall clock of UTC, whatever the session's zone
            second = F.pmod(key.cast("bigint"), F.lit(86_400))
            day = ((key.cast("bigint") - second) / 86_400).cast("int")
            when = F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(day, F.lit(0), F.lit(0), second)
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            when = key
        else:
            raise InvalidKey(f"{kind.simpleString()} is no time, text or whole number")
        return _required(key, F.concat(F.lit("_"), F.date_format(when, self.java)))


class RangeStrategy:
    """Buckets between ascending bounds: ``max(0, number of bounds at or below the value - 1)``; values below the first
    bound belong to bucket 0. ``suffix_func`` names a bucket, ``_<i>`` by default."""

    monotone = True

    def __init__(self, bounds: Sequence[int], suffix_func: Callable[[int], str] | None = None):
        self.bounds = [to_int64(b) for b in bounds]
        if not self.bounds:
            raise ShardingError("a range rule needs bounds")
        if any(a >= b for a, b in zip(self.bounds, self.bounds[1:])):
            raise ShardingError("the bounds must ascend")
        self.names = [suffix_func(i) if suffix_func else f"_{i}" for i in range(len(self.bounds))]

    def bucket(self, value) -> int:
        n = to_int64(value)
        return max(0, sum(b <= n for b in self.bounds) - 1)

    def suffix(self, value):
        _no_null(value)
        return self.names[self.bucket(value)]

    def expr(self, key, kind):
        n = int64_expr(key, kind)
        out = F.when(key.isNull(), F.raise_error(F.lit("the sharding key is null")))
        for i in range(len(self.bounds) - 1, 0, -1):
            out = out.when(n >= self.bounds[i], F.lit(self.names[i]))
        return out.otherwise(F.lit(self.names[0]))


def padded_format(shards: int) -> str:
    """Format of a padded suffix for so many shards, up to 9,999."""
    if shards <= 0:
        raise ShardingError("give a number of shards or a shard function")
    if shards >= 10_000:
        raise ShardingError("padded suffixes go up to 9,999 shards")
    return f"_%0{len(str(shards))}d"


class PaddedModulo:
    """The default: ``number % shards``, padded, with the sign kept; text is a whole number or numbered by its CRC-32."""

    monotone = False

    def __init__(self, shards: int):
        self.format, self.shards = padded_format(shards), shards

    def suffix(self, value):
        if isinstance(value, str):
            value = int(value) if _DIGITS.match(value) and -(1 << 63) <= int(value) < 1 << 63 else crc32(value)
        elif isinstance(value, bool) or not isinstance(value, int):
            raise InvalidKey(f"{value!r} is neither a whole number nor text")
        return self.format % _remainder(value, self.shards)

    def expr(self, key, kind):
        if isinstance(kind, T.StringType):
            number = F.coalesce(F.when(key.rlike(r"^[+-]?[0-9]+\z"), key.try_cast("bigint")), F.crc32(key))
        elif isinstance(kind, (T.IntegerType, T.LongType)):
            number = key.cast("bigint")
        else:
            raise InvalidKey(f"{kind.simpleString()} is neither a whole number nor text")
        return _required(key, F.format_string(self.format, number % F.lit(self.shards)))


class NoSharding:
    """Every row in the table or database without suffix."""

    monotone = False

    def suffix(self, value):
        return ""

    def expr(self, key, kind):
        return F.lit("")


class CustomStrategy:
    """A user's function: ``native`` builds a column expression and is preferred; ``function`` places a Python value and
    serves columns through an Arrow UDF where there is no native form."""

    monotone = False

    def __init__(self, function: Callable[[Any], str], native: Callable[[Column], Column] | None = None):
        self.function, self.native = function, native

    def suffix(self, value):
        return self.function(value)

    def expr(self, key, kind):
        if self.native is not None:
            return self.native(key)
        function = self.function

        def place(values: pd.Series) -> pd.Series:
            return values.map(function)

        return F.pandas_udf(place, T.StringType())(key)


def suffix_to_index(suffix: str) -> int:
    """Database number of a suffix: the whole number after one leading ``_``; 0 if it is none."""
    text = suffix[1:] if suffix.startswith("_") else suffix
    return int(text) if _DIGITS.match(text) and -(1 << 63) <= int(text) < 1 << 63 else 0


def suffix_to_index_expr(suffix: Column) -> Column:
    """The column form of ``suffix_to_index``."""
    text = F.regexp_replace(suffix, "^_", "")
    return F.coalesce(F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint")), F.lit(0)).cast("int")
