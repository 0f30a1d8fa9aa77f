import os
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("shardloom.llm")

from shardloom.llm import mix as M

needs_files = pytest.mark.skipif(not os.path.exists(f"{M.TOKENIZERS}/{M.VOCABULARY}"), reason="needs the vocabulary files")


def test_points():
    n = np.arange(64)
    assert M.reversed_bits(n[:5], 3).tolist() == [0, 4, 2, 6, 1]
    points = M.reversed_bits(n, 10)
    for limit in (0, 1, 17, 500, 777, 1023, 1024):
        assert M.points_below(n, limit, 10).tolist() == [int((points[:k] < limit).sum()) for k in n]


def test_schedule_keeps_the_weights_everywhere():
    s = M.Schedule([0.5, 0.3, 0.15, 0.05])
    got = s.sources(np.arange(4096))
    for a in range(0, 4096, 256):
        share = np.bincount(got[a : a + 256], minlength=4) / 256
        assert np.abs(share - [0.5, 0.3, 0.15, 0.05]).max() < 0.02
    for k in range(4):
        assert s.ranks(np.arange(4096), k).tolist() == np.concatenate([[0], np.cumsum(got == k)[:-1]]).tolist()
    with pytest.raises(ValueError):
        M.Schedule([0.0, 0.0])


@needs_files
def test_tokens_are_counted_whole(spark, monkeypatch):
    enc = M._encoding(f"{M.TOKENIZERS}/{M.VOCABULARY}")
    text = " ".join("Wörter und ünïcode 123 ... 北京\n\nnext's line" for _ in range(300))
    whole = len(enc.encode_ordinary(text))
    monkeypatch.setattr(M, "PIECE", 97)
    assert M.token_count(enc, text) == whole and M.token_count(enc, None) == M.token_count(enc, "") == 0
    df = spark.createDataFrame([(1, text, 5), (2, None, 6), (3, "", 7)], "id bigint, text string, tokens int")
    assert sorted(map(tuple, M.with_tokens(df, "text").collect())) == [(1, whole), (2, 0), (3, 0)]


TARGETS = "source string, weight double, max_repeat int"


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    data = [(i, r.choices(["big", "mid", "small", "extra"], [70, 20, 5, 5])[0], r.choice([0, 50, 80, 120, 900])) for i in range(3000)]
    return data, spark.createDataFrame(data, "doc_id bigint, source string, tokens bigint")


def test_mix_keeps_shares_and_caps(spark, rows):
    data, df = rows
    targets = spark.createDataFrame([(" Big", 0.4, 1), ("mid", 0.3, 2), ("small", 0.2, 2), ("none", 0.1, 3)], TARGETS)
    total = sum(t for *_, t in data)
    have = {s: sum(t for _, x, t in data if x == s) for s in ("big", "mid", "small", "none")}
    share = {r.source: r for r in M.shares(df, targets).collect()}
    assert {s: r.tokens for s, r in share.items()} == have
    assert {s: r.reached for s, r in share.items()} == {"big": have["big"] >= 0.4 * total, "mid": 2 * have["mid"] >= 0.3 * total, "small": 2 * have["small"] >= 0.2 * total, "none": False}
    block = 2000
    mix = M.mixed(df, targets, block)
    got = mix.collect()
    uses = Counter((r.source, r.doc_id) for r in got)
    assert all(n <= {"big": 1, "mid": 2, "small": 2}[s] for (s, _), n in uses.items())
    assert len({(r.source, r.doc_id, r.use) for r in got}) == len(got)
    by = Counter()
    for r in got:
        by[r.source] += r.tokens
    for s, w in (("big", 0.4), ("mid", 0.3), ("small", 0.2)):
        want = min(w * total, have[s] * (1 if s == "big" else 2))
        assert abs(by[s] - want) <= 2 * block
    if have["small"] * 2 <= 0.2 * total:
        assert by["small"] == 2 * have["small"]  # a source that falls short is used up whole
    schedule = M.Schedule([0.4, 0.3, 0.1, 0.2])  # in the order of names
    names = ["big", "mid", "none", "small"]
    slots = np.array([r.slot for r in got])
    assert [names[k] for k in schedule.sources(slots)] == [r.source for r in got]
    for r in got:
        assert schedule.ranks(np.array([r.slot]), names.index(r.source))[0] == r.block == r.place // block
    report = {r.source: r for r in M.mix_report(mix, targets).collect()}
    assert report["none"].tokens == 0 and report["big"].actual_share == pytest.approx(by["big"] / sum(by.values()))


@pytest.mark.parametrize("n", [60, 3000])
def test_small_mixes_hold_every_source(spark, rows, n):
    """With the blocks of large mixes: each source gives its target and less than a record more."""
    data, df = rows[0][:n], rows[1].where(f"doc_id < {n}")
    weights = {"big": 0.67, "extra": 0.03, "mid": 0.28, "small": 0.02}
    targets = spark.createDataFrame([(s, w, 2) for s, w in weights.items()], TARGETS)
    got, total = M.mixed(df, targets).collect(), sum(t for *_, t in data)
    schedule, names = M.Schedule(list(weights.values())), list(weights)
    assert [names[k] for k in schedule.sources(np.array([r.slot for r in got]))] == [r.source for r in got]
    for k, (s, w) in enumerate(weights.items()):
        mine, have = [r for r in got if r.source == s], sum(t for _, x, t in data if x == s)
        assert have and min(round(w * total), 2 * have) <= sum(r.tokens for r in mine) < round(w * total) + 900
        assert all(schedule.ranks(np.array([r.slot]), k)[0] == r.block for r in mine)


def test_empty(spark, rows):
    _, df = rows
    none, targets = spark.createDataFrame([], TARGETS), spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    assert M.shares(df, none).collect() == [] and M.mixed(df, none).collect() == []
    assert [(r.tokens, r.reached) for r in M.shares(df.limit(0), targets).collect()] == [(0, True)] and M.mixed(df.limit(0), targets).collect() == []


@needs_files
def test_measured_leaves_out_documents_without_source(spark):
    df = spark.createDataFrame([(1, "a b", " A\t"), (2, "x", None), (3, "x", " "), (4, None, "b")], "doc_id bigint, text string, source string")
    assert sorted(map(tuple, M.measured(df, "doc_id", "text", "source").collect())) == [(1, "a", 2), (4, "b", 0)]


def test_reached_is_read_off_the_mix(spark, rows):
    """What the mix gave decides like the capacities of ``shares``, at the edges too."""
    data, df = rows
    total, have = sum(t for *_, t in data), sum(t for _, s, t in data if s == "mid")
    for w in (0.01, 2 * have / total, 2 * (have + 1) / total, 2 * (have - 1) / total, 0.9):
        targets = spark.createDataFrame([("mid", w, 2), ("big", 1 - w, 9), ("none", 0.05, 9)], TARGETS)
        want = {r.source: r.reached for r in M.shares(df, targets).collect()}
        assert {r.source: r.reached for r in M.mix_report(M.mixed(df, targets), targets, df).collect()} == want


def test_many_buckets_give_the_same_order(spark, rows, monkeypatch):
    """Places are those of one long shuffled list per source and use, whatever the buckets."""
    _, df = rows
    targets = spark.createDataFrame([("mid", 0.3, 3), ("big", 0.7, 1)], TARGETS)
    monkeypatch.setattr(M, "BUCKET_RECORDS", 3)
    got = M.mixed(df, targets, 2000).collect()
    for s in ("mid", "big"):
        mine = sorted((r.place, r.tokens) for r in got if r.source == s)
        assert [p for p, _ in mine] == [0, *np.cumsum([t for _, t in mine])[:-1].tolist()]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
@pytest.mark.parametrize("name", ["p7_letter_shares", "p7_letter_report"])
def test_sql(spark, name):
    import glob

    import duckdb

    from shardloom.llm import queries as Q

    c = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df, want = Q.QUERIES[name](spark, "/root/testdata/sf0.001"), c.sql(Q.SQL[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    rows = sorted(tuple(r[c] for c in order) for r in df.collect())
    assert rows == sorted(tuple(dict(zip(want.columns, r))[c] for c in order) for r in want.fetchall())
