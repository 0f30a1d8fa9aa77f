import os
import random

import pytest

pytest.importorskip("shardloom.llm")

from shardloom.llm import language as L

EVAL = "/root/testdata/sf0.001/eval_item.parquet"
needs_data = pytest.mark.skipif(not os.path.exists(EVAL), reason="needs the test tables")


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(r.passage, r.lang) for r in spark.read.parquet(EVAL).select("passage", "lang").collect()]
    random.Random(3).shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def model(samples):
    return L.fit(samples[:200])


@needs_data
def test_held_out_accuracy(model, samples):
    texts = [" ".join(t.split()[i : i + 20]) for t, _ in samples[200:] for i in range(0, 60, 20)]
    labels = [lang for _, lang in samples[200:] for _ in range(3)]
    doc, _, _, grams, values = L.block_scores(model, texts)
    lang, sure = model.decide(values, grams)
    right = [model.langs[x] == labels[d] for x, d in zip(lang, doc)]
    assert len(right) == len(texts) and sum(right) / len(right) > 0.99
    assert ((sure > 0.25) & (sure <= 1)).all()
    assert model.pairs[0][0] == "family" and len(model.pairs) == 1 + 3 + 6


def document(samples, langs):
    by = {lang: [t for t, x in samples if x == lang] for lang in set(langs)}
    return [by[lang][i % len(by[lang])] for i, lang in enumerate(langs)]


@needs_data
@pytest.mark.parametrize("gap", ["\n\n", "\r\n\r\n", "\n \t\n", "\n\n\n\n"])
def test_blocks_and_main_language(spark, model, samples, gap):
    parts = document(samples, ["de", "de", "fr", "de", "en"])
    text = gap + gap.join(["URTEIL", *parts, "kurz hier, too short"]) + gap
    rows = [(1, text, "de"), (2, None, "de"), (3, "", None), (4, " \n\n 12 ... ", "x"), (5, parts[2], "xx"), (1, text, "de")]
    got = L.detect_languages(spark.createDataFrame(rows, "id bigint, text string, lang string"), "text", ["id"], model).collect()
    assert [(r.block_no, r.lang) for r in got if r.id == 1] == [(0, "de"), (4, "fr"), (6, "en")] * 2
    assert [(r.block_no, r.lang, r.confidence) for r in got if r.id in (2, 3, 4)] == [(0, None, 0.0)] * 3
    assert [(r.block_no, r.lang) for r in got if r.id == 5] == [(0, "fr")]
    assert all(0 <= r.confidence <= 1 for r in got)


def test_one_line_end_is_no_blank_line():
    assert L.BLANK.split("abc\r\ndef\r\n\r\nghi") == ["abc\r\ndef", "ghi"]
    for end in ("\n", "\r\n", "\r"):
        assert len(L.BLANK.split(f"a{end}b{end} \tc{end}{end}d{end} {end}e{end}{end}{end}f")) == 4


@needs_data
@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_blocks_of_wrapped_lines(spark, model, samples, end):
    wrap = lambda t: end.join(" ".join(t.split()[i : i + 8]) for i in range(0, len(t.split()), 8))
    parts = document(samples, ["de", "fr", "de", "de"])
    text = (end * 2).join(["URTEIL", *map(wrap, parts)])
    got = L.detect_languages(spark.createDataFrame([(1, text)], "id bigint, text string"), "text", ["id"], model).collect()
    assert [(r.block_no, r.lang, r.words) for r in got[1:]] == [(3, "fr", len(parts[1].split()))] and got[0].lang == "de"


@needs_data
def test_long_texts_are_scored_in_parts(spark, model, samples, monkeypatch):
    text = "\n\n".join(document(samples, ["it", "it", "pt"] * 10))
    df = spark.createDataFrame([(1, text)], "id bigint, text string")
    whole = [tuple(r) for r in L.detect_languages(df, "text", ["id"], model).collect()]
    values = L.block_scores(model, [text])[4]
    monkeypatch.setattr(L, "SCORED", 1000)
    assert abs(L.block_scores(model, [text])[4] - values).max() < 1e-3 and len(whole) == 11


@needs_data
def test_wrong_labels(spark, model, samples):
    fr, de = document(samples, ["fr", "de"])
    rows = [(1, fr, "fr"), (2, fr, "de"), (3, fr, None), (4, fr, "French"), (5, fr, "french"), (6, fr + "\n\n" + fr + "\n\n" + de, "fr"), (7, "la loi", "de")]
    df = spark.createDataFrame(rows, "id bigint, text string, label string")
    alias = spark.createDataFrame([("fr", "fr"), ("French", "fr"), ("de", "de"), ("fr", "fr"), (None, "de")], "label string, lang string")
    found = L.wrong_labels(L.detect_languages(df, "text", ["id", "label"], model), "label", alias).collect()
    assert sorted((r.id, r.block_no, r.lang) for r in found) == [(2, 0, "fr"), (3, 0, "fr"), (5, 0, "fr"), (6, 3, "de")]
    assert L.detect_languages(df.limit(0), "text", ["id"], model).collect() == []


def test_fit_on_is_bounded_and_repeatable(spark):
    df = spark.createDataFrame([(f"{w} {i} {w}", lang) for i in range(20) for w, lang in (("hello world there", "en"), ("guten tag welt", "de"), (None, "de"), ("x", None))], "t string, l string")
    a, b = (L.fit_on(df, "t", "l", most=30) for _ in range(2))
    assert a.langs == ["de", "en"] and (a.weights == b.weights).all()
    with pytest.raises(ValueError):
        L.fit_on(df.limit(0), "t", "l")
    one = L.fit([("some text here", "xx")])
    assert one.langs == ["xx"] and one.pairs == []


@needs_data
def test_kept_columns_with_names_of_the_result(spark, model, samples):
    df = spark.createDataFrame([(1, t, lang, 7) for t, lang in samples[:90]], "words bigint, text string, lang string, block_no int")
    got = L.detect_languages(df, "text", ["lang", "words", "block_no", "text"], model).where("block_no = 0").collect()
    assert all(r.lang == r.lang_kept and r.words_kept == 1 and r.block_no_kept == 7 and r.text for r in got) and len(got) == 90
