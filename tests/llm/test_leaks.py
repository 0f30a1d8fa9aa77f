import random

import numpy as np
import pytest

pytest.importorskip("shardloom.llm")

from shardloom.llm import leaks as L
from shardloom.llm.words import repaired, word_hashes, words


def test_words_survive_damage():
    want = [b"la", b"senora", b"no", b"acepto", b"el", b"recibo", b"v145"]
    for text in ("La señora no aceptó el recibo V145.", "LA SEÑORA no acep-\n  tó «el recibo» (V145)", "La seÃ±ora no aceptÃ³\r\nel re­cibo V145", "la señora, no—aceptó; el recibo: v145"):
        assert words(text) == want
    assert words(None) == words("") == words(" ... ") == []
    assert repaired("Ã la carte, Âge") == "Ã la carte, Âge" and words("Straße 北京 2") == ["strasse".encode(), "北京".encode(), b"2"]


def text_of(r, n):
    return [r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon".split()) + str(r.randrange(12)) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(2)
    items = [(100 + i, text_of(r, r.randrange(40, 90))) for i in range(12)]
    common = text_of(r, 12)
    docs, truth = [(1, None), (2, ""), (3, "...")], set()
    for d in range(10, 130):
        words_ = text_of(r, 150)
        if r.random() < 0.4:
            words_[20:20] = common
        if r.random() < 0.6:
            ident, item = r.choice(items)
            part = r.choice([1.0, 0.8, 0.65, 0.3, 0.2])
            a = r.randrange(0, len(item) - int(part * len(item)) + 1)
            passage = item[a : a + int(part * len(item))]
            for k in range(len(passage)):
                if r.random() < 0.05:
                    passage[k] = r.choice(["[...]", "XXXX", passage[k] + "q", ""])
            if len(passage) > 20:
                passage[15:15] = "Header 5 - Page 3 -".split()
            at = r.randrange(0, 100)
            words_[at:at] = passage
            if part > 0.5:
                truth.add((d, ident))
        if r.random() < 0.1:
            ident, item = r.choice(items)  # scattered pieces are no stretch
            for k in range(0, len(item) - 6, 6):
                words_[k * 3 : k * 3] = item[k : k + 5]
        docs.append((d, " ".join(words_)))
    copies = [(1000 + d, t) for d, t in docs[3:10]]
    truth |= {(1000 + d, i) for d, i in truth if any(c[0] == 1000 + d for c in copies)}
    return docs + copies, [(i, " ".join(w)) for i, w in items], truth


def test_finds_planted_passages(spark, corpus):
    docs, items, truth = corpus
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, item_id string, ids int")
    ev = spark.createDataFrame([(*i, "x") for i in [*items, (1, None), (2, ""), (3, "two words")]], "item_id bigint, passage string, doc_id string")
    got = L.leaked_passages(df, "doc_id", "text", ev, "item_id", "passage")
    rows = got.collect()
    assert {(r.doc_id, r.item_id) for r in rows} == truth and len(rows) == len(truth)
    assert all(r.coverage >= 0.5 and r.last_word > r.first_word and r.matched_words <= r.spanned_words <= r.item_words for r in rows)
    report = {r.item_id: r.docs for r in L.leak_report(got).collect()}
    assert report == {i: sum(x == i for _, x in truth) for _, i in truth}


def kept_and_exact(items, docs):
    """Pairs that the search finds, and those that the exact check of every pair accepts."""
    own = [word_hashes(" ".join(w)) for w in items]
    ids = [word_hashes(" ".join(d)) for d in docs]
    block = L.ItemBlock(list(range(len(own))), own, 0.5)
    counts = np.zeros(len(block.code))
    for x in ids:
        counts[np.unique(block.hits(x)[1])] += 1
    picked = [L.anchors(c, int(s) - 2, 11) for c, s in zip(block.costs(counts), block.span)]
    block = L.ItemBlock(block.ids, own, 0.5, picked)
    exact = {(d, i) for d in range(len(ids)) for i, w in enumerate(own) if L.is_case(len(w), *(s := L.stretch(w, ids[d]))[:2], s[3] - s[2] + 1, 0.5)}
    return set(L.found_in(block, ids, 24, 8)), exact


def test_search_loses_nothing(corpus):
    """Rare prefixes and bounds of count and position against the exact check of every pair."""
    docs, items, _ = corpus
    kept, exact = kept_and_exact([t.split() for _, t in items], [(t or "").split() for _, t in docs])
    assert exact and exact == kept


@pytest.mark.parametrize("lengths", [range(3, 16), range(16, 61, 4), (70, 90, 140)])
def test_search_loses_no_damaged_stretch(lengths):
    """Stretches of any damage and items of any length; copies of common phrases stand in all of them."""
    r = random.Random(6)
    phrase = text_of(r, 9)
    items = [text_of(r, n) for n in lengths] + [text_of(r, 6) * 6]
    for w in items[1:-1:2]:
        w[len(w) // 3 : len(w) // 3 + 9] = phrase[: len(w) // 2]
    docs = []
    for k in range(260):
        item = r.choice(items)
        part = item[r.randrange(0, len(item) // 3 + 1) :]
        rate, kinds = r.choice([0, 0.05, 0.15, 0.25, 0.35]), r.choice([(0,), (1,), (2,), (0, 1, 2)])
        bad = [("zz", "", w + " zz")[r.choice(kinds)] if r.random() < rate else w for w in part]
        if k % 3 == 0:
            bad = [w + "q" if n % 4 == 3 else w for n, w in enumerate(part)]
        docs.append(" ".join(text_of(r, 30) + bad + phrase + text_of(r, 30)).split())
    kept, exact = kept_and_exact(items, docs)
    assert len(exact) > 100 and exact == kept


def test_short_items_and_every_fourth_word_damaged():
    """Half of an item exactly, and all of it with every fourth word damaged, at every length from 6 words on."""
    r = random.Random(9)
    for n in range(6, 61):
        item = text_of(r, n)
        docs = [text_of(r, 20) + item[: -(-n // 2)] + text_of(r, 20), text_of(r, 20) + [w + "q" if k % 4 == 3 else w for k, w in enumerate(item)] + text_of(r, 20)]
        kept, exact = kept_and_exact([item], docs)
        assert kept == exact and (0, 0) in kept and ((1, 0) in kept or n == 7), n  # of 7 words a run of 3 is less than half


def test_anchors_meet_every_stretch():
    r = np.random.default_rng(1)
    for n in range(1, 60):
        for places in range(1, n + 1):
            for window in (3, 11):
                got = set(L.anchors(r.random(n), places, window).tolist())
                need = range(places - window + 1) if places >= window else ()
                assert all(any(all(x + a + k in got for k in range(window)) for a in need) if need else got == set(range(n)) for x in range(n - places + 1))


def test_long_documents_in_pieces(monkeypatch):
    r = random.Random(3)
    item = text_of(r, 60)
    doc = text_of(r, 3_000)
    for at in (995, 1_990):
        doc[at : at + 40] = item[5:45]
    monkeypatch.setattr(L, "BATCH_WORDS", 1_000)
    kept, exact = kept_and_exact([item], [doc])
    assert kept == exact == {(0, 0)}


def test_hashes_are_those_of_words():
    text = "La señora no aceptó; " * 3 + "x" * 50 + " Straße 北京"
    w, h = words(text), word_hashes(text)
    assert len(w) == len(h) and len(set(w)) == len(set(h.tolist())) and all(h) and word_hashes(None).tolist() == word_hashes(" .").tolist() == []
    long = " ".join(f"w{k}" for k in range(300_000))  # more than a piece
    assert word_hashes(long)[[0, 1, 200_000, 299_999]].tolist() == [word_hashes(f"w{k}")[0] for k in (0, 1, 200_000, 299_999)]
    assert len(word_hashes("a" * 3_000_000 + " b")) == 2


def test_finds_evenly_damaged_and_short_passages(spark):
    r = random.Random(4)
    long, short, tiny, twice = text_of(r, 120), text_of(r, 8), text_of(r, 5), text_of(r, 12) * 5
    damaged = [w + "q" if k % 4 == 3 else w for k, w in enumerate(long[30:93])]
    apart = [x for k, w in enumerate(long[:70]) for x in ([w, "strange"] if k % 11 in (2, 4, 6, 8, 10) else [w])]
    docs = [(k, " ".join(text_of(r, 40) + part + text_of(r, 40))) for k, part in enumerate((damaged, apart, short[2:6], tiny[1:4], twice[:30], long[:50], short[:3]))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    ev = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((long, short, tiny, twice))], "item_id bigint, passage string")
    got = L.leaked_passages(df, "doc_id", "text", ev, "item_id", "passage").collect()
    assert sorted((x.doc_id, x.item_id) for x in got) == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3)]


def test_blocks_of_items_and_empty_tables(spark, corpus, monkeypatch):
    """With many blocks of items, and prefixes taken in several passes, the text is read once."""
    docs, items, truth = corpus
    df, ev = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), spark.createDataFrame(items, "item_id bigint, passage string")
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    once = df.mapInArrow(seen, df.schema)
    monkeypatch.setattr(L, "BLOCK_WORDS", 200)
    monkeypatch.setattr(L, "MOST_ANCHORS", 150)
    monkeypatch.setattr(L, "SALT_WORDS", 2_000)
    assert {tuple(r)[:2] for r in L.leaked_passages(once, "doc_id", "text", ev, "item_id", "passage").collect()} == truth
    assert read.value == len(docs)
    assert L.leaked_passages(df, "doc_id", "text", ev.limit(0), "item_id", "passage").collect() == []
    assert L.leaked_passages(df.limit(0), "doc_id", "text", ev, "item_id", "passage").collect() == []


def test_repeated_rows_and_null_ids(spark):
    r = random.Random(5)
    item = " ".join(text_of(r, 30))
    df = spark.createDataFrame([("a", item), ("a", item), (None, item), ("b", None)], "doc_id string, text string")
    ev = spark.createDataFrame([(None, item), ("i", item)], "item_id string, passage string")
    got = L.leaked_passages(df, "doc_id", "text", ev, "item_id", "passage").collect()
    assert sorted((str(x.doc_id), str(x.item_id), x.coverage) for x in got) == sorted((d, i, 1.0) for d in ("None", "a", "a") for i in ("None", "i"))


def test_stretch_is_exact():
    item, doc = np.arange(1, 21, dtype=np.uint32), np.array([0, 0, 3, 4, 5, 6, 0, 8, 9, 10, 11, 0, 0], np.uint32)
    assert L.stretch(item, doc) == (9, 8, 2, 10)
    assert L.stretch(item, np.zeros(0, np.uint32)) == (0, 0, 0, 0)
