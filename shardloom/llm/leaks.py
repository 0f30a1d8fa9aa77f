"""Evaluation passages that reappear in a corpus: prefix-filtered set join with positional bounds and exact checks.

A stretch hangs together by runs of SHINGLE equal words, so of any ``item_gap + SHINGLE`` neighbouring shingles it spans
one is intact. An item's *necessary prefix* is the rarest choice of such windows that every stretch long enough to count
must contain one of; documents without any of its shingles are not looked at. Items are kept in blocks of bounded size;
documents are sent to the blocks whose prefixes they share, and compared there word by word.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import column, ensure_checkpoint_dir, spread
from .words import word_hashes

#: Words of a shingle. Three, not five: single damaged words must not hide a passage of which half is there.
SHINGLE = 3
#: Words of the items of a block; a task holds one block at a time.
BLOCK_WORDS = 250_000
#: What a strange word between two matching pieces costs, in matching words: short pieces far apart are no stretch.
STRANGE = 0.5
#: Words of documents that are compared with a block by one task, and at once within it.
SALT_WORDS, BATCH_WORDS = 2_000_000, 200_000
#: Prefix shingles broadcast at once (12 bytes each); more are taken in several passes over the encoded documents.
MOST_ANCHORS = 4_000_000
#: Most bits of a sieve, as a power of 2 (16 MB). More shingles make it let through more; what it lets through is checked.
SIEVE_BITS = 27
#: Odd multipliers that make a shingle's code of three word hashes.
_CODE = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SLOT = np.uint64(0xD6E8FEB86659FD93)


def shingle_codes(words: np.ndarray):
    """Places and 64-bit codes of the shingles of a list of word hashes; none holds a 0, which ends a text."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = words.astype(np.uint64)
    code, ok = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(SHINGLE):
        code += w[k : k + n] * _CODE[k]
        ok &= words[k : k + n] != 0
    at = np.flatnonzero(ok)
    return at, (code[at] ^ (code[at] >> np.uint64(29))).view(np.int64)


def _slots(code: np.ndarray, bits: int) -> np.ndarray:
    return (code.view(np.uint64) * _SLOT) >> np.uint64(64 - bits)


class Sieve:
    """Bits of the codes of a set; lets all of its codes pass, and few others."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @classmethod
    def of(cls, code: np.ndarray) -> Sieve:
        bits = cls.bits_for(len(code))
        words = np.zeros(1 << bits >> 6, np.uint64)
        at = _slots(code, bits)
        np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        return cls(bits, words)

    @staticmethod
    def bits_for(n: int) -> int:
        return min(SIEVE_BITS, max(10, (16 * n).bit_length()))

    def has(self, code: np.ndarray) -> np.ndarray:
        at = _slots(code, self.bits)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _spread(start, n):
    """Indices start[i] ... start[i]+n[i]-1, one after another."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def least_span(n: int, share: float) -> int:
    """Words of an item of n words that a stretch spans at least."""
    return max(SHINGLE, math.ceil(share * n - 1e-9))


def anchors(cost: np.ndarray, places: int, window: int) -> np.ndarray:
    """Places of the cheapest windows of which every stretch of ``places`` neighbouring shingles contains one whole; all
    places where a stretch may be shorter than a window. Of an item with ``len(cost)`` shingles."""
    if places < window:
        return np.arange(len(cost))
    step = places - window + 1  # two chosen windows begin at most so far apart
    c = np.convolve(cost, np.ones(window), "valid")
    best, before = c.copy(), np.full(len(c), -1)
    for a in range(step, len(c)):
        k = a - step + int(np.argmin(best[a - step : a]))
        best[a], before[a] = best[k] + c[a], k
    at = max(0, len(c) - step)
    at += int(np.argmin(best[at:]))
    starts = []
    while at >= 0:
        starts.append(at)
        at = int(before[at])
    return np.unique((np.array(starts)[:, None] + np.arange(window)).ravel())


class ItemBlock:
    """Items as word hashes with their shingles; small enough for a task, by BLOCK_WORDS."""

    def __init__(self, ids: list, words: list[np.ndarray], share: float, anchored: list[np.ndarray] | None = None):
        self.ids, self.own, self.share = ids, words, share
        self.n = np.array([len(w) for w in words], np.int64)
        self.span = np.array([least_span(len(w), share) for w in words], np.int64)
        self.words = np.concatenate([np.zeros(1, np.uint32)] + [x for w in words for x in (w, np.zeros(1, np.uint32))])
        self.start = np.concatenate([[0], np.cumsum(self.n + 1)[:-1]]) + 1
        at, code = shingle_codes(self.words)
        order = np.argsort(code, kind="stable")
        self.post, code = at[order], code[order]
        self.code, first = np.unique(code, return_index=True)
        self.first = np.append(first, len(code))
        self.post_item = np.searchsorted(self.start, self.post, side="right") - 1
        self.sieve = Sieve.of(self.code)
        if anchored is not None:
            flag = np.zeros(len(self.words), bool)
            for s, a in zip(self.start, anchored):
                flag[s + a] = True
            flag = flag[self.post]
            self.anchor_item = self.post_item[flag]
            self.anchor_first = np.concatenate([[0], np.cumsum(flag)])[self.first]

    def costs(self, docs: np.ndarray) -> list[np.ndarray]:
        """Documents of each item's shingles, place by place, from the documents of each code."""
        by = np.zeros(len(self.words), np.float64)
        by[self.post] = np.repeat(docs, np.diff(self.first))
        return [by[s : s + max(0, n - SHINGLE + 1)] for s, n in zip(self.start, self.n)]

    def hits(self, words: np.ndarray):
        """Places where a shingle of an item stands, and the number of its code."""
        at, code = shingle_codes(words)
        keep = self.sieve.has(code)
        at, code = at[keep], code[keep]
        if not len(self.code):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        same = self.code[k] == code
        return at[same], k[same]


def _common(a: list, b: list) -> int:
    """Length of the longest common subsequence of two short word lists."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            keep = row[j + 1]
            row[j + 1] = left + 1 if x == y and x else max(keep, row[j])
            left = keep
    return row[-1]


def chain(p: list, q: list, n: list, item: np.ndarray, doc: np.ndarray, doc_gap: int, item_gap: int):
    """The best stretch made of runs (place in doc, place in item, length; ordered by place in doc): (words of the item it
    spans, words matched, first and last word in doc)."""
    reach, best, prev = [], [], []
    for j in range(len(p)):
        pj, qj, nj = p[j], q[j], n[j]
        reach.append(max(reach[-1] if reach else 0, pj + nj))
        score, from_ = float(nj), (-1, 0)
        for i in range(j - 1, -1, -1):
            if reach[i] + doc_gap < pj:
                break
            pi, qi = p[i] + n[i], q[i] + n[i]  # ends
            if p[i] < pj and q[i] < qj:
                over = max(0, pi - pj, qi - qj)
                gp, gq = pj + over - pi, qj + over - qi
                if over < nj and gp <= doc_gap and gq <= item_gap:
                    gain = best[i] + nj - over - STRANGE * max(0, gp - gq)
                    if gain > score:
                        score, from_ = gain, (i, over)
        best.append(score)
        prev.append(from_)
    if not best:
        return 0, 0, 0, 0
    last = j = max(range(len(best)), key=best.__getitem__)
    matched = 0
    while True:
        i, over = prev[j]
        matched += n[j] - over
        if i < 0:
            break
        a, b = q[i] + n[i], p[i] + n[i]
        if q[j] + over > a and p[j] + over > b:
            matched += _common(item[a : q[j] + over].tolist(), doc[b : p[j] + over].tolist())
        j = i
    return q[last] + n[last] - q[j], matched, p[j], p[last] + n[last] - 1


def stretch(item: np.ndarray, doc: np.ndarray, doc_gap: int = 24, item_gap: int = 8):
    """The best connected stretch of one item in one document, as ``chain`` gives it, from all runs of equal words."""
    block, runs = ItemBlock([0], [item], 0.5), []
    at, k = block.hits(doc)
    for place, code in zip(at.tolist(), k.tolist()):
        for q in (block.post[block.first[code] : block.first[code + 1]] - 1).tolist():
            if not (place and q and doc[place - 1] == item[q - 1]):
                n = SHINGLE
                while place + n < len(doc) and q + n < len(item) and doc[place + n] == item[q + n]:
                    n += 1
                runs.append((place, q, n))
    return chain(*map(list, zip(*runs)), item, doc, doc_gap, item_gap) if runs else (0, 0, 0, 0)


def is_case(item_words: int, spanned: int, matched: int, doc_words: int, share: float) -> bool:
    """Whether a stretch spans enough of the item, three quarters of the words it spans are equal, and at least half of
    the words between its ends in the document are the item's."""
    return spanned >= share * item_words and 4 * matched >= 3 * spanned and 2 * matched >= doc_words


def _segments(block: ItemBlock, docs: list[np.ndarray], doc_gap: int, item_gap: int):
    """(document, item, runs: places in the document, in the item, lengths) that may hold a stretch: the pair shares a
    prefix, and the runs hang together on both sides and span enough of the item. These bounds hold for every stretch
    that ``is_case`` accepts."""
    whole = np.concatenate([np.zeros(1, np.uint32)] + [x for d in docs for x in (d, np.zeros(1, np.uint32))])
    start = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])[:-1]]) + 1
    at, k = block.hits(whole)
    of = np.searchsorted(start, at, side="right") - 1
    items = len(block.ids)
    many = block.anchor_first[k + 1] - block.anchor_first[k]
    wanted = np.zeros(len(docs) * items, bool)
    wanted[np.repeat(of, many) * items + block.anchor_item[_spread(block.anchor_first[k], many)]] = True
    many = block.first[k + 1] - block.first[k]
    upto, parts, lo = np.cumsum(many), [], 0
    while lo < len(at):  # rows of a bounded number of hits at once; only starts of runs are kept
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + 4_000_000)))
        m = many[lo:hi]
        post = _spread(block.first[k[lo:hi]], m)
        p, q, pair = np.repeat(at[lo:hi], m), block.post[post], np.repeat(of[lo:hi] * items, m) + block.post_item[post]
        keep = wanted[pair]
        keep[keep] = (whole[p[keep] - 1] != block.words[q[keep] - 1]) | (whole[p[keep] - 1] == 0)
        parts.append((pair[keep], p[keep], q[keep]))
        lo = hi
    if not parts:
        return
    pair, p, q = (np.concatenate(x) for x in zip(*parts))
    n, on = np.full(len(p), SHINGLE, np.int64), np.arange(len(p))
    while len(on):
        w = whole[p[on] + n[on]]
        on = on[(w == block.words[q[on] + n[on]]) & (w != 0)]
        n[on] += 1

    def cut(group, x, gap, size):
        """Numbers of groups of runs, in order of (group, x), that are cut where a gap is larger."""
        low = group * (size + gap + 2) + x
        far = np.maximum.accumulate(low + n)
        return np.cumsum(np.append(False, low[1:] - far[:-1] > gap)) if len(low) else low

    def ordered(by):
        nonlocal pair, p, q, n
        pair, p, q, n = pair[by], p[by], q[by], n[by]

    ordered(np.lexsort((p, pair)))
    part = cut(np.cumsum(np.append(0, np.diff(pair) != 0)) if len(pair) else pair, p, doc_gap, len(whole))
    by = np.lexsort((q, part))
    ordered(by)
    part = cut(part[by], q, item_gap, len(block.words))
    first = np.flatnonzero(np.append(True, np.diff(part) != 0)) if len(part) else part
    if not len(first):
        return
    good = np.maximum.reduceat(q + n, first) - q[first] >= block.span[pair[first] % items]
    for a, b in zip(first[good], np.append(first[1:], len(part))[good]):
        d, i = divmod(int(pair[a]), items)
        by = a + np.lexsort((q[a:b], p[a:b]))
        yield d, i, (p[by] - start[d]).tolist(), (q[by] - block.start[i]).tolist(), n[by].tolist()


def found_in(block: ItemBlock, docs: list[np.ndarray], doc_gap: int, item_gap: int) -> dict:
    """(document, item) -> (spanned, matched, first and last word) of the cases of a block in some documents; those are
    compared in pieces that overlap by more than a stretch is long."""
    over, best = 2 * int(block.n.max(initial=0)) + doc_gap, {}
    pieces = [(d, at, w[at : at + BATCH_WORDS + over]) for d, w in enumerate(docs) for at in range(0, max(1, len(w)), BATCH_WORDS)]
    lo = 0
    while lo < len(pieces):
        hi, size = lo, 0
        while hi < len(pieces) and (hi == lo or size + len(pieces[hi][2]) <= BATCH_WORDS):
            size, hi = size + len(pieces[hi][2]), hi + 1
        for x, i, p, q, n in _segments(block, [w for *_, w in pieces[lo:hi]], doc_gap, item_gap):
            d, at, w = pieces[lo + x]
            spanned, matched, first, last = chain(p, q, n, block.own[i], w, doc_gap, item_gap)
            if is_case(len(block.own[i]), spanned, matched, last - first + 1, block.share) and matched > best.get((d, i), (0, 0))[1]:
                best[d, i] = spanned, matched, at + first, at + last
        lo = hi
    return best


def leaked_passages(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, share: float = 0.5, doc_gap: int = 24, item_gap: int = 8) -> DataFrame:
    """Documents that reproduce an item's passage: ``doc_id``, ``item_id``, ``item_words``, ``spanned_words``,
    ``matched_words``, ``coverage`` (spanned / item words), ``first_word``, ``last_word`` (places in the document).

    A pair is found if one connected stretch of the document spans at least ``share`` of the item's words in their order,
    at least three quarters of the words it spans are equal, and at least half of the document's words between its ends
    are the item's. A stretch hangs together by runs of three equal words with at most ``item_gap`` of the item's and ``doc_gap`` of the document's words (page headers, paragraph numbers)
    between them. The search for candidates loses none that this accepts, for items of any length. Blanked words
    (``____``) are no words. Words are compared by 32-bit hashes.

    Cases: null or empty texts and passages without three words match nothing; a passage that stands several times in a
    document gives one row; repeated rows of a document or item give rows each; extra columns are ignored; empty tables
    give no row; very long texts are compared in overlapping pieces.

    Plan: one pass over the text turns it into word hashes, written to the checkpoint folder (documents without a shingle
    of any item are dropped there, by a sieve of bounded size); a pass over the hashes counts in how many documents each
    shingle is, which decides the items' rare prefixes; the next sends each document to the blocks of items with whose
    prefixes it shares a shingle, spread over tasks by the words each block gets; there bounds of count and position are
    applied and the words are checked. However many blocks there are, the text is read once and the hashes are shuffled
    only to blocks that need them. No item or document passes the driver; the sieve and MOST_ANCHORS prefix codes do.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    id_type, item_type = docs.schema[doc_id].dataType, items.schema[item_id].dataType
    out = T.StructType([T.StructField("doc_id", id_type), T.StructField("item_id", item_type)] + [T.StructField(c, t) for c, t in (("item_words", T.LongType()), ("spanned_words", T.LongType()), ("matched_words", T.LongType()), ("coverage", T.DoubleType()), ("first_word", T.LongType()), ("last_word", T.LongType()))])
    blocks = _blocks(items.select(F.col(item_id).alias("item_id"), F.col(passage).alias("passage")))
    shingles = blocks.agg(F.coalesce(F.sum("shingles"), F.lit(0))).first()[0]
    if not shingles:
        return spark.createDataFrame([], out)
    sieve = spark.sparkContext.broadcast(_sieve(blocks, shingles))
    encoded = _encoded(spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text") != ""), "doc_id"), sieve).checkpoint()
    ready = _prefixed(blocks, _frequencies(encoded, sieve), share, item_gap).checkpoint()
    found, group, size = None, [], 0
    for block, n in [*ready.select("block", "anchors").orderBy("block").collect(), (None, MOST_ANCHORS + 1)]:  # a row per block
        if group and size + n > MOST_ANCHORS:
            one = _matched(encoded, ready.where(F.col("block").isin(group)), out, share, doc_gap, item_gap)
            found, group, size = one if found is None else found.unionAll(one), [], 0
        group, size = [*group, block], size + n
    return found


def filled(batches):
    """Batches that have rows; Spark bounds them by bytes, so texts of any length fit."""
    return (b for b in batches if b.num_rows)


def _packed(words: np.ndarray) -> bytes:
    return pa.compress(words.tobytes(), "zstd", asbytes=True)


def _unpacked(body: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(body, 4 * n, "zstd", asbytes=True), np.uint32)


def _blocks(items: DataFrame) -> DataFrame:
    """``block``, ``shingles``, ``body`` (pickled ids and word hashes) of blocks of about BLOCK_WORDS words."""
    most = BLOCK_WORDS
    chars = items.agg(F.sum(F.length("passage"))).first()[0] or 0

    def make(batches):
        from pyspark import TaskContext

        block, ids, words, n = TaskContext.get().partitionId() << 32, [], [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sum(len(w) - SHINGLE + 1 for w in words)], pa.int64()), pa.array([pickle.dumps((ids, words))], pa.binary())], names=["block", "shingles", "body"])

        for b in batches:
            for ident, passage in zip(b.column("item_id").to_pylist(), b.column("passage").to_pylist()):
                w = word_hashes((passage or "").replace("_", " "))
                if len(w) >= SHINGLE:
                    ids.append(ident)
                    words.append(w)
                    n += len(w)
                if n >= most:
                    yield made()
                    block, ids, words, n = block + 1, [], [], 0
        if ids:
            yield made()

    return items.repartition(max(1, chars // (64 * most))).mapInArrow(make, "block bigint, shingles bigint, body binary").checkpoint()


def _sieve(blocks: DataFrame, shingles: int) -> Sieve:
    """The sieve of all items' shingles, put together from 64-bit words: no more of them than it has."""
    bits = Sieve.bits_for(shingles)

    def words(batches):
        for b in batches:
            for body in b.column("body").to_pylist():
                at = np.unique(_slots(np.concatenate([shingle_codes(w)[1] for w in pickle.loads(body)[1]]), bits))
                word, first = np.unique(at >> np.uint64(6), return_index=True)
                mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])

    got = blocks.select("body").mapInArrow(words, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(1 << bits >> 6, np.uint64)
    out[got["word"].to_numpy(np.int64)] = got["mask"].to_numpy(np.int64).view(np.uint64)
    return Sieve(bits, out)


def _encoded(source: DataFrame, sieve) -> DataFrame:
    """``doc_id``, ``n`` and ``body`` (packed word hashes) of the documents with a shingle that may be an item's."""
    kind = T.StructType([source.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("body", T.BinaryType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        s, schema = sieve.value, to_arrow_schema(kind)
        for b in batches:
            keep, n, bodies = [], [], []
            for i, t in enumerate(b.column("text")):
                w = word_hashes(t.as_py())
                if s.has(shingle_codes(w)[1]).any():
                    keep.append(i)
                    n.append(len(w))
                    bodies.append(_packed(w))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(bodies, pa.binary())], schema=schema)

    return source.mapInArrow(run, kind)


def _frequencies(encoded: DataFrame, sieve) -> DataFrame:
    """``code``, ``docs``: in how many documents each shingle is that passes the sieve, added up in each task first."""

    def run(batches):
        s = sieve.value
        for t in filled(batches):
            codes = []
            for n, body in zip(column(t, "n").to_pylist(), column(t, "body")):
                code = shingle_codes(_unpacked(body.as_py(), n))[1]
                codes.append(np.unique(code[s.has(code)]))
            code, docs = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(docs.astype(np.int64))], names=["code", "docs"])

    return encoded.select("n", "body").mapInArrow(run, "code bigint, docs bigint").groupBy("code").agg(F.sum("docs").alias("docs"))


def _prefixed(blocks: DataFrame, counts: DataFrame, share: float, item_gap: int) -> DataFrame:
    """``block``, ``anchors`` (number of prefix codes), ``body`` with the items' necessary prefixes."""

    def codes(batches):
        for b in batches:
            for block, body in zip(b.column("block").to_pylist(), b.column("body").to_pylist()):
                code = np.unique(np.concatenate([shingle_codes(w)[1] for w in pickle.loads(body)[1]]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), block)), pa.array(code)], names=["block", "code"])

    def choose(batches):
        for b in batches:
            for block, body, known in zip(b.column("block").to_pylist(), b.column("body").to_pylist(), b.column("known")):
                ids, words = pickle.loads(body)
                own = ItemBlock(ids, words, share)
                docs = np.zeros(len(own.code), np.float64)
                if known.is_valid:
                    k = known.values
                    docs[np.searchsorted(own.code, k.field("code").to_numpy(zero_copy_only=False))] = k.field("docs").to_numpy(zero_copy_only=False)
                picked = [anchors(c, int(s) - SHINGLE + 1, item_gap + SHINGLE) for c, s in zip(own.costs(docs), own.span)]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sum(map(len, picked))], pa.int64()), pa.array([pickle.dumps((ids, words, picked))], pa.binary())], names=["block", "anchors", "body"])

    own = blocks.select("block", "body").mapInArrow(codes, "block bigint, code bigint")
    known = own.join(counts, "code").groupBy("block").agg(F.collect_list(F.struct("code", "docs")).alias("known"))  # a block's own codes
    return blocks.select("block", "body").join(known, "block", "left").mapInArrow(choose, "block bigint, anchors bigint, body binary")


def _matched(encoded: DataFrame, blocks: DataFrame, out: T.StructType, share: float, doc_gap: int, item_gap: int) -> DataFrame:
    """The cases of some blocks whose prefixes are small enough to be sent to every task."""
    spark = encoded.sparkSession

    def prefix(batches):
        for b in batches:
            for block, body in zip(b.column("block").to_pylist(), b.column("body").to_pylist()):
                _, words, picked = pickle.loads(body)
                code = np.unique(np.concatenate([shingle_codes(w)[1][a] for w, a in zip(words, picked)]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), block)), pa.array(code)], names=["block", "code"])

    got = blocks.mapInArrow(prefix, "block bigint, code bigint").toPandas().sort_values("code")
    numbers, of = np.unique(got["block"].to_numpy(np.int64), return_inverse=True)
    code, first = np.unique(got["code"].to_numpy(np.int64), return_index=True)
    sent = spark.sparkContext.broadcast((Sieve.of(code), code, np.append(first, len(got)), of.astype(np.int32), numbers))

    def routes(t):
        """Rows of a table of documents and the numbers of the blocks they go to."""
        s, code, first, of, numbers = sent.value
        rows, to = [], []
        for i, (n, body) in enumerate(zip(column(t, "n").to_pylist(), column(t, "body"))):
            c = shingle_codes(_unpacked(body.as_py(), n))[1]
            c = c[s.has(c)]
            k = np.minimum(np.searchsorted(code, c), len(code) - 1)
            k = np.unique(k[code[k] == c])
            b = np.unique(of[_spread(first[k], first[k + 1] - first[k])])
            rows.append(np.full(len(b), i))
            to.append(b)
        return np.concatenate(rows), np.concatenate(to)

    def weigh(batches):
        for t in filled(batches):
            rows, to = routes(t)
            words = np.bincount(to, column(t, "n").to_numpy()[rows], len(sent.value[4])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(words)), pa.array(words[words > 0])], names=["block", "words"])

    weights = {r["block"]: r["words"] for r in encoded.select("n", "body").mapInArrow(weigh, "block bigint, words bigint").groupBy("block").agg(F.sum("words").alias("words")).collect()}  # a row per block
    each = min(SALT_WORDS, max(1, sum(weights.values()) // spark.sparkContext.defaultParallelism))
    salts = np.array([-(-weights.get(b, 0) // each) for b in range(len(numbers))], np.int64)
    base = np.concatenate([[0], np.cumsum(salts)])
    if not base[-1]:
        return spark.createDataFrame([], out)
    kind = T.StructType([T.StructField("task", T.IntegerType()), T.StructField("kind", T.IntegerType()), out["doc_id"], T.StructField("n", T.LongType()), T.StructField("body", T.BinaryType())])

    def send(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, turn = to_arrow_schema(kind), TaskContext.get().partitionId()
        for t in filled(batches):
            rows, to = routes(t)
            task = base[to] + (turn + np.arange(len(to))) % salts[to]
            turn += len(to)
            at = pa.array(rows)
            yield from pa.table([pa.array(task.astype(np.int32)), pa.array(np.ones(len(to), np.int32)), *[column(t, c).take(at) for c in ("doc_id", "n", "body")]], schema=schema).to_batches()

    copies = spark.createDataFrame([(int(numbers[b]), int(base[b]), int(base[b + 1]) - 1) for b in np.flatnonzero(salts)], "block bigint, low int, high int")
    items = blocks.join(copies, "block").select(F.explode(F.sequence("low", "high")).alias("task"), F.lit(0).alias("kind"), F.lit(None).cast(out["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("bigint").alias("n"), "body")
    rows = items.unionAll(encoded.mapInArrow(send, kind)).repartitionById(int(base[-1]), "task").sortWithinPartitions("task", "kind")

    def match(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, block, held, size = to_arrow_schema(out), None, [], 0

        def cases():
            best = found_in(block, [w for _, w in held], doc_gap, item_gap)
            got = [(held[d][0], block.ids[i], len(block.own[i]), spanned, matched, spanned / len(block.own[i]), *ends) for (d, i), (spanned, matched, *ends) in best.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), schema)], schema=schema) if got else None

        for b in batches:
            for what, ident, n, body in zip(b.column("kind").to_pylist(), b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("body")):
                if what == 0 or size >= BATCH_WORDS:
                    if held and (c := cases()) is not None:
                        yield c
                    held, size = [], 0
                if what == 0:
                    ids, words, picked = pickle.loads(body.as_py())
                    block = ItemBlock(ids, words, share, picked)
                else:
                    held.append((ident, _unpacked(body.as_py(), n)))
                    size += n
        if held and (c := cases()) is not None:
            yield c

    return rows.mapInArrow(match, out)


def leak_report(found: DataFrame) -> DataFrame:
    """Items that leaked: ``item_id``, ``docs``, ``best_coverage``, ``whole`` (documents with at least 95 % of it)."""
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"), F.max("coverage").alias("best_coverage"), F.sum((F.col("coverage") >= 0.95).cast("bigint")).alias("whole"))
