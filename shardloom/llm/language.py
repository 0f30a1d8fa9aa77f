"""Languages of documents and of blocks within them: family first, then one-versus-one linear machines within it.

A text is scored by hashed 3- and 4-grams of its bytes (lower case, words separated by one space). One linear support
vector machine separates each pair of families and each pair of languages of a family; a machine's value for a text is
the sum of its weights over the text's grams, so all machines are one table and a block is one sum of its rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import spread
from .words import repaired

#: Families of closely related languages (fixed values); a language not named here is a family of its own.
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance"}
#: Most labelled rows that are taken to fit the machines.
MOST_SAMPLES = 3000
SLOT_BITS = 15
#: Words of the pieces on which the machines are fitted.
PIECE_WORDS = 24
#: Bytes scored at once.
SCORED = 1 << 19

# a \r before \n is never a line end of its own, else one CRLF counted as two
BLANK = re.compile(r"(?:\r\n|\r(?!\n)|\n)[ \t]*(?:(?:\r\n|\r(?!\n)|\n)[ \t]*)+")
_MARK = "\x01"
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() or c == 1 else 32 for c in range(256))
_SPACES = np.zeros(256, bool)
_SPACES[[1, 9, 10, 11, 12, 13, 32]] = True


def _clean(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", repaired(text))
    return text


def _slots(letters: np.ndarray) -> np.ndarray:
    """Slots of the 3-grams and 4-grams that start at each byte but the last three, one after the other."""
    x = letters.astype(np.uint32)
    three = x[:-3] | x[1:-2] << 8 | x[2:-1] << 16
    four = three | x[3:] << 24
    return np.concatenate([(three * np.uint32(2654435769)) >> np.uint32(32 - SLOT_BITS), ((four ^ np.uint32(0x9E3779)) * np.uint32(2246822519)) >> np.uint32(32 - SLOT_BITS)])


def _letters(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).replace(b"\x01", b" ").split()) + b" "


class Model:
    """Machines of all pairs in one table: ``weights[machine, slot]``."""

    def __init__(self, langs: list[str], families: Mapping[str, str]):
        self.langs = sorted(langs)
        self.family = [families.get(x, x) for x in self.langs]
        self.families = sorted(set(self.family))
        self.pairs = [("family", a, b) for a, b in combinations(range(len(self.families)), 2)]
        self.pairs += [("lang", a, b) for a, b in combinations(range(len(self.langs)), 2) if self.family[a] == self.family[b]]
        self.weights = np.zeros((len(self.pairs), 1 << SLOT_BITS), np.float32)
        self.slope = 1.0

    def sides(self, labels: np.ndarray, pair) -> np.ndarray:
        """1 and -1 for the two sides of a machine, 0 for texts that are on neither."""
        kind, a, b = pair
        x = np.array([self.families.index(self.family[i]) for i in labels]) if kind == "family" else labels
        return np.where(x == a, 1, np.where(x == b, -1, 0))

    def _votes(self, chance: np.ndarray, kind: str, n: int):
        """Votes of the machines of a kind and the least chance any of them leaves each side."""
        votes, sure = np.zeros((len(chance), n)), np.ones((len(chance), n))
        for m, (k, a, b) in enumerate(self.pairs):
            if k == kind:
                p = chance[:, m]
                votes[:, a] += (p >= 0.5) + p / 1e3
                votes[:, b] += (p < 0.5) + (1 - p) / 1e3
                sure[:, a], sure[:, b] = np.minimum(sure[:, a], p), np.minimum(sure[:, b], 1 - p)
        return votes, sure

    def family_of(self, values: np.ndarray, grams=None):
        """Family number and its chance for rows of machine values."""
        margins = values / np.sqrt(np.maximum(1 if grams is None else grams, 1)).reshape(-1, 1) * self.slope
        votes, sure = self._votes(1 / (1 + np.exp(-np.clip(margins, -30, 30))), "family", len(self.families))
        family = votes.argmax(axis=1)
        return family, sure[np.arange(len(values)), family]

    def decide(self, values: np.ndarray, grams: np.ndarray):
        """Language number and confidence of rows of machine values over so many grams: the family first, then the
        language with most votes within it."""
        family, family_sure = self.family_of(values, grams)
        margins = values / np.sqrt(np.maximum(grams, 1))[:, None] * self.slope
        votes, sure = self._votes(1 / (1 + np.exp(-np.clip(margins, -30, 30))), "lang", len(self.langs))
        inside = np.array([self.families.index(f) for f in self.family])[None, :] == family[:, None]
        lang = np.where(inside, votes, -1).argmax(axis=1)
        return lang, family_sure * sure[np.arange(len(values)), lang]


def fit(samples: list[tuple[str, str]], families: Mapping[str, str] = FAMILIES, epochs: int = 6, seed: int = 5) -> Model:
    """Machines fitted on (text, language) by averaged stochastic subgradient steps on the hinge loss (no bias term, so
    the sign does not depend on a text's length). A tenth of the pieces is held out to scale the confidence."""
    model = Model(sorted({x for _, x in samples}), families)
    rows, labels = [], []
    for text, lang in samples:
        w = _letters(_clean(text)).split()
        for i in range(0, len(w), PIECE_WORDS):
            if len(piece := w[i : i + PIECE_WORDS]) * 2 >= PIECE_WORDS or not i and piece:
                slots, n = np.unique(_slots(np.frombuffer(b" " + b" ".join(piece) + b"   ", np.uint8)), return_counts=True)
                rows.append((slots, (n / np.sqrt((n * n).sum())).astype(np.float32), int(n.sum()), n.astype(np.float32)))
                labels.append(model.langs.index(lang))
    labels, rng = np.array(labels), np.random.default_rng(seed)
    held = rng.random(len(rows)) < 0.1
    lam = 1e-4
    for m, pair in enumerate(model.pairs):
        side = model.sides(labels, pair)
        own = np.flatnonzero((side != 0) & ~held)
        w, total, scale, t = np.zeros(1 << SLOT_BITS), np.zeros(1 << SLOT_BITS), 1.0, 1
        for epoch in range(epochs):
            for i in rng.permutation(own):
                slots, x = rows[i][:2]
                t += 1
                rate = 1 / (lam * (t + 1000))
                value = scale * (w[slots] @ x)
                scale *= 1 - rate * lam
                if side[i] * value < 1:
                    w[slots] += side[i] * rate / scale * x
            if epoch >= epochs // 2:
                total += scale * w
        model.weights[m] = total / max(1, np.sqrt((total**2).sum()))
    # one slope for all machines, by likelihood on the pieces held out
    margins = []
    for i in np.flatnonzero(held):
        slots, _, grams, n = rows[i]
        v = model.weights[:, slots] @ n / np.sqrt(max(1, grams))
        margins += [v[m] * s for m, pair in enumerate(model.pairs) if (s := model.sides(labels[i : i + 1], pair)[0])]
    if margins:
        x = np.array(margins)
        model.slope = float(min((2.0**k for k in range(-6, 10)), key=lambda a: np.logaddexp(0, -a * x).mean()))
    return model


def fit_on(labelled: DataFrame, text: str, lang: str, most: int = MOST_SAMPLES, families: Mapping[str, str] = FAMILIES) -> Model:
    """Machines fitted on at most ``most`` labelled rows: those with the smallest hash of their text, a sample that is
    the same at every run. Rows without text or label are left out; without two languages every text gets the one."""
    rows = labelled.where((F.col(text) != "") & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    got = rows.orderBy(F.xxhash64("t"), "l").limit(most).collect()
    if not got:
        raise ValueError("no labelled rows")
    return fit([(r.t, r.l) for r in got], families)


def _add(model: Model, values, machines, slots, of, first) -> None:
    """Add the machines' weights of the grams (3-grams, then 4-grams, of the same blocks) to the values of their blocks."""
    for m in machines:
        w = model.weights[m][slots]
        values[of[first], m] += np.add.reduceat(w[: len(of)] + w[len(of) :], first)


def block_scores(model: Model, texts: list[str]):
    """Per block of the texts: text number, block number from 1, words, grams, machine values."""
    marked = [BLANK.sub(f"\n{_MARK}\n", _clean(t).replace(_MARK, " ")).lower().encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer((b"\n" + _MARK.encode() + b"\n").join([*marked, b""]), np.uint8)
    mark = raw == 1
    block = np.cumsum(mark)
    n_blocks = int(block[-1]) + 1 if len(block) else 0
    of_text = np.repeat(np.arange(len(texts)), [m.count(b"\x01") + 1 for m in marked])
    space = _SPACES[raw]
    begins = ~space
    begins[1:] &= space[:-1]
    words = np.bincount(block[begins], minlength=n_blocks)[: len(of_text)]
    letters = np.frombuffer(raw.tobytes().translate(_LETTERS), np.uint8)
    letters = np.where(mark, np.uint8(32), letters)
    keep = letters != 32
    keep[1:] |= letters[:-1] != 32  # one space after a word
    keep |= mark  # and one before the first word of a block
    letters, block = letters[keep], block[keep]
    values, grams = np.zeros((n_blocks, len(model.pairs)), np.float32), np.zeros(n_blocks, np.int64)
    kind = np.array([k == "lang" for k, _, _ in model.pairs], bool)
    machine_family = [model.family[a] if k == "lang" else None for k, a, _ in model.pairs]
    chunks = [(lo, block[lo : min(lo + SCORED, len(letters) - 3)]) for lo in range(0, max(0, len(letters) - 3), SCORED)]
    for lo, of in chunks:  # families, all blocks
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        grams[of[first]] += 2 * np.diff(np.append(first, len(of)))
        _add(model, values, np.flatnonzero(~kind), _slots(letters[lo : lo + len(of) + 3]), of, first)
    family = model.family_of(values)[0]
    for lo, of in chunks:  # the languages of its family, each block
        slots, own = _slots(letters[lo : lo + len(of) + 3]), family[of]
        for f, name in enumerate(model.families):
            machines = [m for m, x in enumerate(machine_family) if x == name]
            here = np.flatnonzero(own == f)
            if machines and len(here):
                at = of[here]
                _add(model, values, machines, np.concatenate([slots[: len(of)][here], slots[len(of) :][here]]), at, np.flatnonzero(np.append(True, at[1:] != at[:-1])))
    some = np.flatnonzero(words > 0)
    of_text = of_text[some]
    new = np.append(True, of_text[1:] != of_text[:-1]) if len(of_text) else np.zeros(0, bool)
    number = np.arange(len(some)) - np.maximum.accumulate(np.where(new, np.arange(len(some)), 0)) + 1 if len(some) else some
    return of_text, number, words[some], grams[some], values[some]


def detect_languages(df: DataFrame, text: str, keep: list[str], model: Model, least_words: int = 20) -> DataFrame:
    """Per document a row with ``block_no`` 0 and the main language, and a row for each block of at least
    ``least_words`` words that is written in another language: the ``keep`` columns, ``block_no``, ``lang``,
    ``confidence`` (0 to 1), ``words``, ``characters`` (of the whole text). A kept column that has the name of one of
    these comes out as ``<name>_kept``.

    Blocks are the pieces between blank lines, numbered from 1. The main language is that of most words, counting each
    block's words for the block's language; of equal counts the alphabetically first. Its confidence is the average of
    its blocks' confidences by words, times its share of the words.

    Cases: a null or empty text, or one without a word, gives one row with null language and confidence 0; blocks without
    letters count for the language of their document (they have no vote); very long texts are scored in parts of bounded
    size, whole; repeated documents give rows each; an empty table gives no row.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    kept = [f"kept_{i}" for i in range(len(keep))]
    df = spread(df.select(*[F.col(c).alias(k) for c, k in zip(keep, kept)], F.col(text).alias("text")), kept[0] if kept else "text")
    out = T.StructType([*[df.schema[c] for c in kept], T.StructField("block_no", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("words", T.LongType()), T.StructField("characters", T.LongType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, m = to_arrow_schema(out), sent.value
        names = np.array([*m.langs, None], dtype=object)
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                texts = [x or "" for x in part.column("text").to_pylist()]
                doc, number, words, grams, values = block_scores(m, texts)
                lang, sure = m.decide(values, grams)
                voting = np.where(grams > 8, words, 0)
                count = np.zeros((len(texts), len(m.langs)))
                weight = np.zeros((len(texts), len(m.langs)))
                np.add.at(count, (doc, lang), voting)
                np.add.at(weight, (doc, lang), voting * sure)
                main, r = count.argmax(axis=1), np.arange(len(texts))
                total = count.sum(axis=1)
                share = weight[r, main] / np.maximum(total, 1)
                main = np.where(total > 0, main, len(m.langs))
                all_words = np.bincount(doc, weights=words, minlength=len(texts)).astype(np.int64)
                other = np.flatnonzero((words >= least_words) & (grams > 8) & (lang != main[doc])) if len(doc) else doc
                at = np.concatenate([r, doc[other]])
                order = np.argsort(at, kind="stable")
                length = np.array([len(t) for t in texts])
                cols = [np.concatenate(x)[order] for x in ((np.zeros(len(r), np.int32), number[other].astype(np.int32)), (names[main], names[lang[other]]), (share, sure[other]), (all_words, words[other].astype(np.int64)))]
                at = at[order]
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(pa.array(at)) for c in kept], *[pa.array(c, f.type) for c, f in zip([*cols, length[at]], list(schema)[len(kept) :])]], schema=schema)

    own = out.names[len(keep) :]
    return df.mapInArrow(run, out).select(*[F.col(k).alias(f"{c}_kept" if c in own else c) for c, k in zip(keep, kept)], *own)


def wrong_labels(found: DataFrame, label: str, aliases: DataFrame, least_characters: int = 20) -> DataFrame:
    """Of ``detect_languages``: the documents whose label names no language or another than the main one (block_no 0),
    and all blocks in another language. Aliases (``label``, ``lang``) are compared exactly; a null label names none."""
    named = aliases.select(F.col("label").alias("alias"), F.col("lang").alias("named")).where(F.col("alias").isNotNull()).dropDuplicates(["alias"])
    rows = found.where((F.col("characters") >= least_characters) & F.col("lang").isNotNull())
    rows = rows.join(named, F.col(label) == F.col("alias"), "left")
    return rows.where((F.col("block_no") > 0) | F.col("named").isNull() | (F.col("named") != F.col("lang")))
