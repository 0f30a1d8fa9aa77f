"""A mix of sources by target weights: token counts, a low-discrepancy schedule of slots, and shuffled blocks."""

from __future__ import annotations

import base64
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import ensure_checkpoint_dir, normalised, spread

#: Where the vocabulary files of public tokenizers are.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokenizer pattern that belongs to the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most sources of a mix; a row of each is kept by every task.
MOST_SOURCES = 10_000
#: Binary digits of a schedule point.
BITS = 40
#: Records of a bucket, about; each bucket is shuffled and added up by itself.
BUCKET_RECORDS = 20_000
#: Slots that the smallest target fills at least; blocks are made smaller for it.
LEAST_SLOTS = 8

#: Most bytes of a vocabulary file; it is sent to every executor, which need not have the file.
MOST_VOCABULARY = 64 << 20

_encodings: dict = {}


def _encoding(path: str):
    with open(path, "rb") as f:
        return _tokenizer(f.read())


def _tokenizer(raw: bytes):
    """The tokenizer of a vocabulary file's content, kept for as long as the Python process."""
    known = len(raw), zlib.crc32(raw)
    if known not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _encodings[known] = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[known]


#: A text is cut for encoding at line ends after so many characters: the encoder's memory stays small on huge texts.
PIECE = 1 << 20


def token_count(encoding, text: str | None) -> int:
    """Tokens of the whole text; null and empty texts have none."""
    if not text:
        return 0
    if len(text) <= PIECE:
        return len(encoding.encode_ordinary(text))
    n, at = 0, 0
    while at < len(text):
        # a cut between a letter and the next space is one the pattern makes as well, so the count stays exact
        end = at + PIECE
        while end < len(text) and not (text[end - 1].isalpha() and text[end] == " "):
            end += 1
        n, at = n + len(encoding.encode_ordinary(text[at:end])), end
    return n


def with_tokens(df: DataFrame, text: str, name: str = "tokens", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the number of tokens of ``text`` in place of the text; each text is read once and not shuffled.

    Null and empty texts have 0 tokens. A column called ``name`` is replaced.
    """
    with open(f"{tokenizers}/{vocabulary}", "rb") as f:
        raw = f.read(MOST_VOCABULARY + 1)
    if len(raw) > MOST_VOCABULARY:
        raise ValueError(f"a vocabulary of more than {MOST_VOCABULARY} bytes")
    sent = df.sparkSession.sparkContext.broadcast(raw)
    rest = [f for f in df.schema.fields if f.name not in (text, name)]
    out = T.StructType([*rest, T.StructField(name, T.LongType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        enc, schema = _tokenizer(sent.value), to_arrow_schema(out)
        for b in batches:
            n = [token_count(enc, x.as_py()) for x in b.column(text)]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in rest], pa.array(n, pa.int64())], schema=schema)

    return df.select(*[f.name for f in rest], text).mapInArrow(run, out)


def reversed_bits(i: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Van der Corput points of base 2 as integers of ``bits`` digits: the binary digits of i in reverse."""
    x, r = i.astype(np.int64), np.zeros(len(i), np.int64)
    for _ in range(bits):
        r, x = (r << 1) | (x & 1), x >> 1
    return r


def points_below(n: np.ndarray, limit: int, bits: int = BITS) -> np.ndarray:
    """How many of the first n points lie below ``limit``: each one digit of the limit is an interval of points whose
    index has a known remainder, so a slot's rank needs neither a sort nor the slots before it."""
    n, total = n.astype(np.int64), np.zeros(len(n), np.int64)
    if limit >= 1 << bits:
        return n.copy()
    for p in range(1, bits + 1):
        if limit >> (bits - p) & 1:
            prefix = (limit >> (bits - p)) ^ 1
            residue = int(reversed_bits(np.array([prefix]), p)[0])
            total += np.where(n > residue, (n - 1 - residue) // (1 << p) + 1, 0)
    return total


class Schedule:
    """Slots of sources: slot i goes to the source into whose share of the unit interval its point falls."""

    def __init__(self, weights: list[float]):
        total = float(sum(weights))
        if not total > 0 or min(weights) < 0:
            raise ValueError("weights are not negative and not all 0")
        upto = np.cumsum(np.array(weights, float) / total)
        self.edges = [0, *[min(1 << BITS, int(round(x * (1 << BITS)))) for x in upto[:-1]], 1 << BITS]

    def sources(self, slots: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.edges[1:]), reversed_bits(slots), side="right")

    def ranks(self, slots: np.ndarray, source: int) -> np.ndarray:
        """Number of earlier slots of the source."""
        return points_below(slots, self.edges[source + 1]) - points_below(slots, self.edges[source])


def measured(docs: DataFrame, doc_id: str, text: str, source: str, **tokenizer) -> DataFrame:
    """``doc_id``, ``source``, ``tokens`` of the documents that have a source, written to the checkpoint folder: the
    tokens are counted once, whatever is asked of them later. Sources are compared in lower case without surrounding
    white space; null or empty ones are no source. Repeated documents are records of their own."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(source).alias("source"), F.col(text).alias("text")).where(F.col("source") != "")
    return with_tokens(spread(rows, "doc_id"), "text", **tokenizer).checkpoint()


def shares(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """What each source can and does give in a mix as large as all ``rows``: ``source``, ``weight``, ``max_repeat``,
    ``records``, ``tokens``, ``target_tokens``, ``capacity_tokens`` (with every record used max_repeat times),
    ``mixed_tokens`` (the smaller of both), ``target_share``, ``actual_share``, ``repeats`` (average uses of a record),
    ``reached``. Targets are few rows: one per source; sources without documents have 0 tokens; rows of sources without
    a target count in the size of the mix only. Empty targets give no row."""
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("tokens").alias("tokens"))
    size = F.coalesce(per.agg(F.sum("tokens")).scalar(), F.lit(0))
    wanted = targets.select(normalised("source").alias("source"), F.col("weight").cast("double").alias("weight"), F.col("max_repeat").cast("bigint").alias("max_repeat"))
    t = wanted.join(per, "source", "left").fillna(0, ["records", "tokens"]).withColumn("size", size)
    t = t.withColumns({"target_tokens": F.col("weight") * F.col("size"), "capacity_tokens": F.col("tokens") * F.col("max_repeat")})
    t = t.withColumn("mixed_tokens", F.least(F.col("target_tokens"), F.col("capacity_tokens").cast("double")))
    t = t.withColumn("actual_share", F.col("mixed_tokens") / F.nullif(F.sum("mixed_tokens").over(Window.partitionBy()), F.lit(0.0)))  # a row per source
    return t.select("source", "weight", "max_repeat", "records", "tokens", "target_tokens", "capacity_tokens", "mixed_tokens", F.col("weight").alias("target_share"), "actual_share", (F.col("mixed_tokens") / F.nullif(F.col("tokens"), F.lit(0))).alias("repeats"), (F.col("capacity_tokens") >= F.col("target_tokens")).alias("reached"))


def mixed(rows: DataFrame, targets: DataFrame, block_tokens: int = 65_536, seed: int = 7) -> DataFrame:
    """The mix itself: ``slot``, ``source``, ``block``, ``use`` (0 for the first use of a record), ``doc_id``, ``tokens``.

    The mix has the size of all ``rows``. Its slots are dealt to the sources by a van der Corput sequence, so every
    stretch of slots holds the weights closely; the r-th slot of a source takes its r-th block of shuffled records,
    starting over up to ``max_repeat`` times. A slot has ``block_tokens`` tokens, or fewer if the smallest target of a
    source with tokens would fill less than LEAST_SLOTS of them. The last block of a source ends with the record that
    reaches its ``target_tokens`` (rounded up), so at every size a source that is not used up gives its target and less
    than one record more; the last slots of a mix may therefore lie a little behind its size. Slots of a source that is used up
    stay empty. Order by slot, then by ``place`` within it.

    A record longer than a block fills the slots it reaches into. Records without tokens are left out. The shuffle is by
    hash of seed, use and record, so it is repeatable; each use is shuffled anew.

    Plan: the places of a source's tokens come from sums per hash bucket (one per BUCKET_RECORDS records of the source)
    and windows within a bucket, so a source that holds most records is spread like any other; buckets beyond the budget
    are left out before the windows; slots are computed, not joined.
    """
    spark = rows.sparkSession
    plan = [r.asDict() for r in shares(rows, targets).orderBy("source").limit(MOST_SOURCES + 1).collect()]
    if len(plan) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if not plan or not any(r["target_tokens"] for r in plan):
        return spark.createDataFrame([], "slot bigint, source string, block bigint, use int, doc_id string, tokens bigint, place bigint")
    schedule, names = Schedule([r["weight"] for r in plan]), [r["source"] for r in plan]
    budgets = [math.ceil(r["target_tokens"]) for r in plan]
    block_tokens = max(1, min([block_tokens, *[b // LEAST_SLOTS for b, r in zip(budgets, plan) if b and r["tokens"]]]))
    blocks = [-(-b // block_tokens) if r["tokens"] else 0 for b, r in zip(budgets, plan)]
    if any(n and schedule.edges[k] == schedule.edges[k + 1] for k, n in enumerate(blocks)):
        raise ValueError(f"a weight is less than one part in 2^{BITS}")
    n_slots = max(1, sum(blocks))
    while any(schedule.ranks(np.array([n_slots]), k)[0] < n for k, n in enumerate(blocks)):
        n_slots *= 2
    uses = [min(r["max_repeat"], -(-b // r["tokens"])) if r["tokens"] else 0 for r, b in zip(plan, budgets)]
    wanted = spark.createDataFrame([(k, s, max(u, 0), b, r["tokens"], max(1, r["records"] // BUCKET_RECORDS)) for k, (s, u, b, r) in enumerate(zip(names, uses, budgets, plan))], "k int, source string, uses int, budget bigint, of_source bigint, buckets bigint")
    used = rows.where("tokens > 0").join(F.broadcast(wanted.where("uses > 0")), "source").withColumn("use", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
    used = used.withColumn("order", F.xxhash64(F.lit(seed), F.col("use"), F.col("doc_id"))).withColumn("bucket", F.pmod(F.shiftright("order", 24), F.col("buckets")))
    per = used.groupBy("k", "use", "bucket", "budget", "of_source").agg(F.sum("tokens").alias("sum")).withColumn("part", F.floor(F.col("bucket") / 4_096))
    parts = per.groupBy("k", "use", "part").agg(F.sum("sum").alias("sum")).withColumn("upto", F.sum("sum").over(Window.partitionBy("k", "use").orderBy("part")))
    before = per.join(parts.select("k", "use", "part", (F.col("upto") - F.col("sum")).alias("early")), ["k", "use", "part"])
    before = before.withColumn("before", F.col("early") + F.sum("sum").over(Window.partitionBy("k", "use", "part").orderBy("bucket")) - F.col("sum"))
    before = before.where(F.col("use") * F.col("of_source") + F.col("before") < F.col("budget")).select("k", "use", "bucket", "before")
    w = Window.partitionBy("k", "use", "bucket").orderBy("order", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = used.join(before, ["k", "use", "bucket"]).withColumn("place", F.col("use") * F.col("of_source") + F.col("before") + F.sum("tokens").over(w) - F.col("tokens"))
    placed = placed.where(F.col("place") < F.col("budget")).withColumn("rank", F.floor(F.col("place") / block_tokens).cast("bigint"))
    edges = schedule.edges
    out = T.StructType([T.StructField("slot", T.LongType()), *[placed.schema[c] for c in ("source", "rank", "use", "doc_id", "tokens", "place")]])

    def slots(batches):
        """The slot of the r-th block of source k: the smallest i with r+1 points of the source among the first i+1."""
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for b in batches:
            k, rank = b.column("k").to_numpy(), b.column("rank").to_numpy()
            slot = np.zeros(len(k), np.int64)
            for s in np.unique(k):
                r, at = np.unique(rank[k == s], return_inverse=True)
                lo, hi = np.zeros(len(r), np.int64), np.full(len(r), n_slots, np.int64)
                while (lo < hi).any():
                    mid = (lo + hi) // 2
                    enough = points_below(mid + 1, edges[s + 1]) - points_below(mid + 1, edges[s]) > r
                    lo, hi = np.where(enough, lo, np.minimum(mid + 1, hi)), np.where(enough, mid, hi)
                slot[k == s] = lo[at]
            yield pa.RecordBatch.from_arrays([pa.array(slot), *[b.column(f.name) for f in list(schema)[1:]]], schema=schema)

    return placed.mapInArrow(slots, out).withColumnRenamed("rank", "block")


def mix_report(mix: DataFrame, targets: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Shares of a mix as it came out: ``source``, ``target_share``, ``actual_share``, ``tokens``, ``records``,
    ``most_uses`` and, given the ``rows`` it was made from, ``target_tokens`` (of a mix as large as all of them) and
    ``reached``, whether the source gave these. Sources of the targets that gave nothing have 0."""
    per = mix.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("records"), F.max(F.col("use") + 1).alias("most_uses"))
    t = targets.select(normalised("source").alias("source"), F.col("weight").cast("double").alias("target_share")).join(per, "source", "left").fillna(0, ["tokens", "records", "most_uses"])
    share = F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy()), F.lit(0))  # a row per source
    out = t.withColumn("actual_share", share).select("source", "target_share", "actual_share", "tokens", "records", "most_uses")
    if rows is None:
        return out
    target = F.col("target_share") * F.coalesce(rows.agg(F.sum("tokens")).scalar(), F.lit(0))
    return out.withColumn("target_tokens", target).withColumn("reached", F.col("tokens") >= F.col("target_tokens"))
