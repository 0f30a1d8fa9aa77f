"""Queries of the text problems (p6 to p8). Where SQL cannot express one, tests compare it with brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.common import normalised
from .language import detect_languages, fit_on, wrong_labels
from .leaks import leak_report, leaked_passages
from .mix import measured, mix_report, mixed, shares


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _leaks(spark, d):
    return leaked_passages(_read(spark, d, "documents"), "doc_id", "text", _read(spark, d, "eval_item"), "item_id", "passage")


def p6_found(spark, d):
    return _leaks(spark, d).select("doc_id", "item_id")


def p6_leaks(spark, d):
    return _leaks(spark, d)


def p6_report(spark, d):
    return leak_report(_leaks(spark, d))


def _measured(spark, d):
    return measured(_read(spark, d, "documents"), "doc_id", "text", "source")


def _report(spark, d):
    rows, targets = _measured(spark, d), _read(spark, d, "mix_target")
    return mix_report(mixed(rows, targets), targets, rows)


def p7_found(spark, d):
    """Sources that did not give their target in the mix itself."""
    return _report(spark, d).where(~F.col("reached")).select("source")


def p7_shares(spark, d):
    return shares(_measured(spark, d), _read(spark, d, "mix_target"))


def p7_mix(spark, d):
    return mixed(_measured(spark, d), _read(spark, d, "mix_target"))


def p7_report(spark, d):
    return _report(spark, d)


def _by_letters(spark, d):
    """The documents that have a source, measured in code points: a size that SQL knows as well."""
    docs = _read(spark, d, "documents").select("doc_id", normalised("source").alias("source"), F.col("n_chars").alias("tokens")).where("source != ''")
    return docs, _read(spark, d, "mix_target")


def p7_letter_shares(spark, d):
    rows, targets = _by_letters(spark, d)
    return shares(rows, targets).select("source", "records", "tokens", "target_tokens", "capacity_tokens", "mixed_tokens", "reached")


def p7_letter_report(spark, d):
    """What a mix measured in code points must hold, whatever the order its records are dealt in."""
    rows, targets = _by_letters(spark, d)
    return mix_report(mixed(rows, targets), targets, rows).select("source", "target_tokens", "reached", (F.col("most_uses") > 0).alias("used"))


def _model(spark, d):
    return fit_on(_read(spark, d, "eval_item"), "passage", "lang")


def p8_languages(spark, d):
    return detect_languages(_read(spark, d, "documents"), "text", ["doc_id"], _model(spark, d))


def p8_found(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", F.col("lang").alias("label"), "text")
    found = detect_languages(docs, "text", ["doc_id", "label"], _model(spark, d))
    return wrong_labels(found, "label", _read(spark, d, "lang_alias")).select("doc_id", "block_no", "lang")


QUERIES = {f.__name__: f for f in (p6_found, p6_leaks, p6_report, p7_found, p7_shares, p7_mix, p7_report, p7_letter_shares, p7_letter_report, p8_found, p8_languages)}
_LETTERS = """WITH d AS (SELECT lower(trim(source, ' \t')) AS source, count(*) AS records, sum(n_chars) AS tokens FROM documents WHERE lower(trim(source, ' \t')) <> '' GROUP BY 1),
t AS (SELECT lower(trim(m.source, ' \t')) AS source, weight, max_repeat, coalesce(records, 0) AS records, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens, weight * (SELECT sum(tokens) FROM d) AS target_tokens
  FROM mix_target m LEFT JOIN d ON lower(trim(m.source, ' \t')) = d.source)"""
SQL: dict[str, str] = {
    "p7_letter_shares": f"{_LETTERS} SELECT source, records, tokens, target_tokens, tokens * max_repeat AS capacity_tokens, least(target_tokens, tokens * max_repeat) AS mixed_tokens, tokens * max_repeat >= target_tokens AS reached FROM t",
    "p7_letter_report": f"{_LETTERS} SELECT source, target_tokens, tokens * max_repeat >= target_tokens AS reached, tokens * max_repeat > 0 AS used FROM t",
}
