"""Where a statement names tables, by Spark's own parser: texts and comments that mention a name do not count."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Quoted text, quoted names and comments; everything else is code.
QUOTED = re.compile(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/)", re.S)


@dataclass(frozen=True)
class Reference:
    """A table's name in a statement, from ``start`` up to ``stop``; ``aliased`` if the statement gives it another one."""

    name: str
    start: int
    stop: int
    aliased: bool


def _items(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def references(parser, sql: str) -> list[Reference]:
    """Names of one part that stand for tables, in the order of the text; names that WITH defines are none."""
    found: dict[int, Reference] = {}

    def plan(p, aliased, hidden):
        kind = p.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            parts, at = list(_items(p.multipartIdentifier())), p.origin()
            if len(parts) == 1 and parts[0].lower() not in hidden and at.startIndex().isDefined():
                found[at.startIndex().get()] = Reference(parts[0].lower(), at.startIndex().get(), at.stopIndex().get() + 1, aliased)
            return
        if kind == "UnresolvedWith":
            for cte in _items(p.cteRelations()):
                plan(cte._2(), False, hidden)
                hidden = hidden | {cte._1().lower()}
        for child in _items(p.children()):
            plan(child, kind == "SubqueryAlias", hidden)
        for e in _items(p.expressions()):
            expression(e, hidden)

    def expression(e, hidden):
        if e.getClass().getSimpleName() in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
            plan(e.plan(), False, hidden)
        for child in _items(e.children()):
            expression(child, hidden)

    plan(parser.parsePlan(sql), False, frozenset())
    return [found[k] for k in sorted(found)]


def renamed(sql: str, names: list[tuple[Reference, str]]) -> str:
    """``sql`` with each reference replaced by another table that keeps the old name as its alias."""
    for r, new in sorted(names, key=lambda x: -x[0].start):
        sql = sql[: r.start] + new + ("" if r.aliased else f" AS {sql[r.start : r.stop]}") + sql[r.stop :]
    return sql


def outside(text: str, word: str) -> list[int]:
    """Places of a word or sign outside of quotes, comments and brackets."""
    hidden, depth, out = QUOTED.sub(lambda m: "\0" * len(m[0]), text), 0, []
    pattern = re.compile(rf"[()]|(?<!\w){re.escape(word)}(?!\w)" if word.isalnum() else rf"[()]|{re.escape(word)}", re.I)
    for m in pattern.finditer(hidden):
        if m[0] in "()":
            depth += 1 if m[0] == "(" else -1
        elif not depth:
            out.append(m.start())
    return out


def split_change(rest: str) -> tuple[str | None, dict[str, str], str]:
    """Alias, assignments and condition of an UPDATE or DELETE from the text after its table's name."""
    m = re.match(r"\s*(?:as\s+)?(?!(?:where|set)\b)(`[^`]+`|\w+)?", rest, re.I)
    alias, rest = (m[1], rest[m.end() :]) if m and m[1] else (None, rest)
    where = outside(rest, "where")
    head, cond = (rest[: where[0]], rest[where[0] + 5 :].strip()) if where else (rest, "true")
    changes: dict[str, str] = {}
    m = re.match(r"\s*set\b", head, re.I)
    if m:
        head = head[m.end() :]
        cuts = [-1, *outside(head, ","), len(head)]
        for a, b in zip(cuts, cuts[1:]):
            key, _, value = head[a + 1 : b].partition("=")
            changes[key.strip().split(".")[-1].strip("`")] = value.strip()
    return alias, changes, cond
