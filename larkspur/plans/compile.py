"""Rules to columns.

A predicate is false on an absent field before it is negated, so a negated one
is true there; every column built here is true or false, never null.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import network, regexes, text
from .model import MAX_DEPTH, NUMERIC, TEXTUAL, Kind, Op, Predicate, Rule, RuleSet, Selection, Token

# The fields that route an event, in order.
ROUTE_FIELDS = (
    "event.category", "techno", "product", "technology", "observer.product", "event.provider", "event.module",
    "event.dataset", "log.syslog.appname",
)


def predicate(p: Predicate, field) -> Column:
    raw = F.coalesce(_test(p, field(p.field), field), F.lit(False))
    return ~raw if p.negate else raw


def _test(p: Predicate, v: Column, field) -> Column:
    if p.op == Op.EXISTS:
        return v.isNotNull() & (F.length(v) > 0)
    if p.op in NUMERIC:
        return _compare(p.op, text.to_i64(v), F.lit(p.value))
    if p.op == Op.CIDR:
        return network.in_network(v, p.value)
    if p.op == Op.RE:
        return F.lit(False) if p.value is None else regexes.matches(v, p.value, p.cased)
    if p.fieldref:
        return _textual(p.op, _folded(p.field, p, field), _folded(p.value, p, field))
    if p.value is None:
        return F.lit(False)
    operand = F.lit(p.value if p.cased else text.fold_literal(p.value))
    return _textual(p.op, _folded(p.field, p, field), operand)


def _folded(name: str, p: Predicate, field) -> Column:
    """The field as the predicate compares it; a resolver may have it ready."""
    if p.cased:
        return field(name)
    ready = getattr(field, "folded", {})
    return ready[name] if name in ready else text.fold(field(name))


def folded_fields(rules: RuleSet) -> list[str]:
    """Fields that some predicate compares without regard to case."""
    out = set()
    for r in rules.rules:
        for p in r.predicates():
            if p.op in TEXTUAL and not p.cased:
                out |= {p.field, p.value} if p.fieldref else {p.field}
    return sorted(out)


def _textual(op: Op, v: Column, operand: Column) -> Column:
    if op == Op.EQ:
        return v == operand
    if op == Op.CONTAINS:
        return F.contains(v, operand)
    if op == Op.STARTSWITH:
        return F.startswith(v, operand)
    if op == Op.ENDSWITH:
        return F.endswith(v, operand)
    return F.lit(False)


def _compare(op: Op, a: Column, b: Column) -> Column:
    return {Op.GT: a > b, Op.GTE: a >= b, Op.LT: a < b, Op.LTE: a <= b, Op.NUMEQ: a == b}[op]


def selection(s: Selection, field) -> Column:
    """All groups, any predicate of each; none at all is false."""
    if not s.groups:
        return F.lit(False)
    return reduce(and_, [reduce(or_, [predicate(p, field) for p in g]) for g in s.groups])


def reduce_tokens(tokens: tuple[Token, ...], values: list, false, depth: int = MAX_DEPTH):
    """The value of a postfix condition over values; a malformed one is false.

    Works on columns and on booleans alike (operators & | and ~ or not)."""
    negate = (lambda x: not x) if isinstance(false, bool) else (lambda x: ~x)
    stack: list = []
    for t in tokens:
        if t.kind == Kind.SEL:
            if len(stack) >= depth or t.index >= len(values):
                return false
            stack.append(values[t.index])
        elif t.kind == Kind.NOT:
            if not stack:
                return false
            stack[-1] = negate(stack[-1])
        else:
            if len(stack) < 2:
                return false
            b = stack.pop()
            stack[-1] = stack[-1] & b if t.kind == Kind.AND else stack[-1] | b
    return stack[0] if len(stack) == 1 else false


def rule(r: Rule, field) -> Column:
    """Whether a rule matches, without routing."""
    values = [selection(s, field) for s in r.selections]
    if r.condition:
        return reduce_tokens(r.condition, values, F.lit(False))
    return reduce(and_, values) if values else F.lit(False)


def routes(field) -> Column:
    """The event's route values: those that are there and not empty."""
    values = F.array(*[field(name) for name in ROUTE_FIELDS])
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def in_scope(rules: RuleSet, position: int, route_values: Column) -> Column:
    """Whether routing lets a rule be verified: the event has no route value, or
    one whose bucket holds the rule, or the rule is in the bucket for every event."""
    if not rules.buckets:
        return F.lit(True)
    keys = [k for k, members in rules.buckets.items() if position in members]
    if "" in keys:
        return F.lit(True)
    unrouted = F.size(route_values) == 0
    return unrouted | F.arrays_overlap(route_values, F.lit(keys)) if keys else unrouted


def skipped_regexes(rules: RuleSet) -> int:
    """Patterns that don't compile; their predicates never match."""
    return sum(
        1
        for r in rules.rules
        for p in r.predicates()
        if p.op == Op.RE and (p.value is None or regexes.compiled(p.value, p.cased) is None)
    )
