"""Building rules by hand, and the necessary conditions that follow from them."""

from __future__ import annotations

from ..functions.text import fold_literal
from ..plans.model import NUMERIC, Kind, Network, Op, Predicate, Rule, RuleSet, Selection, Token, Verdict, Witness

_SYMBOLS = {"and": Token(Kind.AND), "or": Token(Kind.OR), "not": Token(Kind.NOT)}
#: Shortest literal that is worth looking for before a rule is verified.
MIN_LITERAL = 3


def where(field: str, op: str, *values, cased: bool = False, negate: bool = False, fieldref: bool = False):
    """A group: the field passes the test for any of the values."""
    code = Op[op.upper()]
    out = []
    for v in values or (None,):
        if code == Op.CIDR and isinstance(v, str):
            v = Network.parse(v)
        out.append(Predicate(field, code, v, cased, negate, fieldref))
    return tuple(out)


def between(field: str, low: int, high: int):
    """Two groups: low <= field <= high."""
    return where(field, "gte", low), where(field, "lte", high)


class RuleBuilder:
    """Collects rules and buckets; build() gives the rule set."""

    def __init__(self):
        self._rules: list[Rule] = []
        self._buckets: dict[str, list[int]] = {}

    def rule(
        self,
        rule_id: int,
        *selections: tuple,
        condition: str = "",
        name: str | None = None,
        verdict: str = "alert",
        severity: int = 0,
        score: float = 0.0,
        mitre: str | None = None,
        buckets: tuple[str, ...] | None = None,
    ) -> "RuleBuilder":
        """A selection is a sequence of groups; condition is postfix over selection
        numbers, `and`, `or` and `not` ("0 1 not and"); none means all of them."""
        tokens = tuple(_SYMBOLS.get(t) or Token(Kind.SEL, int(t)) for t in condition.split())
        sels = tuple(Selection(tuple(s)) for s in selections)
        self._rules.append(
            Rule(rule_id, name, sels, tokens, Verdict[verdict.upper()], severity, round(score * 100), mitre)
        )
        for b in buckets or ():
            self._buckets.setdefault(b, []).append(len(self._rules) - 1)
        return self

    def build(self, prefilter: bool = False) -> RuleSet:
        rules = tuple(self._rules)
        buckets = {k: tuple(v) for k, v in self._buckets.items()}
        if not prefilter:
            return RuleSet(rules, buckets)
        return RuleSet(rules, buckets, *necessary(rules))


def necessary(rules: tuple[Rule, ...]) -> tuple[tuple[Witness, ...], tuple[int, ...], tuple[int, ...]]:
    """Witnesses, clause counts and always-verified rules.

    A group of a selection that the rule cannot match without gives a clause if
    every predicate of it has a witness: a literal of three bytes or more, a
    number or a network, not negated and not another field's value."""
    found, clauses = [], []
    for i, rule in enumerate(rules):
        n = 0
        for s in _required(rule):
            for group in s.groups:
                own = [_witness(i, n, p) for p in group]
                if own and all(own) and n < 32:
                    found += own
                    n += 1
        clauses.append(n)
    always = tuple(i for i, n in enumerate(clauses) if not n)
    return tuple(found), tuple(clauses), always


def _required(rule: Rule) -> list[Selection]:
    """Selections without which the rule cannot match."""
    if not rule.condition:
        return list(rule.selections)
    stack: list[set[int]] = []
    for t in rule.condition:
        if t.kind == Kind.SEL:
            stack.append({t.index})
        elif t.kind == Kind.NOT and stack:
            stack[-1] = set()
        elif len(stack) > 1:
            b, a = stack.pop(), stack.pop()
            stack.append(a | b if t.kind == Kind.AND else a & b)
    return [rule.selections[i] for i in sorted(stack[0])] if len(stack) == 1 else []


def _witness(rule: int, clause: int, p: Predicate) -> Witness | None:
    if p.negate or p.fieldref:
        return None
    if p.op in (Op.EQ, Op.CONTAINS, Op.STARTSWITH, Op.ENDSWITH) and isinstance(p.value, str):
        literal = fold_literal(p.value)
        return Witness(rule, clause, p.field, literal) if len(literal.encode()) >= MIN_LITERAL else None
    if p.op in NUMERIC or p.op == Op.CIDR:
        return Witness(rule, clause, p.field, None, p.op, p.value)
    return None
