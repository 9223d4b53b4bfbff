"""Detection and correlation rules as plain immutable objects."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import IntEnum

# Codes of the rule artifact.


class Op(IntEnum):
    EQ = 0
    CONTAINS = 1
    STARTSWITH = 2
    ENDSWITH = 3
    EXISTS = 4
    GT = 5
    GTE = 6
    LT = 7
    LTE = 8
    RE = 9
    CIDR = 10
    NUMEQ = 11


NUMERIC = (Op.GT, Op.GTE, Op.LT, Op.LTE, Op.NUMEQ)
TEXTUAL = (Op.EQ, Op.CONTAINS, Op.STARTSWITH, Op.ENDSWITH)


class Verdict(IntEnum):
    ALERT = 0
    BENIGN = 1
    ESCALATE = 2


class Kind(IntEnum):
    """What a condition token is."""

    SEL = 0
    AND = 1
    OR = 2
    NOT = 3


#: Deepest stack of a detection condition and of a correlation condition.
MAX_DEPTH = 64


@dataclass(frozen=True)
class Network:
    """A CIDR network: its version (4 or 6), prefix length and masked address."""

    version: int
    prefix: int
    address: bytes

    @classmethod
    def parse(cls, text: str) -> "Network":
        import ipaddress

        n = ipaddress.ip_network(text, strict=False)
        return cls(n.version, n.prefixlen, n.network_address.packed)

    def __str__(self) -> str:
        import ipaddress

        return f"{ipaddress.ip_address(self.address)}/{self.prefix}"


@dataclass(frozen=True)
class Predicate:
    """One test of one field. value is text, a number, a Network, the name of
    another field (fieldref) or None, as the operator asks for."""

    field: str
    op: Op
    value: str | int | Network | None = None
    cased: bool = False
    negate: bool = False
    fieldref: bool = False


#: Predicates of which one must hold.
Group = tuple[Predicate, ...]


@dataclass(frozen=True)
class Selection:
    """All groups must hold; a selection without groups never does."""

    groups: tuple[Group, ...] = ()


@dataclass(frozen=True)
class Token:
    kind: Kind
    index: int = 0


@dataclass(frozen=True)
class Rule:
    rule_id: int
    name: str | None = None
    selections: tuple[Selection, ...] = ()
    condition: tuple[Token, ...] = ()
    verdict: int = Verdict.ALERT
    severity: int = 0
    score_x100: int = 0
    mitre: str | None = None

    def fields(self) -> set[str]:
        out = set()
        for p in self.predicates():
            out.add(p.field)
            if p.fieldref:
                out.add(str(p.value))
        return out

    def predicates(self):
        return (p for s in self.selections for g in s.groups for p in g)


@dataclass(frozen=True)
class Witness:
    """A necessary condition: it satisfies a clause of a rule. For a text the
    literal must occur in the field (any field if None); otherwise the numeric
    or network test must hold."""

    rule: int
    clause: int
    field: str | None
    literal: str | None = None
    op: Op | None = None
    value: int | Network | None = None


@dataclass(frozen=True)
class RuleSet:
    """Rules with their routing buckets and necessary conditions.

    buckets maps a route value to the positions of its rules; the key "" holds
    the rules that are verified for every event. No buckets: no routing.
    clauses[i] is how many clauses rule i's witnesses must satisfy (0: always
    verified).
    """

    rules: tuple[Rule, ...] = ()
    buckets: dict[str, tuple[int, ...]] = field(default_factory=dict)
    witnesses: tuple[Witness, ...] = ()
    clauses: tuple[int, ...] = ()
    always: tuple[int, ...] = ()

    def fields(self) -> list[str]:
        return sorted(set().union(*(r.fields() for r in self.rules)))

    def position(self, rule_id: int) -> int | None:
        """The first rule of that identifier (identifiers need not be unique)."""
        return next((i for i, r in enumerate(self.rules) if r.rule_id == rule_id), None)


# --- correlations ------------------------------------------------------------

TYPES = (
    "event_count", "value_count", "temporal", "temporal_ordered", "value_sum", "value_avg", "beaconing",
    "value_percentile", "value_median",
)
COMPARISONS = ("gte", "gt", "lte", "lt", "eq")
# Limits of correlation rules.
MAX_GROUP_FIELDS, MAX_SEEN_RULES, MAX_BEACON_BUCKETS = 8, 64, 1024
#: Active share of the span of a bucketed beacon, in thousandths.
BEACON_PRESENCE = 700
STRONG_TYPES, STRONG_LEVELS = ("temporal", "temporal_ordered", "beaconing"), ("high", "critical")
WEIGHTS = {"strong": 0.6, "weak": 0.3}


@dataclass(frozen=True)
class Correlation:
    """A sliding-window rule over the hits of detection rules."""

    id: str
    type: str
    base_rule_ids: tuple[int, ...]
    timespan_s: int
    title: str | None = None
    level: str | None = None
    mitre: str | None = None
    ordered_rule_ids: tuple[int, ...] = ()
    group_by: tuple[str, ...] = ()
    alias_group_by: tuple[tuple[str, ...], ...] = ()
    op: str = "gte"
    count: int = 0
    field: str | None = None
    percentile: int = 0
    cv_permille: int = 0
    n_buckets: int = 0
    condition: tuple[Token, ...] = ()

    @property
    def order(self) -> tuple[int, ...]:
        return self.ordered_rule_ids or self.base_rule_ids

    @property
    def uses_field(self) -> bool:
        return self.type.startswith("value_")

    @property
    def tier(self) -> str:
        level = (self.level or "medium").lower()
        return "strong" if self.type in STRONG_TYPES or level in STRONG_LEVELS else "weak"

    @property
    def rank(self) -> int:
        """The percentile that value_percentile and value_median take."""
        k = 50 if self.type == "value_median" else self.percentile
        return 95 if k <= 0 else min(k, 100)

    def watches(self, rule_ids) -> bool:
        return not set(self.base_rule_ids).isdisjoint(rule_ids)

    def group_fields(self, rule_id: int) -> tuple[str, ...]:
        """The fields to group by when that base rule selected the correlation."""
        if self.alias_group_by and len(self.alias_group_by) == len(self.base_rule_ids):
            if rule_id in self.base_rule_ids:
                return self.alias_group_by[self.base_rule_ids.index(rule_id)]
        return self.group_by


def problem(c: Correlation) -> str | None:
    """Why a correlation is not admitted, or None."""
    if c.condition and len(c.base_rule_ids) > MAX_SEEN_RULES:
        return "condition over too many rules"
    checks = (
        (bool(c.id), "no id"),
        (c.type in TYPES, "unknown type"),
        (bool(c.base_rule_ids), "no base rules"),
        (c.timespan_s > 0, "no time span"),
        (len(c.group_by) <= MAX_GROUP_FIELDS, "too many group fields"),
        (not c.alias_group_by or len(c.alias_group_by) == len(c.base_rule_ids), "aliases don't fit"),
        (not c.uses_field or bool(c.field), "no field"),
        (c.type != "value_percentile" or 0 <= c.percentile <= 100, "percentile out of range"),
    )
    for good, why in checks:
        if not good:
            return why
    if c.type == "beaconing":
        if c.cv_permille <= 0 or c.count < 3:
            return "no tolerance or fewer than three events"
        if c.n_buckets < 0 or c.n_buckets and not 2 <= c.n_buckets <= min(MAX_BEACON_BUCKETS, c.timespan_s):
            return "bucket count out of range"
    return None


def admitted(rules) -> tuple[list[Correlation], dict[str, int]]:
    """The valid correlations, and how many were rejected (and over arity)."""
    good = [c for c in rules if problem(c) is None]
    over = sum(problem(c) == "condition over too many rules" for c in rules)
    return good, {"rules_rejected": len(rules) - len(good), "cond_over_arity": over}
