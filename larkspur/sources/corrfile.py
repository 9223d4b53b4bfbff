"""Correlation files: a JSON object with version 1 and an array of rules.

A wrong document is refused; a wrong rule is left out and counted.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from ..plans.model import COMPARISONS, MAX_GROUP_FIELDS, TYPES, Correlation, Kind, Token

# Limits of the file.
MAX_RULE_IDS, MAX_TOKENS, MAX_SPAN, MAX_ID = 4096, 256, (1 << 31) - 1, (1 << 32) - 1


class CorrelationFileError(ValueError):
    pass


@dataclass
class LoadStats:
    rules_rejected: int = 0
    rids_dropped: int = 0
    baserules_truncated: int = 0
    groupby_truncated: int = 0
    rules: list[Correlation] = field(default_factory=list)


class _Bad(Exception):
    pass


def loads(text: str) -> tuple[list[Correlation], LoadStats]:
    """The correlations of a document (not yet admitted), and what was left out."""
    try:
        doc = json.loads(text)
    except ValueError as e:
        raise CorrelationFileError(f"no JSON: {e}") from e
    if not isinstance(doc, dict) or doc.get("version") != 1 or isinstance(doc.get("version"), bool):
        raise CorrelationFileError("not version 1")
    if not isinstance(doc.get("correlations"), list):
        raise CorrelationFileError("no array of correlations")
    stats, rules = LoadStats(), []
    for entry in doc["correlations"]:
        try:
            if not isinstance(entry, dict):
                raise _Bad
            rules.append(_one(entry, stats))
        except _Bad:
            stats.rules_rejected += 1
    stats.rules = rules
    return rules, stats


def load(path: str) -> tuple[list[Correlation], LoadStats]:
    with open(path, encoding="utf-8") as f:
        return loads(f.read())


def _text(entry: dict, key: str) -> str | None:
    v = entry.get(key)
    return v if isinstance(v, str) else None


def _int(entry: dict, key: str, low: int, high: int) -> int:
    v = entry.get(key)
    if isinstance(v, bool) or not isinstance(v, int | float):
        return 0
    return max(low, min(high, int(v)))


def _ids(entry: dict, key: str, stats: LoadStats) -> tuple[int, ...]:
    values = entry.get(key)
    if not isinstance(values, list):
        return ()
    stats.baserules_truncated += max(0, len(values) - MAX_RULE_IDS)
    out = []
    for v in values[:MAX_RULE_IDS]:
        if isinstance(v, str):
            v = int(v) if v.strip().lstrip("+-").isdigit() else 0
        elif isinstance(v, float):
            v = int(v)
        elif not isinstance(v, int):
            v = 0
        if 0 <= v <= MAX_ID:
            out.append(int(v))
        else:
            stats.rids_dropped += 1
    return tuple(out)


def _names(values, stats: LoadStats) -> tuple[str, ...]:
    if not isinstance(values, list):
        return ()
    stats.groupby_truncated += max(0, len(values) - MAX_GROUP_FIELDS)
    return tuple(v if isinstance(v, str) else "" for v in values[:MAX_GROUP_FIELDS])


def _tokens(rows, n_base: int) -> tuple[Token, ...]:
    if not isinstance(rows, list):
        return ()
    if not 0 < len(rows) <= MAX_TOKENS:
        raise _Bad
    out = []
    for row in rows:
        kind = row.get("k") if isinstance(row, dict) else None
        if kind == "sel":
            r = row.get("r")
            if not isinstance(r, int) or isinstance(r, bool) or not 0 <= r < min(n_base, 64):
                raise _Bad
            out.append(Token(Kind.SEL, r))
        elif kind in ("and", "or", "not"):
            out.append(Token(Kind[kind.upper()]))
        else:
            raise _Bad
    return tuple(out)


def _one(entry: dict, stats: LoadStats) -> Correlation:
    base, group = _ids(entry, "base_rule_ids", stats), _names(entry.get("group_by"), stats)
    aliases: tuple[tuple[str, ...], ...] = ()
    rows = entry.get("alias_group_by")
    if isinstance(rows, list):
        if len(rows) != len(base) or not group:
            raise _Bad
        if any(not isinstance(r, list) or len(r) != len(group) for r in rows):
            raise _Bad
        aliases = tuple(tuple(v if isinstance(v, str) else "" for v in r) for r in rows)
    cond = entry.get("condition") if isinstance(entry.get("condition"), dict) else {}
    small = -(1 << 31), MAX_SPAN
    rule_id = _text(entry, "id")
    if rule_id is None:
        raise _Bad
    kind = _text(entry, "type")
    return Correlation(
        id=rule_id,
        type=kind if kind in TYPES else "",
        base_rule_ids=base,
        timespan_s=_int(entry, "timespan_s", -MAX_SPAN, MAX_SPAN),
        title=_text(entry, "title"),
        level=_text(entry, "level"),
        mitre=_text(entry, "mitre"),
        ordered_rule_ids=_ids(entry, "ordered_rule_ids", stats),
        group_by=group,
        alias_group_by=aliases,
        op=cond.get("op") if cond.get("op") in COMPARISONS else "gte",
        count=_int(cond, "count", -(1 << 63), (1 << 63) - 1),
        field=_text(cond, "field"),
        percentile=_int(cond, "percentile", *small),
        cv_permille=_int(cond, "cv_permille", *small),
        n_buckets=_int(cond, "n_buckets", *small),
        condition=_tokens(entry.get("condition_rpn"), len(base)),
    )
